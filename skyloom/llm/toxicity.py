"""Toxicity scores from gradient-boosted trees over dense features with isotonic calibration.

Features of a text: densities of a seed lexicon and of words and word beginnings learned from labelled
rows, lexicon words near second-person pronouns, capitals, punctuation, obfuscation and repetition
rates. The learned lexicon has one half of a bounded sample of labelled rows (``SAMPLE`` rows, the least
by a hash of the id) and the trees the other; isotonic calibration learns from margins of trees that
haven't seen their rows (``FOLDS`` folds), whatever the number of rows. Scoring covers every row in one
pass without a shuffle.

Edge cases: null and empty texts have zero features and a score like any other; documents without a
label are scored; labels without a document, null labels and repeated labels (the greatest counts, also
among equal texts) don't fail; with no labels or one class the score is the seed lexicon's presence. Only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text

#: Most labelled rows that are learned from.
SAMPLE = 24_000
#: Most learned words and word beginnings.
LEXICON = 4_000
STEMS = (4, 5, 6, 7)
FOLDS = 3
#: Words between a lexicon word and a second-person one at most, to both sides.
NEAR = 5
# Common insults and second-person words in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage clown clowns pathetic worthless disgusting ugly fool imbecile jerk creep pig filth vermin retard bastard bitch asshole shit fuck fucking hate kill "
    "dumm idioten trottel arschloch scheisse abschaum widerlich wertlos depp verlierer connard salaud imbécile ordure crétin débile minable dégoûtant idiota estúpido imbécil basura asqueroso patético inútil tonto cabrón mierda"
).split()
YOU = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes tú ti vos".split()
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _maps() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte maps: lower case; lower case with look-alikes undone; bytes dropped from words in each."""
    plain = _text.LOWER.copy()
    leet = plain.copy()
    for a, b in _LEET.items():
        leet[ord(a)] = ord(b)
    mark = np.zeros(256, bool)
    for b in range(33, 127):
        mark[b] = not chr(b).isalnum()
    unleet = mark.copy()
    unleet[[ord("@"), ord("$")]] = False
    return plain, leet, mark, unleet


_PLAIN, _UNLEET, _MARK, _MARK_LEET = _maps()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTERISH = np.zeros(256, bool)
_LETTERISH[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
FEATURES = "words seed seed_hits hidden word_sum word_max word_hits stem_sum stem_max stem_hits near_you you capitals shouted marks exclaims symbols mixed repeats mean_length lines".split()


def _hashes(words: list[str]) -> np.ndarray:
    data, at = _text.join([w.encode() for w in words])
    return np.sort(_text.span_hashes(data, at[:-1], at[1:] - 1))


_SEED, _YOU = _hashes(INSULTS), _hashes(YOU)


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _clean(data: np.ndarray, at: np.ndarray, mapped: np.ndarray, drop: np.ndarray):
    """The block with marks dropped from its words: bytes, word starts and ends, first word of each text."""
    keep = ~drop[data]
    moved = np.concatenate([[0], np.cumsum(keep)])
    out = mapped[data[keep]]
    starts, ends, bounds = _text.word_spans(out, moved[at])
    return out, starts, ends, bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums by text, each of its own values alone, so that a text's sum is the same in any block."""
    out = np.zeros(len(bounds) - 1)
    filled = bounds[1:] > bounds[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(np.asarray(values, np.float64), bounds[:-1][filled])
    return out


def _around(flags: np.ndarray, bounds: np.ndarray, reach: int) -> np.ndarray:
    """Whether a flag is set at most ``reach`` places away in the same text."""
    at = np.flatnonzero(flags)
    text = np.searchsorted(bounds, at, side="right") - 1
    steps = np.zeros(len(flags) + 1, np.int64)
    np.add.at(steps, np.maximum(at - reach, bounds[text]), 1)
    np.add.at(steps, np.minimum(at + reach + 1, bounds[text + 1]), -1)
    return np.cumsum(steps)[:-1] > 0


def _maxima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1)
    filled = bounds[1:] > bounds[:-1]
    if filled.any():
        out[filled] = np.maximum.reduceat(values, bounds[:-1][filled])
    return out


def block_items(raws: list[bytes]):
    """Hashes of the words and of their beginnings (0 where a word is not longer), and the bounds of texts."""
    data, at = _text.join(raws)
    out, starts, ends, bounds = _clean(data, at, _PLAIN, _MARK)
    word = _text.span_hashes(out, starts, ends)
    stems = []
    for k in STEMS:
        long = ends - starts > k
        key = np.zeros(len(word), np.uint64)
        key[long] = _text.span_hashes(out, starts[long], starts[long] + k) + np.uint64(k)
        stems.append(key)
    return data, at, word, stems, bounds, ends - starts


def features(raws: list[bytes], lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each text. ``lexicon``: sorted hashes of learned items and their weights."""
    data, at, word, stems, bounds, length = block_items(raws)
    keys, weights = lexicon
    n = np.maximum(1, np.diff(bounds))
    seed = (_member(word, _SEED) >= 0).astype(np.float64)
    found = _member(word, keys)
    gain = np.where(found >= 0, weights[np.maximum(found, 0)], 0.0) if len(keys) else np.zeros(len(word))
    stem = np.zeros(len(word))
    for s in stems:
        hit = _member(s, keys)
        if len(keys):
            stem = np.maximum(stem, np.where(hit >= 0, weights[np.maximum(hit, 0)], 0.0))
    # lexicon words once look-alike characters are undone
    out, s2, e2, b2 = _clean(data, at, _UNLEET, _MARK_LEET)
    undone = _text.span_hashes(out, s2, e2)
    listed = np.where(_member(undone, _SEED) >= 0, 1.0, 0.0)
    if len(keys):
        listed = np.maximum(listed, _member(undone, keys) >= 0)
    any_hit = ((seed > 0) | (gain > 0)).astype(np.float64)
    hidden = np.maximum(0, _sums(listed, b2) - _sums(any_hit, bounds))
    you = _member(word, _YOU) >= 0
    near = any_hit * _around(you, bounds, NEAR)
    size = np.maximum(1, np.diff(at) - 1)
    space = _text.SPACE[data]
    starts, ends, wb = _text.word_spans(data, at)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letter = np.concatenate([[0], np.cumsum(_LETTERISH[data])])
    mark = np.concatenate([[0], np.cumsum(_MARK[data])])
    of = lambda c: c[ends] - c[starts]
    shouted = (of(upper) > 2) & (of(upper) == of(letter))
    inner = ends - starts > 2
    middle_marks = np.zeros(len(starts), np.int64)
    middle_marks[inner] = mark[ends[inner] - 1] - mark[starts[inner] + 1]
    mixed = (of(letter) > 0) & ((of(digit) > 0) | (middle_marks > 0))
    same = np.zeros(len(data))
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & ~space[2:]
    by_text = lambda flags: _sums(flags, at)
    word_n = np.maximum(1, np.diff(wb))
    cols = [
        np.log1p(np.diff(bounds)), _sums(seed, bounds) / n, _sums(seed, bounds), hidden / n, _sums(gain, bounds) / n, _maxima(gain, bounds), _sums(gain > 0, bounds),
        _sums(stem, bounds) / n, _maxima(stem, bounds), _sums(stem > 0, bounds), _sums(near, bounds) / n, _sums(you, bounds) / n, by_text(_UPPER[data]) / size, _sums(shouted, wb) / word_n,
        by_text(_MARK[data]) / size, by_text(data == 33) / size, by_text(np.isin(data, [35, 36, 37, 38, 42, 64])) / size, _sums(mixed, wb) / word_n, by_text(same) / size, _sums(length, bounds) / n, by_text(data == 10) / size,
    ]
    return np.stack(cols, axis=1)


class Trees:
    """Gradient-boosted trees of fixed depth for log loss; splits at feature quantiles."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: int = 4, ridge: float = 2.0, cuts: int = 48):
        self.rounds, self.depth, self.rate, self.least, self.ridge, self.cuts = rounds, depth, rate, least, ridge, cuts
        self.start, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        grids = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 2)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(g, x[:, f], side="left") for f, g in enumerate(grids)], axis=1)
        width = self.cuts + 2
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.start)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(1 << self.depth)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                base, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-6)
                split_bin = np.full(n, width)
                for f in range(x.shape[1]):
                    cell = (at - base) * width + binned[:, f]
                    g = np.bincount(cell, grad, n * width).reshape(n, width).cumsum(axis=1)
                    h = np.bincount(cell, hess, n * width).reshape(n, width).cumsum(axis=1)
                    c = np.bincount(cell, minlength=n * width).reshape(n, width).cumsum(axis=1)
                    G, H, C = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + self.ridge) + (G - g) ** 2 / (H - h + self.ridge) - G**2 / (H + self.ridge)
                    gain[(c < self.least) | (C - c < self.least)] = -1
                    gain[:, len(grids[f]) :] = -1
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(n), k] > best
                    best[better] = gain[np.arange(n), k][better]
                    feature[base : base + n][better] = f
                    split_bin[better] = k[better]
                    cut[base : base + n][better] = grids[f][k[better]]
                at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > split_bin[at - base])
            leaf = at - inner
            g, h = np.bincount(leaf, grad, 1 << self.depth), np.bincount(leaf, hess, 1 << self.depth)
            value = -self.rate * g / (h + self.ridge)
            margin += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step means (pool adjacent violators), each block smoothed by a half count of either class."""
    order = np.argsort(margin, kind="stable")
    xs, ys = margin[order], y[order].astype(float)
    blocks: list[list[float]] = []
    for a, b in zip(xs.tolist(), ys.tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    px = np.array([v for b in blocks for v in (b[2], b[3])])
    py = np.array([v for b in blocks for v in [(b[0] + 0.25) / (b[1] + 0.5)] * 2])
    return px, np.maximum.accumulate(py)


class Model:
    """Learned lexicon, trees and calibration."""

    def __init__(self, lexicon, trees: Trees | None, steps):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.where(x[:, FEATURES.index("seed_hits")] > 0, 0.9, 0.05)
        m = self.trees.margin(x)
        even = np.interp(m, *self.steps) if self.steps is not None else 1 / (1 + np.exp(-m))
        # a trace of the margin keeps the order within a step
        return np.clip(even + 0.002 * (1 / (1 + np.exp(-m)) - 0.5), 0, 1)


def held_out(id_col: Column) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text divides by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that aren't held out. Items of the lexicon are counted on the cluster."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    ranked = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(8)))
    picked = ranked.orderBy("h", "doc_id").limit(sample).select("doc_id", "y", F.pmod("h", F.lit(20)).alias("part"))
    rows = picked.toPandas()
    empty = (np.zeros(0, np.uint64), np.zeros(0))
    if rows.empty or rows["y"].nunique() < 2:
        return Model(empty, None, None)
    # at most ``sample`` small rows
    chosen = F.broadcast(spark.createDataFrame(rows, "doc_id long, y int, part int"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")

    def items(batches):
        seen: dict[int, list[int]] = {}
        for batch in batches:
            ys = batch.column("y").to_pylist()
            for lo, _, raws in _text.blocks(batch.column("text").to_pylist()):
                _, _, word, stems, bounds, _ = block_items(raws)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.unique(np.concatenate([word[a:b], *(s[a:b] for s in stems)]))
                    for key in own[own > 0].tolist():
                        seen.setdefault(key, [0, 0])[ys[lo + i]] += 1
        keys = np.fromiter(seen, np.uint64, len(seen)).view(np.int64)
        counts = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(counts[k : k + 100_000, 1]), pa.array(counts[k : k + 100_000, 0])], names=["item", "pos", "neg"])

    # equal texts count once, as toxic if one of them is
    lexical = texts.where("part < 10").groupBy(F.sha2("text", 256).alias("fp")).agg(F.max("y").alias("y"), F.min("text").alias("text")).select("text", "y")
    n_pos, n_neg = max(1, int(rows.query("part < 10")["y"].sum())), max(1, int((1 - rows.query("part < 10")["y"]).sum()))
    counted = lexical.mapInArrow(items, "item long, pos long, neg long").groupBy("item").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.2) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.2) / (n_neg + 1.0))
    worth = counted.where((F.col("pos") >= 3) & (odds > 2.0)).select("item", (odds * F.col("pos") / (F.col("pos") + 3.0)).alias("w"))
    best = worth.orderBy(F.desc("w"), "item").limit(LEXICON).toPandas()
    keys = best["item"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    lexicon = (keys[order], best["w"].to_numpy(float)[order])

    def dense(batches):
        for batch in batches:
            for lo, hi, raws in _text.blocks(batch.column("text").to_pylist()):
                x = features(raws, lexicon)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), batch.column("part").slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "part", "x"])

    table: pd.DataFrame = texts.where("part >= 10").select("doc_id", "text", "y", "part").mapInArrow(dense, "doc_id long, y int, part int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if table.empty or table["y"].nunique() < 2:
        return Model(lexicon, None, None)
    x, y, part = np.array(table["x"].tolist()), table["y"].to_numpy(float), table["part"].to_numpy()
    # margins of rows that their trees haven't seen, for the calibration; the trees that stay have seen all
    unseen = np.zeros(len(y))
    for fold in range(FOLDS):
        own = part % FOLDS == fold
        rest = own if own.all() or len(set(y[~own])) < 2 else ~own
        unseen[own] = Trees().fit(x[rest], y[rest]).margin(x[own]) if own.any() else 0
    trees, steps = Trees().fit(x, y), isotonic(unseen, y)
    return Model(lexicon, trees, steps)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the model is a few hundred KB."""

    def run(batches):
        for batch in batches:
            for lo, hi, raws in _text.blocks(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(model.score(features(raws, model.lexicon)))], names=["doc_id", "held_out", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores under ``cut``, all columns as they are; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(text_col).to_pylist()
                kept = np.concatenate([model.score(features(raws, model.lexicon)) < cut for _, _, raws in _text.blocks(texts)])
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
