"""Language of the words of code-switched texts by a linear-chain conditional random field.

A word's features are its beginnings and endings, inner byte n-grams and, as a lexicon, the word
itself, hashed into one weight table; transitions between the languages of neighbouring words are
learned with them. The labels' marginals come from the forward-backward algorithm over the whole
text. A text's language is the one with most expected words.

Learning takes about ``SAMPLE`` texts of each language (a hash of the id chooses them), each language
within its own share of ``WORDS``, cuts them into passages and joins passages of different texts, so that languages switch within a
sequence. Of a text that is longer than an eighth of its language's share (``LEAST_TEXTS``; 94,000 characters with four
languages) only the start is learned from, so that one text isn't a language's whole sample. Predictions
read whole texts, always.

Edge cases: null texts and texts without letters are ``und`` with score 0; words without letters
have no features and follow their neighbours; null languages aren't learned from; with nothing to
learn from every text is ``und``. Only the id, text and language columns are read, so other columns
can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm import _text

#: About so many texts of each language, and at most so many words of all, are learned from; with more than LANGUAGES
#: languages the words of all are fewer in proportion, as each word is scored in each language. No language is left out.
SAMPLE = 400
WORDS = 500_000
LANGUAGES = 64
#: The share of the words of a language is room for so many texts at least; longer texts are learned from by their start.
LEAST_TEXTS = 8
TABLE = 1 << 16
GRAM = 3
CHUNK = 64
_TRIM = np.zeros(256, bool)
_TRIM[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True


def trimmed_words(raws: list[bytes]):
    """Lower-cased block, starts and ends of words without marks around them, and bounds of texts."""
    data, at = _text.join(raws)
    starts, ends, bounds = _text.word_spans(data, at)
    if len(starts):
        # the nearest byte that is no mark, from the front and from the back; words of marks alone are empty
        at, plain = np.arange(len(data)), ~_TRIM[data]
        behind = np.minimum.accumulate(np.where(plain, at, len(data))[::-1])[::-1][starts]
        before = np.maximum.accumulate(np.where(plain, at, -1))[ends - 1]
        empty = behind >= ends
        starts, ends = np.where(empty, starts, behind), np.where(empty, starts, before + 1)
    return _text.LOWER[data], starts, ends, bounds


def word_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Rows of the weight table for each word: fixed slots (word, affixes; 0 is none) and inner n-grams with their bounds."""
    n = len(starts)
    size = ends - starts
    lettered = np.concatenate([[0], np.cumsum(_ALPHA[low] | (low >= 0xC3))])
    word_like = lettered[ends] > lettered[starts]

    def rows(a, b, kind, fits):
        out = np.zeros(len(a), np.int64)
        if fits.any():
            h = _text.span_hashes(low, a[fits], b[fits]) + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            out[fits] = 1 + (_text.mix64(h) % np.uint64(TABLE - 1)).astype(np.int64)
        return out

    slots = [rows(starts, ends, 1, word_like)]
    for k in (1, 2, 3, 4):
        fits = word_like & (size >= k)
        slots.append(rows(starts, np.minimum(starts + k, ends), 1 + k, fits))
        slots.append(rows(np.maximum(ends - k, starts), ends, 5 + k, fits))
    count = np.where(word_like, np.maximum(size - GRAM + 1, 0), 0)
    owner = np.repeat(np.arange(n), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    grams = rows(inner, inner + GRAM, 11, np.ones(len(inner), bool))
    return np.stack(slots, axis=1), grams, owner, count, word_like


def word_scores(weights: np.ndarray, slots, grams, owner, count) -> np.ndarray:
    """Emission score of each language for each word; inner n-grams count by their mean."""
    out = weights[slots].sum(axis=1)
    for c in range(weights.shape[1] if len(owner) else 0):
        out[:, c] += np.bincount(owner, weights[grams, c], len(out)) / np.maximum(1, count)
    return out


def marginals(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label marginals of every word by forward-backward over whole texts.

    Texts are cut into chunks; the chunks' transfer matrices are multiplied out side by side, passed
    along each text, and give every chunk its exact incoming and outgoing messages.
    """
    n, labels = scores.shape
    if not n:
        return np.zeros((0, labels))
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    sizes = np.diff(bounds)
    parts = -(-sizes // CHUNK)
    first = np.cumsum(parts) - parts
    total = int(parts.sum())
    text_of = np.repeat(np.arange(len(sizes)), parts)
    begin = np.repeat(bounds[:-1], parts) + (np.arange(total) - np.repeat(first, parts)) * CHUNK
    length = np.minimum(CHUNK, np.repeat(bounds[1:], parts) - begin)
    # longest chunks first, so that those at work are a prefix
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(CHUNK)]
    transfer = np.tile(np.eye(labels), (total, 1, 1))
    for t in range(CHUNK):
        if not (k := active[t]):
            break
        m = (transfer[:k] @ step) * emit[begin[:k] + t][:, None, :]
        transfer[:k] = m / m.sum(axis=(1, 2), keepdims=True)
    back = np.empty(total, np.int64)
    back[order] = np.arange(total)
    ahead = np.full((total, labels), 1.0 / labels)
    behind = np.ones((total, labels))
    width = int(parts.max())
    several = np.flatnonzero(parts > 1)
    several = several[np.argsort(-parts[several], kind="stable")]
    for p in range(1, width):
        several_p = several[: int(np.searchsorted(-parts[several], -p, side="left"))]
        now = back[first[several_p] + p]
        before = back[first[several_p] + p - 1]
        v = (ahead[before][:, None, :] @ transfer[before])[:, 0]
        ahead[now] = v / v.sum(axis=1, keepdims=True)
    for p in range(width - 2, -1, -1):
        several_p = several[: int(np.searchsorted(-parts[several], -(p + 1), side="left"))]
        now = back[first[several_p] + p]
        after = back[first[several_p] + p + 1]
        v = (transfer[after] @ behind[after][:, :, None])[:, :, 0]
        behind[now] = v / v.sum(axis=1, keepdims=True)
    out = np.empty((n, labels))
    v = ahead
    for t in range(CHUNK):
        if not (k := active[t]):
            break
        v = (v[:k] @ step) * emit[begin[:k] + t]
        v /= v.sum(axis=1, keepdims=True)
        out[begin[:k] + t] = v
    w = behind
    for t in range(CHUNK - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        at = begin[:k] + t
        out[at] *= w[:k]
        moved = (w[:k] * emit[at]) @ step.T
        w[:k] = moved / moved.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


class Model:
    """Languages, weight table and transitions."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray):
        self.langs, self.weights, self.moves = langs, weights, moves

    def word_marginals(self, raws: list[bytes]):
        low, starts, ends, bounds = trimmed_words(raws)
        keys = _text.span_hashes(low, starts, ends)
        _, lead, which = np.unique(keys, return_index=True, return_inverse=True)
        *features, word_like = word_features(low, starts[lead], ends[lead])
        scores = word_scores(self.weights, *features)
        return marginals(scores[which], bounds, self.moves), bounds, word_like[which]

    def texts(self, raws: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the expected words of each text."""
        lettered = [any(c.isalpha() for c in r.decode("utf-8", "replace")) for r in raws]
        if not self.langs or not any(lettered):
            return ["und"] * len(raws), np.zeros(len(raws))
        m, bounds, word_like = self.word_marginals(raws)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(m * word_like[:, None], axis=0)])
        expected = sums[bounds[1:]] - sums[bounds[:-1]]
        share = expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-12)
        best = share.argmax(axis=1)
        langs = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)]
        return langs, np.where(lettered, np.clip(share[np.arange(len(raws)), best], 0, 1), 0.0)


def train(texts: list[str], langs: list[str], rounds: int = 30, seed: int = 9) -> Model:
    """Maximise the labels' conditional likelihood with adaptive gradient steps over all passages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((TABLE, 1)), np.zeros((1, 1)))
    labels = len(names)
    low, starts, ends, bounds = trimmed_words([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    _, lead, which = np.unique(_text.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    slots, grams, owner, count, _ = word_features(low, starts[lead], ends[lead])
    del low, starts, ends
    truth = np.repeat([names.index(x) for x in langs], np.diff(bounds))
    # passages of 10 to 150 words, then shuffled and joined
    rng = np.random.default_rng(seed)
    passages = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while a < b:
            size = int(rng.integers(10, 151))
            passages.append((a, min(b, a + size)))
            a += size
    rng.shuffle(passages)
    sequence = np.concatenate([np.arange(a, b) for a, b in passages]) if passages else np.zeros(0, np.int64)
    if len(sequence) < 2:
        return Model(names, np.zeros((TABLE, labels)), np.zeros((labels, labels)))
    limit = np.arange(0, len(sequence) + 256, 256).clip(max=len(sequence))
    limit = np.unique(limit)
    word, y = which[sequence], truth[sequence]
    same = np.zeros((labels, labels))
    inside = np.ones(len(sequence), bool)
    inside[limit[:-1]] = False
    pairs = np.flatnonzero(inside)
    np.add.at(same, (y[pairs - 1], y[pairs]), 1)
    # transitions: log relative frequencies of the joined passages
    moves = np.log((same + 1) / (same + 1).sum(axis=1, keepdims=True))
    weights = np.zeros((TABLE, labels))
    square, square_m = np.full((TABLE, labels), 1e-8), np.full((labels, labels), 1e-8)
    want = np.zeros((len(lead), labels))
    np.add.at(want, (word, y), 1)
    per_gram = 1 / np.maximum(1, count)[owner]
    for r in range(rounds):
        scores = word_scores(weights, slots, grams, owner, count)
        m = marginals(scores[word], limit, moves)
        have = np.stack([np.bincount(word, m[:, c], len(lead)) for c in range(labels)], axis=1)
        diff = (want - have) / len(sequence)
        grad = np.zeros_like(weights)
        for c in range(labels):
            for s in range(slots.shape[1]):
                grad[:, c] += np.bincount(slots[:, s], diff[:, c], TABLE)
            grad[:, c] += np.bincount(grams, diff[owner, c] * per_gram, TABLE)
        grad -= 1e-6 * weights
        grad[0] = 0
        square += grad**2
        weights += 0.5 * grad / np.sqrt(square)
        # transitions follow the expected pairs (by neighbouring marginals)
        have_m = m[pairs - 1].T @ m[pairs]
        grad_m = (same - have_m) / len(sequence)
        square_m += grad_m**2
        moves += 0.05 * grad_m / np.sqrt(square_m) / (1 + r)
    return Model(names, weights, moves)


def held_out(id_col: Column) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text is 2 modulo 4. A null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _within_shares(texts: list, budget: float) -> set:
    """(doc_id, lang) of the texts (rows with doc_id, lang, k and n words) within the languages' shares of ``budget`` words, in the order of k."""
    by_lang: dict[str, list] = {}
    for row in sorted(texts, key=lambda r: r["k"]):
        by_lang.setdefault(row["lang"], []).append(row)
    kept, left = set(), budget
    # languages of few words first: the others share what they leave
    for done, lang in enumerate(sorted(by_lang, key=lambda x: (sum(r["n"] for r in by_lang[x]), x))):
        share, used = left / (len(by_lang) - done), 0.0
        for row in by_lang[lang]:
            if used + row["n"] <= share + 1e-6:
                used += row["n"]
                kept.add((row["doc_id"], lang))
        left -= used
    return kept


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from a bounded sample of every language that has texts which aren't held out.

    Each language's share of the ids' hashes gives about ``sample`` texts. Each has its own part of the words, and what
    languages with fewer words leave goes to the others.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col(id_col)))
    # one row a language
    counts = src.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return train([], [])
    budget = WORDS * min(1.0, LANGUAGES / len(counts))
    longest = max(1, int(6 * budget / len(counts) / LEAST_TEXTS))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, sample / r["count"]))]), F.col("lang"))
    picked = src.where(hashed < rate).select("doc_id", F.substring("text", 1, longest).alias("text"), "lang", hashed.alias("h"))
    # one row a text, about ``sample`` a language
    nearest = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    small = picked.select("doc_id", "lang", (F.length("text") / 6).alias("n"), "h").withColumn("k", nearest).where(F.col("k") <= 2 * sample).collect()
    kept = _within_shares(small, budget)
    if not kept:
        return train([], [])
    # as many rows as texts to learn from
    ids = F.broadcast(docs.sparkSession.createDataFrame(sorted(kept, key=str), "doc_id long, lang string"))
    rows = picked.join(ids, picked["doc_id"].eqNullSafe(ids["doc_id"]) & (picked["lang"] == ids["lang"]), "left_semi").select("doc_id", "text", "lang").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    texts, langs = [r["text"] for r in rows], [r["lang"] for r in rows]
    rows = small = None  # the texts once are enough
    return train(texts, langs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; one pass, no shuffle. The model's table is of fixed size and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights.astype(np.float32), model.moves))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for lo, hi, raws in _text.blocks(batch.column("text").to_pylist()):
                langs, share = own.texts(raws)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(share)], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and marginal of every word: doc_id, and the lists word_langs and word_scores in text order."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights.astype(np.float32), model.moves))

    def run(batches):
        own = Model(*shared.value)
        names = np.array([*own.langs, "und"], object)
        for batch in batches:
            for lo, hi, raws in _text.blocks(batch.column("text").to_pylist()):
                m, bounds, _ = own.word_marginals(raws)
                best = m.argmax(axis=1) if m.size else np.zeros(0, np.int64)
                cuts = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(cuts, pa.array(names[best].tolist(), pa.string())), pa.ListArray.from_arrays(cuts, pa.array(m[np.arange(len(best)), best]))], names=["doc_id", "word_langs", "word_scores"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, word_langs array<string>, word_scores array<double>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows whose text has a language with at least ``least`` of its words, all columns as they are; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights.astype(np.float32), model.moves))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            if batch.num_rows:
                kept = []
                for _, _, raws in _text.blocks(batch.column(text_col).to_pylist()):
                    langs, share = own.texts(raws)
                    kept += [lang != "und" and s >= least for lang, s in zip(langs, share.tolist(), strict=True)]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
