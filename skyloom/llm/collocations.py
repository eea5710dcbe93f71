"""Phrases that recur, mined from compressed position bitmaps, with the cohesion of their weakest cut.

The texts of a language are cut into shards. A shard numbers its words' positions, one position is left
free behind each piece, and keeps for each word a bitmap of its positions: the 16-bit units that aren't
zero, with their places. A phrase's bitmap has a bit where it ends. It is shifted by a position and
ANDed with the bitmaps of all words that have a unit there; what isn't zero are the bitmaps of the longer
phrases, and their popcounts are their counts in the shard. Phrases grow depth-first from groups of first
words; a gap behind each piece keeps them within it.

Counts of all shards are summed (``_shards``): of words, of pairs, then of two lengths at a time. Phrases grow only
from words and heads that reach the threshold, as no phrase is more frequent than its parts, so all that reach
it are found.
A phrase is named by the least shard that has it, which knows the counts of all its parts too.

Edge cases: null and empty texts have no words; a null language is ``und``; equal rows count as often as
they are there; a word or piece of any length counts; an empty table gives an empty result; only the
language and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skyloom.llm import _text
from skyloom.llm._shards import PACKETS, Known, given_back, packets, parts_for, recurring
from skyloom.llm._tables import save

LEAST = 30
LONGEST = 4
PERCENT = 80
TOP = 2000
#: Bytes of a shard's texts.
SHARD_BYTES = 4 << 20
#: Units that are ANDed at a time with those of all words.
GROUP = 1 << 17
#: Groups in which a language's phrases are ranked before the best of each meet.
RANKED = 32
_UNIT = 16
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_HEAD, _SIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHARD = "shard long, lang string, n long, words binary, units binary, places binary, bits binary"
_ROWS = 8


def bitmaps(raws: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for each its number of units; place and bits of the units by word."""
    data = _text.LOWER[np.frombuffer(b"\n".join([*raws, b""]), np.uint8)]
    inside = ~_GAP[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return [], *(np.zeros(0, np.int64) for _ in range(3))
    piece = np.cumsum(_BREAK[data])[starts]
    position = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    _, first, word = np.unique(_text.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(word, kind="stable")
    word, place = word[order], position[order] // _UNIT
    lead = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (place[1:] != place[:-1])]))
    bits = np.bitwise_or.reduceat(1 << (position[order] % _UNIT), lead)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.bincount(word[lead]), place[lead], bits


def position_shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Saved shards: language, number of words, distinct words joined by spaces, units of each, their places and bits."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            words, units, places, bits = bitmaps(held.pop(lang))
            sizes.pop(lang)
            number += 1
            wide = np.uint32 if len(places) and places.max() >= 1 << 16 else np.uint16
            row = [number - 1, lang, int(np.bitwise_count(bits).sum()), b" ".join(words), units.astype(np.int32).tobytes(), places.astype(wide).tobytes(), bits.astype(np.uint16).tobytes()]
            kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["shard", "lang", "n", "words", "units", "places", "bits"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                held.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
                if sizes[lang] >= SHARD_BYTES or sum(sizes.values()) >= 4 * SHARD_BYTES:
                    yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    return save(src.mapInArrow(run, _SHARD), rows=1000).where("n > 0")


def _then(keys: np.ndarray, words: np.ndarray, by: np.uint64) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _text.mix64((keys + by) * (by | np.uint64(1)) ^ words)


class _Shard:
    """A shard's words and bitmaps, and the hashes of its words as phrases of one."""

    def __init__(self, lang: str, words: bytes, units: bytes, places: bytes, bits: bytes):
        data = np.frombuffer(words + b" ", np.uint8)
        ends = np.flatnonzero(data == 0x20)
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.words = words.split(b" ")
        self.hashes = _text.span_hashes(data, starts, ends)
        tongue = _text.span_hashes(np.frombuffer(lang.encode() + b" ", np.uint8), np.array([0]), np.array([len(lang.encode())]))
        self.keys, self.sides = _then(tongue, self.hashes, _HEAD), _then(tongue, self.hashes, _SIDE)
        self.units = np.frombuffer(units, np.int32)
        self.bits = np.frombuffer(bits, np.uint16)
        self.places = np.frombuffer(places, f"u{len(places) // len(self.bits)}").astype(np.int64)

    def counts(self) -> np.ndarray:
        """Popcounts of the words' bitmaps."""
        return np.add.reduceat(np.bitwise_count(self.bits).astype(np.int64), np.cumsum(self.units) - self.units)


def grow(shard: _Shard, known: Known, first_length: int, longest: int, judged: int):
    """Yield (words by phrase, keys, sides, counts) of phrases of ``first_length`` to ``longest`` words, depth-first by groups of first words.

    Phrases of up to ``judged`` words that aren't known are left out, with all that begins with them.
    """
    _, frequent = known.find(shard.keys)
    ids = np.flatnonzero(frequent)
    if not len(ids):
        return
    mine = np.repeat(frequent, shard.units)
    word = np.repeat(np.arange(len(ids)), shard.units[ids])
    place, bits = shard.places[mine], shard.bits[mine]
    hashes, v = shard.hashes[ids], len(ids)
    by_place = np.argsort(place, kind="stable")
    all_words, all_bits = word[by_place], bits[by_place]
    at = np.searchsorted(place[by_place], np.arange(int(place.max()) + 3))
    first = np.cumsum(np.concatenate([[0], shard.units[ids]]))
    lo = 0
    while lo < v:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + GROUP, side="right")) - 1)
        own = slice(first[lo], first[hi])
        phrase, spot, here = word[own] - lo, place[own], bits[own]
        words, keys, sides = np.arange(lo, hi)[:, None], shard.keys[ids[lo:hi]], shard.sides[ids[lo:hi]]
        for length in range(2, longest + 1):
            # one position on; what leaves a unit enters the next
            over = here >> 15 == 1
            phrase, spot, here = np.concatenate([phrase, phrase[over]]), np.concatenate([spot, spot[over] + 1]), np.concatenate([here << 1, np.ones(int(over.sum()), np.uint16)])
            some = here != 0
            phrase, spot, here = phrase[some], spot[some], here[some]
            found = [_meet(phrase[i : i + GROUP], spot[i : i + GROUP], here[i : i + GROUP], at, all_words, all_bits) for i in range(0, len(phrase), GROUP)]
            if not sum(len(f[0]) for f in found):
                break
            phrase, nexts, spot, here = (np.concatenate(c) for c in zip(*found, strict=True))
            longer, which = np.unique(phrase * v + nexts, return_inverse=True)
            head, last = longer // v, longer % v
            words, keys, sides = np.hstack([words[head], last[:, None]]), _then(keys[head], hashes[last], _HEAD), _then(sides[head], hashes[last], _SIDE)
            counts = np.bincount(which, np.bitwise_count(here), len(longer)).astype(np.int64)
            phrase = which
            if length <= judged:
                _, keep = known.find(keys)
                place_of = np.cumsum(keep) - 1
                stays = keep[which]
                phrase, spot, here = place_of[which[stays]], spot[stays], here[stays]
                words, keys, sides, counts = words[keep], keys[keep], sides[keep], counts[keep]
            if length >= first_length and len(keys):
                yield ids[words], keys, sides, counts
            if not len(phrase):
                break
        lo = hi


def _meet(phrase, spot, here, at, all_words, all_bits):
    """AND each unit of the phrases with the units of all words at its place: phrase, word, place and bits of what is left."""
    n = at[spot + 1] - at[spot]
    row = np.repeat(np.arange(len(phrase)), n)
    other = np.arange(len(row)) + np.repeat(at[spot] - (np.cumsum(n) - n), n)
    both = here[row] & all_bits[other]
    hit = np.flatnonzero(both)
    row = row[hit]
    return phrase[row], all_words[other[hit]], spot[row], both[hit]


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield row, _Shard(*(row[c] for c in ("lang", "words", "units", "places", "bits")))


def frequent_keys(shards: DataFrame, least: int, longest: int) -> DataFrame:
    """What comes back to the shards of all phrases of up to ``longest`` words that reach ``least``."""
    parts = parts_for(shards, shards.agg(F.sum("n")).first()[0] or 0)

    def words(batches):
        for row, shard in _read(batches):
            yield packets(row["shard"], shard.keys, shard.sides, shard.counts().astype(np.int32), parts)

    def phrases(length, longest):
        def run(batches):
            for row, shard in _read(batches):
                found = list(grow(shard, Known(row["back"]), length, longest, length - 1))
                if found:
                    _, keys, sides, counts = (list(c) for c in zip(*found, strict=True))
                    yield packets(row["shard"], np.concatenate(keys), np.concatenate(sides), np.concatenate(counts).astype(np.int32), parts)

        return run

    back = [save(recurring(shards.mapInArrow(words, PACKETS), parts, least), rows=_ROWS)]
    # pairs alone, as they rule most out; then two lengths at a time, which moves the shards half as often for few more keys
    length = 2
    while length <= longest:
        upto = min(longest, length + (length > 2))
        sent = given_back(shards, reduce(DataFrame.union, back)).mapInArrow(phrases(length, upto), PACKETS)
        back.append(save(recurring(sent, parts, least), rows=_ROWS))
        length = upto + 1
    return reduce(DataFrame.union, back)


def phrase_counts(shards: DataFrame, back: DataFrame, longest: int, percent: int) -> DataFrame:
    """lang, phrase, a, the counts l and r of both sides of each cut, and the shorter phrases inside that it makes drop; one row a phrase."""

    def run(batches):
        for row, shard in _read(batches):
            known = Known(row["back"])
            out = []
            total = lambda keys: known.totals[known.find(keys)[0]]
            for words, keys, _, _ in grow(shard, known, 2, longest, longest):
                at, _ = known.find(keys)
                mine = known.own[at] == 1
                words, a = words[mine], known.totals[at[mine]]
                if not len(words):
                    continue
                size = words.shape[1]
                inner = {}  # (first, end): totals of these words as a phrase
                for i in range(size):
                    part = shard.keys[words[:, i]]
                    inner[i, i + 1] = total(part)
                    for j in range(i + 1, size):
                        part = _then(part, shard.hashes[words[:, j]], _HEAD)
                        inner[i, j + 1] = total(part)
                names = [[shard.words[w].decode("utf-8", "surrogatepass") for w in p] for p in words.tolist()]
                drops = [(i, j, (100 * a >= percent * inner[i, j]).tolist()) for i, j in inner if 2 <= j - i < size]
                l, r = np.stack([inner[0, k] for k in range(1, size)], 1).tolist(), np.stack([inner[k, size] for k in range(1, size)], 1).tolist()
                for x, name in enumerate(names):
                    out.append((row["lang"], " ".join(name), int(a[x]), l[x], r[x], [" ".join(name[i:j]) for i, j, gone in drops if gone[x]]))
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["lang", "phrase", "a", "ls", "rs", "drops"])

    return save(given_back(shards, back).mapInArrow(run, "lang string, phrase string, a long, ls array<long>, rs array<long>, drops array<string>"), rows=_ROWS)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of most cohesion, without those that longer ones stand for."""
    shards = position_shards(docs, lang_col, text_col)
    counted = phrase_counts(shards, frequent_keys(shards, least, longest), longest, percent)
    gone = counted.select("lang", F.explode("drops").alias("phrase")).distinct()
    kept = counted.join(gone, ["lang", "phrase"], "left_anti")
    # of the cuts the lowest score, then the first
    cut = F.expr("array_min(transform(ls, (l, i) -> struct(cast((2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(rs[i] as decimal(20,0))) as long) as score, i as k, l as l, rs[i] as r)))")
    scored = kept.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    some = scored.withColumn("group", group).withColumn("i", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*best))).where(F.col("i") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select(F.col("lang").cast(StringType()), "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP) -> str:
    """DuckDB SQL of the same rows: all phrases of each piece, counted as text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH pieces AS (SELECT lang, unnest(list_transform(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\f\\r]'), lambda p: list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda w: w <> ''))) AS ws
 FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, '{upper}', '{upper.lower()}') AS t FROM documents WHERE text <> '')),
 n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
 f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM pieces, range(1, {longest + 1}) r(k) WHERE len(ws) >= k) GROUP BY ALL),
 c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {least}),
 cuts AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * c.a) // (l.a + r.a) AS BIGINT) AS score, cut
 FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1 : c.k], ' ')),
 inner_ AS (SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
 gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= {percent} * c.a),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts) WHERE o = 1),
 ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN gone g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.phrase IS NULL)
 SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""
