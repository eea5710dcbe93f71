"""Document fingerprints by one-permutation MinHash.

Every word 5-gram is hashed once; the top bits choose a bin and the bin keeps its least hash.
Empty bins copy the first filled bin of a fixed pseudo-random probing order of their own (optimal
densification), and the low bits of each bin are packed. The likeness of two fingerprints is the
share of equal bins, corrected for the chance that low bits agree.

Edge cases: null and empty texts have the empty fingerprint; two empty fingerprints have likeness 1,
an empty and a filled one 0. Texts of fewer than five words are one shingle. Rows keep their
multiplicity; only the named id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text

BINS = 512
BITS = 4
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_order: dict[int, np.ndarray] = {}


def probing_order(bins: int = BINS) -> np.ndarray:
    """For each bin, the fixed order in which it looks for a filled bin."""
    if bins not in _order:
        seeds = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins) * np.uint64(0x9FB21C651E98DF25)
        _order[bins] = np.argsort(_text.mix64(seeds + np.uint64(1)), axis=1, kind="stable").astype(np.int32)
    return _order[bins]


def bin_values(grams: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """Low bits of each bin's least hash after densification; None for an empty set. ``grams``: sorted, distinct."""
    if not len(grams):
        return None
    cell = (grams >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int32)
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    filled = np.zeros(bins, bool)
    values = np.zeros(bins, np.uint64)
    filled[cell[first]] = True
    values[cell[first]] = grams[first]
    if not filled.all():
        order, empty = probing_order(bins), np.flatnonzero(~filled)
        for attempt in range(32 if np.count_nonzero(first) >= bins // 64 else 0):
            asked = order[empty, attempt]
            found = filled[asked]
            values[empty[found]] = values[asked[found]]
            empty = empty[~found]
            if not len(empty):
                break
        if len(empty):
            rest = order[empty]
            values[empty] = values[rest[np.arange(len(empty)), filled[rest].argmax(axis=1)]]
    # bits differ by bin, so that bins with one value agree by chance independently
    return (_text.mix64(values + np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def pack(values: np.ndarray | None, bits: int = BITS) -> str:
    """Hexadecimal text of the packed bins; empty for the empty set."""
    if values is None:
        return ""
    if bits == 4:
        return ((values[0::2] << 4) | values[1::2]).tobytes().hex()
    return np.packbits(np.unpackbits(values[:, None], axis=1)[:, -bits:]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two documents' shingle sets, 0 to 1."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-bits
    return max(0.0, float((np.count_nonzero(a == b) / len(a) - chance) / (1 - chance)))


#: Ids of the sample for each range's bound.
_SAMPLED = 60


def _with_slots(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Documents dealt into up to ``n`` ranges of ids, numbered from 1; the first document of each range is also sent, as a guest, to the range before.

    Bounds are ids of a sample, chosen by hash; they and the least id of each range are one broadcast row of an id a range.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = d.where(part < _SAMPLED * n / max(1, d.count())).agg(F.sort_array(F.collect_list("k")).alias("ids"))
    cuts = sample.select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.try_element_at("ids", F.greatest(F.lit(1), (i * F.size("ids") / F.lit(n)).cast("int")))).alias("cuts"))
    # one row a range that has documents: its least id
    least = d.select("k").crossJoin(F.broadcast(cuts)).groupBy(_last_at_most(F.col("k"), F.col("cuts"), n).alias("range")).agg(F.min("k").alias("head"))
    heads = least.agg(F.sort_array(F.collect_list("head")).alias("heads"))
    own = d.crossJoin(F.broadcast(heads)).withColumn("slot", _last_at_most(F.col("k"), F.col("heads"), n + 1)).withColumn("first", F.col("k") == F.try_element_at("heads", F.col("slot")))
    places = F.array(F.struct(F.col("slot"), F.lit(0).alias("guest")), F.struct((F.col("slot") - 1).alias("slot"), F.lit(1).alias("guest")))
    placed = F.when(F.col("first") & (F.col("slot") > 1), places).otherwise(F.slice(places, 1, 1))
    return own.withColumn("to", F.explode(placed)).select("k", "doc_id", "text", "to.slot", "to.guest")


def _last_at_most(k, bounds, most: int):
    """How many of the sorted bounds, ``most`` at most, are at most ``k``, by binary search; nulls are bounds of nothing."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.try_element_at(bounds, at + s) <= k, F.lit(False)), at + s).otherwise(at))


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprint each text and its edited text, whose last floor(n/2) code points give way to the start of the next document.

    The next document is the next in ascending id (null ids first, equal ids by text), after the last the first.
    Texts move once: ranges of ids are sorted by Spark and walked in order by the tasks.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _with_slots(docs, id_col, text_col, n)
    least = dealt.agg(F.min("k").alias("k")).first()["k"]
    opening = None if least is None else dealt.where(F.col("k") == least).orderBy("text").select("text").first()
    opening_text = opening["text"] if opening is not None else ""
    ordered = dealt.repartitionById(n + 1, F.col("slot") - 1).sortWithinPartitions("slot", "k", "guest", "text")

    def values(raws):
        return [bin_values(s, bins, bits) for s in _text.shingles(*_text.word_hashes(raws))]

    def walk(batches):
        held = None  # (slot, id, text) awaiting the next document

        def results(rows):
            """rows: (id, text, next text), in small groups so that memory stays near a block of text."""
            size, group = 0, []
            for row in rows:
                group.append(row)
                size += len(row[1])
                if size > _text.BLOCK_BYTES // 2:
                    yield from compute(group)
                    size, group = 0, []
            if group:
                yield from compute(group)

        def compute(group):
            edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, nxt in group]
            # a text and the next one's text appear once: rows of a group mostly follow each other
            texts: dict[str, int] = {}
            for _, t, nxt in group:
                texts.setdefault(t, len(texts))
                texts.setdefault(nxt, len(texts))
            for t in edited:
                texts.setdefault(t, len(texts))
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            prints = []
            for _, _, part in _text.blocks(raws):
                prints.extend(values(part))
            for (doc, t, nxt), e in zip(group, edited, strict=True):
                a, b, c = prints[texts[t]], prints[texts[e]], prints[texts[nxt]]
                yield doc, len(t), hashlib.sha256(raws[texts[e]]).hexdigest(), pack(a, bits), pack(b, bits), likeness(a, b, bits), likeness(a, c, bits)

        def pairs(table):
            nonlocal held
            for slot, doc, text, guest in zip(*(table.column(c).to_pylist() for c in ("slot", "doc_id", "text", "guest")), strict=True):
                if held is not None:
                    if held[0] == slot:
                        yield held[1], held[2], text
                    else:  # only the last range has no guest at its end
                        yield held[1], held[2], opening_text
                held = None if guest else (slot, doc, text)

        def to_batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            yield to_batch(list(results(pairs(batch))))
        if held is not None:
            yield to_batch(list(results([(held[1], held[2], opening_text)])))

    return ordered.mapInArrow(walk, _SCHEMA)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
