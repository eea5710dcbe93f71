"""Passages of many words that occur more than once, located by automata and taken out.

1. Documents are packed into shards of some megabytes. A shard sends hashes of its windows of ``WIDTH``
   words; windows that start twice or more anywhere recur, and their hashes come back to the shards that
   have them (``_shards``).
2. A shard joins the recurring windows, each at its first place, to passages, and cuts these into tiles
   of half a window, so that every window of a passage has a whole tile.
3. Tiles are compiled into Aho-Corasick automata of bounded size, one after the other, and all documents
   of the shard are streamed through each. Around every tile found, windows are compared word by word
   with the passage that has their hash, and the words of equal ones are covered.

A shard compiles only passages that recur in it, so automata and streams grow with the input, not with
all passages times all documents. Windows are judged on the input alone.

Edge cases: null and empty texts, and texts of fewer words than a window, keep all words; equal rows and
rows with equal or null ids are different documents, so their common windows recur; a text of any length
is one row; an empty table gives an empty result; only the id and text columns are read, so other columns
can't clash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text
from skyloom.llm._shards import PACKETS, Known, given_back, packets, parts_for, recurring
from skyloom.llm._tables import save

WIDTH = 35
#: Bytes of a shard's texts, if its texts aren't longer themselves.
SHARD_BYTES = 2 << 20
#: Nodes of an automaton, about a hundred bytes each.
NODES = 400_000
#: Letters of each digit of a word's number; digits have alphabets of their own, so matches begin with a word.
LETTERS = 64
_COMPARED = 1 << 15
_ROWS = 8


def text_shards(docs: DataFrame) -> DataFrame:
    """Saved rows of shard, number of words, ids and texts of its documents."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flush():
            n = sum(len(t.split()) for t in texts)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["shard", "n", "ids", "texts"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(raw)
                size += len(raw) + 1
                if size >= SHARD_BYTES:
                    yield flush()
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return save(docs.mapInArrow(run, "shard long, n long, ids array<long>, texts array<binary>"), rows=1000)


def windows(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows within documents, and two hashes of each."""
    n = max(0, len(words) - width + 1)
    seeds = _text.mix64(np.arange(1, 2 * width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    keys, sides = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(width if n else 0):
        keys += words[j : j + n] * seeds[j]
        sides += words[j : j + n] * seeds[width + j]
    inside = np.zeros(len(words) + 1, np.int64)
    whole = np.flatnonzero(np.diff(bounds) >= width)
    np.add.at(inside, bounds[whole], 1)
    np.add.at(inside, bounds[whole + 1] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    return at, _text.mix64(keys[at]), _text.mix64(sides[at])


def tiles(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Places of tiles: half a window each, side by side over every run of adjacent windows."""
    half = (width + 1) // 2
    fresh = np.concatenate([[True], np.diff(starts) != 1])
    begin = starts[fresh]
    end = starts[np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)] + width
    count = (end - begin) // half
    return np.repeat(begin, count) + half * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))


def letters(ids: np.ndarray, bounds: np.ndarray) -> tuple[str, int]:
    """All words as letters, so many a word."""
    digits = 1
    while LETTERS**digits <= (int(ids.max()) if len(ids) else 0):
        digits += 1
    place = LETTERS ** np.arange(digits - 1, -1, -1)
    coded = (ids[:, None] // place % LETTERS + LETTERS * np.arange(digits) + 0x100).astype("<u2")
    return coded.tobytes().decode("utf-16-le"), digits


def located(stream: str, digits: int, half: int, at: np.ndarray) -> np.ndarray:
    """Places where the tiles at ``at`` occur in the stream of letters, by automata built one after the other."""
    step = max(1, NODES // (half * digits))
    found = []
    # equal tiles once
    different = sorted({stream[i * digits : (i + half) * digits] for i in at.tolist()})
    for lo in range(0, len(different), step):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for tile in different[lo : lo + step]:
            automaton.add_word(tile)
        automaton.make_automaton()
        found.append(np.fromiter((end for end, _ in automaton.iter(stream)), np.int64))
    return (np.concatenate(found) + 1) // digits - half


def covered(raws: list[bytes], known: Known, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether it is in a recurring window, and the bounds of the documents in the words."""
    words, bounds = _text.word_hashes(raws, lower=False)
    out = np.zeros(len(words) + 1, np.int64)
    at, keys, _ = windows(words, bounds, width)
    _, again = known.find(keys)
    if not again.any():
        return out[:-1].astype(bool), bounds
    first_keys, lead = np.unique(keys[again], return_index=True)
    first = at[again][lead]
    _, ids = np.unique(words, return_inverse=True)
    half = (width + 1) // 2
    stream, digits = letters(ids, bounds)
    hits = located(stream, digits, half, tiles(ids, np.sort(first), width))
    # windows around the tiles that are found
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(hits + half - width, 0), 1)
    np.add.at(near, hits + 1, -1)
    around = np.flatnonzero((np.cumsum(near)[at] > 0) & again)
    of = first[np.searchsorted(first_keys, keys[around])]
    ids32 = ids.astype(np.int32)
    view = np.lib.stride_tricks.sliding_window_view(ids32, width)
    for lo in range(0, len(around), _COMPARED):
        here = at[around[lo : lo + _COMPARED]]
        same = here[(view[here] == view[of[lo : lo + _COMPARED]]).all(axis=1)]
        np.add.at(out, same, 1)
        np.add.at(out, same + width, -1)
    return np.cumsum(out)[:-1] > 0, bounds


def _by_document(docs: DataFrame, id_col: str, text_col: str, width: int, finish, schema: str) -> DataFrame:
    """A row for each document by ``finish(id, words, covered)``."""
    shards = text_shards(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    parts = parts_for(shards, shards.agg(F.sum("n")).first()[0] or 0)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, bounds = _text.word_hashes(row["texts"], lower=False)
                _, keys, sides = windows(words, bounds, width)
                if len(keys):
                    keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
                    yield packets(row["shard"], keys, sides[first], np.minimum(counts, 2).astype(np.int8), parts)

    def locate(batches):
        for batch in batches:
            for row in batch.to_pylist():
                gone, bounds = covered(row["texts"], Known(row["back"]), width)
                out = [finish(i, raw.split(), gone[a:b]) for i, raw, a, b in zip(row["ids"], row["texts"], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=wanted)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    back = save(recurring(shards.mapInArrow(send, PACKETS), parts, 2, with_totals=False), rows=_ROWS)
    return save(given_back(shards, back).mapInArrow(locate, schema), rows=_ROWS)


def spans(gone: np.ndarray) -> list[dict]:
    """First words and ends of the runs that are covered."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"first": a, "end": b} for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, spans (first word and end) that recur, and the words that are left, joined by spaces."""

    def finish(i, words, gone):
        return {"doc_id": i, "n_words": len(words), "spans": spans(gone), "text": b" ".join(compress(words, ~gone)).decode("utf-8", "surrogatepass")}

    return _by_document(docs, id_col, text_col, width, finish, "doc_id long, n_words long, spans array<struct<first: long, end: long>>, text string")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that are left, joined by spaces."""

    def finish(i, words, gone):
        return {"doc_id": i, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(b" ".join(compress(words, ~gone))).hexdigest()}

    return _by_document(docs, id_col, text_col, width, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op13_repeats(spark, sf_dir: str) -> DataFrame:
    return repeat_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
