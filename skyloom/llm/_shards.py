"""Keys counted over all shards of a corpus, and what recurs given back to the shards that have it.

A shard is a row of a saved table that holds the texts of some documents, or what was made of them. Each
shard sends its distinct keys with their counts, packed by part of the key space; a part's task sums the
counts; keys that reach a threshold go back to the shards that sent them. A key costs a few bytes a shard
however often it occurs, parts are made by the number of keys, and no key is held by more than its shards.

Keys are 64-bit hashes. The part is taken from a second hash, so keys meet only if parts are equal too,
which adds the logarithm of the number of parts to the bits that count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKETS = "shard long, part int, keys binary, counts binary"
#: Keys of a part, before those that several shards send are counted once.
PART_KEYS = 2_000_000
_BACK = "shard long, keys binary, totals binary, own binary"


def parts_for(df: DataFrame, keys: int) -> int:
    """Number of parts for so many keys."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys // PART_KEYS + 1)


def packets(shard: int, keys: np.ndarray, sides: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A shard's distinct keys by part, sorted; ``sides`` are their second hashes, counts are of any integer type."""
    part = (sides % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((keys, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    filled = np.flatnonzero(np.diff(cuts)).tolist()
    own = [order[cuts[p] : cuts[p + 1]] for p in filled]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(filled), pa.int64()), pa.array(filled, pa.int32()), pa.array([keys[o].tobytes() for o in own], pa.binary()), pa.array([counts[o].tobytes() for o in own], pa.binary())],
        names=["shard", "part", "keys", "counts"],
    )


def recurring(sent: DataFrame, parts: int, least: int, with_totals: bool = True) -> DataFrame:
    """For each packet its keys that reach ``least`` in all, their totals, and whether this shard is the least one that has the key.

    Without ``with_totals`` only the keys.
    """

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard, part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append((shard, keys, counts))
        for rows in held.values():
            rows.sort(key=lambda r: r[0])
            sizes = [len(k) // 8 for _, k, _ in rows]
            keys = np.frombuffer(b"".join(k for _, k, _ in rows), np.uint64)
            counts = np.concatenate([np.frombuffer(c, f"i{len(c) // n}").astype(np.int64) for n, (_, _, c) in zip(sizes, rows, strict=True)])
            order = np.argsort(keys, kind="stable")  # by key, then by shard
            s = keys[order]
            lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sums = np.repeat(np.add.reduceat(counts[order], lead), np.diff(np.append(lead, len(s))))
            totals, own = np.empty(len(s), np.int64), np.zeros(len(s), np.uint8)
            totals[order], own[order[lead]] = sums, 1
            often = totals >= least
            at = np.cumsum([0, *sizes])
            back = [(r[0], *(a[lo:hi][often[lo:hi]].tobytes() for a in (keys, totals, own))) for r, lo, hi in zip(rows, at[:-1], at[1:], strict=True) if often[lo:hi].any()]
            if back:
                cols = list(zip(*back, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])]
                yield pa.RecordBatch.from_arrays(arrays if with_totals else arrays[:2], names=["shard", "keys", "totals", "own"][: len(arrays) if with_totals else 2])

    return sent.repartitionById(parts, F.col("part")).mapInArrow(count, _BACK if with_totals else "shard long, keys binary")


def given_back(shards: DataFrame, back: DataFrame) -> DataFrame:
    """The shards with what came back to them, as a list ``back`` of structs."""
    lists = back.groupBy("shard").agg(F.collect_list(F.struct(*[c for c in back.columns if c != "shard"])).alias("back"))
    return shards.join(lists, "shard", "left")


class Known:
    """Keys that came back to a shard, with totals and ownership where they were asked for."""

    def __init__(self, back: list[dict] | None):
        col = lambda name, kind: np.frombuffer(b"".join(b[name] for b in back or [] if name in b), kind)
        keys = col("keys", np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.totals, self.own = (x[order] if len(x) else x for x in (col("totals", np.int64), col("own", np.uint8)))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands among the known ones, and whether it is one."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys
