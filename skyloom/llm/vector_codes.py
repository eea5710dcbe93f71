"""Vectors compressed to a byte a part: integer Lloyd rounds by the filtering algorithm on kd-trees.

Components are scaled to integers and vectors cut into equal parts. Every partition packs its vectors into
blocks and builds a balanced kd-tree over each part of a block, with bounding boxes, sums and counts of
all nodes; the trees are saved once. In a round the codebook's entries go down each tree: at a box, entries
that are nowhere in it nearer than the entry nearest to its middle are left out; where one is left, the
whole subtree is its own, by the cached sum and count; leaves compare their points with what is left. A
partition sends at most a sum and a count for each entry of each part, whatever it holds.

All arithmetic is on integers, exact: floats hold them below 2**53, 64-bit integers below 2**62; wider
components are refused. Ties go to the lower index also where boxes leave entries out.

Edge cases: null and empty vectors and those with null, NaN or infinite components are dropped; the
others have one length, which can be cut into equal parts, or the query is refused; equal rows are coded
each; null ids come last among the first entries; with fewer vectors than entries the codebooks are
smaller; an empty table gives an empty result; only the id, vector and label columns are read, so other
columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm._tables import save

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors of a block, and points of a leaf at most.
BLOCK = 1 << 13
LEAF = 32
#: Labels that are sent to all tasks with their sums at most.
SENT = 1_000_000
_ROWS = 8


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, vector (doubles) and label of the rows whose vectors are complete."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.col(label_col).alias("label")).where((F.size("vector") > 0) & ~bad)


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as integers; squared distances must fit 62 bits."""
    x = np.floor(vectors * float(scale))
    if x.size and float(np.abs(x).max()) ** 2 * 4 * x.shape[1] >= 2.0**62:
        raise ValueError("components are too large for exact distances")
    return x.astype(np.int64)


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Order of the points in a balanced kd-tree, and for each level the cuts, lowest and highest corners and sums of its boxes.

    Box i of a level is cut into boxes 2 i and 2 i + 1 of the next, at the median of its widest side.
    """
    n = len(points)
    order, levels, k = np.arange(n), [], 1
    while True:
        cuts = n * np.arange(k + 1) // k
        p = points[order]
        low, high = np.minimum.reduceat(p, cuts[:-1]), np.maximum.reduceat(p, cuts[:-1])
        levels.append((cuts, low, high, np.add.reduceat(p, cuts[:-1])))
        if n // (2 * k) < max(1, leaf // 2):
            return order, levels
        box = np.repeat(np.arange(k), np.diff(cuts))
        side = (high - low).argmax(axis=1)[box]
        order = order[np.lexsort((p[np.arange(n), side], box))]
        k *= 2


def _exact(points_bound: int, width: int) -> type:
    """Floats if all terms of the comparisons stay whole in them."""
    return np.float64 if 16 * width * (points_bound + 1) ** 2 < 1 << 53 else np.int64


class Codebook:
    """Entries of one part with what comparisons with boxes need."""

    def __init__(self, entries: np.ndarray, bound: int):
        self.kind = _exact(max(bound, int(np.abs(entries).max())), entries.shape[1])
        self.entries = entries.astype(self.kind)
        self.norms = (self.entries**2).sum(axis=1)
        self.apart: dict[int, np.ndarray] = {}

    def distances_to(self, z: int) -> np.ndarray:
        """Componentwise distances of all entries to entry ``z``, a column an entry."""
        if z not in self.apart:
            self.apart[z] = np.abs(self.entries - self.entries[z]).T.copy()
        return self.apart[z]

    def filtered(self, low: np.ndarray, high: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Which live entries may be the nearest of some point of each box, ties to the lower index."""
        twice, side = (low + high).astype(self.kind), (high - low).astype(self.kind)
        # of |m - z|^2 with twice the middle m, without what all entries share
        lift = self.norms - twice @ self.entries.T
        top = np.iinfo(np.int64).max if self.kind is np.int64 else np.inf
        best = np.where(live, lift, top).argmin(axis=1)
        # most by which z is nearer than the best, over the corners of the box
        gain = lift[np.arange(len(best)), best][:, None] - lift
        for z in np.unique(best).tolist():
            rows = np.flatnonzero(best == z)
            gain[rows] += side[rows] @ self.distances_to(z)
        index = np.arange(len(self.norms))
        keep = live & ((gain > 0) | ((gain == 0) & (index <= best[:, None])))
        keep[np.arange(len(best)), best] = True
        return keep

    def nearest(self, points: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nearest of some entries, in ascending order, to each point; the first of equal ones."""
        p = points.astype(self.kind)
        return among[(self.norms[among] - 2 * (p @ self.entries[among].T)).argmin(axis=1)]


def descend(book: Codebook, points: np.ndarray, levels: list[tuple[np.ndarray, ...]]):
    """Yield (entries, sums, counts, first, end) of whole subtrees, and the same of the leaves' points by entry.

    ``points`` are in the tree's order; first and end are the places of a subtree's points, for leaves their places and entries.
    """
    boxes, live = np.array([0]), np.ones((1, len(book.norms)), bool)
    for depth, (cuts, low, high, sums) in enumerate(levels):
        live = book.filtered(low[boxes], high[boxes], live)
        alone = live.sum(axis=1) == 1
        done = boxes[alone]
        if len(done):
            yield live[alone].argmax(axis=1), sums[done], cuts[done + 1] - cuts[done], cuts[done], cuts[done + 1]
        boxes, live = boxes[~alone], live[~alone]
        if depth + 1 < len(levels):
            boxes, live = (2 * boxes[:, None] + np.arange(2)).ravel(), np.repeat(live, 2, axis=0)
    for box, some in zip(boxes.tolist(), live, strict=True):
        a, b = int(cuts[box]), int(cuts[box + 1])
        near = book.nearest(points[a:b], np.flatnonzero(some))
        yield near, points[a:b], np.ones(b - a, np.int64), np.arange(a, b), np.arange(a + 1, b + 1)


def assigned(book: Codebook, points: np.ndarray, levels: list) -> np.ndarray:
    """The nearest entry of each point, in the tree's order."""
    out = np.empty(len(points), np.int64)
    for entries, _, counts, first, end in descend(book, points, levels):
        out[np.repeat(first, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)] = np.repeat(entries, end - first)
    return out


def totals(book: Codebook, points: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points of each entry."""
    found = list(descend(book, points, levels))
    entries, sums, counts = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(entries, kind="stable")
    lead = np.flatnonzero(np.concatenate([[True], np.diff(entries[order]) != 0]))
    all_sums, all_counts = np.zeros(book.entries.shape, np.int64), np.zeros(len(book.norms), np.int64)
    all_sums[entries[order][lead]] = np.add.reduceat(sums[order], lead)
    all_counts[entries[order][lead]] = np.add.reduceat(counts[order], lead)
    return all_sums, all_counts


def _pack(levels: list[tuple[np.ndarray, ...]], kind: type) -> bytes:
    return b"".join(a.astype(k).tobytes() for _, *rest in levels for a, k in zip(rest, (kind, kind, np.int64), strict=True))


def _unpack(raw: bytes, n: int, width: int, depth: int, kind: type) -> list[tuple[np.ndarray, ...]]:
    levels, at = [], 0
    for d in range(depth):
        k, rest = 1 << d, []
        for t in (kind, kind, np.int64):
            size = k * width * np.dtype(t).itemsize
            rest.append(np.frombuffer(raw[at : at + size], t).reshape(k, width).astype(np.int64))
            at += size
        levels.append((n * np.arange(k + 1) // k, *rest))
    return levels


def trees(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """Saved blocks of vectors: ids, labels, number, bound of the components, and for each part the points in the tree's order, that order, and the boxes."""
    label = dict(vectors.dtypes)["label"]

    def run(batches):
        ids, labels, held, n = [], [], [], 0

        def flush():
            x = scaled(np.concatenate(held), scale)
            if x.shape[1] % parts:
                raise ValueError(f"vectors of {x.shape[1]} components can't be cut into {parts} equal parts")
            bound = int(np.abs(x).max())
            kind = np.int32 if bound < 1 << 31 else np.int64
            width = x.shape[1] // parts
            made = []
            for i in range(parts):
                p = x[:, i * width : (i + 1) * width]
                order, levels = build(p)
                made.append({"points": p[order].astype(kind).tobytes(), "places": order.astype(np.int32).tobytes(), "boxes": _pack(levels, kind), "depth": len(levels)})
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((pa.concat_arrays(ids).to_pylist(), pa.concat_arrays(labels).to_pylist(), len(x), bound, width, made), kinds, strict=True)], names=["ids", "labels", "n", "bound", "width", "trees"])

        for batch in batches:
            lists = batch.column("vector")
            sizes = set(np.diff(lists.offsets.to_numpy()).tolist()) | {held[0].shape[1] for _ in held[:1]}
            if len(sizes) > 1:
                raise ValueError(f"vectors of {sorted(sizes)} components: one length is needed")
            for lo in range(0, len(lists), BLOCK):
                some = lists.slice(lo, BLOCK)
                ids.append(batch.column("vec_id").slice(lo, BLOCK))
                labels.append(batch.column("label").slice(lo, BLOCK))
                held.append(some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1))
                n += len(some)
                if n >= BLOCK:
                    yield flush()
                    ids, labels, held, n = [], [], [], 0
        if n:
            yield flush()

    schema = f"ids array<long>, labels array<{label}>, n int, bound long, width int, trees array<struct<points: binary, places: binary, boxes: binary, depth: int>>"
    kinds = _arrow(schema).types
    return save(vectors.mapInArrow(run, schema), rows=1000)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _parts_of(row: dict):
    """(points, places, levels) of each part of a block."""
    kind = np.int32 if row["bound"] < 1 << 31 else np.int64
    for t in row["trees"]:
        points = np.frombuffer(t["points"], kind).reshape(row["n"], row["width"]).astype(np.int64)
        yield points, np.frombuffer(t["places"], np.int32), _unpack(t["boxes"], row["n"], row["width"], t["depth"], kind)


def first_entries(vectors: DataFrame, entries: int, parts: int, scale: int) -> list[np.ndarray]:
    """Each part of the vectors of least id; at most ``entries`` rows reach the driver."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    if not rows:
        return []
    x = scaled(np.array([r.vector for r in rows], np.float64), scale)
    return [x[:, i : i + x.shape[1] // parts] for i in range(0, x.shape[1], x.shape[1] // parts)]


def moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: entries at the floored means of their points, unused ones as they are."""

    def run(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for i, (points, _, levels) in enumerate(_parts_of(row)):
                    new = totals(Codebook(books[i], row["bound"]), points, levels)
                    old = sums.get(i)
                    sums[i] = [a + b for a, b in zip(old, new, strict=True)] if old else list(new)
        for i, (s, n) in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    width = books[0].shape[1]
    sent = blocks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    # decimals, as sums over any number of rows must be exact
    summed = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d].cast("decimal(20,0)")) for d in range(width)]).alias("sums"))
    out = [b.copy() for b in books]
    # a row an entry of each part
    for r in summed.collect():
        out[r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return out


def codebooks(vectors: DataFrame, blocks: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> list[np.ndarray]:
    """Entries of each part after so many rounds."""
    books = first_entries(vectors, entries, parts, scale)
    for _ in range(rounds if books else 0):
        books = moved(blocks, books)
    return books


def encoded(blocks: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    """vec_id, label, code and error of every vector of the blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, error = np.zeros((row["n"], len(books)), np.uint8), np.zeros(row["n"], np.int64)
                for i, (points, places, levels) in enumerate(_parts_of(row)):
                    near = assigned(Codebook(books[i], row["bound"]), points, levels)
                    codes[places, i] = near
                    error[places] += ((points - books[i][near]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], kind), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {label}, code string, error long"
    kind = _arrow(schema).field("label").type
    return save(blocks.mapInArrow(run, schema), rows=_ROWS)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (two hex digits a part) and error of every usable vector, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    vectors = usable(df, id_col, vector_col, label_col)
    blocks = trees(vectors, parts, scale)
    books = codebooks(vectors, blocks, entries, rounds, parts, scale)
    return encoded(blocks, books, dict(vectors.dtypes)["label"]), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: errors summed over equal labels, nulls together. Sums go to all tasks if labels are few."""
    sums = save(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= SENT else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
