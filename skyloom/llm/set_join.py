"""Exact n-gram Jaccard join with set-relation skipping, and its connected components.

1. Equal sets are one class; its least id stands for it.
2. A set with over 20 % of its shingles in no other set links with nothing. Shingles of a fixed part
   of the hash space are dealt by hash and counted, which finds such sets early.
3. The others index the prefix that any partner at the threshold must share, with size and position:
   the rarest shingles. Shingles in ``COMMON`` sets or more are counted and come last, by their number of
   sets; all others are in the order of their hashes. So passages that many documents share leave the
   prefixes of documents that have anything else.
4. Each index list has a leader. The sets of the list are compared with it, unless sizes and parity
   bitmaps exclude a link, and linked ones join its component.
5. A list whose sets are all in one component is skipped whole. In the others, only sets of different
   components meet; their list entries are in blocks by size, blocks too far apart are skipped, and
   within near ones a pair is skipped if the sizes, the positions, the sets' parity bitmaps, or the two
   sets' known overlaps with the leader (the answer of a similar set) already bound its overlap under
   the threshold.
6. What remains is compared exactly.

Large groups of near copies cost about a comparison a member, not a pair. Every pair at the threshold
is either compared or already connected, so components are exact (up to collisions of hashes, of which
64 bits count for equal sets and lonely ones, and the upper 48 bits in comparisons).

Edge cases: null and empty texts have no shingles and are components of their own; rows with equal id
are one document; rows with null id keep a null component; only the id and text columns are read, so
other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text
from skyloom.llm._tables import save

WIDTH = 5
PERCENT = 80
#: Part of the hash space in which shingles are counted before the join.
COUNTED = 0.4
#: Counted shingles of a part.
PART = 1_000_000
#: Longs of a set's short parity bitmap.
LONGS = 16
#: Shingles in so many sets or more are common.
COMMON = 200
#: Most ids (8 bytes each) or common shingles (16 bytes each) that are broadcast.
SENT = 1_000_000
_FLUSH = 1 << 22
_SIZE_BASE = 1.25


def _signature(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _grams(raws: list[bytes], width: int) -> list[np.ndarray]:
    return _text.shingles(*_text.word_hashes(raws), width)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, a 128-bit signature of the shingle set and the signature's first 64 bits, for every row."""

    def run(batches):
        for batch in batches:
            for lo, hi, raws in _text.blocks(batch.column("text").to_pylist()):
                sets = _grams(raws, width)
                sids = [_signature(s) for s in sets]
                keys = np.frombuffer(b"".join(x[:8] for x in sids), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()), pa.array(keys)], names=["doc_id", "n_shingles", "sid", "key"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sid binary, key long")


def lonely_sets(docs: DataFrame, total: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Keys (64 bits of the signature) of sets with too many shingles of their own to reach the threshold.

    Packed arrays of shingles are dealt by hash; each part counts its shingles and returns packed
    counts of singles, which are summed by set. Shingles that only look equal keep a set, never drop one.
    Parts are made by ``total``, the shingles of all sets, so a task holds about ``PART`` of them however many there are.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(COUNTED * total) // PART + 1)
    homes = max(1, n // 4)
    top = np.uint64(int(COUNTED * 2.0**64) - 1)

    def deal(batches):
        held: list[tuple[np.ndarray, np.uint64, int]] = []
        size = 0

        def flush():
            grams = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            keys = np.array([h[1] for h in held], np.uint64)
            sizes = np.array([h[2] for h in held], np.int32)
            part = (_text.mix64(grams) % np.uint64(n)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                docs_here, counts = np.unique(owner[own], return_counts=True)
                rows.append((b, keys[docs_here].tobytes(), sizes[docs_here].tobytes(), counts.astype(np.int32).tobytes(), grams[own].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "keys", "sizes", "counts", "grams"])

        for batch in batches:
            for _, _, raws in _text.blocks(batch.column("text").to_pylist()):
                for s in _grams(raws, width):
                    if len(s):
                        key = np.frombuffer(_signature(s)[:8], np.uint64)[0]
                        low = s[: np.searchsorted(s, top, side="right")]
                        held.append((low, key, len(s)))
                        size += 8 * len(low)
                if size > _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def packed(batches, names):
        held = {c: [] for c in names}
        for batch in batches:
            for c in names:
                held[c] += batch.column(c).to_pylist()
        return lambda c, t: np.frombuffer(b"".join(held.pop(c)), t)

    def count(batches):
        col = packed(batches, ("keys", "sizes", "counts", "grams"))
        grams, keys, sizes, counts = col("grams", np.uint64), col("keys", np.uint64), col("sizes", np.int32), col("counts", np.int32)
        if not len(grams):
            return
        order = np.argsort(grams, kind="stable")
        s = grams[order]
        fresh = np.concatenate([[True], s[1:] != s[:-1], [True]])
        single = np.zeros(len(grams), bool)
        single[order] = fresh[:-1] & fresh[1:]
        owner = np.repeat(np.arange(len(keys)), counts)
        singles = np.bincount(owner[single], minlength=len(keys)).astype(np.int32)
        some = singles > 0
        keys, sizes, singles = keys[some], sizes[some], singles[some]
        home = (keys % np.uint64(homes)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(homes + 1))
        rows = [(b, keys[o].tobytes(), sizes[o].tobytes(), singles[o].tobytes()) for b in np.flatnonzero(np.diff(cuts)).tolist() for o in [order[cuts[b] : cuts[b + 1]]]]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["home", "keys", "sizes", "singles"])

    def judge(batches):
        col = packed(batches, ("keys", "sizes", "singles"))
        keys, lead, which = np.unique(col("keys", np.uint64), return_index=True, return_inverse=True)
        singles = np.bincount(which, col("singles", np.int32), len(keys))
        sizes = col("sizes", np.int32)[lead]
        # |x and y| >= p |x or y| needs |x without y| <= (1 - p) |x|
        lonely = 100 * singles > (100 - percent) * sizes.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys[lonely].view(np.int64))], names=["key"])

    dealt = docs.mapInArrow(deal, "part int, keys binary, sizes binary, counts binary, grams binary")
    counted = dealt.repartitionById(n, F.col("part")).mapInArrow(count, "home int, keys binary, sizes binary, singles binary")
    return counted.repartitionById(homes, F.col("home")).mapInArrow(judge, "key long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, n, the packed sorted shingles (the upper six bytes of each hash) and a parity bitmap of every row.

    A shingle flips one bit of the bitmap, so the bits in which two bitmaps differ are at most the shingles in which
    the sets do.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, raws in _text.blocks(batch.column("text").to_pylist()):
                sets = _grams(raws, width)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in sets], pa.binary()), pa.array([_parity(s, 64 * LONGS).view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([_parity(s).tobytes() for s in sets], pa.binary())], names=["node", "n", "grams", "bits", "wide"])

    return docs.mapInArrow(run, "node long, n int, grams binary, bits array<long>, wide binary")


def _parity(grams: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Parity of the shingles by position among ``bits``, by default four or more for each shingle."""
    bits = bits or 1 << max(10, (4 * len(grams) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(16)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def _differing(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(folded ^ y).sum())


def _unpack(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(a), 8), np.uint8)
    out[:, 2:] = a
    return out.view(np.uint64).ravel()


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles in ``COMMON`` or more of the sets, and in how many.

    With over ``COMMON * SENT`` shingles in all the number rises so that no more than ``SENT`` can have it.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000 + 1)
    least = max(COMMON, -(-total // SENT))

    def deal(batches):
        held, size = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (_text.mix64(tokens) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            filled = np.flatnonzero(np.diff(cuts)).tolist()
            own = [order[cuts[p] : cuts[p + 1]] for p in filled]
            return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([tokens[o].tobytes() for o in own], pa.binary()), pa.array([counts[o].astype(np.int32).tobytes() for o in own], pa.binary())], names=["part", "tokens", "counts"])

        for batch in batches:
            for raw in batch.column("grams").to_pylist():
                held.append(_unpack(raw))
                size += len(raw)
                if size > _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(batches):
        found = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)) for batch in batches for t, c in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        if found:
            tokens, which = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            df = np.bincount(which, np.concatenate([c for _, c in found])).astype(np.int64)
            often = df >= least
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(df[often])], names=["token", "df"])

    dealt = sets.select("grams").mapInArrow(deal, "part int, tokens binary, counts binary").repartitionById(parts, F.col("part"))
    # at most SENT rows
    rows = dealt.mapInArrow(count, "token long, df long").toPandas()
    tokens, df = rows["token"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], df[order]


def _prefixes(sets: DataFrame, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, node, n, pos: the prefix of each set, rare shingles by hash, then common ones by the number of sets."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        often, df = shared.value
        for batch in batches:
            nodes, ns, tokens, places = [], [], [], []
            for node, n, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "grams")), strict=True):
                need = -(-percent * n // 100)
                own = _unpack(raw)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    own = own[np.lexsort((own, np.where(often[at] == own, df[at], 0)))]
                first = own[: n - need + 1]
                tokens.append(first)
                nodes.append(np.full(len(first), node))
                ns.append(np.full(len(first), n, np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes).astype(np.int64)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(places))], names=["token", "node", "n", "pos"])

    return sets.mapInArrow(run, "token long, node long, n int, pos int")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and wide bitmaps leave the threshold within reach."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a")
    met = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b")
    met = met.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            need = -(-percent * total // (100 + percent))
            unlike = np.array([_differing(x, y) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(unlike <= total - 2 * need))

    return met.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, both for pairs (a, b): sizes and size of the intersection."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), "a")
    met = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b")

    def run(batches):
        for batch in batches:
            both = []
            for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True):
                m = np.concatenate([_unpack(x), _unpack(y)])
                m.sort(kind="stable")  # two sorted runs: a merge
                both.append(int(np.count_nonzero(m[1:] == m[:-1])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(both, pa.int32())], names=["a", "b", "na", "nb", "both"])

    return met.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(run, "a long, b long, na int, nb int, both int")


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of the graph of links (a, b), by alternating large and small stars."""
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        # large star: each larger neighbour of a node goes to the node's least neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: each smaller neighbour, and the node, go to the node's least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = save(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = save(signatures(src, width))
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = save(filled.groupBy("sid").agg(F.min("doc_id").alias("node"), F.min("key").alias("key")))
    lonely = lonely_sets(src.where("doc_id is not null"), signed.agg(F.sum("n_shingles")).first()[0] or 0, width, percent)
    heads = save(classes.join(lonely, "key", "left_anti").select(F.col("node").alias("doc_id")).distinct())
    # ids alone are sent to all tasks if they are few; texts are shuffled otherwise
    heads = F.broadcast(heads) if heads.count() <= SENT else heads
    sets = save(_sets(src.join(heads, "doc_id").select(F.col("doc_id").alias("node"), "text"), width).where("n > 0"))
    links = similar_links(sets, percent).union(_same_ids(filled, classes))
    groups = save(components(links))
    member = filled.select("doc_id", "sid").join(classes.select("sid", "node"), "sid").select("doc_id", "node")
    placed = member.join(groups, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _same_ids(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows with equal ids."""
    several = filled.groupBy("doc_id").agg(F.min("sid").alias("s"), F.max("sid").alias("t")).where("s <> t").select("doc_id")
    nodes = filled.join(several, "doc_id").join(classes.select("sid", "node"), "sid").select("doc_id", "node")
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("b"))
    return nodes.join(least, "doc_id").select(F.col("node").alias("a"), "b")


def similar_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) at the threshold that connect whatever all links connect; ``sets`` as from ``_sets``."""
    near = 100 * F.col("both").cast("long") >= percent * (F.col("na").cast("long") + F.col("nb") - F.col("both"))
    prefix = save(_prefixes(sets, percent, common_shingles(sets)))
    leaders = save(prefix.groupBy("token").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1").select("token", "leader"))
    listed = save(prefix.join(leaders, "token"))
    first = listed.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    met = save(_overlaps(save(_possible(first, sets, percent)), sets))
    links = met.where(near).select("a", "b")
    groups = components(links)

    # lists with sets of several components
    placed = listed.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    placed = save(placed)
    mixed = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    # no row where sizes or bitmaps excluded the leader: that overlap stays unknown (null) and bounds nothing
    known = met.select(F.col("a").alias("node"), F.col("b").alias("leader"), "both").distinct()
    lead = placed.where("node = leader").select("token", F.col("c").alias("lc")).distinct()
    entries = placed.join(mixed, "token").join(lead, "token").join(known, ["node", "leader"], "left")
    entries = entries.join(sets.select("node", "bits"), "node")
    entries = save(entries.select("token", "bits", "node", "n", "pos", "c", "lc", "leader", F.col("both").alias("seen"), F.floor(F.log(_SIZE_BASE, F.col("n")) + 1e-9).cast("int").alias("block")))
    side = lambda p: [F.col(x).alias(p + x) for x in ("node", "n", "pos", "c", "seen", "bits")]
    reach = int(np.ceil(np.log(100 / percent) / np.log(_SIZE_BASE) - 1e-9))
    x = entries.where("c <> lc").select("token", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"), "lc", *side("x"))
    y = entries.where("node <> leader").select("token", "block", *side("y"))
    need = F.ceil(percent * (F.col("xn").cast("long") + F.col("yn")) / F.lit(100.0 + percent) - 1e-9)
    unlike = sum((F.bit_count(F.col("xbits")[i].bitwiseXOR(F.col("ybits")[i])) for i in range(LONGS)), F.lit(0))
    pairs = (
        x.join(y, ["token", "block"])
        .where("xc <> yc and (yc = lc or xnode < ynode)")
        .where(100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn"))
        .where(F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos")) >= need)
        .where(unlike <= F.col("xn") + F.col("yn") - 2 * need)
        .where(F.col("xseen").isNull() | F.col("yseen").isNull() | (F.least("xseen", "yseen") + F.least(F.col("xn") - F.col("xseen"), F.col("yn") - F.col("yseen")) >= need))
    )
    second = save(pairs.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct())
    return links.union(_overlaps(save(_possible(second, sets, percent)), sets).where(near).select("a", "b"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the least id, all columns as they are.

    Of rows with equal id one stays, the least by text and then by all columns as JSON. Rows with null id are named
    by a hash of their text above all usual ids, so of equal ones and of near copies one stays too.
    """
    taken = {c.lower() for c in docs.columns}
    key, mark = (next(n for i in range(len(taken) + 1) if (n := f"_{x}{i}") not in taken) for x in ("node", "mark"))
    named = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 61)))
    keyed = docs.withColumn(key, named)
    placed = save(similar_components(keyed, key, text_col))
    # ids that go or have several rows; the others need no mention
    odd = save(placed.groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("gone"), F.count(F.lit(1)).alias("rows")).where("gone or rows > 1").select(F.col("doc_id").alias(key), F.struct("gone", "rows").alias(mark)))
    marked = keyed.join(F.broadcast(odd) if odd.count() <= SENT else odd, key, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.where(F.col(mark).isNull()).select(*columns)
    if odd.where(~F.col(f"{mark}.gone")).isEmpty():
        return kept
    row = F.struct(*columns)
    least = marked.where(~F.col(f"{mark}.gone")).groupBy(key).agg(F.min_by(row, F.struct(F.col(text_col), F.to_json(row))).alias(mark))
    return kept.unionByName(least.select(f"{mark}.*"))


def op5_set_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
