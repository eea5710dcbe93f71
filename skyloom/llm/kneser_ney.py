"""Log-probabilities of texts under an interpolated modified Kneser-Ney model.

The model is of order two: a word's probability given the word before it, interpolated with its
continuation probability and that with the uniform one; each level has three discounts from its
counts of counts. Words are 56-bit hashes, pairs within a part 64-bit ones.

1. A part is made for each ``PART`` bytes of text, or less where that leaves cores idle. Tasks send the distinct bigrams of a block of texts,
   packed, to the part of their context; contexts of more than one word in ``2 * parts`` (and at least
   one in ``HEAVY``) are dealt by successor too, so that no part holds a frequent word alone.
2. A part adds up its packets and writes one file in the shared folder: sorted hash arrays of bigrams
   and of contexts, and the words of which it needs continuation counts.
3. Continuation counts are summed by ranges of words and written for the parts that asked.
4. To score, texts send their bigrams to the parts, whose files the workers map into memory: only the
   pages that are looked up are read, and a packet at a time is in memory. Sums come back by block of
   texts, so every row has a row of its own whatever its id.

Nothing but totals and the heavy contexts (at most two a part) passes through the driver, and no table
is broadcast. Files are named by part and renamed into place when whole, so a task that runs again
writes the same file again. Folders that aren't mounted as files are read through Arrow's file systems,
a part at a time.

Edge cases: null and empty texts have one token, the end; rows of equal id, repeated rows and null ids
are rows of their own in the result (a null id counts as ``crc32('')``); an empty table gives an empty
result; a model without training texts gives the uniform probability. Only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text
from skyloom.llm._tables import save, shared_folder

#: Bytes of text for each part of the model.
PART = 16_000_000
#: Contexts with at least one in so many words are split among the parts; with many parts, one in twice as many.
HEAVY = 1000
#: Bytes of text and rows in a block; with very many parts up to four times as much, so that packets aren't tiny.
_FLUSH, _ROWS = 10_000_000, 1 << 16
#: In so many steps a part's bigrams are added up.
_SLICES = 4
#: Bits of a word's hash.
_BITS = 56
_START, _END = (int(x) >> 64 - _BITS for x in _text.mix64(np.array([0x5151, 0xE4D], np.uint64)))


_pack, _unpack_bytes = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _shrink(a: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed bytes of an array by significance, of the steps where it ascends, so that the high ones are mostly alike."""
    steps = np.diff(a, prepend=a.dtype.type(0)) if ascending else np.ascontiguousarray(a)
    return _pack.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(a), -1).T).tobytes()) if len(a) else b""


def _grow(raw: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    a = np.ascontiguousarray(np.frombuffer(_unpack_bytes.decompress(raw) if raw else b"", np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if ascending else a


def _pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _text.mix64(v ^ _text.mix64(w + np.uint64(0x9E3779B97F4A7C15)))


def trained_on(id_col: Column) -> Column:
    """Whether a text is learned from: crc32 of the id as text isn't 2 modulo 7."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def bigrams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, successors and text numbers of all bigrams; each text starts after START and ends with END."""
    words, bounds = _text.word_hashes(raws)
    words >>= np.uint64(64 - _BITS)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(raws)), n + 1)
    first = np.cumsum(n + 1) - (n + 1)
    v, w = np.empty(len(text), np.uint64), np.empty(len(text), np.uint64)
    inner = np.ones(len(text), bool)
    inner[first] = False
    v[inner] = words
    v[first] = _START
    last = first + n
    inner = np.ones(len(text), bool)
    inner[last] = False
    w[inner] = words
    w[last] = _END
    return v, w, text


def _route(v: np.ndarray, w: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(heavy, v), len(heavy) - 1)
    return (np.where(heavy[at] == v, _text.mix64(v ^ _text.mix64(w)), v) % np.uint64(parts)).astype(np.int64)


def homes(parts: int) -> int:
    """In how many ranges of words continuation counts are summed, and in how many places blocks of texts."""
    return max(1, parts // 2)


def _home(words: np.ndarray, n: int) -> np.ndarray:
    """Range of a word; ranges ascend with the hash."""
    return ((words >> np.uint64(_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def heavy_contexts(src: DataFrame, share: int) -> np.ndarray:
    """Sorted hashes of contexts with over one in ``share`` words, and START. A word that frequent is so in some task; no task names over twice as many."""

    def count(batches):
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for _, _, raws in _text.blocks(batch.column("text").to_pylist()):
                words = _text.word_hashes(raws)[0] >> np.uint64(64 - _BITS)
                total += len(words)
                k, c = np.unique(words, return_counts=True)
                allk, which = np.unique(np.concatenate([keys, k]), return_inverse=True)
                summed = np.bincount(which, np.concatenate([counts, c])).astype(np.int64)
                # words that can't reach the share any more may be forgotten and counted anew
                kept = summed * 4 * share >= total
                keys, counts = allk[kept], summed[kept]
        kept = counts * 2 * share >= total
        yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(counts[kept])], names=["v", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total])], names=["v", "n"])

    found = src.mapInArrow(count, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    total = found.where("v = 0").agg(F.sum("n")).first()[0] or 0
    top = found.where(f"v <> 0 and n * {share} >= {total}").orderBy(F.desc("n")).limit(2 * share).collect() if total else []
    return np.unique(np.array([_START, *(r["v"] & (1 << 64) - 1 for r in top)], np.uint64))


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; local and mounted ones map files into memory."""
    uri = re.sub(r"^(file:/*)?/", "file:///", folder)
    system, path = pafs.FileSystem.from_uri(uri)
    return (pafs.LocalFileSystem(use_mmap=True) if isinstance(system, pafs.LocalFileSystem) else system), path


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """A file of arrays one after another, behind the number of bytes of each; whole under its name or absent."""
    system, path = _files(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).data.cast("B") if a.size else b"")
            out.write(bytes(-a.nbytes % 8))
    system.move(own, f"{path}/{name}")


def map_arrays(folder: str, name: str, kinds: list[type]) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory; empty ones where there is no file."""
    system, path = _files(folder)
    if system.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return [np.zeros(0, t) for t in kinds]
    with system.open_input_file(f"{path}/{name}") as file:
        whole = np.frombuffer(file.read_buffer(), np.uint8)
    sizes = whole[8 : 8 + 8 * len(kinds)].view(np.int64)
    at = 8 + 8 * len(kinds) + np.concatenate([[0], np.cumsum(-(-sizes // 8) * 8)])
    return [whole[a : a + n].view(t) for a, n, t in zip(at.tolist(), sizes.tolist(), kinds, strict=False)]


_PACKET = "part int, block long, contexts binary, runs binary, words binary, which binary, weights binary, doc_ids binary, flags binary, tokens binary"


def _records(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _packets(src: DataFrame, heavy: np.ndarray, parts: int, by_text: bool) -> DataFrame:
    """Bigrams of blocks of texts, packed by part: contexts, run lengths, distinct words, each successor's place among them, and training counts or texts.

    With ``by_text`` a block also has a row with ids, flags (1: held out, 2: null id) and numbers of tokens of its texts.
    """
    flush = max(_FLUSH, min(640 * parts, 4 * _FLUSH))

    def packed(held, block):
        raws = [h[0] for h in held]
        v, w, text = (np.concatenate(x) for x in zip(*((a, b, c + lo) for lo, _, part in _text.blocks(raws) for a, b, c in [bigrams(part)]), strict=True))
        train = np.array([h[2] for h in held])
        sizes = np.bincount(text, minlength=len(raws))
        route = _route(v, w, heavy, parts)
        order = np.lexsort((w, v, route))
        v, w, text, route = v[order], w[order], text[order], route[order]
        if by_text:
            weights = text.astype(np.uint16)
        else:
            at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
            weights = np.add.reduceat(train[text].astype(np.int32), at, dtype=np.int32)
            v, w, route = v[at], w[at], route[at]
        cuts = np.searchsorted(route, np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            first = np.flatnonzero(np.concatenate([[True], v[a + 1 : b] != v[a : b - 1]]))
            runs = np.diff(np.append(first, b - a)).astype(np.int32)
            words, which = np.unique(w[a:b], return_inverse=True)
            which = which.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
            rows.append((p, block, _shrink(v[a + first], True), _shrink(runs), _shrink(words, True), _shrink(which), _shrink(weights[a:b]), None, None, None))
        if by_text:
            ids = np.array([h[1] or 0 for h in held], np.int64)
            flags = (~train).astype(np.uint8) + np.array([2 * (h[1] is None) for h in held], np.uint8)
            rows.append((block % parts, block, *[None] * 5, ids.tobytes(), flags.tobytes(), sizes.astype(np.int64).tobytes()))
        return _records(rows, _PACKET)

    def deal(batches):
        held: list[tuple] = []
        size, block = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for text, doc, train in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "train")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                held.append((raw, doc, train))
                size += len(raw)
                if size > flush or len(held) >= _ROWS:
                    yield packed(held, block)
                    held, size, block = [], 0, block + 1
        if held:
            yield packed(held, block)

    return src.mapInArrow(deal, _PACKET).repartitionById(parts, F.col("part"))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, run lengths, distinct words, and each successor's place among them."""
    words = _grow(row["words"], np.uint64, True)
    return _grow(row["contexts"], np.uint64, True), _grow(row["runs"], np.int32), words, _grow(row["which"], np.uint16 if len(words) <= 1 << 16 else np.uint32)


#: Arrays of a part's file: bigram hashes, their counts (255: in the next two), bigrams of 255 and more, their counts,
#: contexts, their totals and numbers of successors seen once, twice, more often, words asked for, contexts before each.
_MODEL = [np.uint64, np.uint8, np.uint64, np.int64, np.uint64, np.uint32, np.uint64, np.uint32]


def count_parts(src: DataFrame, heavy: np.ndarray, parts: int, folder: str) -> DataFrame:
    """Write the model's parts; a row a part with counts of counts, distinct light contexts, their tokens, and the heavy contexts' totals."""

    def summed(rows, low, high):
        """Distinct bigrams with contexts from ``low`` up to ``high``, and their counts."""
        held = []
        for row in rows:
            contexts, runs, words, which = _unpack(row)
            a, b = np.searchsorted(contexts, np.array([low, high], np.uint64)).tolist()
            at = np.concatenate([[0], np.cumsum(runs, dtype=np.int64)])
            own = slice(at[a], at[b])
            held.append((np.repeat(contexts[a:b], runs[a:b]), words[which[own]], _grow(row["weights"], np.int32)[own]))
        v, w, c = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        order = np.lexsort((w, v))
        v, w, c = v[order], w[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
        return v[at], w[at], np.add.reduceat(c, at, dtype=np.int64) if len(at) else c.astype(np.int64)

    def count(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        part, found = rows[0]["part"], []
        for k in range(_SLICES):
            v, w, c = summed(rows, (k << _BITS) // _SLICES, ((k + 1) << _BITS) // _SLICES)
            # words that are asked for, seen in training or not
            asked, which = np.unique(w, return_inverse=True)
            before = np.bincount(which, c > 0, len(asked)).astype(np.int64)
            seen = c > 0
            v, w, c = v[seen], w[seen], c[seen]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
            stats = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2)], axis=1) if len(v) else np.zeros((0, 4), np.int64)
            found.append((v[first], stats, _pair_keys(v, w), c, asked, before))
        rows.clear()
        contexts, stats, keys, c, asked, before = map(np.concatenate, zip(*found, strict=True))
        found.clear()
        asked, which = np.unique(asked, return_inverse=True)
        before = np.bincount(which, before, len(asked)).astype(np.uint32)
        order = np.argsort(keys)
        keys, n = keys[order], c[order]
        large = n >= 255
        write_arrays(folder, f"{part}.model", [keys, np.minimum(n, 255).astype(np.uint8), keys[large], n[large], contexts, stats.astype(np.uint32), asked, before])
        light = ~np.isin(contexts, heavy)
        own = [(int(x), *map(int, y)) for x, y in zip(contexts[~light].view(np.int64), stats[~light], strict=True)]
        names = ["c1", "c2", "c3", "c4", "known", "tokens"]
        sums = [*(int((c == k).sum()) for k in (1, 2, 3, 4)), int(light.sum()), int(stats[light, 0].sum())]
        five = pa.list_(pa.struct([(x, pa.int64()) for x in ("v", "n", "n1", "n2", "n3")]))
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in sums), pa.array([own], five)], names=[*names, "heavy"])

    packets = _packets(src, heavy, parts, False)
    return packets.mapInArrow(count, "c1 long, c2 long, c3 long, c4 long, known long, tokens long, heavy array<struct<v:bigint,n:bigint,n1:bigint,n2:bigint,n3:bigint>>")


_LEVEL = "m1 long, m2 long, m3 long, m4 long, more long, total long"


def count_continuations(spark, parts: int, folder: str) -> DataFrame:
    """Sum the contexts before each word over the parts and write them for every part, in the order of the words it asked for; rows with the counts of counts."""
    n = homes(parts)

    def ask(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                asked, before = map_arrays(folder, f"{part}.model", _MODEL)[6:]
                cuts = np.searchsorted(_home(asked, n), np.arange(n + 1))
                yield _records([(h, part, _shrink(asked[cuts[h] : cuts[h + 1]], True), _shrink(before[cuts[h] : cuts[h + 1]])) for h in np.flatnonzero(np.diff(cuts)).tolist()], "home int, part int, words binary, counts binary")

    def total(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        words = [_grow(r["words"], np.uint64, True) for r in rows]
        counts = np.concatenate([_grow(r["counts"], np.uint32) for r in rows])
        _, which = np.unique(np.concatenate(words), return_inverse=True)
        summed = np.bincount(which, counts).astype(np.int64)
        level = [*(int((summed == k).sum()) for k in (1, 2, 3, 4)), int((summed > 2).sum()), int(summed.sum())]
        back, at = summed[which].astype(np.uint32), np.cumsum([0, *map(len, words)])
        yield _records([(r["part"], r["home"], _shrink(back[a:b]), *(level if not i else [0] * 6)) for i, (r, a, b) in enumerate(zip(rows, at[:-1], at[1:], strict=True))], f"part int, home int, counts binary, {_LEVEL}")

    def store(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            rows.sort(key=lambda r: r["home"])
            write_arrays(folder, f"{rows[0]['part']}.lower", [np.concatenate([_grow(r["counts"], np.uint32) for r in rows])])
            yield _records([tuple(sum(r[x.split()[0]] for r in rows) for x in _LEVEL.split(", "))], _LEVEL)

    asks = spark.range(parts).repartitionById(parts, F.col("id").cast("int")).mapInArrow(ask, "home int, part int, words binary, counts binary")
    totals = asks.repartitionById(n, F.col("home")).mapInArrow(total, f"part int, home int, counts binary, {_LEVEL}")
    return totals.repartitionById(parts, F.col("part")).mapInArrow(store, _LEVEL)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more; halves where counts of counts are missing."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1))])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    train = F.coalesce(trained_on(F.col(id_col)) if trained is None else trained, F.lit(False))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), train.alias("train"), F.col(text_col).alias("text"))
    size = src.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("train").alias("texts")).first()
    n_train, wide = size["texts"], -(-(size["bytes"] or 0) // (PART // 16))
    # a small table has as many parts as the session has partitions, if they get a sixteenth of a part or more
    parts = max(1, -(-wide // 16), min(wide, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    folder = f"{shared_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"
    heavy = heavy_contexts(src.select("text"), max(HEAVY, 2 * parts))
    counted = save(count_parts(src, heavy, parts, folder))
    sums = counted.agg(*(F.sum(c).alias(c) for c in ("c1", "c2", "c3", "c4", "known", "tokens"))).first().asDict()
    # at most as many rows as there are heavy contexts
    split = counted.select(F.explode("heavy").alias("h")).groupBy("h.v").agg(*(F.sum(f"h.{x}").alias(x) for x in ("n", "n1", "n2", "n3"))).collect()
    level = save(count_continuations(spark, parts, folder)).agg(*(F.sum(c.split()[0]).alias(c.split()[0]) for c in _LEVEL.split(", "))).first().asDict()
    sums, level = ({k: int(v or 0) for k, v in x.items()} for x in (sums, level))
    split = sorted((r["v"] & (1 << 64) - 1, r["n"], r["n1"], r["n2"], r["n3"]) for r in split)
    heavy_keys = np.array([r[0] for r in split], np.uint64)
    heavy_stats = np.array([r[1:] for r in split], np.int64).reshape(-1, 4)
    words = heavy_keys != np.uint64(_START)
    n_tokens = sums["tokens"] + int(heavy_stats[words, 0].sum()) + n_train
    n_words = sums["known"] + int(words.sum()) + (n_train > 0)
    d2, d1 = discounts(*(sums[f"c{k}"] for k in (1, 2, 3, 4))), discounts(*(level[f"m{k}"] for k in (1, 2, 3, 4)))
    uniform, span = 1.0 / (n_words + 1), n_tokens + n_words + 1
    left = (d1[1] * level["m1"] + d1[2] * level["m2"] + d1[3] * level["more"]) / max(1, level["total"])

    def find(stored, asked):
        """Places of what is asked in a sorted array, and whether it is there."""
        at = np.searchsorted(stored, asked)
        at[at == len(stored)] = 0
        return at, stored[at] == asked if len(stored) else np.zeros(len(asked), bool)

    def one(row, arrays, lower):
        keys, counts, large, large_counts, known_contexts, stats, asked, _ = arrays
        contexts, runs, words, which = _unpack(row)
        at, hit = find(keys, _pair_keys(np.repeat(contexts, runs), words[which]))
        c = np.where(hit, counts[at] if len(counts) else 0, 0).astype(np.int64)
        many = np.flatnonzero(c == 255)
        c[many] = large_counts[find(large, keys[at[many]])[0]] if len(many) else 0
        at, hit = find(known_contexts, contexts)
        own = np.where(hit[:, None], stats.reshape(-1, 4)[at].astype(np.int64) if len(stats) else 0, np.zeros((len(contexts), 4), np.int64))
        at, hit = find(heavy_keys, contexts)
        own[hit] = heavy_stats[at[hit]]
        # the same words were asked for when the parts were counted
        cont = lower[np.searchsorted(asked, words)].astype(np.int64)
        low = (np.maximum(cont - d1[np.minimum(cont, 3)], 0) / level["total"] + left * uniform) if level["total"] else np.full(len(words), uniform)
        total = own[:, 0]
        weight = np.where(total > 0, (own[:, 1:] @ d2[1:]) / np.maximum(1, total), 1.0)
        logs = np.log10(np.maximum(c - d2[np.minimum(c, 3)], 0) / np.repeat(np.maximum(1, total), runs) + np.repeat(weight, runs) * low[which])
        inner, end = contexts != np.uint64(_START), (words == np.uint64(_END))[which]
        base = np.repeat(np.where(inner, np.log10((total + 1) / span), 0.0), runs) + np.where(end, np.log10((n_train + 1) / span), 0.0)
        known = np.repeat((inner & (total > 0)).astype(np.int64), runs) + (end & (n_train > 0))
        texts, which = np.unique(_grow(row["weights"], np.uint16), return_inverse=True)
        add = lambda x: np.bincount(which, x, len(texts))
        return row["block"], _shrink(texts, True), _shrink(add(known).astype(np.uint32)), add(base).tobytes(), add(logs).tobytes(), None, None, None

    summed = "block long, texts binary, known binary, base binary, score binary, doc_ids binary, flags binary, tokens binary"

    def score(batches):
        arrays = lower = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if arrays is None:
                    arrays = map_arrays(folder, f"{row['part']}.model", _MODEL)
                    (lower,) = map_arrays(folder, f"{row['part']}.lower", [np.uint32])
                rows.append(one(row, arrays, lower) if row["doc_ids"] is None else (row["block"], *[None] * 4, row["doc_ids"], row["flags"], row["tokens"]))
            yield _records(rows, summed)

    def gather(batches):
        """Rows come sorted by block."""
        rows: list[dict] = []

        def whole():
            head = next(r for r in rows if r["doc_ids"] is not None)
            ids, flags, tokens = (np.frombuffer(head[x], t) for x, t in (("doc_ids", np.int64), ("flags", np.uint8), ("tokens", np.int64)))
            known, base, logs = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for r in rows:
                if r["doc_ids"] is None:
                    texts = _grow(r["texts"], np.uint16, True)
                    known[texts] += _grow(r["known"], np.uint32)
                    base[texts] += np.frombuffer(r["base"], float)
                    logs[texts] += np.frombuffer(r["score"], float)
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=(flags & 2).astype(bool)), pa.array((flags & 1).astype(bool)), pa.array(tokens), pa.array(known), pa.array(np.full(n, n_tokens)), pa.array(base), pa.array(logs)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["block"] != row["block"]:
                    yield whole()
                    rows = []
                rows.append(row)
        if rows:
            yield whole()

    partial = _packets(src, heavy, parts, True).mapInArrow(score, summed)
    n = homes(parts)
    placed = partial.repartitionById(n, F.pmod(F.hash("block"), F.lit(n))).sortWithinPartitions("block")
    return placed.mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
