"""Byte-level BPE encoding and decoding with two tiers.

Texts are cut into pre-tokens by character class, a block at a time. A minimal perfect hash of the
vocabulary resolves each pre-token that is a token as a whole; the others are merged by a heap of
ranked pairs over linked bytes. Hashes only find candidates: bytes are compared on every hit, so ids are
exact. Results of merges are remembered in the task by their bytes, up to ``MEMO`` pieces.

Edge cases: null and empty texts have no ids and decode to no bytes. Rows keep their multiplicity
and order of columns doesn't matter; only the id and text columns are read, so extra columns can't
clash. Long texts are blocks of their own. Special tokens are never produced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text

MEMO = 500_000
# The characters that Unicode calls White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_tables: dict[str, object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (base64 token, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def character_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    if "classes" not in _tables:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[_WHITE] = _SPACE
        _tables["classes"] = table
    return _tables["classes"]


def pretoken_starts(chars: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the joined code points; ``docs``: first code point of each text, with the end.

    One space goes with the run of letters, numbers or others behind it; of other white space the last
    character stands apart, unless the text ends there; 's 't 're 've 'm 'll 'd stand apart.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = character_classes()[chars]
    fresh = np.zeros(n + 1, bool)
    fresh[docs[:-1]] = True
    fresh[n] = True
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(run)
    end = np.append(first[1:], n)
    white = kind[first] == _SPACE
    cut = run.copy()
    # white space with something behind it in the same text
    lead = white & ~fresh[end]
    start, last = first[lead], end[lead] - 1
    cut[last] = True
    joins = chars[last] == 0x20
    cut[end[lead][joins]] = False
    # contractions: a lone apostrophe that no space joins, before letters
    lone = first[(chars[first] == 0x27) & (end - first == 1)]
    lone = lone[(lone + 1 < n)]
    lone = lone[~fresh[lone + 1] & ((chars[lone - 1] != 0x20) | fresh[lone])]
    one = chars[lone + 1]
    two = np.where(lone + 2 < n, chars[np.minimum(lone + 2, n - 1)], 0)
    two[fresh[np.minimum(lone + 2, n)]] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((lone[short], 2), (lone[long & ~short], 3)):
        cut[at + 1] = False
        behind = at + size
        behind = behind[behind < n]
        cut[behind] |= kind[behind] == _LETTER
    return np.flatnonzero(cut)


class PerfectHash:
    """Minimal perfect hash of the tokens by hash and displace: a bucket's displacement puts its keys in free slots."""

    def __init__(self, tokens: list[bytes]):
        raws = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        starts = ends - np.array([len(t) for t in tokens])
        keys = _text.span_hashes(raws, starts, ends)
        n = len(tokens)
        self.size, self.buckets = n, max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        owner = np.full(n, -1, np.int64)
        # buckets of one size at a time, the largest first; each round tries one displacement for all that wait
        for size in range(int(sizes.max(initial=0)), 1, -1):
            waiting = np.flatnonzero(sizes == size)
            own = order[bounds[waiting][:, None] + np.arange(size)]
            d = 0
            while len(waiting):
                d += 1
                slots = self._place(keys[own], np.int64(d))
                claim = np.full(n, len(waiting), np.int64)
                np.minimum.at(claim, slots, np.arange(len(waiting))[:, None])
                ordered = np.sort(slots, axis=1)
                good = (owner[slots] < 0).all(axis=1) & (claim[slots] == np.arange(len(waiting))[:, None]).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                owner[slots[good]] = own[good]
                self.shift[waiting[good]] = d
                waiting, own = waiting[~good], own[~good]
        free = iter(np.flatnonzero(owner < 0).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():
            slot = next(free)
            owner[slot] = order[bounds[b]]
            self.shift[b] = -slot - 1
        self.keys, self.owner, self.raws = keys[owner], owner, raws
        self.starts, self.lengths = starts[owner], (ends - starts)[owner]

    def _place(self, keys: np.ndarray, shift) -> np.ndarray:
        return (_text.mix64(keys + np.asarray(shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the token that each byte span is, -1 where there is none, and the spans' hashes."""
        keys, lengths = _text.span_hashes(data, starts, ends), ends - starts
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._place(keys, np.maximum(shift, 0)))
        out = np.where((self.keys[slot] == keys) & (self.lengths[slot] == lengths), self.owner[slot], -1)
        hit = np.flatnonzero(out >= 0)
        out[hit[~_text.equal_spans(data, starts[hit], self.raws, self.starts[slot[hit]], lengths[hit])]] = -1
        return out, keys


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank, leftmost first, is joined until no pair is a token."""
    n, get = len(piece), ranks.get
    bits = 22 if n < 1 << 22 else 40
    mask = (1 << bits) - 1
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append((((rank << bits) | i) << bits) | i + 2)
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        end, i = entry & mask, (entry >> bits) & mask
        middle = after[i]  # below 0 where i was joined to its left
        if middle < 0 or middle >= n or after[middle] != end:
            continue
        after[middle] = -1
        after[i] = end
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]])
            if rank is not None:
                heapq.heappush(heap, (((rank << bits) | i) << bits) | after[end])
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            if rank is not None:
                heapq.heappush(heap, (((rank << bits) | left) << bits) | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes blocks of texts; built once a worker from the rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = list(ranks)
        self.ids = np.array([ranks[t] for t in self.tokens], np.int32)
        self.hash = PerfectHash(self.tokens)
        self.by_id = {i: t for t, i in ranks.items()}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the bounds of each text in them."""
        whole = b"".join(raws)
        chars = np.frombuffer(whole.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        byte_at = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000), out=byte_at[1:])
        docs_b = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        docs = np.searchsorted(byte_at, docs_b)
        filled = docs[:-1] < docs[1:]
        begins = byte_at[pretoken_starts(chars, np.append(docs[:-1][filled], len(chars)))]
        ends = np.append(begins[1:], len(whole)) if len(begins) else begins
        data = np.frombuffer(whole, np.uint8)
        found, keys = self.hash.find(data, begins, ends)
        missed = np.flatnonzero(found < 0)
        _, lead, which = np.unique(keys[missed], return_index=True, return_inverse=True)
        # pieces that only share a hash with the first of theirs stand for themselves
        first, sizes = missed[lead][which], ends - begins
        other = np.flatnonzero((sizes[first] != sizes[missed]) | ~_text.equal_spans(data, begins[missed], data, begins[first], np.minimum(sizes[first], sizes[missed])))
        which[other] = len(lead) + np.arange(len(other))
        if len(self.memo) > MEMO:
            self.memo.clear()
        pieces = []
        spans = missed[np.concatenate([lead, other])]
        for start, end in zip(begins[spans].tolist(), ends[spans].tolist(), strict=True):
            piece = whole[start:end]
            got = self.memo.get(piece)
            if got is None:
                got = self.memo[piece] = tuple(merge_bytes(piece, self.ranks))
            pieces.append(got)
        sizes = np.array([len(p) for p in pieces], np.int64)
        flat = np.array([i for p in pieces for i in p], np.int32)
        heads = np.cumsum(sizes) - sizes
        counts = np.ones(len(begins), np.int64)
        counts[missed] = sizes[which]
        to = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        hit = found >= 0
        ids[to[hit]] = self.ids[found[hit]]
        many = counts[missed]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        ids[np.repeat(to[missed], many) + inner] = flat[np.repeat(heads[which], many) + inner]
        bounds = np.append(to, len(ids))[np.searchsorted(begins, docs_b)]
        return ids, bounds

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (list of int) and decoded (the bytes of those ids) of every text; one pass, no shuffle.

    The rank table is broadcast: its size is that of the vocabulary, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def run(batches):
        encoder = _encoders.get(name)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[name] = Encoder(shared.value)
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi, raws in _text.blocks(texts):
                ids, bounds = encoder.encode(raws)
                listed = ids.tolist()
                decoded = [encoder.decode(listed[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, ranks: dict[bytes, int], with_ids: bool = False) -> DataFrame:
    """Number of ids, and digests of the ids and of what they decode to; the ids themselves if asked for."""
    return encode_decode(docs, ranks).select(
        "doc_id",
        *(["ids"] if with_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def vocabulary() -> dict[bytes, int]:
    """The rank table of the registered query."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
