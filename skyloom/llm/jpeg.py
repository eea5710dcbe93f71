"""Media columns: baseline JPEG written and read in numpy.

Reading parses the markers, decodes the Huffman codes of a scan and keeps the DC coefficients, which
give a luminance thumbnail of a pixel per 8x8 block, dimensions and a thumbnail hash. Restart
intervals are independent, so all intervals of a batch with equal tables are decoded side by side,
a symbol at a time. Writing stores a payload losslessly: each byte is the level of one 8x8 block
(DC quantiser 8, so that level is exact), 64 blocks a row, one row a restart interval.

Edge cases: null and empty texts are 64 zero bytes; payloads over 64 x 8191 bytes are several
images, one after the other; equal texts give equal values; images that aren't baseline JPEG, miss a
table, end early or hold codes of no table are left out, and streams without an image have null
features. Only the id and content columns are read, so other columns can't clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import _text

ROW = 64
MAX_ROWS = 8191
# Lengths of the standard's luminance DC codes by category, and its zigzag order isn't needed for DC.
_DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
_DC_SYMBOLS = list(range(12))
_AC_COUNTS = [1] + [0] * 15
_AC_SYMBOLS = [0]
_cache: dict[str, object] = {}


def code_table(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For any 16 bits: code length << 8 | symbol; 0 where no code begins so."""
    key = f"t{counts}{symbols}"
    if key not in _cache:
        if len(_cache) > 200:
            _cache.clear()
        table = np.zeros(1 << 16, np.int32)
        for symbol, code, length in code_table(counts, symbols):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        _cache[key] = table
    return _cache[key]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    quantiser = bytes([0, 8] + [1] * 63)
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"".join([
        b"\xff\xd8", _segment(0xDB, quantiser), _segment(0xC0, frame),
        _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_SYMBOLS])), _segment(0xC4, bytes([0x10, *_AC_COUNTS, *_AC_SYMBOLS])),
        _segment(0xDD, ROW.to_bytes(2, "big")), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _level_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, with the end-of-block code behind."""
    if "levels" not in _cache:
        dc = {s: (c, n) for s, c, n in code_table(_DC_COUNTS, _DC_SYMBOLS)}
        bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
        for diff in range(-255, 256):
            category = abs(diff).bit_length()
            code, n = dc[category]
            extra = diff if diff >= 0 else diff + (1 << category) - 1
            bits[diff + 255] = (code << category | extra) << 1
            sizes[diff + 255] = n + category + 1
        _cache["levels"] = bits, sizes
    return _cache["levels"]


def payload(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG stream for each payload, whose length is a positive multiple of 64."""
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, ROW)
    diff = np.diff(data - 128, axis=1, prepend=0)
    bits, sizes = _level_codes()
    code, size = bits[diff + 255], sizes[diff + 255]
    in_row = np.cumsum(size, axis=1)
    row_bytes = (in_row[:, -1] + 7) // 8
    row_at = np.cumsum(row_bytes) - row_bytes
    at = (in_row - size + row_at[:, None] * 8).ravel()
    total = int(row_bytes.sum())
    window = code.ravel() << (24 - (at & 7) - size.ravel())
    first = at >> 3
    packed = np.zeros(total + 2)
    for k in range(3):
        packed += np.bincount(first + k, weights=(window >> (16 - 8 * k)) & 0xFF, minlength=total + 2)[: total + 2]
    packed = packed[:total].astype(np.uint8)
    spare = row_bytes * 8 - in_row[:, -1]
    packed[row_at + row_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)
    # images: rows of each payload in runs of at most MAX_ROWS
    images, owner = [], []
    for i, p in enumerate(payloads):
        rows = len(p) // ROW
        for k in range(0, rows, MAX_ROWS):
            images.append(min(MAX_ROWS, rows - k))
            owner.append(i)
    rows = np.array(images)
    first_row = np.cumsum(rows) - rows
    inside = np.arange(len(row_bytes)) - np.repeat(first_row, rows)
    heads = [_header(r) for r in images]
    lead = np.where(inside > 0, 2, 0)  # a restart marker before each row but the first
    lead[first_row] = [len(h) for h in heads]
    lead[first_row[1:]] += 2  # the end marker of the image before
    full = packed == 0xFF
    shift = np.cumsum(full) - full
    byte_row = np.repeat(np.arange(len(row_bytes)), row_bytes)
    place = np.arange(total) + shift + np.cumsum(lead)[byte_row]
    out = np.zeros(int(place[-1]) + 1 + int(full[-1]) + 2, np.uint8)
    out[place] = packed
    begin = place[row_at]
    later = inside > 0
    out[begin[later] - 2] = 0xFF
    out[begin[later] - 1] = 0xD0 + (inside[later] - 1) % 8
    stream, starts = out, []
    for head, b in zip(heads, begin[first_row].tolist(), strict=True):
        stream[b - len(head) : b] = np.frombuffer(head, np.uint8)
        starts.append(b - len(head))
    for b in [*starts[1:], len(out)]:
        stream[b - 2 : b] = (0xFF, 0xD9)
    whole, cuts = stream.tobytes(), [*starts, len(out)]
    parts: list[list[bytes]] = [[] for _ in payloads]
    for k, i in enumerate(owner):
        parts[i].append(whole[cuts[k] : cuts[k + 1]])
    return [b"".join(p) for p in parts]


def parse(media: bytes) -> list[dict]:
    """Baseline images of a stream: dimensions, components, tables and the place of the scan; broken ones are left out."""
    images, i, n = [], 0, len(media)
    while (i := media.find(b"\xff\xd8", i)) >= 0:
        image = {"quant": {}, "huff": {}, "restart": 0}
        i += 2
        while i + 4 <= n and media[i] == 0xFF:
            marker = media[i + 1]
            if marker == 0xD9 or marker == 0xFF:
                i += 2 if marker == 0xD9 else 1
                if marker == 0xD9:
                    break
                continue
            size = int.from_bytes(media[i + 2 : i + 4], "big")
            body = media[i + 4 : i + 2 + size]
            i += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    image["quant"][body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                    k += 65 + 64 * wide
            elif marker == 0xC0 and len(body) >= 6:
                image |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big")}
                image["depth"] = body[0]
                image["parts"] = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5]) if 8 + 3 * c < len(body)]
            elif marker == 0xC4:
                k = 0
                while k + 17 <= len(body):
                    counts = list(body[k + 1 : k + 17])
                    symbols = list(body[k + 17 : k + 17 + sum(counts)])
                    if len(symbols) == sum(counts):
                        image["huff"][body[k]] = (counts, symbols)
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                image["restart"] = int.from_bytes(body[:2], "big")
            elif marker == 0xDA and "width" in image:
                image["scan"] = {name: (tables >> 4, tables & 15) for name, tables in zip(body[1 : 1 + 2 * body[0] : 2], body[2 : 2 + 2 * body[0] : 2], strict=False)} if body else {}
                end = i
                while True:
                    end = media.find(b"\xff", end)
                    if end < 0 or end + 1 >= n:
                        end = n
                        break
                    if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                        nul = end + 2
                        end = nul
                        continue
                    break
                image["data"] = (i, end)
                i = end
                if _fits(image, media[slice(*image["data"])]):
                    images.append(image)
                break
    return images


def _grid(image: dict) -> tuple[int, int, int]:
    """MCUs across and down, and MCUs in a restart interval."""
    alone = len(image["parts"]) == 1
    hmax, vmax = max(p[1] for p in image["parts"]), max(p[2] for p in image["parts"])
    across = -(-image["width"] // (8 if alone else 8 * hmax))
    down = -(-image["height"] // (8 if alone else 8 * vmax))
    return across, down, image["restart"] or across * down


def _fits(image: dict, scan: bytes) -> bool:
    """Whether an image has all that its scan needs, and the scan has its restart intervals and two bits or more a block."""
    parts, huff = image["parts"], image["huff"]
    if image["depth"] != 8 or not (image["width"] and image["height"] and parts) or not all(p[0] in image["scan"] and 1 <= p[1] <= 4 and 1 <= p[2] <= 4 for p in parts):
        return False
    if any(dc not in huff or 16 | ac not in huff or max(huff[dc][1], default=0) > 11 for dc, ac in (image["scan"][p[0]] for p in parts)):
        return False
    across, down, step = _grid(image)
    blocks = 1 if len(parts) == 1 else sum(p[1] * p[2] for p in parts)
    data = np.frombuffer(scan, np.uint8)
    marks = int(((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7)).sum())
    return marks + 1 == -(-across * down // step) and 2 * blocks * across * down <= 8 * len(scan)


def _layout(image: dict) -> tuple:
    """What the decoder needs to know of an image: blocks of an MCU as (component, DC table, AC table) and the tables."""
    blocks = []
    alone = len(image["parts"]) == 1
    for c, (name, h, v, _) in enumerate(image["parts"]):
        dc, ac = image["scan"][name]
        blocks += [(c, dc, ac)] * (1 if alone else h * v)
    return tuple(blocks), tuple(sorted((k, tuple(a), tuple(b)) for k, (a, b) in image["huff"].items()))


def decode_dc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mcus: np.ndarray, layout: tuple) -> tuple[np.ndarray, np.ndarray]:
    """DC levels of the MCUs of many independent intervals, (interval, MCU, block), and which intervals are sound; ``data`` without stuffing, padded by 8 bytes."""
    blocks, tables = layout
    found = {k: lookup(list(a), list(b)) for k, a, b in tables}
    wide = data.astype(np.uint32)
    wide = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    at = starts.astype(np.int64) * 8
    limit = (len(wide) - 1) * 8
    steps = int(mcus.max(initial=0))
    out = np.zeros((len(starts), steps, len(blocks)), np.int32)
    level = np.zeros((len(starts), 1 + max(c for c, _, _ in blocks)), np.int32)
    even = bool((mcus == steps).all())
    sound = np.ones(len(starts), bool)

    def peek(p: np.ndarray) -> np.ndarray:
        return (wide[p >> 3] << (p & 7).astype(np.uint32)) >> 16

    def met(entry: np.ndarray) -> None:
        """Lanes that meet a code of no symbol aren't sound."""
        if entry.min() <= 0:
            sound[lanes[entry <= 0]] = False

    lanes = np.arange(len(starts))
    for m in range(steps):
        if not even:
            lanes = np.flatnonzero(mcus > m)
        p = at if even else at[lanes]
        for b, (c, dc, ac) in enumerate(blocks):
            entry = found[dc][peek(p)]
            met(entry)
            size = entry & 0xFF
            p = np.minimum(p + (entry >> 8), limit)
            extra = (peek(p) >> (16 - size).astype(np.uint32)).astype(np.int32)
            p = np.minimum(p + size, limit)
            half = (1 << size) >> 1
            diff = np.where(extra < half, extra - (1 << size) + 1, extra)
            if even:
                level[:, c] += diff
                out[:, m, b] = level[:, c]
            else:
                level[lanes, c] += diff
                out[lanes, m, b] = level[lanes, c]
            # pass over the AC coefficients
            table, seen, busy = found[16 | ac], None, None
            entry = table[peek(p)]
            met(entry)
            p = np.minimum(p + (entry >> 8), limit)
            symbol = entry & 0xFF
            busy = np.flatnonzero(symbol)
            if len(busy):
                seen = np.zeros(len(p), np.int32)
                while len(busy):
                    s = symbol[busy]
                    p[busy] = np.minimum(p[busy] + (s & 15), limit)
                    seen[busy] += (s >> 4) + 1
                    busy = busy[seen[busy] < 63]
                    entry = table[peek(p[busy])]
                    if len(busy) and entry.min() <= 0:
                        sound[lanes[busy[entry <= 0]]] = False
                    p[busy] = np.minimum(p[busy] + np.maximum(entry >> 8, 1), limit)
                    symbol[busy] = entry & 0xFF
                    busy = busy[symbol[busy] > 0]
        if even:
            at = p
        else:
            at[lanes] = p
    return out, sound & (at <= 8 * ends)


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, luminance thumbnail of a pixel per 8x8 block) of each baseline image of each stream."""
    parsed = [(i, image) for i, m in enumerate(media) for image in parse(m)]
    out: list[list] = [[] for _ in media]
    groups: dict[tuple, list] = {}
    for i, image in parsed:
        groups.setdefault(_layout(image), []).append((i, image))
    for layout, members in groups.items():
        # scans of the group, each closed by a marker that ends its last interval
        data = np.frombuffer(b"".join(media[i][im["data"][0] : im["data"][1]] + b"\xff\xd0" for i, im in members), np.uint8)
        full = np.flatnonzero(data == 0xFF)
        full = full[full + 1 < len(data)]
        behind = data[full + 1]
        marks = full[(behind >= 0xD0) & (behind <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[full[behind == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        moved = np.concatenate([[0], np.cumsum(keep)])
        ends = moved[marks]
        starts = np.concatenate([[0], ends[:-1]])
        clean = np.concatenate([data[keep], np.zeros(8, np.uint8)])
        mcus, shape = [], []
        for _, im in members:
            across, down, step = _grid(im)
            n = across * down
            mcus += [min(step, n - k) for k in range(0, n, step)]
            shape.append((across, down, step))
        levels, sound = decode_dc(clean, starts, ends, np.array(mcus), layout)
        first = 0
        for (i, im), (across, down, step) in zip(members, shape, strict=True):
            n = across * down
            lanes = -(-n // step)
            own = levels[first : first + lanes].reshape(lanes * levels.shape[1], -1)
            if levels.shape[1] != step:
                own = levels[first : first + lanes, :step].reshape(lanes * step, -1)
            whole = sound[first : first + lanes].all()
            first += lanes
            if not whole:
                continue
            _, h, v, q = im["parts"][0]
            if len(im["parts"]) == 1:
                h = v = 1
            luma = own[:n, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            pixels = np.clip((luma * im["quant"].get(q, 8) + 4) // 8 + 128, 0, 255).astype(np.uint8)
            out[i].append((im["width"], im["height"], pixels[: -(-im["height"] // 8), : -(-im["width"] // 8)]))
    return out


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64-bit difference hash of a thumbnail brought to 8 rows of 9 mean levels."""
    def fold(a: np.ndarray, n: int) -> np.ndarray:
        if len(a) < n:
            a = a[np.arange(n) * len(a) // n]
        at = np.arange(n) * len(a) // n
        return np.add.reduceat(a, at, axis=0) / np.diff(np.append(at, len(a)))[:, None]

    small = fold(fold(pixels.astype(np.float64), 8).T, 9)
    return np.packbits((small[1:] > small[:-1]).T).tobytes().hex()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the JPEG stream that stores each text's padded UTF-8 bytes."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, raws in _text.blocks(batch.column("text").to_pylist()):
                media = encode([payload(r) for r in raws])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions, thumbnail hash and thumbnail bytes (the levels of all images in order) of each stream; null where there is no image."""
    kept = [c for c in media.columns if c not in ("width", "height", "images", "thumbnail_hash", "thumbnail")]
    src = media.select(*kept)

    def run(batches):
        for batch in batches:
            streams = batch.column(media_col)
            sizes = streams.to_pylist()
            for lo, hi, part in _text.blocks([s or b"" for s in sizes]):
                found = thumbnails(part)
                rows = [(f[0][0], sum(x[1] for x in f), len(f), "-".join(thumbnail_hash(x[2]) for x in f), b"".join(x[2].tobytes() for x in f)) if f else (None, None, 0, None, None) for f in found]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=[*kept, "width", "height", "images", "thumbnail_hash", "thumbnail"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{fields}, width long, height long, images long, thumbnail_hash string, thumbnail binary")


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Payload values are those of the thumbnail read back: a level a byte."""
    back = read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    tail = F.expr("substring(thumbnail, -64, 64)")
    return back.select(
        "doc_id", "n_bytes", F.octet_length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "images", "thumbnail_hash").alias("feature"),
    )
