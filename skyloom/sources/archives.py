"""Archives of gridded arrays as a Spark data source: NetCDF classic files and NumPy archives, read by slices and written in two phases.

    read_archives(spark, folder, ["target"], split="train", batch_id=3, first=0, end=8)

A file's arrays share their first axis, the samples. A sample is a row: ``file``, ``split``, ``digest`` and ``batch_id`` from
names like ``train_b5e241cc_00000003.nc`` (null in others), ``pos`` on the first axis, and a flat array a key (a
single value where the array has one axis). Files are chosen by name at planning; a task reads the headers of
its files and then only the bytes of the positions and keys that are asked for, unless a member is
compressed or in column order, which is read as a whole. Formats are parsed here, by their published layouts.

Options: ``path``; ``keys`` (those to read), ``file``, ``split``, ``digest``, ``batch_id``, each a value or several with
commas; ``first`` and ``end`` of the positions; ``content`` = ``headers`` for a row an array with its type, shape
and attributes; ``target`` bytes a task (32 MB). What is wanted is said by options, not by pushed filters, since
Spark 4.1 keeps one reader for all queries over a loaded frame, which would share them.

Writing takes rows of ``file`` (a relative path), ``pos`` and the arrays, with the rows of a file together and in
order, as ``write_archives`` deals them. Tasks write into a staging folder of their own attempt; the commit moves
the files of the successful attempts to their names and then writes the manifest, a line a file; an abort removes
the staging folder. Names that begin with ``_`` or ``.`` are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skyloom.functions.text import zero_filled

NAME = re.compile(r"(?P<split>.+)_(?P<digest>[0-9a-f]+)_(?P<batch>\d{8,})\.(nc|npz)$")
PLACE = [("file", T.StringType()), ("split", T.StringType()), ("digest", T.StringType()), ("batch_id", T.LongType()), ("pos", T.LongType())]
HEADERS = "file string, key string, kind string, shape array<long>, attributes map<string, string>"
TARGET = 32 << 20
#: Rows of a batch that a task hands to Spark.
ROWS = 256

# Types of NetCDF classic files by number, and the tags of its lists.
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NC_DIMENSION, NC_VARIABLE, NC_ATTRIBUTE = 10, 11, 12


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"file:/+", path) or ":" not in path.split("/")[0]:
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path).rstrip("/")
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner.rstrip("/")


@dataclass
class Array:
    """Where an array's samples are in a file: ``step`` bytes lie between the beginnings of two samples."""

    kind: str
    shape: tuple[int, ...]
    offset: int
    step: int
    whole: Callable[[Callable], np.ndarray] | None = None
    attributes: dict = field(default_factory=dict)

    def rows(self, read: Callable[[int, int], bytes], first: int, end: int) -> np.ndarray:
        """Samples first to end - 1."""
        if self.whole:
            return self.whole(read)[first:end]
        inner, dtype, n = self.shape[1:], np.dtype(self.kind), max(0, end - first)
        width = int(np.prod(inner, dtype=np.int64)) * dtype.itemsize
        if not n or not width:
            return np.zeros((n, *inner), dtype)
        raw = read(self.offset + first * self.step, (n - 1) * self.step + width)
        return np.ndarray((n, *inner), dtype, raw, strides=(self.step, *np.empty((1, *inner), dtype).strides[1:]))


class _Cursor:
    """Numbers and names of a NetCDF header; more of the file is fetched as the header goes on."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.raw, self.at = read, size, b"", 0

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.raw):
            if len(self.raw) >= self.size:
                raise ValueError("the header is cut short")
            self.raw += self.read(len(self.raw), min(max(1 << 14, len(self.raw)), self.size - len(self.raw)))
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(f">{code}", self.take(struct.calcsize(code)))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]


def netcdf_arrays(read: Callable[[int, int], bytes], size: int) -> dict[str, Array]:
    """The variables of a NetCDF classic file (all three offsets), attributes of the variables included."""
    c = _Cursor(read, size)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("no NetCDF classic file")
    many, place = ("q" if magic[3] == 5 else "i"), ("i" if magic[3] == 1 else "q")
    count = lambda: c.number(many)

    def listed(tag: int) -> int:
        found, n = c.number("i"), count()
        if found not in (0, tag):
            raise ValueError("an unknown list in the header")
        return n if found else 0

    def attributes() -> dict:
        out = {}
        for _ in range(listed(NC_ATTRIBUTE)):
            name = c.padded(count()).decode()
            kind, n = NC_TYPES[c.number("i")], count()
            raw = c.padded(n * np.dtype(kind).itemsize)
            values = raw.decode() if kind == "S1" else np.frombuffer(raw, kind).tolist()
            out[name] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return out

    records = count()
    dims = [(c.padded(count()).decode(), count()) for _ in range(listed(NC_DIMENSION))]
    attributes()
    found, out = [], {}
    for _ in range(listed(NC_VARIABLE)):
        name = c.padded(count()).decode()
        ids = [count() for _ in range(count())]
        held, kind, _ = attributes(), NC_TYPES[c.number("i")], count()
        found.append((name, ids, held, kind, c.number(place)))
    of_record = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
    width = lambda v: int(np.prod([dims[d][1] for d in v[1][1:]], dtype=np.int64)) * np.dtype(v[3]).itemsize
    record = width(of_record[0]) if len(of_record) == 1 else sum(width(v) + -width(v) % 4 for v in of_record)
    for v in found:
        name, ids, held, kind, begin = v
        shape = tuple(dims[d][1] for d in ids)
        if v in of_record:
            out[name] = Array(kind, (records, *shape[1:]), begin, record, attributes=held)
        elif shape:
            out[name] = Array(kind, shape, begin, width(v), attributes=held)
    return out


def _npy(raw: bytes, offset: int) -> Array:
    """The array of a ``.npy`` file that begins at an offset; ``raw`` has its header."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("no NumPy array")
    n, start = (struct.unpack("<H", raw[8:10])[0], 10) if raw[6] == 1 else (struct.unpack("<I", raw[8:12])[0], 12)
    head = raw[start : start + n].decode("latin1")
    kind = re.search(r"'descr': '([^']+)'", head)
    if not kind or np.dtype(kind[1]).hasobject:
        raise ValueError("arrays of objects or records aren't read")
    shape = tuple(int(x) for x in re.search(r"'shape': \(([^)]*)\)", head)[1].split(",") if x.strip())
    begin, dtype = offset + start + n, np.dtype(kind[1])
    step = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
    size = int(np.prod(shape, dtype=np.int64)) * dtype.itemsize
    if "'fortran_order': True" in head and len(shape) > 1:
        return Array(kind[1], shape, begin, step, lambda read: np.frombuffer(read(begin, size), dtype).reshape(shape[::-1]).T)
    return Array(kind[1], shape, begin, step)


def zip_members(read: Callable[[int, int], bytes], size: int) -> list[tuple[str, int, int, int, int]]:
    """Name, method, packed and full size, and place of the local header of each member, from the central directory."""
    tail = read(max(0, size - (1 << 16) - 22), min(size, (1 << 16) + 22))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no archive")
    n, length, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    wide = tail.rfind(b"PK\x06\x07", 0, at)
    if wide >= 0 and (n == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF):
        record = read(struct.unpack("<Q", tail[wide + 8 : wide + 16])[0], 56)
        n, length, begin = struct.unpack("<QQQ", record[32:56])
    raw, at, out = read(begin, length), 0, []
    for _ in range(n):
        method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
        packed, full, names, extras, comments = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        local = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + names].decode()
        extra, k = raw[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, m = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:  # sizes and place beyond 32 bits, in this order, those that are needed
                values = iter(struct.unpack(f"<{m // 8}Q", extra[k + 4 : k + 4 + m // 8 * 8]))
                full, packed, local = (next(values) if v == 0xFFFFFFFF else v for v in (full, packed, local))
            k += 4 + m
        out.append((name, method, packed, full, local))
        at += 46 + names + extras + comments
    return out


def numpy_arrays(read: Callable[[int, int], bytes], size: int) -> dict[str, Array]:
    """The members of a NumPy archive: stored ones by place, deflated ones unpacked as a whole when they are read."""
    out = {}
    for name, method, packed, full, local in zip_members(read, size):
        names, extras = struct.unpack("<HH", read(local + 26, 4))
        begin = local + 30 + names + extras
        key = name.removesuffix(".npy")
        if method == 0:
            out[key] = _npy(read(begin, min(full, 1 << 12)), begin)
        elif method == 8:
            head = _npy(zlib.decompressobj(-15).decompress(read(begin, min(packed, 1 << 12)), 1 << 12), 0)

            def whole(read, begin=begin, packed=packed, head=head):
                raw = zlib.decompress(read(begin, packed), -15)
                inner = lambda first, n: raw[first : first + n]
                return head.whole(inner) if head.whole else head.rows(inner, 0, head.shape[0])

            out[key] = Array(head.kind, head.shape, 0, 0, whole)
        else:
            raise ValueError(f"{name} is packed by an unknown method")
    return {k: a for k, a in out.items() if a.shape}


def opened(fs: pafs.FileSystem, path: str) -> tuple[Callable[[int, int], bytes], dict[str, Array]]:
    """A function that reads bytes at a place, and the arrays of the file."""
    handle = fs.open_input_file(path)
    read = lambda at, n: handle.read_at(n, at)
    return read, (numpy_arrays if path.endswith(".npz") else netcdf_arrays)(read, handle.size())


def netcdf_bytes(arrays: dict[str, np.ndarray], attributes: dict[str, dict] | None = None) -> bytes:
    """A NetCDF classic file: all arrays share the first dimension, ``sample``; the others are named by key and place.

    64-bit offsets, and the format of 64-bit numbers only where integers need it.
    """
    codes = {np.dtype(k).newbyteorder("=").str: n for n, k in NC_TYPES.items() if k != "S1"}
    wide = any(np.dtype(a.dtype).str[1:] not in ("i1", "i2", "i4", "f4", "f8") for a in arrays.values())
    many = (lambda n: struct.pack(">q", n)) if wide else (lambda n: struct.pack(">i", n))
    name = lambda s: many(len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    listed = lambda tag, items: struct.pack(">i", tag if items else 0) + many(len(items)) + b"".join(items)

    def attribute(key: str, value) -> bytes:
        if isinstance(value, str):
            raw, code, n = value.encode(), 2, len(value.encode())
        else:
            a = np.atleast_1d(np.asarray(value, np.float64 if isinstance(value, float) or isinstance(value, list) and any(isinstance(v, float) for v in value) else np.int32))
            raw, code, n = a.astype(a.dtype.newbyteorder(">")).tobytes(), 6 if a.dtype.kind == "f" else 4, len(a)
        return name(key) + struct.pack(">i", code) + many(n) + raw + b"\0" * (-len(raw) % 4)

    samples = {len(a) for a in arrays.values()}
    if len(samples) > 1:
        raise ValueError("arrays of one file share their first axis")
    dims, ids = [("sample", samples.pop() if samples else 0)], {}
    for key, a in arrays.items():
        ids[key] = [0, *range(len(dims), len(dims) + a.ndim - 1)]
        dims += [(f"{key}_{i}", n) for i, n in enumerate(a.shape[1:])]
    if any(n == 0 for _, n in dims[1:]) or arrays and dims[0][1] == 0:
        raise ValueError("arrays of a file aren't empty")

    def header(begins: list[int]) -> bytes:
        variables = []
        for (key, a), begin in zip(arrays.items(), begins, strict=True):
            held = [attribute(k, v) for k, v in ((attributes or {}).get(key) or {}).items()]
            size = a.nbytes + -a.nbytes % 4
            variables.append(name(key) + many(a.ndim) + b"".join(map(many, ids[key])) + listed(NC_ATTRIBUTE, held) + struct.pack(">i", codes[np.dtype(a.dtype).newbyteorder("=").str]) + (many(size) if wide else struct.pack(">I", min(size, 0xFFFFFFFF))) + struct.pack(">q", begin))
        return b"CDF" + bytes([5 if wide else 2]) + many(0) + listed(NC_DIMENSION, [name(k) + many(n) for k, n in dims]) + listed(NC_ATTRIBUTE, []) + listed(NC_VARIABLE, variables)

    at, begins = len(header([0] * len(arrays))), []
    for a in arrays.values():
        begins.append(at)
        at += a.nbytes + -a.nbytes % 4
    data = [a.astype(a.dtype.newbyteorder(">")).tobytes() for a in arrays.values()]
    return header(begins) + b"".join(d + b"\0" * (-len(d) % 4) for d in data)


def numpy_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A NumPy archive of stored members, so that slices can be read."""
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def listing(path: str) -> list[tuple[str, int]]:
    """Relative paths and sizes of all archives under a folder, by path; hidden and staged ones are left out."""
    fs, root = store(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [(root.rsplit("/", 1)[1], fs.get_file_info(root).size)]
    found = [(f.path.removeprefix(root).lstrip("/"), f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith((".nc", ".npz"))]
    return sorted(f for f in found if not any(p.startswith(("_", ".")) for p in f[0].split("/")))


@dataclass
class Slices(InputPartition):
    """Files of a task, with the positions of each that are wanted."""

    files: list[tuple[str, int, int | None]]


class ArchiveReader(DataSourceReader):
    """Plans tasks from names, sizes and what is wanted; reads slices."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema, self.headers = options["path"], schema, options.get("content") == "headers"
        self.target = int(options.get("target", TARGET))
        asked = {c: options[c].split(",") for c in ("file", "split", "digest") if options.get(c)}
        self.wanted = asked | ({"batch_id": [int(b) for b in options["batch_id"].split(",")]} if options.get("batch_id") else {})
        self.first, self.end = max(0, int(options.get("first", 0))), int(options["end"]) if options.get("end") else None

    def _named(self, file: str) -> dict:
        m = NAME.search(file.rsplit("/", 1)[-1])
        return {"file": file, "split": m and m["split"], "digest": m and m["digest"], "batch_id": int(m["batch"]) if m else None}

    def partitions(self) -> list[Slices]:
        out, held, size = [], [], 0
        fs, root = store(self.path)
        for file, n in listing(self.path):
            named = self._named(file)
            if any(named[c] not in v for c, v in self.wanted.items()) or self.end is not None and self.end <= self.first:
                continue
            pieces = [(self.first, self.end)]
            if n > 2 * self.target and not self.headers:
                # large files are cut at positions by their headers
                _, arrays = opened(fs, self._full(root, file))
                rows = min(max(a.shape[0] for a in arrays.values()), self.end if self.end is not None else 1 << 62)
                cuts = [self.first + (rows - self.first) * i // (n // self.target) for i in range(n // self.target + 1)]
                pieces = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
            for a, b in pieces:
                held.append((file, a, b))
                size += n // len(pieces)
                if size >= self.target:
                    out.append(Slices(held))
                    held, size = [], 0
        return [*out, Slices(held)]

    def _full(self, root: str, file: str) -> str:
        return root if root.endswith((".nc", ".npz")) else f"{root}/{file}"

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, root = store(self.path)
        wanted = to_arrow_schema(self.schema)
        for file, first, end in partition.files:
            read, arrays = opened(fs, self._full(root, file))
            if self.headers:
                rows = [{"file": file, "key": k, "kind": np.dtype(a.kind).newbyteorder("=").str.lstrip("<>=|"), "shape": list(a.shape), "attributes": [(n, v if isinstance(v, str) else json.dumps(v)) for n, v in sorted(a.attributes.items())]} for k, a in arrays.items()]
                yield pa.RecordBatch.from_pylist(rows, schema=wanted)
                continue
            keys = [f.name for f in self.schema.fields[len(PLACE) :]]
            n = max((arrays[k].shape[0] for k in keys if k in arrays), default=max((a.shape[0] for a in arrays.values()), default=0))
            named, stop = self._named(file), n if end is None else min(n, end)
            for lo in range(first, stop, ROWS):
                hi = min(lo + ROWS, stop)
                columns = [pa.array([named[c]] * (hi - lo), wanted.field(c).type) for c, _ in PLACE[:-1]] + [pa.array(np.arange(lo, hi))]
                for key in keys:
                    kind = wanted.field(key).type
                    if key not in arrays or arrays[key].shape[0] < hi:
                        columns.append(pa.nulls(hi - lo, kind))
                        continue
                    values = np.ascontiguousarray(arrays[key].rows(read, lo, hi)).reshape(hi - lo, -1)
                    flat = pa.array(values.astype(values.dtype.newbyteorder("=")).ravel())
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat.cast(kind.value_type)) if pa.types.is_list(kind) else flat.cast(kind))
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


@dataclass
class Staged(WriterCommitMessage):
    """What a task's successful attempt left in the staging folder: its list of files, their number and bytes."""

    attempt: str
    files: int
    size: int


class ArchiveWriter(DataSourceArrowWriter):
    """Two phases: attempts stage files, the commit moves those of the successful ones and writes the manifest."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.shapes, self.attributes = (json.loads(options.get(k) or "{}") for k in ("shapes", "attributes"))
        self.columns = [f.name for f in schema.fields if f.name not in ("file", "pos")]

    @property
    def staging(self) -> str:
        return f"{store(self.path)[1]}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, _ = store(self.path)
        attempt = uuid.uuid4().hex
        listed, total, now, held, done = [], 0, None, [], set()

        def flush():
            nonlocal total
            table = pa.Table.from_batches(held)
            arrays = {}
            for c in self.columns:
                column = table.column(c).combine_chunks()
                if column.null_count:
                    raise ValueError(f"{now}: {c} has nulls")
                nested = pa.types.is_list(column.type)
                values = (column.flatten() if nested else column).to_numpy(zero_copy_only=False)
                arrays[c] = values.reshape(len(table), *(self.shapes.get(c) or [-1])) if nested else values
            raw = numpy_bytes(arrays) if now.endswith(".npz") else netcdf_bytes(arrays, self.attributes)
            target = f"{self.staging}/{attempt}/{now}"
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(target) as out:
                out.write(raw)
            listed.append({"file": now, "samples": len(table), "bytes": len(raw)})
            total += len(raw)

        for batch in iterator:
            names = batch.column("file").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and names[lo] != now:
                    flush()
                    held = []
                if names[lo] != now:
                    if names[lo] in done or names[lo].startswith(("/", "_", ".")) or ".." in names[lo].split("/"):
                        raise ValueError(f"{names[lo]}: rows of a file lie apart, or its name leaves the folder or is hidden")
                    done.add(names[lo])
                now = names[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            flush()
        if listed:
            with fs.open_output_stream(f"{self.staging}/{attempt}/_files") as out:
                out.write("".join(json.dumps(x) + "\n" for x in listed).encode())
        return Staged(attempt, len(listed), total)

    def commit(self, messages: list[Staged | None]) -> None:
        """Lists are read and files moved a task at a time; the manifest grows in the staging folder and appears last."""
        fs, root = store(self.path)
        fs.create_dir(f"{root}/_manifests", recursive=True)
        made: set[str] = set()
        fs.create_dir(self.staging, recursive=True)
        with fs.open_output_stream(f"{self.staging}/_manifest") as manifest, ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is None or not m.files:
                    continue
                with fs.open_input_stream(f"{self.staging}/{m.attempt}/_files") as f:
                    lines = f.read()
                files = [json.loads(line)["file"] for line in lines.splitlines()]
                for folder in {x.rsplit("/", 1)[0] for x in files if "/" in x} - made:
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                list(pool.map(lambda x, m=m: fs.move(f"{self.staging}/{m.attempt}/{x}", f"{root}/{x}"), files))
                manifest.write(lines)
        fs.move(f"{self.staging}/_manifest", f"{root}/_manifests/{self.job}.jsonl")
        fs.delete_dir(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, _ = store(self.path)
        if fs.get_file_info(self.staging).type == pafs.FileType.Directory:
            fs.delete_dir(self.staging)


class Archives(DataSource):
    """``grid_archive``."""

    @classmethod
    def name(cls) -> str:
        return "grid_archive"

    def schema(self) -> T.StructType | str:
        if self.options.get("content") == "headers":
            return HEADERS
        path = self.options["path"]
        fs, root = store(path)
        files = listing(path)
        if not files:
            raise FileNotFoundError(f"no archives in {path}")
        _, arrays = opened(fs, root if root.endswith((".nc", ".npz")) else f"{root}/{files[0][0]}")
        asked = [k for k in self.options.get("keys", "").split(",") if k] or list(arrays)
        kinds = {"f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType()}
        fields = []
        for k in asked:
            one = kinds[np.dtype(arrays[k].kind).str[1:]]
            fields.append((k, one if len(arrays[k].shape) == 1 else T.ArrayType(one)))
        return T.StructType([T.StructField(n, t) for n, t in [*PLACE, *fields]])

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("archives are added, never overwritten")
        return ArchiveWriter(dict(self.options), schema)


def read_archives(spark: SparkSession, path: str, keys: list[str] | None = None, headers: bool = False, **wanted) -> DataFrame:
    """Samples of the archives in a folder, or a row an array with ``headers``; ``wanted`` as the options, lists included."""
    spark.dataSource.register(Archives)
    text = lambda v: ",".join(map(str, v)) if isinstance(v, list | tuple) else str(v)
    options = {"path": path} | ({"keys": ",".join(keys)} if keys else {}) | ({"content": "headers"} if headers else {}) | {k: text(v) for k, v in wanted.items() if v is not None}
    return spark.read.format("grid_archive").options(**options).load()


def write_archives(samples: DataFrame, path: str, shapes: dict[str, list[int]] | None = None) -> None:
    """Write rows of ``file``, ``pos`` and arrays as archives, a file whole in one task; column metadata become attributes.

    Files are dealt by name among all tasks; files of other runs stay, one of the same name is replaced.
    """
    samples.sparkSession.dataSource.register(Archives)
    attributes = {f.name: f.metadata for f in samples.schema.fields if f.metadata}
    dealt = samples.repartition("file").sortWithinPartitions("file", "pos")
    dealt.write.format("grid_archive").options(path=path, shapes=json.dumps(shapes or {}), attributes=json.dumps(attributes)).mode("append").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, samples and bytes of everything that was committed."""
    return spark.read.schema("file string, samples long, bytes long").json(f"{path.rstrip('/')}/_manifests", pathGlobFilter="*.jsonl")


def archive_name(split: Column, digest: Column, batch: Column, suffix: str = "nc") -> Column:
    """``{split}_{digest}_{00000000}.nc``."""
    return F.concat(F.concat_ws("_", split, digest, zero_filled(batch)), F.lit(f".{suffix}"))
