"""Binary arrays as a Spark data source: byte ranges read by many tasks, parts written and published at once.

Layouts: points (raw little-endian float32 x, y, z), array (.npy), bundle (a member of an .npz) and matrix (compressed rows
in an .npz: indptr, indices, data; with rows, their numbers where they are far apart). A path is a file or a folder of parts that the sink wrote. Files are opened where the
tasks run by Arrow's file systems: local or mounted folders and the object stores that Arrow knows.

Reading: a partition is a range of values of any length and offset, cut after the header is read, and passes blocks of a
megabyte on. The archive's directory tells where members of a bundle begin: stored members are read by range like files, a
matrix at a range of its entries finds its first row by bisection in indptr; deflated members have no places to start from,
so one task streams each, a block at a time. Only columns of the given schema are made.

Writing: each task writes files of its own in a folder beside the path; the commit compares their sizes with the rows that
were counted, removes what failed attempts left, and renames the folder to the path, which must not exist.
"""

from __future__ import annotations

import ast
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import require

#: Bytes of a block that a task holds, of a partition's range, and rows and bytes of columns of a part file, at most. A
#: writing task holds a part several times: as batches, as arrays, and compressed.
BLOCK, RANGE, PART_ROWS, PART_BYTES = 1 << 20, 64 << 20, 1 << 20, 8 << 20
#: Rows for each entry that a part of a matrix points to at most; of rows further apart it keeps the numbers of those with entries.
SPARSE = 4

SCHEMAS = {
    "points": "id long, x float, y float, z float",
    "array": "row long, col long, value double",
    "bundle": "row long, col long, value double",
    "matrix": "src long, dst long, w double",
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def array_header(head: bytes) -> tuple[int, np.dtype, bool, tuple[int, ...]]:
    """Of a .npy file: where its data begin, their type, whether columns come first, and their shape."""
    require(head[:6] == b"\x93NUMPY", "not a .npy file")
    wide = 4 if head[6] > 1 else 2
    begin = 8 + wide + int.from_bytes(head[8 : 8 + wide], "little")
    found = ast.literal_eval(head[8 + wide : begin].decode("latin1"))
    kind = np.dtype(found["descr"])
    require(len(found["shape"]) in (1, 2) and kind.kind in "iufb", f"an array of {kind} and shape {found['shape']} is no table of numbers")
    return begin, kind, found["fortran_order"], found["shape"]


@dataclass
class Values:
    """Numbers in a file: from a byte on, so many of a type; deflated members count from their member's beginning."""

    path: str
    begin: int
    kind: str
    count: int
    shape: tuple[int, ...]
    by_column: bool = False
    deflated_at: int | None = None

    def read(self, start: int, end: int) -> Iterator[np.ndarray]:
        """Values start to end, in blocks."""
        kind = np.dtype(self.kind)
        size = max(1, BLOCK // kind.itemsize)
        system, path = opened(self.path)
        if self.deflated_at is not None:
            yield from self.inflated(system, path, start, end, size)
            return
        with system.open_input_file(path) as file:
            for at in range(start, end, size):
                n = min(size, end - at)
                content = file.read_at(n * kind.itemsize, self.begin + at * kind.itemsize)
                require(len(content) == n * kind.itemsize, f"{self.path} ends early")
                yield np.frombuffer(content, kind)

    def inflated(self, system: fs.FileSystem, path: str, start: int, end: int, size: int) -> Iterator[np.ndarray]:
        kind, held, skip, at = np.dtype(self.kind), b"", self.begin, 0
        engine = zlib.decompressobj(-15)
        with system.open_input_stream(path) as file:
            ahead = self.deflated_at
            while ahead and (passed := len(file.read(min(ahead, BLOCK)))):
                ahead -= passed
            while at < end and not engine.eof and (content := engine.unconsumed_tail or file.read(BLOCK // 4)):
                fresh = engine.decompress(content, BLOCK)
                drop = min(skip, len(fresh))
                skip -= drop
                held += fresh[drop:]
                n = len(held) // kind.itemsize
                block = np.frombuffer(held[: n * kind.itemsize], kind)
                held = held[n * kind.itemsize :]
                low, high = max(start - at, 0), min(end - at, n)
                if low < high:
                    yield block[low:high]
                at += n
        require(at >= end, f"{self.path} ends early")


def npy_values(path: str) -> Values:
    system, name = opened(path)
    with system.open_input_file(name) as file:
        begin, kind, by_column, shape = array_header(file.read_at(min(1 << 16, file.size()), 0))
        count = int(np.prod(shape))
        require(file.size() == begin + count * kind.itemsize, f"{path} has {file.size()} bytes, not {begin + count * kind.itemsize}")
    return Values(path, begin, kind.str, count, shape, by_column)


def members(path: str) -> dict[str, Values]:
    """The arrays of a bundle by name, from the archive's directory and the head of each member."""
    system, name = opened(path)
    out = {}
    with system.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            with archive.open(info) as member:
                begin, kind, by_column, shape = array_header(member.read(1 << 12))
            local = file.read_at(30, info.header_offset)
            data = info.header_offset + 30 + sum(struct.unpack("<HH", local[26:30]))
            require(info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED), f"{info.filename} is neither stored nor deflated")
            stored = info.compress_type == zipfile.ZIP_STORED
            out[info.filename.removesuffix(".npy")] = Values(path, begin + (data if stored else 0), kind.str, int(np.prod(shape)), shape, by_column, None if stored else data)
    return out


def files_of(path: str, suffix: str) -> list[str]:
    """The file, or the parts of a folder in their order."""
    system, name = opened(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(suffix))
    return [f"{path.rstrip('/')}/{f}" for f in found]


@dataclass
class Piece(InputPartition):
    """Values start to end of some arrays; first is the number of the file's first row among all files."""

    arrays: dict[str, Values]
    start: int
    end: int
    first: int

    def __init__(self, arrays: dict[str, Values], start: int, end: int, first: int) -> None:
        super().__init__(0)
        self.arrays, self.start, self.end, self.first = arrays, start, end, first


def ranges(count: int, size: int, whole: bool) -> list[tuple[int, int]]:
    step = count if whole else max(1, RANGE // size)
    return [(a, min(a + step, count)) for a in range(0, count, max(step, 1))]


class ArrayReader(DataSourceReader):
    def __init__(self, layout: str, path: str, member: str | None, columns: list[str]) -> None:
        self.layout, self.path, self.member, self.columns = layout, path, member, columns

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for path in files_of(self.path, {"points": ".bin", "array": ".npy", "bundle": ".npz", "matrix": ".npz"}[self.layout]):
            if self.layout == "points":
                system, name = opened(path)
                size = system.get_file_info(name).size
                require(size % 12 == 0, f"{path} has {size} bytes, no multiple of 12")
                arrays, count, rows, unit, whole = {"xyz": Values(path, 0, "<f4", size // 4, (size // 12, 3))}, size // 12, size // 12, 12, False
            elif self.layout == "matrix":
                arrays = members(path)
                lacking = {"indptr", "indices", "data"} - set(arrays)
                require(not lacking, f"{path} lacks {sorted(lacking)}")
                whole = any(a.deflated_at is not None for a in arrays.values())
                count, rows, unit = arrays["indices"].count, arrays["indptr"].count - 1, 12
                if "first" in arrays:  # a part, which knows its first row
                    first = int(next(arrays["first"].read(0, 1))[0])
                first = 0 if "rows" in arrays else first  # or the number of each
            else:
                found = npy_values(path) if self.layout == "array" else members(path)[self.member]
                arrays, count, rows, unit, whole = {"value": found}, found.count, found.shape[0], np.dtype(found.kind).itemsize, found.deflated_at is not None
            out += [Piece(arrays, a, b, first) for a, b in ranges(count, unit, whole)]
            first += rows
        return out or [Piece({}, 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.start < partition.end:
            for found in {"points": self.points, "array": self.values, "bundle": self.values, "matrix": self.entries}[self.layout](partition):
                made = {n: make for n, make in found.items() if n in self.columns}
                yield pa.RecordBatch.from_arrays([pa.array(made[c]()) for c in self.columns], names=self.columns)

    def points(self, piece: Piece) -> Iterator[dict[str, Callable]]:
        at = piece.first + piece.start
        held = np.zeros(0, "<f4")
        for block in piece.arrays["xyz"].read(3 * piece.start, 3 * piece.end):
            held = np.concatenate([held, block])
            n = len(held) // 3
            xyz, held, here = held[: 3 * n].reshape(-1, 3), held[3 * n :], at
            at += n
            yield {"id": lambda: here + np.arange(n), **{c: (lambda i=i: np.ascontiguousarray(xyz[:, i])) for i, c in enumerate("xyz")}}

    def values(self, piece: Piece) -> Iterator[dict[str, Callable]]:
        found = piece.arrays["value"]
        rows, cols = (*found.shape, 1)[:2]
        at = piece.start
        for block in found.read(piece.start, piece.end):
            places, value = at + np.arange(len(block)), block
            at += len(block)
            row, col = (places % rows, places // rows) if found.by_column else (places // cols, places % cols)
            yield {"row": lambda: row + piece.first, "col": lambda: col, "value": lambda: value.astype(float)}

    def entries(self, piece: Piece) -> Iterator[dict[str, Callable]]:
        """Entries of compressed rows with their row: the first is found by bisection, the others as indptr goes on."""
        pointers, rows = piece.arrays["indptr"], piece.arrays["indptr"].count - 1
        low, high = 0, rows - 1
        if pointers.deflated_at is None:
            while low < high:  # the last row that begins at or before start
                middle = (low + high + 1) // 2
                if int(next(pointers.read(middle, middle + 1))[0]) <= piece.start:
                    low = middle
                else:
                    high = middle - 1
        ahead = pointers.read(low, rows + 1)
        begins, row = next(ahead).astype(np.int64), low  # begins[i] is where row + i begins
        at = piece.start
        for columns, values in paired(piece.arrays["indices"].read(piece.start, piece.end), piece.arrays["data"].read(piece.start, piece.end)):
            done = 0
            while done < len(columns):
                while begins[-1] <= at and (more := next(ahead, None)) is not None:  # this stretch of rows is over
                    row, begins = row + len(begins) - 1, np.concatenate([begins[-1:], more.astype(np.int64)])
                upto = min(len(columns), done + int(begins[-1]) - at) if begins[-1] > at else len(columns)
                own = row + np.searchsorted(begins, np.arange(at, at + upto - done), "right") - 1
                part = slice(done, upto)
                at += upto - done
                done = upto
                number = own + piece.first
                if "rows" in piece.arrays:
                    number = np.concatenate(list(piece.arrays["rows"].read(int(own[0]), int(own[-1]) + 1)))[own - own[0]]
                yield {"src": lambda: number, "dst": lambda: columns[part].astype(np.int64), "w": lambda: values[part].astype(float)}


def paired(a: Iterator[np.ndarray], b: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of both with as many values each."""
    x, y = np.zeros(0), np.zeros(0)
    while True:
        if not len(x) and (x := next(a, None)) is None:
            return
        if not len(y):
            y = next(b)
        n = min(len(x), len(y))
        yield x[:n], y[:n]
        x, y = x[n:], y[n:]


@dataclass
class Written(WriterCommitMessage):
    """Files of a task with their rows and bytes."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, layout: str, path: str, compress: bool) -> None:
        self.layout, self.path, self.compress = layout, path.rstrip("/"), compress
        system, name = opened(self.path)
        require(system.get_file_info(name).type == fs.FileType.NotFound, f"{path} is there already")
        self.folder = f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context, system_of = TaskContext.get(), opened(self.folder)
        out, system, folder = Written(), *system_of
        system.create_dir(folder, recursive=True)
        stem = f"part-{context.partitionId():06d}"
        suffix = {"points": "bin", "array": "npy", "bundle": "npz", "matrix": "npz"}[self.layout]
        for k, rows in enumerate(in_parts(iterator)):
            name = f"{stem}-{k:05d}-{context.taskAttemptId()}.{suffix}"
            size = self.put(system, f"{folder}/{name}", rows)
            out.files.append((name, rows.num_rows, size))
        return out

    def put(self, system: fs.FileSystem, name: str, rows: pa.RecordBatch) -> int:
        """Writes rows to a file; returns the bytes that it must have."""
        with system.open_output_stream(name) as file:
            if self.layout == "points":
                content = np.stack([rows[c].to_numpy(zero_copy_only=False) for c in "xyz"], axis=1).astype("<f4").tobytes()
                file.write(content)
                return 12 * rows.num_rows
            if self.layout == "array":
                table = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.columns], axis=1)
                np.lib.format.write_array(file, np.ascontiguousarray(table), allow_pickle=False)
                return file.tell()
            arrays = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(rows.schema.names, rows.columns, strict=True)}
            if self.layout == "matrix":
                src = arrays["src"]
                require(bool((np.diff(src) >= 0).all()), "entries of a matrix must be sorted by row within their partitions")
                first, n = (int(src[0]), int(src[-1]) - int(src[0]) + 1) if len(src) else (0, 0)
                if n <= SPARSE * len(src):
                    rows_of = {"first": np.array([first]), "indptr": np.searchsorted(src, first + np.arange(n + 1))}
                else:
                    numbers, begins = np.unique(src, return_index=True)
                    rows_of = {"rows": numbers, "indptr": np.append(begins, len(src))}
                arrays = rows_of | {"indices": arrays["dst"], "data": arrays["w"]}
            (np.savez_compressed if self.compress else np.savez)(file, **arrays)
            return file.tell()

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        wanted = {name: (rows, size) for m in messages if m for name, rows, size in m.files}
        there = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(folder))}
        for name, (_, size) in wanted.items():
            require(there.get(name) == size, f"{name} has {there.get(name)} bytes, not {size}")
        for name in set(there) - set(wanted):  # of attempts that failed or were not needed
            system.delete_file(f"{folder}/{name}")
        with system.open_output_stream(f"{folder}/_rows.json") as file:
            file.write(json.dumps({n: r for n, (r, _) in sorted(wanted.items())}).encode())
        target = opened(self.path)[1]
        require(system.get_file_info(target).type == fs.FileType.NotFound, f"{self.path} was written meanwhile")
        system.move(folder, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in parts of PART_ROWS, or of fewer that take PART_BYTES."""
    held, n, most = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            most = most or max(1, min(PART_ROWS, PART_BYTES * batch.num_rows // max(1, batch.nbytes)))
            take = batch.slice(0, most - n)
            held.append(take)
            n, batch = n + take.num_rows, batch.slice(take.num_rows)
            if n == most:
                part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
                yield part
                del part, take
                pa.default_memory_pool().release_unused()
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class ArraySource(DataSource):
    """Options: path, layout, for bundles member, for writing compress (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "perigraph_array"

    def schema(self) -> str:
        return SCHEMAS[self.options["layout"]]

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["layout"], self.options["path"], self.options.get("member"), [f.name for f in schema])

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        require(not overwrite, "arrays are not overwritten")
        return ArrayWriter(self.options["layout"], self.options["path"], self.options.get("compress", "false") == "true")


def read_layout(spark: SparkSession, layout: str, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(ArraySource)
    kinds = dict(c.split() for c in SCHEMAS[layout].split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("perigraph_array").schema(schema).options(layout=layout, **options).load(path)


def write_layout(df: DataFrame, layout: str, path: str, **options: str) -> None:
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("perigraph_array").mode("append").options(layout=layout, **options).save(path)


def read_points(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """id (row number), x, y, z of a raw little-endian float32 table of any size."""
    return read_layout(spark, "points", path, columns)


def read_array(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """row, col, value of a one- or two-dimensional .npy file of numbers, of any size."""
    return read_layout(spark, "array", path, columns)


def read_bundle(spark: SparkSession, path: str, member: str, columns: list[str] | None = None) -> DataFrame:
    """row, col, value of a member of an .npz bundle, of any size: in ranges if stored, as one stream if deflated."""
    return read_layout(spark, "bundle", path, columns, member=member)


def read_sparse_matrix(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """src, dst, w of a compressed-row matrix in an .npz bundle (indptr, indices, data), in ranges of entries if stored."""
    return read_layout(spark, "matrix", path, columns)


def write_points(df: DataFrame, path: str) -> None:
    """x, y, z by order of id as raw float32 parts."""
    write_layout(df.repartitionByRange("id").sortWithinPartitions("id").select("x", "y", "z"), "points", path)


def write_array(df: DataFrame, path: str, order: list[str], columns: list[str]) -> None:
    """A row for each row, by order, and a column for each of columns (of one type) as .npy parts."""
    write_layout(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns), "array", path)


def write_bundle(df: DataFrame, path: str, order: list[str], compress: bool = True) -> None:
    """A member for each column, rows by order, as .npz parts."""
    write_layout(df.repartitionByRange(*order).sortWithinPartitions(*order), "bundle", path, compress=str(compress).lower())


def write_sparse_matrix(edges: DataFrame, path: str, compress: bool = False) -> None:
    """src, dst, w as parts of compressed rows, by src and dst; where src leaves gaps, a part keeps the numbers of its rows."""
    rows = edges.select("src", "dst", "w").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    write_layout(rows, "matrix", path, compress=str(compress).lower())


def unfinished(path: str) -> list[str]:
    """Folders that writes to path left when they were killed."""
    system, name = opened(path.rstrip("/"))
    parent, _, base = name.rpartition("/")
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(parent)) if f.base_name.startswith(f"{base}.writing-"))


def remove_unfinished(path: str) -> int:
    found = unfinished(path)
    for folder in found:
        opened(path)[0].delete_dir(folder)
    return len(found)
