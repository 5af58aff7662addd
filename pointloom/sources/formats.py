"""Point-cloud and mesh files as Spark data sources: ply, pcd and stl.

    register(spark)
    spark.read.format("ply").load(path)                      # points
    spark.read.format("ply").option("element", "face").load(path)
    spark.read.format("stl").option("element", "triangle").load(path)
    df.write.format("ply").mode("overwrite").save(path)

Headers give the schema; fixed-width binary bodies are read in parallel by
record ranges. Rows get their ordinal in the file as pid (fid for faces). Tasks
write bodies beside the target, the commit joins them in partition order under
one header, so sort by pid first where order matters.
"""

from __future__ import annotations

import io
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
RENAMED = {"red": "r", "green": "g", "blue": "b", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}
#: Records per partition of a fixed-width body.
SPLIT = 1 << 20


def placed(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: a plain path, or a URI of
    any file system that Arrow knows (file, hdfs, s3, gs, abfs)."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def opened(path: str) -> io.BufferedReader:
    files, at = placed(path)
    return io.BufferedReader(files.open_input_file(at))


def moved(source: str, target: str) -> None:
    """Put a finished file in the place of another."""
    files, at = placed(target)
    if files.get_file_info(at).type == pafs.FileType.File and not isinstance(files, pafs.LocalFileSystem):
        files.delete_file(at)  # not every file system replaces
    files.move(placed(source)[1], at)


def size_of(path: str) -> int:
    """Bytes of a file; it has to exist."""
    files, at = placed(path)
    info = files.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def spark_type(code: str) -> T.DataType:
    kind, width = code[0], int(code[1:])
    if kind == "f":
        return T.FloatType() if width == 4 else T.DoubleType()
    return T.LongType() if width == 8 or code == "u4" else T.IntegerType() if width == 4 or code == "u2" else T.ShortType()


@dataclass
class Layout:
    """Where a body of records is and what they hold."""

    path: str
    fields: list[tuple[str, str, int]]  # name, numpy code, channels
    count: int
    offset: int
    text: bool
    order: str = "<"
    swizzled: bool = False
    skip: int = 0  # text lines of the body before the first record

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, self.order + c, (k,)) if k > 1 else (n, self.order + c) for n, c, k in self.fields])

    def schema(self, key: str = "pid") -> T.StructType:
        out = T.StructType().add(key, T.LongType(), False)
        for n, c, k in self.fields:
            kind = T.DoubleType() if n in ("x", "y", "z") else spark_type(c)
            out = out.add(RENAMED.get(n, n), T.ArrayType(kind) if k > 1 else kind)
        return out


def ply_header(path: str) -> tuple[str, list[tuple[str, int, list]], int]:
    """Format, elements (name, count, properties) and the body's offset."""
    size_of(path)
    elements: list[tuple[str, int, list]] = []
    with opened(path) as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"not a PLY file: {path}")
        form = ""
        for raw in f:
            word = raw.decode("ascii", "replace").split()
            if not word or word[0] in ("comment", "obj_info"):
                continue
            if word[0] == "format":
                form = word[1]
            elif word[0] == "element":
                elements.append((word[1], int(word[2]), []))
            elif word[0] == "property":
                elements[-1][2].append(("list", PLY_TYPES[word[2]], PLY_TYPES[word[3]], word[4]) if word[1] == "list" else (PLY_TYPES[word[1]], word[2]))
            elif word[0] == "end_header":
                return form, elements, f.tell()
    raise ValueError(f"header without end: {path}")


def ply_vertices(path: str) -> Layout:
    form, elements, offset = ply_header(path)
    order = ">" if "big" in form else "<"
    skip = 0
    for name, count, props in elements:
        if name == "vertex":
            fields = [(p[1], p[0], 1) for p in props if p[0] != "list"]
            if len(fields) != len(props):
                raise ValueError("vertices with list properties")
            return Layout(path, fields, count, offset, form == "ascii", order, skip=skip)
        if form == "ascii":
            skip += count
        elif any(p[0] == "list" for p in props):
            raise ValueError("vertices after an element of lists")
        else:
            offset += count * sum(np.dtype(p[0]).itemsize for p in props)
    return Layout(path, [("x", "f8", 1), ("y", "f8", 1), ("z", "f8", 1)], 0, offset, True)


def ply_faces(path: str) -> Iterator[list[int]]:
    """Corner lists of the face element, in order."""
    form, elements, offset = ply_header(path)
    with opened(path) as f:
        f.seek(offset)
        order = ">" if "big" in form else "<"
        for name, count, props in elements:
            for _ in range(count):
                corners: list[int] = []
                words = f.readline().split() if form == "ascii" else None
                at = 0
                for p in props:
                    if words is not None:
                        n = int(words[at]) if p[0] == "list" else 1
                        values = words[at + (p[0] == "list") : at + (p[0] == "list") + n]
                        at += n + (p[0] == "list")
                    elif p[0] == "list":
                        n = int(np.frombuffer(f.read(np.dtype(p[1]).itemsize), order + p[1])[0])
                        values = np.frombuffer(f.read(n * np.dtype(p[2]).itemsize), order + p[2])
                    else:
                        f.read(np.dtype(p[0]).itemsize)
                        continue
                    if name == "face" and p[0] == "list" and p[3] in ("vertex_indices", "vertex_index"):
                        corners = [int(v) for v in values]
                if name == "face":
                    yield corners


def pcd_layout(path: str) -> Layout:
    size_of(path)
    head: dict[str, list[str]] = {}
    with opened(path) as f:
        for raw in f:
            word = raw.decode("ascii", "replace").split()
            if word and word[0] != "#":
                head[word[0]] = word[1:]
            if word and word[0] == "DATA":
                offset = f.tell()
                break
        else:
            raise ValueError(f"not a PCD file: {path}")
    count = head.get("COUNT", ["1"] * len(head["FIELDS"]))
    fields = [(n, {"F": "f", "I": "i", "U": "u"}[t] + s, int(c)) for n, t, s, c in zip(head["FIELDS"], head["TYPE"], head["SIZE"], count)]
    kind = head["DATA"][0]
    if kind not in ("ascii", "binary"):
        raise ValueError(f"PCD data {kind} is not supported")
    points = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    return Layout(path, fields, points, offset, kind == "ascii")


def stl_is_text(path: str) -> bool:
    """Text starts with solid; a binary file that does too has the size its
    count of faces demands."""
    size = size_of(path)
    with opened(path) as f:
        head = f.read(84)
    if len(head) == 84 and size == 84 + 50 * struct.unpack("<I", head[80:])[0]:
        return False
    return head[:5] == b"solid"


class Range(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class RecordReader(DataSourceReader):
    """Reads a Layout in ranges of records."""

    def __init__(self, layout: Layout, schema: T.StructType) -> None:
        self.layout, self.schema = layout, schema

    def partitions(self) -> list[Range]:
        n = self.layout.count
        if self.layout.text or n == 0:
            return [Range(0, n)]
        return [Range(a, min(a + SPLIT, n)) for a in range(0, n, SPLIT)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        lay = self.layout
        arrow = _arrow(self.schema)
        if lay.text:
            with opened(lay.path) as f:
                f.seek(lay.offset)
                lines = (x for x in f if x.strip())
                for _ in range(lay.skip):
                    next(lines)
                rows, at = [], 0
                for line in lines:
                    if at + len(rows) >= lay.count:
                        break
                    rows.append(line.split())
                    if len(rows) == 65536:
                        yield self._batch(self._parsed(rows), at, arrow)
                        at, rows = at + len(rows), []
                if rows:
                    yield self._batch(self._parsed(rows), at, arrow)
            return
        with opened(lay.path) as f:
            width = lay.dtype.itemsize
            for a in range(partition.start, partition.stop, 65536):
                n = min(65536, partition.stop - a)
                f.seek(lay.offset + a * width)
                yield self._batch(np.frombuffer(f.read(n * width), lay.dtype, n), a, arrow)

    def _parsed(self, rows: list[list[bytes]]) -> np.ndarray:
        out = np.zeros(len(rows), self.layout.dtype)
        at = 0
        for n, c, k in self.layout.fields:
            cast = float if c[0] == "f" else int
            out[n] = [cast(r[at]) for r in rows] if k == 1 else [[cast(v) for v in r[at : at + k]] for r in rows]
            at += k
        return out

    def _batch(self, records: np.ndarray, first: int, arrow: pa.Schema) -> pa.RecordBatch:
        columns = []
        back = {RENAMED.get(n, n): n for n, _, _ in self.layout.fields}
        for field in arrow:
            if field.name == "pid":
                columns.append(pa.array(np.arange(first, first + len(records)), pa.int64()))
                continue
            v = records[back[field.name]]
            v = v.astype(v.dtype.newbyteorder("="))
            columns.append(pa.array(list(v), field.type) if v.ndim > 1 else pa.array(v).cast(field.type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


FACE_SCHEMA = "fid bigint, i0 bigint, i1 bigint, i2 bigint"
CORNERS = [f"{c}{a}" for c in "abc" for a in "xyz"]
TRIANGLE_SCHEMA = "fid bigint, " + ", ".join(f"{c} double" for c in CORNERS)


def ply_triangles(path: str) -> Layout | None:
    """Where the faces are, if all records have the width of triangles."""
    form, elements, offset = ply_header(path)
    for name, count, props in elements:
        if form == "ascii" or (name != "face" and any(p[0] == "list" for p in props)):
            return None
        if name == "face":
            if [p[3] for p in props if p[0] == "list"] not in (["vertex_indices"], ["vertex_index"]):
                return None
            fields = []
            for k, p in enumerate(props):
                fields += [("n", p[1], 1), ("i", p[2], 3)] if p[0] == "list" else [(f"_{k}", p[0], 1)]
            found = Layout(path, fields, count, offset, False, ">" if "big" in form else "<")
            return found if name == elements[-1][0] and size_of(path) == offset + count * found.dtype.itemsize else None
        offset += count * sum(np.dtype(p[0]).itemsize for p in props)
    return None


def _columns(schema: T.StructType, columns: list[np.ndarray]) -> pa.RecordBatch:
    arrow = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)


class PlyFaceReader(DataSourceReader):
    """Faces as triangles; polygons become fans. Bodies of triangles are read by
    ranges, others by one task."""

    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema, self.layout = path, schema, ply_triangles(path)

    def partitions(self) -> list[Range]:
        n = self.layout.count if self.layout else 0
        return [Range(a, min(a + SPLIT, n)) for a in range(0, n, SPLIT)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple | pa.RecordBatch]:
        if self.layout:
            lay = self.layout
            with opened(self.path) as f:
                for a in range(partition.start, partition.stop, 65536):
                    n = min(65536, partition.stop - a)
                    f.seek(lay.offset + a * lay.dtype.itemsize)
                    rec = np.frombuffer(f.read(n * lay.dtype.itemsize), lay.dtype, n)
                    if (rec["n"] != 3).any():
                        raise ValueError(f"faces of two corners or fewer: {self.path}")
                    yield _columns(self.schema, [np.arange(a, a + n), *rec["i"].astype(np.int64).T])
            return
        fid = 0
        for c in ply_faces(self.path):
            for k in range(1, len(c) - 1):
                yield fid, c[0], c[k], c[k + 1]
                fid += 1


class StlReader(DataSourceReader):
    """Triangles, or the corners as vertices (3 * fid + corner) or faces."""

    record = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("attr", "<u2")])

    def __init__(self, path: str, element: str, schema: T.StructType) -> None:
        self.path, self.element, self.schema = path, element, schema
        self.text = stl_is_text(path)

    def partitions(self) -> list[Range]:
        if self.text:
            return [Range(0, 0)]
        n = (size_of(self.path) - 84) // 50
        return [Range(a, min(a + SPLIT, n)) for a in range(0, n, SPLIT)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.text:
            corners: list[list[float]] = []
            with io.TextIOWrapper(opened(self.path), encoding="ascii", errors="replace") as f:
                for line in f:
                    word = line.split()
                    if word[:1] == ["vertex"]:
                        corners.append([float(x) for x in word[1:4]])
            yield self._batch(np.array(corners, float).reshape(-1, 3, 3), 0)
            return
        with opened(self.path) as f:
            f.seek(84 + 50 * partition.start)
            for a in range(partition.start, partition.stop, 65536):
                n = min(65536, partition.stop - a)
                yield self._batch(np.frombuffer(f.read(50 * n), self.record, n)["v"].astype(float), a)

    def _batch(self, v: np.ndarray, first: int) -> pa.RecordBatch:
        fid = np.arange(first, first + len(v))
        if self.element == "triangle":
            return _columns(self.schema, [fid, *v.reshape(len(v), 9).T])
        if self.element == "face":
            return _columns(self.schema, [fid, 3 * fid, 3 * fid + 1, 3 * fid + 2])
        return _columns(self.schema, [np.arange(3 * first, 3 * (first + len(v))), *v.reshape(-1, 3).T])


@dataclass
class Body(WriterCommitMessage):
    path: str
    count: int


class BodyWriter(DataSourceArrowWriter):
    """Each task writes its rows in a folder beside the target; the commit puts
    them together in partition order."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.parts = f"{path}._parts_{uuid.uuid4().hex[:8]}"
        files, at = placed(path)
        if "/" in at.rstrip("/"):
            files.create_dir(at.rpartition("/")[0], recursive=True)
        if files.get_file_info(at).type != pafs.FileType.NotFound and not overwrite:
            raise FileExistsError(path)

    names = {v: k for k, v in RENAMED.items()}

    def columns(self) -> list[tuple[str, str, int]]:
        """Numeric columns: (name, numpy code, channels); an array has as many
        channels as its first row."""
        code = {"double": "f8", "float": "f4", "integer": "i4", "long": "i8", "short": "i2", "byte": "i1"}
        out = []
        for f in self.schema.fields:
            kind = f.dataType.typeName()
            if f.name not in ("pid", "fid", "vid") and kind in code:
                out.append((f.name, code[kind], 1))
        return out

    def write(self, batches: Iterator[pa.RecordBatch]) -> Body:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, folder = placed(self.parts)
        files.create_dir(folder, recursive=True)
        part = f"{self.parts}/{context.partitionId():08d}-{context.attemptNumber()}"
        count = 0
        with files.open_output_stream(placed(part)[1]) as f:
            for batch in batches:
                f.write(self.encode(batch))
                count += len(batch)
        return Body(part, count)

    def records(self, batch: pa.RecordBatch, columns: list[tuple[str, str, int]]) -> np.ndarray:
        """Rows as packed records; a null is 0, or NaN in floats."""
        out = np.zeros(len(batch), np.dtype([(n, "<" + c) for n, c, _ in columns]))
        for n, c, _ in columns:
            v = batch.column(batch.schema.get_field_index(n))
            out[n] = np.asarray(v.fill_null(float("nan") if c[0] == "f" else 0))
        return out

    def commit(self, messages: list[Body | None]) -> None:
        bodies = sorted((m for m in messages if m), key=lambda m: m.path)
        done = f"{self.parts}.whole"
        with placed(done)[0].open_output_stream(placed(done)[1]) as out:
            out.write(self.header(sum(b.count for b in bodies)))
            for b in bodies:
                with opened(b.path) as f:
                    shutil.copyfileobj(f, out, 1 << 24)
            out.write(self.footer())
        moved(done, self.path)
        self.abort(messages)

    def abort(self, messages: list[Body | None]) -> None:
        files, folder = placed(self.parts)
        if files.get_file_info(folder).type == pafs.FileType.Directory:
            files.delete_dir(folder)

    def header(self, count: int) -> bytes:
        raise NotImplementedError

    def footer(self) -> bytes:
        return b""

    def encode(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError


class PlyWriter(BodyWriter):
    text = False

    def columns(self) -> list[tuple[str, str, int]]:
        # PLY has no 64-bit integers
        return [(n, "i4" if c == "i8" else c, k) for n, c, k in super().columns()]

    def header(self, count: int) -> bytes:
        word = {"f8": "double", "f4": "float", "i4": "int", "i2": "short", "i1": "char"}
        lines = ["ply", f"format {'ascii' if self.text else 'binary_little_endian'} 1.0", f"element vertex {count}"]
        lines += [f"property {word[c]} {self.names.get(n, n)}" for n, c, _ in self.columns()]
        return ("\n".join([*lines, "end_header"]) + "\n").encode()

    def encode(self, batch: pa.RecordBatch) -> bytes:
        out = self.records(batch, self.columns())
        return "".join(" ".join(map(repr, r)) + "\n" for r in out.tolist()).encode() if self.text else out.tobytes()


class PcdWriter(BodyWriter):
    text = False

    def header(self, count: int) -> bytes:
        c = self.columns()
        lines = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(n for n, _, _ in c), "SIZE " + " ".join(k[1:] for _, k, _ in c), "TYPE " + " ".join(k[0].upper() for _, k, _ in c), "COUNT " + " ".join("1" for _ in c), f"WIDTH {count}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {count}", f"DATA {'ascii' if self.text else 'binary'}"]
        return ("\n".join(lines) + "\n").encode()

    encode = PlyWriter.encode


class StlWriter(BodyWriter):
    """Rows of TRIANGLE_SCHEMA as binary STL; normals follow the corners."""

    def header(self, count: int) -> bytes:
        return b"binary triangles".ljust(80, b" ") + struct.pack("<I", count)

    def encode(self, batch: pa.RecordBatch) -> bytes:
        out = np.zeros(len(batch), StlReader.record)
        if len(batch):
            v = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c)), float) for c in CORNERS], 1).reshape(-1, 3, 3)
            n = np.cross(v[:, 1] - v[:, 0], v[:, 2] - v[:, 0])
            size = np.linalg.norm(n, axis=1, keepdims=True)
            out["v"], out["n"] = v, n / np.where(size > 0, size, 1)
        return out.tobytes()


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    @property
    def path(self) -> str:
        return self.options["path"]

    def schema(self) -> T.StructType | str:
        return FACE_SCHEMA if self.options.get("element") == "face" else ply_vertices(self.path).schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PlyFaceReader(self.path, schema) if self.options.get("element") == "face" else RecordReader(ply_vertices(self.path), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        out = PlyWriter(self.path, schema, overwrite)
        out.text = self.options.get("ascii", "false").lower() == "true"
        return out


class PcdSource(PlySource):
    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> T.StructType | str:
        return pcd_layout(self.path).schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordReader(pcd_layout(self.path), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        out = PcdWriter(self.path, schema, overwrite)
        out.text = self.options.get("ascii", "false").lower() == "true"
        return out


class StlSource(PlySource):
    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> T.StructType | str:
        stl_is_text(self.path)
        return {"triangle": TRIANGLE_SCHEMA, "face": FACE_SCHEMA}.get(self.options.get("element", "triangle"), "vid bigint, x double, y double, z double")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return StlReader(self.path, self.options.get("element", "triangle"), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return StlWriter(self.path, schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (PlySource, PcdSource, StlSource):
        spark.dataSource.register(source)


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """A cloud by its extension: ply, pcd, or parquet for anything else."""
    register(spark)
    kind = path.rpartition(".")[2].lower()
    return spark.read.format(kind if kind in ("ply", "pcd") else "parquet").load(path)


def write_cloud(cloud: DataFrame, path: str, ordered: bool = True) -> None:
    """Write by extension, in the order of pid."""
    register(cloud.sparkSession)
    kind = path.rpartition(".")[2].lower()
    (cloud.sort("pid") if ordered and "pid" in cloud.columns else cloud).write.format(kind if kind in ("ply", "pcd") else "parquet").mode("overwrite").save(path)


def write_both(cloud: DataFrame, path: str) -> None:
    """The cloud at its path and as PLY beside it, from one computation."""
    kept = cloud.persist()
    write_cloud(kept, path)
    sibling = path.rpartition(".")[0] + ".ply"
    if sibling != path:
        write_cloud(kept, sibling)
    kept.unpersist()


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a PLY or STL file; an empty mesh is an error."""
    register(spark)
    kind = path.rpartition(".")[2].lower()
    if kind == "stl":
        read = lambda e: spark.read.format("stl").option("element", e).load(path)
        vertices, faces = read("vertex"), read("face")
    else:
        vertices = spark.read.format("ply").load(path).withColumnRenamed("pid", "vid").select("vid", "x", "y", "z")
        faces = spark.read.format("ply").option("element", "face").load(path)
    if faces.isEmpty():
        raise ValueError(f"no faces in {path}")
    return vertices, faces


def write_stl(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    from ..operators.mesh import triangles

    register(vertices.sparkSession)
    flat = triangles(vertices, faces).selectExpr("fid", *[f"{c}.{a} as {c}{a}" for c in "abc" for a in "xyz"])
    flat.sort("fid").write.format("stl").mode("overwrite").save(path)


def write_mesh_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A mesh as binary PLY: vertices in order of vid, faces re-indexed by it.
    The two bodies are written in parallel and joined under one header."""
    from ..operators.ranking import numbered

    spark = vertices.sparkSession
    register(spark)
    place = numbered(vertices.select("vid"), "vid", "at")
    body = f"{path}._vertices.ply"
    vertices.drop("pid").sort("vid").write.format("ply").mode("overwrite").save(body)
    out = faces
    for i in ("i0", "i1", "i2"):
        out = out.join(place.select(place.vid.alias(i), place["at"].alias(f"{i}_at")), i)
    ordered = out.sort("fid").selectExpr("i0_at as i0", "i1_at as i1", "i2_at as i2")
    corners = f"{path}._faces.pcd"
    ordered.selectExpr("cast(i0 as int) i0", "cast(i1 as int) i1", "cast(i2 as int) i2").write.format("pcd").mode("overwrite").save(corners)
    lay = pcd_layout(corners)
    form, elements, offset = ply_header(body)
    with opened(body) as f:
        head = f.read(offset)
    head = head.replace(b"end_header\n", f"element face {lay.count}\nproperty list uchar int vertex_indices\nend_header\n".encode())
    files = placed(path)[0]
    with files.open_output_stream(placed(f"{path}._whole")[1]) as f:
        f.write(head)
        with opened(body) as v:
            v.seek(offset)
            shutil.copyfileobj(v, f, 1 << 24)
        with opened(corners) as c:
            c.seek(lay.offset)
            while chunk := c.read(12 * 65536):
                rec = np.zeros(len(chunk) // 12, np.dtype([("n", "u1"), ("i", "<i4", 3)]))
                rec["n"], rec["i"] = 3, np.frombuffer(chunk, "<i4").reshape(-1, 3)
                f.write(rec.tobytes())
    moved(f"{path}._whole", path)
    for used in (body, corners):
        files.delete_file(placed(used)[1])


def read_cloud_or_mesh(spark: SparkSession, path: str, samples: int, seed: int = 42) -> DataFrame:
    """A cloud; or, where a file has no points of its own, samples of the mesh
    it holds. Neither is an error."""
    from ..operators.mesh import sample_surface

    kind = path.rpartition(".")[2].lower()
    if kind != "stl":
        cloud = read_cloud(spark, path)
        if not cloud.isEmpty():
            return cloud
    return sample_surface(*read_mesh(spark, path), samples, seed).select("pid", "x", "y", "z")
