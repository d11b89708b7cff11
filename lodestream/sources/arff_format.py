"""ARFF as a Spark data source: `spark.read.format("arff")` and `df.write.format("arff")`, after `register(spark)`.

A folder holds whole ARFF files, one a task of the write, each with the same header; a path can also name a single file
of any origin. Text is nominal where the field's metadata holds its domain and STRING else, booleans are the domain
{0,1}, numbers are NUMERIC and NULL is `?`. The field whose metadata names it the class, or else the last one, comes last.

Reading cuts files into ranges of `split_bytes`, a task each; a range owns the lines that begin in it. Lines are
parsed in pieces, so memory holds a piece and never a file. A file whose header differs from that of the first is an error.

Writing goes to a hidden folder; the commit moves the files of the tasks that the driver counts, so that tasks run
twice, or lost with their executor, leave nothing behind. Overwriting deletes earlier files only then.

Values keep their line ends (written as \\n and \\r). Comments and empty lines are skipped. Sparse rows are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Metadata of a field: the values of a nominal column, and whether it is the class.
DOMAIN, CLASS = "domain", "class"
MISSING = "?"
SUFFIX = ".arff"
SPLIT_BYTES = 128 << 20
#: Bytes parsed at once.
PIECE = 8 << 20
#: A value of a declared domain.
VALUE = re.compile(r"'((?:[^'\\]|\\.)*)'|([^,{}\s][^,{}]*)")
ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|[^\s{]+)\s*(.*)", re.IGNORECASE)
DATA = re.compile(rb"^[ \t]*@data[^\n]*(?:\n|\Z)", re.IGNORECASE | re.MULTILINE)
COMMENT = re.compile(rb"^[ \t]*%[^\n]*(?:\n|\Z)", re.MULTILINE)
ESCAPED = {"\n": "\\n", "\r": "\\r", "\\": "\\\\", "'": "\\'"}
NEEDS_QUOTES = re.compile(r"[\s,{}'\"%\\]")


def quoted(text: str) -> str:
    if NEEDS_QUOTES.search(text) or text in ("", MISSING):
        return "'" + re.sub(r"[\n\r\\']", lambda m: ESCAPED[m[0]], text) + "'"
    return text


def unquoted(text: str) -> str:
    """The value of a name or of the inside of a quoted one."""
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), text)


def nominal_text(value) -> str:
    """A value of a nominal column: whole numbers without a fraction, booleans as 1 and 0."""
    if isinstance(value, bool):
        return str(int(value))
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def class_last(schema: T.StructType) -> list[T.StructField]:
    return sorted(schema.fields, key=lambda f: bool(f.metadata.get(CLASS)))


def declarations(fields: list[T.StructField], relation: str) -> str:
    lines = [f"@RELATION {quoted(relation)}", ""]
    for f in fields:
        if DOMAIN in f.metadata or isinstance(f.dataType, T.BooleanType):
            kind = "{" + ",".join(map(quoted, f.metadata.get(DOMAIN, ["0", "1"]))) + "}"
        else:
            kind = "NUMERIC" if isinstance(f.dataType, T.NumericType) else "STRING"
        lines.append(f"@ATTRIBUTE {quoted(f.name)} {kind}")
    return "\n".join([*lines, "", "@DATA"])


def declared(head: str) -> T.StructType:
    """The schema of a header: numbers are double, all else text; the last attribute is the class."""
    found = [m.groups() for m in map(ATTRIBUTE.match, map(str.strip, head.split("\n"))) if m]
    fields = []
    for i, (name, kind) in enumerate(found):
        metadata = {CLASS: True} if i == len(found) - 1 else {}
        if kind.startswith("{"):
            metadata[DOMAIN] = [unquoted(q) if plain == "" else plain.strip() for q, plain in VALUE.findall(kind)]
        number = kind.split()[0].upper() in ("NUMERIC", "REAL", "INTEGER") if kind else False
        fields.append(T.StructField(unquoted(name[1:-1]) if name[0] == "'" else name, T.DoubleType() if number else T.StringType(), True, metadata))
    return T.StructType(fields)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    file: str


class Folder:
    """The files at a path of any file system that Arrow knows."""

    def __init__(self, path: str):
        self.url = path
        self.system, self.path = fs.FileSystem.from_uri(path)

    def files(self) -> list[fs.FileInfo]:
        at = self.system.get_file_info(self.path)
        if at.type == fs.FileType.File:
            return [at]
        if at.type == fs.FileType.NotFound:
            return []
        return sorted((f for f in self.system.get_file_info(fs.FileSelector(self.path)) if f.type == fs.FileType.File and f.path.endswith(SUFFIX)), key=lambda f: f.path)

    def head(self, file: str) -> bytes:
        """The bytes of a file up to its data section."""
        found = b""
        with self.system.open_input_stream(file) as source:
            while block := source.read(1 << 16):
                found += block
                if (m := DATA.search(found)) and (m[0].endswith(b"\n")):
                    return found[: m.end()]
        if m := DATA.search(found):
            return found[: m.end()]
        raise ValueError(f"{file} has no data section")


class ArffReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, schema: T.StructType):
        self.path, self.split_bytes, self.schema = path, split_bytes, schema

    def partitions(self) -> list[Range]:
        return [Range(f.path, at, min(at + self.split_bytes, f.size)) for f in Folder(self.path).files() for at in range(0, f.size, self.split_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        head = folder.head(partition.file)
        own = declared(head.decode())
        if [(f.name, f.dataType) for f in own] != [(f.name, f.dataType) for f in self.schema]:
            raise ValueError(f"{partition.file} declares other attributes than the first file")
        kinds = {f.name: pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in own}
        for piece in self._pieces(folder, partition, len(head)):
            piece = COMMENT.sub(b"", piece) if b"%" in piece else piece
            if b"\\" in piece:
                piece = re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"r": b"\r"}.get(m[1], m[0]), piece)
            if not piece.strip():
                continue
            table = csv.read_csv(
                pa.BufferReader(piece),
                read_options=csv.ReadOptions(column_names=list(kinds), block_size=len(piece) + 1),
                parse_options=csv.ParseOptions(quote_char="'", escape_char="\\", newlines_in_values=True),
                convert_options=csv.ConvertOptions(column_types=kinds, null_values=[MISSING], strings_can_be_null=True, quoted_strings_can_be_null=False),
            )
            yield from table.to_batches(max_chunksize=1 << 16)

    @staticmethod
    def _pieces(folder: Folder, partition: Range, data: int) -> Iterator[bytes]:
        """The lines that begin in the range, some mebibytes at a time, whole lines each."""
        start = max(partition.start, data)
        if start >= partition.stop:
            return
        with folder.system.open_input_file(partition.file) as source:
            # a line that begins before the range is the one's before it: look at the byte before for its end
            source.seek(start - 1 if start > data else start)
            held, at, skipping = b"", source.tell(), start > data
            while at < partition.stop or held or skipping:
                block = source.read(PIECE)
                at += len(block)
                if skipping:
                    cut = block.find(b"\n") + 1
                    if not cut and block:
                        continue
                    skipping = False
                    if at - len(block) + cut >= partition.stop:
                        return
                    block = block[cut:]
                held += block
                if at >= partition.stop:
                    # the last own line begins at or before stop - 1
                    own_end = held.find(b"\n", max(len(held) - (at - partition.stop) - 1, 0)) + 1
                    if own_end or not block:
                        yield held[:own_end] if own_end else held
                        return
                elif cut := held.rfind(b"\n") + 1:
                    yield held[:cut]
                    held = held[cut:]


class ArffWriter(DataSourceArrowWriter):
    def __init__(self, path: str, relation: str, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.schema = path, overwrite, schema
        self.fields = class_last(schema)
        self.head = declarations(self.fields, relation)
        self.hidden = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, task = Folder(self.path), TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}{SUFFIX}"
        folder.system.create_dir(f"{folder.path}/{self.hidden}")
        with folder.system.open_output_stream(f"{folder.path}/{self.hidden}/{name}") as out:
            out.write((self.head + "\n").encode())
            for batch in iterator:
                by_name = dict(zip(batch.schema.names, batch.columns))
                cells = [self._cells(f, by_name[f.name]) for f in self.fields]
                out.write("".join(",".join(row) + "\n" for row in zip(*cells)).encode())
        return Written(name)

    @staticmethod
    def _cells(field: T.StructField, column: pa.Array) -> list[str]:
        values = column.to_pylist()
        if DOMAIN in field.metadata or not isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return [MISSING if v is None else quoted(nominal_text(v)) for v in values]
        return [MISSING if v is None or v != v else "%.10g" % v for v in values]

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        earlier = [f.path for f in folder.files()] if self.overwrite else []
        folder.system.create_dir(folder.path)
        for m in messages:
            if m is not None:
                folder.system.move(f"{folder.path}/{self.hidden}/{m.file}", f"{folder.path}/{m.file}")
        for file in earlier:
            folder.system.delete_file(file)
        self._clear(folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(Folder(self.path))

    def _clear(self, folder: Folder) -> None:
        if folder.system.get_file_info(f"{folder.path}/{self.hidden}").type == fs.FileType.Directory:
            folder.system.delete_dir(f"{folder.path}/{self.hidden}")


class ArffSource(DataSource):
    """Options: path; `relation` (its name, for writing); `split_bytes` (bytes of a task, for reading)."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    @cached_property
    def path(self) -> str:
        path = self.options["path"]
        return path[len("file:") :] if re.match(r"file:/[^/]", path) else path

    def schema(self) -> T.StructType:
        folder = Folder(self.path)
        files = folder.files()
        if not files:
            raise FileNotFoundError(f"no ARFF file at {self.path}")
        return declared(folder.head(files[0].path).decode())

    def reader(self, schema: T.StructType) -> ArffReader:
        return ArffReader(self.path, int(self.options.get("split_bytes", SPLIT_BYTES)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArffWriter:
        return ArffWriter(self.path, self.options.get("relation", "relation"), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArffSource)
