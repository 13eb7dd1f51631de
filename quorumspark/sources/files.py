"""Data sources `panel_runs` (JSONL logs of runs) and `panel_reports` (whole text files), split over tasks, with filters that reach the files.

`panel_runs` reads byte ranges of JSONL files: each task parses the lines that start in its ranges. The schema that the user declares is the
columns that are built. A line that is no JSON object, has a field of another type than declared (string columns take any value, as JSON text),
or a null or nothing in one of the `required` columns is skipped; blank lines are no lines. A column `skipped` of the schema (long) makes every task give one
more row that holds only the number of lines it skipped, so rows and counts come from one pass; in all other rows it is null. Suffixes named
by `drop_suffix` ("column=suffix,...") are taken off before filters are judged.

`panel_reports` reads files laid out as source/year/slug.txt, or as Spark writes them (source=.../year=.../slug=.../part). Filters on source,
year and slug are judged on paths, so files that they exclude are never opened; a file is held whole by the task that reads it.

Ranges and files are dealt to tasks of `split_bytes` (128 MB) at most, of less where the input does not fill `parallel` tasks. Paths are files or
folders of any file system that pyarrow opens; names that start with _ or . are left out, as Spark does. Compressed logs (.gz, .bz2, .zst)
are read by one task each.
"""

import json
import re
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyarrow import json as arrow_json
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

_PACKED = (".gz", ".bz2", ".zst")
_CHUNK, _BATCH, _LEAST, _FEW = 1 << 20, 1 << 20, 4 << 20, 8
_TESTS = {
    EqualTo: lambda x, v: pc.equal(x, pa.scalar(v, x.type)),
    GreaterThan: lambda x, v: pc.greater(x, pa.scalar(v, x.type)),
    GreaterThanOrEqual: lambda x, v: pc.greater_equal(x, pa.scalar(v, x.type)),
    LessThan: lambda x, v: pc.less(x, pa.scalar(v, x.type)),
    LessThanOrEqual: lambda x, v: pc.less_equal(x, pa.scalar(v, x.type)),
    In: lambda x, v: pc.is_in(x, pa.array([y for y in v if y is not None], x.type)),
    IsNotNull: lambda x, v: x.is_valid(),
}


@dataclass
class Piece:
    """Bytes [start, end) of a file at or below `root`; end None: the whole of a file that cannot be split."""

    root: str
    path: str
    start: int
    end: int | None


@dataclass
class Pieces(InputPartition):
    pieces: list


def _opened(root: str):
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", root))


def _files(root: str):
    """(path in its file system, size) of the visible files at or below a path, by name."""
    system, inner = _opened(root)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.is_file:
        return [(info.path, info.size)]
    found = [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    return sorted(f for f in found if not re.search(r"(?:^|/)[_.]", f[0][len(inner) :]))


def _dealt(pieces, size: int):
    """(piece, bytes) in order, in partitions of about `size` bytes."""
    out, held = [], 0
    for p, n in pieces:
        if not out or held + n > size:
            out.append([])
            held = 0
        out[-1].append(p)
        held += n
    return [Pieces(p) for p in out or [[]]]


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.filters = schema, []
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split, self.parallel = int(options.get("split_bytes", 128 << 20)), int(options.get("parallel", 1))

    def size(self, total: int) -> int:
        """Bytes of a task."""
        return max(1, min(self.split, max(_LEAST, -(-total // self.parallel))))

    def judged(self, name: str) -> bool:
        """Whether this source can judge filters on the column."""
        return name in self.schema.names

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ())  # a negated filter has none
            if len(column) == 1 and self.judged(column[0]) and type(f) in _TESTS:
                self.filters.append((column[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def passing(self, rows: pa.Table) -> pa.Table:
        """The rows that all pushed filters let through; a null passes none."""
        for c, kind, v in self.filters:
            rows = rows.filter(pc.and_(pc.fill_null(_TESTS[kind](rows[c], v), False), rows[c].is_valid()))
        return rows


def _cell(x, kind: T.DataType):
    """A JSON value as Arrow takes it in a column of this type; TypeError where it is of another type. Null fits everywhere."""
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if isinstance(kind, (T.IntegerType, T.LongType)):
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        if type(x) is int and -(1 << bits) <= x < 1 << bits:
            return x
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        if type(x) in (int, float):
            return float(x)
    elif isinstance(kind, T.BooleanType):
        if isinstance(x, bool):
            return x
    elif isinstance(kind, T.ArrayType) and isinstance(x, list):
        return [_cell(y, kind.elementType) for y in x]
    elif isinstance(kind, T.MapType) and isinstance(x, dict):
        return [(k, _cell(y, kind.valueType)) for k, y in x.items()]
    elif isinstance(kind, T.StructType) and isinstance(x, dict):
        return {f.name: _cell(x.get(f.name), f.dataType) for f in kind}
    raise TypeError(kind.simpleString())


class RunsReader(_Reader):
    """Whole blocks of lines go through Arrow's parser; a block that it refuses is halved down to the lines at fault, which are judged one by one."""

    def __init__(self, schema, options):
        super().__init__(schema, options)
        names = lambda key: [x for x in options.get(key, "").split(",") if x]
        self.required, self.suffixes = names("required"), [x.split("=", 1) for x in names("drop_suffix")]
        if missing := [x for x in self.required if x not in schema.names]:
            raise ValueError(f"required columns that the schema lacks: {missing}")

    def judged(self, name):
        return name in self.schema.names and name != "skipped"

    def partitions(self):
        found = [(root, *f) for root in self.paths for f in _files(root)]
        size, pieces = self.size(sum(n for _, _, n in found)), []
        for root, path, n in found:
            if path.endswith(_PACKED):
                pieces.append((Piece(root, path, 0, None), n))
            else:
                pieces += [(Piece(root, path, a, min(a + size, n)), min(size, n - a)) for a in range(0, n, size)]
        return _dealt(pieces, size)

    @staticmethod
    def lines(piece: Piece):
        """The lines that start in the piece. A line is held whole, the file never."""
        system, _ = _opened(piece.root)
        with system.open_input_stream(piece.path) if piece.end is None else system.open_input_file(piece.path) as f:
            at = max(piece.start - 1, 0)
            if at:
                f.seek(at)
            first = at < piece.start  # what stands before the first line break belongs to the piece before
            held = []
            while chunk := f.read(_CHUNK):
                *whole, rest = chunk.split(b"\n")
                for part in whole:
                    line = b"".join([*held, part])
                    held = []
                    if not first:
                        yield line
                    first = False
                    at += len(line) + 1
                    if piece.end is not None and at >= piece.end:
                        return
                if rest:
                    held.append(rest)
            if held and not first:
                yield b"".join(held)

    @staticmethod
    def cells(line: bytes, kinds: T.StructType):
        """The cells of a line, or None where it has to be skipped. Half surrogate pairs become question marks."""
        try:
            row = json.loads(line)
            if b"\\ud" in line or b"\\uD" in line:
                row = json.loads(json.dumps(row, ensure_ascii=False).encode("utf-8", "replace"))
            return _cell(row, kinds)
        except (ValueError, TypeError, OverflowError, RecursionError):
            return None

    def parsed(self, lines: list, kinds: T.StructType, arrow: pa.Schema):
        """Tables of the lines in order, without the lines to skip."""
        if not any(isinstance(f.dataType, T.MapType) for f in kinds) and len(kinds) and all(x[:1] == b"{" and x[-1:] == b"}" for x in lines):
            # lines that begin and end so hold an object each, or more: no object goes on over a line break
            block = b"\n".join(lines)
            try:
                rows = arrow_json.read_json(pa.BufferReader(block), arrow_json.ReadOptions(use_threads=False, block_size=len(block) + 1), arrow_json.ParseOptions(explicit_schema=arrow, unexpected_field_behavior="ignore"))
                rows.validate(full=True)
                if rows.num_rows == len(lines):
                    yield rows.select(arrow.names)
                    return
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                pass
        if len(lines) > _FEW:
            half = len(lines) // 2
            yield from self.parsed(lines[:half], kinds, arrow)
            yield from self.parsed(lines[half:], kinds, arrow)
            return
        rows = [x for x in (self.cells(line, kinds) for line in lines) if x is not None]
        yield pa.Table.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    def read(self, partition: Pieces):
        kinds = T.StructType([f for f in self.schema if f.name != "skipped"])
        whole, arrow = to_arrow_schema(self.schema), to_arrow_schema(kinds)
        n_lines = n_good = 0

        def judged(lines):
            nonlocal n_lines, n_good
            rows = pa.concat_tables(self.parsed(lines, kinds, arrow))
            for c in self.required:
                rows = rows.filter(rows[c].is_valid())
            n_lines += len(lines)
            n_good += rows.num_rows
            for c, suffix in self.suffixes:
                if c in rows.column_names:
                    rows = rows.set_column(rows.column_names.index(c), arrow.field(c), pc.replace_substring_regex(rows[c], re.escape(suffix) + "$", ""))
            return whole_rows(self.passing(rows))

        def whole_rows(rows):
            cols = [rows[f.name] if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type) for f in whole]
            return pa.Table.from_arrays(cols, schema=whole).combine_chunks().to_batches()

        lines, held = [], 0
        for line in (x.strip() for piece in partition.pieces for x in self.lines(piece)):
            if line:
                lines.append(line)
                held += len(line)
                if held > _BATCH:
                    yield from judged(lines)
                    lines, held = [], 0
        if lines:
            yield from judged(lines)
        if "skipped" in whole.names and not self.filters:
            yield pa.RecordBatch.from_arrays([pa.array([n_lines - n_good if f.name == "skipped" else None], f.type) for f in whole], schema=whole)


class PanelRuns(DataSource):
    @classmethod
    def name(cls):
        return "panel_runs"

    def schema(self):
        return "country string, year int, indicator string, condition string, model_key string, rating int"

    def reader(self, schema):
        return RunsReader(schema, self.options)


_PLACE = re.compile(r"([^/=]+)/(?:year=)?(\d{4})/(?:slug=([^/]+)/[^/]+|([^/]+)\.[A-Za-z]+)$")


class ReportsReader(_Reader):
    def judged(self, name):
        return name in ("source", "year", "slug")

    @staticmethod
    def place(path: str):
        """{source, year, slug} that a path says, or None where it is laid out otherwise."""
        m = _PLACE.search(path)
        if not m:
            return None
        spark = m[3] is not None
        return {"source": unquote(m[1]) if spark else m[1], "year": int(m[2]), "slug": unquote(m[3]) if spark else m[4]}

    def partitions(self):
        found = [(Piece(root, path, 0, None), n, at) for root in self.paths for path, n in _files(root) if (at := self.place(path))]
        places = pa.Table.from_pylist([at | {"i": i} for i, (_, _, at) in enumerate(found)], pa.schema([("source", pa.string()), ("year", pa.int32()), ("slug", pa.string()), ("i", pa.int64())]))
        found = [found[i][:2] for i in self.passing(places)["i"].to_pylist()]
        return _dealt(found, self.size(sum(n for _, n in found)))

    def read(self, partition: Pieces):
        for piece in partition.pieces:
            system, _ = _opened(piece.root)
            with system.open_input_stream(piece.path, compression=None) as f:
                text = f.read().decode("utf-8", "replace")
            row = self.place(piece.path) | {"text": text.removesuffix("\n")}
            yield tuple(row[c] for c in self.schema.names)


class PanelReports(DataSource):
    @classmethod
    def name(cls):
        return "panel_reports"

    def schema(self):
        return "source string, year int, slug string, text string"

    def reader(self, schema):
        return ReportsReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Both sources by name, and the session setting that lets filters reach sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PanelRuns, PanelReports):
        spark.dataSource.register(source)
