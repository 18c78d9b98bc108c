"""Quoted CSV files as a Spark data source.

Spark's CSV reader takes one header for a whole read, and a quoted line break makes it read a file in one task. Here every
file is read by the names in its own first line, files are cut into byte ranges that also part a quoted cell, rows carry
their file and line, and a filter on ``file_symbol`` keeps files from being opened.

A range does not know whether it starts inside quotes. Where a file has several, ``marks`` counts quotes and line breaks per
range in one pass; their running sums say for each range whether it starts inside a cell, and at which line.

Paths are opened through Arrow's file systems: local ones, and the stores that Arrow knows by their scheme. The module is sent
to workers by value, so they need not have the library.
"""

from __future__ import annotations

import csv
import hashlib
import json
import re
import sys
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "quoted_csv"
#: Bytes of a range, and of the small files that one task reads.
RANGE_BYTES = 32 << 20
_BATCH_ROWS = 1 << 14
_BLOCK = 1 << 20
#: Bytes that are parsed at once where nothing is quoted.
_PLAIN_BYTES = 4 << 20


def file_symbol(name: str) -> str:
    """``aapl_daily.csv`` and ``AAPL.csv`` both name AAPL."""
    return re.sub(r"(?i)_daily$", "", re.sub(r"(?i)\.csv$", "", name)).upper()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def listed(paths: Sequence[str]) -> list[tuple[str, str, int]]:
    """(path, name, bytes) of the files: those named, and in folders the visible ones that end in .csv, in any case."""
    found = []
    for path in paths:
        fs, place = opened(path)
        info = fs.get_file_info(place)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no such file or folder: {path}")
        inside = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(place))
        kept = [i for i in inside if i.is_file and (info.is_file or re.fullmatch(r"(?i)[^._].*\.csv", i.base_name))]
        head = path if info.is_file else path.rstrip("/")
        found += [(head if info.is_file else f"{head}/{i.base_name}", i.base_name, i.size) for i in kept]
    return sorted(found)


@dataclass(frozen=True)
class Range:
    """Bytes ``start`` to ``stop`` of a file; ``quoted`` if it starts inside a quoted cell, ``line`` that of its first byte."""

    path: str
    symbol: str
    start: int
    stop: int
    quoted: bool = False
    line: int = 1


@dataclass
class Bundle(InputPartition):
    ranges: list[Range]

    def __init__(self, ranges: list[Range]):
        super().__init__(None)
        self.ranges = ranges


def _pieces(size: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, size)) for a in range(0, size, width)]


def bundles(ranges: Iterable[Range], width: int) -> list[InputPartition]:
    """Neighbouring ranges of together at most ``width`` bytes, or one."""
    made: list[list[Range]] = []
    held = width + 1
    for r in ranges:
        held += r.stop - r.start
        if held > width:
            made.append([])
            held = r.stop - r.start
        made[-1].append(r)
    return [Bundle(r) for r in made]


class _Lines:
    """Lines of a file from a place on, as text, with the place and the number of the next one."""

    def __init__(self, file: pa.NativeFile, place: int, line: int):
        file.seek(place)
        self.file, self.place, self.line, self.rest, self.quotes = file, place, line, b"", 0

    def __iter__(self) -> Iterator[str]:
        return self

    def __next__(self) -> str:
        raw = self.raw()
        return raw.decode("utf-8-sig" if self.place == len(raw) else "utf-8")

    def raw(self) -> bytes:
        parts = []
        while (end := self.rest.find(b"\n")) < 0:
            parts.append(self.rest)
            self.rest = self.file.read(_BLOCK)
            if not self.rest:
                break
        parts.append(self.rest[: end + 1])
        self.rest = self.rest[end + 1 :]
        raw = b"".join(parts)
        if not raw:
            raise StopIteration
        self.quotes += raw.count(b'"')
        self.line += 1
        self.place += len(raw)
        return raw


def _header(lines: _Lines) -> list[str]:
    return [name.strip().lower() for name in next(csv.reader(lines), [])]


def _to_record(lines: _Lines, quoted: bool) -> None:
    """Moves from the byte before a range to the first record that starts in it."""
    while True:
        try:
            # Bytes, as the first of them may be in the middle of a letter.
            quoted ^= bool(lines.raw().count(b'"') % 2)
        except StopIteration:
            return
        if not quoted:
            return


def _at_first_record(file: pa.NativeFile, r: Range) -> tuple[list[str], _Lines]:
    """The file's header, and its lines from the first record that starts in the range."""
    header_lines = _Lines(file, 0, 1)
    header = _header(header_lines)
    if r.start == 0:
        return header, header_lines
    # From the byte before: a record may start with the range. That byte is a line's last or changes nothing but
    # a quote, whose count belongs to the range before.
    file.seek(r.start - 1)
    before = file.read(1)
    lines = _Lines(file, r.start - 1, r.line - (before == b"\n"))
    _to_record(lines, r.quoted ^ (before == b'"'))
    return header, lines


def _records(lines: _Lines, r: Range) -> Iterator[tuple[int, list[str]]]:
    """(line, cells) of each record from here to the end of the range. Blank lines are none."""
    lines.quotes = 0
    reader = csv.reader(lines)
    while lines.place < r.stop:
        line = lines.line
        cells = next(reader, None)
        if cells is None:
            break
        if len(cells) > 1 or (cells and cells[0].strip()):
            yield line, cells
    if lines.quotes % 2:
        raise ValueError(f"{r.path}: a quote that opens after line {line} is not closed")


def _plain_block(lines: _Lines, stop: int, width: int, places: list[int]) -> tuple[int, pa.Table] | None:
    """(line of the first record, cells) of the next lines, parsed by Arrow; the place moves behind them.

    None, and nothing moves, if they hold a quote or another thing that only ``csv`` reads as wanted: returns, zeros,
    blank lines, cells that are missing or too many, cells beyond its limit, wrong letters.
    """
    lines.file.seek(lines.place)
    parts = [lines.file.read(min(_PLAIN_BYTES, stop - lines.place))]
    while parts[-1] and not parts[-1].endswith(b"\n"):
        more = lines.file.read(1 << 16)
        parts.append(more[: more.find(b"\n") + 1] or more)
    data = b"".join(parts)
    if width < 2 or data.startswith(b"\xef\xbb\xbf") or any(c in data for c in (b'"', b"\r", b"\0")) or max(map(len, data.split(b"\n"))) > csv.field_size_limit():
        return None
    names = [str(k) for k in range(width)]
    try:
        data.decode()  # also the cells that nobody asks for
        table = pacsv.read_csv(
            pa.BufferReader(data),
            pacsv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=names),
            pacsv.ParseOptions(quote_char=False),
            pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, null_values=[""], strings_can_be_null=True, include_columns=[names[k] for k in places]),
        )
    except (pa.ArrowInvalid, UnicodeDecodeError):
        return None
    breaks = data.count(b"\n") + (not data.endswith(b"\n"))
    if table.num_rows != breaks:
        return None
    first = lines.line
    lines.place, lines.line, lines.rest = lines.place + len(data), first + breaks, b""
    return first, table


class CsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.columns = json.loads(options["columns"])
        self.mode = options.get("mode", "rows")
        self.width = int(options.get("range_bytes", RANGE_BYTES))
        self.marks = json.loads(options.get("marks", "{}"))
        self.one_per_symbol = options.get("one_per_symbol", "false") == "true"
        self.symbols: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file_symbol",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("file_symbol",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.symbols = wanted if self.symbols is None else self.symbols & wanted

    def files(self) -> list[tuple[str, str, int]]:
        found = [(path, file_symbol(name), size) for path, name, size in listed(self.paths)]
        if self.symbols is not None:
            found = [f for f in found if f[1] in self.symbols]
        if self.one_per_symbol:
            # Sorted by path: the first name of a symbol stays.
            found = list({f[1]: f for f in reversed(found)}.values())[::-1]
        return found

    def partitions(self) -> Sequence[InputPartition]:
        if self.mode in ("heads", "digests"):
            found = self.files()
            per_task = max(1, len(found) // 256)
            return [Bundle([Range(p, s, 0, 0) for p, s, _ in found[k : k + per_task]]) for k in range(0, len(found), per_task)]
        ranges = []
        for path, symbol, size in self.files():
            pieces = _pieces(size, self.width)
            if self.mode == "marks":
                ranges += [Range(path, symbol, a, b) for a, b in pieces] if len(pieces) > 1 else []
            else:
                states = self.marks.get(path, [[False, 1]])
                ranges += [Range(path, symbol, a, b, *state) for (a, b), state in zip(pieces, states, strict=True)]
        return bundles(ranges, self.width)

    def read(self, partition: Bundle | None) -> Iterator[pa.RecordBatch]:
        # Spark asks for the rows of no partition where there are no files.
        return getattr(self, f"read_{self.mode}")(partition) if partition is not None else iter(())

    def read_heads(self, partition: Bundle) -> Iterator[tuple]:
        for r in partition.ranges:
            fs, place = opened(r.path)
            with fs.open_input_file(place) as file:
                yield r.path, r.symbol, _header(_Lines(file, 0, 1))

    def read_digests(self, partition: Bundle) -> Iterator[tuple]:
        for r in partition.ranges:
            fs, place = opened(r.path)
            state, size = hashlib.sha256(), 0
            with fs.open_input_file(place) as file:
                while block := file.read(_BLOCK):
                    state.update(block)
                    size += len(block)
            yield r.path, r.symbol, state.hexdigest(), size

    def read_marks(self, partition: Bundle) -> Iterator[tuple]:
        for r in partition.ranges:
            fs, place = opened(r.path)
            quotes = breaks = 0
            with fs.open_input_file(place) as file:
                file.seek(r.start)
                left = r.stop - r.start
                while left:
                    block = file.read(min(_BLOCK, left))
                    left -= len(block)
                    quotes += block.count(b'"')
                    breaks += block.count(b"\n")
            yield r.path, r.start, quotes, breaks

    def read_rows(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            fs, place = opened(r.path)
            with fs.open_input_file(place) as file:
                yield from self.read_cells(r, *_at_first_record(file, r))

    def read_cells(self, r: Range, header: list[str], lines: _Lines) -> Iterator[pa.RecordBatch]:
        """Lines without quotes are parsed in blocks; from the first block that is not plain, record by record."""
        missing = sorted(set(self.columns) - set(header))
        places = [header.index(c) for c in self.columns] if not missing else None

        def batch(cells: list[pa.Array], numbers: pa.Array) -> pa.RecordBatch:
            own = [pa.repeat(pa.scalar(r.path), len(numbers)), numbers, pa.repeat(pa.scalar(r.symbol), len(numbers))]
            return pa.RecordBatch.from_arrays(cells + own, names=[*self.columns, "source", "row_number", "file_symbol"])

        def listed_batch() -> pa.RecordBatch:
            return batch([pa.array([(row[k] or None) if k < len(row) else None for row in rows], pa.string()) for k in places], pa.array(numbers, pa.int64()))

        while places and lines.place < r.stop and (block := _plain_block(lines, r.stop, len(header), places)):
            first, table = block
            for part in table.combine_chunks().to_batches(max_chunksize=_BATCH_ROWS):
                yield batch(part.columns, pa.array(range(first, first + part.num_rows), pa.int64()))
                first += part.num_rows
        lines.file.seek(lines.place)
        lines.rest = b""
        rows, numbers = [], []
        for line, cells in _records(lines, r):
            if missing:
                raise ValueError(f"{r.path}: missing required columns {', '.join(missing)}")
            rows.append(cells)
            numbers.append(line)
            if len(rows) == _BATCH_ROWS:
                yield listed_batch()
                rows, numbers = [], []
        if rows:
            yield listed_batch()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class CsvWriter(DataSourceArrowWriter):
    """One file per symbol. Tasks write into a staging folder; only the commit moves files to their place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        # An attempt has its own folder, so a task that runs twice cannot mix its files.
        folder = f"{self.staging}/{TaskContext.get().taskAttemptId()}"
        fs, place = opened(folder)
        fs.create_dir(place, recursive=True)
        names, symbol, stream = [], None, None

        def close() -> None:
            if stream is not None:
                stream[1].close()
                stream[0].close()

        try:
            for batch in iterator:
                cells = batch.column("symbol").to_pylist()
                cuts = [0, *(k for k in range(1, len(cells)) if cells[k] != cells[k - 1]), len(cells)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if cells[a] != symbol:
                        close()
                        symbol = cells[a]
                        if not re.fullmatch(r"[^/\\._][^/\\]*", symbol or ""):
                            raise ValueError(f"a symbol that cannot name a file: {symbol!r}")
                        names.append(f"{symbol}.csv")
                        sink = fs.open_output_stream(f"{place}/{symbol}.csv")
                        stream = (sink, pacsv.CSVWriter(sink, batch.schema, write_options=pacsv.WriteOptions(quoting_style="needed")))
                    stream[1].write_batch(batch.slice(a, b - a))
        finally:
            close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        written = [m for m in messages if m is not None]
        names = [n for m in written for n in m.names]
        repeated = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        if repeated:
            self.abort(messages)
            raise ValueError(f"rows of one symbol came from several tasks: {sorted(repeated)[:5]}")
        fs, place = opened(self.path)
        if self.overwrite:
            for path, name, _ in listed([self.path]):
                if name not in set(names):
                    fs.delete_file(opened(path)[1])
        for m in written:
            for name in m.names:
                fs.move(f"{opened(m.folder)[1]}/{name}", f"{place}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, place = opened(self.staging)
        if fs.get_file_info(place).type == pafs.FileType.Directory:
            fs.delete_dir(place)


class QuotedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        mode = self.options.get("mode", "rows")
        if mode == "heads":
            return "source string, file_symbol string, header array<string>"
        if mode == "digests":
            return "source string, file_symbol string, sha256 string, length long"
        if mode == "marks":
            return "source string, start long, quotes long, breaks long"
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"])) + ", source string, row_number long, file_symbol string"

    def reader(self, schema) -> CsvReader:  # noqa: ANN001
        return CsvReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CsvWriter:  # noqa: ANN001
        return CsvWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QuotedCsv)
    # Without it Spark refuses a reader that takes filters.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _reader(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], **options: str):  # noqa: ANN202
    register(spark)
    named = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(FORMAT).options(paths=json.dumps(named), columns=json.dumps(list(columns)), **options)


def heads(spark: SparkSession, paths: str | Sequence[str], one_per_symbol: bool = False) -> DataFrame:
    """(source, file_symbol, header) of every file. Only first lines are read."""
    return _reader(spark, paths, [], mode="heads", one_per_symbol=str(one_per_symbol).lower()).load()


def digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source, file_symbol, sha256, length) of every file's bytes, which stream through a task."""
    return _reader(spark, paths, [], mode="digests").load()


def rows(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], range_bytes: int = RANGE_BYTES, one_per_symbol: bool = False) -> DataFrame:
    """The named columns as text, and source, row_number (the line, the header being line 1) and file_symbol.

    Names in headers are compared trimmed and in lower case; other columns are left out. An empty cell is null. A row
    that is too short has nulls. A quote that is not closed is an error.
    """
    named = [paths] if isinstance(paths, str) else list(paths)
    options = {"range_bytes": str(range_bytes), "one_per_symbol": str(one_per_symbol).lower()}
    if any(size > range_bytes for *_, size in listed(named)):
        # A small row per range, as many as Spark's own listing of splits has.
        found: dict[str, list[tuple[int, int, int]]] = {}
        for r in _reader(spark, named, columns, mode="marks", **options).load().collect():
            found.setdefault(r["source"], []).append((r["start"], r["quotes"], r["breaks"]))
        states = {}
        for path, ranges in found.items():
            quotes, line, states[path] = 0, 1, []
            for _, q, breaks in sorted(ranges):
                states[path].append([bool(quotes % 2), line])
                quotes, line = quotes + q, line + breaks
            if quotes % 2:
                raise ValueError(f"{path}: a quote is not closed")
        options["marks"] = json.dumps(states)
    return _reader(spark, named, columns, **options).load()


def write_symbol_files(cells: DataFrame, path: str, overwrite: bool = True) -> None:
    """A file per ``symbol`` with the columns of ``cells``, which are text, in their order within a symbol's partition."""
    register(cells.sparkSession)
    fs, place = opened(path)
    fs.create_dir(place, recursive=True)
    cells.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).save()
