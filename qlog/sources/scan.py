"""Split-parallel, byte-true scan of quoted CSV whose fields may hold line breaks.

Spark's text reader cuts files into byte ranges and gives each range its physical lines, byte for byte. Whether a range
begins inside a quoted field is not known to its task, so

1. every range reports, for either start, how its last line ends, how many records start in it and how many lines it has;
2. these reports, one row a range, are combined along each file and fix every range's start, first record and first line;
3. ranges parse their records on their own; only records that cross ranges are put together afterwards, from fragments.

A physical line ends with a line feed, a carriage return, or both. A byte order mark at a file's start is the reader's and
is not part of the first field.
"""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qlog.operators.tables import written

MOST_FIELD = 128 << 20
#: Ranges whose starts ride to the lines in a broadcast; more go by a sort of the lines.
MOST_RANGES = 500_000

OUT, IN, BROKEN = 0, 1, 2
_QUOTED = rb'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rb"(?:" + _QUOTED + rb'|[^",][^,]*+)?+'
_CLOSED = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+\Z")
_OPENED = re.compile(rb"(?:" + _FIELD + rb',)*+"[^"]*+(?:""[^"]*+)*+\Z')
_REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+')


def line_end(line: bytes, state: int) -> int:
    """State after a physical line that begins outside (OUT) or inside (IN) a quoted field."""
    if state == BROKEN or b'"' not in line:
        return state
    body = line.rstrip(b"\r\n")
    if state == IN:
        at = _REST.match(line).end()
        if at == len(line):
            return IN
        body = body[at + 1 :]
        if not body:
            return OUT
        if not body.startswith(b","):
            return BROKEN
        body = body[1:]
    return OUT if _CLOSED.match(body) else IN if _OPENED.match(body) else BROKEN


def physical(line: bytes) -> list[bytes]:
    """Physical lines, with their ends, of what stands before a line feed."""
    return (line + b"\n").splitlines(True)


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, range (first byte) and line (its bytes) of each line, in order within a range."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[tuple]]]:
    """Rows of each run of equal (path, range): its lines with what else the batch has."""

    def rows():
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns])

    it = rows()
    ahead = next(it, None)
    while ahead is not None:
        key = ahead[:2]

        def own(key=key):
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                yield ahead
                ahead = next(it, None)

        lines = own()
        yield *key, lines
        for _ in lines:  # what the caller left
            pass


REPORT = "path string, range long, lines long, out_end int, out_starts long, in_end int, in_starts long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, start, rows in _ranges(batches):
        lines, ends, starts = 0, [OUT, IN], [0, 0]
        for _, _, raw in rows:
            for line in physical(raw):
                lines += 1
                for h in (0, 1):
                    starts[h] += ends[h] == OUT
                    ends[h] = line_end(line, ends[h])
        row = (path, start, lines, ends[0], starts[0], ends[1], starts[1])
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], [c.split()[0] for c in REPORT.split(", ")])


STARTS = "path string, range long, state int, record_no long, line_no long, last boolean"


def _combine(reports: pa.Table) -> pa.Table:
    """Start state, records and lines before each range of one file; ``last``: no range follows."""
    rows = sorted(reports.select(["range", "path", "lines", "out_end", "out_starts", "in_end", "in_starts"]).to_pylist(), key=lambda r: r["range"])
    out, state, records, lines = [], OUT, 0, 0
    for n, r in enumerate(rows):
        out.append({"path": r["path"], "range": r["range"], "state": state, "record_no": records, "line_no": lines, "last": n == len(rows) - 1})
        which = "in" if state == IN else "out"
        records += r[f"{which}_starts"]
        state = BROKEN if state == BROKEN else r[f"{which}_end"]
        lines += r["lines"]
    kinds = pa.schema([("path", pa.string()), ("range", pa.int64()), ("state", pa.int32()), ("record_no", pa.int64()), ("line_no", pa.int64()), ("last", pa.bool_())])
    return pa.Table.from_pylist(out, kinds)


PARSED = "path string, record_no long, line_start long, line_end long, fields array<string>, readable boolean, error string, fragment binary, ends boolean"
_NAMES = [c.split()[0] for c in PARSED.split(", ")]


def _fields(rows: list[list[bytes]]) -> pa.ListArray:
    """Lists of strings with the given bytes, also where they are no UTF-8."""
    offsets, flat = [0], []
    for r in rows:
        flat += r
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.binary()).view(pa.string()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), None, pa.bool_(), pa.string(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([_fields(c) if k is None else pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)


def _clean(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def parse(lines: Iterator[bytes]) -> Iterator[tuple[int, int, list[bytes], bool, str | None]]:
    """(first line, last line, fields, readable, error) of each record of physical lines that begin outside quotes.

    Strict: text behind a closing quote, or an end inside quotes, is an error, and the last thing that is given; its first
    line is that of the record.
    """
    csv.field_size_limit(MOST_FIELD)
    text = (line.decode("utf-8", "surrogateescape") for line in lines)
    reader, before = csv.reader(text, strict=True), 0
    while True:
        try:
            fields = [_clean(f) for f in next(reader)]
        except StopIteration:
            return
        except csv.Error as e:
            yield before + 1, reader.line_num, [], True, "open" if "end of data" in str(e) else "csv_boundary"
            return
        readable = True
        try:
            b"".join(fields).decode()
            for f in fields:
                f.decode()
        except UnicodeDecodeError:
            readable = False
        yield before + 1, reader.line_num, fields, readable, None
        before = reader.line_num


def _parse_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for path, _, rows in _ranges(batches):
        first = next(rows)
        _, _, _, state, record, number, last = first
        lines = (line for r in chain([first], rows) for line in physical(r[2]))
        if state == BROKEN:
            continue  # an earlier range has reported the error
        if state == IN:  # the end, or a further part, of a record that began before
            part: list[bytes] = []
            for line in lines:
                part.append(line)
                state = line_end(line, state)
                if state != IN:
                    break
            out.append((path, record, number + 1, number + len(part), [], True, "csv_boundary" if state == BROKEN else None, b"".join(part), state != IN))
            number += len(part)
            if state != OUT:
                continue
        kept: list[bytes] = []  # lines of the record that is being read

        def keep():
            for line in lines:
                kept.append(line)
                yield line

        done = 0
        for a, b, fields, readable, error in parse(keep()):
            record += 1
            own = kept[: b - a + 1]
            del kept[: b - a + 1]
            done = b
            if error == "open" and last:
                error = "csv_boundary"
            if error == "open":
                out.append((path, record, number + a, number + b, [], True, None, b"".join(own), False))
            else:
                out.append((path, record, number + a, number + b, fields, readable, error, None, True))
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        number += done
    if out:
        yield _batch(out)


def _join_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, record, start, end, error, parts in zip(*[c.to_pylist() for c in b.columns]):
            found = list(parse(iter(b"".join(p["fragment"] for p in parts).splitlines(True))))
            if error or len(found) != 1 or found[0][4]:
                out.append((path, record, start, end, [], True, "csv_boundary", None, True))
            else:
                out.append((path, record, start, end, found[0][2], found[0][3], None, None, True))
        if out:
            yield _batch(out)


def scan(spark: SparkSession, paths: str | list[str], width: int | None = None, most_ranges: int = MOST_RANGES) -> DataFrame:
    """path, record_no from 1, line_start, line_end, fields, readable and error of each record of the files.

    ``error``: ``csv_boundary`` where quoting breaks (the last record given for its range; none of the later ranges is
    parsed) or a quoted field is open at the end, ``csv_columns`` where a record has not ``width`` fields (an empty line
    has none). Fields keep their bytes, NUL included; ``readable`` is false where they are no UTF-8. Empty files give no
    rows. A field may have ``MOST_FIELD`` characters, a file any size.
    """
    lines = lines_of(spark, paths)
    reports = written(lines.mapInArrow(_report, REPORT), "ranges")
    starts = written(reports.groupBy("path").applyInArrow(_combine, STARTS), "starts")
    if starts.count() <= most_ranges:
        lines = lines.join(F.broadcast(starts), ["path", "range"])
    else:
        lines = lines.withColumn("_at", F.monotonically_increasing_id()).join(starts, ["path", "range"])
        lines = lines.repartition("path", "range").sortWithinPartitions("path", "range", "_at").drop("_at")
    parsed = written(lines.select("path", "range", "line", "state", "record_no", "line_no", "last").mapInArrow(_parse_ranges, PARSED), "parsed")
    cut = parsed.where("fragment is not null").groupBy("path", "record_no")
    cut = cut.agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("line_start", "fragment"))).alias("parts"))
    whole = parsed.where("fragment is null").unionByName(cut.mapInArrow(_join_fragments, PARSED))
    error = F.col("error") if width is None else F.coalesce("error", F.when(F.size("fields") != width, "csv_columns"))
    return whole.select("path", "record_no", "line_start", "line_end", "fields", "readable", error.alias("error"))


def _digest(mark: bytes):
    """path and sha256 of files that begin with ``mark``; null where the bytes read are not as many as the file's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for path, own in groupby(rows, lambda r: r[0]):
            sha, used = hashlib.sha256(mark), len(mark)
            for n, (_, size, line) in enumerate(own):
                if n:
                    sha.update(b"\n")
                sha.update(line)
                used += len(line) + (n > 0)
            if used + 1 == size:  # the last line's own line feed
                sha.update(b"\n")
                used += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.hexdigest() if used == size else None], pa.string())], ["path", "sha256"])

    return run


def digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, sha256 and byte_count of each file, hashed as a stream of its lines by one task a file.

    The hash is of the whole content in order, so a file cannot be split here; nothing of it is held. Files that begin
    with a byte order mark, which the line reader drops, are read once more.
    """
    whole = spark.newSession()  # its own settings: one file, one partition
    for k in ("maxPartitionBytes", "openCostInBytes"):
        whole.conf.set(f"spark.sql.files.{k}", str(1 << 40))
    raw = whole.read.option("lineSep", "\n").text(paths)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    found = written(lines.mapInArrow(_digest(b""), "path string, sha256 string"), "digests")
    marked = [r[0] for r in found.where("sha256 is null").limit(10_000).collect()]
    if marked:
        again = lines.where(F.col("path").isin(marked)).mapInArrow(_digest(b"\xef\xbb\xbf"), "path string, sha256 string")
        found = found.where("sha256 is not null").unionByName(again)
    files = spark.read.format("binaryFile").load(paths)
    sizes = files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("byte_count"))
    # readers skip empty files; the listing, which the driver has anyway, knows them
    every = spark.createDataFrame([(re.sub("^file:///", "file:/", f),) for f in files.inputFiles()], "path string")  # as the metadata column writes it
    out = every.join(sizes, "path", "left").join(found, "path", "left").withColumn("byte_count", F.coalesce("byte_count", F.lit(0).cast("long")))
    return out.select("path", F.coalesce("sha256", F.when(F.col("byte_count") == 0, F.sha2(F.lit(""), 256))).alias("sha256"), "byte_count")
