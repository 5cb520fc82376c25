"""Large FASTA files, read by ranges of bytes.

A file is cut into ranges, each read by a task of its own, so that a chromosome is many tasks, however its lines are broken, and no row
holds it whole. A header belongs to the range that holds the line end before it. What a range can't know (which record it starts in, how
many bases of it came before) is summed up in one row a range and handed on. Compression is told by the first bytes of a file, not by
its name: files of independent gzip blocks (each names its size) are cut too, other gzip files are read as one range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a file that one task reads, bases that a row holds at most, bytes read at once, and ranges whose sums may be broadcast.
RANGE, PIECE, READ, FEW = 64 << 20, 16_384, 1 << 20, 50_000
SPACE = b" \t\r\n\v\f"
UPPER = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PLAIN, GZIP, BLOCKS = range(3)


def block_size(head: bytes) -> int | None:
    """Bytes of the gzip block that begins here; None if none begins here or it doesn't name its size."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def kind_of(head: bytes) -> int:
    return PLAIN if head[:2] != b"\x1f\x8b" else GZIP if block_size(head) is None else BLOCKS


def _members(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The text of a gzip file, of one member or several, in pieces of bounded size."""
    inflate = zlib.decompressobj(31)
    for part in parts:
        while part:
            if inflate.eof:
                part = part.lstrip(b"\0")  # padding after a member
                if not part:
                    break
                inflate = zlib.decompressobj(31)
            text = inflate.decompress(part, READ)
            part = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if text:
                yield text
    if not inflate.eof:
        raise EOFError("the gzip file ends within a member")


def _first_block(file, start: int, size: int) -> int:
    """Where the first block at or after ``start`` begins; the file's end if none does. A block counts if another, or the end, follows it."""
    file.seek(start)
    held = file.read(1 << 18)  # a block has 64 KiB at most
    at = held.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        long = block_size(held[at : at + 512])
        if long and (start + at + long == size or block_size(held[at + long : at + long + 512])):
            return start + at
        at = held.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def texts(path: str, size: int, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """(text, whether it is the range's own) of bytes [start, end) of a file and, as long as more is asked for, of what follows them."""
    place, path = (fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)) if path[:1] == "/" or path.startswith("file:") else fs.FileSystem.from_uri(path)
    with place.open_input_file(path) as file:
        kind = kind_of(file.read(512))
        if kind == PLAIN:
            file.seek(start)
            while part := file.read(min(READ, end - start) if start < end else READ):
                yield part, start < end
                start += len(part)
        elif kind == GZIP and start == 0:
            file.seek(0)
            yield from ((text, True) for text in _members(iter(lambda: file.read(READ), b"")))
        elif kind == BLOCKS:
            at = _first_block(file, start, size)
            while at < size:
                file.seek(at)
                long = block_size(file.read(512))
                if not long:
                    raise ValueError(f"no gzip block at byte {at} of {path}")
                file.seek(at)
                yield zlib.decompress(file.read(long), 31), at < end
                at += long


class Reader:
    """Walks over one range. ``pieces`` yields (record, lead, at, bases): record 0 is the one that the range starts in; lead: within the first,
    broken line; at: bases of the record before these, in this range (after the first line for record 0). The sums are right afterwards."""

    def __init__(self, parts: Iterator[tuple[bytes, bool]], first: bool, most: int | None = None):
        self.parts, self.most = parts, most  # most: stop after so many headers with an id
        self.ids: list[str] = []
        self.lead = self.rest = self.tail = 0  # bases of the first line, of record 0 after it, of the last record that begins here
        self.known = first  # whether the kind of the line at the range's end is known
        self.in_header = False  # whether the next range starts within a header line

    def header(self, text: bytes) -> None:
        words = text.split(None, 1)
        self.ids.append(words[0].decode("utf-8", "replace") if words else "")
        self.tail = 0

    def pieces(self) -> Iterator[tuple[int, bool, int, bytes]]:
        kind, fresh, held = ("bases", True, b"") if self.known else ("lead", False, b"")  # fresh: a line begins here
        for buffer, own in self.parts:
            if not own:
                if kind == "bases" and fresh and buffer[:1] == b">":
                    kind, buffer = "header", buffer[1:]
                if kind != "header":
                    break
                self.in_header = True
                line, found, _ = buffer.partition(b"\n")
                held += line
                if found:
                    break
                continue
            at = 0
            while at < len(buffer):
                if kind == "header":
                    stop = buffer.find(b"\n", at)
                    held += buffer[at : stop if stop >= 0 else len(buffer)]
                    if stop < 0:
                        break
                    self.header(held)
                    kind, held, at, fresh = "bases", b"", stop + 1, True
                    if self.most is not None and sum(map(bool, self.ids)) >= self.most:
                        return
                elif kind == "bases" and fresh and buffer[at : at + 1] == b">":
                    kind, at = "header", at + 1
                else:
                    stop = buffer.find(b"\n" if kind == "lead" else b"\n>", at)
                    stop = len(buffer) if stop < 0 else stop + 1
                    fresh = buffer[stop - 1 : stop] == b"\n"
                    yield from self.bases(buffer[at:stop].translate(UPPER, SPACE), kind == "lead")
                    if kind == "lead" and fresh:
                        kind, self.known = "bases", True
                    at = stop
        if kind == "header":
            self.in_header = True
            self.header(held)

    def bases(self, text: bytes, lead: bool) -> Iterator[tuple[int, bool, int, bytes]]:
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            name = "lead" if lead else "tail" if self.ids else "rest"
            yield len(self.ids), lead, getattr(self, name), piece
            setattr(self, name, getattr(self, name) + len(piece))


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, int]:
    """(_file, _size, _range, _start, _end) of the files, and how many there are. Only the files' lengths are read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), F.col("length").alias("_size")).where("_size > 0")
    count = files.agg(F.sum(F.ceil(F.col("_size") / size))).first()[0] or 0
    cut = files.select("_file", "_size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_size") / size) - 1)).alias("_range"))
    cut = cut.select("_file", "_size", "_range", (F.col("_range") * size).alias("_start"), F.least("_size", (F.col("_range") + 1) * size).alias("_end"))
    return cut.repartition(max(1, int(count))), int(count)


def _walk(cut: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make`` yields, as lists of Arrow columns, for every range."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for columns in make(row):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return cut.mapInArrow(run, schema)


def _sums(row):
    reader = Reader(texts(row["_file"], row["_size"], row["_start"], row["_end"]), row["_range"] == 0)
    for _ in reader.pieces():
        pass
    last = reader.ids[-1] if reader.ids else None
    known = reader.in_header if reader.known or reader.in_header else None
    yield [[v] for v in (row["_file"], row["_range"], reader.lead, reader.rest, known, len(reader.ids), last, reader.tail)]


def _headers(most):
    def make(row):
        reader = Reader(texts(row["_file"], row["_size"], row["_start"], row["_end"]), row["_range"] == 0, most)
        for _ in reader.pieces():
            pass
        if reader.ids:
            n = len(reader.ids)
            yield [[row["_file"]] * n, [row["_range"]] * n, list(range(1, n + 1)), reader.ids]

    return make


def _pieces(names):
    def make(row):
        reader = Reader(texts(row["_file"], row["_size"], row["_start"], row["_end"]), row["_range"] == 0)
        held = []
        for record, lead, at, bases in reader.pieces():
            seq_id = reader.ids[-1] if record else None
            if record and names is not None and seq_id not in names:
                continue
            held.append((row["_file"], row["_range"], record, seq_id, lead, at, bases.decode("ascii", "replace")))
            if len(held) == 64:
                yield list(zip(*held, strict=True))
                held = []
        if held:
            yield list(zip(*held, strict=True))

    return make


def from_fasta_ranges(spark: SparkSession, path: str, names: list[str] | None = None, max_records: int | None = None, size: int = RANGE) -> DataFrame:
    """(seq_id, record, pos, bases): the sequences of FASTA files, compressed or not, in rows of PIECE bases at most; pos is that of the first base.

    ``contigs.chunks`` and what is built on it take these rows in place of whole sequences. The id is the header's first word; bases are
    upper case, without white space; text before the first header and records without an id are left out. ``record`` names one record, so
    that an id that comes twice stays apart. names: only these records. max_records: only the first so many of them, by file and place.
    The files are read twice (sums of each range, then bases). Their file system is one that pyarrow opens (local or shared folders, HDFS,
    object stores); elsewhere ``contigs.from_fasta`` reads by Spark's own reader.
    """
    cut, count = ranges(spark, path, size)
    sums = _walk(cut, "_file string, _range long, lead long, rest long, known boolean, headers long, last string, tail long", _sums)
    before = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_inside", F.coalesce(F.last("known", ignorenulls=True).over(before), F.lit(False)))
    sums = sums.withColumn("_all", F.sum(F.col("rest") + F.when(F.col("_inside"), 0).otherwise(F.col("lead"))).over(upto))
    began = F.when(F.col("headers") > 0, F.struct("last", "_range", "headers", (F.col("tail") - F.col("_all")).alias("less")))
    sums = sums.withColumn("_began", F.last(began, ignorenulls=True).over(before)).withColumn("_so_far", F.coalesce(F.sum(F.col("rest") + F.when(F.col("_inside"), 0).otherwise(F.col("lead"))).over(before), F.lit(0)))
    carried = sums.select("_file", "_range", "_inside", F.col("_began.last").alias("_id"), F.col("_began._range").alias("_from"), F.col("_began.headers").alias("_nth"), (F.col("_so_far") + F.col("_began.less")).alias("_done"), F.when(F.col("_inside"), 0).otherwise(F.col("lead")).alias("_first"))
    pieces = _walk(cut, "_file string, _range long, _record long, _own string, _lead boolean, _at long, bases string", _pieces(None if names is None else frozenset(names)))
    rows = pieces.join(F.broadcast(carried) if count <= FEW else carried, ["_file", "_range"])
    led = F.col("_record") == 0
    rows = rows.where(~(F.col("_lead") & F.col("_inside"))).select(
        F.when(led, F.col("_id")).otherwise(F.col("_own")).alias("seq_id"),
        F.struct(F.col("_file").alias("file"), F.when(led, F.col("_from")).otherwise(F.col("_range")).alias("range"), F.when(led, F.col("_nth")).otherwise(F.col("_record")).alias("nth")).alias("record"),
        (F.col("_at") + F.when(led, F.col("_done") + F.when(F.col("_lead"), 0).otherwise(F.col("_first"))).otherwise(0)).alias("pos"),
        "bases",
    ).where("seq_id <> ''")
    if names is not None:
        rows = rows.where(F.col("seq_id").isin(names))
    if max_records is not None:
        heads = _walk(cut, "file string, range long, nth long, seq_id string", _headers(max_records if names is None else None)).where("seq_id <> ''")
        heads = heads if names is None else heads.where(F.col("seq_id").isin(names))
        kept = heads.orderBy("file", "range", "nth").limit(max_records).select(F.struct("file", "range", "nth").alias("record"))
        rows = rows.join(kept, "record", "left_semi").select("seq_id", "record", "pos", "bases")
    return rows
