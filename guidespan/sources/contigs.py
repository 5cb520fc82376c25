"""Sequences: from FASTA and BED files or text columns, in chunks, and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guidespan.sources import scan

CHUNK = 1024


def from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 23) -> DataFrame:
    """(seq_id, seq) from the letters a, c, g and t of texts, upper case, of a least length."""
    return scan.bases(docs, id_col, text_col, shortest)


def from_fasta(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(seq_id, seq) of FASTA files, compressed or not: the id is the first word of the header; sequences are upper case.

    Each record is one row of the text reader, which splits at the header sign. names: only these records.
    """
    record = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n", 2)
    rows = record.select(F.element_at(F.split(F.trim(lines[0]), r"\s+"), 1).alias("seq_id"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), r"\s", "")).alias("seq")).where("seq_id <> ''")
    return rows if names is None else rows.where(F.col("seq_id").isin(names))


def checked(contigs: DataFrame) -> DataFrame:
    """The contigs; an error if there is none."""
    if contigs.isEmpty():
        raise ValueError("no sequence records")
    return contigs


def from_bed(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, start, end, name, strand), half-open from 0. Headers, comments and lines without numbers are left out."""
    parts = F.split("value", "\t")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)"))
    return rows.select(at(1).alias("seqid"), at(2).try_cast("long").alias("start"), at(3).try_cast("long").alias("end"), F.coalesce(F.nullif(at(4), F.lit("")), F.concat_ws(":", at(1), at(2), at(3))).alias("name"), F.when(at(6).isin("+", "-"), at(6)).otherwise("+").alias("strand")).where("start is not null and end is not null")


def chunks(contigs: DataFrame, overlap: int, size: int = CHUNK) -> DataFrame:
    """(seq_id, chunk_start, own, chunk): pieces of ``size`` bases and the ``overlap`` bases after them; ``own`` bases are its own.

    Cut in one pass over the sequence; places within a chunk are found in time of the chunk, not of the contig. Contigs that come in rows
    of their own (``fasta.from_fasta_ranges``) are never put together: each row sends its bases to the chunks that it touches.
    """
    if overlap > size:
        raise ValueError("the overlap is longer than a chunk")
    if "bases" in contigs.columns:
        return _joined(contigs, overlap, size)
    cut = contigs.select("seq_id", F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0)).alias("_parts"))
    return cut.select("seq_id", F.posexplode(F.expr(f"transform(_parts, (c, i) -> named_struct('c', c, 'n', coalesce(left(get(_parts, i + 1), {overlap}), '')))"))).select("seq_id", (F.col("pos") * size).cast("long").alias("chunk_start"), F.length("col.c").alias("own"), F.concat("col.c", "col.n").alias("chunk"))


def _joined(rows: DataFrame, overlap: int, size: int) -> DataFrame:
    """Chunks of contigs that come in rows (seq_id, record, pos, bases)."""
    end = F.col("pos") + F.length("bases")
    cells = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - overlap) / size)), F.floor((end - 1) / size))

    def part(cell: Column) -> Column:
        start = F.greatest(F.col("pos"), cell * size)
        n = F.least(end, (cell + 1) * size + overlap) - start
        return F.struct(cell.alias("cell"), F.struct(start.alias("pos"), F.substring("bases", (start - F.col("pos") + 1).cast("int"), n.cast("int")).alias("bases")).alias("part"))

    parts = rows.where("bases <> ''").select("seq_id", "record", F.explode(F.transform(cells, part)).alias("p")).select("seq_id", "record", F.col("p.cell").alias("_cell"), F.col("p.part").alias("_part"))
    # A row that only ends where the overlap of a chunk would begin sends it nothing.
    whole = parts.where(F.col("_part.bases") != "").groupBy("record", "seq_id", "_cell").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_part")), lambda p: p["bases"]), "").alias("chunk"))
    return whole.select("seq_id", (F.col("_cell") * size).cast("long").alias("chunk_start"), F.least(F.length("chunk"), F.lit(size)).alias("own"), "chunk")


def marked(contigs: DataFrame, wanted: list[tuple[int, str, tuple[int, str] | None]]) -> DataFrame:
    """(seq_id, pos, window, which): every stretch of so many bases that matches a pattern, with its place in ``wanted``.

    All of these (length, pattern, anchor) are looked for in one scan. Patterns of letters, classes and counts are matched in numpy, a batch of
    contigs at a time (``scan.places``), which cuts no chunks of contigs that are one row each. For others a pattern may come with an anchor,
    (offset, text) that each of its matches has there, so that most places are left out by comparing a few letters and only the others are
    cut out and matched.
    """

    overlap = max(length for length, _, _ in wanted) - 1
    plain = [(length, scan.runs(pattern, length)) for length, pattern, _ in wanted]
    if all(parts is not None for _, parts in plain):
        whole = "bases" not in contigs.columns
        held = contigs.select("seq_id", F.lit(0).cast("long").alias("chunk_start"), F.length("seq").alias("own"), F.col("seq").alias("chunk")).where("own > 0") if whole else chunks(contigs, overlap)
        return scan.places(held, plain)
    held = chunks(contigs, overlap)

    def matches(k: int, length: int, pattern: str, anchor: tuple[int, str] | None) -> Column:
        places = F.sequence(F.lit(0), F.col("own") - 1)
        if anchor:
            offset, text = anchor
            places = F.filter(places, lambda i: F.substring("chunk", i + (offset + 1), F.lit(len(text))) == text)
        cut = F.transform(places, lambda i: F.struct((F.col("chunk_start") + i).alias("pos"), F.substring("chunk", i + 1, F.lit(length)).alias("window"), F.lit(k).alias("which")))
        return F.filter(cut, lambda w: w["window"].rlike(f"^(?:{pattern})$"))

    found = [matches(k, *one) for k, one in enumerate(wanted)]
    return held.select("seq_id", F.explode(F.concat(*found)).alias("w")).select("seq_id", "w.pos", "w.window", "w.which")


def windows(contigs: DataFrame, length: int, pattern: str | None = None) -> DataFrame:
    """(seq_id, pos, window): every stretch of ``length`` bases (overlapping ones too), if given only those that match the pattern."""
    if pattern:
        return marked(contigs, [(length, pattern, None)]).drop("which")
    found = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.struct((F.col("chunk_start") + i).alias("pos"), F.substring("chunk", i + 1, F.lit(length)).alias("window")))
    return chunks(contigs, length - 1).select("seq_id", F.explode(F.filter(found, lambda w: F.length(w["window"]) == length)).alias("w")).select("seq_id", "w.pos", "w.window")


def fetch(rows: DataFrame, contigs: DataFrame, start: Column, end: Column, name: str, longest: int) -> DataFrame:
    """Rows (with seq_id) and the bases [start, end) of their contig, clamped to it, as column ``name``; null where that is empty.

    Looks up the chunk that holds the start, so no contig is carried along whole. No stretch may be longer than ``longest``.
    """
    held = chunks(contigs, longest).withColumnRenamed("seq_id", "_seq_id").drop("own")
    rows = rows.withColumn("_start", F.greatest(start, F.lit(0)).cast("long")).withColumn("_n", (end - F.col("_start")).cast("int"))
    rows = rows.withColumn("_chunk_start", F.col("_start") - F.col("_start") % CHUNK)
    met = rows.join(held, (F.col("seq_id") == F.col("_seq_id")) & (F.col("_chunk_start") == F.col("chunk_start")), "left")
    piece = F.when(F.col("_n") > 0, F.nullif(F.substring("chunk", (F.col("_start") - F.col("_chunk_start") + 1).cast("int"), F.col("_n")), F.lit("")))
    return met.withColumn(name, piece).drop("_start", "_n", "_chunk_start", "_seq_id", "chunk_start", "chunk")
