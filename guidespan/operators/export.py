"""Lines of the export formats. Writing them is ``write.text``; tables go out by ``write.csv`` or ``write.parquet``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidespan.functions import formats


def bed(rows: DataFrame, name: str, score: str = "0") -> DataFrame:
    """(line) of rows with seq_id, start, end and strand. A start below 0 is 0; a strand other than plus or minus is a dot."""
    strand = F.when(F.col("strand").isin("+", "plus"), "+").when(F.col("strand").isin("-", "minus"), "-").otherwise(".")
    return rows.select(F.concat_ws("\t", F.col("seq_id").cast("string"), F.greatest("start", F.lit(0)).cast("string"), F.col("end").cast("string"), F.col(name).cast("string"), F.lit(score), strand).alias("line"))


def fasta(rows: DataFrame, name: str, sequence: str) -> DataFrame:
    """(line) of two lines a record; empty sequences are left out."""
    return rows.where(F.coalesce(F.length(sequence), F.lit(0)) > 0).select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(sequence)).alias("line"))


def without_blank_columns(rows: DataFrame) -> DataFrame:
    """Rows without the columns that are null or white space in every row: one aggregate decides."""
    if not rows.columns:
        return rows
    held = rows.agg(*(F.max(F.trim(F.col(c).cast("string")) != "").alias(c) for c in rows.columns)).first()
    return rows.select([c for c in rows.columns if held[c]])


def first_name(rows: DataFrame, *names: str, prefix: str = "candidate_", number: str | None = None) -> Column:
    """The first of these columns that is not blank, or else the prefix and the row's number."""
    held = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*held, *([F.concat(F.lit(prefix), F.col(number).cast("string"))] if number else []), F.lit(""))


def delimited(rows: DataFrame, decimals: int = 2, separator: str = "\t") -> DataFrame:
    """(line) of all columns, formatted; text with a separator, a quote or a line end is quoted. The header is ``rows.columns``."""
    quoted = lambda c: F.when(F.col(c).rlike(f'[{separator}"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return formats.shown(rows, decimals).select(F.concat_ws(separator, *map(quoted, rows.columns)).alias("line"))


def score_bed(rows: DataFrame, name: str, specificity: str, start: str = "motif_pos", sequence: str = "sequence") -> DataFrame:
    """(line) of BED with one over the specificity as score, six decimals."""
    score = F.format_string("%.6f", 1.0 / F.greatest(F.col(specificity), F.lit(1e-12)))
    strand = F.when(F.col("strand").isin("plus", "+"), "+").otherwise("-")
    return rows.select(F.concat_ws("\t", F.col("seq_id").cast("string"), F.col(start).cast("string"), (F.col(start) + F.length(sequence)).cast("string"), F.col(name).cast("string"), score, strand).alias("line"))


def library(sites: DataFrame) -> DataFrame:
    """(qid, sequence, positions): one row a sequence of sites (qid, sequence, seq_id, strand, start), its places as a JSON list in order."""
    text_ids = dict(sites.dtypes)["seq_id"] == "string"
    place = F.struct("seq_id", "strand", "start")
    rows = sites.where(F.coalesce(F.length("sequence"), F.lit(0)) > 0).groupBy("sequence").agg(F.min("qid").alias("qid"), F.array_sort(F.collect_list(place)).alias("_all"))
    return rows.select("qid", "sequence", formats.places_json(F.col("_all"), text_ids).alias("positions"))


def unique_guides(rows: DataFrame, sequence: str, name: str) -> DataFrame:
    """(query_id, query_seq, occurrence_count): each sequence once, by its least name."""
    return rows.where(F.coalesce(F.length(sequence), F.lit(0)) > 0).groupBy(F.col(sequence).alias("query_seq")).agg(F.min(name).alias("query_id"), F.count("*").alias("occurrence_count")).select("query_id", "query_seq", "occurrence_count")


def hit_json(hits: DataFrame) -> DataFrame:
    """(line) of a JSON object a hit (normalised), the bitscore with two decimals."""
    text = lambda c: F.to_json(F.array(F.col(c).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c).cast("string")))) - 2)
    names = ("qid", "guide", "target", "start", "strand", "mismatch", "indel", "rna_bulges", "dna_bulges", "pam", "bitscore", "target_start", "target_end", "query_start", "query_end", "cigar", "aligned_guide", "aligned_target", "engine")
    whole = {"start", "mismatch", "indel", "rna_bulges", "dna_bulges", "target_start", "target_end", "query_start", "query_end"}
    value = lambda c: F.col(c).cast("string") if c in whole else F.format_string("%.2f", c) if c == "bitscore" else text(c)
    parts = [F.lit('{"type":"hit"')] + [F.concat(F.lit(f',"{c}":'), value(c)) for c in names]
    return hits.select(F.concat(*parts, F.lit("}")).alias("line"))


def flank_fasta(hits: DataFrame, flanks: DataFrame) -> DataFrame:
    """(seq_id, qid, line): the flank beside every perfect hit, two lines each; write it partitioned by seq_id and qid.

    hits: normalised, with seq_id's name as target; flanks: (target, start, strand, flank).
    """
    rows = hits.where((F.col("mismatch") == 0) & (F.col("indel") == 0)).join(flanks, ["target", "start", "strand"]).where(F.length("flank") > 0)
    return rows.select(F.col("target").alias("seq_id"), "qid", F.concat(F.lit(">"), F.concat_ws(":", "qid", F.col("target").cast("string"), F.col("start").cast("string"), "strand"), F.lit("\n"), F.col("flank")).alias("line"))


def write_by(lines: DataFrame, path: str, by: list[str], most_lines: int = 1_000_000) -> None:
    """Write (by..., line) as text with one folder for each value of ``by``.

    Rows are dealt by these columns first, so a folder gets one file, and a further one after so many lines. Each task moves its own files
    to their folders, as the driver would move all of them one by one.
    """
    lines.repartition(*by).write.option("maxRecordsPerFile", most_lines).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)


def read_by(folders: DataFrame, path: str) -> DataFrame:
    """The folders' columns and (line) of all lines in them, of what ``write_by`` wrote by these columns; an error if a folder is missing.

    Tasks list and read the folders that their rows name, so the driver lists none. Their file system is one that pyarrow opens.
    """
    by = folders.columns
    # As Spark writes them: these characters, control ones and DEL as hexadecimal; null and empty by a name of their own.
    special = r'[\x01-\x1f\x7f"#%\'*/:=?\\{\[\]^]'
    schema = T.StructType([*folders.schema.fields, T.StructField("line", T.StringType())])

    def name(value) -> str:
        return "__HIVE_DEFAULT_PARTITION__" if value in (None, "") else re.sub(special, lambda m: f"%{ord(m[0]):02X}", str(value))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = (fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)) if path[:1] == "/" or path.startswith("file:") else fs.FileSystem.from_uri(path)
        for batch in batches:
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
                folder = "/".join([root, *(f"{c}={name(v)}" for c, v in zip(by, row, strict=True))])
                for info in place.get_file_info(fs.FileSelector(folder)):
                    if info.base_name[:1] not in "._":
                        with place.open_input_stream(info.path, compression=None) as file:
                            lines = file.read().decode().removesuffix("\n").split("\n") if info.size else []
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array([i] * len(lines), pa.int64())) for c in by), pa.array(lines, pa.string())], schema.names)

    return folders.mapInArrow(run, schema)


def annotation_lines(features: DataFrame, source: str = "inferred") -> DataFrame:
    """(value) of annotation lines of (seq_id, type, start, end, strand, transcript_id), places from 1 with both ends."""
    return features.select(F.concat_ws("\t", F.col("seq_id").cast("string"), F.lit(source), "type", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("Parent="), F.col("transcript_id"))).alias("value"))
