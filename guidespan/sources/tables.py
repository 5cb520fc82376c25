"""Tables of guides, candidates and hits in delimited files with free headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guidespan.functions import formats
from guidespan.operators.ordinals import numbered

#: The columns of tabular hits, and the names that an id and a sequence go by.
HIT_COLUMNS = ("qid", "seq_id", "identity", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore", "qseq", "sseq")
ID_NAMES, GUIDE_NAMES = ("qid", "id", "seq_id"), ("guide_seq", "spacer_seq")


def read(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A delimited table with a header as text columns; lines that begin with # are left out, quoted fields are unquoted."""
    return spark.read.csv(path, sep=separator, header=True, comment="#", quote='"', escape='"', mode="PERMISSIVE")


def remarks(spark: SparkSession, path: str) -> dict[str, str]:
    """What the comment lines of a table say, as key=value words."""
    words = spark.read.text(path).where("value like '#%'").select(F.explode(F.split(F.regexp_replace("value", "^#+", ""), r"\s+")).alias("w")).where("w like '%=%'")
    return {r["k"]: r["v"] for r in words.select(F.substring_index("w", "=", 1).alias("k"), F.expr("substring(w, instr(w, '=') + 1)").alias("v")).distinct().limit(1000).collect()}  # settings, not data


def _first(rows: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((c for c in rows.columns if c in names), None)


def guides(rows: DataFrame) -> DataFrame:
    """(qid, guide) of a table of guides: the first id column, the first sequence column; upper case, U as T.

    A row without id is guide_ and its number in the table, from 0. Rows without a sequence are left out, but counted.
    """
    own, seq = _first(rows, ID_NAMES), _first(rows, GUIDE_NAMES)
    if seq is None:
        raise ValueError("no column of guides")
    name = F.nullif(F.trim(F.col(own)), F.lit("")) if own else F.lit(None).cast("string")
    rows = rows.select(name.alias("qid"), F.translate(F.upper(F.trim(F.col(seq))), "U", "T").alias("guide"), F.monotonically_increasing_id().alias("_at"))
    rows = numbered(rows, "_n", [F.col("_at")])
    return rows.where("guide <> ''").select(F.coalesce("qid", F.concat(F.lit("guide_"), (F.col("_n") - 1).cast("string"))).alias("qid"), "guide")


def hits(rows: DataFrame) -> DataFrame:
    """Typed tabular hits of lines (value), places from 0: the plus strand where they run forwards. Lines without numbers are left out."""
    parts = F.split("value", "\t")
    at = {c: F.try_element_at(parts, F.lit(i + 1)) for i, c in enumerate(HIT_COLUMNS)}
    whole = lambda c: at[c].try_cast("long")
    forward = whole("sstart") <= whole("send")
    out = rows.where(~F.col("value").startswith("#")).select(
        at["qid"].alias("qid"), at["seq_id"].alias("seq_id"), (F.least(whole("sstart"), whole("send")) - 1).alias("start"), F.greatest(whole("sstart"), whole("send")).alias("end"), F.when(forward, "+").otherwise("-").alias("strand"),
        formats.number(at["identity"]).alias("identity"), whole("mismatch").alias("mismatch"), whole("gapopen").alias("gaps"), (whole("qstart") - 1).alias("query_start"), whole("qend").alias("query_end"), formats.number(at["evalue"]).alias("evalue"), formats.number(at["bitscore"]).alias("bitscore"), at["qseq"].alias("aligned_guide"), at["sseq"].alias("aligned_target"),
    )
    return out.where("start is not null and `end` is not null and mismatch is not null")


def collection(tables: list[DataFrame]) -> DataFrame:
    """Several tables of queries as one: all columns, null where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def units(lines: DataFrame) -> DataFrame:
    """(scope_id, pattern_id) of lines of a units table: two columns, comments and the header left out, each pair once."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(F.trim(F.get(parts, F.lit(0))).alias("scope_id"), F.trim(F.get(parts, F.lit(1))).alias("pattern_id"))
    return rows.where("scope_id <> '' and pattern_id <> '' and scope_id <> 'scope_id'").distinct()


def batch(text: Column) -> Column:
    """The groups of a batch in JSON: an array of (group_id, scope_ids, pattern_ids); null if it is none."""
    return F.from_json(text, "struct<groups:array<struct<group_id:string,scope_ids:array<string>,pattern_ids:array<string>>>>")["groups"]
