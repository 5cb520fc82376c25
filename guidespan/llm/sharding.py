"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring. A row starts at the cell of its hash and goes to the next point clockwise; a shard
that is full passes the row on to the next point. With capacities that add up to the number of rows, counts differ by one at most
(the law ``rows``), and a change of the shard count moves few rows beyond those that balance asks for.

Spark counts the rows of each cell of the ring (a fixed number of cells), the driver lets these counts flow round the ring, which
gives a few thousand segments of ranks, and the rows then look up their segment. Only rows of one cell are ever ordered together.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidespan.llm.common import cut

CELL_BITS = 12


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The points of the ring, (position in 64 bits, shard), clockwise."""
    return sorted((int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(vnodes))


def flow(counts: dict[int, int], shards: int, vnodes: int, cell_bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, from rank, to rank, shard, slot of the first) that the counts of the cells make.

    Ranks count the rows of a cell from 0. In the first round each cell fills its own shard, in the order of the ring; what a full
    shard leaves over goes on clockwise, again in the order of the ring. Capacities are the row count over the shards, one more for
    the first shards if it doesn't divide.
    """
    total, points = sum(counts.values()), ring(shards, vnodes)
    places = [p for p, _ in points]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def take(cell: int, first: int, last: int, shard: int) -> int:
        n = min(last - first, room[shard])
        if n:
            out.append((cell, first, first + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return first + n

    for cell in sorted(counts):
        at = bisect.bisect_left(places, cell << (64 - cell_bits)) % len(points)
        first = take(cell, 0, counts[cell], points[at][1])
        if first < counts[cell]:
            over.append((cell, first, counts[cell], at))
    for cell, first, last, at in over:
        while first < last:
            at = (at + 1) % len(points)
            first = take(cell, first, last, points[at][1])
    return out


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, size, text_crc32, shard and slot (0, 1, ... in each shard) of every row.

    size is the UTF-8 length plus 8. Null and empty texts count 0 bytes; a null id is a key like any other. Repeated rows are
    rows of their own, counted before they are shuffled; which copy gets which slot makes no difference. An empty table gives an
    empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 8).alias("_size"), F.crc32(text.cast("binary")).cast("long").alias("_crc"))
    rows = rows.groupBy("_id", "_size", "_crc").agg(F.count("*").alias("_n"))
    rows = cut(rows.withColumn("_hash", F.xxhash64("_id", "_size", "_crc")).withColumn("_cell", F.shiftrightunsigned("_hash", 64 - CELL_BITS).cast("int")))
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()}  # 2**CELL_BITS rows at most
    segments = rows.sparkSession.createDataFrame(flow(counts, shards, vnodes), "_cell int, _from long, _to long, shard int, _slot long")
    before = Window.partitionBy("_cell").orderBy("_hash", "_id", "_size", "_crc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = ranked.join(F.broadcast(segments), "_cell").where("_from < _first + _n and _to > _first")
    spread = met.withColumn("_rank", F.explode(F.sequence(F.greatest("_from", "_first"), F.least("_to", F.col("_first") + F.col("_n")) - 1)))
    return spread.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))
