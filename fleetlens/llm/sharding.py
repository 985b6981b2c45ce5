"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``2**CELL_BITS`` cells. A row falls into a cell by the hash of its key and belongs to the shard of
the first virtual node clockwise. Shards take rows in ring order up to their capacity; what overflows walks on clockwise,
node by node, to the first shard with room. With ``slack=0`` the capacities add up to the number of rows, so counts differ
by one at most; with more slack fewer rows move. Only counts by cell reach the driver: a fixed number, whatever the input.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetlens.llm.common import stored, text_of

CELL_BITS = 14
VIRTUAL_NODES = 64
_PIECE = T.StructType(
    [
        T.StructField("cell", T.IntegerType()),
        T.StructField("first_rank", T.LongType()),
        T.StructField("end_rank", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("first_slot", T.LongType()),
    ]
)


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    nodes = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.sha256(f"{shard}/{node}".encode()).digest()
            nodes.append((int.from_bytes(digest[:8], "big") >> (64 - CELL_BITS), shard))
    return sorted(nodes)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """How many rows each shard may hold."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def place(counts: dict[int, int], shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple]:
    """Pieces (cell, first rank, end rank, shard, first slot) from the rows counted in each cell."""
    nodes = ring(shards, virtual_nodes)
    room = capacities(sum(counts.values()), shards, slack)
    filled = [0] * shards
    waiting, at = [], 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting.append((cell, 0, counts[cell], at % len(nodes)))
    pieces = []
    while waiting:
        overflow = []
        for cell, rank, rows, node in waiting:
            while room[nodes[node][1]] == filled[nodes[node][1]]:
                node = (node + 1) % len(nodes)
            shard = nodes[node][1]
            taken = min(rows, room[shard] - filled[shard])
            pieces.append((cell, rank, rank + taken, shard, filled[shard]))
            filled[shard] += taken
            if taken < rows:
                overflow.append((cell, rank + taken, rows - taken, (node + 1) % len(nodes)))
        waiting = overflow
    return pieces


def shard_rows(
    docs: DataFrame, shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot.

    The key is the id, or the text where the id is null; a null text counts as empty for size and checksum. Rows alike in
    id, size and checksum are counted before the shuffle and spread again at the end, so a row repeated any number of times
    costs one row per task. Slots of a shard run from 0 without gaps. An empty table gives an empty table; other columns
    are ignored.
    """
    text = text_of(text_col)
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("text"), text)).otherwise(F.xxhash64(F.col(id_col)))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("_key"),
    )
    alike = narrow.groupBy("doc_id", "size", "text_crc32", "_key").agg(F.count(F.lit(1)).alias("_rows"))
    cell = F.shiftrightunsigned("_key", 64 - CELL_BITS).cast("int")
    alike = stored(alike.withColumn("_cell", cell), "shard")
    counts = {r["_cell"]: r["n"] for r in alike.groupBy("_cell").agg(F.sum("_rows").alias("n")).collect()}
    pieces = alike.sparkSession.createDataFrame(place(counts, shards, slack, virtual_nodes), _PIECE)
    in_ring_order = Window.partitionBy("_cell").orderBy("_key", "doc_id", "size", "text_crc32")
    ranked = alike.withColumn("_end", F.sum("_rows").over(in_ring_order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_end") - F.col("_rows"), F.col("_end") - 1)))
    # at most 2**CELL_BITS cells plus one split per shard: a fixed bound of a few hundred KB
    here = (F.col("_cell") == F.col("cell")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    return ranked.join(F.broadcast(pieces), here).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("_rank") - F.col("first_rank")).alias("slot")
    )
