"""Shards from a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of places. Virtual nodes stand on places; a row's place follows from its doc_id, and the
next virtual node clockwise is its home. A full shard passes rows on to the next virtual node whose shard has
room. Which rows go where depends on the row counts of the places alone, so the driver plans with one number for each place
(a fixed number of them) and no row ever waits for another: a row finds its shard by its rank within its place.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import stored

SHARDS = 16
VIRTUAL_NODES = 128
PLACES = 1 << 16
PLAN = "place int, low long, high long, shard int, first_slot long"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, places: int = PLACES) -> dict[int, int]:
    """Place -> shard of every virtual node. A taken place sends the later node on to another hash."""
    if shards * virtual_nodes > places // 2:
        raise ValueError("too many virtual nodes for the places of the ring")
    taken: dict[int, int] = {}
    for node in range(virtual_nodes):
        for shard in range(shards):
            attempt = 0
            while True:
                digest = hashlib.md5(f"{shard}:{node}:{attempt}".encode()).digest()
                place = int.from_bytes(digest[:8], "big") % places
                if place not in taken:
                    break
                attempt += 1
            taken[place] = shard
    return taken


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: without slack exactly its share (one more for the first ``rows % shards``)."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, places: int = PLACES, slack: float = 0.0) -> list[tuple]:
    """``PLAN`` rows: ranks ``low`` to ``high`` of a place go to a shard, in slots from ``first_slot`` on.

    Homes fill first, in ring order; what does not fit moves clockwise, the rows that wait longest being placed first.
    """
    nodes = ring(shards, virtual_nodes, places)
    at = sorted(nodes)
    room = capacities(sum(counts.values()), shards, slack)
    used, out, over = [0] * shards, [], {}

    def put(place: int, low: int, n: int, shard: int) -> None:
        out.append((place, low, low + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for place in sorted(counts):
        home = nodes[at[bisect_left(at, place) % len(at)]]
        n = min(counts[place], room[home])
        if n:
            put(place, 0, n, home)
        if n < counts[place]:
            over.setdefault(bisect_left(at, place) % len(at), []).append((place, n, counts[place] - n))
    waiting: deque = deque()
    for i in range(2 * len(at) if over else 0):  # two rounds: rows that join late meet every shard
        shard = nodes[at[i % len(at)]]
        while waiting and room[shard]:
            place, low, n = waiting.popleft()
            taken = min(n, room[shard])
            put(place, low, taken, shard)
            if taken < n:
                waiting.appendleft((place, low + taken, n - taken))
        if i < len(at):
            waiting.extend(over.get(i, ()))
    return out


def assign(documents: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, places: int = PLACES, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` its CRC-32 (null: as empty). Without slack the row counts of
    two shards differ by one at most; with it no shard holds more than (1 + slack) times its share, and fewer rows move when a
    shard is added. Slots run from 0 without a gap. Repeated rows each get a slot of their own; a row without doc_id is
    placed by its text; no rows give no rows. Equal texts are not kept together: only the doc_id counts.
    Other columns are left out.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text.alias("raw"))
    rows = rows.withColumn("point", F.xxhash64(F.coalesce("doc_id", F.xxhash64("raw"))))
    rows = rows.select("doc_id", "size", "text_crc32", "point", F.pmod("point", F.lit(places)).cast("int").alias("place"))
    rows = stored(rows, "shard-rows")
    # At most one count for each place of the ring, however many rows there are.
    counts = {r.place: r.n for r in rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = spark.createDataFrame(plan(counts, shards, virtual_nodes, places, slack), PLAN)
    order = Window.partitionBy("place").orderBy("point", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("at", F.row_number().over(order).cast("long") - 1)
    # The plan has a row for each place and one more for each virtual node met by an overflow: a few megabytes at most.
    found = ranked.join(F.broadcast(steps), (ranked["place"] == steps["place"]) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("at") - F.col("low")).alias("slot"))


def by_rows(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The assignment without slack under the law ``rows``: counts at most one apart."""
    return assign(documents, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
