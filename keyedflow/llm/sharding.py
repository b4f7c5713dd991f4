"""Balanced label propagation: linked documents move to their neighbours' shards.

Documents that have a link start in a shard by hash and then, round by round, ask to move to
the shard that most of their neighbours are in. Every shard has a quota, and of the requests
for a shard only the share that fits is granted. Documents without links are dealt last, so
that they fill every shard to its exact size; where linked documents overfill a shard, the
last of them by group are dealt with these.

The law is ``rows``: the numbers of rows of two shards differ by at most one.

Defined results: null texts count as empty, and all empty texts are one group. Repeated rows
are rows of their own, linked by their text. Null ids are kept. An empty table gives an empty
result; shards may be empty when there are fewer rows than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import in_order, store, table, text_of

ROUNDS = 5


def links_of_equals(rows: DataFrame) -> DataFrame:
    """A star for each group: every row and the smallest row of its group, in both directions."""
    hubs = rows.groupBy("group").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaves = rows.select("row", "group").join(hubs, "group").where("row <> hub")
    ends = F.array(F.struct(F.col("row").alias("a"), F.col("hub").alias("b")), F.struct(F.col("hub").alias("a"), F.col("row").alias("b")))
    return leaves.select(F.inline(ends))


def propagate(links: DataFrame, capacity: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``(row, shard)`` of every row that has a link.

    In the first and then every other round a row that has no smaller neighbour waits, since
    two neighbours that swap shards at once would never meet.
    """
    links = store(links)
    of_row = links.groupBy(F.col("a").alias("row")).agg((F.min("b") > F.col("a")).alias("least"))
    labels = store(of_row.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    for turn in range(rounds):
        votes = links.join(labels.select(F.col("row").alias("b"), "shard"), "b").groupBy("a", "shard").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("a").alias("row")).agg(
            F.max(F.struct("n", (-F.col("shard")).alias("order"))).alias("best"),
            F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by_shard"),
        )
        here = F.coalesce(F.element_at("by_shard", F.col("shard")), F.lit(0))
        may_move = ~F.col("least") if turn % 2 == 0 else F.lit(True)
        wish = F.when(may_move & (F.col("best.n") > here), -F.col("best.order"))
        asked = labels.join(best, "row").select("row", "least", "shard", wish.alias("wish"))
        # Eight numbers or so: one for each shard.
        there = labels.groupBy("shard").count()
        wanted = asked.where("wish is not null").groupBy("wish").agg(F.count(F.lit(1)).alias("asking"))
        room = wanted.join(there, wanted["wish"] == there["shard"], "left").select(
            "wish", (F.greatest(F.lit(capacity) - F.coalesce("count", F.lit(0)), F.lit(0)) / F.col("asking")).alias("share")
        )
        chance = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
        granted = F.col("share").isNotNull() & (chance < F.col("share"))
        moved = asked.join(F.broadcast(room), "wish", "left").select(
            "row", "least", F.when(granted, F.col("wish")).otherwise(F.col("shard")).alias("shard"), granted.alias("moved")
        )
        moved = store(moved)
        labels = moved.drop("moved")
        if turn % 2 == 1 and moved.where("moved").isEmpty():
            break
    return labels.drop("least")


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (which has a unique ``row`` and a ``group``) with shard and slot.

    ``links`` (a, b) holds each link in both directions.
    """
    n = rows.count()
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    labels = propagate(links, n // shards, shards, rounds)
    linked = rows.select("row", "group").join(labels, "row")
    taken = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}
    if any(taken.get(s, 0) > sizes[s] for s in range(shards)):
        # Rows of a group stand together, so that few groups are cut by the end of a shard.
        placed = in_order(store(linked), "shard", F.xxhash64("group"), "row")
        first, starts = 0, []
        for s in range(shards):
            starts.append(first)
            first += taken.get(s, 0)
        at = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1)
        size = F.element_at(F.array(*[F.lit(x).cast("long") for x in sizes]), F.col("shard") + 1)
        labels = store(placed.where(F.col("pos") - at < size).select("row", "shard"))
    kept = [min(taken.get(s, 0), sizes[s]) for s in range(shards)]

    free = rows.select("row").join(labels, "row", "left_anti").withColumn("order", F.xxhash64("row"))
    free = in_order(store(free), "order", "row")
    end, ends = 0, []
    for s in range(shards):
        end += sizes[s] - kept[s]
        ends.append(end)
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("pos")))
    every = labels.unionByName(free.select("row", shard.alias("shard")))

    slots = in_order(store(every), "shard", "row")
    starts = F.array(*[F.lit(sum(sizes[:s])).cast("long") for s in range(shards)])
    slots = slots.withColumn("slot", F.col("pos") - F.element_at(starts, F.col("shard") + 1)).drop("pos")
    return rows.join(slots, "row")


def op5_balanced_shards(spark, sf_dir: str) -> DataFrame:
    text = text_of()
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = store(rows)
    out = balanced_shards(rows, links_of_equals(rows))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
