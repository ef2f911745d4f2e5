"""Balanced label propagation: linked documents move to one shard, sizes stay even.

Documents are linked where they share a hub (for the query: their text). A hub of any size
is looked at only through its histogram over shards, 40 counts at most, never through its
pairs. In each round every linked document looks up its hub's histogram in a join and asks
to move towards the shard where most of its neighbours are; a shard grants requests up to
its quota. Unlinked documents fill what is left, so that in the end the shards' row counts
differ by one at most.

Null texts have size 16, crc 0 and are linked with nothing, as are documents with a null
hub. Repeated rows are rows of their own, linked by their text. Texts of any length count
with all their bytes. Ties between shards go to the lower one, between rows to the order in
which they lie. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, save, spread

#: Rows of one hub that one join key carries at most.
HUB_ROWS = 20_000


def _shard_of(rank: Column, starts: list[int]) -> Column:
    """The shard whose stretch of ranks holds ``rank``; ``starts`` is one number a shard."""
    return F.size(F.filter(F.array(*map(F.lit, starts[1:])), lambda s: s <= rank))


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """``linked`` (row, hub, size of the hub) with a shard for each row; about ``quota`` rows
    a shard at most."""
    state = save(
        linked.select(
            "row", "hub",
            spread(shards, "row").alias("shard"),
            F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.ceil(F.col("_size") / HUB_ROWS)).cast("long")).alias("salt"),
        ),
        "shards",
    )
    for turn in range(rounds):
        held = {r[0]: r[1] for r in state.groupBy("shard").count().collect()}  # one row a shard
        cells = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        by_size = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "shard")))
        hubs = cells.groupBy("hub").agg(by_size.alias("cells"), F.sum("n").alias("size"))
        # The hub's documents meet in its fullest cells, as many as it needs.
        targets = F.slice("cells", 1, F.ceil(F.col("size") / quota).cast("int"))
        salts = F.greatest(F.lit(1), F.ceil(F.col("size") / HUB_ROWS)).cast("long")
        plan = hubs.select("hub", "size", targets.alias("targets"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        goal = F.get("targets", F.pmod(F.xxhash64("row", F.lit(turn)), F.size("targets")).cast("int"))["shard"]
        there = F.exists("targets", lambda t: t["shard"] == F.col("shard"))
        wanted = state.join(plan, ["hub", "salt"]).withColumn("goal", F.when(there, F.col("shard")).otherwise(goal))
        asked = {r[0]: r[1] for r in wanted.where("goal <> shard").groupBy("goal").count().collect()}
        if not asked:
            break
        granted = [min(1.0, max(0, quota - held.get(s, 0)) / asked[s]) if s in asked else 0.0 for s in range(shards)]
        # Small hubs move whole, large ones by document.
        whole = F.when(F.col("size") * 20 <= quota, F.xxhash64("hub", F.lit(turn))).otherwise(F.xxhash64("row", F.lit(turn)))
        lucky = F.pmod(whole, F.lit(1 << 20)) < F.get(F.array(*map(F.lit, granted)), F.col("goal")) * (1 << 20)
        moved = save(wanted.select("row", "hub", F.when(lucky, F.col("goal")).otherwise(F.col("shard")).alias("shard"), "salt"), "shards")
        discard(state)
        state = moved
    return state


def shard_documents(docs: DataFrame, hub: Column, shards: int = 40, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard and a slot for every row; row counts of shards differ by one at most.

    ``hub`` is the column expression whose equal values link documents.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            hub.alias("hub"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "slim",
    )
    total = slim.count()
    wide = max(1, total // 5_000)
    common = slim.where("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("_size")).where("_size > 1")
    linked = slim.select("row", "hub").join(common, "hub")
    state = propagate(linked, shards, max(1, total // shards), rounds)
    quota = [total * (s + 1) // shards - total * s // shards for s in range(shards)]

    kept = ["doc_id", "size", "text_crc32", "row"]
    placed = numbered(state.join(slim.select(*kept), "row"), ["shard"], ["row"], spread(wide, "row"), "slot")
    placed = save(placed.select(*kept, "shard", "slot"), "placed")
    limit = F.get(F.array(*map(F.lit, quota)), F.col("shard"))
    inside = placed.where(F.col("slot") < limit)
    counts = {r[0]: r[1] for r in inside.groupBy("shard").count().collect()}  # one row a shard
    over = placed.where(F.col("slot") >= limit).select(*kept)
    rest = slim.join(placed.select("row"), "row", "left_anti").select(*kept).unionByName(over)
    starts, at = [], 0
    for s in range(shards):
        starts.append(at)
        at += quota[s] - counts.get(s, 0)
    filled = numbered(save(rest, "rest"), [], ["row"], spread(wide, "row"), "rank").withColumn("shard", _shard_of(F.col("rank"), starts))
    first = F.get(F.array(*[F.lit(counts.get(s, 0) - starts[s]) for s in range(shards)]), F.col("shard"))
    filled = filled.select(*kept, "shard", (F.col("rank") + first).cast("long").alias("slot"))
    return inside.unionByName(filled).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def text_hub(text_col: str = "text") -> Column:
    """Links documents of equal texts."""
    return F.md5(F.col(text_col))
