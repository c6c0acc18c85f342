"""Balanced label propagation: documents of equal text move to one shard, shards stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_sum, table, written

SHARDS = 24
ROUNDS = 8


def _capped(moves: DataFrame, room: DataFrame, by: str) -> DataFrame:
    """The rows of ``moves`` whose running ``n`` still fits the ``room`` of shard ``by``."""
    ranked = running_sum(moves, F.col("n"), F.xxhash64("g", "home"), ["g", "home"], [by], "_before", bits=6)
    return ranked.join(F.broadcast(room), by).where(F.col("_before") + F.col("n") <= F.col("room")).drop("_before", "room")


def propagate(units: DataFrame, quota: int, rounds: int = ROUNDS, shards: int = SHARDS) -> DataFrame:
    """Moves ``units`` (g, home, n, label) to their neighbours' shards; returns (g, home, n, label).

    A unit is the part of one group of linked documents that began on one
    shard.  In each round a unit asks for the shard, among those with room, that holds
    most of its group, if that is more than its own shard holds; of the units
    asking for a shard, as many move as its quota has room for.  Ends when no
    unit moves.
    """
    spark = units.sparkSession
    labels = spark.range(shards).select(F.col("id").cast("int").alias("label"))
    for _ in range(rounds):
        load = units.groupBy("label").agg(F.sum("n").alias("load"))
        room = labels.join(load, "label", "left").select("label", (F.lit(quota) - F.coalesce("load", F.lit(0))).alias("room"))
        held = units.groupBy("g", "label").agg(F.sum("n").alias("held"))
        open_ = held.join(F.broadcast(room), "label").where("room > 0")
        best = open_.groupBy("g").agg(F.max(F.struct("held", (-F.col("label")).alias("neg"))).alias("best")).select("g", F.col("best.held").alias("most"), (-F.col("best.neg")).alias("target"))
        asking = units.join(held, ["g", "label"]).join(best, "g").where((F.col("target") != F.col("label")) & ((F.col("most") > F.col("held")) | ((F.col("most") == F.col("held")) & (F.col("target") < F.col("label")))))
        moves = _capped(asking.select("g", "home", "n", "target"), room.withColumnRenamed("label", "target"), "target").select("g", "home", "target")
        units = written(units.join(moves, ["g", "home"], "left").select("g", "home", "n", F.coalesce("target", "label").alias("label"), F.col("target").isNotNull().alias("moved")), "labels")
        if not units.where("moved").limit(1).count():
            break
        units = units.drop("moved")
    return units.drop("moved")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Puts every row into one of ``shards`` shards whose row counts differ by one at most.

    Linked documents are those of equal text.  They start where a hash of their
    id puts them, and move to the shard of their group by label propagation
    under quotas; a group larger than a shard spreads over several.  Documents
    without links fill the shards to equal counts.  A null text has no links,
    size 8 and checksum 0; an empty text is a text.  A null id has a place like
    any other; repeated rows are placed one by one, in any order among
    themselves.  Long texts count by their bytes only; other columns are not
    looked at, whatever they are called.  An empty table gives no rows.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.when(F.col(text_col).isNotNull(), F.xxhash64(text)).alias("g"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("home")), F.lit(shards)).cast("int").alias("home"),
    )
    rows = written(rows, "rows")
    total = rows.count()
    quota = total // shards
    linked = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    parts = rows.where("g is not null").groupBy("g", "home").agg(F.count("*").alias("n"))
    units = written(parts.join(linked, "g", "left_semi").withColumn("label", F.col("home")), "units")
    units = propagate(units, quota, rounds, shards)
    # What a shard holds beyond its quota loses its place, so that counts come out even.
    room = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("label"), F.lit(quota).alias("room"))
    units = written(_capped(units, room, "label").select("g", "home", "label"), "placed")
    placed = written(rows.join(units, ["g", "home"], "left"), "placed")
    load = placed.where("label is not null").groupBy("label").agg(F.count("*").alias("load"))
    # Shards below total % shards take one row more.
    want = room.join(load, "label", "left").select("label", (F.lit(quota) + (F.col("label") < total % shards).cast("int") - F.coalesce("load", F.lit(0))).alias("want"))
    ends = want.withColumn("hi", F.sum("want").over(Window.partitionBy(F.lit(0)).orderBy("label"))).select(F.col("label").alias("to"), (F.col("hi") - F.col("want")).alias("lo"), "hi")
    free = running_sum(placed.where("label is null"), F.lit(1), F.xxhash64("id", "crc"), ["id", "crc"], [], "rank")
    bounds = F.broadcast(ends.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "to"))).alias("bounds")))  # one row of 24 entries
    free = free.crossJoin(bounds).withColumn("label", F.element_at(F.expr("filter(bounds, b -> b.lo <= rank and rank < b.hi)"), 1)["to"])
    cols = ["id", "size", "crc", F.col("label").alias("shard")]
    both = placed.where("label is not null").select(*cols).unionByName(free.select(*cols))
    slots = running_sum(both, F.lit(1), F.xxhash64("id", "crc"), ["id", "crc"], ["shard"], "slot")
    return slots.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards by the law ``rows``; awkward rows as in ``balanced_shards``."""
    return balanced_shards(table(spark, sf_dir, "documents"))
