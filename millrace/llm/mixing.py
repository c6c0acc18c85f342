"""Capped water-filling: sources are mixed to target weights, no document more than three times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_sum, table

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of ``sources`` (source, source_size); adds ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes.  A source stops at ``max_epochs`` times its size; the
    excess goes to the others by weight until none is above.  The level at
    which that ends is found in one pass: with the sources in order of cap over
    weight, those below the level are the clamped ones.
    """
    whole = Window.partitionBy("_one")
    seq = whole.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(seq) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_one", F.lit(0)).withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = whole.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole))
    # If this source and all after it are not clamped, the level is `level`.
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0))))
    s = s.withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: bool = False) -> DataFrame:
    """How many words of each row the mix takes: (id, source, size, source_size, target, whole, part, taken), and the whole row if ``carry``.

    Every document of a source is taken as many whole times as the target over
    the source's size allows; what is left of the target goes to documents in
    the order of a seeded hash, each once more, and the document in which the
    target is reached gives its first words only.  So a source's taken words
    are its target rounded to whole words.  A null source is a source of its
    own.  Documents without words (null and empty texts) take nothing; repeated
    rows count one by one; rows without an id take part like others; ties of the
    seeded hash go by id, size and text.  Long texts are counted whole; other
    columns are carried or left out, whatever they are called; an empty table
    gives no rows.
    """
    facts = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("x")]
    sized = docs.select(*facts, *([F.struct(*docs.columns).alias("row")] if carry else []))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(sources, max_epochs).withColumnRenamed("source", "_source")
    plan = plan.withColumn("goal", F.round("target").cast("long")).withColumn("whole", F.when(F.col("source_size") > 0, F.expr("goal div nullif(source_size, 0)")).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size"))
    order = F.xxhash64("id", F.lit(seed))
    ranked = running_sum(sized, F.col("size"), order, ["id", "size", "x"], ["source"], "before")
    out = ranked.join(plan, ranked["source"].eqNullSafe(plan["_source"])).drop("_source", "x")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return out.withColumn("part", part).withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).drop("before", "rest", "goal")


def repeated(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The mixed table itself: each row as often as it is taken, the last time perhaps in part.

    Only a document cut short has its text changed: to its first words, as they stood.
    """
    m = mix(docs, text_col=text_col, carry=True, **kw).where("taken > 0")
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>"))
    n = (F.col("whole") + (F.col("part") == F.col("size")).cast("long")).cast("int")
    m = m.select("row", "size", F.explode(F.concat(F.array_repeat(F.col("size"), n), cut)).alias("words"))
    short, text = F.col("words") < F.col("size"), F.col("row").getField(text_col)
    # The words and the gaps before them, as they stood.
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    row = F.when(short, F.col("row").withField(text_col, head)).otherwise(F.col("row"))
    if "n_chars" in docs.columns:
        row = F.when(short, row.withField("n_chars", F.length(head).cast("long"))).otherwise(F.col("row"))
    return m.select(row.alias("row")).select("row.*")


def op10_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; awkward rows as in ``mix``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
