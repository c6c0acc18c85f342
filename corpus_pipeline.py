"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.common import small, table, written
from millrace.llm.lines import dedup_lines
from millrace.llm.mixing import repeated
from millrace.llm.packing import pack
from millrace.llm.quality import BROADCAST_ROWS, classify

#: Words a Python worker remembers here, where workers of earlier stages live on.
REMEMBERED = 250_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts, and texts of languages without trusted text, stay.
    Rows that repeat an id, a text and a language share their verdict; rows that
    share an id only, or have none, are judged by their texts.  Long texts are
    read whole, columns are carried along whatever they are called, and an empty
    table stays empty.
    """
    verdicts = classify(docs, table(spark, sf_dir, "labels"), remembered=REMEMBERED)
    rejected = written(verdicts.where("not keep").select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("lang").alias("_lang")), "rejected")
    rejected = small(rejected, BROADCAST_ROWS)
    here = docs["doc_id"].cast("long").eqNullSafe(rejected["_id"]) & (F.xxhash64(docs["text"]) == rejected["_x"]) & docs["lang"].eqNullSafe(rejected["_lang"])
    return docs.join(rejected, here, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one repeats go, exactly or within a few edits.

    Documents stay, if with an empty text; null and empty texts stay as they
    are.  Ties are broken by id, null first, then by the hash of the text, then
    by place; only rows that repeat id and text lose the same lines.  Long texts
    are read whole, columns are carried along whatever they are called, and an
    empty table stays empty.
    """
    return dedup_lines(docs).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest id, then of the smallest hash of its text.

    A row is told by its id and its text, so rows that share an id, or have
    none, are documents of their own if their texts differ; repeated rows come
    down to one.  Ids come before nulls.  Texts without words, null and empty
    ones, are copies of each other.  Long texts are read whole, columns are
    carried along whatever they are called, and an empty table stays empty.
    """
    key = lambda d, x, a, b: d.eqNullSafe(a) & (x == b)
    found = written(shingles.near_copies(docs), "near")
    stays = key(F.col("id"), F.col("x"), F.col("least_id"), F.col("least_x"))
    copies = small(written(found.where(~stays).select(F.col("id").alias("_id"), F.col("x").alias("_x")).distinct(), "copies"), BROADCAST_ROWS)
    text = F.xxhash64(docs["text"])
    out = docs.join(copies, key(docs["doc_id"].cast("long"), text, copies["_id"], copies["_x"]), "left_anti")
    again = found.where(stays).groupBy("id", "x").count().where("count > 1")
    if again.limit(1).count():
        # Rows of one id and text: one of them stays.
        again = small(written(again.select(F.col("id").alias("_id"), F.col("x").alias("_x")), "again"), BROADCAST_ROWS)
        same = lambda d: key(d["doc_id"].cast("long"), F.xxhash64(d["text"]), again["_id"], again["_x"])
        once = out.join(again, same(out), "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(again, same(out), "left_anti").unionByName(once)
    return out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets; documents may come several times, the last time perhaps in part.

    Documents without words (null and empty texts) take part in no mix and go.
    A null source is a source of its own; repeated rows count one by one; ties
    of the seeded order go by id, size and text.  Columns are carried along
    whatever they are called, and an empty table stays empty.
    """
    return repeated(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences.

    A null or empty text has its end mark only; repeated rows are packed one by
    one; long texts are cut, other columns not looked at; an empty table gives no pieces.
    """
    return pack(docs, remembered=REMEMBERED)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("mixing sources", mixture), ("packing", sequences)]

#: SQL expresses neither the classifier nor the hashes and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
