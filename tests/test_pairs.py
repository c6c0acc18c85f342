"""All pairs within keys: as a join gives them, in tasks of bounded size."""

import duckdb
import pytest
from oracle import differences
from pyspark.sql import functions as F

from millrace.operators import pairs
from millrace.operators.resolve import resolved
from millrace.plans.queries import ORACLE_SQL, QUERIES


def spread(df):
    """Rows of the fullest partition, and of all."""
    counts = [r[1] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*")).collect()]
    return max(counts), sum(counts)


def test_equals_a_join(spark):
    """Large and small keys, keys of one side, null keys, null values, and rows that are equal many times over."""
    left = spark.range(300).select(F.when(F.col("id") % 50 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("l"), F.col("id") % 100)).alias("x"), F.lit("r").alias("y"))
    right = spark.range(200).select(F.when(F.col("id") % 40 > 0, F.col("id") % 4 + 1).alias("k"), F.when(F.col("id") % 9 > 0, F.lit("same")).alias("z"))
    want = sorted(map(repr, left.join(right, "k").drop("k").collect()))
    for block_rows, task_pairs in ((8, 500), (64, 2000), (1000, 1000), (None, None)):
        got = pairs.pairs(left, right, "k", block_rows, task_pairs)
        assert got.columns == ["x", "y", "z"]
        assert sorted(map(repr, got.collect())) == want
    assert pairs.pairs(left, right.limit(0), "k").isEmpty()


@pytest.fixture
def two_nations(spark, tmp_path, monkeypatch):
    """A folder of tables with 400 suppliers each of two nations, one after the other."""
    spark.range(800).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (F.col("id") % 2).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(1).select(F.lit(1).alias("l_suppkey"), F.lit(1.0).alias("l_quantity")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 50)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 8000)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["graph_links", "resolve_go"])
def test_large_groups_are_shared_out(spark, two_nations, name):
    """No task makes all pairs of one nation, and the rows stay those of the SQL."""
    df = QUERIES[name](spark, two_nations)
    most, total = spread(df)
    assert total == {"graph_links": 400 * 400, "resolve_go": 2 * 400 * 400}[name]
    assert most <= total / 5
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{two_nations}/supplier.parquet/*.parquet'")
    assert differences(df, ORACLE_SQL[name], con) is None


def test_package_and_a_file_of_it(spark):
    """A file of a package that is imported by name as well is one edge, and no file is an edge to itself."""
    files = spark.createDataFrame([("p/a.go",), ("p/b.go",), ("p/a.go",), ("p/c.txt",), ("main.go",)], "path string")
    imports = spark.createDataFrame([("main.go", "m/p"), ("main.go", "m/p/a.go"), ("main.go", "m/p"), ("p/a.go", "m/p"), ("p/b.go", "m/main")], "path string, source string")
    imports = imports.withColumns({"ext": F.lit(".go"), "type": F.lit("value"), "dynamic": F.col("source") == "m/main"})
    got = sorted((r.src, r.dst, r.relation) for r in resolved(imports, files, module="m").collect())
    assert got == [("main.go", "p/a.go", "imports"), ("main.go", "p/b.go", "imports"), ("p/a.go", "p/b.go", "imports"), ("p/b.go", "main.go", "imports:dynamic")]
