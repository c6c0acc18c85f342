"""Task-focused ranking: keywords by rarity, symbols, summaries and vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_CANDIDATES, PACK_EXTENSIONS, PATH_WEIGHT, RADIUS_CAP, RELATIVE_PRUNE, SEMANTIC_WEIGHT, SIMILARITY_FLOOR, STOP_WORDS, SUMMARY_WEIGHT, SYMBOL_WEIGHT, TESTS_CAP
from ..sources.tree import extension
from .graph import blast_radius, is_test, shown


def tokenize(task: str) -> list[str]:
    """Keywords of a task, repeats kept: they count twice."""
    words = re.sub(r"[^a-z0-9_\s]", " ", task.lower()).split()
    return [w for w in words if len(w) > 2 and w not in STOP_WORDS]


def keywords(text: Column) -> Column:
    """``tokenize`` of a column."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def _like(text: str, kw: str) -> Column:
    """Substring match without regard to case; a keyword's _ stands for any character."""
    return F.expr(f"{text} ilike concat('%', {kw}, '%')")


def idf(files: DataFrame, words: DataFrame, text: str = "path") -> DataFrame:
    """(kw, idf) of distinct ``words`` (kw): how rare each is among the paths.

    A word of no file counts as of one.
    """
    total = files.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    words = F.broadcast(words.select("kw").distinct())  # the words of one task
    counts = files.join(words, _like(text, "kw")).groupBy("kw").agg(F.count("*").alias("n"))
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return words.join(counts, "kw", "left").crossJoin(F.broadcast(total)).select("kw", (F.log(F.col("total").cast("double") / (n + 1)) + 1).alias("idf"))


def contributions(files: DataFrame, symbols: DataFrame, weighted: DataFrame, key: str = "path") -> DataFrame:
    """(key, score) for every match of ``weighted`` words (kw, idf) in the path, a symbol's name or the summary, one row for each word of the task."""
    w = F.broadcast(weighted)  # the words of one task
    by_path = files.join(w, _like("path", "kw")).select(key, (PATH_WEIGHT * F.col("idf")).alias("score"))
    by_symbol = symbols.join(w, _like("name", "kw")).select(key, (SYMBOL_WEIGHT * F.col("idf")).alias("score"))
    by_summary = files.join(w, _like("summary", "kw")).select(key, (SUMMARY_WEIGHT * F.col("idf")).alias("score"))
    return by_path.unionAll(by_symbol).unionAll(by_summary)


def semantic_contributions(hits: DataFrame) -> DataFrame:
    """(path, score) of nearest neighbours (path, distance) that are near enough."""
    similarity = F.greatest(F.lit(0.0), 1 - F.col("distance"))
    return hits.where(similarity >= SIMILARITY_FLOOR).select("path", (SEMANTIC_WEIGHT * similarity).alias("score"))


def ranked(scores: DataFrame, most: int = MAX_CANDIDATES, prune: float = RELATIVE_PRUNE, key: str = "path") -> DataFrame:
    """The best by summed score, ties by path, without those far behind the first."""
    total = scores.groupBy(key).agg(F.sum("score").alias("score"))
    best = total.agg(F.max("score").alias("_best"))
    return total.crossJoin(F.broadcast(best)).where(F.col("score") >= prune * F.col("_best")).drop("_best").orderBy(F.col("score").desc(), key).limit(most)


def with_files(best: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """The few rows that a ranking or a search has left, with what ``files`` say of them; the files are not moved."""
    return files.join(F.broadcast(best), key)


def matching_rules(rules: DataFrame, words: DataFrame) -> DataFrame:
    """Rules that have a keyword in their name or description, each once."""
    return rules.join(F.broadcast(words.select("kw").distinct()), _like("name", "kw") | _like("description", "kw"), "left_semi")


def context_pack(spark: SparkSession, task: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, rules: DataFrame, semantic: DataFrame | None = None, budget_tokens: int | None = None) -> dict:
    """What to read for a task: files, what depends on them, tests, rules, warnings.

    The token budget is accepted and has no effect.
    """
    empty = {"task": task, "strategy": "", "read_first": [], "blast_radius": [], "tests_to_run": [], "optional_read": [], "rules": [], "warnings": []}
    words = tokenize(task)
    if not words:
        return empty | {"strategy": "No keywords", "warnings": ["The task has no words to search for."]}
    kw = spark.createDataFrame([(w,) for w in words], "kw string")
    scores = contributions(files, symbols, kw.join(idf(files, kw), "kw"))
    if semantic is not None:
        scores = scores.unionAll(semantic_contributions(semantic))
    top = [r.asDict() for r in with_files(ranked(scores), files.select("path", "summary", "stale")).orderBy(F.col("score").desc(), "path").collect()]  # ten at most
    if not top:
        return empty | {"strategy": "No relevant files", "warnings": ["No relevant files were found."]}
    followed = spark.createDataFrame([(i, r["path"]) for i, r in enumerate(top)], "origin int, node string").where(F.lower(extension(F.col("node"))).isin(PACK_EXTENSIONS))
    radius = blast_radius(edges, followed)
    first = lambda df, text, n: [r[0] for r in df.groupBy(text.alias("p")).agg(F.min(F.struct("origin", "depth")).alias("o")).orderBy("o", "p").limit(n).collect()]
    found = matching_rules(rules, kw).orderBy("id").toLocalIterator()  # all rules, as the pack lists them all
    return empty | {
        "strategy": f"Context centered on {top[0]['path'].rsplit('/', 1)[-1]}",
        "read_first": [{"path": r["path"], "summary": r["summary"] or "No summary"} for r in top],
        "blast_radius": first(radius, shown(), RADIUS_CAP),
        "tests_to_run": first(radius.where(is_test(F.col("path"))), F.col("path"), TESTS_CAP),
        "rules": [f"{r['name']}: {r['description']}" for r in found],
        "warnings": ["Some files changed since they were indexed."] if any(r["stale"] for r in top) else [],
    }
