"""Phrase collocation mining by top-order marginalisation: only the longest windows are counted, shorter phrases are their prefixes' sums."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import short_batches, small, table, written

#: Words of the longest phrase.
ORDER = 4
#: Occurrences of a phrase from which it is a candidate.
LEAST = 30
#: A phrase goes if a longer one holds it and has so many hundredths of its occurrences.
HELD = 80
#: Phrases of a language in the report, and parts of a language that are ranked by themselves first.
TOP, PARTS = 2000, 64
#: Frequent words (language and word) up to which workers hold numbers for them; with more of them windows are counted as strings.
NUMBERED = 1_000_000
BROADCAST_ROWS = 1_000_000

#: Words whose windows a task holds before it counts them.
TOGETHER = 1_500_000

#: The end of a piece, a byte that no UTF-8 text has.
_END = b"\xff"
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _END * 10 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text in order, with the mark of an end between pieces."""
    return (text or b"").translate(_BYTES).replace(_END, b" \xff ").split(b" ")


def _strings(words: list[bytes]) -> pa.Array:
    """As they are: Spark's strings may hold bytes that are no UTF-8."""
    return pa.array(words, pa.binary()).cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f): how often each word occurs in a batch."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(lang, Counter()).update(tokens(text.as_py()))
        langs, words, counts = [], [], []
        for lang, c in found.items():
            c.pop(b"", None)
            c.pop(_END, None)
            langs += [lang] * len(c)
            words += c.keys()
            counts += c.values()
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), _strings(words), pa.array(counts, pa.int64())], names=["lang", "word", "f"])


def _leads(a: np.ndarray) -> np.ndarray:
    """Windows of four: each number with the three after it, 0 from the first 0 on; those of one word are left out."""
    padded = np.concatenate([a, np.zeros(ORDER - 1, a.dtype)])
    columns = [padded[: len(a)]]
    for i in range(1, ORDER):
        columns.append(np.where(columns[-1] > 0, padded[i : i + len(a)], 0))
    return np.stack(columns, 1)[columns[1] > 0]


def _numbered(numbers: dict[str, dict[bytes, int]]):
    """(w12, w3, w4, f): the windows of some texts by the numbers of their words, each once with its count; a word without a number ends a window."""

    def once(parts: list[np.ndarray]) -> pa.RecordBatch:
        w = _leads(np.concatenate([*parts, np.zeros(0, np.int64)]))
        first, rest = w[:, 0] << 32 | w[:, 1], w[:, 2] << 32 | w[:, 3]
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(first)))
        first, rest = first[at], rest[at]
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array((rest >> 32).astype(np.int32)), pa.array((rest & 0xFFFFFFFF).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["w12", "w3", "w4", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                known = numbers.get(lang, {})
                # Of the empty strings between blanks nothing may remain: they would part words.
                parts.append(np.array([known.get(t, 0) for t in tokens(text.as_py()) if t] + [0], np.int64))
                size += len(parts[-1])
                if size > TOGETHER:
                    yield once(parts)
                    parts, size = [], 0
        yield once(parts)

    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, w12, w3, w4, f): the same by the words themselves, '' after a piece's end."""
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            piece: list[bytes] = []
            for t in [*tokens(text.as_py()), _END]:
                if t != _END:
                    if t:
                        piece.append(t)
                    continue
                ends = [*piece, b"", b""]
                found.update((lang, piece[i] + b" " + piece[i + 1], ends[i + 2], ends[i + 3]) for i in range(len(piece) - 1))
                piece = []
        keys = list(zip(*found.keys())) if found else [()] * 4
        columns = [pa.array(keys[0], pa.string()), *map(_strings, keys[1:])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.int64())], names=["lang", "w12", "w3", "w4", "f"])


def marginals(windows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, m, w12, w3, w4, a) of all phrases of m = 2 to 4 words with ``least`` occurrences, from ``windows`` (keys, w12, w3, w4, f).

    A phrase is the beginning of one window for each of its occurrences, so
    sums over the beginnings of windows count it.  Two words are summed
    first: a window then ends where two words follow each other that are too
    rare, as no longer phrase that holds them is frequent enough.  ROLLUP sums what
    is left of the windows up to four and to three words.
    """
    numbers = dict(windows.dtypes)["w3"] == "int"
    nothing = F.lit(0) if numbers else F.lit("")
    pairs = written(windows.groupBy(*keys, "w12").agg(F.sum("f").alias("a")).where(F.col("a") >= least), "pairs")
    known = small(pairs.select(*keys, F.col("w12").alias("pair")), BROADCAST_ROWS).withColumn("there", F.lit(True))

    def follows(df: DataFrame, first: Column, second: str, name: str) -> DataFrame:
        """With ``name``: whether the two words are a frequent pair."""
        pair = F.shiftleft(first.cast("long"), 32).bitwiseOR(F.col(second).cast("long")) if numbers else F.concat_ws(" ", first, second)
        # A pad is in no pair, and needs no look.
        return df.withColumn("pair", F.when(F.col(second) != nothing, pair)).join(known, [*keys, "pair"], "left").withColumn(name, F.coalesce("there", F.lit(False))).drop("pair", "there")

    second = F.col("w12").bitwiseAND(0xFFFFFFFF) if numbers else F.element_at(F.split("w12", " "), -1)
    longer = windows.where(F.col("w3") != nothing).join(known.select(*keys, F.col("pair").alias("w12")), [*keys, "w12"], "left_semi")
    longer = follows(longer, second, "w3", "third").where("third")
    longer = follows(longer, F.col("w3"), "w4", "fourth").select(*keys, "w12", "w3", F.when(F.col("fourth"), F.col("w4")).otherwise(nothing).alias("w4"), "f")
    by = ", ".join([*keys, "w12", "w3"])
    sums = windows.sparkSession.sql(f"SELECT {by}, w4, sum(f) AS a, grouping_id() AS level FROM {{longer}} GROUP BY {by}, ROLLUP (w4)", longer=longer)
    # Sums that end with a pad are not of a phrase of four words.
    whole = (F.col("level") == 1) | (F.col("w4") != nothing)
    sums = sums.where(whole & (F.col("a") >= least)).select(*keys, F.when(F.col("level") == 1, 3).otherwise(4).alias("m"), "w12", "w3", "w4", "a")
    none = F.lit(None).cast("int" if numbers else "string")
    return sums.unionByName(pairs.select(*keys, F.lit(2).alias("m"), "w12", none.alias("w3"), none.alias("w4"), "a"))


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, numbered: int = NUMBERED) -> tuple[DataFrame, DataFrame]:
    """(lang, m, phrase, f) of all phrases of up to 4 words with ``least`` occurrences, and (lang, n): all occurrences of words.

    Words below ``least`` are in no such phrase and end a window.  Up to
    ``numbered`` frequent words are counted by number, more of them as strings.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("t"))
    words = written(rows.mapInArrow(_counted, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words", "zstd")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = written(words.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "frequent")
    if frequent.limit(numbered + 1).count() <= numbered:
        held: dict[str, dict[bytes, int]] = {}
        ids = frequent.select("lang", "word", "id").orderBy("id").toArrow()
        # In order of the written ids, from 1: 32 bits are enough.
        for k, (lang, word) in enumerate(zip(ids.column(0).to_pylist(), ids.column(1).to_pylist()), 1):
            held.setdefault(lang, {})[word.encode()] = k
        named = docs.sparkSession.createDataFrame(pa.table({"lang": ids.column(0), "word": ids.column(1), "k": pa.array(np.arange(1, len(ids) + 1, dtype=np.int64))}))
        box = docs.sparkSession.sparkContext.broadcast(held)
        windows = written(rows.mapInArrow(lambda batches: _numbered(box.value)(batches), "w12 bigint, w3 int, w4 int, f bigint"), "windows", "zstd")
        sums = marginals(windows, [], least)
        parts = F.filter(F.array(F.shiftright("w12", 32), F.col("w12").bitwiseAND(0xFFFFFFFF), F.col("w3").cast("long"), F.col("w4").cast("long")), lambda w: F.coalesce(w, F.lit(0)) > 0)
        spelt = sums.select("m", "a", "w12", "w3", "w4", F.posexplode(parts).alias("i", "k"))
        spelt = spelt.join(small(named, BROADCAST_ROWS), "k")
        phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda w: w["word"]), " ")
        grams = spelt.groupBy("m", "w12", "w3", "w4", "a").agg(F.first("lang").alias("lang"), phrase.alias("phrase")).select("lang", "m", "phrase", F.col("a").alias("f"))
    else:
        windows = written(rows.mapInArrow(_spelled, "lang string, w12 string, w3 string, w4 string, f bigint"), "windows", "zstd")
        join = lambda m: F.when(m == 2, F.col("w12")).when(m == 3, F.concat_ws(" ", "w12", "w3")).otherwise(F.concat_ws(" ", "w12", "w3", "w4"))
        grams = marginals(windows, ["lang"], least).select("lang", "m", join(F.col("m")).alias("phrase"), F.col("a").alias("f"))
    return written(grams.unionByName(frequent.select("lang", F.lit(1).alias("m"), F.col("word").alias("phrase"), "f")), "grams"), totals


def _first(k: Column | int) -> Column:
    return F.array_join(F.slice("words", F.lit(1), k), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, numbered: int = NUMBERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language whose words go together more than apart.

    Candidates are phrases of 2 to 4 words that occur ``least`` times within
    pieces of text between punctuation marks or line ends.  A cut after k words has the
    score floor(2000000 a / (l + r)) of the occurrences of the whole and of its
    two parts; the lowest cut counts, the smallest k among equals.  Candidates
    with nearly all their occurrences in one longer candidate are left out.
    Ties of the score go by a, then by the phrase's bytes.

    A null language is ``und`` like the language of that name; null and empty
    texts have no words; repeated rows count one by one; texts are read whole
    however long; other columns are not looked at, whatever they are called;
    an empty table gives no rows.
    """
    grams, totals = phrases(docs, lang_col, text_col, least, numbered)
    wanted = grams.where("m > 1").select("lang", "m", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    known = lambda name, f: small(grams.select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(f)), BROADCAST_ROWS)
    cuts = wanted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _first(F.col("k")).alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
    # Decimals: the product may pass 64 bits.
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div cast(l + r as decimal(20, 0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What a longer candidate holds: its runs of 2 to m - 1 words.
    runs = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("m") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " ")))), lambda s: s != "")
    longer = wanted.where("m > 2").select("lang", "a", F.explode(F.array_distinct(runs)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    left = best.join(longer, ["lang", "phrase"], "left").where(f"held is null or cast(held as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {HELD}")
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language's phrases are ranked in parts first, so that few of them meet in one task.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(small(written(totals, "totals"), BROADCAST_ROWS), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_marginal_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of all documents; awkward rows as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, d.doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece
  FROM documents d),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM spots, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cuts AS (
  SELECT g.lang, g.phrase, g.f AS a, k, x.f AS l, y.f AS r, CAST((2000000 * CAST(g.f AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM grams WHERE m > 1) g
  JOIN grams x ON x.lang = g.lang AND x.phrase = array_to_string(g.w[1:k], ' ')
  JOIN grams y ON y.lang = g.lang AND y.phrase = array_to_string(g.w[k + 1:g.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, m, f, string_split(phrase, ' ') AS w, unnest([2, 3]) AS s FROM grams WHERE m > 2), (SELECT unnest([1, 2, 3]) AS i)
  WHERE s < m AND i + s - 1 <= m GROUP BY 1, 2),
rest AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM rest)
JOIN totals USING (lang) WHERE rank <= 2000
"""
