"""Quality classifier: interpolated modified Kneser-Ney trigrams of tokens of trusted text, by language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, small, table, written
from .tokens import Encoder, encoder, tokenizer_path

#: Share of trusted documents, by hash, that are kept from training to take the quantiles from.
HELD_OUT = 10
#: A document is rejected above this quantile of the perplexity of held-out trusted text of its language and length.
QUANTILE = 0.998
#: Windows of held-out text have powers of so many tokens.  A length needs MANY windows for a quantile of its own, and SOME for a curve fitted to them.
LENGTH_BASE, MANY, SOME = 4, 500, 30
#: Rows up to which a side is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_500_000
#: Entries of a model, of 12 bytes each, up to which every worker holds it; a larger one is joined by shuffles.
MODEL_ROWS = 16_000_000
#: Log probabilities are summed as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Counted entries that a task holds before it gives them away, and words that a worker remembers.
HELD, REMEMBERED = 1_500_000, 250_000
#: Texts taken together.
TEXTS = 256

#: Kinds of a model's entries: log probabilities of seen n-grams by their order, what their contexts leave to the order below, and what an unseen token has.
TRIGRAM, BIGRAM, UNIGRAM, AFTER_TWO, AFTER_ONE, UNSEEN = 3, 2, 1, -2, -1, 0


def bits(size: int) -> int:
    """Bits of a token in a key of three; zero stands for the start of a text."""
    n = int(size).bit_length()
    if 3 * n > 63:
        raise ValueError("the vocabulary is too large for keys of 64 bits")
    return n


def keys_of(texts: list[str | None], e: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that ends at each token of the texts, one text after another, and the number of tokens of each."""
    b, parts, sizes = bits(e.size), [], []
    for data in e.encode(texts):
        t = np.zeros(len(data) // 4 + 2, np.int64)
        t[2:] = np.frombuffer(data, "<u4")
        t[2:] += 1
        parts.append(t[:-2] << 2 * b | t[1:-1] << b | t[2:])
        sizes.append(len(t) - 2)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(sizes, np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[new], np.add.reduceat(counts[order], new)


def _counts(path: str, remembered: int):
    """Each trigram of a task's texts by language, counted as far as there is room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, remembered)
        held: dict[str | None, list] = {}
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            for lang, ((keys, n),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "key", "c"])
            held.clear()

        def merge() -> int:
            for lang, parts in held.items():
                held[lang] = [_merged(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))]
            return sum(len(parts[0][0]) for parts in held.values())

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in set(langs):
                    keys, _ = keys_of([t for t, x in zip(texts, langs) if x == lang], e)
                    if len(keys):
                        found = np.unique(keys, return_counts=True)
                        held.setdefault(lang, []).append(found)
                        size += len(found[0])
                if size > HELD and (size := merge()) > HELD // 2:
                    yield from closed()
                    size = 0
        merge()
        yield from closed()

    return run


def _discounts(counts: DataFrame, c: str) -> DataFrame:
    """Per language the three discounts of modified Kneser-Ney, from how many entries have counts 1 to 4."""
    n = counts.groupBy("lang").agg(*[F.sum((F.col(c) == k).cast("double")).alias(f"n{k}") for k in range(1, 5)])
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def d(k: int) -> Column:
        plain = k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}")
        return F.when((plain > 0) & (plain < k), plain).otherwise(F.lit(0.5 * k))

    return n.select(F.col("lang").alias("_lang"), *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], *cols: Column, how: str = "inner") -> DataFrame:
    """A join on ``keys`` of which the first, the language, may be null."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *cols)
    same = F.lit(True)
    for k in keys:
        same &= left[k].eqNullSafe(right[f"_{k}"]) if k == "lang" else left[k] == right[f"_{k}"]
    return left.join(right, same, how).drop(*[f"_{k}" for k in keys])


def _level(counts: DataFrame, c: str, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """``counts`` with what is left of each count, and the sum and the mass taken of each context."""
    d = small(_discounts(counts, c), BROADCAST_ROWS)  # one row for each language
    by = _joined(counts, d.withColumnRenamed("_lang", "lang"), ["lang"], *map(F.col, ("d1", "d2", "d3")))
    off = F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))
    total = by.groupBy("lang", *context).agg(F.sum(c).alias("s"), (F.sum(off) / F.sum(c)).alias("g"))
    return by.withColumn("a", F.col(c) - off).drop("d1", "d2", "d3"), total


def model(counts: DataFrame, width: int, size: int) -> DataFrame:
    """(lang, kind, key, lp): log probabilities in whole units of the n-grams in ``counts`` (lang, key, c), and of their contexts' remainders.

    ``width`` is the bits of a token in a key, ``size`` the tokens there are.
    Lower orders count in how many contexts an entry is seen; the lowest is
    interpolated with the uniform distribution over all tokens.
    """
    low = (1 << 2 * width) - 1
    three = counts.select("lang", F.shiftright("key", width).alias("uv"), F.col("key").bitwiseAND(low).alias("vw"), "c")
    two = written(three.groupBy("lang", "vw").agg(F.count("*").alias("c")), "bigrams")
    two = two.select("lang", F.shiftright("vw", width).alias("v"), F.col("vw").bitwiseAND((1 << width) - 1).alias("w"), "vw", "c")
    one = two.groupBy("lang", "w").agg(F.count("*").alias("c"))
    a1, g1 = _level(one, "c", [])
    a2, g2 = _level(two, "c", ["v"])
    a3, g3 = _level(three, "c", ["uv"])
    g1 = small(g1.withColumn("floor", F.col("g") / size), BROADCAST_ROWS)  # one row for each language
    p1 = _joined(a1, g1, ["lang"], F.col("s"), F.col("floor")).select("lang", "w", (F.col("a") / F.col("s") + F.col("floor")).alias("p"))
    p1 = written(p1, "unigrams")
    p2 = _joined(_joined(a2, g2, ["lang", "v"], F.col("s"), F.col("g")), small(p1, BROADCAST_ROWS), ["lang", "w"], F.col("p"))
    p2 = written(p2.select("lang", "vw", (F.col("a") / F.col("s") + F.col("g") * F.col("p")).alias("p")), "bigrams")
    p3 = _joined(_joined(a3, g3, ["lang", "uv"], F.col("s"), F.col("g")), small(p2, BROADCAST_ROWS), ["lang", "vw"], F.col("p"))
    p3 = p3.select("lang", F.shiftleft("uv", width).bitwiseOR(F.col("vw").bitwiseAND((1 << width) - 1)).alias("key"), (F.col("a") / F.col("s") + F.col("g") * F.col("p")).alias("p"))

    def entries(df: DataFrame, kind: int, key: Column, p: str) -> DataFrame:
        return df.select("lang", F.lit(kind).cast("byte").alias("kind"), key.cast("long").alias("key"), F.round(F.log(p) * UNIT).cast("int").alias("lp"))

    out = entries(p3, TRIGRAM, F.col("key"), "p")
    for df, kind, key, p in ((p2, BIGRAM, F.col("vw"), "p"), (p1, UNIGRAM, F.col("w"), "p"), (g3, AFTER_TWO, F.col("uv"), "g"), (g2, AFTER_ONE, F.col("v"), "g"), (g1, UNSEEN, F.lit(0), "floor")):
        out = out.unionAll(entries(df, kind, key, p))
    return out


Tables = dict[int, tuple[np.ndarray, np.ndarray]]


def _looked_up(tables: Tables, kind: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there, and its value, or zero."""
    keys, values = tables[kind]
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    there = keys[at] == asked
    return there, np.where(there, values[at], 0).astype(np.int64)


def log_probabilities(tables: Tables, keys: np.ndarray, width: int) -> np.ndarray:
    """Log probability of the last token of each trigram, given the first two, in whole units."""
    asked, back = np.unique(keys, return_inverse=True)
    there, value = _looked_up(tables, TRIGRAM, asked)
    rest = asked[~there]
    there2, value2 = _looked_up(tables, BIGRAM, rest & (1 << 2 * width) - 1)
    last = rest & (1 << width) - 1
    there1, value1 = _looked_up(tables, UNIGRAM, last)
    lower = np.where(there1, value1, tables[UNSEEN][1][0]) + _looked_up(tables, AFTER_ONE, rest >> width & (1 << width) - 1)[1]
    value[~there] = np.where(there2, value2, lower) + _looked_up(tables, AFTER_TWO, rest >> width)[1]
    return value[back]


def windows(sizes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: its exponent, and row and first token of all windows, side by side, of each text that is long enough.

    ``sizes`` are the tokens of texts that lie one after another, ``rows`` the texts asked for.
    """
    begins = np.cumsum(sizes) - sizes
    k, length = 1, LENGTH_BASE
    while len(rows := rows[sizes[rows] >= length]):
        n = sizes[rows] // length
        each = np.repeat(rows, n)
        yield k, each, begins[each] + (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)) * length
        k, length = k + 1, length * LENGTH_BASE


UNITS = "id bigint, x bigint, lang string, k int, at bigint, n bigint"


def _parts(batches: Iterator[pa.RecordBatch], e: Encoder) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """By language: keys of its texts, sizes, and as ``k``, row and first token all that is scored: texts (k = 0) and windows of held-out ones."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            part = batch.slice(lo, TEXTS)
            langs = np.array(part.column(2).to_pylist(), object)
            texts, held = np.array(part.column(3).to_pylist(), object), np.array(part.column(4).to_pylist(), bool)
            for lang in set(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                keys, sizes = keys_of(texts[own].tolist(), e)
                yield lang, keys, sizes, held[own], own, part


def _units(part: pa.RecordBatch, lang: str | None, own: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """First tokens, numbers of tokens, and the columns of UNITS for the texts, and for the windows of each length."""
    for k, rows, at in [(0, np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]), *windows(sizes, np.flatnonzero(held))]:
        n = sizes[rows] if k == 0 else np.full(len(rows), LENGTH_BASE**k)
        take = pa.array(own[rows])
        within = at - (np.cumsum(sizes) - sizes)[rows]
        yield at, n, [part.column(0).take(take), part.column(1).take(take), pa.array([lang] * len(rows), pa.string()), pa.array(np.full(len(rows), k, np.int32)), pa.array(within), pa.array(n)]


def _scored(path: str, remembered: int, tables: Callable[[], dict[str | None, Tables]]):
    """UNITS and their log probability, by a model that every worker holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, of = encoder(path, remembered), tables()
        for lang, keys, sizes, held, own, part in _parts(batches, e):
            if lang not in of or not len(keys):
                continue
            ends = np.concatenate([[0], np.cumsum(log_probabilities(of[lang], keys, bits(e.size)))])
            for at, n, cols in _units(part, lang, own, sizes, held):
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ends[at + n] - ends[at])], names=["id", "x", "lang", "k", "at", "n", "lp"])

    return run


def _grams(path: str, remembered: int):
    """UNITS by their distinct trigrams, each with how often it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, remembered)
        for lang, keys, sizes, held, own, part in _parts(batches, e):
            for at, n, cols in _units(part, lang, own, sizes, held):
                for i, (a, m) in enumerate(zip(at.tolist(), n.tolist())):
                    key, times = np.unique(keys[a : a + m], return_counts=True)
                    take = pa.array(np.full(len(key), i))
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in cols), pa.array(key), pa.array(times)], names=["id", "x", "lang", "k", "at", "n", "key", "times"])

    return run


def _by_joins(grams: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """UNITS and log probability of ``grams`` by joins: each distinct trigram is looked up once."""
    t = grams.select("lang", "key").distinct()
    t = t.select("lang", "key", F.shiftright("key", width).alias("uv"), F.col("key").bitwiseAND((1 << 2 * width) - 1).alias("vw"), F.col("key").bitwiseAND((1 << width) - 1).alias("w"), F.shiftright("key", width).bitwiseAND((1 << width) - 1).alias("v"))
    for kind, key in ((TRIGRAM, "key"), (BIGRAM, "vw"), (UNIGRAM, "w"), (AFTER_TWO, "uv"), (AFTER_ONE, "v")):
        t = _joined(t, entries.where(F.col("kind") == kind).withColumnRenamed("key", key) if key != "key" else entries.where(F.col("kind") == kind), ["lang", key], F.col("lp").alias(f"lp{kind}"), how="left")
    t = _joined(t, small(entries.where(F.col("kind") == UNSEEN), BROADCAST_ROWS), ["lang"], F.col("lp").alias("floor"))
    zero = lambda k: F.coalesce(F.col(f"lp{k}"), F.lit(0))
    lower = F.coalesce(f"lp{BIGRAM}", zero(AFTER_ONE) + F.coalesce(f"lp{UNIGRAM}", "floor")) + zero(AFTER_TWO)
    t = t.select("lang", "key", F.coalesce(f"lp{TRIGRAM}", lower).cast("long").alias("lp"))
    hits = _joined(grams, t, ["lang", "key"], F.col("lp"))
    return hits.groupBy("id", "x", "lang", "k", "at", "n").agg(F.sum(F.col("lp") * F.col("times")).alias("lp"))


def held_tables(entries: DataFrame) -> dict[str | None, dict[int, Broadcast]]:
    """The ``entries`` of a model as sorted arrays for every worker, by language and kind; the driver holds one kind of one language at a time."""
    out: dict[str | None, dict[int, Broadcast]] = {}
    context = entries.sparkSession.sparkContext
    for lang in [r[0] for r in entries.where(F.col("kind") == UNSEEN).select("lang").collect()]:  # one row for each language
        own = entries.where(F.col("lang").eqNullSafe(F.lit(lang)))
        out[lang] = {}
        for k in (TRIGRAM, BIGRAM, UNIGRAM, AFTER_TWO, AFTER_ONE, UNSEEN):
            found = own.where(F.col("kind") == k).select("key", "lp").toArrow()
            key, lp = (found.column(i).to_numpy() for i in (0, 1))
            del found
            order = np.argsort(key)
            key = key[order]
            lp = lp[order]
            del order
            out[lang][k] = context.broadcast((key, lp))
            del key, lp
            pa.default_memory_pool().release_unused()
    return out


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = HELD_OUT, path: str | None = None, remembered: int = REMEMBERED) -> tuple[DataFrame, DataFrame]:
    """Texts (id, x, lang, tokens, trusted, held_out, perplexity), one for every distinct (id, hash x of the text, lang), and windows (lang, k, perplexity) of held-out ones.

    Trusted are rows whose id is labelled of quality 1 and not toxic.  Of each
    language one in ``held_out`` trusted documents, and at least one if there
    are two, is kept from training.  A text without tokens, or in a language
    without trusted text, has no perplexity.
    """
    spark = docs.sparkSession
    short_batches(spark)
    path = path or tokenizer_path()
    size = encoder(path, remembered).size
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    good = small(good, BROADCAST_ROWS).withColumn("_good", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("x"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.join(good, rows["id"] == good["_id"], "left").withColumn("fold", F.xxhash64("id", F.lit("fold")))
    trusted = F.coalesce("_good", F.lit(False))
    # The least of a language is held out whatever its hash, unless it is the only one.
    ends = written(rows.where("_good").groupBy("lang").agg(F.min("fold").alias("least"), F.max("fold").alias("most")), "folds")
    ends = ends.where("least < most").select(F.col("lang").alias("_lang"), "least")
    rows = rows.join(small(ends, BROADCAST_ROWS), rows["lang"].eqNullSafe(F.col("_lang")), "left").drop("_lang")
    held = trusted & ((F.pmod("fold", F.lit(held_out)) == 0) | (F.col("fold") == F.col("least"))) & F.col("least").isNotNull()
    rows = rows.select("id", "x", "lang", "text", F.coalesce(held, F.lit(False)).alias("held"), trusted.alias("trusted"))
    counts = rows.where("trusted and not held").select("lang", "text").mapInArrow(_counts(path, remembered), "lang string, key bigint, c bigint")
    counts = written(counts.groupBy("lang", "key").agg(F.sum("c").alias("c")), "counts")
    entries = written(model(counts, bits(size), size), "model")
    asked = rows.select("id", "x", "lang", "text", "held")
    tables = None
    if entries.count() <= MODEL_ROWS:
        tables = held_tables(entries)
        units = asked.mapInArrow(_scored(path, remembered, lambda: {lang: {k: b.value for k, b in kinds.items()} for lang, kinds in tables.items()}), f"{UNITS}, lp bigint")
    else:
        units = _by_joins(written(asked.mapInArrow(_grams(path, remembered), f"{UNITS}, key bigint, times bigint").distinct(), "grams"), entries, bits(size))
    units = written(units.withColumn("perplexity", F.exp(-F.col("lp") / F.col("n") / UNIT)), "units")
    for kinds in (tables or {}).values():
        for b in kinds.values():
            b.destroy()  # the driver's copy too
    facts = rows.select("id", "x", "lang", "trusted", F.col("held").alias("held_out")).distinct()
    texts = units.where("k = 0").groupBy(F.col("id").alias("_i"), F.col("x").alias("_x"), F.col("lang").alias("_l")).agg(F.max("n").alias("tokens"), F.max("perplexity").alias("perplexity"))
    same = facts["id"].eqNullSafe(texts["_i"]) & (facts["x"] == texts["_x"]) & facts["lang"].eqNullSafe(texts["_l"])
    texts = facts.join(texts, same, "left").select("id", "x", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"), "trusted", "held_out", "perplexity")
    return texts, units.where("k > 0").dropDuplicates(["id", "x", "lang", "k", "at"]).select("lang", "k", "perplexity")


def thresholds(held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, bounds): for the lengths k of the windows ``held`` (lang, k, perplexity) the largest perplexity to keep.

    Of MANY windows it is their quantile.  Of SOME it is that of the normal
    curve with the mean and spread of their logarithms, as a quantile of few
    is only their largest.  Lengths with fewer windows have no bound, but the
    shortest always has its windows' quantile.  Longer texts vary less, so no bound is
    above that of a shorter length.
    """
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    log = F.log("perplexity")
    fitted = F.exp(F.avg(log) + NormalDist().inv_cdf(quantile) * F.stddev_pop(log))
    by = held.groupBy("lang", "k").agg(at.alias("own"), fitted.alias("fitted"), F.count("*").alias("n")).where((F.col("n") >= SOME) | (F.col("k") == 1))
    entries = F.sort_array(F.collect_list(F.struct("k", "own", "fitted", "n")))
    bound = lambda done, e: F.least(F.when((e["n"] >= MANY) | (e["k"] == 1), e["own"]).otherwise(e["fitted"]), F.try_element_at(done, F.lit(-1))["threshold"])
    step = lambda done, e: F.array_append(done, F.struct(e["k"].alias("k"), bound(done, e).alias("threshold")))
    return by.groupBy("lang").agg(entries.alias("e")).select("lang", F.aggregate("e", F.array().cast("array<struct<k:int,threshold:double>>"), step).alias("bounds"))


def classified(texts: DataFrame, held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``texts`` with threshold and keep: whether the perplexity is at most the quantile of its language for windows of its length, or of the next smaller one that has a bound."""
    k = F.floor(F.log(F.greatest("tokens", F.lit(LENGTH_BASE))) / F.log(F.lit(float(LENGTH_BASE))) + 1e-9)
    bounds = small(written(thresholds(held, quantile), "thresholds").withColumnRenamed("lang", "_l"), BROADCAST_ROWS)
    out = texts.join(bounds, texts["lang"].eqNullSafe(bounds["_l"]), "left").drop("_l")
    own = F.try_element_at(F.filter("bounds", lambda b: b["k"] <= k), F.lit(-1))
    out = out.withColumn("threshold", own["threshold"]).drop("bounds")
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, **cols) -> DataFrame:
    """(id, x, lang, tokens, trusted, held_out, perplexity, threshold, keep) of every distinct (id, x, lang).

    Rows without tokens (null and empty texts), and rows of languages that have
    no two trusted documents, are kept: there is no evidence against them.  A
    null language is a language of its own.  Repeated rows are judged once;
    whole texts are read however long they are; other columns, whatever they
    are called, are not looked at; an empty table gives no rows, and without
    trusted labels all are kept.
    """
    return classified(*perplexities(docs, labels, **cols))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every document: its perplexity under the model of its language, the quantile it is held against, and the verdict.

    Nulls, empty and long texts, repeated rows and empty tables as in ``classify``.
    """
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "lang", "tokens", "perplexity", "threshold", "keep")
