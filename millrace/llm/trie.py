"""Conversation prefix trie by truncation peeling: from the deepest turns up, what ends at a depth joins what survives there, and loses its last turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small, table, written

#: Turns a conversation may borrow from the first one of its hundred, less one.
BORROWED, HUNDRED = 6, 100
#: Depths that are peeled by jobs over all conversations.  Deeper subtrees are peeled in one task each, as far as they are small.
LEVELS = 16
#: Turns of different conversations in a subtree that one task peels; larger subtrees are peeled by jobs for LEVELS more depths.
TASK_TURNS = 100_000
#: Ids of one chunk of a list that is hashed.
CHUNK = 16_384
BROADCAST_ROWS = 1_000_000

NODE = "a bigint, b bigint, pa bigint, pb bigint, conv_id bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"
NODE_COLUMNS = [f.split()[0] for f in NODE.split(", ")]


def numbered_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, pos, x, y, chars) of every turn: its place from 1 on, 128 bits of role and text, and code points of the text.

    Turns are dealt by ranges of conversation and turn and counted by range, so
    that a conversation of any length is spread over many tasks.
    """
    spark = convs.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1), role, text).alias("y"), F.length(text).cast("long").alias("chars"))
    # Turns of one number go by their hashes, so that no text is shuffled.
    ranged = rows.repartitionByRange(partitions(spark), "conv_id", "turn", "x", "y").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "x", "y")
    rows = written(ranged.select("conv_id", "part", F.row_number().over(within).alias("i"), "x", "y", "chars"), "turns")
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("m"))
    before = counts.select("conv_id", "part", (F.sum("m").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("m")).alias("before")).where("before > 0")
    placed = rows.join(small(written(before, "before"), BROADCAST_ROWS), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "x", "y", "chars")


def rebuilt(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c), (c, depth, x, y, chars)): all conversations, and their turns once they begin with those of the first of their hundred.

    x and y are hashes of a turn and its depth, so that all up to a depth, taken
    by exclusive or, name the prefix.
    """
    turns = written(numbered_turns(convs), "numbered")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("m"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    plan = written(own.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"), h.alias("h")), "plan")
    bases = turns.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < BORROWED))
    heads = bases.groupBy("conv_id").agg(F.max("pos").alias("there"), F.sort_array(F.collect_list(F.struct("pos", "x", "y", "chars"))).alias("head"))
    heads = written(heads.withColumnRenamed("conv_id", "base"), "heads")
    plan = written(plan.join(small(heads, BROADCAST_ROWS), "base", "left").select("c", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), F.slice("head", F.lit(1), F.col("h").cast("int")).alias("head")), "borrowed")
    first = plan.select("c", F.explode("head").alias("t")).select("c", F.col("t.pos").alias("depth"), "t.x", "t.y", "t.chars")
    rest = turns.join(small(plan.select(F.col("c").alias("conv_id"), "h", "taken"), BROADCAST_ROWS), "conv_id").where("pos > h").select(F.col("conv_id").alias("c"), (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "x", "y", "chars")
    named = lambda seed: F.xxhash64(F.lit(seed), "depth", "x", "y")
    return plan.select("c"), written(first.unionByName(rest).select("c", "depth", named(2).alias("x"), named(3).alias("y"), "chars"), "rebuilt")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, first, ids): runs of a list's ids, comma-joined; rows come in order."""
    a, b, first, ids = [], [], [], []
    run: tuple | None = None
    held: list[int] = []

    def close() -> None:
        if run is not None:
            a.append(run[0])
            b.append(run[1])
            first.append(held[0])
            ids.append(",".join(map(str, held)))

    for batch in batches:
        for x, y, c in zip(*(col.to_pylist() for col in batch.columns)):
            if run != (x, y) or len(held) >= CHUNK:
                close()
                run, held = (x, y), []
            held.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], names=["a", "b", "first", "ids"])
        a, b, first, ids = [], [], [], []
    close()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], names=["a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sha) of lists whose chunks come in order; of a list only the hash's state is held."""
    run, state = None, hashlib.sha256()
    done: list[tuple] = []
    for batch in batches:
        for x, y, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if run != (x, y):
                if run is not None:
                    done.append((*run, state.hexdigest()))
                run, state = (x, y), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if run is not None:
        done.append((*run, state.hexdigest()))
    cols = list(zip(*done)) if done else [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["a", "b", "sha"])


def end_hashes(whole: DataFrame, sequences: DataFrame) -> DataFrame:
    """(a, b, sha): SHA-256 of the ascending ids of all conversations (``whole``: c, a, b) of each of the ``sequences`` (a, b, n, rep)."""
    spark = whole.sparkSession
    one = sequences.where("n = 1").select("a", "b", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("sha"))
    many = whole.select("c", "a", "b").join(small(sequences.where("n > 1").select("a", "b"), BROADCAST_ROWS), ["a", "b"], "left_semi")
    ranged = many.select("a", "b", "c").repartitionByRange(partitions(spark), "a", "b", "c").sortWithinPartitions("a", "b", "c")
    chunks = written(ranged.mapInArrow(_chunks, "a bigint, b bigint, first bigint, ids string"), "chunks")
    lists = chunks.repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b", "first")
    return one.unionByName(lists.mapInArrow(_digests, "a bigint, b bigint, sha string"))


def _path(upto: int) -> Column:
    """Prefixes (a, b, chars) of the first turns, from an array of them in order."""
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("chars"))
    step = lambda done, t: F.array_append(done, F.struct(F.element_at(done, -1)["a"].bitwiseXOR(t["x"]).alias("a"), F.element_at(done, -1)["b"].bitwiseXOR(t["y"]).alias("b"), t["chars"].alias("chars")))
    return F.slice(F.aggregate(F.slice("turns", F.lit(1), F.lit(upto)), F.array(zero), step), F.lit(2), F.lit(upto))


def _peeled(top: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Nodes deeper than ``top`` of one subtree; rows are turns (rep, n, a, b, depth, x, y, chars), a and b of the prefix of ``top`` turns."""
        nodes: dict[int, dict[tuple[int, int], list]] = {}
        turns: dict[int, list] = {}
        for r in rows.sort_values(["rep", "depth"]).itertuples(index=False):
            turns.setdefault(r.rep, [r.n, [(r.a, r.b, 0)]])[1].append((r.x, r.y, r.chars))
        ended: dict[int, list] = {}
        for rep, (n, steps) in turns.items():
            a, b, _ = steps[0]
            path = [(a, b, 0)]
            for x, y, chars in steps[1:]:
                a, b = a ^ x, b ^ y
                path.append((a, b, chars))
            ended.setdefault(len(path) - 1, []).append((path, rep, n))
        alive: list = []  # (path, conv, n, leaves, saved) of the children of the depth at hand
        for depth in range(max(ended), 0, -1):
            here: dict[tuple[int, int], list] = {}
            for path, rep, n, kids, leaves, saved in [*((p, c, n, 1, l, s) for p, c, n, l, s in alive), *((p, c, n, 0, 0, 0) for p, c, n in ended.get(depth, []))]:
                node = here.setdefault(path[depth][:2], [path, rep, 0, 0, 0, 0])
                node[1] = min(node[1], rep)
                for k, v in enumerate((n, kids, leaves, saved), 2):
                    node[k] += v
            for node in here.values():
                node[4] = node[4] or 1
                node[5] += (node[2] - 1) * node[0][depth][2]
            nodes[depth] = here
            alive = [(p, c, n, leaves, saved) for p, c, n, _, leaves, saved in here.values()]
        out = []
        for depth, here in nodes.items():
            for (a, b), (path, conv, n, kids, leaves, saved) in here.items():
                above = nodes[depth - 1][path[depth - 1][:2]][1] if depth > 1 else None
                out.append((a, b, *path[depth - 1][:2], conv, depth + top, above, n, kids, leaves, saved))
        return pd.DataFrame(out, columns=NODE_COLUMNS).astype({"parent": "Int64"})

    return run


def _chains(open_: DataFrame, turns: DataFrame, top: int) -> DataFrame:
    """Nodes deeper than ``top`` of sequences that have their subtree to themselves: one a turn, told by the turn alone."""
    mine = turns.join(small(open_.select(F.col("rep").alias("c"), "n", "len", "a", "b", "pa", "pb", "ca", "cb"), BROADCAST_ROWS), "c").where(F.col("depth") > top)
    # Sums over the turns below, in two levels, as a conversation may be of any length.
    block = (F.col("depth") / 4096).cast("long")
    rows = mine.withColumn("block", block).withColumn("v", (F.col("n") - 1) * F.col("chars"))
    sums = rows.groupBy("c", "block").agg(F.sum("v").alias("t"))
    below = sums.select("c", "block", (F.sum("t").over(Window.partitionBy("c").orderBy(F.col("block").desc())) - F.col("t")).alias("below"))
    inside = F.sum("v").over(Window.partitionBy("c", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("inside", inside).join(below, ["c", "block"])
    last, first = F.col("depth") == F.col("len"), F.col("depth") == top + 1
    no = F.lit(None).cast("long")
    return out.select(F.when(last, F.col("a")).when(first, F.col("ca")).otherwise(no).alias("a"), F.when(last, F.col("b")).when(first, F.col("cb")).otherwise(no).alias("b"), F.when(first, F.col("pa")).otherwise(no).alias("pa"), F.when(first, F.col("pb")).otherwise(no).alias("pb"), F.col("c").alias("conv_id"), "depth",
                      F.when(~first, F.col("c")).alias("parent"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("inside") + F.col("below")).alias("saved"))


def nodes_of(whole: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(NODE of every node, sequences): ``whole`` (c, len, a, b) has every conversation, ``turns`` (c, depth, x, y, chars) their turns."""
    sequences = written(whole.groupBy("a", "b").agg(F.first("len").alias("len"), F.count("*").alias("n"), F.min("c").alias("rep")), "sequences")
    top, done, roots = LEVELS, [], []
    open_ = sequences
    finished = [sequences.where(F.col("len") <= top)]
    while True:
        # Subtrees below ``top``: by the prefix of one turn more.
        open_ = open_.where(F.col("len") > top)
        if open_.isEmpty():
            break
        upto = turns.where(F.col("depth") <= top + 1).join(small(open_.select(F.col("rep").alias("c")), BROADCAST_ROWS), "c", "left_semi")
        at = lambda d, x: F.bit_xor(F.when(F.col("depth") <= d, F.col(x)))
        keys = upto.groupBy("c").agg(at(top, "x").alias("pa"), at(top, "y").alias("pb"), at(top + 1, "x").alias("ca"), at(top + 1, "y").alias("cb")).withColumnRenamed("c", "rep")
        keyed = written(open_.join(keys, "rep"), "keyed")
        sizes = written(keyed.groupBy("ca", "cb").agg(F.count("*").alias("m"), F.sum(F.col("len") - top).alias("size")), "sizes")
        sized = keyed.join(small(sizes, BROADCAST_ROWS), ["ca", "cb"])
        alone, few = sized.where("m = 1"), sized.where(f"m > 1 and size <= {TASK_TURNS}")
        done.append(written(_chains(alone, turns, top), "chains"))
        deep = turns.where(F.col("depth") > top).join(small(few.select(F.col("rep").alias("c"), "n", F.col("pa").alias("a"), F.col("pb").alias("b"), "ca", "cb"), BROADCAST_ROWS), "c").withColumnRenamed("c", "rep")
        done.append(written(deep.groupBy("ca", "cb").applyInPandas(_peeled(top), NODE), "subtrees"))
        # The subtrees' own nodes go on to be peeled; their paths are those of any of their sequences.
        closed = written(sized.where(f"m = 1 or size <= {TASK_TURNS}").groupBy("ca", "cb").agg(F.min("rep").alias("rep")), "closed")
        roots.append((top, closed))
        open_ = written(sized.where(f"m > 1 and size > {TASK_TURNS}").select("a", "b", "len", "n", "rep"), "open")
        finished.append(open_.where(F.col("len") <= top + LEVELS))
        top += LEVELS
    ended = reduce(DataFrame.unionByName, finished)
    deepest = reduce(DataFrame.unionByName, done) if done else None
    # Paths of what is peeled by jobs: of at most ``top`` turns.
    reps = ended.where("len > 0").select("rep")
    for _, closed in roots:
        reps = reps.unionByName(closed.select("rep"))
    short = turns.where(F.col("depth") <= top).join(small(reps.distinct().withColumnRenamed("rep", "c"), BROADCAST_ROWS), "c", "left_semi")
    paths = short.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("depth", "x", "y", "chars"))).alias("turns")).select(F.col("c").alias("rep"), _path(top).alias("path"))
    paths = written(paths, "paths")
    none = F.array().cast("array<struct<a:bigint,b:bigint,chars:bigint>>")
    leaves = ended.join(paths, "rep", "left").select(F.col("len").alias("depth"), F.coalesce("path", none).alias("path"), F.col("rep").alias("conv_id"), F.col("n").alias("n"), *[F.lit(0).cast("long").alias(k) for k in ("kids", "leaves", "saved")])
    fed = [leaves]
    for at_top, closed in roots:
        own = deepest.where(F.col("depth") == at_top + 1).select("conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), "saved", "a", "b")
        inside = closed.join(paths, "rep").select("ca", "cb", F.slice("path", F.lit(1), F.lit(at_top)).alias("path"))
        fed.append(own.join(inside, (own["a"] == inside["ca"]) & (own["b"] == inside["cb"])).select(F.lit(at_top).cast("long").alias("depth"), "path", "conv_id", "n", "kids", "leaves", "saved"))
    entering = written(reduce(DataFrame.unionByName, fed), "entering")
    out = [] if deepest is None else [deepest]
    alive = None
    last = entering.agg(F.max("depth")).first()[0]
    for depth in range(-1 if last is None else last, -1, -1):
        here = entering.where(F.col("depth") == depth).drop("depth")
        if alive is not None:
            # Strip the last turn of what survives, and regroup with what ends here.
            here = here.unionByName(alive.select(F.slice("path", F.lit(1), F.lit(depth)).alias("path"), "conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), "saved"))
        met = here.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("kids").alias("n_children"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        chars = F.coalesce(F.try_element_at("path", F.lit(-1))["chars"], F.lit(0))
        alive = written(met.select("path", "conv_id", "n_convs", "n_children", F.greatest("l", F.lit(1)).alias("n_leaves"), (F.col("s") + (F.col("n_convs") - 1) * chars).alias("saved")), f"depth{depth}")
        key = lambda k, x: F.coalesce(F.try_element_at("path", F.lit(k))[x], F.lit(0))
        out.append(alive.select(key(-1, "a").alias("a"), key(-1, "b").alias("b"), key(-2, "a").alias("pa"), key(-2, "b").alias("pb"), "conv_id", F.lit(depth).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", "n_children", "n_leaves", "saved"))
    nothing = whole.sparkSession.createDataFrame([], NODE)
    return (reduce(DataFrame.unionByName, out) if out else nothing), sequences


def prefix_trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every prefix of rebuilt conversations.

    ``convs`` (conv_id, turn, role, text).  Conversation c is rebuilt of the
    first h turns of conversation c - c % 100, h = crc32 of its decimal number % 6, and of its
    own turns after its first h.  Turns are ordered by turn, null first, those
    of one number by a hash of role and text, and rows that repeat are turns of
    their own; null roles and texts are empty.  Rows without conv_id take no part.  Of a negative c
    the remainder is negative, too, so that c - c % 100 is nearer to zero.  The root
    has every conversation, those without turns included; a table without
    conversations has no nodes, not even the root.  Texts are taken whole by
    128 bits; other columns are not looked at, whatever they are called.
    """
    ids, turns = rebuilt(convs)
    sums = turns.groupBy("c").agg(F.max("depth").alias("len"), F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    whole = written(ids.join(sums, "c", "left").select("c", zero("len"), zero("a"), zero("b")), "whole")
    nodes, sequences = nodes_of(whole, turns)
    nodes = written(nodes, "nodes")
    # Parents of the first turns are the root, one row; others are found by their prefix.
    root = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("_root")))
    above = nodes.where("depth > 0 and n_children > 0 and a is not null").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("conv_id").alias("_conv"))
    open_ = nodes.where("depth > 1 and parent is null").join(above, (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left")
    known = nodes.where("parent is not null").withColumn("_conv", F.col("parent"))
    top = nodes.where("depth = 1 and parent is null").join(root).withColumn("_conv", F.col("_root"))
    first = nodes.where("depth = 0").withColumn("_conv", F.lit(None).cast("long"))
    columns = ["a", "b", "conv_id", "depth", "_conv", "n_convs", "n_children", "n_leaves", "saved"]
    placed = reduce(DataFrame.unionByName, [x.select(*columns) for x in (open_, known, top, first)])
    ends = end_hashes(whole, sequences).withColumnsRenamed({"a": "_a", "b": "_b"})
    out = placed.join(ends, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    sha = F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", F.col("_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), sha.alias("ends_sha256"))


def op12_truncation_peeling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations; awkward rows as in ``prefix_trie``."""
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id AS c, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT c, 0 AS part, pos, turn FROM convs JOIN t ON t.conv_id = c - c % 100 AND pos <= h
  UNION ALL SELECT c, 1, pos, turn FROM convs JOIN t ON t.conv_id = c AND pos > h),
seqs AS (SELECT c, coalesce(list(turn ORDER BY part, pos) FILTER (WHERE pos IS NOT NULL), []) AS s FROM convs LEFT JOIN parts USING (c) GROUP BY c),
prefixes AS (SELECT c, len(s) AS whole, d, s[1:d] AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE whole = d), '')) AS ends
  FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n - 1) * CASE WHEN n.d > 0 THEN length(n.p[n.d].text) ELSE 0 END AS own FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p),
under AS (
  SELECT k AS d, p[1:k] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, u.n_leaves, u.saved AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN under u ON u.d = n.d AND u.p = n.p LEFT JOIN nodes a ON a.d = n.d - 1 AND a.p = n.p[1:n.d - 1]
"""
