"""Order-preserving packing: dynamic programming over document and sentence ends."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table
from .tokens import REMEMBERED, encoder, tokenizer_path

LENGTH = 1024
END = 0
#: What a cut at the end of a sentence costs, and one within a sentence, in tokens of padding.
SENTENCE_CUT, INNER_CUT = 2, 6
#: Within a sentence there may be a cut after every so many tokens.
STEP = 24
#: So many tokens are planned together; the last sequence of a plan is opened again in the next.
PLAN = 1 << 20

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cuts(ends: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into ``ends`` (ascending token positions at which a cut may be) of the cheapest cuts.

    Windows between consecutive cuts hold ``length`` tokens at most; a window
    costs what it lacks of that, and its cut ``costs``.  The last position is
    always cut, and the window before it pays nothing for padding, as more
    tokens may follow.  With best(j) = cost(j) + length - ends(j) + min over i
    of best(i) + ends(i), the minimum is over a sliding window, which a queue
    of increasing values keeps.
    """
    pos, cost = ends.tolist(), costs.tolist()
    n = len(pos)
    best, back = [0.0] * n, [-1] * n
    queue: deque[tuple[float, int, int]] = deque([(0, 0, -1)])  # (best + position, position, index)
    for j in range(n):
        p = pos[j]
        while queue[0][1] < p - length:
            queue.popleft()
        if j < n - 1:
            value, _, back[j] = queue[0]
            value += cost[j] + length - p
        else:  # no padding: the best alone counts, among the cuts that the last window can reach
            value, back[j] = 0.0 if p <= length else float("inf"), -1
            for i in range(j - 1, -1, -1):
                if pos[i] < p - length:
                    break
                if best[i] < value:
                    value, back[j] = best[i], i
            value += cost[j]
        best[j] = value
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], n - 1
    while j >= 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def plan(ids: np.ndarray, lengths: list[int], sentence_end: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Token positions at which the stream of ``ids`` of documents of ``lengths`` is cut, the last one included."""
    doc_ends = np.cumsum(lengths)
    kind = np.zeros(len(ids) + 1, np.uint8)
    kind[1:][sentence_end[ids]] = 1
    kind[doc_ends] = 2
    at = np.flatnonzero(kind)
    # Within long sentences: every STEP tokens from their start.
    gaps = np.diff(at, prepend=0)
    inner = (gaps - 1) // STEP
    first = np.repeat(at - gaps, inner)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    kind[first + nth * STEP] = 3
    at = np.flatnonzero(kind)
    cost = np.array([0, SENTENCE_CUT, 0, INNER_CUT])[kind[at]]
    return at[cuts(at, cost, length)]


def _pieces(path: str, end: int, length: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(path, remembered)
        tail, sequence = int(end).to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        # Documents of this plan: id, tokens in all, where in the document the held ids start, the held ids.
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        size = 0

        def closed(last: bool) -> pa.RecordBatch:
            nonlocal held, size, sequence
            ids, lengths = np.concatenate([h[3] for h in held]), [len(h[3]) for h in held]
            at = plan(ids, lengths, e.ends, length).tolist()
            stop = len(ids) if last or len(at) < 2 else at[-2]
            rows: list[tuple] = []
            rest = []
            doc_at, w = 0, 0
            for d, total, start, own in held:
                p = doc_at
                doc_at += len(own)
                while p < min(doc_at, stop):
                    q = min(doc_at, at[w])
                    rows.append((d, start + p - doc_at + len(own), q - p, zlib.crc32(ids[p:q]), total, sequence + w, p - (at[w - 1] if w else 0)))
                    p = q
                    if p == at[w]:
                        w += 1
                if doc_at > stop:
                    cut = max(0, stop - (doc_at - len(own)))
                    rest.append((d, total, start + cut, own[cut:]))
            held, size, sequence = rest, sum(len(r[3]) for r in rest), sequence + w
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(docs), 256):
                for d, data in zip(docs[lo : lo + 256], e.encode(texts.slice(lo, 256).to_pylist())):
                    ids = np.frombuffer(data + tail, "<u4")
                    held.append((d, len(ids), 0, ids))
                    size += len(ids)
                    if size >= PLAN:
                        yield closed(False)
        if held:
            yield closed(True)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, length: int = LENGTH, remembered: int = REMEMBERED) -> DataFrame:
    """Packs all rows, in the order they are stored in, into sequences of ``length`` tokens at most.

    Every partition of the table is packed as it stands, without a shuffle, so
    only the last sequence of a partition may be far from full.  A document is
    cut at sentence ends where that saves padding, and elsewhere only where it
    has no sentence end for long.  Each id lies in exactly one piece.  A null
    text counts as empty and has the end id only; repeated rows are packed one
    by one, and so are rows without an id; texts are packed whole however long,
    over several plans if need be; other columns are not looked at, whatever they
    are called; an empty table gives no pieces.  Returns one row per piece.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_pieces(path or tokenizer_path(), end, length, remembered), PIECES).withColumnRenamed("doc_id", id_col)


def op5_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, one row for every piece; awkward rows as in ``pack``."""
    return pack(table(spark, sf_dir, "documents"))
