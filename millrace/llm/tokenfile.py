"""Token-id files of patched frame-of-reference blocks.

A block holds up to 1,024 ids: their minimum, the differences to it packed at
the width that most of them need, and lists of the exceptions that need more.
A chunk is a row of a Parquet file: the documents it holds, its blocks one
after another, and where each block starts.  Parquet is the container because
Spark commits its files as a whole, whichever executor is lost, in any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, shared_folder, short_batches, table
from .tokens import encoder, tokenizer_path

BLOCK = 1024
LANES = BLOCK // 64
#: The packing width fits this share of a block's ids; the others are exceptions.
PERCENTILE = 90
#: A chunk is closed when it holds so many ids.
CHUNK = 1 << 16
END = 2

CHUNK_SCHEMA = "part int, chunk int, start bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, block_starts array<bigint>, payload binary"


@cache
def _places(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each of 64 values below 2^width the word it begins in and the bit there; which ones go on in the next word; the first value of every word."""
    word, bit = np.divmod(np.arange(64) * width, 64)
    return word, bit.astype(np.uint64)[:, None], np.flatnonzero(bit + width > 64), np.searchsorted(word, np.arange(width))


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 64, LANES) values below 2^width to (blocks, width, LANES) words."""
    word, bit, on, first = _places(width)
    out = np.bitwise_or.reduceat(v << bit, first, axis=1)
    out[:, word[on] + 1] |= v[:, on] >> (np.uint64(64) - bit[on])
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    word, bit, on, _ = _places(width)
    v = words[:, word] >> bit
    v[:, on] |= words[:, word[on] + 1] << (np.uint64(64) - bit[on])
    v &= np.uint64((1 << width) - 1)
    return v


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of unsigned 32-bit ``ids`` as bytes, and the byte at which each starts.

    A block: number of ids (u16), width (u8), number of exceptions (u16),
    minimum (u32), packed words, positions (u16) and values (u32) of exceptions.
    """
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    padded = padded.reshape(blocks, BLOCK)
    least = padded.min(axis=1)
    over = padded - least[:, None]
    kth = np.partition(over, BLOCK * percentile // 100 - 1, axis=1)[:, BLOCK * percentile // 100 - 1]
    widths = np.array([max(1, int(k).bit_length()) for k in kth])
    out: list[bytes] = [b""] * blocks
    for width in set(widths.tolist()):
        which = np.flatnonzero(widths == width)
        part = over[which]
        beyond = part > np.uint64((1 << width) - 1)
        words = _pack(np.where(beyond, 0, part).astype(np.uint64).reshape(-1, 64, LANES), width)
        for k, at in enumerate(which.tolist()):
            there = np.flatnonzero(beyond[k])
            count = min(BLOCK, n - at * BLOCK)
            head = count.to_bytes(2, "little") + width.to_bytes(1, "little") + len(there).to_bytes(2, "little") + int(least[at]).to_bytes(4, "little")
            out[at] = head + words[k].tobytes() + there.astype("<u2").tobytes() + part[k][there].astype("<u4").tobytes()
    starts = np.cumsum([0, *map(len, out[:-1])])
    return b"".join(out), starts


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids that ``encode_blocks`` was given."""
    heads = [(at, data[at + 2], int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 3 : at + 5], "little"), int.from_bytes(data[at + 5 : at + 9], "little")) for at in map(int, starts)]
    out = np.empty((len(heads), BLOCK), np.uint32)
    for width in {h[1] for h in heads}:
        which = [k for k, h in enumerate(heads) if h[1] == width]
        size = width * LANES * 8
        words = np.frombuffer(b"".join(data[heads[k][0] + 9 : heads[k][0] + 9 + size] for k in which), np.uint64).reshape(-1, width, LANES)
        values = _unpack(words, width).reshape(-1, BLOCK).astype(np.uint32)
        for row, k in enumerate(which):
            at, _, _, n, least = heads[k]
            at += 9 + size
            there = np.frombuffer(data, "<u2", n, at)
            values[row][there] = np.frombuffer(data, "<u4", n, at + 2 * n)
            out[k] = values[row] + np.uint32(least)
    flat = out.reshape(-1)
    return flat[: (len(heads) - 1) * BLOCK + heads[-1][2]] if heads else flat


def _chunks(path: str, end: int, percentile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, start = TaskContext.get().partitionId(), 0, 0
        encode, tail = encoder(path).encode, int(end).to_bytes(4, "little")
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in held]
            data, starts = encode_blocks(np.frombuffer(b"".join(held), "<u4"), percentile)
            cols = [[part], [chunk], [start], [sum(lengths)], [docs], [lengths], [starts.tolist()], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "chunk", "start", "n_ids", "doc_ids", "lengths", "block_starts", "payload"])

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids_of), 256):
                for d, ids in zip(ids_of[lo : lo + 256], encode(texts.slice(lo, 256).to_pylist())):
                    docs.append(d)
                    held.append(ids + tail)
                    size += len(ids) // 4 + 1
                    if size >= CHUNK:
                        yield closed()
                        chunk, start = chunk + 1, start + size
                        docs, held, size = [], [], 0
        if docs:
            yield closed()

    return run


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, percentile: int = PERCENTILE) -> None:
    """Writes the ids of all texts to ``folder``, in ascending order of their ids.

    A null text counts as empty and has the end id only; a null id comes first.
    Rows of equal id follow each other by text, repeated ones each for itself.
    Texts are encoded whole however long, and may fill several chunks' worth in
    one; other columns are not looked at, whatever they are called.  An empty
    table gives no chunks.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "d").sortWithinPartitions("d", "t")
    rows.mapInArrow(_chunks(path or tokenizer_path(), end, percentile), CHUNK_SCHEMA).write.parquet(folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_blocks(row["payload"], np.array(row["block_starts"], np.int64)).astype("<u4")
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                names=["part", "d", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a folder, with ``before``: the ids in all earlier files."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(folder)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each file
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).drop("n")
    return chunks.join(F.broadcast(before), "part")


def digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32."""
    chunks = read_tokens(spark, folder)
    before = chunks.select("part", "before").distinct()
    rows = spark.read.schema(CHUNK_SCHEMA).parquet(folder).mapInArrow(_digests, "part int, d bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(before), "part").select(F.col("d").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_patched_frame_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token file of all documents and reads it back: one digest for every row, awkward ones as in ``write_tokens``."""
    import uuid

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return digests(spark, folder)
