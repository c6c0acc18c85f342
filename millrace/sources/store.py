"""Versioned Parquet snapshots of the tables, and written copies of intermediate results."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEYS, TABLES


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read back: lineage ends, executors may go."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_bytes(fs, path) -> bytes:
    stream = fs.open(path)
    content = bytes(stream.readAllBytes())
    stream.close()
    return content


#: Rows up to which a table is sent to all executors.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which are counted first; a larger side is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A change of a table: the keys whose rows go, and the rows that come.
Change = tuple[DataFrame, DataFrame]
Segments = list[dict[str, str | None]]


def _segments(where: str | Segments) -> Segments:
    return [{"rows": where, "gone": None}] if isinstance(where, str) else where


class Store:
    """Tables as folders of Parquet; numbered pointers name the folders of each, and the highest number counts.

    A snapshot never overwrites what is being read: every write goes to a new
    folder, and the pointers of all tables written together change at once.
    A change of a few rows is written as a segment, the rows that come and the
    keys that go, which is read on top of the segments before it; many segments
    become one, and the base is written anew when they are a good part of it.
    Who writes first claims the next number; another who wants it waits, and
    then builds on what the first has written, so no update is lost.
    """

    #: Segments on top of a table's base before they become one, and the share of the base from which it is written anew.
    SEGMENTS, SHARE = 8, 0.25

    def __init__(self, spark: SparkSession, folder: str, patience: float = 60.0):
        self.spark, self.folder, self.patience = spark, folder.rstrip("/"), patience

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _latest(self) -> int:
        """The highest number of a pointer, or -1."""
        fs, path = self._path("pointers")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def _tables(self, number: int) -> dict[str, str | Segments]:
        if number < 0:
            return {}
        rows = self.spark.read.text(f"{self.folder}/pointers/{number}", wholetext=True).collect()  # one small file
        return json.loads(rows[0][0])

    def pointers(self) -> dict[str, str | Segments]:
        return self._tables(self._latest())

    def read(self, table: str) -> DataFrame:
        """The table's last snapshot, or no rows."""
        where = self.pointers().get(table)
        if where is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self._rows(table, _segments(where))

    def _gone(self, table: str, segments: Segments) -> DataFrame | None:
        """Keys that go by any of the segments."""
        folders = [f"{self.folder}/{s['gone']}" for s in segments if s.get("gone")]
        return self.spark.read.schema(f"{KEYS[table]} string").parquet(*folders) if folders else None

    def _rows(self, table: str, segments: Segments) -> DataFrame:
        """Rows of each segment whose keys do not go by a later one."""
        out = None
        for i, s in enumerate(segments):
            rows = self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{s['rows']}")
            if (gone := self._gone(table, segments[i + 1 :])) is not None:
                rows = rows.join(gone, KEYS[table], "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _put(self, df: DataFrame, table: str) -> str:
        where = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{where}")
        return where

    def _bytes(self, segments: Segments) -> int:
        return sum(fs.getContentSummary(path).getLength() for s in segments for name in (s["rows"], s.get("gone")) if name for fs, path in [self._path(name)])

    def _compacted(self, table: str, segments: Segments) -> Segments:
        """Fewer segments of the same rows, if there are many."""
        base, more = segments[:1], segments[1:]
        if len(more) <= self.SEGMENTS:
            return segments
        if self._bytes(more) >= self.SHARE * self._bytes(base):
            return [{"rows": self._put(self._rows(table, segments), table), "gone": None}]
        gone = self._gone(table, more)
        return [*base, {"rows": self._put(self._rows(table, more), table), "gone": None if gone is None else self._put(gone.distinct(), table)}]

    def _claim(self) -> int:
        """The next number, for this writer alone."""
        until = time.monotonic() + self.patience
        while True:
            number = self._latest() + 1
            fs, path = self._path(f"claims/{number}")
            try:
                fs.create(path, False).close()
                return number
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception.toString()):
                    raise
            if time.monotonic() > until:
                raise TimeoutError(f"another writer holds {path.toString()}; remove it if that writer is gone")
            time.sleep(0.2)

    def write(self, **tables: DataFrame | Change) -> None:
        """New snapshots of ``tables``, seen together: whole tables, or changes (keys that go, rows that come) of those that have a key."""
        fresh: dict[str, str | dict] = {}
        for name, what in tables.items():
            gone, df = what if isinstance(what, tuple) else (None, what)
            rows = self._put(df.select(*[c.split(" ")[0] for c in TABLES[name].split(", ")]), name)
            fresh[name] = rows if gone is None else {"rows": rows, "gone": self._put(gone.select(KEYS[name]).distinct(), name)}
        number = self._claim()
        held = self._tables(number - 1)
        for name, what in fresh.items():
            held[name] = what if isinstance(what, str) else self._compacted(name, [*_segments(held[name]), what])
        fs, new = self._path(f"fresh-{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(json.dumps(held).encode())
        out.close()
        fs.mkdirs(self._path("pointers")[1])
        if not fs.rename(new, self._path(f"pointers/{number}")[1]):
            raise OSError(f"pointer {number} could not be put in place")

    def ensure(self) -> None:
        """Creates the tables that are not there; the others stay."""
        there = self.pointers()
        missing = {t: self.spark.createDataFrame([], s) for t, s in TABLES.items() if t not in there}
        if missing:
            self.write(**missing)
