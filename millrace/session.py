"""The engine over one source tree: index it, keep it fresh, and ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import SEMANTIC_K
from .functions.extract import Extractor, extracted
from .functions.gist import gist
from .functions.vector import Embedder, embedded, nearest
from .operators import changes as ch
from .operators import graph, memory, rank, views
from .operators.resolve import candidates, file_keys, folders, matched
from .sources import tree
from .sources.store import Change, Store, materialized


Progress = Callable[[int, str], None]


class Index:
    """Snapshots of files, symbols, imports, edges, tasks and rules of the tree under ``root``.

    ``parity`` keeps known quirks of import resolution; ``keep_removed`` keeps
    files that are gone.  Without an ``embedder`` nothing is searched by vector;
    an ``extractor`` is a second pass over sources besides the patterns.
    """

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, embedder: Embedder | None = None, parity: bool = False, keep_removed: bool = False, extractor: Extractor | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, store or f"{self.root}/.millrace/tables")
        self.embedder, self.parity, self.keep_removed, self.extractor = embedder, parity, keep_removed, extractor

    def init(self) -> None:
        self.store.ensure()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def scan(self, paths: DataFrame | None = None) -> DataFrame:
        settings = tree.config(self.spark, self.root).get("indexing", {})
        return tree.scan(self.spark, self.root, settings.get("include"), settings.get("exclude", []), paths=paths)

    def index(self, progress: Progress | None = None) -> dict[str, int]:
        """Brings the tables up to date with the tree; returns counts."""
        self.init()
        return self.refresh(self.scan(), progress=progress)

    def refresh(self, scanned: DataFrame, partial: bool = False, progress: Progress | None = None) -> dict[str, int]:
        """Brings the tables up to date with ``scanned`` (path, content, content_hash, error); if ``partial``, files not in it stay.

        Only new and changed contents are parsed.  Of the edges those are
        resolved again whose file changed, and those of imports that may mean a
        file that came or went; so a new file is found by imports that were
        there before.  A change of the module, a package or a crate resolves all.
        ``progress`` is told percents and what is being done.
        """
        tell = progress or (lambda percent, what: None)
        tell(0, "Comparing")
        stored = self.table("files")
        known = stored.join(scanned.select("path"), "path", "left_semi") if partial else stored
        status = materialized(ch.changes(scanned, known, self.embedder is not None).where("status <> 'unchanged'"), "changes")
        work = status.where(F.col("status").isin("new", "changed", "retry")).select("path")
        gone = status.where("status = 'removed'").select("path")
        if partial or self.keep_removed:
            gone = gone.limit(0)
        touched = work.union(gone)
        if touched.isEmpty():
            tell(100, "Indexed")
            return self.counts()
        tell(30, f"Parsing {work.count()} files")
        texts = scanned.join(work, "path", "left_semi")
        parsed = materialized(extracted(texts, self.parity, self.extractor, deep=True), "parsed")
        fresh = parsed.join(scanned.select("path", "content_hash", F.col("error").alias("unread")), "path")
        fresh = fresh.select("path", "content_hash", gist(F.col("symbols"), F.col("imports")).alias("summary"), F.col("error").isNotNull().alias("stale"), F.current_timestamp().alias("last_indexed"), F.coalesce("error", "unread").alias("error"))
        fresh = materialized(embedded(fresh, "summary", self.embedder), "fresh")
        symbols = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.type", F.col("s.line").alias("start_line"), F.col("s.end").alias("end_line"), "s.docstring", "s.scope")
        imports = parsed.select("path", "ext", F.explode("imports").alias("i")).select("path", "ext", "i.pos", "i.source", "i.type", "i.dynamic")
        facts = materialized(tree.workspace(texts), "workspace")
        tell(70, "Resolving imports")
        moved = status.where(F.col("status") == "new").select("path").union(gone)
        self._changed(touched, moved, fresh, symbols, imports, facts)
        tell(100, "Indexed")
        return self.counts()

    def counts(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in ("files", "symbols", "edges")} | {"errors": self.table("files").where("error is not null").count()}

    def _changed(self, touched: DataFrame, moved: DataFrame, *fresh: DataFrame) -> None:
        """Writes what a change of the ``touched`` files means, of which some ``moved`` in or out: ``fresh`` are their new files, symbols, imports and workspace facts.

        Only rows that change are written, unless there were none before.
        """
        touched, moved = materialized(touched.distinct(), "touched"), materialized(moved, "moved")
        changes = dict(zip(("files", "symbols", "imports", "workspace"), ((touched, x) for x in fresh)))
        files, imports = (ch.replaced(self.table(t), *changes[t]) for t in ("files", "imports"))
        before = self.table("workspace")
        workspace = ch.replaced(before, *changes["workspace"])
        settled = before.exceptAll(workspace).union(workspace.exceptAll(before)).isEmpty()
        if self.table("files").isEmpty():
            settled, changes = False, dict(zip(changes, fresh))
        wanted, edges = self._resolved(files, imports, touched, moved, workspace, settled)
        self.store.write(**changes, candidates=wanted, edges=edges)

    def _resolved(self, files: DataFrame, imports: DataFrame, touched: DataFrame, moved: DataFrame, workspace: DataFrame, settled: bool) -> tuple[DataFrame | Change, DataFrame | Change]:
        """Candidates and edges: whole tables, or the change that what ``touched`` files and those that were ``moved`` in or out have to do with makes, if the workspace is ``settled``."""
        paths = files.select("path")
        facts = tree.packages(workspace), tree.go_module(workspace), tree.crates(workspace), self.parity
        if not settled:
            wanted = materialized(candidates(imports, paths, *facts), "candidates")
            return wanted, matched(wanted, paths)
        again = touched.select("path")
        if not moved.isEmpty():  # where a crate begins may depend on what folders there are
            again = again.union(imports.where("ext = '.rs'").select("path")).distinct()
        again = materialized(again.withColumnRenamed("path", "src"), "again")
        fresh = materialized(candidates(imports.join(again.withColumnRenamed("src", "path"), "path", "left_semi"), paths, *facts), "candidates")
        wanted = self.table("candidates").join(again, "src", "left_anti").unionByName(fresh)
        keys = file_keys(moved).select(F.lower("key").alias("lc")).union(folders(moved).select(F.lower("key"))).distinct()
        met = wanted.withColumn("lc", F.lower("key")).join(keys, "lc", "left_semi").select("src")
        affected = materialized(met.union(again).distinct(), "affected")
        return (again, fresh), (affected, matched(wanted.join(affected, "src", "left_semi"), paths))

    def remove(self, paths: list[str] | DataFrame) -> None:
        """Files go, with their symbols, imports and edges; what imported them is resolved to what is left."""
        gone = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        self._changed(gone, gone, *(self.table(t).limit(0) for t in ("files", "symbols", "imports", "workspace")))

    def _starts(self, paths: list[str]) -> DataFrame:
        """The stored spelling of ``paths``, whatever their case."""
        asked = self.spark.createDataFrame([(i, p.lower()) for i, p in enumerate(paths)], "origin int, lc string")
        return self.table("files").select(F.col("path").alias("node"), F.lower("path").alias("lc")).join(F.broadcast(asked), "lc").select("origin", "node")

    def blast_radius(self, *paths: str) -> DataFrame:
        """(path, depth) of what may break; flagged files with their flag."""
        found = graph.blast_radius(self.table("edges"), self._starts(list(paths)))
        return found.groupBy(graph.shown().alias("path")).agg(F.min("depth").alias("depth")).orderBy("depth", "path")

    def direct_dependents(self, path: str) -> DataFrame:
        return graph.direct_dependents(self.table("edges"), path)

    def radius_size(self, path: str) -> int:
        """How many files a change of ``path`` may break."""
        row = graph.radius_size(graph.blast_radius(self.table("edges"), self._starts([path]))).first()
        return row["size"] if row else 0

    def related_tests(self, *paths: str) -> DataFrame:
        return graph.related_tests(self.table("edges"), self._starts(list(paths)))

    def semantic_search(self, query: str, k: int = SEMANTIC_K) -> DataFrame:
        if self.embedder is None:
            raise ValueError("there is no embedder")
        return nearest(self.table("files"), self.embedder([query])[0], k)

    def context_pack(self, task: str, budget_tokens: int | None = None) -> dict:
        hits = self.semantic_search(task) if self.embedder else None
        return rank.context_pack(self.spark, task, self.table("files"), self.table("symbols"), self.table("edges"), self.table("rules"), hits, budget_tokens)

    def symbols_of(self, path: str) -> DataFrame:
        return self.table("symbols").where(F.lower("path") == path.lower())

    def add_rule(self, name: str, description: str, scope_type: str = "global", scope_value: str = "", severity: str = "info") -> None:
        self.store.write(rules=memory.appended(self.table("rules"), name=name, description=description, scope_type=scope_type, scope_value=scope_value, severity=severity))

    def record_task(self, description: str, type: str = "unknown", outcome: str = "success", notes: str = "") -> None:
        self.store.write(tasks=memory.appended(self.table("tasks"), description=description, type=type, outcome=outcome, notes=notes))

    def remove_rule(self, id: int) -> None:
        self.store.write(rules=memory.removed(self.table("rules"), id))

    def remove_task(self, id: int) -> None:
        self.store.write(tasks=memory.removed(self.table("tasks"), id))

    def tasks(self) -> DataFrame:
        return memory.recent(self.table("tasks"))

    def rules(self) -> DataFrame:
        return memory.recent(self.table("rules"), None)

    def stats(self) -> DataFrame:
        return views.stats(*(self.table(t) for t in ("files", "symbols", "edges", "tasks", "rules")))

    def memory(self) -> DataFrame:
        return views.memory(self.table("files"), self.table("symbols"))

    def files(self) -> DataFrame:
        return views.file_list(self.table("files"))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and links."""
        return graph.graph_nodes(self.table("edges"), self.table("files"), self.table("symbols")), graph.graph_links(self.table("edges"))
