"""Every operator as a query over the given tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STOP_WORDS
from ..functions.extract import extracted
from ..functions.gist import gist, shortened
from ..functions.vector import cosine_distance, nearest
from ..operators import changes, graph, memory, rank, views
from ..operators.pairs import pairs
from ..operators.resolve import as_edges, folders, normalized, resolved
from ..sources import ignore, tree
from ..sources.store import materialized
from ..sources.tree import guarded
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Tables seen as the engine's own: foreign keys are imports, rows are files.


def _node(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, relation): orders depend on customers, these and suppliers on nations, these on regions."""
    pairs = [("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey")]
    out = None
    for table, key, to, ref in pairs:
        e = _t(spark, d, table).select(_node(table, key).alias("src"), _node(to, ref).alias("dst"), F.lit("imports").alias("relation"))
        out = e if out is None else out.unionAll(e)
    return out


FK = """fk AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""


def _starts(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(nodes)], "origin int, node string")


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, relation) from each user to the user of the event before, by the later event's type: full of cycles."""
    e = _t(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"))
    a, b = e, e.select((F.col("event_id") + 1).alias("event_id"), F.col("u").alias("dst"))
    return a.join(b, "event_id").where("u <> dst").select(F.col("u").alias("src"), "dst", relation_of().alias("relation")).distinct()


def relation_of(column: str = "event_type"):
    return F.when(F.col(column) == "signup", "imports:dynamic").when(F.col(column).isin("view", "error"), "imports:type").otherwise("imports")


REL = "CASE WHEN event_type = 'signup' THEN 'imports:dynamic' WHEN event_type IN ('view', 'error') THEN 'imports:type' ELSE 'imports' END"
TR = f"""tr AS (SELECT DISTINCT a.user_id::VARCHAR AS src, b.user_id::VARCHAR AS dst, {REL.replace('event_type', 'a.event_type')} AS relation
  FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE a.user_id <> b.user_id)"""


@query("""SELECT doc_id, source, n_chars FROM documents WHERE n_chars <= 8000 AND source || '/' || lang || '.txt' NOT SIMILAR TO 'src1[0-9]*/.*' AND lang <> 'es'""")
def scan_guard(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars", F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("path"), F.col("n_chars").alias("length"))
    return guarded(docs, excludes=["src1*/**", "**/es.txt"], max_bytes=8000).select("doc_id", "source", "n_chars")


@query("""WITH now AS (SELECT doc_id::VARCHAR AS path, md5(text) AS h FROM documents WHERE source <> 'src3'), old AS (SELECT doc_id::VARCHAR AS path, md5(CASE WHEN lang = 'de' THEN text || '.' ELSE text END) AS h, n_chars < 100 AS stale FROM documents WHERE source <> 'src5')
SELECT coalesce(now.path, old.path) AS path, CASE WHEN now.path IS NULL THEN 'removed' WHEN old.path IS NULL THEN 'new' WHEN now.h <> old.h THEN 'changed' WHEN old.stale THEN 'retry' ELSE 'unchanged' END AS status FROM now FULL JOIN old ON now.path = old.path""")
def content_hash_diff(spark, d):
    docs = _t(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    hashed = lambda text: tree.content_hash(text.cast("binary")).alias("content_hash")
    now = docs.where("source <> 'src3'").select("path", hashed(F.col("text")))
    then = docs.where("source <> 'src5'").select("path", hashed(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))), (F.col("n_chars") < 100).alias("stale"), F.lit("x").alias("summary"))
    return changes.changes(now, then)


@query("SELECT doc_id, lang, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def purge_removed(spark, d):
    gone = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("path")).distinct()
    return changes.without(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), gone, ("doc_id",))


def page_imports(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, pos, source) of the links of every page, as written."""
    return _t(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("pos", "source"))


@query("""SELECT page_id, (u.i - 1)::INTEGER AS pos, u.s AS source FROM (SELECT page_id, unnest([{'i': i, 's': l[i]} for i in range(1, len(l) + 1)]) AS u FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages))""")
def import_extract_pages(spark, d):
    return page_imports(spark, d)


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a script for every brand, which imports the types of its parts, some as types only, some as templates, and defines a function for each size."""
    kind = F.col("p_partkey") % 5
    source = F.replace("p_type", F.lit(" "), F.lit("-"))
    line = F.when(kind == 0, F.concat(F.lit("import type {T} from './"), source, F.lit("'"))).when(kind == 1, F.concat(F.lit("const t"), "p_partkey", F.lit(" = '"), source, F.lit("';\nimport(`./${t"), "p_partkey", F.lit("}`)"))).otherwise(F.concat(F.lit("import x from './"), source, F.lit("'")))
    defined = F.concat(F.lit("function f"), "p_size", F.lit("() {}"))
    rows = _t(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.concat(line, F.lit("\n"), defined).alias("text")))).alias("lines"))
    return rows.select(F.concat("p_brand", F.lit(".ts")).alias("path"), F.array_join("lines.text", "\n").alias("content"))


@query("""WITH x AS (SELECT p_brand, './' || replace(p_type, ' ', '-') AS source, p_partkey % 5 AS k FROM part)
SELECT p_brand || '.ts' AS path, source, CASE WHEN bool_and(k = 0) THEN 'type' ELSE 'value' END AS type, bool_or(k = 1) AS dynamic FROM x GROUP BY ALL""")
def import_merge(spark, d):
    return extracted(source_files(spark, d)).select("path", F.explode("imports").alias("i")).select("path", "i.source", "i.type", "i.dynamic")


@query("""WITH x AS (SELECT p_brand || '.ts' AS path, 'f' || p_size AS name, 1 + sum(CASE WHEN p_partkey % 5 = 1 THEN 3 ELSE 2 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS line FROM part) SELECT path, name, 'function' AS type, line::INTEGER AS line FROM x""")
def extract_symbols(spark, d):
    return extracted(source_files(spark, d)).select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.type", "s.line")


#: For each extension a way to write an import, and what it means; {} is a number.
SPELLINGS = [
    (".ts", "import {{ a }} from './u{}'", "./u{}"), (".tsx", "export {{ a }} from './u{}'", "./u{}"), (".js", "const a = require('./u{}')", "./u{}"), (".jsx", "import './u{}'", "./u{}"), (".vue", "import a from './u{}'", "./u{}"), (".svelte", "export * from './u{}'", "./u{}"),
    (".py", "from ..pkg import u{} as v", "../pkg/u{}"), (".rs", "pub use crate::u{}::T;", "crate::u{}::T"), (".go", 'import x "ex.org/u{}"', "ex.org/u{}"), (".java", "import static org.x.u{};", "org.x.u{}"), (".kt", "import org.x.u{}", "org.x.u{}"), (".scala", "import org.x.u{}", "org.x.u{}"),
    (".rb", "require_relative 'u{}'", "u{}"), (".php", "use App\\\\u{};", "App/u{}"), (".c", "#include <u{}.h>", "u{}.h"), (".cpp", '#include "u{}.h"', "u{}.h"), (".m", '#import "u{}.h"', "u{}.h"), (".cs", "using X.u{};", "X.u{}"), (".swift", "import X_u{}", "X/u{}"), (".lua", 'local a = require "x.u{}"', "x/u{}"),
    (".dart", "import 'u{}.dart';", "u{}.dart"), (".ex", "alias X.U{}", "x/u{}"), (".zig", 'const a = @import("u{}.zig");', "u{}.zig"), (".sh", "source u{}.sh", "u{}.sh"), (".ps1", ". ./u{}.ps1", "./u{}.ps1"), (".jl", 'include("u{}.jl")', "u{}.jl"), (".v", '`include "u{}.v"', "u{}.v"), (".sv", '`include "u{}.sv"', "u{}.sv"),
]
_SPELLED = ", ".join("'" + want.format("{}") + "'" for _, _, want in SPELLINGS)
_EXTENSIONS = ", ".join(f"'{ext}'" for ext, _, _ in SPELLINGS)


@query(f"SELECT 'f' || l_orderkey || '-' || l_linenumber || ([{_EXTENSIONS}])[l_partkey % {len(SPELLINGS)} + 1] AS path, replace(([{_SPELLED}])[l_partkey % {len(SPELLINGS)} + 1], '{{}}', l_suppkey::VARCHAR) AS source FROM lineitem")
def extract_each_language(spark, d):
    """Every line item as a source file of one of the languages."""
    of = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("l_partkey") % len(SPELLINGS) + 1).cast("int"))
    number = F.col("l_suppkey").cast("string")
    path = F.concat(F.lit("f"), "l_orderkey", F.lit("-"), "l_linenumber", of([ext for ext, _, _ in SPELLINGS]))
    text = F.replace(of([text.replace("\\\\", "\\").format("{}") for _, text, _ in SPELLINGS]), F.lit("{}"), number)
    files = _t(spark, d, "lineitem").select(path.alias("path"), text.alias("content"))
    return extracted(files).select("path", F.explode("imports.source").alias("source"))


#: For each extension a commented declaration of u{} over lines 2 to the number given, with a false one in a string or a comment, and its type.
DECLARATIONS = [
    (".ts", "// About it\nexport function u{}(a = ')') {{\n  return 'class No {{'\n}}\n", "function", 4), (".tsx", "// About it\nexport function u{}(a = 1) {{\n  return `class No {{`\n}}\n", "function", 4), (".js", "/* About it */\nclass u{} {{\n  // function no() {{}}\n}}", "class", 4), (".jsx", "/* About it */\nclass u{} {{\n  /* class No {{ */\n}}", "class", 4),
    (".vue", "<template>class No</template>\n<script>const u{} = async (a) => {{\n  return `let no = 1`\n}}</script>", "variable", 4), (".svelte", "<script lang='ts'>\nlet u{} = 1\n// const no = 2\n</script>", "variable", 2), (".py", '# About it\ndef u{}(a):\n    """def no(): pass"""\n    return a\nx = 1', "function", 4), (".rs", "/// About it\npub fn u{}<'a>(x: &'a str) {{\n    // fn no() {{\n}}", "function", 4),
    (".go", "// About it\nfunc u{}(a int) int {{\n\treturn `func No() {{`\n}}", "function", 4), (".java", '/** About it */\npublic class u{} {{\n  String s = "class No {{";\n}}', "class", 4), (".kt", "// About it\nfun u{}(a: Int) {{\n  /* fun no() /* nested */ class No */\n}}", "function", 4), (".scala", "// About it\nobject u{} {{\n  // def no = 1\n}}", "module", 4),
    (".rb", "# About it\ndef u{}(a)\n  'def no' if a\nend", "method", 4), (".php", '// About it\nfunction u{}($a) {{\n  return "class No {{";\n}}', "function", 4), (".c", '/* About it */\nstatic int u{}(int a) {{\n  return sizeof("int no() {{");\n}}', "function", 4), (".cpp", "// About it\nstruct u{} : Base {{\n  int x; // class No {{\n}};", "struct", 4),
    (".m", "// About it\n- (void) u{} {{\n  // - (int) no {{\n}}", "method", 4), (".cs", "// About it\ninterface u{} {{\n  // class No {{\n}}", "interface", 4), (".swift", '// About it\nfunc u{}(_ a: Int) -> Int {{\n  return "func no() {{".count\n}}', "function", 4), (".lua", "-- About it\nfunction u{}(a)\n  if a then return 'function no()' end\nend", "function", 4),
    (".dart", "// About it\nclass u{} {{\n  var s = 'class No {{';\n}}", "class", 4), (".ex", '# About it\ndefmodule u{} do\n  @x "def no do"\nend', "module", 4), (".zig", "// About it\npub fn u{}(a: i32) void {{\n  // fn no() void {{\n}}", "function", 4), (".sh", "# About it\nu{}() {{\n  echo 'no() {{' # no2() {{\n}}", "function", 4),
    (".ps1", "# About it\nfunction u{} {{\n  <# function no {{ #>\n}}", "function", 4), (".jl", '# About it\nfunction u{}(a)\n  "function no()"\nend', "function", 4), (".v", "// About it\nmodule u{} (input a);\n  // module no;\nendmodule", "class", 4), (".sv", "/* About it */\ninterface u{} (input a);\n  /* class no; */\nendinterface", "class", 4),
]
_DECLARING = ", ".join(f"'{ext}'" for ext, *_ in DECLARATIONS)
_DECLARED_TYPES = ", ".join(f"'{kind}'" for _, _, kind, _ in DECLARATIONS)
_DECLARED_ENDS = ", ".join(str(end) for *_, end in DECLARATIONS)


@query(f"""SELECT 'f' || p_partkey || ext AS path, 'u' || p_size AS name, ([{_DECLARED_TYPES}])[i] AS type, 2 AS line, ([{_DECLARED_ENDS}])[i] AS end_line, CASE WHEN ext IN ('.ts', '.tsx', '.js', '.jsx', '.vue', '.svelte') THEN NULL ELSE 'About it' END AS docstring
FROM (SELECT *, ([{_DECLARING}])[i] AS ext FROM (SELECT p_partkey, p_size, p_partkey % {len(DECLARATIONS)} + 1 AS i FROM part))""")
def symbols_each_language(spark, d):
    """Every part as a source file of one of the languages: what it declares, from where to where, and the comment above; patterns, which scripts go by first, take no comments."""
    of = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("p_partkey") % len(DECLARATIONS) + 1).cast("int"))
    path = F.concat(F.lit("f"), "p_partkey", of([ext for ext, *_ in DECLARATIONS]))
    text = F.replace(of([text.format("{}") for _, text, *_ in DECLARATIONS]), F.lit("u{}"), F.concat(F.lit("u"), "p_size"))
    files = _t(spark, d, "part").select(path.alias("path"), text.alias("content"))
    return extracted(files).select("path", F.explode("symbols").alias("s")).where("s.name like 'u%'").select("path", "s.name", "s.type", "s.line", F.col("s.end").alias("end_line"), "s.docstring")


@query("""WITH f AS (SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' ELSE '/index.ts' END AS path FROM part),
w AS (SELECT DISTINCT replace(p_name, ' ', '/') AS base, p_size FROM part),
h AS (SELECT base, p_size, path, CASE WHEN path = base THEN 0 WHEN path = base || '.ts' THEN 6 WHEN path = base || '/index.ts' THEN 7 ELSE 30 END AS way FROM w JOIN (SELECT DISTINCT path FROM f) ON path IN (base, base || '.ts', base || '.py', base || '/index.ts'))
SELECT DISTINCT 'main' || p_size || '.ts' AS src, arg_min(path, way) AS dst FROM h GROUP BY base, p_size""")
def resolve_first_match(spark, d):
    base = F.replace("p_name", F.lit(" "), F.lit("/"))
    suffix = F.element_at(F.array(*map(F.lit, ["", ".ts", ".py", "/index.ts"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    part = _t(spark, d, "part")
    files = part.select(F.concat(base, suffix).alias("path")).distinct()
    return _resolved(part.select(F.concat(F.lit("main"), "p_size", F.lit(".ts")).alias("path"), F.concat(F.lit("./"), base).alias("source")).distinct(), files)


def _resolved(imports: DataFrame, files: DataFrame, **kw) -> DataFrame:
    """(src, dst) of plain imports (path, source)."""
    imports = imports.withColumn("ext", tree.extension(F.col("path"))).withColumn("type", F.lit("value")).withColumn("dynamic", F.lit(False))
    return resolved(imports, files, **kw).select("src", "dst")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """(n, s): nation and number of each supplier, as text."""
    return _t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("n"), F.col("s_suppkey").cast("string").alias("s"))


def _path(*parts: str):
    """Text in which $n and $s stand for the columns n and s."""
    return F.concat(*[F.col(p[1:]) if p in ("$n", "$s") else F.lit(p) for p in parts])


N_S = "WITH x AS (SELECT s_nationkey::VARCHAR AS n, s_suppkey::VARCHAR AS s FROM supplier)"


@query(f"{N_S} SELECT 'app.ts' AS src, 'packages/n' || n || '/src/s' || s || '.ts' AS dst FROM x UNION SELECT 'app.ts', 'packages/n' || n || '/src/index.ts' FROM x")
def resolve_packages(spark, d):
    """Packages of a workspace by name, with a path inside and without one."""
    x = _suppliers(spark, d)
    files = x.select(_path("packages/n", "$n", "/src/s", "$s", ".ts").alias("path")).union(x.select(_path("packages/n", "$n", "/src/index.ts")).distinct())
    imports = x.select(F.lit("app.ts").alias("path"), _path("@w/n", "$n", "/src/s", "$s", ".js").alias("source")).union(x.select(F.lit("app.ts"), _path("@w/n", "$n")).distinct())
    return _resolved(imports, files, packages=x.select(_path("@w/n", "$n").alias("name"), _path("packages/n", "$n").alias("dir")).distinct())


@query(f"{N_S} SELECT 'pkg/n' || n || '/use.py' AS src, 'pkg/n' || n || '/m' || s || '.py' AS dst FROM x UNION SELECT 'pkg/n' || n || '/use.py', 'pkg/n' || n || '/__init__.py' FROM x UNION SELECT 'pkg/n' || n || '/use.py', 'top' || s || '/__init__.py' FROM x")
def resolve_python(spark, d):
    """Modules beside the importing one, the package itself, and packages from the root on."""
    x = _suppliers(spark, d)
    use = _path("pkg/n", "$n", "/use.py").alias("path")
    files = x.select(_path("pkg/n", "$n", "/m", "$s", ".py").alias("path")).union(x.select(_path("top", "$s", "/__init__.py"))).union(x.select(_path("pkg/n", "$n", "/__init__.py")).distinct())
    imports = x.select(use, _path("./m", "$s", "/Name").alias("source")).union(x.select(use, F.lit("../n").alias("a")).select("path", F.regexp_replace("path", "^pkg/(n[0-9]+)/.*$", "../$1")).distinct()).union(x.select(use, _path("top", "$s")))
    return _resolved(imports, files)


@query(f"{N_S} SELECT 'c' || n || '/src/deep/a.rs' AS src, 'c' || n || '/src/s' || s || '.rs' AS dst FROM x UNION SELECT 'c' || n || '/src/deep/a.rs', 'c' || n || '/src/deep/t' || s || '/mod.rs' FROM x")
def resolve_rust(spark, d):
    """From a crate's root on, without the names inside a module, and from the module above."""
    x = _suppliers(spark, d)
    use = _path("c", "$n", "/src/deep/a.rs").alias("path")
    files = x.select(_path("c", "$n", "/src/s", "$s", ".rs").alias("path")).union(x.select(_path("c", "$n", "/src/deep/t", "$s", "/mod.rs")))
    imports = x.select(use, _path("crate::s", "$s", "::T").alias("source")).union(x.select(use, _path("self::t", "$s", "::inner::T")))
    return _resolved(imports, files, crates=x.select(_path("crate", "$n").alias("name"), _path("c", "$n").alias("dir")).distinct())


@query(f"{N_S} SELECT 'cmd/m' || b.s || '.go' AS src, 'n' || a.n || '/s' || a.s || '.go' AS dst FROM x a JOIN x b ON a.n = b.n")
def resolve_go(spark, d):
    """A package of the module is all files of its directory."""
    x = _suppliers(spark, d)
    return _resolved(x.select(_path("cmd/m", "$s", ".go").alias("path"), _path("ex.org/m/n", "$n").alias("source")), x.select(_path("n", "$n", "/s", "$s", ".go").alias("path")), module="ex.org/m")


@query(f"{N_S} SELECT 'use.java' AS src, 'org/n' || n || '/s' || s || '.java' AS dst FROM x UNION SELECT 'deep/x.lua', 'lib/s' || s || '.lua' FROM x")
def resolve_dotted(spark, d):
    """Dots for slashes, names inside a file left off, and the root where nothing is beside the importing file."""
    x = _suppliers(spark, d)
    files = x.select(_path("org/n", "$n", "/s", "$s", ".java").alias("path")).union(x.select(_path("lib/s", "$s", ".lua")))
    return _resolved(x.select(F.lit("use.java").alias("path"), _path("org.n", "$n", ".s", "$s", ".member").alias("source")).union(x.select(F.lit("deep/x.lua"), _path("lib/s", "$s"))), files)


@query("""WITH p AS (SELECT 'a/' || p_brand || '/./../' || replace(p_name, ' ', '/') || '//x/..' AS raw, 'a/' || replace(p_name, ' ', '/') AS path FROM part) SELECT DISTINCT raw, path FROM p""")
def path_normalize(spark, d):
    raw = F.concat(F.lit("a/"), "p_brand", F.lit("/./../"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("//x/.."))
    return _t(spark, d, "part").select(raw.alias("raw"), normalized(F.split(raw, "/")).alias("path")).distinct()


@query("""WITH u AS (SELECT DISTINCT string_split(regexp_replace(url, '^https?://([^?#]*).*$', '\\1'), '/') AS p FROM pages), l AS (SELECT p, unnest(range(1, len(p))) AS n FROM u) SELECT DISTINCT array_to_string(p[1:n], '/') AS key FROM l""")
def ancestor_folders(spark, d):
    return folders(_t(spark, d, "pages").select(F.regexp_replace("url", r"^https?://([^?#]*).*$", "$1").alias("path")).distinct())


@query("""SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'imports:type' ELSE 'imports' END AS relation, CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence, 'static_analysis' AS provenance FROM lineitem""")
def edge_dedup(spark, d):
    li = _t(spark, d, "lineitem")
    return as_edges(li.select(_node("order", "l_orderkey").alias("src"), _node("part", "l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "imports:type").otherwise("imports").alias("relation")))


@query(f"""SELECT DISTINCT 'u:' || user_id AS src, 'e:' || event_id AS dst, {REL} AS relation, CASE {REL} WHEN 'imports:dynamic' THEN 0.3::DOUBLE WHEN 'imports:type' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE {REL} WHEN 'imports:dynamic' THEN 'dynamic_analysis' ELSE 'static_analysis' END AS provenance FROM events""")
def confidence_case(spark, d):
    return as_edges(_t(spark, d, "events").select(_node("u", "user_id").alias("src"), _node("e", "event_id").alias("dst"), relation_of().alias("relation")))


@query(f"WITH {FK} SELECT DISTINCT src AS path FROM fk WHERE dst = 'nation:3'")
def direct_dependents(spark, d):
    return graph.direct_dependents(fk_edges(spark, d), "nation:3")


@query(f"WITH RECURSIVE {FK}, r AS (SELECT src FROM fk WHERE dst = 'region:1' UNION SELECT fk.src FROM fk JOIN r ON fk.dst = r.src) SELECT src AS path FROM r")
def blast_radius_fk(spark, d):
    return graph.blast_radius(fk_edges(spark, d), _starts(spark, "region:1")).where("not unresolvable").select("path")


@query(f"WITH RECURSIVE {TR}, r AS (SELECT src FROM tr WHERE dst = '1' AND relation = 'imports' UNION SELECT tr.src FROM tr JOIN r ON tr.dst = r.src WHERE relation = 'imports') SELECT src AS path FROM r WHERE src <> '1'")
def blast_radius_cyclic(spark, d):
    return graph.blast_radius(transitions(spark, d), _starts(spark, "1")).where("not unresolvable").select("path")


@query(f"WITH RECURSIVE {TR}, r AS (SELECT '1' AS src UNION SELECT tr.src FROM tr JOIN r ON tr.dst = r.src WHERE relation = 'imports') SELECT DISTINCT 'UNRESOLVABLE: ' || tr.src AS path FROM tr JOIN r ON tr.dst = r.src WHERE relation = 'imports:dynamic'")
def dynamic_flagged(spark, d):
    return graph.blast_radius(transitions(spark, d), _starts(spark, "1")).where("unresolvable").select(graph.shown().alias("path"))


TESTED = "CASE WHEN o_orderpriority = '1-URGENT' THEN '.test.' ELSE '.' END"


@query(f"""WITH RECURSIVE e AS (SELECT 'o' || o_orderkey || {TESTED} || 'ts' AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
r AS (SELECT src FROM e WHERE dst IN ('n3', 'n7') UNION SELECT e.src FROM e JOIN r ON e.dst = r.src) SELECT src AS path FROM r WHERE src LIKE '%.test.%'""")
def related_tests(spark, d):
    orders = _t(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey"), F.when(F.col("o_orderpriority") == "1-URGENT", ".test.").otherwise("."), F.lit("ts")).alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    customers = _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    return graph.related_tests(orders.unionAll(customers).withColumn("relation", F.lit("imports")), _starts(spark, "n3", "n7"))


@query(f"WITH RECURSIVE {FK}, r AS (SELECT n_nationkey AS origin, 'nation:' || n_nationkey AS node, 0 AS depth FROM nation UNION SELECT r.origin, fk.src, depth + 1 FROM fk JOIN r ON fk.dst = r.node) SELECT origin, node, min(depth)::INTEGER AS depth FROM r GROUP BY ALL")
def multi_source_closure(spark, d):
    return graph.closure(fk_edges(spark, d), _t(spark, d, "nation").select(F.col("n_nationkey").alias("origin"), _node("nation", "n_nationkey").alias("node")))


def _part_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as files, what they deliver as symbols by part size, links from customers' nations to suppliers'."""
    files = _t(spark, d, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey")).alias("path"), F.col("s_name").alias("summary"), (F.col("s_acctbal") < 0).alias("stale"))
    kind = F.when(F.col("l_quantity") < 10, "function").when(F.col("l_quantity") < 20, "class").when(F.col("l_quantity") < 30, "const").otherwise("other")
    symbols = _t(spark, d, "lineitem").select(F.concat(F.lit("s/"), F.col("l_suppkey")).alias("path"), kind.alias("type"))
    s = _t(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("s/"), "s_suppkey").alias("path"))
    edges = pairs(s.select((F.col("s_nationkey") + 1).alias("n"), F.col("path").alias("src")), s.select(F.col("s_nationkey").alias("n"), F.col("path").alias("dst")), "n").withColumn("relation", F.lit("imports"))
    return files, symbols, edges


SUP = "e AS (SELECT 's/' || a.s_suppkey AS src, 's/' || b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey + 1 = b.s_nationkey)"


@query(f"""WITH {SUP}, c AS (SELECT 's/' || l_suppkey AS path, count(*) AS n, count(*) FILTER (l_quantity < 10) AS f, count(*) FILTER (l_quantity >= 10 AND l_quantity < 20) AS k, count(*) FILTER (l_quantity >= 20 AND l_quantity < 30) AS v FROM lineitem GROUP BY 1)
SELECT 's/' || s_suppkey AS id, s_suppkey::VARCHAR AS label, s_name AS summary, s_acctbal < 0 AS stale, coalesce(n, 0) AS "symbolCount", coalesce(f, 0) AS functions, coalesce(k, 0) AS classes, coalesce(v, 0) AS variables
FROM supplier LEFT JOIN c ON path = 's/' || s_suppkey WHERE 's/' || s_suppkey IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def graph_nodes(spark, d):
    files, symbols, edges = _part_files(spark, d)
    return graph.graph_nodes(edges, files, symbols).select("id", "label", "summary", "stale", "symbolCount", "breakdown.*")


@query(f"WITH {SUP} SELECT src AS source, dst AS target FROM e")
def graph_links(spark, d):
    return graph.graph_links(_part_files(spark, d)[2])


@query(f"WITH {FK} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM fk UNION ALL SELECT dst FROM fk) GROUP BY node")
def degree(spark, d):
    return graph.degrees(fk_edges(spark, d))


@query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents WHERE n_chars < 500) AS stale, (SELECT count(*) FROM lineitem) AS symbols, (SELECT count(*) FROM orders) AS edges, (SELECT count(*) FROM events) AS tasks, (SELECT count(*) FROM part) AS rules")
def stats(spark, d):
    docs = _t(spark, d, "documents").select((F.col("n_chars") < 500).alias("stale"))
    return views.stats(docs, *(_t(spark, d, t) for t in ("lineitem", "orders", "events", "part")))


@query("""WITH f AS (SELECT 'c/' || lpad(c_custkey::VARCHAR, 9, '0') AS path, c_custkey, c_name FROM customer ORDER BY 1 LIMIT 50) SELECT path, c_name AS summary, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS names FROM f LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def memory_graph(spark, d):
    path = lambda c: F.concat(F.lit("c/"), F.lpad(F.col(c).cast("string"), 9, "0")).alias("path")
    files = _t(spark, d, "customer").select(path("c_custkey"), F.col("c_name").alias("summary"))
    symbols = _t(spark, d, "orders").select(path("o_custkey"), F.col("o_orderkey").cast("int").alias("start_line"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("type"))
    out = views.memory(files, symbols)
    return out.select("path", "summary", F.size("symbols").cast("long").alias("n"), F.array_join("symbols.name", ",").alias("names"))


STOP = "', '".join(STOP_WORDS)


@query(f"""SELECT conv_id, turn, len(k)::INTEGER AS n, array_to_string(k, ' ') AS words FROM (SELECT conv_id, turn, [w for w in regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+') if length(w) > 2 AND w NOT IN ('{STOP}')] AS k FROM conversations)""")
def keyword_tokenize(spark, d):
    k = rank.keywords(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(k).alias("n"), F.array_join(k, " ").alias("words"))


TASK = "fix the red widget and the blue bolt, RED ring zzz"
KW = "kw AS (SELECT unnest(['red', 'widget', 'blue', 'bolt', 'red', 'ring', 'zzz']) AS kw)"
IDF = f"{KW}, idf AS (SELECT kw, ln((SELECT greatest(count(*), 1) FROM part)::DOUBLE / (greatest(count(p_partkey), 1) + 1)) + 1 AS idf FROM (SELECT DISTINCT kw FROM kw) LEFT JOIN part ON p_name ILIKE '%' || kw || '%' GROUP BY kw)"
SCORES = f"""{IDF}, w AS (SELECT kw, idf FROM kw JOIN idf USING (kw)), s AS (SELECT p_partkey AS path, 10 * idf AS score FROM part JOIN w ON p_name ILIKE '%' || kw || '%'
  UNION ALL SELECT ps.p_partkey, 5 * idf FROM (SELECT p_partkey, 'ring ' || p_type AS name FROM part) ps JOIN w ON name ILIKE '%' || kw || '%' UNION ALL SELECT p_partkey, 2 * idf FROM part JOIN w ON p_brand || ' ' || p_name ILIKE '%' || kw || '%'),
t AS (SELECT path, sum(score) AS score FROM s GROUP BY path)"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as files, scored by name; (key, path, summary), symbols (path, name), weighted words of TASK."""
    part = _t(spark, d, "part")
    files = part.select("p_partkey", F.col("p_name").alias("path"), F.concat_ws(" ", "p_brand", "p_name").alias("summary"))
    kw = spark.createDataFrame([(w,) for w in rank.tokenize(TASK)], "kw string")
    return files, part.select("p_partkey", F.concat(F.lit("ring "), "p_type").alias("name")), kw.join(rank.idf(files, kw), "kw")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    files, symbols, w = _parts(spark, d)
    return rank.contributions(files, symbols, w, "p_partkey").withColumnRenamed("p_partkey", "path")


@query(f"WITH {IDF} SELECT kw, round(idf, 6) AS idf FROM idf")
def keyword_idf(spark, d):
    files = _t(spark, d, "part").select(F.col("p_name").alias("path"))
    kw = spark.createDataFrame([(w,) for w in rank.tokenize(TASK)], "kw string")
    return rank.idf(files, kw).select("kw", F.round("idf", 6).alias("idf"))


@query(f"WITH {SCORES} SELECT path, round(score, 6) AS score FROM t")
def keyword_score(spark, d):
    return _scores(spark, d).groupBy("path").agg(F.round(F.sum("score"), 6).alias("score"))


@query(f"WITH {SCORES}, u AS (SELECT path, round(score, 6) AS score FROM t) SELECT path, score FROM u WHERE score >= 0.4 * (SELECT max(score) FROM u) ORDER BY score DESC, path LIMIT 10")
def relative_prune(spark, d):
    rounded = _scores(spark, d).groupBy("path").agg(F.round(F.sum("score"), 6).alias("score"))
    return rank.ranked(rounded)


QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    return F.broadcast(_t(spark, d, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("q")))  # one row


def _hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return nearest(_t(spark, d, "embeddings").crossJoin(_query_vector(spark, d)), F.col("q"), k, "vec_id")


@query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {QV}), 6) AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {QV}), vec_id LIMIT 10")
def semantic_topk(spark, d):
    return _hits(spark, d).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(greatest(0, 1 - list_cosine_distance(embedding::DOUBLE[], {QV})) * 15, 5) AS score FROM embeddings WHERE greatest(0, 1 - list_cosine_distance(embedding::DOUBLE[], {QV})) >= 0.25")
def semantic_floor(spark, d):
    near = _t(spark, d, "embeddings").crossJoin(_query_vector(spark, d)).select(F.col("vec_id").alias("path"), cosine_distance(F.col("embedding"), F.col("q")).alias("distance"))
    return rank.semantic_contributions(near).select(F.col("path").alias("vec_id"), F.round("score", 5).alias("score"))


@query(f"""WITH {SCORES}, h AS (SELECT vec_id AS path, 1 - list_cosine_distance(embedding::DOUBLE[], {QV}) AS sim FROM embeddings ORDER BY sim DESC, vec_id LIMIT 10),
a AS (SELECT path, score FROM s UNION ALL SELECT path, 15 * greatest(0, sim) FROM h WHERE sim >= 0.25) SELECT path, round(sum(score), 5) AS score FROM a GROUP BY path""")
def hybrid_score(spark, d):
    semantic = rank.semantic_contributions(_hits(spark, d).withColumnRenamed("vec_id", "path"))
    return _scores(spark, d).unionAll(semantic).groupBy("path").agg(F.round(F.sum("score"), 5).alias("score"))


@query(f"WITH {KW} SELECT p_partkey AS id, p_name AS name, p_type AS description FROM part WHERE EXISTS (SELECT 1 FROM kw WHERE p_name ILIKE '%' || kw || '%' OR p_type ILIKE '%' || kw || '%')")
def rules_match(spark, d):
    rules = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return rank.matching_rules(rules, spark.createDataFrame([(w,) for w in rank.tokenize(TASK)], "kw string"))


@query("SELECT event_id AS id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_tasks(spark, d):
    events = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", "event_type")
    return memory.recent(events).select("id", "user_id", "event_type")


@query("SELECT o_orderkey AS id, o_orderpriority AS severity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS place FROM orders QUALIFY place <= 3")
def top_rules(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return _t(spark, d, "orders").withColumn("place", F.row_number().over(w)).where("place <= 3").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("severity"), "place")


WORDS = "b AS (SELECT source AS path, unnest(string_split(text, ' ')) AS name FROM documents WHERE lang = 'es'), a AS (SELECT source AS path, unnest(string_split(text, ' ')) AS name FROM documents WHERE lang = 'fr')"


@query(f"WITH {WORDS} SELECT path, 'added' AS change, name FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = a.path AND b.name = a.name) UNION ALL SELECT DISTINCT path, 'removed', name FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.path = a.path AND b.name = a.name)")
def symbol_diff(spark, d):
    words = lambda lang: _t(spark, d, "documents").where(F.col("lang") == lang).select(F.col("source").alias("path"), F.explode(F.split("text", " ")).alias("name"))
    return changes.symbol_diff(words("es"), words("fr"))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_brand, p_size < 25 ORDER BY p_partkey) AS r FROM part WHERE TRUE),
g AS (SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_partkey) FILTER (p_size < 25) AS s, string_agg(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (' || (p_name || ' ' || p_name || ' ' || p_type)[1:50] || ')' ELSE '' END, ', ' ORDER BY p_partkey) FILTER (p_size >= 25 AND r <= 5) AS f, string_agg(p_type, ', ' ORDER BY p_partkey) FILTER (q <= 5) AS i
  FROM (SELECT p.*, part.p_size, row_number() OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey) AS q FROM p JOIN part USING (p_partkey)) GROUP BY p_brand),
l AS (SELECT p_brand, concat_ws(' ', 'Core structures: ' || s || '.', 'Key logic: ' || f || '.', 'Integrates with: ' || i || '.') AS t FROM g) SELECT p_brand AS brand, CASE WHEN length(t) > 500 THEN t[1:497] || '...' ELSE t END AS gist FROM l""")
def gist_by_brand(spark, d):
    part = _t(spark, d, "part")
    entry = F.struct("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") < 25, "class").otherwise("function").alias("type"), F.concat(F.lit("lib/"), "p_type").alias("source"), F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", "p_name", F.concat("p_type", F.lit("\nmore")))).alias("docstring"))
    rows = part.groupBy(F.col("p_brand").alias("brand")).agg(F.sort_array(F.collect_list(entry)).alias("s"))
    return rows.select("brand", gist(F.col("s"), F.col("s")).alias("gist"))


@query("""SELECT page_id, CASE WHEN n LIKE 'index.%' AND len(p) > 1 THEN p[-2] || '/' || n ELSE n END AS label FROM (SELECT page_id, string_split(u, '/') AS p, string_split(u, '/')[-1] AS n FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/index.html' ELSE url END AS u FROM pages))""")
def label_basename(spark, d):
    pages = _t(spark, d, "pages").withColumn("path", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/index.html"))).otherwise(F.col("url")))
    return pages.select("page_id", graph.graph_label(F.col("path")).alias("label"))


@query("""WITH x AS (SELECT *, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM g) SELECT user_id::VARCHAR AS path, arg_max(event_type, us) AS event, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, run""")
def watch_debounce(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.debounced(events, 3_600_000).select("path", "event", F.unix_micros("ts").alias("last_us"), "n")


@query("SELECT user_id::VARCHAR AS path, arg_max(event_type, ts) AS event, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id")
def watch_last_event(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.last_events(events).select("path", "event", F.unix_micros("ts").alias("last_us"))


@query("SELECT source, bool_or(quality = 0) AS warned, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def stale_warning(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels"), "doc_id")
    return views.warned(j.select("source", (F.col("quality") == 0).alias("stale")), "source")


@query("SELECT round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS percent FROM labels")
def fixture_pass_rate(spark, d):
    return views.pass_rate(_t(spark, d, "labels").select((F.col("quality") == 1).alias("passed"))).select(F.round("percent", 6).alias("percent"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:497] || '...' ELSE text END AS summary FROM documents")
def summary_cap(spark, d):
    return _t(spark, d, "documents").select("doc_id", shortened(F.col("text")).alias("summary"))


@query(f"""WITH RECURSIVE {FK}, {SCORES}, c AS (SELECT path, score FROM (SELECT path, round(score, 6) AS score FROM t) WHERE score >= 0.4 * (SELECT max(round(score, 6)) FROM t) ORDER BY score DESC, path LIMIT 10),
k AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier), r AS (SELECT path AS origin, 'part:' || path AS node FROM c UNION SELECT r.origin, k.src FROM k JOIN r ON k.dst = r.node)
SELECT origin AS part, count(*) - 1 AS reached, max(c.score) AS score FROM r JOIN c ON c.path = r.origin GROUP BY origin""")
def context_pack_reach(spark, d):
    """The best parts of a task, and how much their change reaches."""
    top = materialized(relative_prune(spark, d), "top")  # planned once, used twice
    supplied = _t(spark, d, "lineitem").select(_node("supplier", "l_suppkey").alias("src"), _node("part", "l_partkey").alias("dst")).distinct()
    nations = _t(spark, d, "supplier").select(_node("nation", "s_nationkey"), _node("supplier", "s_suppkey"))
    reached = graph.closure(supplied.unionAll(nations), top.select(F.col("path").alias("origin"), _node("part", "path").alias("node")))
    counts = reached.groupBy(F.col("origin").alias("part")).agg((F.count("*") - 1).alias("reached"))
    return counts.join(F.broadcast(top), counts["part"] == top["path"]).select("part", "reached", "score")


PACK = f"""{KW}, f AS (SELECT 'p' || p_partkey || '/' || replace(p_name, ' ', '/') || '.ts' AS path, p_partkey, p_brand || ' ' || p_name AS summary, p_size > 48 AS stale FROM part),
idf AS (SELECT kw, ln((SELECT greatest(count(*), 1) FROM f)::DOUBLE / (greatest(count(path), 1) + 1)) + 1 AS idf FROM (SELECT DISTINCT kw FROM kw) LEFT JOIN f ON path ILIKE '%' || kw || '%' GROUP BY kw),
w AS (SELECT kw, idf FROM kw JOIN idf USING (kw)), s AS (SELECT path, 10 * idf AS score FROM f JOIN w ON path ILIKE '%' || kw || '%' UNION ALL SELECT path, 5 * idf FROM (SELECT path, 'ring ' || p_type AS name FROM f JOIN part USING (p_partkey)) JOIN w ON name ILIKE '%' || kw || '%' UNION ALL SELECT path, 2 * idf FROM f JOIN w ON summary ILIKE '%' || kw || '%'),
t AS (SELECT path, round(sum(score), 9) AS score FROM s GROUP BY path), c AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS origin FROM t WHERE score >= 0.4 * (SELECT max(score) FROM t) - 1e-9 ORDER BY score DESC, path LIMIT 10),
e AS (SELECT DISTINCT 's' || l_suppkey || CASE WHEN l_suppkey % 3 = 0 THEN '.test.ts' ELSE '.ts' END AS src, path AS dst FROM lineitem JOIN f ON l_partkey = p_partkey),
r AS (SELECT src, min(origin) AS o FROM e JOIN c ON dst = path GROUP BY src)"""


@query(f"""WITH {PACK} SELECT 'read_first' AS section, path AS value FROM c UNION ALL (SELECT 'blast_radius', src FROM r ORDER BY o, src LIMIT 10) UNION ALL (SELECT 'tests_to_run', src FROM r WHERE src LIKE '%.test.%' ORDER BY o, src LIMIT 5)
UNION ALL SELECT 'rules', s_name || ': ' || s_address FROM (SELECT n_name AS s_name, n_name || ' red' AS s_address FROM nation) UNION ALL SELECT 'warnings', 'Some files changed since they were indexed.' WHERE (SELECT bool_or(stale) FROM c JOIN f USING (path))""")
def context_pack(spark, d):
    """All sections of a context pack over parts as files, suppliers as what imports them, nations as rules."""
    part = _t(spark, d, "part")
    path = F.concat(F.lit("p"), "p_partkey", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".ts"))
    files = part.select("p_partkey", path.alias("path"), F.concat_ws(" ", "p_brand", "p_name").alias("summary"), (F.col("p_size") > 48).alias("stale"))
    symbols = part.select(path.alias("path"), F.concat(F.lit("ring "), "p_type").alias("name"))
    src = F.concat(F.lit("s"), "l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, ".test.ts").otherwise(".ts"))
    edges = _t(spark, d, "lineitem").join(files, F.col("l_partkey") == F.col("p_partkey")).select(src.alias("src"), F.col("path").alias("dst"), F.lit("imports").alias("relation")).distinct()
    rules = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit(" red")).alias("description"))
    pack = rank.context_pack(spark, TASK, files.drop("p_partkey"), symbols, edges, rules)
    rows = [("read_first", r["path"]) for r in pack["read_first"]] + [(k, v) for k in ("blast_radius", "tests_to_run", "rules", "warnings") for v in pack[k]]
    return spark.createDataFrame(rows, "section string, value string")


@query("SELECT event_id AS id, user_id FROM events")
def rules_by_date(spark, d):
    return memory.recent(_t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id"), None).select("id", "user_id")


@query("SELECT doc_id::VARCHAR AS path, source AS summary, n_chars < 100 AS stale FROM documents ORDER BY 1 LIMIT 100")
def files_page(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("summary"), (F.col("n_chars") < 100).alias("stale"), F.lit(None).cast("timestamp").alias("last_indexed"))
    return views.file_list(docs).drop("last_indexed")


@query("SELECT * FROM (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation UNION ALL SELECT (max(n_nationkey) + 1)::BIGINT, 'new', 3::BIGINT FROM nation) WHERE id <> 7")
def append_and_delete(spark, d):
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return memory.removed(memory.appended(nation, name="new", region=3), 7)


@query("SELECT l_orderkey::VARCHAR AS path, l_partkey AS name FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey::VARCHAR, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def replace_symbols(spark, d):
    done = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("name"))
    return changes.replaced(_t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").alias("name")), done.select("path"), done)


@query("""WITH x AS (SELECT doc_id::VARCHAR AS path, n_chars FROM documents) SELECT path, CASE WHEN n_chars < 200 OR n_chars % 7 = 0 THEN 'retry' ELSE 'unchanged' END AS status FROM x""")
def retry_unembedded(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("h").alias("content_hash"), (F.col("n_chars") < 200).alias("stale"), F.lit("s").alias("summary"), F.when(F.col("n_chars") % 7 != 0, F.array(F.lit(1.0))).alias("embedding"))
    return changes.changes(docs, docs, embeds=True)


TREES = "'src/' || p_brand || CASE p_size % 8 WHEN 0 THEN '/node_modules/x.js' WHEN 1 THEN '/dist/y.js' WHEN 2 THEN '/z.min.js' WHEN 3 THEN '/.env.local' WHEN 4 THEN '/yarn.lock' WHEN 5 THEN '/p.PNG' WHEN 6 THEN '/a.b/c.ts' ELSE '/_d.py' END"


@query(f"SELECT p_partkey, {TREES} AS path FROM part WHERE p_size % 8 > 5")
def scan_exclusions(spark, d):
    """Built-in lists, machine-made files, hidden ones and binary extensions."""
    path = F.expr(TREES.replace("::VARCHAR", ""))
    return guarded(_t(spark, d, "part").select("p_partkey", path.alias("path"), F.lit(1).alias("length"))).select("p_partkey", "path")


PLACES = "'src/' || p_brand || CASE p_size % 5 WHEN 0 THEN '/keep/' WHEN 1 THEN '/log/' WHEN 2 THEN '/gen/' WHEN 3 THEN '/deep/gen/' ELSE '/tmp/x/' END || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.log' ELSE '.min.js' END"


@query(f"""SELECT {PLACES} AS path FROM part WHERE p_size % 5 <> 4 AND p_size % 5 <> 2
AND (p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND (p_brand LIKE '%5' OR p_brand = 'Brand#11' AND p_size % 5 = 0) OR p_partkey % 3 = 2 AND p_size % 5 <> 0)""")
def ignore_rules(spark, d):
    """Files that rules of the root and of each brand's directory leave: deeper ones count for more, nothing comes back out of a directory that is left out."""
    parts = _t(spark, d, "part")
    root = ["# of the root", "*.log", "tmp/", "!src/Brand#11/keep/*.log", "src/**/keep/*.min.js", ""]
    brands = parts.select("p_brand").distinct().select(F.concat(F.lit("src/"), "p_brand").alias("dir"), F.posexplode(F.array(F.lit("/gen"), F.when(F.col("p_brand").endswith("5"), "!*.log").otherwise("# none"), F.lit("!tmp/x/*.ts"))).alias("line", "text"))
    top = spark.createDataFrame([("", i, x) for i, x in enumerate(root)], "dir string, line int, text string")
    return ignore.without_ignored(parts.select(F.expr(PLACES).alias("path")), ignore.rules(top.unionByName(brands)))


@query(f"SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN '.js' WHEN 1 THEN '.js' WHEN 2 THEN '.js' WHEN 3 THEN '.local' WHEN 4 THEN '.lock' WHEN 5 THEN '.PNG' WHEN 6 THEN '.ts' ELSE '.py' END AS ext FROM part")
def path_extension(spark, d):
    return _t(spark, d, "part").select("p_partkey", tree.extension(F.expr(TREES)).alias("ext"))


@query("SELECT doc_id, text FROM documents")
def text_decode(spark, d):
    """Texts as bytes with a mark of byte order, and back."""
    return _t(spark, d, "documents").select("doc_id", tree.text_of(F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))).alias("text"))


@query("SELECT count(DISTINCT text) AS texts FROM documents")
def content_hashes(spark, d):
    return _t(spark, d, "documents").select(F.count_distinct(tree.content_hash(F.col("text").cast("binary"))).alias("texts"))


@query("""SELECT 'packages/s' || s_suppkey || '/package.json' AS path, 'package' AS kind, '@s/' || s_name AS name, 'packages/s' || s_suppkey AS dir FROM supplier UNION ALL SELECT 'c' || n_nationkey || '/Cargo.toml', 'crate', u, 'c' || n_nationkey FROM (SELECT n_nationkey, unnest(list_distinct([n, replace(n, '-', '_')])) AS u FROM (SELECT n_nationkey, 'a-' || replace(n_name, ' ', '-') AS n FROM nation)) UNION ALL SELECT 'go.mod', 'module', 'ex.org/' || r_name, '' FROM region WHERE r_regionkey = 1""")
def workspace_map(spark, d):
    """Packages, crates and the module of a workspace, from the files that name them."""
    packages = _t(spark, d, "supplier").select(F.concat(F.lit("packages/s"), "s_suppkey", F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "@s/'), "s_name", F.lit('"}')).alias("content"))
    crates = _t(spark, d, "nation").select(F.concat(F.lit("c"), "n_nationkey", F.lit("/Cargo.toml")), F.concat(F.lit('[package]\nname = "a-'), F.replace("n_name", F.lit(" "), F.lit("-")), F.lit('"')))
    module = _t(spark, d, "region").where("r_regionkey = 1").select(F.lit("go.mod"), F.concat(F.lit("module ex.org/"), "r_name", F.lit("\n\ngo 1.2")))
    return tree.workspace(packages.union(crates).union(module))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'unlink' ELSE 'change' END AS event FROM events WHERE user_id % 5 <> 0 AND (event_type = 'click' OR user_id % 3 > 0)")
def watch_filter(spark, d):
    """Events of files that matter: some lie in node_modules, some have other extensions."""
    path = F.concat(F.when(F.col("user_id") % 5 == 0, "node_modules/").otherwise("src/"), F.lit("f"), F.when(F.col("user_id") % 3 == 0, ".md").when(F.col("user_id") % 3 == 1, ".TS").otherwise(".py"))
    events = _t(spark, d, "events").select("event_id", path.alias("path"), F.when(F.col("event_type") == "click", "unlink").otherwise("change").alias("event"))
    return watch.watched(events).select("event_id", "event")


@query(f"WITH RECURSIVE {FK}, r AS (SELECT r_regionkey AS origin, 'region:' || r_regionkey AS node FROM region UNION SELECT r.origin, fk.src FROM fk JOIN r ON fk.dst = r.node) SELECT origin::INTEGER AS origin, count(*) - 1 AS size FROM r GROUP BY origin HAVING count(*) > 1")
def radius_sizes(spark, d):
    starts = _t(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("origin"), _node("region", "r_regionkey").alias("node"))
    return graph.radius_size(graph.blast_radius(fk_edges(spark, d), starts))


@query(f"SELECT vec_id, greatest(0, floor((1 - round(list_cosine_distance(embedding::DOUBLE[], {QV}), 6)) * 100 + 0.5))::INTEGER AS percent FROM embeddings")
def match_percents(spark, d):
    near = _t(spark, d, "embeddings").crossJoin(_query_vector(spark, d)).select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return near.select("vec_id", views.match_percent(F.col("distance")).alias("percent"))


@query(f"SELECT e.vec_id, d.source, d.lang FROM (SELECT vec_id FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {QV}), vec_id LIMIT 10) e JOIN documents d ON d.doc_id = e.vec_id")
def hits_with_files(spark, d):
    return rank.with_files(_hits(spark, d), _t(spark, d, "documents").withColumnRenamed("doc_id", "vec_id"), "vec_id").select("vec_id", "source", "lang")


@query("""WITH x AS (SELECT o_custkey AS fixture, list(DISTINCT lower(o_orderpriority)) FILTER (o_orderstatus = 'F') AS e, list(DISTINCT lower(o_orderpriority)) FILTER (o_orderstatus = 'O') AS a, list(DISTINCT lower(o_orderpriority)) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY 1),
y AS (SELECT fixture, coalesce(e, []) AS e, coalesce(a, []) AS a, coalesce(b, []) AS b FROM x) SELECT fixture, list_filter(e, lambda i: NOT list_contains(a, i)).len() AS missing, list_filter(a, lambda i: NOT list_contains(e, i)).len() AS extra, list_filter(b, lambda i: list_contains(a, i)).len() AS forbidden FROM y""")
def fixture_sets(spark, d):
    """Expected, forbidden and found sets: a customer's priorities by the status of the orders."""
    of = lambda status: F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))
    cases = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("fixture")).agg(of("F").alias("expected"), of("O").alias("actual"), of("P").alias("banned")).withColumn("unresolvable", F.lit(None).cast("array<string>"))
    return views.fixture_sets(cases).select("fixture", *[F.size(c).cast("long").alias(c) for c in ("missing", "extra", "forbidden")])
