"""Schemas of the stored tables."""

FILES = "path string, content_hash string, summary string, stale boolean, last_indexed timestamp, embedding array<float>, error string"
SYMBOLS = "path string, name string, type string, start_line int, end_line int, docstring string, scope string"
IMPORTS = "path string, ext string, pos int, source string, type string, dynamic boolean"
#: What imports may mean: candidates of each by rank, as paths of files or folders.
CANDIDATES = "src string, ext string, source string, relation string, part int, rank int, key string, folder boolean"
WORKSPACE = "path string, kind string, name string, dir string"
EDGES = "src string, dst string, relation string, confidence double, provenance string"
TASKS = "id bigint, description string, type string, outcome string, notes string, created_at timestamp"
RULES = "id bigint, name string, description string, scope_type string, scope_value string, severity string, created_at timestamp"
EVENTS = "path string, event string, ts timestamp"
TABLES = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "candidates": CANDIDATES, "workspace": WORKSPACE, "edges": EDGES, "tasks": TASKS, "rules": RULES}
#: The column by which rows of a table are replaced and go; other tables are written whole.
KEYS = {"files": "path", "symbols": "path", "imports": "path", "workspace": "path", "candidates": "src", "edges": "src"}
