"""Lists, weights and limits that results depend on."""

#: Directories and files that are never indexed.
EXCLUDED = [
    "**/.git/**", "**/.svn/**", "**/.hg/**", "**/node_modules/**", "**/bower_components/**", "**/vendor/**", "**/dist/**", "**/build/**", "**/out/**", "**/target/**",
    "**/.turbo/**", "**/.cache/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/coverage/**", "**/.gradle/**", "**/bin/**", "**/obj/**", "**/__pycache__/**",
    "**/.venv/**", "**/venv/**", "**/env/**", "**/site-packages/**", "**/*.pyc", "**/.env*", "**/temp/**", "**/tmp/**", "**/scratch/**", "**/.millrace/**",
]
#: Machine-made files.
GENERATED = ["**/pnpm-lock.yaml", "**/package-lock.json", "**/yarn.lock", "**/composer.lock", "**/Cargo.lock", "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.tsbuildinfo", "**/*.wasm"]
#: What a new project's configuration excludes, and more by marker file.
PROJECT_EXCLUDED = [
    "**/.millrace/**", "**/.git/**", "**/.turbo/**", "**/.cache/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.gradle/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**",
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/target/**", "**/vendor/**", "**/coverage/**", "**/out/**", "**/scratch/**", "**/temp/**", "**/*.pyc", "**/*.tsbuildinfo",
    "**/pnpm-lock.yaml", "**/package-lock.json", "**/yarn.lock",
]
MARKED_EXCLUDED = {
    "package.json": ["**/web_modules/**"], "Cargo.toml": ["**/target/**"], "pyproject.toml": ["**/*.egg-info/**"], "requirements.txt": ["**/*.egg-info/**"], "setup.py": ["**/*.egg-info/**"],
    "go.mod": ["**/vendor/**"], "pom.xml": ["**/target/**"], "build.gradle": ["**/build/**"], "build.gradle.kts": ["**/build/**"], "Package.swift": ["**/.build/**"], "Gemfile": ["**/vendor/bundle/**"],
}
#: Extensions of binary files.
BINARY = [".exe", ".dll", ".so", ".dylib", ".zip", ".tar", ".gz", ".jpg", ".png", ".gif", ".pdf", ".wasm", ".bin"]
MAX_BYTES = 10 * 1024 * 1024

#: Suffixes an import may leave out, in the order they are tried, and files that stand for their directory.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".lua", ".c", ".cpp", ".cs", ".php", ".swift", ".kt", ".scala", ".ps1", ".jl", ".m", ".v", ".sv", ".vue", ".svelte", ".dart", ".ex", ".zig", ".sh", ".h", ".hpp"]
ENTRIES = ["index", "__init__", "mod", "lib", "main"]

#: Extensions whose graph a context pack follows, and that a watcher takes note of.
PACK_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".java", ".kt", ".cpp", ".h", ".cs"]
WATCHED_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".c", ".cpp", ".php", ".cs", ".swift", ".lua"]

#: Languages whose symbols are looked for in full even where patterns have found some.
FORCED_DEEP = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".rb", ".c", ".cpp", ".h", ".hpp", ".java", ".cs", ".php", ".swift", ".kt", ".scala", ".lua", ".dart", ".ex", ".zig"]

#: Words of a task that say nothing about where to look.
STOP_WORDS = ["implement", "create", "update", "delete", "change", "fix", "add", "remove", "the", "and", "for", "with", "from", "this", "that", "should", "would", "could", "want", "need", "task", "description", "issue", "bug", "feature"]

PATH_WEIGHT, SYMBOL_WEIGHT, SUMMARY_WEIGHT, SEMANTIC_WEIGHT = 10, 5, 2, 15
SIMILARITY_FLOOR, SEMANTIC_K = 0.25, 10
RELATIVE_PRUNE, MAX_CANDIDATES = 0.4, 10
RADIUS_CAP, TESTS_CAP = 10, 5
CONFIDENCE = {"imports": 0.8, "imports:type": 0.5, "imports:dynamic": 0.3}
GIST_FUNCTIONS, GIST_DEPENDENCIES, GIST_DOC, GIST_CHARS = 5, 5, 50, 500
RECENT, FILES_SHOWN = 50, 100
#: Rows of a list that people read before it says how many more there are.
SHOWN_AFFECTED, SHOWN_SYMBOLS = 5, 20
DEBOUNCE_MS = 250
UNRESOLVABLE = "UNRESOLVABLE: "
