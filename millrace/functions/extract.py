"""Imports and symbols of source files, by tables of patterns and by the lexer."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FORCED_DEEP
from ..sources.tree import extension
from .lexer import declarations

Q, NQ = "[\"'`]", "[^\"'`]"
#: What must stand somewhere behind a pattern's beginning for it to match at all.
_ENDS: dict[re.Pattern, re.Pattern | str] = {}


def _p(pattern: str, flags: int = 0, ends: str | re.Pattern = "") -> re.Pattern:
    """A pattern; it matches only before the last of the characters ``ends``, or before the last match of that pattern.

    Where a pattern runs on until its end, each beginning without one would be
    followed to the end of the text, and the time would grow with the square of its length.
    """
    out = re.compile(pattern, re.M | re.A | flags)
    if ends:
        _ENDS[out] = ends
    return out


def _matches(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    ends = _ENDS.get(pattern)
    stop = len(text)
    if isinstance(ends, str):
        stop = 1 + max(text.rfind(c) for c in ends)
    elif ends is not None:
        last = deque(ends.finditer(text), 1)
        stop = last[0].end() if last else 0
    yield from pattern.finditer(text, 0, stop)
    if pattern in _SHORTER:
        yield from _SHORTER[pattern].finditer(text, stop)


def _quoted(before: str, after: str = "") -> re.Pattern:
    return _p(f"{before}{Q}({NQ}+){Q}{after}")


_FROM, _BRACE_FROM = _quoted(r"\bfrom\s*"), _quoted(r"\}\s+from\s*")
_EXPORT = _p(rf"\bexport\s+(type\s+)?(?:\*|\{{[\s\S]*?\}})\s+from\s*{Q}({NQ}+){Q}", ends=_BRACE_FROM)
#: What a pattern still matches behind its last end.
_SHORTER = {_EXPORT: _p(rf"\bexport\s+(type\s+)?\*\s+from\s*{Q}({NQ}+){Q}")}
#: A pattern for each way to write an import, with the kind of its one group.
SCRIPT = [
    ("type", _p(rf"\bimport\s+type\b[\s\S]*?\bfrom\s*{Q}({NQ}+){Q}", ends=_FROM)),
    ("value", _p(rf"\bimport\s+(?!type\b)[\s\S]*?\bfrom\s*{Q}({NQ}+){Q}", ends=_FROM)),
    ("value", _quoted(r"\bimport\s*")),
    ("export", _EXPORT),
    ("value", _p(rf"(?:^|[^\w])import\(\s*{Q}([^\"'`$]+){Q}\s*\)")),
    ("template", _p(r"(?:^|[^\w])import\(\s*`([^`$]*(?:\$\{[^}`]+\}[^`$]*)+)`\s*\)")),
    ("value", _p(rf"(?:^|[^\w])require\(\s*{Q}([^\"'`$]+){Q}\s*\)")),
]
#: A line's beginning; no more than its own blanks, as a run of empty lines would be gone over once for each.
_L = r"^[^\S\n]*"
PATTERNS: dict[str, list[tuple[str, re.Pattern]]] = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte"), SCRIPT),
    ".py": [("modules", _p(_L + r"import\s+([^\n#]+)")), ("names", _p(_L + r"from\s+(\S+\s+import\s+[^\n#]+)"))],
    ".go": [("value", _quoted(_L + r"import\s+(?:[\w.]+\s+)?")), ("block", _p(_L + r"import\s*\(([\s\S]*?)\)", ends=")"))],
    ".rs": [("value", _p(_L + r"(?:pub(?:\([^)\n]*\))?\s+)?use\s+([^;]+);", ends=";"))],
    **dict.fromkeys((".java", ".kt", ".scala"), [("value", _p(_L + r"import\s+(?:static\s+)?([^;\n]+);?"))]),
    ".rb": [("value", _quoted(r"\brequire_relative\s+")), ("value", _quoted(r"\brequire\s+(?:\(\s*)?"))],
    ".php": [("uses", _p(_L + r"use\s+([^;]+);", ends=";"))],
    **dict.fromkeys((".c", ".cpp", ".m"), [("value", _p(_L + r'#(?:include|import)\s*[<"]([^>"]+)[>"]', ends='>"'))]),
    ".cs": [("value", _p(_L + r"using\s+([^;]+);", ends=";"))],
    ".swift": [("value", _p(_L + r"import\s+([A-Za-z_][\w.]*)"))],
    ".lua": [("value", _quoted(r"\brequire\s*\(\s*", r"\s*\)")), ("value", _quoted(r"\brequire\s+"))],
    ".dart": [("value", _quoted(r"\bimport\s+"))],
    ".ex": [("value", _p(_L + r"(?:alias|import|use)\s+([A-Za-z_][\w.]*)"))],
    ".zig": [("value", _quoted(r"@import\(\s*", r"\s*\)"))],
    ".sh": [("value", _p(_L + r"(?:source|\.)\s+([^\s#;]+)"))],
    ".ps1": [("value", _p(_L + r"\.\s+([^\s#;]+)")), ("value", _p(_L + r"Import-Module\s+([^\s#;]+)", re.I))],
    ".jl": [("value", _quoted(r"\binclude\(\s*", r"\s*\)")), ("value", _p(_L + r"(?:using|import)\s+([^\n]+)"))],
    **dict.fromkeys((".v", ".sv"), [("value", _quoted(_L + r"`include\s+"))]),
    ".html": [],
}
#: A constant string, and a hole for one in a template.
_CONSTANT = _p(r"\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*(['\"])([^'\"\\]*(?:\\.[^'\"\\]*)*)\2")
_HOLE = _p(r"\$\{\s*([A-Za-z_$][\w$]*)\s*\}")
_AS = re.compile(r"\s+as\s+", re.I)

NAME = r"([A-Za-z_$][\w$]*)"
#: A pattern for each kind of symbol; of those that hold brackets what comes before and after these.
_SCRIPT_SYMBOLS = [
    ("function", _p(rf"\bfunction\s+{NAME}\s*\("), None),
    ("class", _p(rf"\bclass\s+{NAME}\b"), None),
    ("method", _p(rf"\n[^\S\n]*{NAME}\s*\("), _p(r"\s*\{")),
    ("variable", _p(rf"\b(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?(?:(\()|[A-Za-z_$][\w$]*\s*=>)"), _p(r"\s*=>")),
]
SCRIPTS = (".ts", ".tsx", ".js", ".jsx")
_CONTROL = {"if", "for", "while", "switch", "catch", "function", "return"}


def normalize(ext: str, raw: str, parity: bool = False) -> str:
    """What an import names, as the resolver wants it."""
    s = re.sub("^[\"'`]|[\"'`]$", "", raw.strip())
    if ext == ".py":
        dots = len(s) - len(s.lstrip("."))
        rest = s[dots:].replace(".", "/")
        return rest if not dots else "../" * (dots - 1) + rest if dots > 1 else f"./{rest}" if rest else "."
    if ext == ".rs":
        s = re.sub(r"\{[\s\S]*\}", "", re.split(r"\s+as\s+", s)[0].strip()).strip()
        return s[:-2] if s.endswith("::") else s
    if ext in (".c", ".cpp"):
        return re.sub("^<|>$", "", s)
    return {".php": lambda: s.replace("\\", "/"), ".swift": lambda: s.replace("_", "/"), ".lua": lambda: s.replace(".", "/"), ".ex": lambda: s.replace(".", "/").lower()}.get(ext, lambda: s)()


def _raw(ext: str, text: str, parity: bool) -> Iterable[tuple[str, str, bool]]:
    """(written form, value or type, dynamic) of each import, in the order of the patterns."""
    constants = {m[1]: m[3] for m in _CONSTANT.finditer(text)} if PATTERNS[ext] is SCRIPT else {}
    for kind, pattern in PATTERNS[ext]:
        for m in _matches(pattern, text):
            got = m[1]
            if kind == "export":
                yield m[2], "type" if got else "value", False
            elif kind in ("value", "type"):
                yield got, kind, False
            elif kind == "template":
                if all(h[1] in constants for h in _HOLE.finditer(got)) and not re.sub(_HOLE, "", got).count("${"):
                    yield _HOLE.sub(lambda h: constants[h[1]], got), "value", True
            elif kind in ("modules", "uses"):
                for part in got.split(",") if kind == "modules" else re.sub(r"^.*\{|\}", "", got).split(",") if "{" in got and not parity else [got]:
                    if part.strip():
                        prefix = got.split("{")[0].strip() if kind == "uses" and "{" in got and not parity else ""
                        yield prefix + _AS.split(part.strip())[0], "value", False
            elif kind == "names":
                module, names = re.split(r"\s+import\s+", got, maxsplit=1)
                for name in (_AS.split(n.strip(" ()\t\r"))[0].strip() for n in names.split(",")):
                    if name and name != "*":
                        # `from . import x` names ./x; a dot more would be the parent directory.
                        yield (module + name if module.endswith(".") and not parity else f"{module}.{name}"), "value", False
                    elif name == "*":
                        yield module, "value", False
            elif kind == "block":
                for inner in _quoted("").finditer(got):
                    yield inner[1], "value", False


def imports_of(ext: str, text: str, parity: bool = False) -> list[tuple[str, str, bool]]:
    """(source, type, dynamic) of a file, each source once: a value import outweighs type imports, a dynamic one static ones."""
    if ext not in PATTERNS:
        return []
    found: dict[str, list] = {}
    for raw, kind, dynamic in _raw(ext, text, parity):
        source = normalize(ext, raw, parity)
        if source:
            entry = found.setdefault(source, [kind, dynamic])
            entry[0] = "value" if "value" in (kind, entry[0]) else "type"
            entry[1] |= dynamic
    return [(s, *e) for s, e in found.items()]


#: What is taken off the ends of a comment where known quirks are kept.
_PARITY_MARKS = (re.compile(r"^(/\*\*?|//|\*)\s*"), re.compile(r"\*/$"))


def _with_brackets(head: re.Pattern, tail: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of ``head``, an opening bracket at its end if its last group says so, up to the next closing one, and ``tail``.

    The next closing bracket, and whether ``tail`` follows it, is looked up
    once for all heads before it.
    """
    pos, close, after = 0, -1, None
    while m := head.search(text, pos):
        if head.groups > 1 and m[2] is None:
            yield m
            pos = m.end()
            continue
        if close < m.end():
            close = text.find(")", m.end())
            if close < 0:
                close = len(text)
            after = tail.match(text, close + 1)
        if after:
            yield m
        pos = after.end() if after else m.start() + 1


def symbols_of(ext: str, text: str, parity: bool = False) -> list[tuple[str, str, int]]:
    """(name, type, line) of a script by patterns, each once; of other languages by the lexer."""
    if ext not in SCRIPTS:
        return [(x.name, x.type, x.line) for x in declarations(ext, text)]
    found: dict[tuple[str, str, int], None] = {}
    starts = [m.end() for m in re.finditer("\n", text)]
    for kind, head, tail in _SCRIPT_SYMBOLS:
        for m in head.finditer(text) if tail is None else _with_brackets(head, tail, text):
            if parity or not (kind == "method" and m[1] in _CONTROL):
                found[m[1], kind, bisect_right(starts, m.start(1) if kind == "method" else m.start()) + 1] = None
    return list(found)


def _parity_docstring(comment: str | None) -> str | None:
    return comment and _PARITY_MARKS[1].sub("", _PARITY_MARKS[0].sub("", comment)).strip()


def all_symbols(ext: str, text: str, imported: bool, parity: bool = False, deep: bool = False) -> list[tuple]:
    """(name, type, line, docstring, end line, scope) of a file.

    Scripts have the symbols of their patterns first, then, if ``deep``, those names that only the
    lexer finds, unless both symbols and imports were found and the language need not be gone through
    twice.  What the lexer knows of a symbol's end and scope holds for both.
    """
    lexed = declarations(ext, text, raw_comments=parity)
    doc = _parity_docstring if parity else lambda x: x
    whole = [(x.name, x.type, x.line, doc(x.docstring), x.end_line, x.scope) for x in lexed]
    if ext not in SCRIPTS:
        return whole
    at = {(x.name, x.line): x for x in reversed(lexed)}
    out = []
    for name, kind, line in symbols_of(ext, text, parity):
        x = at.get((name, line))
        out.append((name, kind, line, None, x.end_line if x else line, x.scope if x else None))
    if deep and not (out and imported and ext not in FORCED_DEEP):
        names = {x[0] for x in out}
        out += list({x[0]: x for x in reversed(whole) if x[0] not in names}.values())[::-1]
    return out


Extractor = Callable[[str, str], tuple[list[tuple[str, str, int, str | None]], list[tuple[str, str, bool]]] | None]


def extracted(files: DataFrame, parity: bool = False, extractor: Extractor | None = None, deep: bool = False) -> DataFrame:
    """(path, ext, imports, symbols, error) of ``files`` (path, content); one broken file does not stop the others.

    ``extractor(ext, text)`` is a pass more, as by a grammar: its symbols
    (name, type, line, docstring) and imports (source, type, dynamic) come after
    those of the patterns and of the lexer, and only names and sources that are new.  None
    stands for a language it doesn't know.  The time is linear in a file's length.
    """

    def parsed(ext: str, text: str) -> tuple[list[dict], list[dict]]:
        imports = imports_of(ext, text, parity)
        symbols = all_symbols(ext, text, bool(imports), parity, deep)
        more = extractor(ext, text) if extractor else None
        if more is not None:
            names, sources = {x[0] for x in symbols}, {x[0] for x in imports}
            symbols += [(*x, x[2], None) for x in list({x[0]: x for x in reversed(more[0]) if x[0] not in names}.values())[::-1]]
            imports += list({x[0]: x for x in reversed(more[1]) if x[0] not in sources}.values())[::-1]
        return [dict(zip(("source", "type", "dynamic"), x), pos=i) for i, x in enumerate(imports)], [dict(zip(("name", "type", "line", "docstring", "end", "scope"), x), pos=i) for i, x in enumerate(symbols)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, text in zip(batch["path"], batch["ext"], batch["content"]):
                try:
                    rows.append((path, ext, *parsed(ext, (text or "").removeprefix("\ufeff")), None))
                except Exception as e:
                    rows.append((path, ext, [], [], str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "ext", "imports", "symbols", "error"])

    shape = "path string, ext string, imports array<struct<pos:int,source:string,type:string,dynamic:boolean>>, symbols array<struct<pos:int,name:string,type:string,line:int,docstring:string,end:int,scope:string>>, error string"
    return files.select("path", extension(F.col("path")).alias("ext"), "content").mapInPandas(run, shape)
