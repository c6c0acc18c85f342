"""Symbols of source files with their extent, scope and comment: one table of languages, one pass over a text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import NamedTuple


class Language(NamedTuple):
    """How a language writes comments and strings, and how it closes what it opens: by braces, by indentation, or by words."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    nested: bool = False
    #: Strings that end with their line, that may have several, and single characters.
    short: tuple[str, ...] = ('"',)
    long: tuple[str, ...] = ()
    char: bool = True
    nesting: str = "brace"
    #: Words that open and close, where nesting goes by words.
    words: tuple[str, str] = ("", "")


_C = Language()
_NESTED = Language(nested=True, long=('"""',))
_HASH = Language(line=("#",), block=(), short=(), long=('"', "'"), char=False)
_SCRIPT = Language(short=('"', "'"), long=("`",), char=False)
_RUBY = (r"^[ \t]*(?:(?:\w+[ \t]+)?def|class|module|if|unless|case|begin)\b|^[ \t]*(?:while|until|for)\b[^\n]*|=[ \t]*(?:if|unless|case|begin)\b|\bdo\b", r"\bend\b")
_JULIA = (r"\b(?:function|begin|let|struct|module|do|quote|try|macro)\b|(?:^|=)[ \t]*(?:@\w+[ \t]+)*(?:if|for|while)\b", r"\bend\b(?![ \t]*[\])+*/-])")
_VERILOG = (r"(?<!end)\b(?:module|class|function|task|interface|package)\b(?=[^\n;]*)", r"\bend(?:module|class|function|task|interface|package)\b")
LANGUAGES: dict[str, Language] = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte"), _SCRIPT),
    ".py": Language(line=("#",), block=(), short=('"', "'"), long=('"""', "'''"), char=False, nesting="indent"),
    ".go": Language(long=("`",)),
    ".rs": Language(nested=True, short=(), long=('"',)),
    **dict.fromkeys((".kt", ".scala", ".swift"), _NESTED),
    ".java": Language(long=('"""',)),
    **dict.fromkeys((".c", ".cpp", ".h", ".hpp", ".m", ".cs"), _C),
    ".rb": Language(line=("#",), block=(("\n=begin", "\n=end"),), short=(), long=('"', "'"), char=False, nesting="words", words=_RUBY),
    ".php": Language(line=("//", "#"), short=(), long=('"', "'"), char=False),
    ".lua": Language(line=("--",), block=(("--[[", "]]"), ("--[=[", "]=]")), short=('"', "'"), long=("[[",), char=False, nesting="words", words=(r"\b(?:function|if|do|repeat)\b", r"\b(?:end|until)\b")),
    ".dart": Language(short=('"', "'"), long=('"""', "'''"), char=False),
    ".ex": Language(line=("#",), block=(), short=('"', "'"), long=('"""',), char=False, nesting="words", words=(r"\bdo\b(?!:)|\bfn\b", r"\bend\b")),
    ".zig": Language(line=("//", "\\\\"), block=()),
    ".sh": _HASH,
    ".ps1": _HASH._replace(block=(("<#", "#>"),)),
    ".jl": Language(line=("#",), block=(("#=", "=#"),), short=(), long=('"""', '"'), nesting="words", words=_JULIA),
    **dict.fromkeys((".v", ".sv"), Language(char=False, nesting="words", words=_VERILOG)),
}
#: What closes a string that opens otherwise.
_CLOSES = {"[[": "]]"}

_N = r"([A-Za-z_]\w*)"
_MODIFIED = r"^[ \t]*(?:[\w<>\[\],.?*&:~@]+[ \t]+)*?[*&]*"


def _p(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.M | re.A)


#: Declarations by language: the kind, a pattern that ends behind the name, and whether parameters and a body must follow.
_SCRIPT_NAMES = [
    ("function", _p(r"\bfunction\b[ \t]*\*?[ \t]*([A-Za-z_$][\w$]*)"), False), ("class", _p(r"\bclass[ \t]+([A-Za-z_$][\w$]*)"), False), ("interface", _p(r"\binterface[ \t]+([A-Za-z_$][\w$]*)"), False), ("class", _p(r"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:const[ \t]+)?(?:enum|type)[ \t]+([A-Za-z_$][\w$]*)"), False),
    ("method", _p(r"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)[ \t]+)*[*#]?([A-Za-z_$][\w$]*)[ \t]*(?:<[^<>()\n]*>)?(?=\()"), True), ("variable", _p(r"\b(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)"), False),
]
DECLARED: dict[str, list[tuple[str, re.Pattern, bool]]] = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte"), _SCRIPT_NAMES),
    ".py": [("class", _p(rf"^[ \t]*class[ \t]+{_N}"), False), ("function", _p(rf"^[ \t]*(?:async[ \t]+)?def[ \t]+{_N}"), False)],
    ".go": [("function", _p(rf"^func[ \t]+{_N}"), False), ("method", _p(rf"^func[ \t]*\([^)\n]*\)[ \t]*{_N}"), False), ("class", _p(rf"^(?:type[ \t]+|[ \t]+(?=\w+[ \t]+(?:struct|interface)\b)){_N}"), False)],
    ".rs": [("function", _p(rf"\bfn[ \t]+{_N}"), False), ("struct", _p(rf"\b(?:struct|union)[ \t]+{_N}"), False), ("class", _p(rf"\benum[ \t]+{_N}"), False), ("interface", _p(rf"\btrait[ \t]+{_N}"), False), ("module", _p(rf"\bmod[ \t]+{_N}"), False)],
    ".java": [("class", _p(rf"\b(?:class|enum|record)[ \t]+{_N}"), False), ("interface", _p(rf"\binterface[ \t]+{_N}"), False), ("method", _p(rf"{_MODIFIED}{_N}[ \t]*(?=\()"), True)],
    ".cs": [("class", _p(rf"\b(?:class|enum|record)[ \t]+{_N}"), False), ("struct", _p(rf"\bstruct[ \t]+{_N}"), False), ("interface", _p(rf"\binterface[ \t]+{_N}"), False), ("module", _p(r"\bnamespace[ \t]+([\w.]+)"), False), ("method", _p(rf"{_MODIFIED}{_N}[ \t]*(?=\()"), True)],
    ".rb": [("class", _p(r"^[ \t]*class[ \t]+([A-Z][\w:]*)"), False), ("module", _p(r"^[ \t]*module[ \t]+([A-Z][\w:]*)"), False), ("method", _p(r"^[ \t]*(?:\w+[ \t]+)?def[ \t]+(?:self\.)?(\w+[?!=]?)"), False)],
    ".php": [("class", _p(rf"\b(?:class|trait|enum)[ \t]+{_N}"), False), ("interface", _p(rf"\binterface[ \t]+{_N}"), False), ("function", _p(rf"^function[ \t]+&?{_N}"), False), ("method", _p(rf"^[ \t]+(?:\w+[ \t]+)*function[ \t]+&?{_N}"), False)],
    **dict.fromkeys((".c", ".h"), [("struct", _p(rf"\b(?:struct|union|enum)[ \t]+{_N}(?=\s*\{{)"), False), ("function", _p(rf"^(?:\w+[ \t*]+)+?{_N}[ \t]*(?=\()"), True)]),
    **dict.fromkeys((".cpp", ".hpp"), [("class", _p(rf"\bclass[ \t]+{_N}"), False), ("struct", _p(rf"\b(?:struct|union)[ \t]+{_N}(?=[^;(\n]*(?:\{{|$))"), False), ("module", _p(r"\bnamespace[ \t]+([\w:]+)"), False), ("function", _p(r"^[ \t]*(?:[\w<>,*&:~]+[ \t]+)*?[*&]*(?:\w+::)*(~?[A-Za-z_]\w*)[ \t]*(?=\()"), True)]),
    ".m": [("class", _p(rf"^@(?:interface|implementation|protocol)[ \t]+{_N}"), False), ("method", _p(rf"^[-+][ \t]*\([^)\n]*\)[ \t]*{_N}"), False), ("function", _p(rf"^(?:\w+[ \t*]+)+?{_N}[ \t]*(?=\()"), True)],
    ".swift": [("function", _p(rf"\bfunc[ \t]+{_N}"), False), ("class", _p(rf"\b(?:class|enum|actor|extension)[ \t]+(?!func\b|var\b){_N}"), False), ("struct", _p(rf"\bstruct[ \t]+{_N}"), False), ("interface", _p(rf"\bprotocol[ \t]+{_N}"), False)],
    ".kt": [("function", _p(rf"\bfun[ \t]+(?:<[^>\n]*>[ \t]*)?(?:\w+\.)*{_N}"), False), ("class", _p(rf"\b(?:class|object)[ \t]+{_N}"), False), ("interface", _p(rf"\binterface[ \t]+{_N}"), False)],
    ".scala": [("function", _p(rf"\bdef[ \t]+{_N}"), False), ("class", _p(rf"\bclass[ \t]+{_N}"), False), ("module", _p(rf"\bobject[ \t]+{_N}"), False), ("interface", _p(rf"\btrait[ \t]+{_N}"), False)],
    ".lua": [("function", _p(r"\bfunction[ \t]+([\w.:]+)"), False), ("function", _p(r"^[ \t]*(?:local[ \t]+)?([\w.]+)[ \t]*=[ \t]*function\b"), False)],
    ".dart": [("class", _p(rf"\b(?:class|mixin|enum|extension)[ \t]+{_N}"), False), ("function", _p(rf"{_MODIFIED}{_N}[ \t]*(?=\()"), True)],
    ".ex": [("module", _p(r"\bdef(?:module|protocol)[ \t]+([\w.]+)"), False), ("function", _p(r"^[ \t]*def(?:p|macro|macrop|guard)?[ \t]+(\w+[?!]?)"), False)],
    ".zig": [("function", _p(rf"\bfn[ \t]+{_N}"), False), ("struct", _p(rf"\bconst[ \t]+{_N}(?=[ \t]*=[ \t]*(?:packed[ \t]+|extern[ \t]+)?(?:struct|enum|union)\b)"), False)],
    ".sh": [("function", _p(r"^[ \t]*(?:function[ \t]+)?([\w-]+)[ \t]*(?=\(\))"), False), ("function", _p(r"^[ \t]*function[ \t]+([\w-]+)"), False)],
    ".ps1": [("function", re.compile(r"^[ \t]*(?:function|filter)[ \t]+([\w:-]+)", re.M | re.A | re.I), False), ("class", re.compile(rf"^[ \t]*class[ \t]+{_N}", re.M | re.A | re.I), False)],
    ".jl": [("function", _p(r"^[ \t]*(?:@\w+[ \t]+)*(?:function|macro)[ \t]+(?:\w+\.)*(\w+!?)"), False), ("function", _p(r"^(\w+!?)(?=\([^()\n]*\)[ \t]*=(?!=))"), False), ("struct", _p(rf"\bstruct[ \t]+{_N}"), False), ("module", _p(rf"^[ \t]*module[ \t]+{_N}"), False)],
    **dict.fromkeys((".v", ".sv"), [("class", _p(rf"^[ \t]*(?:module|class|interface|package)[ \t]+(?:automatic[ \t]+)?{_N}"), False), ("function", _p(r"^[ \t]*(?:virtual[ \t]+|static[ \t]+)*(?:function|task)\b[^\n;(]*?(\w+)(?=[ \t]*[(;])"), False)]),
}
#: Words that are followed by parentheses, or stand before a name, without declaring it.
_NOT_NAMES = set("if for while switch catch return else do new throw await typeof sizeof elif until match when function super this using lock foreach synchronized assert case in of and or not with yield delete".split())
#: How a header goes on in the next line.
_GOES_ON = re.compile(r"[ \t]*(?:extends|implements|throws|where|with|noexcept|const|override|:|->|,|\{)")


@lru_cache(64)
def _openers(language: Language) -> re.Pattern:
    """What opens a comment or a string, the longest first."""
    marks = [*language.line, *(b for b, _ in language.block), *language.short, *language.long]
    parts = ["|".join(re.escape(m) if m != "#" else r"(?<![^\s;(])#" for m in sorted(marks, key=len, reverse=True))]
    if language.char:
        parts.append(r"'(?:\\[^\n']{1,8}|\\'|[^'\\\n])'")
    if language is _SCRIPT:  # a regular expression, where a value can begin
        parts.append(r"(?<=[(,=:\[!&|?{;]) ?/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/")
    return re.compile("|".join(parts))


@lru_cache(64)
def _string_end(mark: str, long: bool) -> re.Pattern:
    close = _CLOSES.get(mark, mark)
    if len(close) > 1:
        return re.compile(rf"(?:(?!{re.escape(close)})(?:\\[\s\S]|[\s\S]))*+(?:{re.escape(close)}|\Z)")
    return re.compile(rf"(?:[^{close}\\{'' if long else chr(92) + 'n'}]|\\[\s\S])*+(?:{close})?")


def _blank(s: str) -> str:
    return "\n".join(" " * len(x) for x in s.split("\n"))


@dataclass
class Lexed:
    """A text without comments and what is inside strings, every character else in its place, and the comments by their last lines."""

    code: str
    language: Language
    comments: dict[int, str] = field(default_factory=dict)

    @cached_property
    def starts(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.code))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    @cached_property
    def events(self) -> tuple[list[int], dict[int, int]]:
        """Places of brackets, braces and semicolons, and the partner of each that opens one."""
        places, partner, open_ = [], {}, {"(": [], "{": []}
        for m in re.finditer(r"[(){};]", self.code):
            c, at = m[0], m.start()
            places.append(at)
            if c in open_:
                open_[c].append(at)
            elif c == ")" and open_["("]:
                partner[open_["("].pop()] = at
            elif c == "}" and open_["{"]:
                partner[open_["{"].pop()] = at
        return places, partner

    @cached_property
    def words(self) -> tuple[list[int], dict[int, int]]:
        """Places of words that open, and where what they open ends."""
        opens, closes = self.language.words
        places, partner, stack = [], {}, []
        for m in re.finditer(rf"(?P<o>{opens})|(?P<c>{closes})", self.code, re.M):
            if m["o"] is not None:
                places.append(m.end() - 1)
                stack.append(m.end() - 1)
            elif stack:
                partner[stack.pop()] = m.start()
        return places, partner

    @cached_property
    def dedents(self) -> list[int]:
        """For each line the last line of the block it opens by indentation."""
        lines = self.code.split("\n")
        out, stack, last = list(range(1, len(lines) + 1)), [], 0
        for i, text in enumerate(lines):
            bare = text.lstrip()
            if not bare:
                continue
            width = len(text) - len(bare)
            # A closing bracket at the margin goes on with a statement.
            while stack and stack[-1][0] >= width and bare[0] not in ")]}":
                out[stack.pop()[1]] = last + 1
            stack.append((width, i))
            last = i
        for _, i in stack:
            out[i] = last + 1
        return out

    def end(self, begin: int, name_end: int, body: bool) -> int | None:
        """Where the declaration ends whose name ends at ``name_end``; None if it needs a body that isn't there."""
        if self.language.nesting == "indent":
            last = self.dedents[self.line(name_end) - 1]
            return self.starts[last] - 1 if last < len(self.starts) else len(self.code)
        if self.language.nesting == "words":
            places, partner = self.words
            k = bisect_left(places, begin)
            if k < len(places) and self.line(places[k]) == self.line(name_end):
                return partner.get(places[k], name_end)
            return name_end
        places, partner = self.events
        at, k = name_end, bisect_left(places, name_end)
        while k < len(places):
            place = places[k]
            line, here = self.line(at), self.line(place)
            if any(not _GOES_ON.match(self.code, self.starts[n]) for n in range(line, min(here, line + 2))):
                break
            c = self.code[place]
            if c == "(" and place in partner:
                at = partner[place]
                k = bisect_right(places, at)
                continue
            if c == "{":
                return partner.get(place, name_end)
            break
        return None if body else name_end


def lexed(ext: str, text: str) -> Lexed:
    """One pass over a text: what opens a comment or a string is looked for, and skipped up to its end."""
    language = LANGUAGES[ext]
    opener, blocks = _openers(language), dict(language.block)
    out, pos = Lexed("", language), 0
    parts: list[str] = []
    lines = 1

    def skip(start: int, end: int, comment: bool) -> None:
        nonlocal pos, lines
        lines += text.count("\n", pos, end)
        parts.append(text[pos:start])
        # A string's mark stays, as it is something that a line can begin with.
        parts.append(_blank(text[start:end]) if comment else text[start] + _blank(text[start + 1 : end]))
        if comment:
            # Of several comments in a row of lines the last counts.
            out.comments[lines - (text[end - 1 : end] == "\n")] = text[start:end]
        pos = end

    while m := opener.search(text, pos):
        mark, end = m[0], m.end()
        if mark in blocks:
            close = blocks[mark]
            if language.nested:
                depth = 1
                for x in re.compile(f"{re.escape(mark)}|{re.escape(close)}").finditer(text, end):
                    depth += 1 if x[0] == mark else -1
                    end = x.end()
                    if not depth:
                        break
                else:
                    end = len(text)
            else:
                at = text.find(close, end)
                end = len(text) if at < 0 else at + len(close)
            skip(m.start(), end, True)
        elif mark in language.line:
            at = text.find("\n", end)
            skip(m.start(), len(text) if at < 0 else at, True)
        elif mark in language.short or mark in language.long:
            skip(m.start(), _string_end(mark, mark in language.long).match(text, end).end(), False)
        else:
            skip(m.start(), end, False)
    parts.append(text[pos:])
    out.code = "".join(parts)
    return out


_SCRIPT_BLOCK = re.compile(r"<script\b[^>]*>", re.I)


def scripts_only(text: str) -> str:
    """A component file of which only the insides of its script tags are left, each in its place."""
    parts, pos = [], 0
    while m := _SCRIPT_BLOCK.search(text, pos):
        end = text.find("</script", m.end())
        end = len(text) if end < 0 else end
        parts += [_blank(text[pos : m.end()]), text[m.end() : end]]
        pos = end
    return "".join([*parts, _blank(text[pos:])])


_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+(?!/)|//+!?|#+[=!]?|--+(?:\[=*\[)?|<#|=begin)[ \t]?", re.M)
_LAST_MARK = re.compile(r"[ \t]*(?:\*+/|\]=*\]|=#|#>|\n=end)\s*$")


def without_marks(comment: str) -> str:
    """A comment's text without the marks of any of its lines."""
    return _MARKS.sub("", _LAST_MARK.sub("", comment.strip())).strip()


#: Lines that may stand between a declaration and its comment, and what they begin with.
SIBLINGS = 5
_BETWEEN = re.compile(r"[ \t]*(?:@(?!interface|implementation|protocol|end)|#\[|\[|template\b|(?:export|default|public|private|static|async)[ \t]*$|$)")


class Symbol(NamedTuple):
    name: str
    type: str
    line: int
    end_line: int
    scope: str | None
    docstring: str | None


def declarations(ext: str, text: str, raw_comments: bool = False) -> list[Symbol]:
    """The symbols of a file in order of their places: each with its last line, the name it lies in, and the comment above it.

    Comments and strings declare nothing.  The comment is the one that ends
    just above, but for blank lines, and for up to five lines of annotations;
    its marks are taken off unless ``raw_comments``.
    """
    if ext in (".vue", ".svelte"):
        text = scripts_only(text)
    if ext not in DECLARED:
        return []
    x = lexed(ext, text)
    found: dict[int, tuple] = {}
    for kind, pattern, body in DECLARED[ext]:
        for m in pattern.finditer(x.code):
            if body and m[1] in _NOT_NAMES or m.start(1) in found:
                continue
            if body:
                before = x.code[max(x.starts[x.line(m.start(1)) - 1], m.start(1) - 40) : m.start(1)].split()
                if before and before[-1] in _NOT_NAMES:
                    continue
            end = x.end(m.start(), m.end(1), body)
            if end is not None:
                found[m.start(1)] = (m[1], kind, end)
    out: list[Symbol] = []
    scope: list[tuple[int, str]] = []
    for at in sorted(found):
        name, kind, end = found[at]
        while scope and scope[-1][0] <= at:
            scope.pop()
        line = x.line(at)
        comment = _comment(x, line)
        out.append(Symbol(name, kind, line, max(line, x.line(end)), scope[-1][1] if scope else None, comment if raw_comments or comment is None else without_marks(comment)))
        if end > at + len(name):
            scope.append((end + 1, name))
    return out


def _comment(x: Lexed, line: int) -> str | None:
    between = 0
    for at in range(line - 1, max(0, line - 50), -1):
        if at in x.comments:
            begin = x.starts[at - 1]
            if not x.code[begin : x.starts[at] if at < len(x.starts) else None].strip():
                return x.comments[at].strip()
            return None
        text = x.code[x.starts[at - 1] : x.starts[at] - 1]
        if text.strip():
            between += 1
            if between > SIBLINGS or not _BETWEEN.match(text):
                return None
    return None
