"""Ignore rules against a plain matcher."""

import random
import re

import pytest

from millrace.session import Index
from millrace.sources import ignore
from millrace.streaming import watch


@pytest.mark.parametrize(
    ("line", "path", "folder", "hit"),
    [
        ("a", "a", False, True), ("a", "x/a", True, True), ("/a", "x/a", False, False), ("a/", "a", False, False), ("a/", "x/a", True, True), ("a/b", "a/b", False, True), ("a/b", "x/a/b", False, False), ("**/a/b", "x/a/b", False, True),
        ("a/**", "a", True, False), ("a/**", "a/b/c", False, True), ("a/**/b", "a/b", False, True), ("a/**/b", "a/x/y/b", False, True), ("*.log", "x/y.log", False, True), ("*.log", "x/log", False, False), ("a*c", "abc", False, True), ("/a*c", "a/c", False, False),
        ("f?o", "foo", False, True), ("f[!a-c]o", "fxo", False, True), ("f[!a-c]o", "fbo", False, False), ("f[]x]o", "f]o", False, True), ("\\#a", "#a", False, True), ("\\!a", "!a", False, True), ("a\\ ", "a ", False, True), ("a  ", "a", False, True), ("a.b+c", "a.b+c", False, True), ("[", "[", False, True), ("x.*", "x.y", False, True), ("!a", "a", False, True), ("*.tar.gz", "v/1.tar.gz", False, True),
    ],
)
def test_lines(line, path, folder, hit):
    _, folders, key, pattern = ignore.parsed(line)
    name = path.rsplit("/", 1)[-1]
    assert (bool(re.match(pattern, path)) and (folder or not folders)) is hit
    assert not hit or key == "*" or key == "=" + name or (key[0] == "." and name.endswith(key))


def test_lines_without_a_rule():
    assert [ignore.parsed(x) for x in ("", "   ", "# note", "/", "\r\n")] == [None] * 5


def plain(paths, lines):
    """Path by path, directory by directory, from the top."""
    out = []
    for path in paths:
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            verdict = False
            for above in range(n):
                for d, _, text in sorted(x for x in lines if x[0] == "/".join(parts[:above])):
                    got = ignore.parsed(text)
                    if got and (n < len(parts) or not got[1]) and re.match(got[3], "/".join(parts[above:n])):
                        verdict = not got[0]
            if verdict:
                out.append(path)
                break
    return sorted(out)


def test_nested_and_negated_rules(spark):
    rnd = random.Random(3)
    names, ends = ["a", "b", "gen", "out"], ["x.ts", "y.log", "z.min.js", "a", ".env"]
    paths = sorted({"/".join([*rnd.choices(names, k=rnd.randint(0, 4)), rnd.choice(ends)]) for _ in range(300)})
    globs = ["*.log", "gen/", "/out", "a/b", "!x.ts", "!*.log", "**/gen/*.ts", "out/**", "!out/a/", "*", "!*/", "?.ts", "[a-b]/*.js", "!a", ".env", "# no", ""]
    for _ in range(4):
        lines = [(d, i, x) for d in {"", *(rnd.choice(paths).rsplit("/", 1)[0] for _ in range(6))} for i, x in enumerate(rnd.sample(globs, rnd.randint(1, 4)))]
        df = spark.createDataFrame([(p,) for p in paths] + [(None,), (paths[0],)], "path string")
        got = ignore.ignored(df, ignore.rules(spark.createDataFrame(lines, "dir string, line int, text string")))
        assert sorted(r["path"] for r in got.collect()) == plain(paths, lines)


def test_trees(spark, tmp_path):
    """Of a tree with ignore files in several directories, those that hold are read, for indexing and for watching."""
    files = {".gitignore": "out2/\n*.log\n!keep.log.ts\n", "src/.gitignore": "/gen\r\n!x.log\n", "src/a.ts": "1", "src/gen/b.ts": "1", "src/deep/gen/c.ts": "1", "src/x.log": "1", "y.log": "1", "out2/c.ts": "1", "out2/.gitignore": "!c.ts", "keep.log.ts": "1", "_p/.gitignore": "q.ts", "_p/q.ts": "1", "_p/r.ts": "1"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    index = Index(spark, str(tmp_path), str(tmp_path / ".millrace" / "tables"))
    want = ["_p/r.ts", "keep.log.ts", "src/a.ts", "src/deep/gen/c.ts", "src/x.log"]
    assert sorted(r["path"] for r in index.scan().collect()) == want
    assert sorted(r["path"] for r in watch.polled(index).collect()) == want


def test_named_files_are_asked_for_by_themselves(spark, tmp_path, monkeypatch):
    """The tree is not listed for a few files; the ignore files above them hold, and names may have any characters."""
    from millrace.sources import tree

    files = {".gitignore": "*.log\n", "a/.gitignore": "!x.log\n/b/\n", "a/x.log": "1", "a/b/c.ts": "1", "a/[d]*? {e}.ts": "2", "_f.py": "3", "empty.ts": "", "g.log": "4"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    monkeypatch.setattr(tree, "listed", None)
    monkeypatch.setattr(tree, "tree_rules", None)
    asked = spark.createDataFrame([(p,) for p in [*files, "gone.ts", "a"]], "path string")
    got = {r["path"]: r["content"] for r in tree.scan(spark, str(tmp_path), paths=asked).collect()}
    assert got == {"a/x.log": "1", "a/[d]*? {e}.ts": "2", "_f.py": "3", "empty.ts": ""}
