"""Declarations against expectations by hand, for every language; and the time they take."""

import time

import pytest

from millrace.functions.extract import all_symbols, imports_of
from millrace.functions.lexer import declarations, without_marks

#: For each language a text, and name, type, first and last line, scope and comment of all it declares.
EXPECTED = [
    (".ts", '/**\n * Doc of A.\n * More.\n */\n@dec()\nexport class A<T> extends B implements C {\n  private x = 1;\n  constructor(private y: string) {\n    super();\n  }\n  /* of m */\n  async m(a: T = {"}": 1}): Promise<void> {\n    if (a) { return }\n    for (const q of [1]) {}\n  }\n}\n\n// not of I\n\nlet z = 1;\ninterface I { f(): void }\ntype Alias = string;\nexport const arrow = async (x) => {\n  return /["\'{]/.test(x);\n};\nconst text = `function no() {`;\n',
     [("A", "class", 6, 16, None, "Doc of A.\nMore."), ("constructor", "method", 8, 10, "A", None), ("m", "method", 12, 15, "A", "of m"), ("q", "variable", 14, 14, "m", None), ("z", "variable", 20, 20, None, "not of I"), ("I", "interface", 21, 21, None, None), ("Alias", "class", 22, 22, None, None), ("arrow", "variable", 23, 25, None, None), ("text", "variable", 26, 26, None, None)]),
    (".py", '# module\nimport os\n\nclass A(B):\n    """class No: pass"""\n\n    # about f\n    @property\n    def f(self, x=")"):\n        def inner():\n            pass\n        return "def no():"\n\n    async def g(\n        self,\n    ):\n        pass\n\n\ndef last(): pass\n',
     [("A", "class", 4, 17, None, None), ("f", "function", 9, 12, "A", "about f"), ("inner", "function", 10, 11, "f", None), ("g", "function", 14, 17, "A", None), ("last", "function", 20, 20, None, None)]),
    (".go", 'package p\n\n// Add adds.\nfunc Add(a, b int) int {\n\ts := `func no() {`\n\treturn a + b\n}\n\ntype (\n\tPoint struct {\n\t\tx int\n\t}\n)\n\n// M is a method.\nfunc (p *Point) M() {}\ntype Shape interface { Area() int }\n',
     [("Add", "function", 4, 7, None, "Add adds."), ("Point", "class", 10, 12, None, None), ("M", "method", 16, 16, None, "M is a method."), ("Shape", "class", 17, 17, None, None)]),
    (".rs", "/// Doc.\n#[derive(Debug)]\npub struct P<'a> {\n    x: &'a str,\n}\n/* outer /* inner */ fn no() {} */\nimpl P<'_> {\n    pub async fn new(c: char) -> Self {\n        let q = '{';\n        todo!()\n    }\n}\npub enum E { A }\npub trait T {\n    fn need(&self);\n}\nmod m;\n",
     [("P", "struct", 3, 5, None, "Doc."), ("new", "function", 8, 11, None, None), ("E", "class", 13, 13, None, None), ("T", "interface", 14, 16, None, None), ("need", "function", 15, 15, "T", None), ("m", "module", 17, 17, None, None)]),
    (".java", '/** Doc. */\n@Anno(x = "}")\npublic class A extends B\n    implements C {\n  private int x = f(1);\n  // gets\n  public <T> List<T> get(int a,\n      int b) throws E {\n    if (a) { foo(b); }\n    return new X(a);\n  }\n  abstract void no();\n  enum K { P }\n}\ninterface I {}\n',
     [("A", "class", 3, 14, None, "Doc."), ("get", "method", 7, 11, "A", "gets"), ("K", "class", 13, 13, "A", None), ("I", "interface", 15, 15, None, None)]),
    (".kt", "// Doc\ndata class P(val x: Int)\n\nfun String.ext(): Int {\n  return 1\n}\nobject O { fun <T> f(t: T) = t }\ninterface I\n", [("P", "class", 2, 2, None, "Doc"), ("ext", "function", 4, 6, None, None), ("O", "class", 7, 7, None, None), ("f", "function", 7, 7, "O", None), ("I", "interface", 8, 8, None, None)]),
    (".scala", "object O {\n  /** d */\n  def f(x: Int): Int = {\n    x\n  }\n}\ncase class C(a: Int)\ntrait T { def g: Int }\n", [("O", "module", 1, 6, None, None), ("f", "function", 3, 5, "O", "d"), ("C", "class", 7, 7, None, None), ("T", "interface", 8, 8, None, None), ("g", "function", 8, 8, "T", None)]),
    (".rb", "module M\n  # Doc\n  class A < B\n    def self.make(x)\n      return 1 if x\n      x.each do |y|\n        y unless y\n      end\n      z = if x then 1 else 2 end\n    end\n\n    private def ask?\n    end\n  end\nend\n=begin\ndef no\n=end\n", [("M", "module", 1, 15, None, None), ("A", "class", 3, 14, "M", "Doc"), ("make", "method", 4, 10, "A", None), ("ask?", "method", 12, 13, "A", None)]),
    (".php", "<?php\n# Doc\nclass A extends B {\n  public static function f($x) {\n    return 'function no() {';\n  }\n}\nfunction g() {\n}\ninterface I {}\n", [("A", "class", 3, 7, None, "Doc"), ("f", "method", 4, 6, "A", None), ("g", "function", 8, 9, None, None), ("I", "interface", 10, 10, None, None)]),
    (".c", "/* Doc */\nstatic const char *name(int a,\n                        int b)\n{\n  if (a) { call(b); }\n  return \"}\";\n}\nint proto(void);\nstruct point {\n  int x;\n};\n", [("name", "function", 2, 7, None, "Doc"), ("point", "struct", 9, 11, None, None)]),
    (".cpp", "namespace n {\n// Doc\nclass A : public B {\n  int f() const { return 1; }\n  void g();\n};\nstruct S { int x; };\nvoid A::g() {\n  while (x) { f(); }\n}\n}\n", [("n", "module", 1, 11, None, None), ("A", "class", 3, 6, "n", "Doc"), ("f", "function", 4, 4, "A", None), ("S", "struct", 7, 7, "n", None), ("g", "function", 8, 10, "n", None)]),
    (".cs", "namespace N.M\n{\n  /// <summary>Doc</summary>\n  public class A : B\n  {\n    public async Task<int> F(int a)\n    {\n      return await G(a);\n    }\n    int P { get; set; }\n  }\n  struct S { }\n}\n", [("N.M", "module", 1, 13, None, None), ("A", "class", 4, 11, "N.M", "<summary>Doc</summary>"), ("F", "method", 6, 9, "A", None), ("S", "struct", 12, 12, "N.M", None)]),
    (".swift", "// Doc\nclass A: B {\n  func f(_ x: Int) -> Int {\n    return x\n  }\n  class func g() {}\n}\nprotocol P { func need() }\nstruct S {}\n", [("A", "class", 2, 7, None, "Doc"), ("f", "function", 3, 5, "A", None), ("g", "function", 6, 6, "A", None), ("P", "interface", 8, 8, None, None), ("need", "function", 8, 8, "P", None), ("S", "struct", 9, 9, None, None)]),
    (".lua", "--[[ function no() end ]]\n-- Doc\nlocal function f(a)\n  for i = 1, 2 do\n    if i then g() end\n  end\nend\nM.h = function(x)\n  repeat x() until x\nend\nfunction M:k() end\n", [("f", "function", 3, 7, None, "Doc"), ("M.h", "function", 8, 10, None, None), ("M:k", "function", 11, 11, None, None)]),
    (".dart", "// Doc\nclass A extends B {\n  Future<int> f(int a) async {\n    if (a) { g(); }\n    return 1;\n  }\n}\nvoid main() {\n}\n", [("A", "class", 2, 7, None, "Doc"), ("f", "function", 3, 6, "A", None), ("main", "function", 8, 9, None, None)]),
    (".ex", "defmodule A.B do\n  # Doc\n  def f(x) do\n    case x do\n      1 -> fn y -> y end\n    end\n  end\n  defp g?(x), do: x\nend\n", [("A.B", "module", 1, 9, None, None), ("f", "function", 3, 7, "A.B", "Doc"), ("g?", "function", 8, 8, "A.B", None)]),
    (".zig", "// Doc\npub fn add(a: i32) i32 {\n    return a;\n}\nconst P = struct {\n    x: i32,\n};\n", [("add", "function", 2, 4, None, "Doc"), ("P", "struct", 5, 7, None, None)]),
    (".sh", "# Doc\nf() {\n  echo \"g() {\" ${#x}\n}\nfunction h {\n  :\n}\n", [("f", "function", 2, 4, None, "Doc"), ("h", "function", 5, 7, None, None)]),
    (".ps1", "<# Doc #>\nfunction Get-It {\n  param($x)\n}\nclass A {\n}\n", [("Get-It", "function", 2, 4, None, "Doc"), ("A", "class", 5, 6, None, None)]),
    (".m", "// Doc\n@interface A : B\n- (void)f;\n@end\n@implementation A\n- (int)g:(int)x {\n  return x;\n}\n@end\nint main(void) { return 0; }\n", [("A", "class", 2, 2, None, "Doc"), ("f", "method", 3, 3, None, None), ("A", "class", 5, 5, None, None), ("g", "method", 6, 8, None, None), ("main", "function", 10, 10, None, None)]),
    (".jl", "module M\n# Doc\nfunction f(x)\n  if x[end] > 1\n    return [i for i in x]\n  end\nend\ng(x) = x + 1\nmutable struct P\n  x\nend\nend\n", [("f", "function", 3, 7, "M", "Doc"), ("g", "function", 8, 8, "M", None), ("P", "struct", 9, 11, "M", None), ("M", "module", 1, 12, None, None)]),
    (".v", "// Doc\nmodule top (input a);\n  function [3:0] f(input b);\n    f = 8'hFF;\n  endfunction\nendmodule\n", [("top", "class", 2, 6, None, "Doc"), ("f", "function", 3, 5, "top", None)]),
    (".sv", "class C;\n  virtual task t();\n  endtask\nendclass\n", [("C", "class", 1, 4, None, None), ("t", "function", 2, 3, "C", None)]),
    (".vue", "<template>\n<p>function no() {}</p></template>\n<script setup>\n// Doc\nfunction f() {\n}\n</script>\n<style>class x {}</style>", [("f", "function", 5, 6, None, "Doc")]),
    (".svelte", "<script context='module'>\nexport const a = 1\n</script>\n<p/>\n<script>\nclass B {}\n</script>", [("a", "variable", 2, 2, None, None), ("B", "class", 6, 6, None, None)]),
    (".html", "<script>function f() {}</script>", []),
]


@pytest.mark.parametrize(("ext", "text", "want"), EXPECTED, ids=[x[0] for x in EXPECTED])
def test_declarations(ext, text, want):
    got = {(x.name, x.line): x for x in declarations(ext, text)}
    assert {(n, at) for n, _, at, *_ in want} == set(got)
    for name, kind, line, end, scope, doc in want:
        x = got[name, line]
        assert (x.type, x.docstring) == (kind, doc), name
        assert (x.end_line, x.scope) == (end, scope), name


@pytest.mark.parametrize("mark", ["// {}", "/// {}", "//! {}", "# {}", "## {}", "-- {}", "/* {} */", "/** {} */", "/**\n * {}\n */", "--[[ {} ]]", "#= {} =#", "<# {} #>", "=begin\n{}\n=end"])
def test_marks(mark):
    assert without_marks(mark.format("Says so, it-self # - *")) == "Says so, it-self # - *"


UNITS = [
    (".ts", "import a\n"), (".ts", "import {a} from './b'\n"), (".ts", "const x = (\n"), (".ts", "\na(\n"), (".ts", "export {\n"), (".ts", "import(`${"), (".ts", "\n"), (".ts", "class a "), (".ts", "/*"), (".ts", '"'), (".ts", "`"), (".ts", "{"), (".py", "\n"), (".py", "def f():\n"), (".rs", "use a\n"), (".rs", "/* "),
    (".go", "import (\n"), (".c", "#include <\n"), (".c", "* "), (".c", "int f("), (".php", "use x\n"), (".java", "  a b(\n"), (".java", "a "), (".rb", "def x\n"), (".kt", "class a\n"), (".lua", "[["), (".cs", "a.b[c]<d> "), (".cpp", "a::"),
]


@pytest.mark.parametrize(("ext", "unit"), UNITS)
def test_time_grows_with_the_length(ext, unit):
    """Four times the text takes about four times as long; if it grew with the square it would be sixteen times."""

    def took(n):
        text, best = unit * (n // len(unit)), float("inf")
        for _ in range(2):
            begin = time.process_time()
            all_symbols(ext, text, bool(imports_of(ext, text)))
            best = min(best, time.process_time() - begin)
        return best

    assert took(400_000) < 10 * max(took(100_000), 0.02)


def test_ten_megabytes():
    text = "import {a} from './b'\n// says what\nfunction f(x) {\n  return `${x}` + '}'\n}\n" * (10_000_000 // 75)
    begin = time.process_time()
    assert len(all_symbols(".ts", text, bool(imports_of(".ts", text)))) > 100_000
    assert time.process_time() - begin < 60
