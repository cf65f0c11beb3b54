import pytest

from arbora.llm import pairs as P

NOTHING = [None, "", "  ", "/** */", "// TODO: document", '"""..."""', "=====", "@param x\n@return", ":param x:\n:return:", "Args:\n x:\n y:\nReturns:", "@since 2.1", "2025-11-03", "v1.4", "noqa: E501", "eslint-disable-next-line no-unused-vars",
           "{@inheritDoc}", "See above.", "ditto", "Getter.", "SPDX-License-Identifier: MIT", "All rights reserved.", "return self.x()", "if a: b()", "import = find(import)", "loadRow(x, 12);", "readAllRows", "readAllRows()", "Reads all the rows.",
           "This function reads all rows", "read all row", "Function to read all rows.", "(String a, List<String> b)", "readAllRows(int a)", "<inheritdoc/>", "@see FooBar", "TODO later.", "READ ALL ROWS", "// ---\n// Undocumented"]
SOMETHING = ["Skips rows that were deleted.", "/**\n * Reads all rows in key order.\n */", "TODO later. Skips rows that were deleted.", "@internal Keeps order.", "@return the rows in key order", ":param x: the table to read",
             "eslint-disable-line. Skips deleted rows.", "Lit les lignes dans leur ordre.", "read all rows keeps the order of keys", "# Skips `parse_row` when empty.", "Licensed under the MIT licence. Skips deleted rows."]


@pytest.mark.parametrize("doc", NOTHING)
def test_says_nothing(doc):
    assert not P.says_something(doc, "readAllRows", "(int a)")


@pytest.mark.parametrize("doc", SOMETHING)
def test_says_something(doc):
    assert P.says_something(doc, "readAllRows", "(int a)")


@pytest.mark.parametrize(("lang", "text", "want"), [
    ("go", "package a\n\nfunc (x *T) Foo(a int) string {\n\treturn b()\n}\n\nfunc Bar[T any](q T) {\n}\n", [("Foo", "(a int) string", 3, 5), ("Bar", "(q T)", 7, 8)]),
    ("javascript", "class A {\n  async foo(a, b = 1) { return 1; }\n}\nexport function bar(x) {\n  return x\n}\nif (\n", [("foo", "(a, b = 1)", 2, 2), ("bar", "(x)", 4, 6)]),
    ("python", "class A:\n    def f(self, a: int) -> int:\n        return 1\n\n    x = (\n", [("f", "(self, a: int) -> int", 2, 3)]),
    ("python", "def f(:\n    pass\ndef g():\n    return 1\ndef h():\n    x = 'a\n", [("g", "()", 3, 4)]),
    ("java", "package a;\npublic class B { @Override public List<String> g(int a) { return x; }\n B(int q) {} void bad() { return 1 + ; } }", [("g", "(int a)", 2, 2), ("B", "(int q)", 3, 3)]),
    ("rust", "impl X { pub fn a<T: Z>(&self, b: &str) -> Vec<T> { b } }", [("a", "(&self, b: &str) -> Vec<T>", 1, 1)]),
    ("csharp", "class A { public async Task<int> F(int a) { return 1; } }", [("F", "(int a)", 1, 1)]),
])
def test_functions(lang, text, want):
    assert sorted(P.functions(text, lang), key=lambda r: (r[2], r[0])) == sorted(want, key=lambda r: (r[2], r[0]))


N = "id string, kind string, name string, file_path string, start_line int, docstring string, signature string, template string, says boolean"
D = "path string, text string, name string"


def test_operator_on_dirty_tables(spark):
    nodes = [("1", "function", "load", "/w/r/a.py", 1, "Reads rows in key order.", None, "x", False), ("1", "function", "load", "/w/r/a.py", 1, "Reads rows in key order.", None, "x", False), ("2", " Method", "load", "/w/r/a.py", 5, "Skips what was deleted.", "(a)", None, None),
             ("3", "class", "load", "/w/r/a.py", 1, "Says a lot about it.", None, None, None), ("4", "function", None, None, None, "Says something else entirely.", None, None, None), (None, "function", "q", "/w/r/a.py", 1, "Says a lot here.", None, None, None),
             ("5", "function", "gone", "/w/r/none.py", 3, "Counts all words of " + "very " * 50_000 + "long texts", None, None, None), ("6", "function", "p", "/w/r/a.py", None, "the alpha, the beta", None, None, None), ("7", "function", "p", "/w/r/a.py", 9, "   ", "", None, None)]
    docs = [("/w/r/a.py", "def load(a):\n    return 1\n\nclass B:\n    def load(self):\n        return 2\n\ndef p(alpha, beta):\n    pass\n", "n"), (None, "def x(): pass", None), ("/w/r/b.py", None, None), ("/w/r/c.py", "", "")]
    n, d = spark.createDataFrame(nodes, N), spark.createDataFrame(docs, D)
    assert {r[0] for r in P.found(n, d).collect()} == {"1", "2", "4", "5"}  # 6 names only the parameters that the text tells
    got = {r["node_id"]: r for r in P.pairs(n, d).collect()}
    assert set(got) == {"1", "2"} and got["1"]["code"] == "def load(a):\n    return 1" and got["2"]["code"].endswith("return 2") and got["1"]["signature"]
    assert P.found(n.limit(0), d).count() == 0 and P.found(n, d.limit(0)).count() == 5


def test_repeated_templates_are_stock(spark):
    rows = [(str(i), "function", f"alpha{chr(97 + i)}", "/w/r/a.py", i, f"Widget for alpha{chr(97 + i)} goes here", None, None, None) for i in range(9)] + [("z", "function", "z", "/w/r/a.py", 1, "Skips rows that were deleted.", None, None, None)]
    assert {r[0] for r in P.found(spark.createDataFrame(rows, N), spark.createDataFrame([], D)).collect()} == {"z"}
