import itertools

import pytest

from arbora.llm import edits, gll, syntax
from arbora.llm.chart import Grammar, accepts, ends, least_edits

G = Grammar("""
s = e ';'?
e = t (op t)*
op = '+' | '*'
t = ID | P:args | t P:args
""")
ALPHABET = ["ID", "+", ";", "P:args"]


def tokens(*kinds):
    return [frozenset([k]) for k in kinds]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_chart_against_brute_force():
    language = [w for n in range(1, 6) for w in itertools.product(ALPHABET, repeat=n) if accepts(G, "s", tokens(*w))]
    for n in range(4):
        for w in itertools.product(ALPHABET, repeat=n):
            want = min(distance(w, x) for x in language)
            assert least_edits(G, "s", tokens(*w), 3) == (want if want <= 3 else None), w


def test_gll_agrees_with_the_chart():
    left = Grammar("a = a 'x' | a a | 'y'")
    for g, start, alphabet in ((G, "s", ALPHABET), (left, "a", ["=x", "=y"])):
        for n in range(6 if start == "a" else 5):
            for w in itertools.product(alphabet, repeat=n):
                assert gll.recognises(g, start, tokens(*w)) == accepts(g, start, tokens(*w)), w


VALID = {
    "python": ["", "x = 1\n", "@d(1)\nasync def f(a, *b, c: int = 2, **k) -> int:\n    '''d'''\n    if a and not b: return [i for i in c if i]\n    elif x:\n        pass\n    else:\n        y = {**a, 'k': 1}\n",
               "try:\n    x[1:2, ::3] += lambda q=1: q\nexcept (A, B) as e:\n    raise X from e\nfinally:\n\tprint(f'{x!r}')\n", "match x:\n    case [1, *r] if r: pass\n    case A(b=1) | None: pass\nwith a as b, c: pass\n", "print(match, case)\n", "x = (\n  1,\n\n  2)\nclass A(B, m=C): x: int\n", "s = '''<<<<<<< HEAD\n=======\n'''\n# {(\n"],
    "javascript": ["", "import a, { b as c } from 'x';\nexport default class A extends B { #p = 1; static async *g(a, {b, ...c} = {}) { yield* a?.b?.[1] ?? c; } get x() { return 1 } }\n", "const f = async (a, [b]) => { for (const [k, v] of m) { if (/[/]\\/x/g.test(k)) continue; else break; } };\nlet t = `a ${b ? `c` : {d: 1}.d} e`\nfoo()\nbar?.()\n",
                   "label: for (let i = 0, j = 1; i < j; i++) { switch (i) { case 1: { x } default: y() } }\ntry { throw new E(1) } catch { } finally { }\nvar o = { a, 'b': 1, [c]: 2, d() { }, async e() { }, get f() { return 1 }, ...g, };\n", "!function(a){a[0]===1&&b()}(c);a=b?c:d,e=f\n", "// open { (\nx = '<<<<<<< HEAD';\n"],
    "typescript": ["interface A<T extends B = C> extends D { readonly x?: Map<string, number[]>; f(a: number, ...b: T[]): void; [k: string]: any }\n", "export abstract class A<T> implements B, C { constructor(private readonly a: string, public b?: number) { super() } private async f<U>(x: U): Promise<U[]> { return x as unknown as U[]; } abstract g(): void; }\n",
                   "type F = (a: string) => x is number; enum E { A = 1, B }\nconst y = <T,>(a: T): T => a;\nfunction f(this: X, a?: string): asserts a is string;\nlet z = a! as const; declare module 'x' { }\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(x = 1) public abstract class T<U extends V & W> extends X<U> implements Y {\n private static final int[] A = {1, 2}, B[] = new int[3][];\n static { int x = 0; }\n public <Q> List<? super Q> f(final int a, String... b) throws E { for (var x : y) if (x instanceof String s && !s.isEmpty()) return (List<Q>) z; else continue; try (var r = o(); r2) { } catch (A | B e) { throw e; } Runnable q = () -> { }; int t = a > 1 ? b[0]++ : -c; this.<Q>g(String[]::new); return switch (a) { case 1, 2 -> 3; default -> { yield 4; } }; }\n}\ninterface I { default void g() { } int h(); }\nenum E { A(1) { void f() { } }, B; int x; }\nrecord R(int a) { }\n"],
    "csharp": ["using A.B;\nnamespace N {\n [Attr(1)] public sealed class C<T> : B, I where T : class, new() {\n  public int X { get; private set; } = 1;\n  private readonly Dictionary<string, List<int>> d = new();\n  public async Task<T?> F(int a, out string b, params int[] c) { foreach (var x in y) { if (x is not null && x is string s) { await G(a: 1, out var q); } } var z = from; return a switch { 1 => null, _ => throw new E($\"{a}\") }; }\n  public int P => x ?? 1; public C(int a) : base(a) { } public static bool operator ==(C<T> a, C<T> b) => true; int this[int i] => i;\n } enum E { A = 1, B, } }\n", "namespace X;\nrecord P(int A);\n#region r\nclass Q { string s = @\"a\"\"b\"; }\n#endregion\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tF(a int, b ...string) (int, error)\n}\n\nfunc (t *T[K]) F(a, b int) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x := f(); x {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tgo func() { c <- 1 }()\n\t}\n\tfor range y {\n\t}\n\tswitch z := q.(type) {\n\tcase int, []string:\n\t\tbreak\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\tw = v\n\t}\n\tk := map[string][]T{\"a\": {{1}, {2}}}\n\tvar s = []int{1, 2}[1:]\n\tdefer close(k)\n\treturn\n}\n\nconst (\n\tA = iota\n\tB\n)\n"],
    "rust": ["#![allow(x)]\nuse a::{b, c::*};\npub struct S<'a, T: Clone + 'a> { pub x: &'a [T; 3], }\nimpl<'a, T> Tr for S<'a, T> where T: Clone {\n    pub async fn f(&mut self, (a, b): (i32, u8)) -> Result<Vec<T>, Box<dyn E>> {\n        let Some(x) = y else { return Err(z?) };\n        match q { A::B { c, .. } | D(1..=3) if c > 1 => { 1 } _ => 2, }\n        for i in 0..10 { if let Some(v) = m.get(&i) { v.push(1); } }\n        let c = |a: i32, b| a + b;\n        vec![1, 2].iter().map(|x| x as u64).collect::<Vec<_>>();\n        'l: loop { break 'l; }\n        Ok(x)\n    }\n}\nenum E { A, B(i32), C { x: u8 } }\nmacro_rules! m { ($x:expr) => { $x }; }\nconst A: &str = r#\"a\"b\"#;\n"],
}
BROKEN = {
    "python": ["def f(:\n  pass\n", "if x\n    y = 1\n", "x = (1\n", "if x:\n    else\n        y\n", "  x = 1\n", "print 'a'\n", "<<<<<<< HEAD\nx = 1\n", "x = 'a\n", "try:\n    x = 1\ny = 2\n", "def f():\n", "x = \x01\n", "a = b c\n"],
    "javascript": ["function f( {", "let x: number = 1;", "const a = ;", "import { a } from ;", '{"a": 1, "b": 2}', "x = 'a\n';", "if (a { }", "class A { int x; }", "a b c;", "<<<<<<< HEAD\n", "return [", "var x = @@;"],
    "typescript": ["public class A { }", "let x: = 1;", "interface A { x y }", "const f = (a: string => a;", "package a\n"],
    "java": ["class A { int f() { return 1 } }", "class A { void f( { } }", "def x():\n", "class A { int = 1; }", "package a\n", "class A { void f() { foo() bar(); } }"],
    "csharp": ["class A { int F() { return 1 } }", "using A.B\nclass C { }", '{"a": 1}', "class A { void F() { if x { } } }"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "using A;\n", "package a\nfunc f() {\n\tif (x {\n\t}\n}\n", "package a\nx = 1\n", "public class A { }\n"],
    "rust": ["fn f() -> { }", "fn f() { let x = ; }", "fn f() { let x = 1 let y = 2; }", "class A { }", "struct S { x i32 }", "fn f() { a(1; }"],
}


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(lang, text):
    assert syntax.parser(lang).check(text) == [], text


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken(lang, text):
    cost, exact, kind, line = syntax.judge(text, lang)
    assert cost > 0 and kind and line > 0


NAMES = [f"N{i}" for i in range(30)]


@pytest.mark.parametrize(("lang", "text"), [
    ("java", "enum E { " + ", ".join(NAMES) + " }\n"),
    ("java", "enum E { " + ", ".join(f"{n}({i})" for i, n in enumerate(NAMES)) + " }\n"),
    ("go", "package a\n\ntype I interface {\n" + "".join(f"\t{n}\n" for n in NAMES) + "}\n"),
    ("go", "package a\n\ntype S struct {\n" + "".join(f"\tp.{n}\n" for n in NAMES) + "}\n"),
    ("go", "package a\n\ntype I interface {\n" + "".join(f"\t{n}()\n" for n in NAMES) + "}\n"),
])
def test_long_bodies_keep_every_reading(lang, text):
    assert syntax.judge(text, lang)[0] == 0


@pytest.mark.parametrize(("lang", "text"), [
    ("javascript", "".join(f"export * from './m{i}'\n" for i in range(300))),
    ("typescript", "type T =\n" + "".join(f"  | 'a{i}'\n" for i in range(40)) + "const x = 1\n"),
    ("javascript", "const x = a\n" + "".join(f"  .f{i}(1)\n" for i in range(200)) + "let y = 2\nz()\n"),
])
def test_line_ends_serve_at_every_length(lang, text):
    assert syntax.judge(text, lang)[0] == 0
    assert syntax.judge(text + "let = = 1\n", lang)[0] > 0


def test_prefixes_against_the_chart():
    for n in range(6):
        for w in itertools.product(ALPHABET, repeat=n):
            t = tokens(*w)
            for begin in range(n + 1):
                assert set(ends(G, "s", t, begin)) == {e for e in range(begin, n + 1) if accepts(G, "s", t[begin:e])}


def test_costs_do_not_hang_on_earlier_texts():
    lines = [f"x = a {'+ b ' * i}c d\n" for i in range(1, 10)]
    text = "".join(lines)
    alone = sum(f.cost for f in syntax.Parser(syntax.language("python")).check(text))
    p = syntax.Parser(syntax.language("python"))
    for line in lines:
        p.check(line)
    assert sum(f.cost for f in p.check(text)) == alone


@pytest.mark.parametrize(("lang", "text", "cost"), [
    ("python", "x = f(a, b\n", 1), ("python", "x = a " + "+ b " * 30 + "c d e\n", 2), ("python", "x = a b c d e\n", 2), ("javascript", "let = = 1;\nlet a b c;\nf(1));\n", 3), ("java", "class A { int f( { return 1; } }\n", 2),
    ("javascript", "const x = a\n" + "".join(f"  .f{i}(1)\n" for i in range(60)) + "let y = 2\nz()\nlet = = 1\n" + "z()\n" * 50, 1),
    ("go", "package a\n\nfunc f() {\n\tx := := 1\n\ty = 2 3 4\n}\n", 2),
])
def test_costs(lang, text, cost):
    assert syntax.judge(text, lang)[:2] == (cost, True) and not syntax.valid(text, lang)


def test_costs_beyond_the_budget_are_marked():
    assert syntax.judge("a " * 20 + "\n", "python")[:2] == (syntax.BUDGET + 1, False)
    assert syntax.judge("a " * 5000 + "\n", "python")[:2] == (syntax.BUDGET + 1, False)


def test_kinds_of_fault():
    body = "".join(f"def f{i}(a):\n    return a + {i}\n\n" for i in range(12))
    assert syntax.judge(body + "def g(a):\n    return [", "python")[2] == "truncation"
    assert syntax.judge(body + "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n" + body, "python")[2] == "conflict"
    assert syntax.judge("package a\n\nimport \"b\"\n\nfunc F() int {\n\treturn 1\n}\n", "python")[2] == "mismatch"


D, F = "path string, text string, is_excerpt boolean, cost int", "path string, language string, errors array<string>"


def test_operator_on_dirty_tables(spark):
    docs = [("/w/r/a.py", "x = (", False, 1), ("/w/r/a.py", "x = (", False, 1), ("/w/r/b.py", "x = 1", None, None), ("/w/r/c.py", "x = (", True, 0), ("/w/r/d.py", None, False, 0), ("/w/r/e.py", "", False, 0),
            (None, "x = (", False, 0), ("/w/r/f.txt", "x = (", False, 0), ("/w/r/g.py", "x = (", False, 0), ("/w/q/h.JS", "a b", False, 0), ("/w/r/long.py", "x = 1\n" * 40_000 + "y = [" + "1, " * 40_000 + "]\n", False, 0), ("/w/r/l2.js", "a " * 40_000, False, 0)]
    files = [(p, "Python", ["note"]) for p in ("/w/r/a.py", "/w/r/a.py", "/w/r/b.py", "/w/r/c.py", "/w/r/d.py", "/w/r/e.py", "/w/r/f.txt", "/w/q/h.JS", "/w/r/long.py", "/w/r/l2.js")] + [(None, None, None)]
    d, f = spark.createDataFrame(docs, D), spark.createDataFrame(files, F)
    assert {r["path"] for r in syntax.found(d, f).collect()} == {"/w/r/a.py", "/w/q/h.JS", "/w/r/l2.js"}
    got = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"]) for r in syntax.rates(d, f).collect()}
    assert got == {("r", "python"): (4, 1), ("q", "javascript"): (1, 1), ("r", "javascript"): (1, 1)}
    assert syntax.found(d.limit(0), f).count() == 0 and syntax.found(d, f.limit(0)).count() == 0


NESTED = [
    (Grammar("a = 'x' a 'y' | 'z' a? | a 'w' a 'x' | b 'x'\nb = 'y' a? 'z' | b 'y' c\nc = | 'w' c 'z'"), ["=x", "=y", "=z", "=w"]),
    (Grammar("a = ID ( '?' a ':' a | '<' a '>' )?"), ["ID", "?", ":", "<", ">"]),
]


@pytest.mark.parametrize("number", [0, 1])
def test_edits_without_a_budget_against_brute_force(number):
    g, alphabet = NESTED[number]
    language = [w for n in range(1, 7) for w in itertools.product(alphabet, repeat=n) if accepts(g, "a", tokens(*w))]
    nets = edits.Networks(g)
    for n in range(4):
        for w in itertools.product(alphabet, repeat=n):
            assert nets.least_edits("a", tokens(*w)) == min(distance(w, x) for x in language), w


def test_prices_change_no_number():
    g, alphabet = NESTED[1]
    nets = edits.Networks(g)
    for w in itertools.product(alphabet, repeat=4):
        want, net = nets.least_edits("a", tokens(*w)), nets.made["a"]
        for price in (-8, -3, 5, 8):
            bound = edits._Bound(net, dict.fromkeys(net.entered if price < 0 else net.left, price))
            marks = bound.marks(tokens(*w))
            assert marks[0][net.start] <= want * edits._UNIT and net._search(tokens(*w), bound, marks, None) == want


def test_least_edits_where_readings_meet():
    # ID, ID > ID: two tokens exchanged
    assert syntax.parser("javascript").repair_cost("case", ("<=", ",", "ID", ">", "=")) == 2
    assert syntax.judge("fn f() { a b c + d }", "rust")[0] == 1


@pytest.mark.parametrize(("lang", "text", "cost"), [
    ("python", "a " * 20 + "\n", 10), ("python", "a " * 5000 + "\n", 2500), ("python", "x = a " + "+ b " * 300 + "c\n", 1), ("python", "x = a " + "+ b c d " * 8 + "\n", 8),
    ("javascript", "let x = a " + "+ b " * 300 + "c;\n", 1), ("java", "class A { int x = a " + "+ b " * 200 + "c d; }\n", 1),
])
def test_costs_of_long_units_and_many_edits(lang, text, cost):
    assert syntax.judge(text, lang, None)[:2] == (cost, True)


def test_judged_counts_every_edit(spark):
    docs = [("/w/r/a.py", "a " * 20, False, 0), ("/w/r/b.py", "x = a " + "+ b " * 300 + "c\n", False, 0), ("/w/r/c.py", "x = 1\n", False, 0)]
    files = [(p, "Python", ["note"]) for p, *_ in docs]
    got = {r["path"]: (r["cost"], r["exact"]) for r in syntax.judged(spark.createDataFrame(docs, D), spark.createDataFrame(files, F)).collect()}
    assert got == {"/w/r/a.py": (10, True), "/w/r/b.py": (1, True), "/w/r/c.py": (0, True)}
