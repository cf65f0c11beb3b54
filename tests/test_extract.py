import pytest

from arbora.extract import frameworks as W
from arbora.extract import imports as M
from arbora.extract import languages as L
from arbora.extract.comments import balanced, strip_comments
from arbora.extract.symbols import extract
from arbora.extract.templates import script_blocks


def names(rows, sort="node"):
    return {(r["kind"], r["name"]) for r in rows if r["sort"] == sort and r["kind"] != "file"}


def refs(rows):
    return {(r["reference_kind"], r["reference_name"]) for r in rows if r["sort"] == "ref"}


def test_strip_comments():
    src = 'a = "// no"; // yes\n/* b\n c */ d'
    out = strip_comments(src, "javascript")
    assert len(out) == len(src) and out.count("\n") == 2 and "// no" in out and "yes" not in out and out.endswith(" d")
    assert strip_comments("x # c\n'# s'", "python") == "x    \n'# s'"
    assert balanced('f(a, ")", (b))x', 1) == 14 and balanced("f(a", 1) == -1


@pytest.mark.parametrize(("path", "text", "nodes", "references"), [
    ("/a.py", "import os\nclass A(Base):\n    def f(self, x: int) -> int:\n        return g(x)\nLIMIT = 1\n", {("class", "A"), ("method", "f"), ("constant", "LIMIT")}, {("imports", "os"), ("extends", "Base"), ("calls", "g")}),
    ("/a.ts", "import { x } from './x';\nexport class A extends B implements C {\n  async run(a: number): void {\n    new D();\n    this.go(a);\n  }\n}\nexport function top(b) { return run(b); }\n",
     {("class", "A"), ("method", "run"), ("function", "top")}, {("imports", "./x"), ("extends", "B"), ("implements", "C"), ("instantiates", "D"), ("calls", "go"), ("calls", "run")}),
    ("/A.java", "package p;\nimport java.util.List;\npublic class A extends B {\n  public int f(int a) { return g(a); }\n}\n", {("class", "A"), ("method", "f")}, {("imports", "java.util.List"), ("extends", "B"), ("calls", "g")}),
    ("/a.go", 'package p\nimport "fmt"\ntype T struct {\n\tX int\n}\nfunc (t *T) Run(a int) string {\n\treturn fmt.Sprint(a)\n}\n', {("struct", "T"), ("function", "Run")}, {("imports", "fmt"), ("calls", "Sprint")}),
    ("/a.rs", "use std::io;\npub struct S { x: i32 }\nimpl Show for S {\n    pub fn go(&self) -> i32 { self.help() }\n}\n", {("struct", "S"), ("method", "go")}, {("imports", "std::io"), ("implements", "Show"), ("calls", "help")}),
    ("/A.cs", "using System;\npublic class A : IB {\n  public int F(int a) { return G(a); }\n}\n", {("class", "A"), ("method", "F")}, {("imports", "System"), ("implements", "IB"), ("calls", "G")}),
    ("/a.vue", "<template><user-card/></template>\n<script>import X from './x'\nfunction go(a) {}\n</script>", {("component", "a"), ("function", "go")}, {("imports", "./x"), ("renders", "UserCard")}),
    ("/a.liquid", "{% render 'card' %}{% assign x = 1 %}", {("variable", "x")}, {("references", "card")}),
    ("/P.razor", '@page "/p"\n@inject Svc s\n<Grid />\n@code { void Load(int a) { } }', {("component", "P"), ("route", "/p"), ("method", "Load")}, {("references", "Svc"), ("renders", "Grid")}),
    ("/f.dfm", "object F: TForm\n  object B: TButton\n    OnClick = Go\n  end\nend", {("component", "F"), ("component", "B")}, {("instantiates", "TForm"), ("instantiates", "TButton"), ("references", "Go")}),
])
def test_extract(path, text, nodes, references):
    out = extract(path, text)
    assert names(out) == nodes and refs(out) == references
    ids = {r["id"] for r in out if r["sort"] == "node"}
    assert all(r["source"] in ids and r["target"] in ids for r in out if r["sort"] == "edge")


SOUND = "import os\nclass A(Base):\n    'doc'\n    @deco\n    def f(self, x: int = 1) -> int:\n        \"\"\"of\n        f\"\"\"\n        if x:  # why\n            return g(x,\n                     h(x))\n        elif k(x):\n            pass\n    async def n(self): return m()\nLIMIT = 1\n"


@pytest.mark.parametrize("error", ["print 'x'\n", "x = (1,\n", "s = 'a\n", "x = )\n", "    y = 1\n", "<<<<<<< HEAD\n", "def (\n", "t = \"\"\"never closed\n"])
def test_a_syntax_error_costs_its_own_line(error):
    want = extract("/a.py", SOUND)[1:]
    after = extract("/a.py", SOUND + error)[1:]
    assert all(r in after for r in want)
    if error.startswith("t ="):  # it ends at the next such quotes, as in every lexer
        return
    before = extract("/a.py", error + SOUND)[1:]
    shift = lambda r: {k: v + 1 if k in ("start_line", "end_line", "line") else v for k, v in r.items() if k not in ("id", "source", "target")}
    got = [{k: v for k, v in r.items() if k not in ("id", "source", "target")} for r in before]
    assert all(r in got for r in map(shift, want))


def test_nested_definitions_of_a_broken_text():
    out = extract("/a.py", "class A:\n  def f(self):\n    def g(): pass\n    print 'x'\n  def h(self): pass\nclass B\n  pass\n")
    assert {(r["kind"], r["qualified_name"], r["start_line"], r["end_line"]) for r in out if r["sort"] == "node" and r["kind"] != "file"} == {
        ("class", "A", 1, 5), ("method", "A::f", 2, 4), ("function", "A::f::g", 3, 3), ("method", "A::h", 5, 5)}


def test_unreadable_gives_the_file():
    assert [r["kind"] for r in extract("/a.py", "def (")] == ["file"]
    assert [r["kind"] for r in extract("/a.unknown", "x")] == ["file"]
    assert script_blocks("a\n<script lang='ts'>x\n</script>") == [(2, "x\n")]


@pytest.mark.parametrize(("path", "text", "want"), [
    ("a.js", "app.get('/u/:id', auth, users.show);", ("GET", "/u/:id", "show", "express")),
    ("a.ts", "@Controller('cats') class C { @Get(':id') find(a) {} }", ("GET", "/cats/:id", "find", "nestjs")),
    ("a.py", "@app.route('/x', methods=['POST'])\ndef go(): pass", ("POST", "/x", "go", "flask")),
    ("a.py", "@r.get('/y')\nasync def y(): pass", ("GET", "/y", "y", "fastapi")),
    ("a.py", "urlpatterns = [path('a/', views.home)]", ("ANY", "/a", "home", "django")),
    ("r.rb", "  get '/a', to: 'users#show'", ("GET", "/a", "users#show", "rails")),
    ("A.java", '@RequestMapping("/api") public class A { @GetMapping("/x") public String x(int a) { } }', ("GET", "/x", "x", "spring")),
    ("A.java", '@RequestMapping("/api") public class A { @GetMapping("/x") public String x(int a) { } }', ("ANY", "/api", "x", "spring")),
    ("A.cs", 'app.MapHub<Chat.ChatHub>("/chat");', ("HUB", "/chat", "ChatHub", "aspnet")),
    ("a.ts", "class E { @MessagePattern('sum') add(x) {} }", ("MESSAGE", "sum", "add", "nestjs")),
    ("a.go", 'v := r.Group("/v1")\nv.GET("/p", h.Ping)', ("GET", "/v1/p", "Ping", "go")),
    ("a.php", "Route::post('/a', [AController::class, 'store']);", ("POST", "/a", "store", "laravel")),
    ("a.swift", 'app.get("a", "b", use: c.list)', ("GET", "/a/b", "list", "vapor")),
    ("A.cs", '[Route("api/[controller]")] public class UsersController { [HttpGet("[action]")] public int ListAll() { } }', ("GET", "/api/users/list-all", "ListAll", "aspnet")),
    ("pages/blog/[id].tsx", "", ("GET", "/blog/:id", "default", "files")),
])
def test_routes(path, text, want):
    assert want in [r[1:] for r in W.routes(path, text)]


def test_path_algebra():
    assert W.join_prefix("/a/", "", "b") == "/a/b" and W.compose_nested("/a", "") == "/a" and W.compose_nested("/a", "/b") == "/b" and W.compose_nested("/a", "b") == "/a/b"
    assert W.file_route("docs/[...rest].vue") == "/docs/*rest" and W.file_route("[[lang]]/index.vue") == "/:lang?"
    assert W.group_prefixes('var a = app.MapGroup("/x"); var b = a.MapGroup("y");', r'(?:var|\w+)\s+(?P<var>\w+)\s*=\s*(?P<parent>\w+)\.MapGroup\("(?P<sub>[^"]*)"')["b"] == "/x/y"
    assert W.di_bindings("s.AddScoped<IFoo, Foo>();") == [("IFoo", "Foo")]


def test_aliases():
    a = M.path_aliases('{ // c\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "@lib/x/*": ["lib/*"],}} }')
    assert [k for k, _ in a] == ["@lib/x/*", "@/*"] and M.apply_alias("@lib/x/q", a) == ["src/lib/q"] and M.apply_alias("z", a) == []


def test_probe_and_scan(spark, tmp_path):
    i = spark.createDataFrame([("/w/a/b.ts", "./c"), ("/w/a/b.ts", "../d"), ("/w/a/b.ts", "lib")], "path string, module string")
    p = spark.createDataFrame([("/w/a/c.js",), ("/w/a/c.ts",), ("/w/d/index.ts",)], "path string")
    assert {tuple(r) for r in M.probe(i, p).collect()} == {("/w/a/b.ts", "./c", "/w/a/c.ts"), ("/w/a/b.ts", "../d", "/w/d/index.ts")}
    for name, data in {"a.py": b"\xef\xbb\xbfx = 1\r\n", "b.bin": b"x", "node_modules/c.js": b"x", ".git/d.py": b"x", "bad.py": b"\xff\xfe\xfa", "gen/e.ts": b"x"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(data)
    rows = L.scan_source_tree(spark, str(tmp_path), ("gen/*",)).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["language"], r["text"]) for r in rows] == [("a.py", "python", "x = 1\r\n")]


def test_nested_route_tables():
    text = """const routes: Routes = [
      { path: '', redirectTo: 'home' },
      { path: 'users', component: UsersComponent, canActivate: [AuthGuard], children: [{ path: ':id', component: UserComponent }, { path: '/abs', loadComponent: () => import('./x').then(m => m.Lazy) }] },
    ];"""
    assert [r[1:] for r in W.route_tables(text)] == [("/users", "UsersComponent", ["AuthGuard"]), ("/users/:id", "UserComponent", []), ("/abs", "Lazy", [])]


def test_declarations():
    ng = "@Component({ selector: 'a-b' })\nexport class AComponent { constructor(private s: UserService, @Inject(X) t: Token) {} z = inject(Store); }"
    assert W.declarations("a.ts", ng) == [(1, "component", "AComponent", "angular")] and W.injected(ng) == ["UserService", "Token", "Store"]
    assert ("component", "Card", "react") in [r[1:] for r in W.declarations("a.tsx", "export function Card(p) { return <div/>; }\nconst useX = () => 1;")]
    assert [r[2] for r in W.declarations("src/routes/(app)/blog/[slug]/+server.ts", "export async function GET() {}")] == ["/blog/:slug", "GET /blog/:slug"]
    assert W.page_route("server/api/users/[id].get.ts") == "/api/users/:id" and W.page_route("src/a.ts") is None
    assert W.workspace_members('[workspace]\nmembers = ["a", "b/*"]\n[dependencies]\nx = { path = "../x" }\ny = "1"') == (["a", "b/*"], [("x", "../x")])


def test_single_edit():
    from arbora.extract.comments import single_edit

    base = "line\n" * 50
    assert single_edit(base, base.replace("line\n", "line\n", 1)[:100] + "X" + base[100:]) == (100, 100, 101)
    assert single_edit(base, "other") is None and single_edit(base, base) == (250, 250, 250)
