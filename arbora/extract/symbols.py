"""The table function from source texts to nodes, contains edges and references.

Python is read through its own syntax tree, and logical line by logical line where the whole is no valid Python, so
that an error costs its own line only; the other languages by a scan of comment-free text that follows
their declaration words and matches brackets (lower fidelity than a full parser, and it says so).  A file
that cannot be read still gives its file node.  One row in, many rows out, so it runs as ``mapInPandas``.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import inspect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from arbora.extract.comments import balanced, strip_comments
from arbora.extract.languages import language_of
from arbora.functions.batches import slices
from arbora.session import spread

NODES = ("id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, "
         "is_exported boolean, is_async boolean")
ROWS = f"sort string, {NODES}, source string, target string, reference_name string, reference_kind string, line int"
_COLS = [c.split()[0] for c in ROWS.split(", ")]
_CALL = re.compile(r"(?:\b(new)\s+)?([A-Za-z_$][\w$]*(?:\s*(?:\.|::)\s*[A-Za-z_$][\w$]*)*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function func fn def class match foreach using lock sizeof typeof nameof super constructor elif and or not in with assert print await throw".split())
_IMPORT = {
    "javascript": r"""(?m)^\s*(?:import|export)\b[^;'"`]*?\bfrom\s*['"]([^'"]+)['"]|^\s*import\s*['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)""",
    "go": r'(?m)^\s*import\s+(?:\w+\s+)?"([^"]+)"|^\s+(?:[\w.]+\s+)?"([\w./-]+)"\s*$', "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "csharp": r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "php": r"(?m)^\s*use\s+([\w\\]+)", "ruby": r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "c": r'(?m)^\s*#\s*include\s*[<"]([^>"]+)',
    "swift": r"(?m)^\s*import\s+(\w+)", "kotlin": r"(?m)^\s*import\s+([\w.]+)", "scala": r"(?m)^\s*import\s+([\w.]+)", "dart": r"(?m)^\s*import\s+['\"]([^'\"]+)",
}
_IMPORT |= {"typescript": _IMPORT["javascript"], "cpp": _IMPORT["c"]}
_TYPE_WORD = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "protocol": "interface", "record": "class", "object": "class", "namespace": "namespace",
              "module": "module", "mod": "module", "extension": "class", "mixin": "class", "union": "struct"}
_TYPE = re.compile(r"\b(class|interface|struct|enum|trait|protocol|record|object|namespace|module|mod|extension|mixin|union)\s+([A-Za-z_][\w.]*)([^{};()]*(?:\([^{}]*\))?[^{};]*)\{")
_FUNC = {
    "javascript": r"\b(?:function\s*\*?\s*([A-Za-z_$][\w$]*)|(?<![.\w$])(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+|readonly\s+)*([A-Za-z_$][\w$]*)(?:<[^<>()]*>)?)\s*(?=\([^;{}]*\)\s*(?::\s*[^;{}=]+?)?\s*\{)",
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)()(?:\[[^\]]*\])?\s*(?=\()", "rust": r"\bfn\s+([A-Za-z_]\w*)()(?:<[^()]*>)?\s*(?=\()", "swift": r"\bfunc\s+([A-Za-z_]\w*)()(?:<[^()]*>)?\s*(?=\()",
    "kotlin": r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?([A-Za-z_]\w*)()\s*(?=\()", "scala": r"\bdef\s+([A-Za-z_]\w*)()(?:\[[^\]]*\])?\s*(?=\()", "php": r"\bfunction\s+&?([A-Za-z_]\w*)()\s*(?=\()",
    "lua": r"\bfunction\s+(?:[\w.]+[.:])?([A-Za-z_]\w*)()\s*(?=\()", "ruby": r"\bdef\s+(?:self\.)?([A-Za-z_]\w*[?!]?)()",
    "java": r"(?:\b[\w<>\[\],.?]+\s+)()([A-Za-z_]\w*)\s*(?=\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?(?:const\s*|override\s*|noexcept\s*)*(?:where[^{]*)?\{)",
}
_FUNC |= {"typescript": _FUNC["javascript"], "csharp": _FUNC["java"], "c": _FUNC["java"], "cpp": _FUNC["java"], "dart": _FUNC["java"], "luau": _FUNC["lua"]}


def node_id(path: str, kind: str, name: str, line: int) -> str:
    return f"file:{path}" if kind == "file" else hashlib.sha256(f"{path}:{kind}:{name}:{line}".encode()).hexdigest()[:16]


class Rows:
    """Collects the rows of one file."""

    def __init__(self, path: str, language: str, lines: int):
        self.path, self.language, self.rows = path, language, []
        self.file = self.node("file", path.rsplit("/", 1)[-1], path, 1, max(1, lines), None)

    def node(self, kind: str, name: str, qualified: str, start: int, end: int, parent: str | None, doc: str | None = None, signature: str | None = None, exported: bool = False, is_async: bool = False) -> str:
        key = node_id(self.path, kind, name, start)
        self.rows.append({"sort": "node", "id": key, "kind": kind, "name": name, "qualified_name": qualified, "file_path": self.path, "language": self.language, "start_line": start, "end_line": end,
                          "docstring": doc or None, "signature": signature, "is_exported": exported, "is_async": is_async})
        if parent:
            self.rows.append({"sort": "edge", "source": parent, "target": key, "kind": "contains", "line": start})
        return key

    def ref(self, source: str, name: str, kind: str, line: int) -> None:
        self.rows.append({"sort": "ref", "source": source, "reference_name": name, "reference_kind": kind, "line": line, "file_path": self.path, "language": self.language})


def _python(text: str, out: Rows) -> None:
    _walk(ast.parse(text).body, out, out.file, [], False)


def _walk(body: list[ast.stmt], out: Rows, parent: str, scope: list[str], in_class: bool, shift: int = 0, top: bool = True) -> str | None:
    """The rows of statements, ``shift`` lines further down in the file; the id of the last definition."""
    key = None
    for s in body:
        line, end = s.lineno + shift, (s.end_lineno or s.lineno) + shift
        if isinstance(s, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            kind = "class" if isinstance(s, ast.ClassDef) else "method" if in_class else "function"
            signature = None if kind == "class" else f"({ast.unparse(s.args)})" + (f" -> {ast.unparse(s.returns)}" if s.returns else "")
            key = out.node(kind, s.name, "::".join([*scope, s.name]), line, end, parent, ast.get_docstring(s), signature, not s.name.startswith("_"), isinstance(s, ast.AsyncFunctionDef))
            if isinstance(s, ast.ClassDef):
                for b in s.bases:
                    out.ref(key, ast.unparse(b).split("[")[0], "extends", line)
            _walk(s.body, out, key, [*scope, s.name], isinstance(s, ast.ClassDef), shift)
            continue
        if isinstance(s, ast.Import | ast.ImportFrom):
            for name in [s.module or "."] if isinstance(s, ast.ImportFrom) else [a.name for a in s.names]:
                out.ref(parent, name, "imports", line)
        elif isinstance(s, ast.Assign) and parent == out.file and top:
            for t in s.targets:
                if isinstance(t, ast.Name):
                    out.node("constant" if t.id.isupper() else "variable", t.id, t.id, line, end, parent)
        for x in ast.walk(s):
            if isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else None
                if name:
                    out.ref(parent, name, "calls", x.lineno + shift)
    return key


_PY_TOKEN = re.compile(r"""(?P<skip>\#[^\n]*|\\\n)|(?P<str>\"{3}(?:\\[\s\S]|[^\\])*?\"{3}|'{3}(?:\\[\s\S]|[^\\])*?'{3}|(?!\"{3}|'{3})(?:"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'))|"""
                       r"""(?P<lost>\"{3}|'{3})|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<nl>\n)|(?P<word>\w+)|(?P<rest>[^\s])""")
#: Words that begin a line and never stand first in a line inside brackets: a bracket before them has lost its end.
_PY_LINE = re.compile(r"[ \t]*(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(|class[ \t]+\w+[ \t]*[(:]|(?:return|import|while|try|raise|with|pass|del|global|assert|break|continue)\b(?![ \t]*[=,.)]))")
#: What makes a head that cannot stand alone a whole statement: (before it, after it).
_PY_HEADS = {"elif": ("if 0: pass\n", " pass"), "except": ("try: pass\n", " pass"), "case": ("match 0:\n ", " pass"), "match": ("", "\n case _: pass")}


def _logical_lines(text: str) -> Iterator[tuple[int, int, int]]:
    """(indent, start, end) of each logical line; what was never closed ends before the next line that must be one."""
    pos, start, stop, depth = 0, -1, 0, 0
    indent = lambda at: len(text[text.rfind("\n", 0, at) + 1 : at].expandtabs(8))
    while m := _PY_TOKEN.search(text, pos):
        pos, sort = m.end(), m.lastgroup
        if sort == "skip":
            continue
        if sort == "nl":
            if start >= 0 and (not depth or _PY_LINE.match(text, pos)):
                yield indent(start), start, stop
                start, depth = -1, 0
            continue
        if start < 0:
            start = m.start()
        if sort == "lost":  # a text in quotes without an end: up to the next definition that stands no deeper
            most = indent(start)
            at = pos
            while (at := text.find("\n", at)) >= 0:
                at += 1
                d = _PY_LINE.match(text, at)
                if d and d[0].rstrip().endswith(("(", ":")) and len(d[0].expandtabs(8)) - len(d[0].expandtabs(8).lstrip()) <= most:
                    break
            pos = len(text) if at < 0 else at - 1
            depth = 0
        elif sort == "open":
            depth += 1
        elif sort == "close":
            depth = max(0, depth - 1)
        stop = pos
    if start >= 0:
        yield indent(start), start, stop


def _python_lines(text: str, out: Rows) -> None:
    """Rows of a text that is no valid Python as a whole: each logical line is parsed by itself."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    breaks = [m.start() for m in re.finditer("\n", text)]
    # Blocks that are open: indent, row of the definition, id, scope, whether it is a class, whether its body has begun.
    blocks: list[list] = []
    for indent, start, end in _logical_lines(text):
        first, last = bisect.bisect_left(breaks, start), bisect.bisect_left(breaks, end - 1) + 1
        while blocks and indent <= blocks[-1][0]:
            blocks.pop()
        for b in blocks:
            if b[1] is not None:
                b[1]["end_line"] = last
        parent, scope, in_class = blocks[-1][2:5] if blocks else (out.file, [], False)
        code = text[start:end]
        word = re.match(r"\w*", code)[0]
        head = code.endswith(":") and word not in ("lambda", "")
        before, after = _PY_HEADS.get(word, ("", " pass")) if head else (_PY_HEADS[word][0] if word in ("elif", "except", "case") else "", "")
        k, key = len(out.rows), None
        try:
            if head and word in ("try", "else", "finally") or word == "" and code.startswith("@"):
                body = []
            else:
                body = ast.parse(before + code + after).body
            key = _walk(body, out, parent, scope, in_class, first - before.count("\n"), not blocks)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            del out.rows[k:]
            body = []
        if blocks and not blocks[-1][5]:
            blocks[-1][5] = True
            if blocks[-1][1] is not None and len(body) == 1 and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
                blocks[-1][1]["docstring"] = inspect.cleandoc(body[0].value.value) or None
        if head:
            if key is not None:
                row = out.rows[k]
                blocks.append([indent, row, key, [*scope, row["name"]], row["kind"] == "class", False])
            else:  # a branch belongs to its surroundings; so does the body of a head that cannot be read
                blocks.append([indent, None, parent, scope, in_class and word not in ("def", "async", "class"), False])


def _braces(text: str, language: str, out: Rows) -> None:
    clean = strip_comments(text, language)
    plain = re.sub(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\[\s\S]|[^`\\])*`', lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], clean)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    rows = text.split("\n")

    def doc_above(first: int) -> str | None:
        got = []
        for i in range(first - 2, -1, -1):
            s = rows[i].strip()
            if not s.startswith(("//", "/*", "*", "#", "@", "[")):
                break
            if not s.startswith(("@", "[")):
                got.append(re.sub(r"^(?://+!?|/\*+|\*+/?|#+)\s?|\s*\*+/$", "", s))
        return "\n".join(reversed(got)).strip() or None

    declared: set[int] = set()  # where the names of functions end
    spans: list[tuple[int, int, str, str, str]] = []  # start, end, kind, name, extra
    for m in _TYPE.finditer(plain):
        end = balanced(plain, m.end() - 1)
        spans.append((m.start(), end if end > 0 else len(text), _TYPE_WORD[m[1]], m[2], m[3]))
    for m in re.finditer(r"\btype\s+(\w+)\s+(struct|interface)\s*\{", plain):
        end = balanced(plain, m.end() - 1)
        spans.append((m.start(), end if end > 0 else len(text), m[2], m[1], ""))
    for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+(?:([\w:<>]+)\s+for\s+)?(\w+)[^{;]*\{", plain) if language == "rust" else ():
        end = balanced(plain, m.end() - 1)
        spans.append((m.start(), end if end > 0 else len(text), "impl", m[2], m[1] or ""))
    for m in re.finditer(_FUNC.get(language, _FUNC["java"]), plain):
        name = m[1] or m[2]
        if not name or name in _NOT_CALLS:
            continue
        declared.add(m.end(1) if m[1] else m.end(2))
        at = plain.find("(", m.end())
        close = balanced(plain, at) if at >= 0 else -1
        brace = plain.find("{", close) if close > 0 else -1
        if close < 0 or (brace >= 0 and ";" in plain[close:brace]):
            brace = -1
        end = balanced(plain, brace) if brace >= 0 else close
        spans.append((m.start() + len(m[0]) - len(m[0].lstrip()), end if end and end > 0 else len(text), "function", name, text[at:close] if close > 0 else ""))
    owners: list[tuple[int, int, str, str, str]] = []
    around: list[tuple[int, int, str, str, str]] = []  # those that have not ended
    types: dict[str, str] = {}  # the first struct or enum of a name
    for start, end, kind, name, extra in sorted(spans, key=lambda s: (s[0], -s[1])):
        while around and around[-1][1] <= start:
            around.pop()
        parent, scope, owner = next((o[2:] for o in reversed(around) if end <= o[1]), (out.file, "", "file"))
        if kind == "impl":
            key = types.get(name, out.file)
            if extra:
                out.ref(key, extra.split("<")[0], "implements", line(start))
            owners.append((start, end, key, name, "struct"))
            around.append(owners[-1])
            types.setdefault(name, key)
            continue
        if kind == "function":
            kind = "method" if owner in ("class", "struct", "interface", "trait", "enum") else "function"
        qualified = f"{scope}::{name}" if scope else name
        head = rows[line(start) - 1]
        key = out.node(kind, name, qualified, line(start), line(max(start, end - 1)), parent, doc_above(line(start)), " ".join(extra.split()) if kind in ("function", "method") else None,
                       bool(re.search(r"\b(?:export|pub|public)\b", head)) or (language == "go" and name[:1].isupper()), "async" in head)
        if kind in ("class", "interface", "struct", "trait", "enum"):
            for word, edge in ((r"\bextends\s+([\w.<>, ]+?)(?=\bimplements\b|\bpermits\b|$)", "extends"), (r"\bimplements\s+([\w.<>, ]+)", "implements"), (r"^\s*(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*:\s*([\w.<>, :]+)", "implements")):
                for m in re.finditer(word, extra):
                    for base in re.sub(r"<[^<>]*>", "", m[1]).split(","):
                        if base.strip():
                            out.ref(key, base.replace("public", "").strip().split(" ")[-1], edge, line(start))
        owners.append((start, end, key, qualified, kind))
        around.append(owners[-1])
        if kind in ("struct", "enum"):
            types.setdefault(name, key)
    for m in re.finditer(_IMPORT.get(language, r"(?!)"), clean):
        out.ref(out.file, next(g for g in m.groups() if g), "imports", line(m.start()))
    open_owners: list[tuple[int, int, str, str, str]] = []
    coming = sorted(owners, key=lambda o: (o[0], -o[1]), reverse=True)
    for m in _CALL.finditer(plain):
        while coming and coming[-1][0] <= m.start():
            open_owners.append(coming.pop())
        while open_owners and open_owners[-1][1] <= m.start():
            open_owners.pop()
        name = re.split(r"\.|::", m[2])[-1].strip()
        before = plain[max(0, m.start() - 12) : m.start()]
        if name in _NOT_CALLS or re.search(r"\b(?:function|func|fn|fun|def)\s*\*?\s*$", before) or m.end(2) in declared:
            continue
        out.ref(open_owners[-1][2] if open_owners else out.file, name, "instantiates" if m[1] else "calls", line(m.start()))


def extract(path: str, text: str) -> list[dict]:
    """All rows of one file; only the file node where nothing of the text can be read as its language."""
    language = language_of(path) or "unknown"
    out = Rows(path, language, text.count("\n") + 1)
    try:
        if language == "python":
            try:
                _python(text.removeprefix("\ufeff"), out)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                out.rows = out.rows[:1]
                _python_lines(text.removeprefix("\ufeff"), out)
        elif language in ("vue", "svelte", "razor", "liquid", "dfm"):
            from arbora.extract.templates import extract_template

            extract_template(text, language, out)
        elif language != "unknown":
            _braces(text, language, out)
    except (SyntaxError, ValueError, RecursionError):
        out.rows = out.rows[:1]
    return out.rows


def extracted(documents: DataFrame) -> DataFrame:
    """Rows of all source texts (path, text): ``sort`` tells nodes, edges and references."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches):
            rows = [r for path, text in zip(part["path"], part["text"], strict=True) for r in extract(path, text)]
            columns = {c: [r.get(c) for r in rows] for c in _COLS}
            yield pd.DataFrame({c: pd.array(v, dtype="Int32") if c in ("start_line", "end_line", "line") else pd.array(v, dtype="boolean") if c.startswith("is_") else pd.Series(v, dtype="object")
                                for c, v in columns.items()})

    return spread(documents.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")).mapInPandas(run, ROWS)
