"""Functions paired with their documentation.

Source texts are parsed with recovery: brackets are matched (missing ends are supplied, stray ones skipped),
and every statement of every level is offered to the generalised LL parser of ``gll`` as a function.  What it
accepts, with no fault inside, is a function with its name, signature, lines and code, also when the rest of
the file is broken.

A description says something if, comment markers aside, one of its sentences does.
1. Every sentence is turned into a template (the function's own words taken out, numbers folded), templates are
   counted by hash over the whole corpus, and one that at least one in ``1 / STOCK_SHARE`` of all sentences has
   (and ``STOCK_LEAST`` at least) is a stock remark, whatever it says.  This comes first and refuses most.
2. Of the others, a sentence says nothing if it is only marks, a tag without a description, a parameter list,
   code (it parses as a statement), or the function's own name or signature in other words.
3. Last, for corpora too small to count in, there are lists of placeholders, pointers, directives and legal lines.
Nodes meet the functions of their text first; those whose file has no text, or in which no function of that
name parses, are judged by the node alone.

Defined results: null or blank docstrings, and null names, give no pair; repeated rows of a node give one;
a node without a text is judged but has no code; other columns are not read; empty tables give none.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm import gll
from arbora.llm.batches import slices
from arbora.llm.grammars import language_of
from arbora.llm.syntax import Parser, parser
from arbora.session import materialise, spread

# ---------------------------------------------------------------- functions of a text

_KEYED = {"javascript": "=function", "typescript": "=function", "go": "=func", "rust": "=fn", "python": "=def"}
_FUNCTIONS: dict[tuple[str, tuple[str, ...]], bool] = {}


def _is_function(p: Parser, unit: tuple[str, ...]) -> bool:
    key = (p.lang.name, unit)
    got = _FUNCTIONS.get(key)
    if got is None:
        if len(_FUNCTIONS) > 200_000:
            _FUNCTIONS.clear()
        tokens = [p.terminal_set(k) for k in unit]
        names = [n for n in ("fnblock", "fnclass") if n in p.lang.grammar.rules]
        got = _FUNCTIONS[key] = any(gll.recognises(p.lang.grammar, n, tokens) for n in names)
    return got


def _name_at(p: Parser, kinds: list[str]) -> tuple[int, int] | None:
    """(index of the name, index of the parameter group) in the tokens of a function."""
    start = kinds.index(_KEYED[p.lang.name]) if _KEYED.get(p.lang.name) in kinds else 0
    group = lambda i: kinds[i] in p.classes and kinds[i][0] == "P"
    for i in range(start + 1, len(kinds)):
        if not group(i):
            continue
        j = i - 1
        if kinds[j] == ">":  # generics between name and parameters
            depth = 0
            while j >= 0:
                depth += (kinds[j] == ">") - (kinds[j] == "<")
                j -= 1
                if depth == 0:
                    break
        elif kinds[j] in p.classes and kinds[j][0] == "S":
            j -= 1
        if j >= 0 and "ID" in p.terminal_set(kinds[j]) and (j == 0 or kinds[j - 1] not in ("@", ".")):
            return j, i
        if p.lang.name == "go":
            continue
        if start:
            return None
    return None


def functions(text: str, lang: str) -> list[tuple[str, str, int, int]]:
    """(name, signature, first line, last line) of each sound function of a text; lines count from 1."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    p = parser(lang)
    p.levels, p.group_ends, p.asked = [], {}, "places"
    try:
        faults = sorted(f.at for f in p.check(text))
        levels, group_ends = p.levels, p.group_ends
    finally:
        p.levels, p.asked = None, "costs"
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect.bisect_left(breaks, at) + 1
    out = []
    if lang == "python":
        rows = text.split("\n")
        for kinds, spots in levels:
            if "=def" not in kinds[:2] or not _is_function(p, tuple(kinds)):
                continue
            first = line_of(spots[0])
            margin = len(rows[first - 1]) - len(rows[first - 1].lstrip())
            at = next((i for i, k in enumerate(kinds) if k in p.classes and k[0] == "P"), None)
            name_at = kinds.index("=def") + 1
            last = line_of(spots[-1])
            for i in range(last, len(rows)):
                if rows[i].strip():
                    if len(rows[i]) - len(rows[i].lstrip()) <= margin and not rows[i].lstrip().startswith((")", "]", "}")):
                        break
                    last = i + 1
            begin, end = spots[0], breaks[last - 1] if last - 1 < len(breaks) else len(text)
            if at is None or bisect.bisect_left(faults, begin) != bisect.bisect_left(faults, end):
                continue
            name = re.match(r"\w+", text[spots[name_at]:])
            out.append((name[0] if name else "", " ".join(text[spots[at] : spots[-1]].split()).rstrip(" :"), first, last))
        return out
    for kinds, spots in levels:
        # Line numbers serve the cuts between statements; offsets are turned into them here.
        lines = [line_of(s) for s in spots]
        for a, b in p.statements(kinds, lines):
            unit = tuple(kinds[a:b])
            if not any(k in p.classes and k[0] == "P" for k in unit) or not _is_function(p, unit):
                continue
            if unit[-1] != ";" and not any(k in p.classes and k[0] == "B" for k in unit):
                continue  # a head that has lost its body
            end = group_ends.get(spots[b - 1], spots[b - 1] + 1)
            if kinds[b - 1] == ";" and b - 2 >= a:
                end = group_ends.get(spots[b - 2], spots[b - 1] + 1)
            if bisect.bisect_left(faults, spots[a]) != bisect.bisect_left(faults, end):
                continue
            at = _name_at(p, list(unit))
            if at is None:
                continue
            body = next((i for i in range(at[1] + 1, len(unit)) if unit[i] in p.classes and unit[i][0] == "B" or unit[i] in ("=>", ";")), None)
            stop = spots[a + body] if body is not None else end
            name = re.match(r"[\w$]+", text[spots[a + at[0]]:])
            out.append((name[0] if name else "", " ".join(text[spots[a + at[1]] : stop].split()), line_of(spots[a]), line_of(end - 1)))
    return out


_FUNCTION = "path string, name string, signature string, start_line int, end_line int, code string"


def extracted(documents: DataFrame, with_code: bool = True) -> DataFrame:
    """(path, name, signature, start_line, end_line, code) of all functions of all source texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                if not (lang := language_of(path)):
                    continue
                parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if with_code else []
                rows += [(path, n, s, a, b, "\n".join(parts[a - 1 : b]) if with_code else None) for n, s, a, b in functions(text, lang)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FUNCTION.split(", ")])

    return spread(documents.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")).mapInPandas(run, _FUNCTION)


# ---------------------------------------------------------------- what a description says

# Wordings that say nothing about a function, compared without case and end marks.
PLACEHOLDERS = {
    "todo", "fixme", "xxx", "tbd", "n/a", "na", "wip", "placeholder", "asdf", "foo", "bar", "later", "todo later", "fixme later", "none", "nothing", "test",
    "todo document", "todo write docs", "write docs", "document", "document me", "docs to follow", "documentation", "missing documentation",
    "add description", "description here", "description", "no description", "undocumented", "not documented", "generated stub", "stub",
    "todo auto-generated method stub", "auto-generated method stub", "auto-generated", "por documentar", "à documenter", "beschreibung folgt",
    "à compléter", "sin documentar", "pendiente", "noch zu dokumentieren", "to be documented", "to do", "to be done", "coming soon", "???",
}
POINTERS = {
    "see above", "see below", "see base class", "see parent", "see super", "see superclass", "see interface", "same as above", "as above", "ditto", "inherited",
    "inheritdoc", "inherit docs", "inherit", "idem", "see docs", "see documentation", "see readme", "override", "overrides", "see also",
}
STOCK = {
    "getter", "setter", "constructor", "ctor", "destructor", "helper", "helper function", "helper method", "utility", "utility function", "main entry", "main entry point",
    "entry point", "default implementation", "implementation", "internal", "private", "public", "deprecated", "hidden", "accessor", "callback", "wrapper",
    "internal use only", "for internal use only", "convenience method", "main function", "main", "init", "initializer", "default constructor",
    "region helpers", "region", "endregion", "nodoc", "this function", "this method", "function", "method",
}
TAG_WORDS = {"args", "arguments", "parameters", "params", "param", "returns", "return", "raises", "yields", "throws", "example", "examples", "note", "notes", "see", "remarks",
             "attributes", "keyword args", "value", "summary"}
_DIRECTIVE = re.compile(
    r"^(?:noqa\b|pylint\s*:|eslint[-\s]|prettier-ignore|tslint:|clippy::|go:\w+|istanbul\s+ignore|nolint\b|pragma\b|type:\s*ignore|@ts-\w+|nosonar\b|region\b|endregion\b|#?region\b|"
    r"mypy:|flake8:|isort:|fmt:\s*(?:on|off|skip)|yapf:|checkstyle|suppresswarnings|@suppress\w*|coverage:|c8\s+ignore|stylelint|jshint|jslint|global\s+\w+\s*$|lint:|rustfmt|skipcq|"
    r"black:|ruff:|pyright:|pytype:|@formatter|biome-ignore|deno-lint|spellchecker|cspell|codecov|sonar|resharper|noinspection|checkov|nosec\b|allow\()", re.I)
_LEGAL = re.compile(r"^(?:spdx-license|licen[cs]ed (?:under|to)\b|all rights reserved|copyright\b|\(c\)|©|released under\b|distributed under\b|this file is part of|part of .* see the licen[cs]e|permission is hereby)", re.I)
_VERSION = re.compile(r"^(?:(?:since|version|v|rev|revision|date|added in|updated|changed|last (?:modified|changed)|created)?[\s:]*)?(?:v?\d+(?:\.\d+)+(?:[-+.\w]*)?|v\d+|\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4})\.?$", re.I)
_BARE_TAG = re.compile(
    r"^[@\\:](?:author|since|version|deprecated|override|internal|hidden|api|test|private|public|protected|see|link|inheritdoc|todo|date|ignore|nodoc|static|async|readonly|access|"
    r"category|group|module|namespace|package|file|copyright|license|final|virtual|abstract|constructor|class|function|func|method|memberof|name|export|exports|experimental|beta|alpha|stable)\b"
    r":?(?:\s*(?:private|public|protected|unknown|[\w.]*\d[\w.]*|\S+))?\.?$", re.I)
_PARAM_TAG = re.compile(r"^(?:[@\\:](?:param|arg|argument|parameter|type|tparam|typeparam|throws|raises|exception|raise|prop|property|keyword|key|var|rtype|yields?|returns?|return)\b:?)\s*(.*)$", re.I)
_COMMENT_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+[!/]?|#+!?(?![\w:])|#(?=\s|$)|<!--|--\s|;;+)\s?|\s*(?:\*+/|-->)\s*$")
_XML = re.compile(r"</?(?:summary|remarks|returns?|value|para|p|br|code|c|b|i|see|seealso|inheritdoc|example|exception|typeparam|param|list|item|description)\b[^>]*/?>", re.I)
_WORD = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ӿ一-鿿぀-ヿ]+|\d+")
_GLUE = {
    "a", "an", "the", "this", "that", "these", "those", "it", "its", "to", "of", "for", "and", "or", "function", "functions", "method", "methods", "func", "routine", "procedure", "which",
    "will", "is", "be", "used", "use", "uses", "does", "do", "performs", "perform", "implements", "implement", "implementation", "given", "with", "our", "your", "my", "in", "on", "by", "from", "s", "call", "calls",
    "simply", "just", "can", "helper", "operation", "class", "object", "instance", "one", "some", "any", "all", "each", "every",
}


def _stem(w: str) -> str:
    w = w.lower()
    for end, put in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 2 and not w.endswith("ss"):
            w = w[: -len(end)] + put
            break
    for end in ("ing", "ed"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "lsz":
        w = w[:-1]
    return w.rstrip("e")


def _parts(text: str) -> list[str]:
    """Words of prose or of names: camel case and underscores are cut."""
    return _WORD.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text.replace("_", " ")))


def bare_lines(doc: str) -> list[str]:
    """The lines of a description without comment markers."""
    text = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    m = re.match(r"^[rRuUbBfF]{0,2}(\"\"\"|''')", text)
    if m:
        text = text[m.end():]
        text = text[: -3] if text.endswith(m[1]) else text
    text = text.replace('"""', " ").replace("'''", " ")
    out = []
    for line in text.split("\n"):
        before = None
        while line != before:
            before, line = line, _COMMENT_MARK.sub("", line)
        out.append(line.strip())
    return out


def _plain(s: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"^[\W_]+|[\W_]+$", "", s.replace(":", " "))).lower().strip()


def _is_code(s: str) -> bool:
    """Whether the generalised LL parser reads it as a statement, and it is not plain words."""
    if not re.search(r"[()=;{}\[\]]", s):
        return False
    # Snippets may use another language's keywords as names, so they are read with and without keywords.
    return any(_reads_as(s, lang, start, names) for lang, start in (("python", "line"), ("typescript", "stmt"), ("java", "stmt"), ("go", "stmt"), ("rust", "stmt")) for names in (False, True))


def _reads_as(s: str, lang: str, start: str, names: bool) -> bool:
    p = parser(lang)
    sink: list = []
    stack: list = []
    kinds: list[str] = []
    lines: list[int] = []
    spots: list[int] = []
    for sort, kind, at, _ in p.tokens(s):
        if sort == "t":
            kinds.append("ID" if names and kind[0] == "=" and kind[1:].isalpha() else kind)
            lines.append(0)
            spots.append(at)
        elif sort == "o":
            stack.append((kind, at, kinds, lines, spots))
            kinds, lines, spots = [], [], []
        elif sort == "c" and stack and {"(": ")", "[": "]", "{": "}"}[stack[-1][0]] == kind:
            kinds, lines, spots = p._reduce(stack, kinds, lines, spots, sink, 0)
        elif sort != "n":
            return False
    if stack or sink or not kinds:
        return False
    key = (lang + start, tuple(kinds))
    got = _FUNCTIONS.get(key)
    if got is None:
        got = _FUNCTIONS[key] = gll.recognises(p.lang.grammar, start, [p.terminal_set(k) for k in kinds])
    return got


def _is_signature(s: str, own: set[str]) -> bool:
    """A parameter list, alone or after the name: all its words are types or parts of the own signature."""
    m = re.fullmatch(r"(?:[\w$.]+\s*)?\(.*\)\s*(?:(?:->|:)?\s*[\w<>\[\], .&?*]+)?;?", s.strip(), re.S)
    return bool(m) and (bool(re.match(r"\s*\(", s)) or {_stem(w) for w in _parts(s.split("(")[0])} <= own)


def _verdict(s: str, own: set[str], signature: set[str]) -> str:
    """What one sentence is: marks, tag, name, signature, code or listed; or says, if it says something."""
    s = s.strip()
    if not re.search(r"[^\W\d_]", s):
        return "marks"
    if _BARE_TAG.match(s) or re.fullmatch(r"\{?@\w+\s*[\w.#()]*\}?\.?", s) or re.fullmatch(r"</?\w+\s*/?>", s) or re.fullmatch(r":\w+:\.?", s):
        return "tag"
    m = _PARAM_TAG.match(s)
    if m:
        rest = re.sub(r"^\{[^}]*\}\s*", "", m[1]).strip()
        tag = s.lstrip("@\\:").lower()
        if not tag.startswith(("return", "yield", "rtype")):
            rest = re.sub(r"^\[?[\w$.]+(?:\s*=[^\]]*)?\]?\s*:?\s*[-–]?\s*", "", rest, count=1)
            # ":param str name:" names a type before the name
            rest = re.sub(r"^[\w$.]+\s*:\s*", "", rest, count=1) if s.startswith(":") else rest
        rest = rest.strip(" :.-")
        if tag.startswith(("type", "rtype")) and len(rest.split()) <= 2:
            return "tag"
        return _verdict(rest, own, signature) if re.search(r"[^\W\d_]", rest) else "tag"
    if re.fullmatch(r"[\w$]+\s*:", s):  # the name of a parameter or of a section, nothing after it
        return "tag"
    words = [_stem(w) for w in _parts(s) if w.lower() not in _GLUE]
    if not words or all(w in own for w in words) or (signature and all(w in own or w in signature for w in words)):
        return "name"
    if _is_signature(s, own):
        return "signature"
    if _is_code(s):
        return "code"
    plain = _plain(s)
    if plain in PLACEHOLDERS or plain in POINTERS or plain in STOCK or plain in TAG_WORDS or _DIRECTIVE.match(s) or _LEGAL.match(s) or _VERSION.match(s):
        return "listed"
    if re.match(r"^(?:see|cf\.?|refer to|inherited from|overrides?|implements|same as|as in|@see|@link)\b(?:\s+(?:also|the|base|class|method|function))*\s+[\w.#:()/`{}@<>-]+\.?$", s, re.I):
        return "listed"
    if len(s.split()) == 1 and not re.search(r"[^\W\d_]{2,}\W+[^\W\d_]{2,}", s):
        return "listed"
    return "says"


_PLACE_FRONT = re.compile(r"^(?:todo|fixme|xxx|tbd|wip|note to self)\b(?:\s*\([^)]*\))?\s*:?\s*(?:later\b)?[.:!-]*\s*", re.I)
_TAG_FRONT = re.compile(r"^(?:@(?:internal|hidden|deprecated|test|override|api private|private|public|beta|inheritdoc)\b|:nodoc:|\{@inheritDoc\})[.:]?\s*", re.I)


def sentences(line: str) -> list[str]:
    return [p for p in re.split(r"(?<=[.!?…])\s+(?=\S)|\s+(?=[@:](?:param|returns?|type|throws|raises)\b)|\s+—\s+", line) if p.strip()]


def _own(name: str | None) -> set[str]:
    return {_stem(w) for w in _parts(name or "")}


def templates(doc: str, name: str | None) -> list[tuple[str, str]]:
    """(template, sentence) of a description; a template takes the words of the name out and folds numbers.

    A description of one line is one sentence if it is the signature, a line of code in a fence is one as it stands.
    """
    own = _own(name)

    def template(s: str) -> str:
        words = ("_" if _stem(w) in own else "0" if w.isdigit() else w.lower() for w in _parts(s))
        return re.sub(r"_(?: _)+", "_", " ".join(words))

    lines = bare_lines(doc)
    filled = [x for x in lines if x]
    if len(filled) == 1 and _is_signature(filled[0], own):
        return [(template(filled[0]), filled[0])]
    out = []
    code = False
    for line in lines:
        if line.startswith("```"):
            code = not code
            continue
        line = line if code else _XML.sub(" ", line).strip()
        if line:
            out += [(template(s), s) for s in ([line] if code or re.search(r"[()=;{}\[\]]", line) and _is_code(line) else sentences(line))]
    return out


def judged_sentences(doc: str | None, name: str | None, signature: str | None, stock: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """What the sentences of a description are, up to the first that says something: stock, or a verdict."""
    own, sig = _own(name), {_stem(w) for w in _parts(signature or "")}
    out = []
    for counted, s in templates(doc, name) if doc and doc.strip() else ():
        if not counted or hash_of(counted) in stock:
            out.append("stock" if counted else "marks")
            continue
        before = None
        while s != before:
            before = s
            s = _TAG_FRONT.sub("", _PLACE_FRONT.sub("", s))
        out.append(_verdict(s, own, sig) if s else "tag")
        if out[-1] == "says":
            break
    return out


def hash_of(template: str) -> int:
    return xxhash.xxh64_intdigest(template) - (1 << 63)


def says_something(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether a description says anything about its function, without counts of a corpus."""
    return "says" in judged_sentences(doc, name, signature)


# ---------------------------------------------------------------- the operator

STOCK_SHARE, STOCK_LEAST = 1 / 4000, 8


def judged(nodes: DataFrame, functions_: DataFrame) -> DataFrame:
    """The documented functions, the step that decides each, and whether the text holds them."""
    n = nodes.filter("lower(trim(kind)) IN ('function', 'method') AND id IS NOT NULL AND trim(docstring) <> ''").select(
        "id", "name", "file_path", "start_line", "docstring", "signature").distinct()
    seen = functions_.groupBy(F.col("path").alias("file_path"), "name").agg(F.min("signature").alias("found"))  # overloads: any will do for the words
    j = n.join(seen, ["file_path", "name"], "left").withColumn("in_text", F.col("found").isNotNull()).withColumn("signature", F.coalesce("signature", "found")).drop("found")
    own = "file_path string, name string, id string, start_line int, docstring string, signature string, in_text boolean"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "docstring"):
            yield pdf.assign(hashes=[sorted({hash_of(t) for t, _ in templates(d, n) if t}) for d, n in zip(pdf["docstring"], pdf["name"], strict=True)])

    rows = materialise(j.mapInPandas(count, own + ", hashes array<bigint>"), "described")
    each = rows.select("id", F.explode("hashes").alias("h"))
    total = each.agg(F.count(F.lit(1)).alias("total")).scalar()
    # At most 1 / STOCK_SHARE templates can pass; they come as one row, null for none.
    stock = each.groupBy("h").agg(F.countDistinct("id").alias("n")).filter((F.col("n") >= STOCK_LEAST) & (F.col("n") >= STOCK_SHARE * total)).agg(F.collect_set("h").alias("stock")).scalar()

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "docstring"):
            steps_ = []
            for d, n, s, h in zip(pdf["docstring"], pdf["name"], pdf["signature"], pdf["stock"], strict=True):
                v = judged_sentences(d, n, s, set(h))
                steps_.append("says" if "says" in v else "template" if all(x in ("stock", "marks") for x in v) else "list" if "listed" in v else "syntax")
            yield pdf.drop(columns="stock").assign(step=steps_)

    marked = rows.withColumn("stock", F.array_intersect("hashes", stock)).drop("hashes")
    return marked.mapInPandas(decide, own + ", step string")


def described(nodes: DataFrame, functions_: DataFrame) -> DataFrame:
    """(node_id, file_path, name, signature, start_line, docstring) of the functions that have a description
    which says something; the signature comes from the text where the node has none."""
    return judged(nodes, functions_).filter("step = 'says'").select(F.col("id").alias("node_id"), "file_path", "name", "signature", "start_line", "docstring")


def steps(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(in_text, step, n): how many documented functions each step decides."""
    return judged(nodes, extracted(documents, with_code=False)).groupBy("in_text", "step").agg(F.countDistinct("id").alias("n"))


def pairs(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node_id, name, signature, code, description): the nearest function of that name in the file."""
    f = materialise(extracted(documents), "functions")
    d = described(nodes, f.select("path", "name", "signature"))
    near = d.join(f.select(F.col("path").alias("file_path"), "name", F.col("start_line").alias("at"), "code"), ["file_path", "name"])
    w = Window.partitionBy("node_id").orderBy(F.abs(F.col("at") - F.col("start_line")), "at", "code")
    return near.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("node_id", "name", "signature", "code", F.col("docstring").alias("description"))


def found(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    return described(nodes, extracted(documents, with_code=False).select("path", "name", "signature")).select("node_id").distinct()
