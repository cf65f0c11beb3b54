"""Generated, minified or vendored source files.

Each text is lexed and re-emitted in a canonical layout (a statement or a brace to a line, indentation by depth,
single blanks, comments left out); the original layout is compared with it:
  * expansion: canonical lines per original line; extreme expansion marks compressed files,
  * uniformity: the share of canonical lines that have the commonest shape; near 1 marks what a printer wrote,
  * literal dominance: the share of code characters in literals with hardly a name between them; marks data,
  * agreement: the share of original lines that are canonical lines; reported, and near 0 in compressed files.
Where a tool or a third party signs its work, the signature counts: the comment on top of the file (a
generator's notice, or a component with a version or a project that is not the repository), the names that
tools give to files and folders, and the hashes of known library files.

Defined results: a path without a text is judged by its path and hash alone; a text cut to an excerpt by the
part that is there; null paths are left out; null or empty texts have no layout; repeated rows and several
rows per path give one row; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.batches import slices
from arbora.session import spread
from arbora.sources.tables import norm_hash

_STRING = r'"""[\s\S]*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?|\'(?:\\.|[^\'\\\n])*\''
_TOKEN_C = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|" + _STRING + r"|[^\W\d][\w$]*|\d[\w.]*|[^\s\w]|\n")
_TOKEN_HASH = re.compile(r"#[^\n]*|'''[\s\S]*?(?:'''|\Z)|" + _STRING + r"|[^\W\d][\w$]*|\d[\w.]*|[^\s\w]|\n")
_HASH_EXT = (".py", ".pyi", ".rb", ".sh")
_MARKS = re.compile(r"^(?:#+!?|//+!?|/\*+!?|\*+/|\*+|<!--|--+)\s*|\s*(?:\*+/|-->)\s*$")

# What generators write on top of their output, each as it begins a comment line.
GENERATOR_NOTICES = (
    r"code generated\b",
    r"@generated\b",
    r"<auto-?generated\b",
    r"auto-?generated\b",
    r"automatically generated\b",
    r"(?:this|the) (?:file|code|class|module) (?:is|was|has been) (?:automatically |auto-?|machine[- ])?(?:generated|made|created|produced) (?:by|from)\b",
    r"generated (?:by|from|with|using)\b",
    r"machine[- ](?:made|generated)\b",
    r"do not (?:edit|modify)\b",
    r"(?:archivo |fichero |código )?(?:auto-?generado|generado (?:automáticamente )?(?:por|con|a partir de)|no (?:modificar|editar))\b",
    r"(?:fichier |code )?(?:auto-?généré|généré (?:automatiquement )?(?:par|avec|à partir de)|ne pas (?:modifier|éditer))\b",
    r"(?:datei |code )?(?:auto-?generiert|(?:automatisch |maschinell )(?:generiert|erzeugt|erstellt)|(?:generiert|erzeugt) (?:von|aus|durch|mit)|nicht (?:bearbeiten|ändern|editieren))\b",
    r"(?:arquivo |código )?(?:auto-?gerado|gerado (?:automaticamente )?(?:por|com)|não (?:modificar|editar))\b",
    r"(?:file |codice )?(?:auto-?generato|generato (?:automaticamente )?(?:da|con)|non (?:modificare|toccare))\b",
    r"(?:此文件|本文件)?(?:由.{0,40})?自动生成|自動生成|このファイルは|请勿(?:修改|编辑)|編集しないで",
)
_NOTICE = re.compile(r"(?:" + "|".join(GENERATOR_NOTICES) + r")", re.I)
_VERSIONED = re.compile(r"\b[\w.@/-]*[A-Za-z][\w.@/-]*\s*(?:-\s*)?(?:at\s+)?(?:version|tag|v\.?)?\s*v?\d+\.\d+", re.I)
_THIRD = re.compile(
    r"licen[cs]e|permission is hereby|upstream|\(c\)|copyright|distributed under|maintainers|all rights reserved", re.I)
_LICENCE = re.compile(r"(?:\W*(?:the|apache|gnu|mozilla|public|general|lesser|affero|boost|software|eclipse|creative|commons|licen[cs]e|[al]?gpl|mpl|epl|bsl|cc|mit|bsd|spdx[\w-]*))*\W*(?:version|v)?\W*\d|version\b|v?\d", re.I)
_OWNER = re.compile(r"(?:copyright(?: \(c\))?|\(c\))\s+(?:\d{4}(?:\s*[-,]\s*\d{4})?,?\s+)?(?:the\s+)?([\w.-]+)\s+(?:authors|project|team|contributors|developers)|"
                    r"\bpart of\s+(?:the\s+)?([\w.-]+)", re.I)

# Names that tools and package managers give to folders and files.
TOOL_FOLDERS = r"/(?:gen|generated|__generated__|generated-src|generated-sources|autogen|dist|build/generated|out/codegen)/"
VENDOR_FOLDERS = r"/(?:vendor|vendored|third[-_]?party|node_modules|bower_components|externals?|extern|deps|Godeps/_workspace)/"
TOOL_FILES = (
    r"(?:[.\-](?:min|bundle|packed)\.m?js|_pb2(?:_grpc)?\.pyi?|[._]pb\.(?:m?js|m?ts|go|cc|h)|_pb\.m?js|"
    r"\.(?:gen|generated|g|g\.i|i|designer)\.[A-Za-z]+|_gen\.go|_generated\.[A-Za-z]+|Grpc\.g\.java|OuterClass\.java)$"
)
GENERATED_FILES = r"/(?:zz_generated\.[^/]+)$"

_SCHEMA = "path string, expansion double, agreement double, uniformity double, literals double, notice boolean, foreign boolean, minified boolean, data boolean, uniform boolean"


def top_comment(text: str) -> list[str]:
    """The comment lines before any code, without their marks."""
    out: list[str] = []
    block = False
    for line in text.lstrip("﻿").splitlines():
        s = line.strip()
        starts = s.startswith(("/*", "<!--"))
        if not s and not block:
            if out:
                continue
            continue
        if not (block or starts or s.startswith(("//", "#", "--"))):
            break
        if starts and "*/" in s and not s.endswith("*/"):  # code follows in the same line
            out.append(_MARKS.sub("", s[: s.index("*/")]).strip())
            break
        if block or starts:
            block = "*/" not in s
        bare = _MARKS.sub("", _MARKS.sub("", s)).strip()
        if bare:
            out.append(bare)
    return out


def signed_by(text: str, repo: str) -> tuple[bool, bool]:
    """(a generator's notice is on top, another project's header is on top)."""
    lines = top_comment(text)
    notice = any(_NOTICE.match(line) for line in lines)
    foreign = False
    own = re.sub(r"[^a-z0-9]", "", repo.lower())
    for line in lines:
        for m in _OWNER.finditer(line):
            who = re.sub(r"[^a-z0-9]", "", (m[1] or m[2] or "").lower())
            foreign |= bool(who) and who != own and who not in ("project", "this", "the")
    if not notice and lines and _THIRD.search(" ".join(lines)):
        # Further down a component's name and version begin their line, as prose and licences have versions, too.
        named = [" ".join(lines[:2])] if _VERSIONED.search(" ".join(lines[:2])) else []
        named += [line for line in lines[2:] if _VERSIONED.match(line) and not _LICENCE.match(line)]
        foreign |= any(not own or own not in re.sub(r"[^a-z0-9]", "", line.lower()) for line in named)
    return notice, foreign


def canonical(tokens: list[str], hash_comments: bool) -> list[tuple[int, list[str]]]:
    """(depth, tokens) of the canonical lines of lexed code."""
    out: list[tuple[int, list[str]]] = []
    line: list[str] = []
    depth = nested = 0
    for t in tokens:
        c = t[0]
        if c == "\n":
            # Without braces a statement ends with its line, unless a bracket is open.
            if hash_comments and line and not nested:
                out.append((depth, line))
                line = []
            continue
        if (c == "#" and hash_comments) or (c == "/" and len(t) > 1):
            continue
        if c == "{" and not hash_comments:
            line.append(t)
            out.append((depth, line))
            depth, line = depth + 1, []
        elif c == "}" and not hash_comments:
            if line:
                out.append((depth, line))
            depth, nested, line = max(0, depth - 1), 0, []
            out.append((depth, [t]))
        elif c == ";" and not nested:
            line.append(t)
            if len(line) == 1 and out and out[-1][1][-1] == "}":  # it belongs to the brace before
                out[-1][1].append(t)
            else:
                out.append((depth, line))
            line = []
        else:
            if c in "([":
                nested += 1
            elif c in ")]":
                nested = max(0, nested - 1)
            line.append(t)
    if line:
        out.append((depth, line))
    return out


def emit(text: str, hash_comments: bool) -> str:
    """The text in canonical layout."""
    return "\n".join("    " * d + " ".join(line) for d, line in canonical((_TOKEN_HASH if hash_comments else _TOKEN_C).findall(text), hash_comments))


def _shape(t: str) -> str:
    c = t[0]
    return "L" if c in "\"'`" or c.isdigit() else "N" if c.isalpha() or c in "_$" else c


def layout(text: str, hash_comments: bool) -> tuple[float, float, float, float, int, int, int, int, int]:
    """(expansion, agreement, uniformity, literal share, code characters, lines, canonical lines, literals, names)."""
    tokens = (_TOKEN_HASH if hash_comments else _TOKEN_C).findall(text)
    lines = canonical(tokens, hash_comments)
    ours = {"".join(line) for _, line in lines}
    shapes: Counter[str] = Counter()
    code = literal = n_lit = names = 0
    for _, line in lines:
        shape = "".join(map(_shape, line))
        shapes[shape] += 1
        code += sum(map(len, line))
        names += shape.count("N")
        if "L" in shape:
            n_lit += shape.count("L")
            literal += sum(len(t) for t, k in zip(line, shape, strict=True) if k == "L")
    filled = same = 0
    own: list[str] = []
    for t in (*tokens, "\n"):
        if t == "\n":
            if own:
                filled += 1
                same += "".join(own) in ours
                own = []
        elif not ((t[0] == "#" and hash_comments) or (t[0] == "/" and len(t) > 1)):
            own.append(t)
    return (len(lines) / max(filled, 1), same / max(filled, 1), max(shapes.values(), default=0) / max(len(lines), 1), literal / max(code, 1), code, filled, len(lines), n_lit, names)


def judge(path: str, text: str | None, repo: str) -> tuple:
    text = text or ""
    expansion, agreement, uniformity, literals, code, lines, printed, n_lit, names = layout(text, path.lower().endswith(_HASH_EXT))
    notice, foreign = signed_by(text, repo)
    minified = code >= 400 and (expansion >= 6 or code / max(lines, 1) >= 400) and names > n_lit / 2
    data = n_lit >= 5 and literals >= 0.5 and names <= 0.34 * n_lit + 4
    uniform = printed >= 20 and uniformity >= 0.8
    return (path, expansion, agreement, uniformity, literals, notice, foreign, minified, data, uniform)


def layouts(documents: DataFrame) -> DataFrame:
    """One row per source text: its layout and who signed it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = [judge(p, t, p.split("/")[2] if p.count("/") > 2 else "") for p, t in zip(pdf["path"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return spread(documents.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")).mapInPandas(run, _SCHEMA)


def judged_files(files: DataFrame, documents: DataFrame, library_hashes: DataFrame) -> DataFrame:
    """(path, produced, compressed, copied, data) for each path of files."""
    known = library_hashes.filter("content_hash IS NOT NULL").select(norm_hash().alias("hash")).distinct().withColumn("known", F.lit(True))
    own = files.filter("path IS NOT NULL").select("path", norm_hash().alias("hash")).join(known, "hash", "left").groupBy("path").agg(
        F.max(F.coalesce("known", F.lit(False))).alias("known"))
    seen = layouts(documents).groupBy("path").agg(*[F.max(c).alias(c) for c in ("notice", "foreign", "minified", "data", "uniform")])
    j = own.join(seen, "path", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    p = F.col("path")
    return j.select(
        "path",
        (yes("notice") | (yes("uniform") & ~yes("data")) | p.rlike(TOOL_FOLDERS) | p.rlike("(?i)" + TOOL_FILES) | p.rlike(GENERATED_FILES)).alias("produced"),
        yes("minified").alias("compressed"), (F.col("known") | yes("foreign") | p.rlike(VENDOR_FOLDERS)).alias("copied"), yes("data").alias("data"),
    )


def found(files: DataFrame, documents: DataFrame, library_hashes: DataFrame) -> DataFrame:
    return judged_files(files, documents, library_hashes).filter("produced OR compressed OR copied OR data").select("path")
