"""Template languages: components, scripts, partials and form objects by pattern."""

from __future__ import annotations

import re


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def script_blocks(text: str) -> list[tuple[int, str]]:
    """(first line, text) of every script block."""
    return [(_line(text, m.start(1)), m[1]) for m in re.finditer(r"<script\b[^>]*>([\s\S]*?)</script>", text, re.I)]


def component_tags(text: str) -> list[tuple[int, str]]:
    """(line, name) of tags that name components: a capital, or a dash inside."""
    return [(_line(text, m.start()), m[1]) for m in re.finditer(r"<([A-Z][\w.]*|[a-z]\w*-[\w-]+)(?=[\s/>])", text)]


def extract_template(text: str, language: str, out) -> None:  # noqa: ANN001
    name = out.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if language in ("vue", "svelte"):
        key = out.node("component", name, name, 1, _line(text, len(text)), out.file, exported=True)
        for first, script in script_blocks(text):
            for m in re.finditer(r"\bfunction\s+(\w+)\s*(\([^)]*\))|\bconst\s+(\w+)\s*=\s*(?:async\s*)?(\([^)]*\))\s*=>", script):
                at = first + script.count("\n", 0, m.start())
                out.node("function", m[1] or m[3], f"{name}::{m[1] or m[3]}", at, at, key, signature=m[2] or m[4])
            for m in re.finditer(r"import\s+[^'\"]*['\"]([^'\"]+)['\"]", script):
                out.ref(key, m[1], "imports", first + script.count("\n", 0, m.start()))
        body = re.sub(r"<(script|style)\b[\s\S]*?</\1>", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.I)
        for at, tag in component_tags(body):
            out.ref(key, "".join(p[:1].upper() + p[1:] for p in tag.split("-")), "renders", at)
    elif language == "razor":
        key = out.node("component", name, name, 1, _line(text, len(text)), out.file, exported=True)
        for m in re.finditer(r'(?m)^\s*@page\s+"([^"]+)"', text):
            out.node("route", m[1], f"{name}::{m[1]}", _line(text, m.start()), _line(text, m.start()), key)
        for m in re.finditer(r"(?m)^\s*@inject\s+([\w.<>]+)\s+\w+", text):
            out.ref(key, m[1].split("<")[0], "references", _line(text, m.start()))
        for m in re.finditer(r"(?m)^\s*@using\s+([\w.]+)", text):
            out.ref(key, m[1], "imports", _line(text, m.start()))
        for m in re.finditer(r"@code\s*\{([\s\S]*)\}", text):
            for f in re.finditer(r"\b[\w<>\[\]?]+\s+([A-Z]\w*)\s*(\([^)]*\))\s*(?:\{|=>)", m[1]):
                at = _line(text, m.start(1) + f.start())
                out.node("method", f[1], f"{name}::{f[1]}", at, at, key, signature=f[2])
        for at, tag in component_tags(text):
            out.ref(key, tag, "renders", at)
    elif language == "liquid":
        for m in re.finditer(r"\{%-?\s*(?:render|include|section)\s+['\"]([^'\"]+)['\"]", text):
            out.ref(out.file, m[1], "references", _line(text, m.start()))
        for m in re.finditer(r"\{%-?\s*assign\s+(\w+)\s*=", text):
            out.node("variable", m[1], m[1], _line(text, m.start()), _line(text, m.start()), out.file)
    elif language == "dfm":
        stack = [(out.file, "")]
        for at, row in enumerate(text.split("\n"), 1):
            m = re.match(r"\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*(\w+)", row)
            if m:
                scope = f"{stack[-1][1]}::{m[1]}".lstrip(":")
                key = out.node("component", m[1], scope, at, at, stack[-1][0])
                out.ref(key, m[2], "instantiates", at)
                stack.append((key, scope))
            elif re.match(r"\s*end\s*$", row) and len(stack) > 1:
                stack.pop()
            elif m := re.match(r"\s*(On\w+)\s*=\s*(\w+)", row):
                out.ref(stack[-1][0], m[2], "references", at)
