"""Blanking of comments with lengths and line ends kept, and reading of bracketed stretches."""

from __future__ import annotations

import re

_SPEC = {
    "c": r'//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)', "hash": r"\#[^\n]*", "sql": r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", "lua": r"--\[\[[\s\S]*?(?:\]\]|\Z)|--[^\n]*", "xml": r"<!--[\s\S]*?(?:-->|\Z)",
}
_FAMILY = {"python": "hash", "ruby": "hash", "lua": "lua", "luau": "lua", "liquid": "xml", "vue": "xml", "svelte": "xml", "razor": "xml"}
_STRINGS = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\[\s\S]|[^`\\])*`'


def strip_comments(text: str, language: str) -> str:
    """Comments become blanks of equal length; strings are left alone."""
    comment = _SPEC[_FAMILY.get(language, "c")]
    return re.sub(f"({_STRINGS})|({comment})", lambda m: m[0] if m[1] is not None else re.sub(r"[^\n]", " ", m[2]), text)


def balanced(text: str, at: int) -> int:
    """Offset after the bracket that closes the one at ``at``; -1 if it never does.  Strings are skipped."""
    close = {"(": ")", "[": "]", "{": "}"}[text[at]]
    depth = 0
    for m in re.compile(_STRINGS + r"|[()\[\]{}]").finditer(text, at):
        if m[0] == text[at]:
            depth += 1
        elif m[0] == close:
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


def single_edit(old: str, new: str) -> tuple[int, int, int] | None:
    """(start, old end, new end) of the one stretch that differs; None where a file is better read anew:
    more than a quarter of it, more than 100 lines, or a size that changes by more than half."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    before, after = old[a : len(old) - b], new[a : len(new) - b]
    if max(len(before), len(after)) > 0.25 * max(len(old), 1) or max(before.count("\n"), after.count("\n")) > 100 or abs(len(new) - len(old)) > 0.5 * max(len(old), 1):
        return None
    return a, len(old) - b, len(new) - b
