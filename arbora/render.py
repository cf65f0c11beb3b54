"""Text output for people and tools, on the driver, from results that are already bounded."""

from __future__ import annotations

MAX_BYTES = 15_000


def cut_utf8(text: str, limit: int = MAX_BYTES) -> str:
    """At most ``limit`` bytes, never inside a character."""
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore")


def numbered(text: str, first: int = 1) -> str:
    return "\n".join(f"{first + i}\t{line}" for i, line in enumerate(text.split("\n")))


def table(rows: list[dict], columns: list[str]) -> str:
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = "\n".join("| " + " | ".join("" if r.get(c) is None else str(r[c]).replace("|", "\\|").replace("\n", " ") for c in columns) + " |" for r in rows)
    return cut_utf8(head + "\n" + body)
