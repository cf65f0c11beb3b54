"""A generalised LL recogniser with a graph-structured stack.

Descriptors (slot, stack node, position) are worked off in any order; a stack node (name, position) is shared
by all calls of one name at one place, keeps the slots to return to, and remembers where it has been popped,
so ambiguity and left recursion need no care.  It reports every position at which the name can end.
"""

from __future__ import annotations

from arbora.llm.chart import Grammar

Slot = tuple[str, tuple[str, ...], int]
Node = tuple[str, int]


def ends(g: Grammar, start: str, tokens: list[frozenset[str]], at: int = 0) -> set[int]:
    """Positions where a ``start`` that begins at ``at`` can end."""
    n = len(tokens)
    root: Node = (start, at)
    returns: dict[Node, set[tuple[Slot, Node]]] = {root: set()}
    popped: dict[Node, set[int]] = {root: set()}
    seen: set[tuple[Slot, Node, int]] = set()
    work: list[tuple[Slot, Node, int]] = []

    def add(slot: Slot, node: Node, pos: int) -> None:
        d = (slot, node, pos)
        if d not in seen:
            seen.add(d)
            work.append(d)

    def begin(node: Node) -> None:
        name, pos = node
        token = tokens[pos] if pos < n else frozenset()
        for alt, first, empty in g.alts[name]:
            if empty or not first.isdisjoint(token):
                add((name, alt, 0), node, pos)

    begin(root)
    while work:
        (name, alt, dot), node, pos = work.pop()
        while dot < len(alt) and alt[dot] not in g.rules:
            if pos < n and alt[dot] in tokens[pos]:
                dot, pos = dot + 1, pos + 1
            else:
                break
        if dot == len(alt):
            if pos not in popped[node]:
                popped[node].add(pos)
                for slot, up in returns[node]:
                    add(slot, up, pos)
        elif alt[dot] in g.rules:
            callee: Node = (alt[dot], pos)
            back = ((name, alt, dot + 1), node)
            new = callee not in returns
            if new:
                returns[callee], popped[callee] = set(), set()
            if back not in returns[callee]:
                returns[callee].add(back)
                for end in popped[callee]:
                    add(back[0], node, end)
            if new:
                begin(callee)
    return popped[root]


def recognises(g: Grammar, start: str, tokens: list[frozenset[str]]) -> bool:
    return len(tokens) in ends(g, start, tokens)
