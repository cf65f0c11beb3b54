"""Grammars in a small notation, and a chart parser that corrects errors at minimum cost.

Notation: ``name = a b | c`` with ``'x'`` for a token, upper case for token classes, ``P:x`` ``S:x`` ``B:x``
for a round, square or curly group whose inside is an ``x``, and ``( )``, ``?``, ``*``, ``+``.

The chart is Earley's; each item holds the least number of edits (a token lost, added or exchanged) inside
its part of the input, as in Aho and Peterson's least-errors parser.  A budget bounds the edits looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

_PART = re.compile(r"'[^']+'|[PSB]:\w+|\w+|[|()?*+]")


class Grammar:
    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self._n = 0
        for line in re.sub(r"\n\s+", " ", text.strip()).split("\n"):
            if line.strip():
                name, _, body = line.partition("=")
                self._define(name.strip(), _PART.findall(body))
        self.nullable: set[str] = set()
        self.first: dict[str, set[str]] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                for alt in alts:
                    first, empty = self.first_of(alt)
                    if empty and n not in self.nullable:
                        self.nullable.add(n)
                        changed = True
                    if not first <= self.first[n]:
                        self.first[n] |= first
                        changed = True
        missing = {s for alts in self.rules.values() for alt in alts for s in alt if s.islower() and s.isidentifier() and s not in self.rules}
        if missing:
            raise ValueError(f"undefined: {sorted(missing)}")
        self.alts = {n: [(alt, *self.first_of(alt)) for alt in alts] for n, alts in self.rules.items()}

    def first_of(self, alt: tuple[str, ...]) -> tuple[frozenset[str], bool]:
        out: set[str] = set()
        for s in alt:
            if s in self.rules:
                out |= self.first.get(s, set())
                if s not in self.nullable:
                    return frozenset(out), False
            else:
                out.add(s)
                return frozenset(out), False
        return frozenset(out), True

    def _fresh(self, base: str) -> str:
        self._n += 1
        return f"{base}_{self._n}"

    def _define(self, name: str, parts: list[str]) -> None:
        alts, rest = self._choice(name, parts)
        assert not rest, (name, rest)
        self.rules.setdefault(name, []).extend(alts)

    def _choice(self, name: str, parts: list[str]) -> tuple[list[tuple[str, ...]], list[str]]:
        alts: list[tuple[str, ...]] = []
        seq: list[str] = []
        while parts and parts[0] != ")":
            p, parts = parts[0], parts[1:]
            if p == "|":
                alts.append(tuple(seq))
                seq = []
                continue
            if p == "(":
                sub, parts = self._choice(name, parts)
                parts = parts[1:]
                sym = sub[0][0] if len(sub) == 1 and len(sub[0]) == 1 else self._fresh(name)
                if sym not in self.rules and not (len(sub) == 1 and len(sub[0]) == 1):
                    self.rules[sym] = sub
            else:
                sym = p[1:-1] if p[0] == "'" else p
                sym = "=" + sym if p[0] == "'" and sym.isidentifier() else sym
            while parts and parts[0] in "?*+":
                op, parts = parts[0], parts[1:]
                rep = self._fresh(name)
                self.rules[rep] = [(), (sym,)] if op == "?" else [(), (rep, sym)] if op == "*" else [(sym,), (rep, sym)]
                sym = rep
            seq.append(sym)
        alts.append(tuple(seq))
        return alts, parts


def accepts(g: Grammar, start: str, tokens: list[frozenset[str]]) -> bool:
    """Whether the tokens (each the set of terminals it can stand for) are a ``start`` without any edit."""
    return least_edits(g, start, tokens, 0) == 0


def ends(g: Grammar, start: str, tokens: list[frozenset[str]], begin: int) -> Iterator[int]:
    """The ends of all pieces from ``begin`` that are a ``start`` without any edit; reads on only while one can still go on."""
    rules, alts, n = g.rules, g.alts, len(tokens)
    waiting: list[dict[str, set[tuple]]] = []
    there: set[tuple] = {(start, a, 0, begin) for a, first, empty in alts[start] if empty or begin < n and not first.isdisjoint(tokens[begin])}
    pos = begin
    while there:
        token = tokens[pos] if pos < n else frozenset()
        here, there = there, set()
        waits: dict[str, set[tuple]] = {}
        waiting.append(waits)
        done: set[tuple[str, int]] = set()
        begun = {start} if pos == begin else set()
        queue = list(here)
        while queue:
            item = queue.pop()
            name, alt, dot, origin = item
            new: list[tuple] = []
            if dot == len(alt):
                if (name, origin) not in done:
                    done.add((name, origin))
                    new = [(w[0], w[1], w[2] + 1, w[3]) for w in waiting[origin - begin].get(name, ())]
            elif (sym := alt[dot]) in rules:
                waits.setdefault(sym, set()).add(item)
                if sym not in begun:
                    begun.add(sym)
                    new = [(sym, a, 0, pos) for a, first, empty in alts[sym] if empty or not first.isdisjoint(token)]
                if (sym, pos) in done:
                    new.append((name, alt, dot + 1, origin))
            elif sym in token:
                there.add((name, alt, dot + 1, origin))
            for x in new:
                if x not in here:
                    here.add(x)
                    queue.append(x)
        if (start, begin) in done:
            yield pos
        pos += 1


def least_edits(g: Grammar, start: str, tokens: list[frozenset[str]], budget: int) -> int | None:
    """The least number of edits that make the tokens a ``start``, or None if more than ``budget``.

    ``ahead`` holds the edits spent before a name is begun; an item whose spent edits reach the budget is
    only carried on by what matches, so its predictions are filtered by the next token.
    """
    n = len(tokens)
    rules, alts = g.rules, g.alts
    waiting: list[dict[str, dict[tuple, int]]] = [{} for _ in range(n + 1)]
    items: list[dict[tuple, int]] = [{} for _ in range(n + 1)]
    done: list[dict[tuple[str, int], int]] = [{} for _ in range(n + 1)]
    ahead: list[dict[str, int]] = [{} for _ in range(n + 1)]
    for skip in range(min(budget, n) + 1):  # tokens too many in front
        ahead[skip][start] = skip
    for pos in range(n + 1):
        here = items[pos]
        token = tokens[pos] if pos < n else frozenset()
        last = pos == n
        if start in ahead[pos]:
            free = ahead[pos][start] < budget
            for a, first, empty in alts[start]:
                if free or empty or not first.isdisjoint(token):
                    here[(start, a, 0, pos)] = 0
        queue = list(here)
        while queue:
            item = queue.pop()
            name, alt, dot, origin = item
            cost = here[item]
            spent = ahead[origin][name] + cost
            if spent > budget:
                continue
            if dot == len(alt):
                if cost < done[pos].get((name, origin), budget + 1):
                    done[pos][(name, origin)] = cost
                    for w, c in list(waiting[origin].get(name, {}).items()):
                        nxt = (w[0], w[1], w[2] + 1, w[3])
                        if c + cost < here.get(nxt, budget + 1):
                            here[nxt] = c + cost
                            queue.append(nxt)
                continue
            sym = alt[dot]
            if sym in rules:
                waits = waiting[pos].setdefault(sym, {})
                if cost < waits.get(item, budget + 1):
                    waits[item] = cost
                    if spent < ahead[pos].get(sym, budget + 1) or sym == start and (sym, pos) not in done[pos] and not any(k[0] == sym and k[3] == pos for k in here):
                        ahead[pos][sym] = min(spent, ahead[pos].get(sym, spent))
                        free = spent < budget
                        for a, first, empty in alts[sym]:
                            if free or empty or not first.isdisjoint(token):
                                key = (sym, a, 0, pos)
                                if key not in here:
                                    here[key] = 0
                                queue.append(key)
                    c = done[pos].get((sym, pos))
                    if c is not None and cost + c < here.get(nxt := (name, alt, dot + 1, origin), budget + 1):
                        here[nxt] = cost + c
                        queue.append(nxt)
                continue
            nxt = (name, alt, dot + 1, origin)
            if not last:
                there = items[pos + 1]
                if sym in token:
                    if cost < there.get(nxt, budget + 1):
                        there[nxt] = cost
                elif spent < budget:
                    if cost + 1 < there.get(nxt, budget + 1):  # exchanged
                        there[nxt] = cost + 1
                    if cost + 1 < there.get(item, budget + 1):  # one too many
                        there[item] = cost + 1
            if spent < budget and cost + 1 < here.get(nxt, budget + 1):  # lost
                here[nxt] = cost + 1
                queue.append(nxt)
        if last:
            break
        if not items[pos + 1] and not budget and start not in ahead[pos + 1]:
            return None
    best = [ahead[o][start] + c + n - p for p in range(max(0, n - budget), n + 1) for (name, o), c in done[p].items() if name == start and start in ahead[o] and ahead[o][start] == o]
    cost = min(best, default=budget + 1)
    return cost if cost <= budget else None
