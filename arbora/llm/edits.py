"""Least numbers of edits without a budget, for units of any length.

The chart is that of ``chart.least_edits``: items with an origin and the least number of edits (a token lost, added
or exchanged) inside their part of the input, completed into whatever waits for their name at their origin.  Three
things make it fit for long units and many edits:

* Rules are compiled to automata.  Names that do not contain themselves are written into the place of their use,
  repetitions become loops, and states with equal futures are merged, so an item is (state, call); calls are left
  only for the few names that nest without brackets, and a call at the end of a rule keeps its caller's origin.
* A pass from the right gives, for every state and position, the least edits to the end if a name could return to
  any place of its use: never more than the truth.  Prices on calls, given back on return, raise it where it says too little.
* Items are taken by edits so far plus that bound, the furthest first, until the whole unit is done.  The bound never
  drops by more than a step costs, so the first number found is the least.

Where the bound meets the truth the time is in proportion to the unit; at worst it is that of the chart, cubic.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

import numpy as np

from arbora.llm.chart import Grammar

#: Bounds are kept for one position in ``_BLOCK`` and made again for a block when asked for; ``_BLOCKS`` blocks stay.
_BLOCK, _BLOCKS = 256, 64
_FAR = 1 << 29
#: Edits are counted in sixteenths, so that a price can be a part of an edit.
_UNIT = 16
#: How prices are found (this changes only the time): steps after which others are looked for (and 100 a token), tokens that
#: are looked at, turns, and how many sets of prices are kept.
_STEPS, _SAMPLE, _TURNS, _LEARNT = 20_000, 400, 24, 8


def _loop(g: Grammar, name: str) -> tuple[str, bool] | None:
    """(what is repeated, whether it can be left out) if the rule is a repetition."""
    alts = g.rules[name]
    if len(alts) == 2 and len(alts[1]) == 2 and alts[1][0] == name and alts[1][1] != name and alts[0] in ((), (alts[1][1],)):
        return alts[1][1], not alts[0]
    return None


def _uses(g: Grammar) -> dict[str, set[str]]:
    return {n: {s for alt in alts for s in alt if s in g.rules and not (s == n and _loop(g, n))} for n, alts in g.rules.items()}


def _components(graph: dict[str, set[str]]) -> list[set[str]]:
    """Sets of names that contain each other."""
    reach: dict[str, set[str]] = {}
    for n in graph:
        seen: set[str] = set()
        work = list(graph[n])
        while work:
            x = work.pop()
            if x not in seen:
                seen.add(x)
                work.extend(graph[x])
        reach[n] = seen
    out, used = [], set()
    for n in graph:
        if n in reach[n] and n not in used:
            out.append({m for m in reach[n] if n in reach[m]})
            used |= out[-1]
    return out


def _nesting(g: Grammar) -> set[str]:
    """Names that stay calls, so that no other name contains itself."""
    graph, kept = _uses(g), set()
    while parts := _components(graph):
        for part in parts:
            uses = {n: sum(n in graph[m] for m in part) * len(graph[n] & part) for n in part}
            best = max(sorted(part), key=lambda n: uses[n] + 1000 * (n in graph[n]))
            kept.add(best)
        graph = {n: u - kept for n, u in graph.items() if n not in kept}
    return kept


class _Automaton:
    """States of one name: per state whether it ends the name, and (terminal or call, state) steps."""

    def __init__(self, g: Grammar, name: str, kept: set[str]):
        self.g, self.kept = g, kept
        self.empty: list[set[int]] = []
        self.steps: list[list[tuple[str, int]]] = []
        begin, end = self._node(), self._node()
        self._alternatives(name, begin, end)
        self._without_empty_steps(begin, end)

    def _node(self) -> int:
        self.empty.append(set())
        self.steps.append([])
        return len(self.steps) - 1

    def _alternatives(self, name: str, a: int, b: int) -> None:
        loop = _loop(self.g, name)
        if loop:
            what, none = loop
            mid = self._node()
            if none:
                self.empty[a].add(mid)
            else:
                self._part(what, a, mid)
            self._part(what, mid, mid)
            self.empty[mid].add(b)
            return
        for alt in self.g.rules[name]:
            at = a
            for s in alt:
                to = self._node()
                self._part(s, at, to)
                at = to
            self.empty[at].add(b)

    def _part(self, s: str, a: int, b: int) -> None:
        if s in self.g.rules and s not in self.kept:
            inner, out = self._node(), self._node()
            self.empty[a].add(inner)
            self._alternatives(s, inner, out)
            self.empty[out].add(b)
        else:
            self.steps[a].append((s, b))

    def _without_empty_steps(self, begin: int, end: int) -> None:
        closed: dict[int, tuple[bool, frozenset[tuple[str, int]]]] = {}
        work = [begin]
        while work:
            n = work.pop()
            if n in closed:
                continue
            seen, todo = {n}, [n]
            while todo:
                for m in self.empty[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            steps = frozenset(s for m in seen for s in self.steps[m])
            closed[n] = (end in seen, steps)
            work.extend(to for _, to in steps)
        group = {n: int(final) for n, (final, _) in closed.items()}
        count = 0
        while True:  # states with equal futures become one
            names: dict[tuple, int] = {}
            new = {n: names.setdefault((group[n], final, frozenset((s, group[to]) for s, to in steps)), len(names)) for n, (final, steps) in closed.items()}
            group = new
            if len(names) == count:
                break
            count = len(names)
        self.start = group[begin]
        self.final = [False] * count
        self.out: list[set[tuple[str, int]]] = [set() for _ in range(count)]
        for n, (final, steps) in closed.items():
            self.final[group[n]] = final
            self.out[group[n]] |= {(s, group[to]) for s, to in steps}
        del self.empty, self.steps


class _Bound:
    """Least edits (times ``_UNIT``) to the end if a name could return to any place of its use, at a price.

    A call costs its price and the return gives it back, so in truth prices cancel out, and the bound holds under
    any of them; a name that returns where nobody called it has to pay, or is paid for, what the other end was not.
    """

    def __init__(self, net: Network, prices: dict[tuple[int, int, int], int]):
        self.net, self.prices = net, prices
        steps: dict[tuple[int, int], int] = {pair: _UNIT for pair in net.pairs}
        for q, first, lasts, r in net.sites:
            price = prices.get((q, first, r), 0)
            for to, c in [((q, first), price), *(((e, r), -price) for e in lasts)]:
                steps[to] = min(c, steps.get(to, c))
        order = sorted(steps)
        self.into = np.array([r for _, r in order], dtype=np.int64)
        self.costs = np.array([steps[x] for x in order], dtype=np.int32)
        self.sources, self.cuts = np.unique(np.array([q for q, _ in order], dtype=np.int64), return_index=True)

    def before(self, then: np.ndarray | None, token: frozenset[str] | None) -> np.ndarray:
        """The bounds of all states before a token, from those after it; at the end without any."""
        net = self.net
        if then is None:
            least = net.ends.copy()
        else:
            cost = net.costs.get(token)
            if cost is None:
                cost = net.costs[token] = np.array([0 if not token.isdisjoint(t) else _UNIT for t in net.terminals], dtype=np.int32)
            least = then + _UNIT
            if len(net.into):
                taken = np.minimum.reduceat(then[net.into] + cost, net.cuts)
                least[net.sources] = np.minimum(least[net.sources], taken)
        while len(self.into):  # steps that read no token
            before = least[self.sources]
            now = np.minimum(np.minimum.reduceat(least[self.into] + self.costs, self.cuts), before)
            if np.array_equal(now, before):
                break
            least[self.sources] = now
        return np.minimum(least, _FAR)

    def marks(self, tokens: list[frozenset[str]]) -> dict[int, np.ndarray]:
        """The bounds at every ``_BLOCK``-th position and at the end."""
        n, now, out = len(tokens), None, {}
        for pos in range(n, -1, -1):
            now = self.before(now, tokens[pos] if pos < n else None)
            if pos % _BLOCK == 0 or pos == n:
                out[pos] = now
        return out

    def excess(self, tokens: list[frozenset[str]]) -> dict[tuple[int, int, int], int]:
        """How many times more than it returns each call begins on a cheapest way through the tokens."""
        net, n = self.net, len(tokens)
        rows, now = [], None
        for pos in range(n, -1, -1):
            now = self.before(now, tokens[pos] if pos < n else None)
            rows.append(now.tolist())
        rows.reverse()
        back: dict[tuple[int, int], tuple] = {(0, net.start): ()}
        work = [(0, net.start)]
        at = work[0]
        while work:
            at = pos, q = work.pop()
            if pos == n and net.ends[q] == 0:
                break
            value = rows[pos][q]
            ways = [((pos, r), _UNIT, None, 0) for r in net.after[q]]
            if pos < n:
                ways.append(((pos + 1, q), _UNIT, None, 0))
                ways += [((pos + 1, r), _UNIT, None, 0) for r in net.after[q]]
            ways += [((pos, first), self.prices.get((q, first, r), 0), (q, first, r), 1) for first, r, _ in net.calls[q]]
            ways += [((pos, r), -self.prices.get((p, first, r), 0), (p, first, r), -1) for p, first, r in net.returns.get(q, ())]
            if pos < n:
                ways += [((pos + 1, r), 0, None, 0) for t in tokens[pos] for r in net.by_terminal[q].get(t, ())]
            for to, cost, site, count in ways:
                if to not in back and cost + rows[to[0]][to[1]] == value:
                    back[to] = at, site, count
                    work.append(to)
        more: dict[tuple[int, int, int], int] = defaultdict(int)
        while back[at]:
            at, site, count = back[at]
            if count:
                more[site] += count
        return more


class Network:
    """The automata that a name needs."""

    def __init__(self, g: Grammar, start: str, automata: dict[str, _Automaton], kept: set[str]):
        names, base = [start], {}
        total = 0
        for n in names:
            if n not in automata:
                automata[n] = _Automaton(g, n, kept)
            base[n] = total
            total += len(automata[n].out)
            names.extend(sorted({s for out in automata[n].out for s, _ in out if s in kept} - set(names)))
        self.size = total
        self.start = base[start] + automata[start].start
        self.final = [f for n in names for f in automata[n].final]
        #: Per state: terminal -> states, all states after a terminal, (first state of the called, state after, whether nothing follows).
        self.by_terminal: list[dict[str, tuple[int, ...]]] = []
        self.after: list[tuple[int, ...]] = []
        self.calls: list[tuple[tuple[int, int, bool], ...]] = []
        sites: set[tuple[int, int, tuple[int, ...], int]] = set()  # (state, first and last states of the called, state after)
        pairs: dict[tuple[int, int], set[str]] = defaultdict(set)
        for n in names:
            b, a = base[n], automata[n]
            for q, out in enumerate(a.out):
                to: dict[str, set[int]] = defaultdict(set)
                calls = []
                for s, r in sorted(out):
                    if s in kept:
                        first = base[s] + automata[s].start
                        calls.append((first, b + r, a.final[r] and not a.out[r]))
                        sites.add((b + q, first, tuple(base[s] + e for e, f in enumerate(automata[s].final) if f), b + r))
                    else:
                        to[s].add(b + r)
                        pairs[b + q, b + r].add(s)
                self.by_terminal.append({s: tuple(sorted(r)) for s, r in to.items()})
                self.after.append(tuple(sorted({r for rs in to.values() for r in rs})))
                self.calls.append(tuple(calls))
        order = sorted(pairs)
        self.terminals = [pairs[p] for p in order]
        self.into = np.array([r for _, r in order], dtype=np.int64)
        sources = np.array([q for q, _ in order], dtype=np.int64)
        self.sources, self.cuts = np.unique(sources, return_index=True)
        self.costs: dict[frozenset[str], np.ndarray] = {}
        self.sites, self.pairs = sorted(sites), order
        called = {first for _, first, _, _ in sites} | {r for _, _, _, r in sites}
        calling = {q for q, _, _, _ in sites}
        #: Calls with a token before each, and with one after each return: there a price can be below or above nothing.
        #: Half an edit each way is the most, as one token can stand between a return and a call.
        self.entered = {(q, first, r) for q, first, _, r in self.sites if q not in called and (not self.final[r] or self.after[r] or self.calls[r])}
        self.left = {(q, first, r) for q, first, _, r in self.sites if not self.final[r] and r not in calling and self.after[r]}
        #: Calls of one kind (the same name before the same tokens) have one price.
        self.kind_of = {(q, first, r): (first, self.final[r], tuple(sorted(self.by_terminal[r]))) for q, first, _, r in self.sites}
        self.kinds: dict[tuple, set[tuple[int, int, int]]] = defaultdict(set)
        for site, kind in self.kind_of.items():
            self.kinds[kind].add(site)
        self.returns: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for q, first, lasts, r in self.sites:
            for e in lasts:
                self.returns[e].append((q, first, r))
        self.bounds: list[_Bound] = []
        self.ends = np.where([f and base[start] <= q < base[start] + len(automata[start].out) for q, f in enumerate(self.final)], 0, _FAR).astype(np.int32)

    def least_edits(self, tokens: list[frozenset[str]]) -> int:
        """The least number of edits that make the tokens a word of the name."""
        if not self.bounds:
            self.bounds.append(_Bound(self, {}))
        bound = self.bounds[0]
        marks = bound.marks(tokens)
        if marks[0][self.start] >= _FAR // 2:
            raise ValueError("the name has no word")
        most = _STEPS + len(tokens) * 100
        got = self._search(tokens, bound, marks, most)
        if got is None and len(self.bounds) > 1:  # the plain bound says too little
            got = self._search(tokens, *self._best(tokens), most)
        if got is None:
            self._learn(tokens[:_SAMPLE])
            got = self._search(tokens, *self._best(tokens), None)
        return got

    def _best(self, tokens: list[frozenset[str]]) -> tuple[_Bound, dict[int, np.ndarray]]:
        return max(((b, b.marks(tokens)) for b in self.bounds), key=lambda x: x[1][0][self.start])

    def _learn(self, tokens: list[frozenset[str]]) -> None:
        """Looks for prices with a higher bound: a call that begins more often than it ends gets dearer, and the other way round."""
        best, marks = self._best(tokens)
        most = marks[0][self.start]
        for _ in range(_TURNS):
            more = best.excess(tokens)
            by_kind: dict[tuple, int] = defaultdict(int)
            for site, d in more.items():
                by_kind[self.kind_of[site]] += d
            new = None
            for kind, d in sorted(by_kind.items(), key=lambda x: -abs(x[1])):
                sites = self.kinds[kind] & (self.entered | self.left)
                old = best.prices.get(next(iter(sites)), 0) if sites else 0
                for step in (_UNIT // 2, _UNIT // 4, _UNIT // 8):
                    price = old + (step if d > 0 else -step)
                    if not d or not sites or price < 0 and not sites <= self.entered or price > 0 and not sites <= self.left or abs(price) > _UNIT // 2:
                        continue
                    now = _Bound(self, {**best.prices, **dict.fromkeys(sites, price)})
                    value = now.marks(tokens)[0][self.start]
                    if value > most:
                        new, most = now, value
                        break
                if new:
                    break
            if new is None:
                break
            best = new
        if best not in self.bounds:
            if len(self.bounds) > _LEARNT:
                del self.bounds[1]
            self.bounds.append(best)

    def _search(self, tokens: list[frozenset[str]], bound: _Bound, marks: dict[int, np.ndarray], most: int | None) -> int | None:
        """The least number of edits; None if it is not found in ``most`` steps."""
        n = len(tokens)
        blocks: dict[int, list[array]] = {}

        def bounds(pos: int) -> array:
            number = pos // _BLOCK
            block = blocks.get(number)
            if block is None:
                if len(blocks) >= _BLOCKS:
                    del blocks[next(iter(blocks))]
                last = min(n, (number + 1) * _BLOCK)
                row, rows = marks[last], []
                for p in range(last - 1, number * _BLOCK - 1, -1):
                    row = bound.before(row, tokens[p])
                    rows.append(array("i", row.tobytes()))
                rows.reverse()
                if last == n:
                    rows.append(array("i", marks[n].tobytes()))
                block = blocks[number] = rows
            return block[pos - number * _BLOCK]

        final, by_terminal, after, calls = self.final, self.by_terminal, self.after, self.calls
        call_of: dict[tuple[int, int], int] = {(-1, 0): 0}
        ahead = [0]  # edits before a call begins
        waits: list[dict[int, int]] = [{}]
        done: list[dict[int, int]] = [{}]
        # An item (call, state, position) is one number, and so is a queue's entry: item, edits inside, whether it is taken up again.
        size, width = self.size, n + 1
        shift = (2 * _UNIT * (n + 1000)).bit_length()
        low = (1 << shift) - 1
        items: dict[int, int] = {}
        queues: dict[int, list[int]] = defaultdict(list)
        prices = bound.prices
        level = bounds(0)[self.start]
        queues[level].append((self.start * width << shift) << 1)
        steps = 0
        while True:
            queue = queues[level]
            if not queue:
                del queues[level]
                level = min(queues)
                continue
            entry = queue.pop()
            inside = entry >> 1 & low
            item = entry >> 1 >> shift
            old = items.get(item, _FAR)
            if old < inside or old == inside and not entry & 1:
                continue
            items[item] = inside
            steps += 1
            if steps == most:
                return None
            rest, pos = divmod(item, width)
            call, q = divmod(rest, size)
            base = call * size
            # Steps that raise the sum wait until it is their turn; the item is then taken up again.
            edits, more = ahead[call] + inside, inside + _UNIT
            here = bounds(pos)
            later = _FAR
            if final[q]:
                if not call:
                    if pos == n:
                        return inside // _UNIT
                elif inside < done[call].get(pos, _FAR):
                    done[call][pos] = inside
                    for key, c in waits[call].items():
                        x, c = key * width + pos, c + inside
                        if c < items.get(x, _FAR):
                            up, r = divmod(key, size)
                            queues[ahead[up] + c + here[r]].append((x << shift | c) << 1)
            for first, r, tail in calls[q]:
                price = prices.get((q, first, r), 0)
                f = edits + price + here[first]
                if f > level:
                    later = min(later, f)
                elif tail:
                    x = (base + first) * width + pos
                    if inside < items.get(x, _FAR):
                        queue.append((x << shift | inside) << 1)
                else:
                    k = call_of.get((first, pos))
                    if k is None:
                        k = call_of[first, pos] = len(ahead)
                        ahead.append(edits + price)
                        waits.append({})
                        done.append({})
                        queue.append(((k * size + first) * width + pos << shift) << 1)
                    key = base + r
                    if inside < waits[k].get(key, _FAR):
                        waits[k][key] = inside
                        for p, c in done[k].items():
                            x = key * width + p
                            if inside + c < items.get(x, _FAR):
                                queues[edits + c + bounds(p)[r]].append((x << shift | inside + c) << 1)
            for r in after[q]:  # a token was lost
                f = edits + _UNIT + here[r]
                if f > level:
                    later = min(later, f)
                elif more < items.get(x := (base + r) * width + pos, _FAR):
                    queue.append((x << shift | more) << 1)
            if pos < n:
                there = bounds(pos + 1)
                f = edits + _UNIT + there[q]
                if f > level:  # one too many
                    later = min(later, f)
                elif more < items.get(item + 1, _FAR):
                    queue.append((item + 1 << shift | more) << 1)
                for r in after[q]:  # exchanged
                    f = edits + _UNIT + there[r]
                    if f > level:
                        later = min(later, f)
                    elif more < items.get(x := (base + r) * width + pos + 1, _FAR):
                        queue.append((x << shift | more) << 1)
                for t in tokens[pos]:
                    for r in by_terminal[q].get(t, ()):
                        f = edits + there[r]
                        if f > level:
                            later = min(later, f)
                        elif inside < items.get(x := (base + r) * width + pos + 1, _FAR):
                            queue.append((x << shift | inside) << 1)
            if later < _FAR // 2:
                queues[later].append(entry | 1)


class Networks:
    """The networks of a grammar, each made when its name is first asked for."""

    def __init__(self, g: Grammar):
        self.g = g
        self.kept = _nesting(g)
        self.automata: dict[str, _Automaton] = {}
        self.made: dict[str, Network] = {}

    def least_edits(self, start: str, tokens: list[frozenset[str]]) -> int:
        net = self.made.get(start)
        if net is None:
            net = self.made[start] = Network(self.g, start, self.automata, self.kept)
        return net.least_edits(tokens)
