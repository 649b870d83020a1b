"""A combined deterministic automaton over bytes.

Rules' regular expressions become one nondeterministic automaton, subset construction and minimisation make it
deterministic, and its transition arrays read a text byte by byte for all rules at once. The syntax is the regular part:
literals, escapes (\\xHH, \\n, \\t), classes, groups, |, ?, *, +, {m}, {m,}, {m,n}.
"""

from __future__ import annotations

from collections import defaultdict

ANY = frozenset(range(256))


class _Parser:
    """Parses a pattern into a tree of ("set", bytes), ("cat", ...), ("or", ...), ("many", low, high, node)."""

    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def more(self, stop: str = "") -> bool:
        return self.i < len(self.s) and self.s[self.i] not in stop

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
            c = {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def klass(self) -> frozenset[int]:
        negate, found = self.s[self.i] == "^", set()
        self.i += negate
        while self.s[self.i] != "]":
            low = high = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            found |= set(range(low, high + 1))
        self.i += 1
        return ANY - found if negate else frozenset(found)

    def either(self):
        options = [self.sequence()]
        while self.more() and self.s[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    def sequence(self):
        parts = []
        while self.more("|)"):
            parts.append(self.repeated())
        return ("cat", *parts)

    def repeated(self):
        c = self.s[self.i]
        if c in "([":
            self.i += 1
        if c == "(":
            node = self.either()
            self.i += 1
        else:
            node = ("set", self.klass() if c == "[" else ANY - {10} if c == "." and self.take() else frozenset([self.char()]))
        while self.more() and self.s[self.i] in "?*+{":
            c = self.take()
            if c == "{":
                low, comma, high = self.s[self.i : self.s.index("}", self.i)].partition(",")
                self.i = self.s.index("}", self.i) + 1
                node = ("many", int(low), int(high) if high else None if comma else int(low), node)
            else:
                node = ("many", int(c == "+"), 1 if c == "?" else None, node)
        return node


def parse(pattern: str):
    p = _Parser(pattern)
    tree = p.either()
    if p.i < len(pattern):
        raise ValueError(f"unbalanced: {pattern}")
    return tree


def mirrored(tree):
    """The tree of the reversed language."""
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "many":
        return ("many", rest[0], rest[1], mirrored(rest[2]))
    parts = [mirrored(x) for x in rest]
    return (kind, *(reversed(parts) if kind == "cat" else parts))


class _Nfa:
    def __init__(self):
        self.steps: list[tuple[frozenset, int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.steps.append(None)
        self.empty.append([])
        return len(self.steps) - 1

    def add(self, tree, start: int) -> int:
        """Adds a tree from ``start``; its end state."""
        kind, *rest = tree
        if kind == "set":
            a, b = self.state(), self.state()
            self.empty[start].append(a)
            self.steps[a] = (rest[0], b)
            return b
        if kind == "cat":
            for x in rest:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in rest:
                self.empty[self.add(x, start)].append(end)
            return end
        low, high, node = rest
        for _ in range(low):
            start = self.add(node, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(node, loop)].append(loop)
            return loop
        ends = [start]
        for _ in range(high - low):
            ends.append(start := self.add(node, start))
        end = self.state()
        for e in ends:
            self.empty[e].append(end)
        return end


class Automaton:
    """``rows[s]`` is the transition array of state s: 256 next states by byte; ``accepts[s]`` a bit mask of rules.

    State 0 is the start. ``anywhere``: matches may begin at any byte, else at the first only; state -1 is none. With
    ``first_end`` nothing follows an accepting state, which keeps the automaton small.
    """

    def __init__(self, trees: list, anywhere: bool, first_end: bool = False):
        nfa, starts, ends = _Nfa(), [], {}
        for k, tree in enumerate(trees):
            starts.append(nfa.state())
            ends[nfa.add(tree, starts[-1])] = 1 << k
        classes = self._classes([s[0] for s in nfa.steps if s])
        first = self._closure(nfa, starts)
        number, order, table = {first: 0}, [first], []
        for subset in order:  # grows while it is read
            row = []
            if first_end and any(s in ends for s in subset):
                table.append([-1] * len(classes))
                continue
            moves = [nfa.steps[s] for s in subset if nfa.steps[s]]
            for _, byte in classes:
                to = [t for members, t in moves if byte in members]
                nxt = self._closure(nfa, to + starts if anywhere else to) if to or anywhere else None
                if nxt is None:
                    row.append(-1)
                    continue
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                row.append(number[nxt])
            table.append(row)
        masks = [0] * len(order)
        for i, subset in enumerate(order):
            for s in subset:
                masks[i] |= ends.get(s, 0)
        table, masks = self._minimal(table, masks)
        of = [0] * 256
        for c, (members, _) in enumerate(classes):
            for b in members:
                of[b] = c
        self.rows, self.accepts = [[row[of[b]] for b in range(256)] for row in table], masks

    @staticmethod
    def _closure(nfa: _Nfa, states) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += nfa.empty[s]
        return frozenset(seen)

    @staticmethod
    def _classes(sets: list[frozenset]) -> list[tuple[list[int], int]]:
        """Bytes that no set tells apart, with one of each."""
        sets, groups = list(dict.fromkeys(sets)), defaultdict(list)
        for b in range(256):
            groups[tuple(b in s for s in sets)].append(b)
        return [(members, members[0]) for members in groups.values()]

    @staticmethod
    def _minimal(table: list[list[int]], masks: list[int]):
        """Merges states that no text tells apart, by refining the partition until it is stable."""
        block = masks[:]
        while True:
            keys = [(block[s], *(block[t] if t >= 0 else -1 for t in row)) for s, row in enumerate(table)]
            names: dict = {}
            refined = [names.setdefault(k, len(names)) for k in keys]
            if len(names) == len(set(block)):
                break
            block = refined
        of: dict = {}
        for s, k in enumerate(refined):
            of.setdefault(k, s)  # the first state of a block stands for it; state 0 stays the first
        number = {s: i for i, s in enumerate(of.values())}
        return [[number[of[refined[t]]] if t >= 0 else -1 for t in table[s]] for s in of.values()], [masks[s] for s in of.values()]
