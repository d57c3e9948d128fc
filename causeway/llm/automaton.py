"""Regex rules to one minimal deterministic automaton over bytes.

Rules are parsed to a nondeterministic automaton, made deterministic by subset construction over byte classes and minimised
by partition refinement. ``Automaton.scan`` steps through many stretches of a byte stream at once: every stretch starts
from the root state, and those whose predecessor ended elsewhere are stepped again until the states agree.

Syntax: literals, ``\\xHH`` and escaped characters, ``[...]`` sets with ranges, ``(...|...)``, ``(?i:...)``, and the
repetitions ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRETCH = 256

Node = tuple  # ("set", frozenset) | ("cat", [nodes]) | ("alt", [nodes]) | ("rep", node, least, most or None)


class _Parser:
    def __init__(self, pattern: str) -> None:
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or expected and c != expected:
            raise ValueError(f"{self.text!r}: expected {expected or 'more'} at {self.at}")
        self.at += 1
        return c

    def parse(self) -> Node:
        node = self.choice()
        if self.peek():
            raise ValueError(f"{self.text!r}: unexpected {self.peek()} at {self.at}")
        return node

    def choice(self) -> Node:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self) -> Node:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node: Node) -> Node:
        while (c := self.peek()) and c in "?*+{":
            self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take("}")
                low, comma, high = body.partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            node = ("rep", node, least, most)
        return node

    def symbol(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
        return ord(c)

    def folded(self, symbols: set[int]) -> frozenset[int]:
        if self.fold:
            symbols |= {s ^ 32 for s in symbols if 65 <= s & ~32 <= 90}
        return frozenset(symbols)

    def atom(self) -> Node:
        c = self.peek()
        if c == "(":
            self.take()
            before = self.fold
            if self.text.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            node = self.choice()
            self.take(")")
            self.fold = before
            return node
        if c == "[":
            self.take()
            symbols: set[int] = set()
            while self.peek() != "]":
                low = self.symbol()
                if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                    self.take()
                    symbols |= set(range(low, self.symbol() + 1))
                else:
                    symbols.add(low)
            self.take("]")
            return ("set", self.folded(symbols))
        return ("set", self.folded({self.symbol()}))


def reversed_node(node: Node) -> Node:
    if node[0] == "cat":
        return ("cat", [reversed_node(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [reversed_node(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", reversed_node(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: Node, start: int) -> int:
        """Build ``node`` from ``start`` on; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for option in node[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(option, begin)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            begin, end = self.state(), self.state()
            self.empty[start].append(begin)
            self.empty[begin].append(end)
            self.empty[self.add(inner, begin)].append(begin)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """``table[state * classes + byte_class]`` is the next state times ``classes``; accepting states come last."""

    byte_class: np.ndarray
    table: np.ndarray
    classes: int
    accept: np.ndarray
    first_accepting: int
    dead: int

    def scan(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends (exclusive) at which some rule matches, and the bit masks of the rules."""
        n = len(stream)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = -(-n // STRETCH)
        padded = np.zeros(rows * STRETCH, np.uint8)
        padded[:n] = stream
        symbols = np.ascontiguousarray(self.byte_class[padded].reshape(rows, STRETCH).T)
        states = np.empty((STRETCH, rows), np.int32)
        state = np.zeros(rows, np.int32)
        for k in range(STRETCH):
            np.take(self.table, state + symbols[k], out=state)
            states[k] = state
        started = np.zeros(rows, np.int32)
        while True:
            needed = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
            wrong = np.flatnonzero(needed != started)
            if not len(wrong):
                break
            started[wrong] = needed[wrong]
            state = needed[wrong]
            for k in range(STRETCH):
                state = self.table[state + symbols[k, wrong]]
                other = state != states[k, wrong]
                wrong, state = wrong[other], state[other]
                if not len(wrong):
                    break
                states[k, wrong] = state
        at = np.flatnonzero(np.ascontiguousarray(states.T).ravel()[:n] >= self.first_accepting * self.classes)
        return at + 1, self.accept[states[at % STRETCH, at // STRETCH] // self.classes]

    def first_end(self, data: bytes, start: int, stop: int) -> int | None:
        """The first end in (start, stop] at which a rule matches, stepping from the root at ``start``."""
        state, floor = 0, self.first_accepting * self.classes
        for k in range(start, stop):
            state = self.table[state + self.byte_class[data[k]]]
            if state >= floor:
                return k + 1
        return None

    def furthest_back(self, data: bytes, end: int, stop: int) -> int | None:
        """Of a reversed rule: the smallest start in [stop, end) of a match that ends at ``end``."""
        state, best, floor = 0, None, self.first_accepting * self.classes
        for k in range(end - 1, stop - 1, -1):
            state = self.table[state + self.byte_class[data[k]]]
            if state >= floor:
                best = k
            elif state == self.dead:
                break
        return best


def compile_rules(patterns: list[str], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """One automaton for all rules; bit i of an accept mask is rule i. ``anywhere`` lets matches begin at any byte."""
    nfa, ends = _Nfa(), {}
    root = nfa.state()
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))
    for bit, pattern in enumerate(patterns):
        node = _Parser(pattern).parse()
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[nfa.add(reversed_node(node) if backwards else node, begin)] = 1 << bit
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    member = np.array([[b in s for b in range(256)] for s in sets]).T
    _, first, byte_class = np.unique(member, axis=0, return_index=True, return_inverse=True)
    byte_class, samples = byte_class.ravel(), first.tolist()
    closed: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closed:
            seen, todo = {state}, [state]
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closed[state] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
        return closed[state]

    steps = [[[t for s, t in moves if b in s] for b in samples] for moves in nfa.moves]
    start = closure(root)
    numbers, subsets, rows = {start: 0}, [start], []
    for subset in subsets:  # grows while it is walked
        row = []
        for c in range(len(samples)):
            target = frozenset().union(*(closure(t) for x in subset for t in steps[x][c]))
            if target not in numbers:
                numbers[target] = len(subsets)
                subsets.append(target)
            row.append(numbers[target])
        rows.append(row)
    table = np.array(rows, np.int64)
    accept = np.array([sum({ends[x] for x in subset if x in ends}) for subset in subsets], np.int64)
    block = np.unique(accept, return_inverse=True)[1].ravel()
    while True:  # refine until states of a block agree on the blocks they lead to
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, sample = np.unique(block, return_index=True)
    order = sorted(range(len(sample)), key=lambda b: (accept[sample[b]] != 0, b != block[0], b))
    if order[0] != block[0]:
        raise ValueError("a rule matches the empty text")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    table, accept = rank[block[table[sample[order]]]], accept[sample[order]]
    dead = next((s for s in range(len(order)) if not accept[s] and (table[s] == s).all()), -1)
    classes = len(samples)
    return Automaton(byte_class.astype(np.int32), (table * classes).astype(np.int32).ravel(), classes, accept, int((accept == 0).sum()), dead * classes)
