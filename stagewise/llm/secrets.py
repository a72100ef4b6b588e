"""Secret scan by one deterministic automaton for all rules.

Rules are regular expressions over bytes. All of them together become one automaton: an NFA each, subset construction over byte
classes, minimisation, a transition array. There are two: `starts` reads a text once from its end to its beginning, all rules at
a time, and marks each byte where some rule's match begins; `reads` goes forward from such a byte for as long as a match lives and
gives the longest. So matches are leftmost-longest and do not overlap within a kind, but may across kinds. A rule's `keep` decides
whether its match counts; one that fails still uses up its text.

`starts` walks a block of documents in many lanes at once. Each lane begins in the initial state, and where the lane before it
ended in another one the lane is walked again until both walks agree, so any length and content gives the exact states.

Every rule reads single bytes, and what a rule excludes may be part of a longer character. NULL and empty texts have no spans,
rows are independent, repeated rows get the same answer, a NULL doc_id stays. Columns other than doc_id and text are ignored. An
empty table gives no rows. Places count code points.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 23  # bytes of text walked together, a longer text alone
BETWEEN = 0xFF  # stands between texts: no byte of UTF-8, and every rule ends at it


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: str | None = None  # the match counts if it matches this, too
    either_case: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{6,}", either_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),  # a shorter run holds no longer one, so its least length may stand in the pattern
)
# Forms that vendors publish for their keys, beside the base kinds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----([A-Za-z0-9+/=\x0A\x0D]*-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY-----)?"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/@:\xFF]+:[^\x00-\x20/@\xFF]+@"),
)
RULES = BASE + ADDED


# Patterns


def parsed(pattern: str, either_case: bool = False) -> tuple:
    """Syntax tree of a pattern: ("set", bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most or None)."""
    at = 0

    def cases(chars: frozenset[int]) -> frozenset[int]:
        letters = {c ^ 32 for c in chars if 65 <= c & ~32 <= 90} if either_case else set()
        return chars | letters

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2:at], 16)
        return ord(c)

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] != "[":
            return "set", cases(frozenset({char()}))
        at += 1
        negated = pattern[at] == "^"
        at += negated
        held: set[int] = set()
        while pattern[at] != "]":
            low = char()
            high = low
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = char()
            held |= set(range(low, high + 1))
        at += 1
        found = cases(frozenset(held))
        return "set", frozenset(range(256)) - found if negated else found

    def repeated() -> tuple:
        nonlocal at
        node = one()
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1:end].partition(",")
                bounds = int(low), (int(high) if high else None) if comma else int(low)
                at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]
                at += 1
            node = "rep", node, *bounds
        return node

    def sequence() -> tuple:
        nodes = []
        while at < len(pattern) and pattern[at] not in "|)":
            nodes.append(repeated())
        return "cat", nodes

    def either() -> tuple:
        nonlocal at
        nodes = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            nodes.append(sequence())
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    tree = either()
    if at != len(pattern):
        raise ValueError(f"{pattern!r} cannot be read from place {at} on")
    return tree


class _Nfa:
    def __init__(self, backwards: bool):
        self.backwards = backwards
        self.free: list[list[int]] = []  # moves without a byte
        self.reads: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.reads.append(None)
        return len(self.free) - 1

    def add(self, tree: tuple, first: int) -> int:
        """Append a tree at a state; gives the state behind it."""
        kind, held, *bounds = tree
        if kind == "set":
            last = self.state()
            self.reads[first] = held, last
            return last
        if kind == "cat":
            for node in reversed(held) if self.backwards else held:
                first = self.add(node, first)
            return first
        last = self.state()
        if kind == "alt":
            for node in held:
                own = self.state()
                self.free[first].append(own)
                self.free[self.add(node, own)].append(last)
            return last
        least, most = bounds
        for _ in range(least):
            first = self.add(held, self._after(first))
        if most is None:
            loop = self._after(first)
            own = self._after(loop)
            self.free[self.add(held, own)].append(loop)
            self.free[loop].append(last)
        else:
            for _ in range(most - least):
                self.free[first].append(last)
                first = self.add(held, self._after(first))
            self.free[first].append(last)
        return last

    def _after(self, state: int) -> int:
        own = self.state()
        self.free[state].append(own)
        return own

    def closed(self, states: set[int]) -> frozenset[int]:
        held, todo = set(states), list(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in held:
                    held.add(other)
                    todo.append(other)
        return frozenset(held)


# Automata


@dataclass
class Automaton:
    """State 0 is the initial one. next[state, byte class], and the rules that accept in a state as bits."""

    classes: np.ndarray
    next: np.ndarray
    accepts: np.ndarray
    dead: int  # a state that nothing leaves and that accepts nothing, -1 if there is none


def compiled(patterns: list[tuple[str, bool]], backwards: bool, anywhere: bool) -> Automaton:
    """One minimal automaton of all patterns: subset construction, then classes of states that no text tells apart.

    `backwards` reads texts from their end, `anywhere` lets a match begin at every byte.
    """
    nfa = _Nfa(backwards)
    initial, bit_of = set(), {}
    for i, (pattern, either_case) in enumerate(patterns):
        first = nfa.state()
        initial.add(first)
        bit_of[nfa.add(parsed(pattern, either_case), first)] = 1 << i
    sets = list(dict.fromkeys(r[0] for r in nfa.reads if r))
    told = np.array([[b in s and b != BETWEEN for s in sets] for b in range(256)])
    told = np.concatenate([told, (np.arange(256) == BETWEEN)[:, None]], axis=1)
    _, sample, classes = np.unique(told, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)
    members = {s: [c for c, b in enumerate(sample) if told[b, i]] for i, s in enumerate(sets)}
    between = int(classes[BETWEEN])

    # Sets of states are whole numbers, one bit for each state.
    closed = [sum(1 << t for t in nfa.closed({s})) for s in range(len(nfa.free))]
    moves = {s: (members[r[0]], closed[r[1]]) for s, r in enumerate(nfa.reads) if r}
    reading = sum(1 << s for s in moves)
    start = 0
    for s in initial:
        start |= closed[s]
    number, order, rows = {start: 0}, [start], []
    for states in order:  # grows as new sets of states are met
        row = [start if anywhere else 0] * len(sample)
        rest = states & reading
        while rest:
            s = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            chars, reached = moves[s]
            for c in chars:
                row[c] |= reached
        row[between] = start if anywhere else 0
        for reached in row:
            if reached not in number:
                number[reached] = len(order)
                order.append(reached)
        rows.append([number[reached] for reached in row])
    accepts = np.array([sum(bit for s, bit in bit_of.items() if states >> s & 1) for states in order], np.int64)
    table = np.array(rows)

    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # Number the classes so that the initial one is 0.
    firsts = np.unique(block, return_index=True)[1]
    place = np.argsort(np.argsort(np.where(np.arange(len(firsts)) == block[0], -1, firsts)))
    keep = np.empty(len(firsts), np.int64)
    keep[place] = firsts
    table, accepts = place[block[table[keep]]], accepts[keep]
    still = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (accepts == 0))
    return Automaton(classes.astype(np.uint8), table, accepts, int(still[0]) if len(still) else -1)


@lru_cache(maxsize=4)
def automata(rules: tuple[Rule, ...]) -> tuple[Automaton, Automaton]:
    """`starts` over the patterns, and `reads` over patterns (bit i) and what matches must be kept by (bit i + rules)."""
    patterns = [(r.pattern, r.either_case) for r in rules]
    kept = [(r.keep or r.pattern, r.either_case) for r in rules]
    return compiled(patterns, True, True), compiled(patterns + kept, False, False)


def walked(machine: Automaton, symbols: np.ndarray) -> np.ndarray:
    """State behind each symbol (byte classes), from the initial state on."""
    n, k = len(symbols), machine.next.shape[1]
    width = max(64, int(np.sqrt(n)) // 2)
    lanes = -(-n // width)
    grid = np.zeros(lanes * width, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    table = (machine.next * k).astype(np.int32).reshape(-1)  # states times classes, so a step is one look-up
    out = np.empty((width, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for j in range(width):
        state = table[state + grid[j]]
        out[j] = state
    begins = np.zeros(lanes, np.int32)
    while True:
        wanted = np.concatenate([np.zeros(1, np.int32), out[-1, :-1]])
        at = np.flatnonzero(wanted != begins)
        if not len(at):
            return out.T.reshape(-1)[:n] // k
        state = begins[at] = wanted[at]
        for j in range(width):
            state = table[state + grid[j, at]]
            other = state != out[j, at]
            if not other.all():
                at, state = at[other], state[other]
                if not len(at):
                    break
            out[j, at] = state


def _matches(data: bytes, rules: tuple[Rule, ...], machines: tuple[Automaton, Automaton]) -> list[tuple[int, int, int]]:
    """(start byte, rule, end byte) of all kept matches, by start and rule. Texts in `data` have BETWEEN between them."""
    starts, reads = machines
    array = np.frombuffer(data, np.uint8)
    bits = starts.accepts[walked(starts, starts.classes[array[::-1]])]
    hit = np.flatnonzero(bits)
    bits, hit = bits[hit][::-1], len(array) - 1 - hit[::-1]
    rows, classes, accepts = reads.next.tolist(), bytes(reads.classes.tolist()), reads.accepts.tolist()
    found = []
    for i in range(len(rules)):
        own = hit[(bits >> i) & 1 == 1].tolist()
        match, kept, at = 1 << i, 1 << (i + len(rules)), 0
        while at < len(own):
            first, state, end, good = own[at], 0, 0, False
            place = first
            while place < len(data):
                state = rows[state][classes[data[place]]]
                if state == reads.dead:
                    break
                place += 1
                if accepts[state] & match:
                    end, good = place, bool(accepts[state] & kept)
            if good:
                found.append((first, i, end))
            at = bisect_left(own, end, at + 1)
    return sorted(found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, spans (kind, start, end; ordered by start, then as the rules are listed)."""
    machines = automata(tuple(rules))  # a few hundred states, the same for every table
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            spans: list[list[dict]] = [[] for _ in texts]
            a = 0
            while a < len(texts):
                b, held = a + 1, len(texts[a])
                while b < len(texts) and held + len(texts[b]) <= BLOCK_BYTES:
                    held += len(texts[b])
                    b += 1
                data = bytes([BETWEEN]).join(texts[a:b]) + bytes([BETWEEN])
                matches = _matches(data, rules, machines)
                if matches:
                    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                    of = np.searchsorted(firsts, [m[0] for m in matches], "right") - 1
                    for doc, (start, i, end) in zip(of.tolist(), matches):
                        base = points[firsts[doc]]
                        spans[a + doc].append({"kind": kinds[i], "start": int(points[start] - base), "end": int(points[end] - base)})
                a = b
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
