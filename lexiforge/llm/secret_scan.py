"""Secret scans by one combined deterministic automaton.

The rules' regular expressions are compiled together: Thompson's construction,
subset construction over classes of bytes, and minimisation, into one array of
transitions. Texts are cut into stretches, and numpy runs the automaton over
thousands of them at once, one table lookup per byte for all rules. A byte after
which every state is the start state gives a cut that no match crosses. Where no
such byte comes, a stretch is cut anywhere and begun in the start state on
trial; then the state that really leads into it is followed until both agree,
mostly a few bytes. Stretches that a match may cross are put together again, and
those where a rule accepts are read by that rule's own automaton, which gives
leftmost longest spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, text_buffers

#: Stretches are cut at the first possible byte after this many.
STRETCH = 512


@dataclass(frozen=True)
class Rule:
    """A kind of secret. keep is a full-match pattern that a found span must pass, or None."""

    kind: str
    pattern: str
    keep: str | None = None


#: The base rules in their order, then those this scan adds. Patterns over bytes; (?i:...) ignores the case of A-Z.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


class _Parser:
    """Regular expressions over bytes: literals, classes, groups, | ? * + {m,n} and (?i:...)."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self):
        node = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return node

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self, n: int = 1) -> str:
        out = self.p[self.i : self.i + n]
        self.i += n
        return out

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                low, comma, high = self.take(self.p.index("}", self.i) - self.i).partition(",")
                self.take()
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("times", node, least, most)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.p.startswith("?i:", self.i):
                self.take(3)
                self.fold = True
            elif self.p.startswith("?:", self.i):
                self.take(2)
            node = self.alternatives()
            self.fold = before
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            return node
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c in "*+?{)":
            raise ValueError(f"unexpected {c!r} in {self.p!r}")
        return ("set", self.folded({self.byte(c)}))

    def byte(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take(2), 16)
            c = {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)
        if ord(c) > 127:
            raise ValueError("rules are over ASCII")
        return ord(c)

    def members(self) -> frozenset:
        negated = self.peek() == "^"
        if negated:
            self.take()
        out: set[int] = set()
        while self.peek() != "]":
            low = self.byte(self.take())
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                out |= set(range(low, self.byte(self.take()) + 1))
            else:
                out.add(low)
        self.take()
        return frozenset(range(256)) - self.folded(out) if negated else self.folded(out)

    def folded(self, members: set) -> frozenset:
        if self.fold:
            members = members | {b ^ 32 for b in members if chr(b).isalpha() and b < 128}
        return frozenset(members)


@dataclass
class _Nfa:
    empty: list = field(default_factory=list)  # states reached without a byte
    moves: list = field(default_factory=list)  # (members, state) or None

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """The end state of node, begun at start."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            at = self.state()
            self.empty[start].append(at)
            self.moves[at] = (node[1], end)
            return end
        if kind == "seq":
            for part in node[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "or":
            for option in node[1]:
                self.empty[self.add(option, start)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start)
                self.empty[start].append(end)
        return end


class Automaton:
    """The minimal automaton of some patterns.

    step[state * classes + byte_class] is the next state times classes; accepts[state]
    has bit k where pattern k accepts. A search automaton looks for matches that
    begin anywhere; else state 0 is dead and matching begins at begin.
    """

    def __init__(self, patterns: Sequence[str], search: bool):
        nfa, finals, root = _Nfa(), {}, None
        root = nfa.state()
        for k, pattern in enumerate(patterns):
            first = nfa.state()
            nfa.empty[root].append(first)
            finals[nfa.add(_Parser(pattern).parse(), first)] = 1 << k
        sets = {m[0] for m in nfa.moves if m}
        kinds: dict = {}
        self.byte_class = np.zeros(256, np.uint8)
        for b in range(256):
            self.byte_class[b] = kinds.setdefault(tuple(b in s for s in sets), len(kinds))
        n = self.classes = len(kinds)
        sample = [int(np.flatnonzero(self.byte_class == c)[0]) for c in range(n)]

        def closed(state: int) -> frozenset:
            """The states with moves, and the final ones, that are reached without a byte."""
            out, todo = {state}, [state]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(s for s in out if nfa.moves[s] or s in finals)

        reached = [[closed(m[1]) if m and b in m[0] else frozenset() for m in nfa.moves] for b in sample]
        always = closed(root)
        start = always
        names, order, table = {start: 0}, [start], []
        for states in order:
            row = []
            for by_state in reached:
                to = (always if search else frozenset()).union(*(by_state[s] for s in states))
                if to not in names:
                    names[to] = len(order)
                    order.append(to)
                row.append(names[to])
            table.append(row)
        accepts = np.array([np.bitwise_or.reduce([finals.get(s, 0) for s in states] or [0]) for states in order], np.int64)
        step, group = np.array(table, np.int64), None
        # Moore's refinement: states stay together while they accept alike and move to the same groups.
        _, group = np.unique(accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == group.max():
                break
            group = finer
        begin = group[0]
        rank = np.where(np.arange(group.max() + 1) == begin, 0, np.arange(group.max() + 1) + 1)
        _, rank = np.unique(rank, return_inverse=True)  # the start state becomes 0
        group = rank[group]
        first = np.unique(group, return_index=True)[1]
        self.table = group[step[first]].astype(np.int32)
        self.accepts = accepts[first]
        self.step = (self.table * n).ravel().astype(np.int32)
        self.resets = np.array([bool((self.table[:, c] == 0).all()) for c in range(n)])[self.byte_class] if search else None

    def longest(self, data: bytes, at: int, end: int) -> int:
        """The end of the longest match that begins at `at`, or -1 (for an anchored automaton)."""
        rows, accepts = self.rows()
        state, found, dead = 0, -1, self._dead
        while at < end:
            state = rows[state][data[at]]
            if state == dead:
                break
            at += 1
            if accepts[state]:
                found = at
        return found

    def rows(self) -> tuple[list, list]:
        """The next state per state and byte, and what each state accepts, as lists."""
        if not hasattr(self, "_cached"):
            self._cached = self.table[:, self.byte_class].tolist(), self.accepts.tolist()
            stuck = [s for s in range(len(self.table)) if (self.table[s] == s).all() and not self.accepts[s]]
            self._dead = stuck[0] if stuck else -1
            self.begins = np.array([t != self._dead for t in self._cached[0][0]])
        return self._cached


class Scanner:
    """Finds the spans of all rules."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        self.search = Automaton([r.pattern for r in rules], search=True)
        self.own = [Automaton([r.pattern], search=False) for r in rules]
        self.keeps = [r.keep and re.compile(r.keep.encode()) for r in rules]

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of stretches, and which begin at a cut that a match may cross; texts begin stretches."""
        cuts = np.flatnonzero(self.search.resets[data]) + 1
        want = np.arange(STRETCH, len(data), STRETCH)
        near = np.searchsorted(cuts, want)
        inner = cuts[near[near < len(cuts)]]
        bounds = np.unique(np.concatenate([offsets, inner]))
        size = np.diff(bounds)
        many = np.where(size > 2 * STRETCH, -(-size // STRETCH), 1)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(bounds[:-1], many) + within * STRETCH
        return starts, np.append(starts[1:], bounds[-1:]), within > 0

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, trial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch the bits of the rules that accept in it (or on trial), and the state it begins in."""
        order = np.argsort(starts - ends, kind="stable")
        first, length = starts[order], (ends - starts)[order]
        symbol, step = self.search.byte_class[data], self.search.step
        state = np.zeros(len(starts), np.int32)
        seen = np.zeros(len(starts), np.int64)
        per_state = np.zeros(len(step), np.int64)
        per_state[:: self.search.classes] = self.search.accepts
        active = len(starts)
        for i in range(int(length[0]) if len(length) else 0):
            while active and length[active - 1] <= i:
                active -= 1
            now = step[state[:active] + symbol[first[:active] + i]]
            state[:active] = now
            seen[:active] |= per_state[now]
        found, last = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        found[order], last[order] = seen, state // self.search.classes
        begin = np.zeros(len(starts), np.int64)
        rows, accepts = self.search.rows()
        for k in np.flatnonzero(trial).tolist():
            begin[k] = true = int(last[k - 1])
            tried, bits = 0, 0
            for b in data[starts[k] : ends[k]].tobytes() if true else b"":
                true, tried = rows[true][b], rows[tried][b]
                bits |= accepts[true]
                if true == tried:
                    break
            else:
                last[k] = true if begin[k] else last[k]
            found[k] |= bits
        return found, begin

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """text -> (start, rule, end) in bytes of the slice, for texts that have any."""
        starts, ends, trial = self.stretches(data, offsets)
        hits, begin = self.hits(data, starts, ends, trial)
        if len(starts):
            whole = np.flatnonzero(begin == 0)  # no match is under way where these begin
            starts, ends, hits = starts[whole], np.append(starts[whole[1:]], ends[-1]), np.bitwise_or.reduceat(hits, whole)
        raw, out = data.tobytes(), {}
        for s in np.flatnonzero(hits):
            a, b = int(starts[s]), int(ends[s])
            text = int(np.searchsorted(offsets, a, "right")) - 1
            for k, own in enumerate(self.own):
                if not hits[s] >> k & 1:
                    continue
                own.rows()
                free = a
                for at in (np.flatnonzero(own.begins[data[a:b]]) + a).tolist():
                    if at >= free and (end := own.longest(raw, at, b)) > 0:
                        free = end
                        if not self.keeps[k] or self.keeps[k].fullmatch(raw, at, end):
                            out.setdefault(text, []).append((at, k, end))
        return out


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES, base: int = len(BASE_RULES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one n_<kind> per base rule, base_sha256, spans; one row per row of docs.

    Spans are kind:start:end in code points, end exclusive, by start, then in
    the order of the rules. Matches of one rule don't overlap; those of
    different rules may. base_sha256 is of the base rules' spans alone.

    * null and empty texts have no spans; bytes outside ASCII never match
    * a null id is carried through; repeated rows get equal results
    * an empty table gives an empty result; further columns of docs are ignored
    """
    rules = tuple(rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # bounded by the rules
    names = ["doc_id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for whole in batches:
            for batch in slices(whole, limit=8 << 20):
                data, offsets = text_buffers(batch.column("text"))
                found = scanner.spans(data, offsets)
                n = batch.num_rows
                counts = np.zeros((base, n), np.int64)
                digests, listed = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
                for d, spans in found.items():
                    begin = offsets[d]
                    points = np.cumsum((data[begin : offsets[d + 1]] & 0xC0) != 0x80)
                    at = lambda i, begin=begin, points=points: int(points[i - begin - 1]) if i > begin else 0
                    spans.sort()
                    texts = [(k, f"{rules[k].kind}:{at(s)}:{at(e)}") for s, k, e in spans]
                    for k, _ in texts:
                        if k < base:
                            counts[k, d] += 1
                    digests[d] = hashlib.sha256(",".join(t for k, t in texts if k < base).encode()).hexdigest()
                    listed[d] = ",".join(t for _, t in texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digests), pa.array(listed)], names=names)

    kinds = ", ".join(f"{n} long" for n in names[1:-2])
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}, base_sha256 string, spans string")
