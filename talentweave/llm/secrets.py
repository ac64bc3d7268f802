"""Secret scans: all rules are one deterministic byte automaton that reads the text once.

The rules' patterns are parsed to a nondeterministic automaton, made deterministic by subset construction over byte classes
and minimised by partition refinement into transition arrays. In the combined automaton every rule accepts what it would
report, that is, with the least length of its group built in. The scan runs many lanes of a batch at once: it cuts the text
behind bytes that take every state back to the start, which no match holds, so each lane may begin in the start state.

Lanes that reach an accepting state are read by the automata of the rules that accepted there. The automaton of the
reversed rule reads the lane once from its end and marks all places where a match begins; from the first of them the rule's
automaton takes the longest match, and goes on at the first one behind it. So a byte is read a fixed number of times,
whatever the text. For the rules here that is what a backtracking matcher gives, as their characters leave one way to match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import blocks, utf8


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (ASCII); those whose `group` has fewer than `least` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


#: The first three are the base rules; the order is the order of kinds at equal starts.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = 3


def _parse(rule: Rule, reported: bool) -> list:
    """The pattern as nested lists: a set of bytes, ("alt", parts), ("rep", part, least, most) or a sequence of these.

    With `reported`, the last repetition of the rule's group is as long as the group's least length asks.
    """
    parser = re._parser

    def letters(found: set[int]) -> frozenset[int]:
        if rule.any_case:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(found)

    def walk(tokens) -> list:
        out = []
        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                out.append(letters({arg}))
            elif name == "IN":
                found: set[int] = set()
                for kind, value in arg:
                    found |= {value} if str(kind) == "LITERAL" else set(range(value[0], value[1] + 1))
                out.append(letters(found))
            elif name == "MAX_REPEAT":
                out.append(("rep", walk(arg[2]), arg[0], None if arg[1] == parser.MAXREPEAT else int(arg[1])))
            elif name == "SUBPATTERN":
                out.append(("alt", [lengthened(walk(arg[-1])) if arg[0] == rule.group else walk(arg[-1])]))
            elif name == "BRANCH":
                out.append(("alt", [walk(x) for x in arg[1]]))
            else:
                raise ValueError(f"a rule can't use {name}")
        return out

    def lengthened(parts: list) -> list:
        if not reported or rule.least <= 1:
            return parts
        *others, last = parts
        if not (isinstance(last, tuple) and last[0] == "rep" and last[3] is None and all(isinstance(x, frozenset) for x in [*others, *last[1]])):
            raise ValueError("the least length needs a group of single characters that ends in an open repetition")
        return [*others, ("rep", last[1], max(last[2], rule.least - len(others)), None)]

    whole = walk(parser.parse(rule.pattern))
    return whole if rule.group else lengthened(whole)


def _backwards(part):
    """What reads the same from the end."""
    if isinstance(part, frozenset):
        return part
    if isinstance(part, list):
        return [_backwards(x) for x in reversed(part)]
    return (part[0], [_backwards(x) for x in part[1]]) if part[0] == "alt" else (part[0], _backwards(part[1]), *part[2:])


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, part, at: int) -> int:
        """Appends what `part` accepts behind the state `at`; returns the state in which it ends."""
        if isinstance(part, frozenset):
            self.moves[at].append((part, end := self.state()))
            return end
        if isinstance(part, list):
            for x in part:
                at = self.add(x, at)
            return at
        if part[0] == "alt":
            end = self.state()
            for x in part[1]:
                self.empty[at].append(begin := self.state())
                self.empty[self.add(x, begin)].append(end)
            return end
        _, body, least, most = part
        for _ in range(least):
            at = self.add(body, at)
        if most is None:
            self.empty[at].append(loop := self.state())
            self.empty[self.add(body, loop)].append(loop)
            self.empty[loop].append(end := self.state())
            return end
        ends = [at]
        for _ in range(most - least):
            ends.append(at := self.add(body, at))
        end = self.state()
        for x in ends:
            self.empty[x].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """move[state * n_classes + class] is the next state times n_classes; hits[state] has a bit for each rule."""

    byte_class: np.ndarray
    move: np.ndarray
    hits: np.ndarray
    n_classes: int
    resets: np.ndarray

    @property
    def n_states(self) -> int:
        return len(self.move) // self.n_classes


@cache
def _rule_automaton(rule: Rule, reported: bool, anywhere: bool, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The minimal automaton of a rule: next state by state and byte, and the states that accept. The start is 0."""
    nfa = _Nfa()
    first = nfa.state()
    parsed = _parse(rule, reported)
    accepting = 1 << nfa.add(_backwards(parsed) if backwards else parsed, first)

    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signatures = [tuple(b in s for s in sets) for b in range(256)]
    classes = {x: k for k, x in enumerate(dict.fromkeys(signatures))}
    byte_class = np.array([classes[x] for x in signatures], np.uint8)
    example = {int(c): b for b, c in reversed(list(enumerate(byte_class)))}

    def closure(state: int) -> int:
        """The states that follow without a byte, as bits."""
        seen, todo = 0, [state]
        while todo:
            if not seen >> (x := todo.pop()) & 1:
                seen |= 1 << x
                todo += nfa.empty[x]
        return seen

    closures = [closure(x) for x in range(len(nfa.empty))]
    steps = [[0] * len(classes) for _ in nfa.moves]  # by state and class
    for x, moves in enumerate(nfa.moves):
        for on, t in moves:
            for c in range(len(classes)):
                if example[c] in on:
                    steps[x][c] |= closures[t]
    moving = sum(1 << x for x, moves in enumerate(nfa.moves) if moves)
    start = closures[first]
    known, order, table = {start: 0}, [start], []
    for states in order:  # grows: subset construction
        row, left = [start if anywhere else 0] * len(classes), states & moving
        while left:
            x = (left & -left).bit_length() - 1
            left &= left - 1
            row = list(map(or_, row, steps[x]))
        for to in row:
            if to not in known:
                known[to] = len(order)
                order.append(to)
        table.append([known[to] for to in row])
    moves = np.array(table)
    _, block = np.unique([bool(states & accepting) for states in order], return_inverse=True)
    while True:  # minimisation: split blocks until all members move alike
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    block = np.argsort(np.argsort(np.arange(block.max() + 1) != block[0], kind="stable"), kind="stable")[block]  # the start is 0
    _, member = np.unique(block, return_index=True)
    return block[moves[member]][:, byte_class], np.array([bool(order[m] & accepting) for m in member])


@cache
def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """All rules in one automaton, its states being what the rules' automata reach together. Those are minimal and each has
    a bit of its own in `hits`, so two states of the whole never behave alike."""
    single = [_rule_automaton(rule, True, True) for rule in rules]
    _, byte_class = np.unique(np.concatenate([moves for moves, _ in single]), axis=1, return_inverse=True)
    _, example = np.unique(byte_class, return_index=True)
    radix = np.cumprod([1, *(len(moves) for moves, _ in single[:-1])])
    known, table, new = np.zeros(1, np.int64), [], np.zeros(1, np.int64)
    rows: list[np.ndarray] = []
    while len(new):
        to = sum(moves[new // r % len(moves)][:, example].astype(np.int64) * r for (moves, _), r in zip(single, radix, strict=True))
        rows.append(new)
        table.append(to)
        new = np.setdiff1d(to, known)
        known = np.union1d(known, new)
    order = np.concatenate(rows)  # the start comes first
    place = np.argsort(order)
    moves = place[np.searchsorted(order[place], np.concatenate(table))]
    hits = sum(accepts[order // r % len(accepts)].astype(np.uint8) << k for k, ((_, accepts), r) in enumerate(zip(single, radix, strict=True)))
    n = len(example)
    return Automaton(byte_class.astype(np.uint8), (moves * n).astype(np.int32).ravel(), np.repeat(hits, n).astype(np.uint8), n, (moves == 0).all(axis=0)[byte_class])


LANE = 2048
BLOCK = 4 << 20
FEW = 24


def scan(dfa: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lanes and, for each lane, the rules whose trigger ends in it."""
    free = np.flatnonzero(dfa.resets[data])
    aims = np.searchsorted(free, np.arange(LANE, len(data), LANE))
    cuts = np.unique(np.concatenate([[0], free[aims[aims < len(free)]] + 1, [len(data)]]))
    starts, lengths = cuts[:-1], np.diff(cuts)
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[order], lengths[order]
    classes = dfa.byte_class[data]
    state, found = np.zeros(len(order), np.int32), np.zeros(len(order), np.uint8)
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    t = 0
    while t < len(alive) and (k := int(alive[t])) > FEW:
        now = dfa.move[state[:k] + classes[begin[:k] + t]]
        state[:k] = now
        found[:k] |= dfa.hits[now]
        t += 1
    if t < len(alive):  # the rest of a few long lanes
        move, hits = dfa.move.tolist(), dfa.hits.tolist()
        for lane in range(int(alive[t])):
            s, h = int(state[lane]), int(found[lane])
            for c in classes[begin[lane] + t : begin[lane] + length[lane]].tobytes():
                s = move[s + c]
                h |= hits[s]
            found[lane] = h
    out = np.zeros(len(order), np.uint8)
    out[order] = found
    return cuts, out


@dataclass(frozen=True)
class Matcher:
    """A rule's matches from one place on: transitions by state and byte, and the states that accept. State 0 is dead."""

    first: int
    move: list[list[int]]
    accepts: list[bool]

    @staticmethod
    def of(rule: Rule, reported: bool) -> Matcher:
        moves, accepts = _rule_automaton(rule, reported, False)
        dead = np.flatnonzero((moves == np.arange(len(moves))[:, None]).all(axis=1) & ~accepts)
        order = np.concatenate([dead, np.setdiff1d(np.arange(len(moves)), dead)])  # the dead state first
        place = np.argsort(order)
        moves = place[moves[order]]
        first = int(place[0])
        return Matcher(first, moves.tolist(), accepts[order].tolist())

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match that begins at `at`, or -1."""
        state, move, accepts, end = self.first, self.move, self.accepts, -1
        for p in range(at, len(data)):
            state = move[state][data[p]]
            if not state:
                break
            if accepts[state]:
                end = p + 1
        return end


@cache
def _matchers(rule: Rule) -> tuple[Matcher, Matcher, list[list[int]], list[bool]]:
    moves, accepts = _rule_automaton(rule, False, True, True)
    return Matcher.of(rule, False), Matcher.of(rule, True), moves.tolist(), accepts.tolist()


def _starts(data: bytes, move: list[list[int]], accepts: list[bool]) -> list[int]:
    """All places where a match begins, ascending: those where the automaton of the reversed rule accepts."""
    state, found = 0, []
    for p in range(len(data) - 1, -1, -1):
        state = move[state][data[p]]
        if accepts[state]:
            found.append(p)
    return found[::-1]


def spans_of(data: np.ndarray, rules: tuple[Rule, ...], mask: int) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the matches of the rules in `mask` that are reported, in bytes, by start and kind."""
    out, raw = [], data.tobytes()
    for k, rule in enumerate(rules):
        if mask >> k & 1:
            every, reported, move, accepts = _matchers(rule)
            behind = 0
            for start in _starts(raw, move, accepts):
                if start >= behind:
                    behind = every.longest(raw, start)
                    if reported.longest(raw, start) == behind:
                        out.append((start, k, behind))
    return sorted(out)


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans: array of (kind, start, end)) for every row; offsets are code points, the end is exclusive.

    Matches of a kind are leftmost and don't overlap; matches that are too short are dropped after matching. Null and
    empty texts have no spans, repeated rows give repeated rows, an empty table gives an empty one, other columns are not read.
    """
    dfa = compile_rules(rules)  # once for each driver; the tasks get its arrays
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, j in blocks(offsets, BLOCK):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                cuts, found = scan(dfa, part)
                for lane in np.flatnonzero(found).tolist():
                    a, b = int(cuts[lane]), int(cuts[lane + 1])
                    for d in range(int(np.searchsorted(own, a, "right")) - 1, int(np.searchsorted(own, b, "left"))):
                        lo, hi = max(a, int(own[d])), min(b, int(own[d + 1]))
                        if spans := spans_of(part[lo:hi], rules, int(found[lane])):
                            shift = _points(part[own[d] : lo])
                            within = part[lo:hi]
                            rows[i + d] += [{"kind": rules[k].kind, "start": shift + _points(within[:s]), "end": shift + _points(within[:e])} for s, k, e in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], ["id", "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {key}, spans array<struct<kind:string,start:bigint,end:bigint>>")
