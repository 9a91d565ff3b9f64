"""Secret scan: all rules compiled into one deterministic automaton.

The rules' regular expressions become one nondeterministic automaton, subset
construction and minimisation turn that into transition arrays over byte
classes, and a text is read once, byte by byte, for all rules together.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import table

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is an ASCII regular expression of literals, classes, groups,
    alternatives and repetition.  ``check`` is an exact pattern that a found
    span must match as a whole, or the span is dropped.  Lengths are best put
    there: each counter in a pattern multiplies the automaton's states.
    """

    kind: str
    pattern: str
    check: str = ""


#: The base kinds first, in the order that ties between spans are put in.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", r".{16,}"),
    Rule("hex", r"[0-9a-f]{8,}", r".{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r".{40,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r".{15,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r".{40,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


class _Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def chain(self, items, start: int, fold: bool, reverse: bool) -> int:
        for op, arg in reversed(items) if reverse else items:
            start = self.item(op, arg, start, fold, reverse)
        return start

    def item(self, op, arg, start: int, fold: bool, reverse: bool) -> int:
        if op is sre.LITERAL or op is sre.IN:
            end = self.state()
            self.edges[start].append((_bytes_of([(op, arg)] if op is sre.LITERAL else arg, fold), end))
            return end
        if op is sre.ANY:
            end = self.state()
            self.edges[start].append((frozenset(range(256)) - {10}, end))
            return end
        if op is sre.SUBPATTERN:
            _, add, _, body = arg
            return self.chain(list(body), start, fold or bool(add & re.IGNORECASE), reverse)
        if op is sre.BRANCH:
            end = self.state()
            for body in arg[1]:
                self.empty[self.chain(list(body), start, fold, reverse)].append(end)
            return end
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            for _ in range(low):
                start = self.chain(list(body), start, fold, reverse)
            if high is sre.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.chain(list(body), loop, fold, reverse)].append(loop)
                return loop
            end = self.state()
            self.empty[start].append(end)
            for _ in range(high - low):
                start = self.chain(list(body), start, fold, reverse)
                self.empty[start].append(end)
            return end
        raise ValueError(f"{op} isn't supported in a rule")

    def close(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


def _bytes_of(items, fold: bool) -> frozenset[int]:
    out: set[int] = set()
    negate = False
    for op, arg in items:
        if op is sre.NEGATE:
            negate = True
        elif op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"{op} isn't supported in a class")
    if max(out, default=0) > 127:
        raise ValueError("rules are ASCII only")
    if fold:
        out |= {ord(c) for b in out for c in (chr(b).lower(), chr(b).upper()) if chr(b).isalpha()}
    return frozenset(range(256)) - out if negate else frozenset(out)


@dataclass
class Automaton:
    """``rows[s][b]`` is the state after byte ``b``; states from ``first`` on accept.

    ``accepts[s - first]`` is the tuple of rules whose match ends in state s.
    """

    rows: list[list[int]]
    first: int
    accepts: list[tuple[int, ...]] = field(default_factory=list)
    start: int = 0
    dead: int = -1  # the state that no match can follow


def compile_automaton(patterns: list[str], anywhere: bool, reverse: bool = False) -> Automaton:
    """One minimal automaton for all patterns.

    ``anywhere``: a match may start at any byte; else only at the first.
    ``reverse``: for the reversed patterns.
    """
    nfa, finals = _Nfa(), {}
    begin = nfa.state()
    for k, p in enumerate(patterns):
        own = nfa.state()
        nfa.empty[begin].append(own)
        finals[nfa.chain(list(sre_parse.parse(p)), own, False, reverse)] = k
    # bytes that no edge tells apart are one class
    sets = list({e[0] for edges in nfa.edges for e in edges})
    kinds: dict[tuple[bool, ...], list[int]] = defaultdict(list)
    for b in range(256):
        kinds[tuple(b in s for s in sets)].append(b)
    classes = list(kinds.values())
    # subset construction
    start = nfa.close([begin])
    ids, todo, moves = {start: 0}, [start], []
    while todo:
        subset = todo.pop(0)
        row = []
        for members in classes:
            b = members[0]
            nxt = nfa.close([t for s in subset for e, t in nfa.edges[s] if b in e])
            if anywhere:
                nxt = nxt | start
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        moves.append(row)
    marks = [tuple(sorted(finals[s] for s in subset if s in finals)) for subset in ids]
    # minimisation: split by what is accepted, then by where the moves lead
    block = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    of = [block[m] for m in marks]
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((of[s], *(of[t] for t in moves[s])), len(keys)) for s in range(len(moves))]
        if len(keys) == len(set(of)):
            break
        of = new
    order = sorted(set(of), key=lambda g: bool(marks[of.index(g)]))
    number = {g: i for i, g in enumerate(order)}
    rows, accepts = [], []
    for g in order:
        s = of.index(g)
        row = [0] * 256
        for members, t in zip(classes, moves[s], strict=True):
            for b in members:
                row[b] = number[of[t]]
        rows.append(row)
        if marks[s]:
            accepts.append(marks[s])
    first = len(rows) - len(accepts)
    dead = next((i for i in range(first) if set(rows[i]) == {i}), -1)
    return Automaton(rows, first, accepts, number[of[0]], dead)


@dataclass
class Scanner:
    """The automaton that finds where matches end, and the backward ones that
    find where each starts."""

    rules: tuple[Rule, ...]
    forward: Automaton
    backward: list[Automaton]
    checks: list[re.Pattern | None]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(
        tuple(rules),
        compile_automaton([r.pattern for r in rules], True),
        [compile_automaton([r.pattern], False, True) for r in rules],
        [re.compile(r.check) if r.check else None for r in rules],
    )


def _start_of(data: bytes, end: int, least: int, automaton: Automaton) -> int:
    """The leftmost start, from ``least`` on, of a match that ends at ``end``; -1 if there is none."""
    found, s, rows, first = -1, automaton.start, automaton.rows, automaton.first
    for at in range(end - 1, least - 1, -1):
        s = rows[s][data[at]]
        if s == automaton.dead:
            break
        if s >= first:
            found = at
    return found


def scan(text: str | None, scanner: Scanner) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` in code points, by start and then kind.

    For each kind the matches are leftmost, longest and don't overlap; one that
    fails its check is dropped, but what it covers is used up.  Spans of
    different kinds may overlap.  A null text has none.
    """
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    rows, first, s = scanner.forward.rows, scanner.forward.first, scanner.forward.start
    hits = []
    at = 0
    for b in data:  # the one pass
        s = rows[s][b]
        if s >= first:
            hits.append((at, s))
        at += 1
    if not hits:
        return []
    # ends: where a rule accepts and doesn't accept again at the next byte
    ends: dict[int, list[int]] = defaultdict(list)
    for at, s in hits:
        for k in scanner.forward.accepts[s - first]:
            own = ends[k]
            if own and own[-1] == at:
                own[-1] = at + 1
            else:
                own.append(at + 1)
    spans = []
    for k, own in ends.items():
        found: list[list[int]] = []
        for end in own:
            least = found[-1][1] if found else 0
            longer = _start_of(data, end, found[-1][0], scanner.backward[k]) if found else -1
            if found and longer == found[-1][0]:
                found[-1][1] = end
            elif (begin := _start_of(data, end, least, scanner.backward[k])) >= 0:
                found.append([begin, end])
        check = scanner.checks[k]
        spans += [(a, k, e) for a, e in found if not check or check.fullmatch(data[a:e].decode("ascii", "replace"))]
    spans.sort()
    # byte places to code points, going through the text once
    places: dict[int, int] = {}
    last, points = 0, 0
    for place in sorted({x for a, _, e in spans for x in (a, e)}):
        points += len(data[last:place].decode("utf-8", "surrogatepass"))
        places[place], last = points, place
    return [(scanner.rules[k].kind, places[a], places[e]) for a, k, e in spans]


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (kind, start, end), by start.

    Offsets are code points, the end exclusive.  The whole text is read; null
    and empty texts have an empty list.  A column ``secret_spans`` in ``docs``
    is replaced, others stay.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))  # its size depends on the rules alone

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": e} for k, a, e in scan(t, scanner.value)] for t in texts])

    return docs.withColumn("secret_spans", run(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``[SECRET]``.

    Overlapping spans become one mark.  A null text stays null.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))  # its size depends on the rules alone

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_redacted(t, scan(t, scanner.value)) for t in texts])

    return docs.withColumn(text, run(F.col(text)))


def _redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    number = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(write(base), 256).alias("base_sha256"),
        write(F.col("secret_spans")).alias("spans"),
    )


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced in the text, every document stays."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
