"""Secret scan: fixed patterns plus assignment-aware lexing of source and configuration text.

The lexer reads `name = literal` pairs (code, JSON, YAML with block scalars, INI,
shell, XML elements and attributes, subscripts, tuples, triple-quoted strings,
literals wrapped in calls), follows constants (`key = BASE`, `"${BASE}tail"`,
`f"{BASE}tail"`, `A + "tail"`, `A . "tail"`, `"%s-tail" % A`, adjacent literals)
back to the literals they hold, also those that are set further down, and scores
each value as a whole by the sensitivity of the name it ends up in.  Comments
are read like code, as secrets stand there too.  No form has a bound on its
length; every pattern moves on by what it has read, so time is linear.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import slices

# Fixed values of the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 characters or more
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Sensitivity of the parts of a target name; the strongest part counts, pairs as one.
NAME_WEIGHT = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "secret_key": 1.0, "signing_key": 0.9, "encryption_key": 0.9, "client_secret": 1.0, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "credential": 0.8, "credentials": 0.8, "connection_string": 0.7, "dsn": 0.5}
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|changeme|example|placeholder|none|null|true|false|your[-_ ].*)$", re.IGNORECASE)
#: Literals that score this much are reported.
MIN_SCORE = 1.2
#: Names that end in one of these hold a figure about a secret, not one.
FIGURES = {"count", "counts", "size", "length", "limit", "total", "number", "index", "usage", "budget", "ttl", "expiry", "expires"}

_TYPE = r"""(?P<type>[A-Za-z_][\w.]*+)(?:[<\[][^"'=:\n]*[>\]])?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+[?!]?"""
# a name begins where a run of name characters does, so long runs are read once
_NAME = r"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)"""
_PAIR = re.compile(
    _NAME
    + r"""(?:["'](?:[ \t]*\])?|\])?[ \t]*+"""
    + r"""(?::[ \t]*(?:&(?:'[a-z]+[ \t]+)?)?"""
    + _TYPE
    + r"""(?:[ \t]+=(?![=>])|=(?=[ \t]*["']))|:=|=>|=(?!=)|:(?![:/]))[ \t]*+"""
    + r"""(?:(?P<open>(?:(?:[A-Za-z_][\w.]*+)?\([ \t\n]*+)++)(?=[bBrRfFuU]{0,2}["'])|(?=["'$A-Za-z0-9+/_-]))"""
)
_TERM = re.compile(
    r"""(?:(?P<prefix>[bBrRfFuU]{0,2})(?:\"{3}(?P<double3>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<single3>(?:[^'\\]|\\.|'(?!''))*+)'{3}"""
    r"""|"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)')"""
    r"""|\$\{(?P<braced>[A-Za-z_]\w*)\}|\$(?P<dollar>[A-Za-z_]\w*)|(?P<bare>[A-Za-z0-9+/_.=-]+))""",
    re.ASCII | re.DOTALL,
)
_QUOTED = ("double", "single", "double3", "single3")
_INSIDE = re.compile(r"\$\{(?P<braced>[A-Za-z_]\w*)\}|\$(?P<dollar>[A-Za-z_]\w*)", re.ASCII)
_FIELD = re.compile(r"\{\{|\{(?P<braced>[A-Za-z_]\w*)(?P<dollar>(?!))?[^{}\n]*\}", re.ASCII)
_SLOT = re.compile(r"%(?:%|[-+ #0]*\d*(?:\.\d+)?[sdrxc])|\{\d*\}")
_GIVEN = re.compile(r"""[ \t]*%[ \t]*(?:\(([^()"'\n]*)\)|([A-Za-z_]\w*))|\.format\(([^()"'\n]*)\)""", re.ASCII)
_ELEMENT = re.compile(r"""<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*+)(?:[ \t\n][^<>]*+)?>[ \t\n]*+(?P<value>[^<>]*[^<> \t\n])[ \t\n]*</(?P=name)>""")
_BLOCK = re.compile(r"""(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?:[ \t]*[|>][+-]?[ \t]*\n(?P<value>(?:[ \t]+[^ \t\n][^\n]*(?:\n|\Z))++)""")
_JOIN = re.compile(r"[ \t]*\+[ \t]*|[ \t]+\.[ \t]+(?=[\"'$A-Za-z_])|\.(?=[\"'$])")
_NEXT = re.compile(r"[ \t]*(?=[bBrRfFuU]{0,2}[\"'])")
_NEXT_LINE = re.compile(r"[ \t\n]*(?:\+[ \t\n]*)?(?=[bBrRfFuU]{0,2}[\"'])")
_COMMA = re.compile(r"[ \t]*,[ \t]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Some part of a name that has a weight; texts without any hold no literal to report.
_SENSITIVE = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "connection", "dsn")


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or parts[-1] in FIGURES:
        return 0.0
    keys = parts + [f"{a}_{b}" for a, b in zip(parts, parts[1:], strict=False)]
    return max((NAME_WEIGHT.get(k, 0.0) for k in keys), default=0.0)


class Shape:
    """What the score of a text needs, adding up over its pieces: characters by kind, its first and last ones."""

    __slots__ = ("chars", "head", "last", "n")

    def __init__(self, text: str) -> None:
        self.n, self.head, self.last, self.chars = len(text), text[:12], text[-1:], Counter(text)

    def __add__(self, other: Shape) -> Shape:
        out = object.__new__(Shape)
        out.n, out.head, out.last = self.n + other.n, (self.head + other.head)[:12], other.last or self.last
        out.chars = self.chars + other.chars
        return out

    def is_placeholder(self) -> bool:
        if self.n <= len(self.head):
            return bool(_PLACEHOLDER.match(self.head))
        if "\n" in self.chars:
            return False
        return self.chars.keys() <= {"x", "X"} or len(self.chars) == 1 and self.head[0] in "*." or self.head[0] == "<" and self.last == ">" or self.head[:4].lower() == "your" and self.head[4] in "-_ "

    def score(self) -> float:
        """0 to 1: length, entropy and mix of character classes, spaces and tabs left out."""
        if self.is_placeholder():
            return 0.0
        counts = {c: k for c, k in self.chars.items() if c not in " \t"}
        n = sum(counts.values())
        if n < 8:
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return 0.4 * min(1.0, n / 16) + 0.4 * min(1.0, entropy / 3.5) + 0.1 * min(2, classes - 1)


def literal_score(value: str) -> float:
    return Shape(value).score()


class Value:
    """What a name holds: spans of literals and values of other names, in order; shared, not copied."""

    __slots__ = ("parts", "shape", "told")

    def __init__(self, parts: list[tuple[int, int] | Value]) -> None:
        self.parts, self.shape, self.told = parts, None, False


def _shape(value: Value, text: str) -> Shape:
    """The shape of a value as a whole, from those of its parts, each worked out once."""
    stack = [value]
    while stack:
        top = stack[-1]
        if top.shape is None:
            waiting = [p for p in top.parts if isinstance(p, Value) and p.shape is None]
            if waiting:
                stack += waiting
                continue
            shapes = [p.shape if isinstance(p, Value) else Shape(text[p[0] : p[1]]) for p in top.parts]
            total = shapes[0]
            for x in shapes[1:]:
                total = total + x
            top.shape = total
        stack.pop()
    return value.shape


def _is_secret(weight: float, score: float) -> bool:
    return weight > 0 and weight + score >= MIN_SCORE + (1 - weight) * 0.5


class Pairs:
    """One pass over a text: what each name holds, and the spans that end up in sensitive names.

    later: what names hold at the end of the text, for those used before they are set.
    """

    def __init__(self, text: str, later: dict[str, Value] | None) -> None:
        self.text, self.later = text, later or {}
        self.held: dict[str, Value] = {}
        self.open_names: set[str] = set()  # names that no value was known for
        self.found: set[tuple[int, int]] = set()

    def known(self, name: str) -> Value | None:
        value = self.held.get(name)
        return value if value is not None else self.later.get(name)

    def between(self, span: tuple[int, int], holes: list[tuple[int, int, str]]) -> list:
        """Literal pieces of a string and the values of the names that stand in its holes; unknown names stay text."""
        parts, last = [], span[0]
        for start, end, name in holes:
            value = self.known(name)
            if value is None:
                self.open_names.add(name)
                continue
            if last < start:
                parts.append((last, start))
            parts.append(value)
            last = end
        if last < span[1] or not parts:
            parts.append((last, span[1]))
        return parts

    def term(self, at: int) -> tuple[list, int, bool] | None:
        """Parts of the term at a place, where it ends, and whether it is a string."""
        text, term = self.text, _TERM.match(self.text, at)
        if not term:
            return None
        kind = term.lastgroup
        value, span = term[kind], term.span(kind)
        if kind not in _QUOTED:
            if kind == "bare" and self.known(value) is None:
                self.open_names.add(value)
                return [span], term.end(), False
            found = self.known(value)
            if found is None:
                self.open_names.add(value)
            return [] if found is None else [found], term.end(), False
        end = term.end()
        given = _GIVEN.match(text, end) if "%" in value or "{" in value else None
        if given:
            names = [n.strip() for n in (given[1] or given[2] or given[3] or "").split(",")]
            slots = [m for m in _SLOT.finditer(value) if m[0] != "%%"]
            holes = [(m.start(), m.end(), n) for m, n in zip(slots, names, strict=False)]
            end = given.end()
        elif "f" in term["prefix"].lower() and "{" in value:
            holes = [(m.start(), m.end(), m["braced"]) for m in _FIELD.finditer(value) if m["braced"]]
        elif "$" in value:
            holes = [(m.start(), m.end(), m["braced"] or m["dollar"]) for m in _INSIDE.finditer(value)]
        else:
            holes = []
        whole = len(holes) == 1 and holes[0][:2] == (0, len(value))
        if whole and self.known(holes[0][2]) is None:
            self.open_names.add(holes[0][2])
            return [], end, True
        return self.between(span, [(span[0] + a, span[0] + b, n) for a, b, n in holes]), end, True

    def expression(self, at: int, lines: bool) -> tuple[list, int]:
        """Parts of terms joined by operators, or by standing side by side as strings; lines: over line ends, inside brackets."""
        parts: list = []
        while got := self.term(at):
            new, at, quoted = got
            parts += new
            join = _JOIN.match(self.text, at) or (quoted and (_NEXT_LINE if lines else _NEXT).match(self.text, at)) or None
            if not join:
                break
            at = join.end()
        return parts, at

    def assign(self, names: list[str], parts: list) -> None:
        if not parts:
            return
        value = parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else Value(parts)
        self.held.update(dict.fromkeys(names, value))
        weight = max(map(name_weight, names))
        if weight and _is_secret(weight, _shape(value, self.text).score()):
            self.report(value)

    def report(self, value: Value) -> None:
        stack: list = [value]
        while stack:
            part = stack.pop()
            if not isinstance(part, Value):
                self.found.add(part)
            elif not part.told:
                part.told = True
                stack += part.parts

    def targets(self, start: int, since: int) -> list[str]:
        """Names before the last one of a tuple on the left of an assignment, from the left."""
        before = self.text[max(since, self.text.rfind("\n", since, start) + 1) : start].rstrip(" \t(")
        names: list[str] = []
        if before.endswith(","):
            for piece in reversed(before[:-1].split(",")):
                name = piece.split()[-1] if piece.split() else ""
                if not name.isidentifier():
                    break
                names.append(name)
                if name != piece.strip():
                    break
        return names[::-1]

    def run(self) -> None:
        text, since = self.text, 0
        for pair in _PAIR.finditer(text):
            kind = pair["type"]
            names = [n for n in (pair["name"], kind) if n]
            if kind and any(c.isdigit() for c in kind):  # `name: literal = ...` is possible too
                if _is_secret(name_weight(pair["name"]), literal_score(kind)):
                    self.found.add(pair.span("type"))
                    # the name before it is no target of what follows
            more = self.targets(pair.start(), since) if "," in text[since : pair.start()] and "=" in pair[0] else []
            since = pair.end()
            parts, at = self.expression(pair.end(), bool(pair["open"]) and "(" in pair["open"])
            values = [parts]
            while more and len(values) <= len(more) and (comma := _COMMA.match(text, at)):
                parts, at = self.expression(comma.end(), False)
                values.append(parts)
            if more and len(values) == len(more) + 1:
                for name, parts in zip([*more, pair["name"]], values, strict=True):
                    self.assign([name], parts)
            else:
                self.assign(names, values[0])
        for pattern in (_ELEMENT, _BLOCK):
            for m in pattern.finditer(text):
                start = m.end("value") - len(m["value"].lstrip())
                value = m["value"].strip()
                if _is_secret(name_weight(m["name"]), literal_score(value.replace("\n", ""))):
                    self.found.add((start, start + len(value)))


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose name and shape together score MIN_SCORE or more.

    A name that is set again takes the later value for what follows; one that is
    used before it is set, the value it has at the end.  Values are shared, so
    chains of constants cost no more than their length.  In `name: word =
    literal`, `word` may be a type or, after a label, the name proper, so the
    stronger of the two counts.
    """
    low = text.lower()
    if not any(x in low for x in _SENSITIVE) or ("=" not in text and ":" not in text and "</" not in text):
        return []
    pairs = Pairs(text, None)
    pairs.run()
    if pairs.open_names & pairs.held.keys():
        ends = pairs.held
        for value in ends.values():
            value.told = False
        again = Pairs(text, ends)
        again.run()
        pairs = again
    return sorted((x, y) for x, y in pairs.found if x < y)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, index in KINDS, end), in code points."""
    base = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    # the furthest end of the base spans up to each one, so that a literal inside one is found by its start
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    more = [(s, 3, e) for s, e in literal_spans(text) if not (k := bisect_right(starts, s)) or reach[k - 1] < e]
    return base, sorted(base + more)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row.

    Spans are whole matches (`kind:start:end`, end exclusive).  A null text
    counts as empty; without spans, `spans` is '' and base_sha256 the digest of
    ''.  Repeated ids give a row each; other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 16 << 20):
            counts, digests, spans = ([], [], []), [], []
            for text in b.column("text").to_pylist():
                base, whole = find(text or "")
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(whole))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
