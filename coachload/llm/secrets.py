"""Secret scans (6): assignment-aware lexing.

Two scans of each whole text.  The base scan finds sensitive assignments,
access keys and long hex runs by pattern.  The lexer reads source and
configuration syntax (``name = "x"``, ``"name": "x"``, ``name: x``,
``name := x``, ``name => x``, typed and exported forms) into pairs of a target
name and literals, keeps a table of the document's constants, resolves names
and concatenations on the right-hand side through it, and scores the literals
by the sensitivity of the name they reach and by their own make-up.

One narrow pass, no shuffle; memory is one document's spans.  Constants refer
to one another, so a value of any length or number of literals is judged and
reported whole.

Defined cases: null and empty texts have no spans; spans that two kinds share
are all reported; repeated rows are each scanned; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, named

# The base kinds, their order and patterns.
KINDS = ["assign", "access", "hex", "literal", "constant"]
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_HINTS = [b"passw", b"secret", b"token", b"apikey", b"api_key"]
LEAST = {"assign": 6, "access": 20}

# How much a part of a target name tells.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.5, "key": 0.5, "auth": 0.5, "access": 0.4,
    "bearer": 0.7, "signing": 0.5, "encryption": 0.5, "client": 0.2, "api": 0.4, "salt": 0.5,
}
HARMLESS = {"public": 0.8, "count": 0.6, "length": 0.6, "size": 0.6, "name": 0.4, "path": 0.5, "url": 0.4, "id": 0.3}
_MARKS = r"(?i)example|change_?me|placeholder|your[_-]|dummy|x{4,}|\*{3,}|\.{3,}"
PLACEHOLDERS = re.compile(_MARKS + "|^(none|null|true|false|undefined)$")
SPANNING = re.compile(_MARKS)
EDGE = 16  # no mark is longer, repeated characters count from 3 or 4
REPORT_FROM = 0.6

TERM = r"""(?:"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`[^`\n]*+`|[A-Za-z0-9_$@%/.~=-]++)"""
STATEMENT = re.compile(
    r"""(?<![A-Za-z0-9_.$-])["']?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?[ \t]*+"""
    r"""(?::[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+[ \t]*+=(?![=>])|:=|=>|=(?![=~])|:(?![:/]))[ \t]*+"""
    rf"""(?P<value>{TERM}(?:[ \t]*+\+[ \t]*+{TERM})*+)""", re.ASCII)
EACH_TERM = re.compile(TERM, re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z", re.ASCII)
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """0 to 1: how likely the target's name holds a secret."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    score = sum(SENSITIVE.get(p, 0.0) for p in parts)
    pairs = {a + b for a, b in zip(parts, parts[1:])}
    score = max(score, max((SENSITIVE.get(p, 0.0) for p in pairs), default=0.0))
    return max(0.0, min(1.0, score - (HARMLESS.get(parts[-1], 0.0) if parts else 0.0)))


class MakeUp:
    """What the make-up of a text depends on; it adds up on concatenation, so
    a long chain of constants never has its whole value in memory."""

    __slots__ = ("n", "chars", "marked", "head", "tail", "solid", "inside", "lead", "trail")

    def __init__(self, text: str = ""):
        body = text.strip()
        self.n, self.chars = len(text), Counter(text)
        self.marked = PLACEHOLDERS.search(text) is not None
        self.head, self.tail = text[:EDGE], text[-EDGE:]
        # a space within the stripped text, before and after it
        self.solid, self.inside = bool(body), " " in body
        at = text.find(body) if body else len(text)
        self.lead, self.trail = " " in text[:at], " " in text[at + len(body):] if body else " " in text

    def __add__(self, other: MakeUp) -> MakeUp:
        if not self.n or not other.n:
            return self if self.n else other
        out = MakeUp()
        out.n, out.chars = self.n + other.n, self.chars.copy()
        out.chars.update(other.chars)
        head = self.head + other.head if self.n < EDGE else self.head
        tail = self.tail + other.tail if other.n < EDGE else other.tail
        out.head, out.tail = head[:EDGE], tail[-EDGE:]
        if out.n <= EDGE:  # the head is all of it, and a mark may be one for the whole text only
            out.marked = PLACEHOLDERS.search(out.head) is not None
        else:
            out.marked = self._found() or other._found() or SPANNING.search(self.tail + other.head) is not None
        out.solid = self.solid or other.solid
        out.inside = self.inside or other.inside or (self.solid and other.solid and (self.trail or other.lead))
        out.lead = self.lead or (not self.solid and other.lead)
        out.trail = other.trail or (not other.solid and self.trail)
        return out

    def _found(self) -> bool:
        """A mark that stays one in a longer text."""
        return self.marked and (self.n > EDGE or SPANNING.search(self.head) is not None)

    def score(self) -> float:
        """0 to 1: how much a literal looks like a secret of its own."""
        if self.n < 8 or self.inside or self.marked:
            return 0.0
        entropy = -sum(c / self.n * math.log2(c / self.n) for c in self.chars.values())
        classes = (sum(any(f(c) for c in self.chars) for f in (str.islower, str.isupper, str.isdigit))
                   + any(not c.isalnum() for c in self.chars))
        return min(1.0, entropy / 4.0) * (0.55 + 0.15 * classes)


class Value:
    """The right-hand side of an assignment: literal spans of its own and the
    values it refers to."""

    __slots__ = ("texts", "spans", "known", "_made")

    def __init__(self):
        self.texts, self.spans, self.known, self._made = [], [], [], None

    @property
    def made(self) -> MakeUp:
        """The values referred to are made before, so chains don't recurse."""
        if self._made is None:
            total, own = MakeUp(), []
            for x in self.texts:
                if isinstance(x, str):
                    own.append(x)
                else:
                    total, own = total + MakeUp("".join(own)) + x.made, []
            self._made, self.texts = total + MakeUp("".join(own)), []
        return self._made


def name_literal_values(text: str):
    """(target name, value) of each assignment.  A span is that of the quoted
    or bare literal itself, without quotes."""
    constants: dict[str, Value] = {}
    for m in STATEMENT.finditer(text):
        value = Value()
        for t in EACH_TERM.finditer(text, m.start("value"), m.end("value")):
            raw = t.group()
            if raw[0] in "\"'`":
                value.texts.append(raw[1:-1])
                value.spans.append((t.start() + 1, t.end() - 1))
            elif IDENTIFIER.match(raw) and (known := constants.get(raw.lstrip("$"))) is not None:
                value.texts.append(known)
                value.known.append(known)
            else:
                value.texts.append(raw)
                value.spans.append((t.start(), t.end()))
        if value.known:
            value.made
        constants[m.group("name")] = value
        yield m.group("name"), value


def method_spans(text: str) -> set[tuple[int, int, int]]:
    found, told_of, literal, constant = set(), set(), KINDS.index("literal"), KINDS.index("constant")
    for name, value in name_literal_values(text):
        told = sensitivity(name)
        if told and told * 0.5 + (looks := value.made.score()) * 0.5 >= REPORT_FROM and looks > 0:
            kind = constant if value.known else literal
            found.update((a, kind, b) for a, b in value.spans if b > a)
            agenda = list(value.known)
            while agenda:  # each value that is reached tells its spans once a document
                own = agenda.pop()
                if own not in told_of:
                    told_of.add(own)
                    found.update((a, constant, b) for a, b in own.spans if b > a)
                    agenda += own.known
    return found


def secret_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) in code points, sorted."""
    low = raw.lower()
    assign = any(h in low for h in ASSIGN_HINTS)
    access = b"AKIA" in raw
    hexes = [m.span() for m in HEX.finditer(raw)]
    lexed = (b"=" in raw or b":" in raw)
    if not (assign or access or hexes or lexed):
        return []
    text = raw.decode("utf-8", "replace")
    found = method_spans(text) if lexed else set()
    if assign:
        found |= {(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]}
    if access:
        found |= {(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST["access"]}
    if hexes:
        at, chars = 0, 0
        for a, b in hexes:
            if len(text) != len(raw):
                chars += len(raw[at:a].decode("utf-8", "replace"))
                at = a
            start = chars if len(text) != len(raw) else a
            found.add((start, 2, start + b - a))
    return sorted(found)


def _scan(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        rows = [[{"start": s, "kind": k, "end": e} for s, k, e in secret_spans(t.as_py())] for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, spans (start, kind as in ``KINDS``, end
    exclusive; code points), by start, then kind, then end."""
    d = named(docs, id_col, text_col).select("doc_id", as_bytes().alias("text"))
    out = d.mapInArrow(_scan, "doc_id long, spans array<struct<start:int,kind:int,end:int>>")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return out.withColumn("spans", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(kinds, s["kind"] + 1).alias("kind"), s["end"].alias("end"))))
