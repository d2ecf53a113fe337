"""Secret scan: fixed patterns, and literals that code or configuration assigns to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_texts, texts

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: How much a part of a name says that its value is secret.
NAME_PARTS = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "pass": 2.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "private": 1.5, "access": 1.0, "auth": 1.5, "authorization": 2.0, "bearer": 2.0,
    "signing": 1.5, "encryption": 1.5, "api": 1.5, "key": 1.5, "salt": 1.5, "session": 1.0,
}
#: Values that stand for a secret but are none.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "redacted", "todo"}
#: Score from which a literal is reported.
LEAST_SCORE = 4.0

#: A name can score only where one of these stands: the name parts, without those that hold another one.
_HINTS = tuple(p for p in NAME_PARTS if not any(q != p and q in p for q in NAME_PARTS))
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_TOKEN = re.compile(r"""
    (?P<space>(?:[\x20\t]|\\\r?\n)+)
  | (?P<string>\"{3}(?:[^"\\]|\\.|\"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<op>:=|=>|==|!=|<=|>=|=|:)
  | (?P<plus>\+)
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.\-][A-Za-z_][A-Za-z0-9_]*)*)
  | (?P<bare>[A-Za-z0-9_+/.=\-]+)
  | (?P<end>\n|;|,)
  | (?P<other>.)
""", re.X | re.S)
_BARE = re.compile(r"[A-Za-z0-9_+/.=\-]+")
#: Letters that may stand directly before a string.
_PREFIX = {"r", "b", "f", "u", "rb", "br", "fr", "rf"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind; a match that is too short is dropped but uses up its characters."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """The weights of a name's parts: ``dbPassword``, ``API_KEY`` and ``auth.token`` all count."""
    parts = {p.lower() for p in _NAME_PART.findall(name)}
    return sum(NAME_PARTS.get(p, 0.0) for p in parts)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, mixed characters, entropy; negative for placeholders."""
    if len(value) < 8 or value.lower() in PLACEHOLDERS or value.startswith(("${", "{{", "<", "%(")) or any(c.isspace() for c in value) or len(set(value)) < 4:
        return -10.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    return min(entropy, 4.0) / 2 + 0.5 * (kinds - 1) + (0.5 if n >= 16 else 0.0)


class Source:
    """The tokens of a text, and readers of assignments among them."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]
        self.tokens.append(("end", len(text), len(text)))

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1]:self.tokens[i][2]]

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else "end"

    def inner(self, i: int) -> tuple[int, int]:
        """A string's content."""
        _, a, b = self.tokens[i]
        quotes = 3 if b - a >= 6 and self.text[a:a + 3] in ('"' * 3, "'" * 3) else 1
        return a + quotes, b - quotes

    def after_lines(self, i: int) -> int:
        while i < len(self.tokens) - 1 and self.word(i) == "\n":
            i += 1
        return i

    def operator(self, i: int) -> int | None:
        """The position of the operator that assigns to a target which ends before ``i``: after closing brackets, past a type."""
        while self.kind(i) == "other" and self.word(i) == "]":
            i += 1
        if self.kind(i) != "op" or self.word(i) not in ("=", ":", ":=", "=>"):
            return None
        if self.word(i) == ":":
            to, last = i + 1, "other"
            while (kind := self.kind(to)) in ("name", "other") and self.word(to) not in "(){}" and not kind == last == "name":
                to, last = to + 1, kind
            if to > i + 1 and self.kind(to) == "op" and self.word(to) == "=" and self.text[self.tokens[to][1] - 1].isspace():
                return to
        return i

    def value(self, at: int, quoted: bool) -> tuple[list, int]:
        """The terms of the sum after the operator ``at``, as ("literal", start, end) or ("name", text, span or None), and the position after it.

        A string is a literal.  A bare word is one if it is no name, or stands where configuration puts values: after a colon or an equals sign
        without spaces, and not as an argument, a member of a list or a call.  Names carry their span where they may be literals.
        Sums go on over line ends after a plus, within round brackets and after a backslash; strings side by side are a sum.
        """
        _, a, b = self.tokens[at]
        tight = self.word(at) == "=" and not self.text[a - 1:a].isspace() and not self.text[b:b + 1].isspace()
        plain = tight or self.word(at) == ":" and not quoted
        terms, depth, i, wait = [], 0, at + 1, True
        while i < len(self.tokens) - 1:
            kind, start, end = self.tokens[i]
            word = self.text[start:end]
            if word == "\n" and (depth or wait and terms):
                i += 1
            elif word == "(" and wait:
                depth, i = depth + 1, i + 1
            elif word == ")" and depth:
                depth, i = depth - 1, i + 1
            elif kind == "plus" and not wait:
                wait, i = True, i + 1
            elif kind == "string" and (wait or terms[-1][0] == "literal" and self.kind(i - 1) in ("string", "end") and (depth or self.kind(i - 1) == "string")):
                terms.append(("literal", *self.inner(i)))
                wait, i = False, i + 1
            elif kind == "name" and wait and word.lower() in _PREFIX and self.kind(i + 1) == "string" and self.tokens[i + 1][1] == end:
                i += 1
            elif kind in ("name", "bare") and wait:
                run = _BARE.match(self.text, start).end()
                follows = self.text[run:run + 1]
                if follows and follows in "([":
                    return [], i + 1  # a call or a member: its value is unknown
                if kind == "bare" or run > end and (plain or self.text[end] != "+"):
                    terms.append(("literal", start, run))
                    while self.tokens[i][2] < run:
                        i += 1
                else:
                    free = plain and not depth and not (follows and follows in ",)}")
                    terms.append(("name", word, (start, end) if free else None))
                wait, i = False, i + 1
            else:
                break
        return terms, i

    def assignments(self):
        """(target name, terms) in the order of the text; a name or string directly before an operator is a target."""
        i = 0
        while i < len(self.tokens):
            if self.kind(i) in ("name", "string") and (at := self.operator(i + 1)) is not None:
                quoted = self.kind(i) == "string"
                a, b = self.inner(i) if quoted else self.tokens[i][1:]
                terms, after = self.value(at, quoted)
                yield self.text[a:b], terms
                if at > i + 2 and self.kind(at - 1) == "name":  # "note: token = ..." is a type or a target
                    yield self.word(at - 1), terms
                # what stands after an operator may be a target itself, as in "a = b = ..."
                i = at + 1 if self.kind(at + 1) in ("name", "string") and self.operator(at + 2) is not None else after
            else:
                i += 1


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach a sensitive name, directly, in a sum or through constants.

    Constants hold from their assignment on; the last assignment wins, also where its value is unknown.  A constant keeps its own literals and
    refers to the constants it is made of, so none is copied and none is too long.  A sum is scored as the joined text of its different literals and
    gives each of them.
    """
    if "=" not in text and ":" not in text:
        return []
    lower = text.lower()
    if not any(p in lower for p in _HINTS):
        return []
    constants: dict[str, list] = {}  # terms: (start, end), or the terms of another constant
    found = set()
    for name, values in Source(text).assignments():
        terms: list = []
        for v in values:
            if v[0] == "literal":
                terms.append(v[1:])
            elif v[1] in constants:
                terms.append(constants[v[1]])
            elif v[2]:
                terms.append(v[2])
        constants[name] = terms
        weight = name_score(name)
        if weight and terms:
            spans = resolved(terms)
            if weight + literal_score("".join(text[a:b] for a, b in spans)) >= LEAST_SCORE:
                found |= {(a, 3, b) for a, b in spans if b > a}
    return sorted(found)


def resolved(terms: list) -> list[tuple[int, int]]:
    """The different literals below ``terms`` in order."""
    out, seen, left = {}, set(), [terms]
    while left:
        term = left.pop()
        if isinstance(term, tuple):
            out[term] = None
        elif id(term) not in seen:
            seen.add(id(term))
            left += reversed(term)
    return list(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every span, overlaps joined, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, mark: str = "[SECRET]", with_text: bool = True) -> DataFrame:
    """Spans of every whole text, one row per input row.

    doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans and, if asked for, ``redacted``: the text with every
    span replaced.  Offsets are code points, ends exclusive.  A NULL or empty text has no span and an empty list; very
    long texts are scanned whole; repeated rows give equal rows.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string" + ", redacted string" * with_text

    def run(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans", "redacted")}
        for text in texts(batch):
            base = base_spans(text)
            every = sorted([*base, *literal_spans(text)])
            kinds = Counter(k for _, k, _ in every)
            for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_literal")):
                out[name].append(kinds[k])
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(every))
            if with_text:
                out["redacted"].append(redacted(text, every, mark))
        return out | {"doc_id": batch.column("doc_id")}

    return map_texts(docs, ["doc_id", "text"], run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with its own columns, every span of ``text`` replaced and ``n_chars``, if there, brought up to date; a NULL text stays."""
    import pyarrow as pa

    from .common import text_slices

    columns = docs.columns

    def run(batches):
        for batch in text_slices(batches):
            clean = []
            for text in batch.column("text").to_pylist():
                spans = [] if text is None else sorted([*base_spans(text), *literal_spans(text)])
                clean.append(redacted(text, spans, mark) if spans else text)
            at = columns.index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
            if "n_chars" in columns:
                at = columns.index("n_chars")
                counts = [old if t is None else len(t) for t, old in zip(clean, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
