"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

Beside three patterns (assignments to well-known names, access key ids, long hexadecimal runs),
texts are lexed into pairs of a name and an expression (``name = "a" + B``, ``"name": "value"``,
``name := value``, ``name => value``, ``name: value``). Expressions are literals in single, double or
triple quotes, bare values and names, joined by ``+`` or by standing side by side, over several lines
inside parentheses or after ``+``. Names are constants from their assignment on, to the end of the braces
around it, so a literal that reaches a sensitive name through others is found where it stands.
Comments and quoted text are lexed like code, as secrets leak there too. A literal is scored by the
target's name, times how much the target's whole value looks random.

A constant is a node that points to its literals and to the constants it is made of, with the counts
of its characters: nothing is copied along chains of assignments, and the literals of all sensitive
targets are walked once, so time and memory are in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_texts, strings

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as a shorter run cannot match
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What the lexer stops at: the name and operator of a pair, and braces.
EVENT = re.compile(r"""(?<![\w.$-])["']?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)["']?[\x20\t]*(?::=|=>|=(?!=)|:(?![:/]))|(?P<open>\{)|(?P<close>\})""", re.ASCII)
TERM = re.compile(
    r"""(?P<triple>\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3})|(?P<quoted>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<bare>[A-Za-z0-9+/_.=$-]+)""", re.ASCII
)
BLANK, BLANK_LINES, QUOTE = re.compile(r"[\x20\t]*"), re.compile(r"(?:\s|\\\n)*"), re.compile(r"[\"']")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your[_-]?|xxxx|\*\*\*|<[^>]*>|\$\{?[a-z_]|^(?:true|false|none|null)$")

#: How sensitive a target is, by the words of its name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "pass": 0.7, "auth": 0.6, "bearer": 0.8, "signature": 0.5}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("connection", "string"): 0.7}
NAME_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "string")
THRESHOLD = 0.6
SHORTEST = 8
MOST = 1 << 62  # where counts of characters stop


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    one = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max([one, *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:]))])  # noqa: B905


class Value:
    """What a name stands for: literals of its own and other values, and the counts of its characters."""

    __slots__ = ("spans", "of", "counts", "plain")

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.of: list[Value] = []
        self.counts: Counter[str] = Counter()
        self.plain = False  # a placeholder or blank in it: no secret

    def literal(self, start: int, end: int, text: str) -> None:
        self.spans.append((start, end))
        self.counts.update(text)
        self.plain |= bool(PLACEHOLDER.search(text)) or any(c.isspace() for c in text)

    def constant(self, other: Value) -> None:
        self.of.append(other)
        self.plain |= other.plain
        for c, n in other.counts.items():
            self.counts[c] = min(MOST, self.counts[c] + n)

    def score(self) -> float:
        """0 to 1: short values and placeholders 0, else by entropy and the kinds of characters."""
        n = sum(self.counts.values())
        if n < SHORTEST or self.plain:
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in self.counts.values())
        kinds = sum(any(map(f, self.counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return min(1.0, entropy / 3.5) * (0.6 if kinds == 1 else 1.0)


class Scopes:
    """Constants by name; what braces enclose ends with them."""

    def __init__(self) -> None:
        self.known: dict[str, list[Value]] = {}
        self.inside: list[list[str]] = []

    def get(self, name: str) -> Value | None:
        stack = self.known.get(name)
        return stack[-1] if stack else None

    def set(self, name: str, value: Value) -> None:
        if self.inside:
            self.known.setdefault(name, []).append(value)
            self.inside[-1].append(name)
        else:
            self.known[name] = [value]

    def close(self) -> None:
        for name in self.inside.pop() if self.inside else ():
            self.known[name].pop()


def _expression(text: str, at: int, scopes: Scopes) -> Value:
    """The value of the terms from ``at`` on."""
    out, depth = Value(), 0
    bare: tuple[int, int] | None = None
    terms = 0
    at = BLANK.match(text, at).end()
    while True:
        while text.startswith("(", at):
            depth, at = depth + 1, BLANK_LINES.match(text, at + 1).end()
        term = TERM.match(text, at)
        if not term:
            break
        terms += 1
        at, kind = term.end(), term.lastgroup
        if kind != "bare":
            width = 3 if kind == "triple" else 1
            out.literal(term.start() + width, at - width, term.group()[width:-width])
        elif (known := scopes.get(term.group())) is not None:
            out.constant(known)
        else:
            bare = term.span()
        skip = BLANK_LINES if depth else BLANK
        after = skip.match(text, at).end()
        if text.startswith("+", after):
            at = BLANK_LINES.match(text, after + 1).end()
        elif kind != "bare" and QUOTE.match(text, after):
            at = after
        else:
            break
    if bare and terms == 1:  # a bare value alone is a literal, within an expression an unknown name
        out.literal(*bare, text[slice(*bare)])
    return out


def lexed(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    scopes, targets = Scopes(), []
    for event in EVENT.finditer(text):
        if event["open"]:
            scopes.inside.append([])
        elif event["close"]:
            scopes.close()
        else:
            value = _expression(text, event.end(), scopes)
            scopes.set(event["name"], value)
            how = name_score(event["name"])
            if how and (how := how * value.score()) >= threshold:
                targets.append((how, value))
    # best targets first: what one has reached needs no second walk
    found: dict[tuple[int, int], float] = {}
    seen: set[int] = set()
    for how, value in sorted(targets, key=lambda t: -t[0]):
        todo = [value]
        while todo:
            node = todo.pop()
            if id(node) not in seen:
                seen.add(id(node))
                todo += node.of
                for start, end in node.spans:
                    if end > start:
                        found.setdefault((start, end), how)
    return [(*span, how) for span, how in sorted(found.items())]


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    spans: list[tuple[str, int, int]] = []
    if any(h in low for h in ASSIGN_HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind; code points, end exclusive.

    Literals inside a span of another kind aren't said twice.
    """
    low = text.lower()
    spans = base_spans(text, low)
    if ("=" in text or ":" in text) and any(h in low for h in NAME_HINTS):
        base = sorted((a, b) for _, a, b in spans)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        for a, b, _ in lexed(text):
            before = bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                spans.append(("literal", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts by kind, the digest of the base kinds' spans, and all spans as text.

    A null text is empty; without secrets the digest is that of the empty string and ``spans`` is
    empty. Repeated rows are scanned each, a null id is kept as it is, and an empty table gives no rows.
    Very long texts are scanned whole, in time and memory in proportion to their length. Other columns
    are not read, so their names cannot clash.
    """

    def kernel(data: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        raw, rows = data.tobytes(), []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            found = scan(raw[a:b].decode("utf-8", "surrogatepass"))
            base = [s for s in found if s[0] != "literal"]
            rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_written(base).encode()).hexdigest(), _written(found)))
        n = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
        return {"n_assign": pa.array(n[0]), "n_access": pa.array(n[1]), "n_hex": pa.array(n[2]), "base_sha256": strings([r[3] for r in rows]), "spans": strings([r[4] for r in rows])}

    return map_texts(docs, kernel, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", id_col=id_col, text_col=text_col)
