"""Secret scans with multipart credential linking.

Strong kinds (assign, access, hex) are reported wherever they stand. Weak parts say little alone:
an account identifier, a bare token of mixed letters and digits, an endpoint. Parts are joined as
intervals within a scope, a stretch of text without an empty line, and a weak part is reported
only when a complementary part that doesn't overlap it stands in the same scope:

* an identifier needs a secret (assign, hex or bare token);
* a bare token needs an identifier (access key or account) or an endpoint;
* an endpoint needs a secret.

The join never forms pairs: parts of a kind are sorted and disjoint, so the nearest one on either
side of a part decides. A weak part that overlaps a strong one is that strong one's and drops out.

Defined cases: null text is empty; a text of any length is scanned whole, in time that grows with
its length and the logarithm of its parts; spans are code points, end exclusive, ordered by start,
then by kind as in ``KINDS``, then by end; equal spans of different kinds are all reported; rows
that repeat, or whose doc_id is null or repeated, are scanned alike and apart; an empty table gives
no rows. Extra columns of any name are ignored (``scan``) or kept (``redact``).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _arrow_schema, alone

KINDS = ["assign", "access", "hex", "account", "bare", "endpoint"]
# The patterns of the strong kinds (with the least length of the part that counts).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Weak parts.
ACCOUNT = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>|]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])", re.A)
_SCOPE = re.compile(r"\n[ \t\r]*\n")
# Every match of a pattern has one of its hints, and every plain address the shape of ``_DOTTED``.
_DOTTED = re.compile(r"[0-9]\.[0-9]{1,3}\.[0-9]")
_ACCOUNT_HINTS = ("user", "login", "account", "client", "access", "tenant")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int]


def strong_spans(text: str) -> dict[str, list[Span]]:
    low = text.lower()
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(h in low for h in _ASSIGN_HINTS) else [],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def weak_spans(text: str, found: dict[str, list[Span]] | None = None) -> dict[str, list[Span]]:
    """The weak parts; with ``found``, bare tokens only where one has a possible complement in the text."""
    low = text.lower()
    account = [m.span() for m in ACCOUNT.finditer(text)] if any(h in low for h in _ACCOUNT_HINTS) else []
    endpoint = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text or _DOTTED.search(text) else []
    alone = found is not None and not (found["access"] or account or endpoint)
    bare = [] if alone else [m.span() for m in BARE.finditer(text) if any(c.isalpha() for c in m[0])]
    return {"account": account, "bare": bare, "endpoint": endpoint}


def merged(spans: list[Span]) -> list[Span]:
    """Sorted disjoint stretches that the spans cover."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Family:
    """Parts of one kind: sorted and disjoint, so both edges rise."""

    def __init__(self, parts: list[Span]):
        self.starts, self.ends = [a for a, _ in parts], [b for _, b in parts]

    def overlaps(self, part: Span) -> bool:
        k = bisect_right(self.ends, part[0])
        return k < len(self.starts) and self.starts[k] < part[1]

    def meets(self, part: Span, scope: Span) -> bool:
        """Whether the nearest member before or after the part, clear of it, starts inside the scope."""
        before, after = bisect_right(self.ends, part[0]) - 1, bisect_left(self.starts, part[1])
        return any(0 <= k < len(self.starts) and scope[0] <= self.starts[k] < scope[1] for k in (before, after))


def link_parts(text: str, found: dict[str, list[Span]], weak: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The weak parts with a complement in their scope."""
    if not any(weak.values()):
        return {k: [] for k in weak}
    edges = [0, *(m.end() for m in _SCOPE.finditer(text)), len(text) + 1]
    strong = Family(merged([s for spans in found.values() for s in spans]))
    weak = {k: [s for s in v if not strong.overlaps(s)] for k, v in weak.items()}
    secret = [Family(v) for v in (found["assign"], found["hex"], weak["bare"])]
    wanted = {"account": secret, "bare": [Family(found["access"]), Family(weak["account"]), Family(weak["endpoint"])], "endpoint": secret}

    def joined(kind: str, part: Span) -> bool:
        k = bisect_right(edges, part[0])
        return any(family.meets(part, (edges[k - 1], edges[k])) for family in wanted[kind])

    return {k: [s for s in v if joined(k, s)] for k, v in weak.items()}


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every reported span, in order."""
    text = text or ""
    found = strong_spans(text)
    found |= link_parts(text, found, weak_spans(text, found))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((k, a, b) for k, spans in found.items() for a, b in spans), key=lambda s: (s[1], order[s[0]], s[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    out = _arrow_schema(docs.sparkSession, schema)
    base = set(KINDS[:3])
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [secrets(t) for t in batch.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for k, _, _ in f) for f in found], pa.int64())
            digests = [hashlib.sha256(join(s for s in f if s[0] in base).encode()).hexdigest() for f in found]
            linked = pa.array([sum(k not in base for k, _, _ in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(count, KINDS[:3]), pa.array(digests, pa.string()), pa.array([join(f) for f in found], pa.string()), linked], schema=out)

    return docs.select("doc_id", "text").mapInArrow(alone(run), schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every reported character goes; each united stretch leaves one mark."""
    parts, at, reach = [], 0, -1
    for _, a, b in spans:
        if a >= reach:
            parts += [text[at:a], "[REDACTED]"]
            reach = b
        reach = max(reach, b)
        at = reach
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets cut out of ``text``; ``n_chars``, where there is one, follows changed texts."""
    names = docs.columns
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    out = _arrow_schema(docs.sparkSession, ddl)
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[text_at].to_pylist()
            chars = columns[chars_at].to_pylist() if chars_at is not None else None
            for i, text in enumerate(texts):
                if text and (spans := secrets(text)):
                    texts[i] = redact(text, spans)
                    if chars is not None:
                        chars[i] = len(texts[i])
            columns[text_at] = pa.array(texts, out.field(text_at).type)
            if chars is not None:
                columns[chars_at] = pa.array(chars, out.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(alone(run), ddl)


def op3_multipart_secrets(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs)
