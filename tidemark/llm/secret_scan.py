"""Secret scans by linking the parts of multipart credentials.

Strong patterns (assignments, access identifiers, long hex runs) are reported by themselves. Weak candidates, such as a
user name, an opaque string or an endpoint, are too common to report alone: they are kept as intervals, each widened to a
window inside its scope (a paragraph), and joined on overlap; a weak candidate is reported only if a complementary part
lies in its window. The interval join is a sweep over a document's sorted parts, so a document costs time in proportion to
its text and its linked parts, and nothing is shuffled.

Defined results: a null text is an empty one (no spans); repeated rows each get a result; spans of one kind never overlap;
offsets are code points, end exclusive; a null doc_id stays null; texts of any length are scanned whole; other columns aren't
read by a scan and carried along by a redaction; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_rows, spread, table

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
BASE_KINDS = KINDS[:3]
#: Characters between two parts of one credential, at most.
WINDOW = 160

# Flag A: letters match in either case, but only ASCII ones (no long s, no Kelvin sign).
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIN_VALUE = 6

# A name may follow a prefix (DB_USER), but a secret_access_key is the secret, not who it belongs to.
_IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|(?<!secret_)access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.I | re.A,
)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}")
_SCOPE_END = re.compile(r"\n[\x20\t]*\n")

#: What completes what. A weak part is reported if a part of one of these kinds is in its window.
_COMPLEMENTS = {
    "identifier": {"assign", "hex", "opaque"},
    "opaque": {"access", "identifier"},
    "endpoint": {"identifier", "access", "assign"},
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind; matches that are too short are dropped after matching."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _opaque(value: str) -> bool:
    """Letters of both cases and digits, as generated keys have and words have not."""
    return any(c.isdigit() for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("identifier", m.start(), m.end()) for m in _IDENTIFIER.finditer(text)]
    if "://" in text:
        found += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    return found


def linked_spans(text: str, base: list[tuple[str, int, int]], window: int = WINDOW) -> list[tuple[str, int, int]]:
    """Weak parts that overlap, widened by the window and within one scope, a complementary part."""
    weak = weak_parts(text)
    if not weak and not any(k == "access" for k, _, _ in base):
        return []
    weak += [("opaque", m.start(), m.end()) for m in _OPAQUE.finditer(text) if _opaque(m[0])]
    taken = sorted((s, e) for _, s, e in base)
    free, i = [], 0
    for k, s, e in sorted(weak, key=lambda x: x[1]):  # a weak part inside a strong one is that strong one
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            free.append((k, s, e))
    ends = [m.start() for m in _SCOPE_END.finditer(text)]
    parts = sorted([*base, *free], key=lambda x: (x[1], x[2]))
    found, open_parts, scope = set(), [], 0
    for part in parts:
        kind, start, end = part
        crossed = False
        while scope < len(ends) and ends[scope] < start:
            scope, crossed = scope + 1, True
        open_parts = [] if crossed else [x for x in open_parts if x[2] + window >= start]
        for other in open_parts:
            if other[0] in _COMPLEMENTS.get(kind, ()):
                found.add(part)
            if kind in _COMPLEMENTS.get(other[0], ()):
                found.add(other)
        open_parts.append(part)  # parts have three characters at least, so a window holds a bounded number
    return sorted(found, key=lambda x: x[1])


def all_spans(text: str | None, window: int = WINDOW) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    text = text or ""
    by = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text), key=by)
    return base, sorted([*base, *linked_spans(text, base, window)], key=by)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones merged, replaced by the mark; null stays null."""
    if not text:
        return text
    spans = sorted((s, e) for _, s, e in all_spans(text)[1])
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: id, base (kind:start:end strings) and spans (base ones and linked ones)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, text in rows:
            base, spans = all_spans(text, window)
            yield i, [written([x]) for x in base], [written([x]) for x in spans]

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, base array<string>, spans array<string>", scan)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets of each text replaced by a mark and n_chars, if there is such a column, of the new text; other
    columns as they were."""
    columns = docs.columns
    at_text, at_n = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def clean(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            text = redact(row[at_text])
            if text is not row[at_text]:
                row = list(row)
                row[at_text] = text
                if at_n is not None:
                    row[at_n] = len(text)
            yield tuple(row)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_rows(docs, schema, clean)


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )
