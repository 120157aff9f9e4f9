"""Secret scans by assignment-aware lexing.

Base spans come from three fixed patterns (assign, access, hex) and always stay. Beyond them, the
text is lexed for assignments in the syntaxes of programs and configuration files: `name = value`,
`name: value`, `"name": "value"`, `export NAME=value`, `<name>value</name>`, values quoted or bare,
joined by `+`, or naming another constant, whose literal is then propagated. A literal is scored by
the sensitivity of its target's name and by its own length, alphabet and entropy; one that reaches
THRESHOLD gives a span of kind `literal` over the value as it stands in the text.

Defined results: null and empty texts have no secrets; rows are judged one by one, so repeated rows
get equal results and an empty table an empty one; texts are read whole; further columns are
ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.common import documents

KINDS = ("assign", "access", "hex")
_A = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Maximal runs: what is shorter than the least length fails wherever in the run it starts.
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
_GATE = re.compile("password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]{0,79}"
_LEX = re.compile(
    rf"""(?P<q>["']?)(?P<name>{_NAME})(?P=q)[\x20\t]*(?::=|=>|=(?![=>])|:(?![:/]))[\x20\t]*
    (?P<value>(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:[\x20\t]*\+[\x20\t]*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|{_NAME}))*|[^\s"',;{{}}\[\](|)][^\s"',;}}\])]*)
    |<(?P<tag>{_NAME})>(?P<body>[^<>\n]+)</(?P=tag)>""",
    re.VERBOSE,
)
_PIECE = re.compile(rf""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|{_NAME}""")
#: Name parts and how much they say that the value is to be kept secret.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "privatekey": 3.0, "auth": 1.5, "key": 1.0, "private": 1.5, "access": 1.0, "api": 1.0, "client": 0.5, "bearer": 2.0, "signature": 1.0, "salt": 1.0, "dsn": 1.0}
HARMLESS = {"public": -2.0, "id": -0.5, "name": -1.5, "file": -1.5, "path": -1.5, "url": -1.0, "type": -1.5, "size": -2.0, "length": -2.0, "count": -2.0, "example": -1.5, "max": -1.5, "min": -1.5, "expiry": -1.5}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|change_me|none|null|true|false|todo|example|placeholder|your.*|<.*>|\$\{.*\}|%\(.*\)s|\.+|-+)$")
THRESHOLD = 4.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base patterns, in order of start, then kind."""
    out = []
    if _GATE.search(text):
        out += [(m.start(), 0, m.end()) for m in _A.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)
    parts = [p.lower() for p in parts]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return sum(SENSITIVE.get(p, HARMLESS.get(p, 0.0)) for p in (*parts, *pairs))


def literal_score(value: str) -> float:
    """By length, entropy and alphabet: prose and numbers score low, random strings high."""
    if len(value) < 8 or " " in value or PLACEHOLDER.match(value):
        return -9.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(2.0, len(value) / 16) + (bits - 2.5) + 0.5 * (classes - 1)


def _plain(quoted: str) -> str:
    return re.sub(r"\\(.)", r"\1", quoted[1:-1])


def assignments(text: str) -> list[tuple[str, str, int, int]]:
    """(name, literal, start, end) of all assignments whose value resolves to a literal, constants propagated."""
    known: dict[str, str] = {}
    out = []
    for m in _LEX.finditer(text):
        if m["tag"]:
            name, value, a, b = m["tag"], m["body"].strip(), *m.span("body")
        else:
            name, raw = m["name"], m["value"]
            a, b = m.span("value")
            if raw[0] in "\"'":
                value = "".join(_plain(x) if x[0] in "\"'" else known.get(x, "") for x in _PIECE.findall(raw))
                if _PIECE.fullmatch(raw):
                    a, b = a + 1, b - 1
            else:
                value = known.get(raw, raw)
        known[name] = value
        out.append((name, value, a, b))
    return out


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of sensitive literals that no base span overlaps."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    out, i = [], 0
    ends = []  # the furthest end among base spans up to each
    for _, _, b in base:
        ends.append(max(b, ends[-1] if ends else 0))
    for name, value, a, b in assignments(text):
        s = name_score(name)
        if s < 1 or s + literal_score(value) < THRESHOLD:
            continue
        while i < len(base) and base[i][0] < b:
            i += 1
        if i == 0 or ends[i - 1] <= a:
            out.append((a, b))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans and further spans of one text."""
    base = base_spans(text or "")
    return base, further_spans(text or "", base)


SCHEMA = "doc_id long, text string, base array<struct<kind:string,a:int,b:int>>, more array<struct<kind:string,a:int,b:int>>"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        base, more = [], []
        for text in batch.column(1):
            x, y = scan(text.as_py())
            base.append([{"kind": KINDS[k], "a": a, "b": b} for a, k, b in x])
            more.append([{"kind": "literal", "a": a, "b": b} for a, b in y])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span), pa.array(more, span)], names=["doc_id", "text", "base", "more"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans (kind, a, b), base and more, for each row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, SCHEMA)


def redact(text: str | None, mask: str = "█") -> str | None:
    """The text with every found span masked."""
    if text is None:
        return None
    base, more = scan(text)
    out, at = [], 0
    for a, b in sorted([(a, b) for a, _, b in base] + more):
        if b > at:
            a = max(a, at)
            out += [text[at:a], mask * (b - a)]
            at = b
    return "".join(out) + text[at:]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, more = scan(text.as_py())
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
            every = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted([(a, k, KINDS[k], b) for a, k, b in base] + [(a, 3, "literal", b) for a, b in more]))
            n = Counter(k for _, k, _ in base)
            rows.append((n[0], n[1], n[2], hashlib.sha256(said.encode()).hexdigest(), every))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Offsets come from Python strings, which count code points.
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.mapInArrow(_digest_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
