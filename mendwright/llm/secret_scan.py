"""Secret scans with multipart credential linking.

Three base kinds are found by pattern, each leftmost and non-overlapping: ``assign`` (a key word, a separator
and a value of 12 or more characters), ``access`` (``AKIA...``, 18 or more) and ``hex`` (16 or more of 0-9a-f).
Beside them stand weak candidates: identifiers (user, login, client id, account), short secrets (password,
passphrase, pwd, pin and key values, long base64 words) and endpoints (URLs and hosts with ports). A weak
candidate alone says nothing. The parts of each scope (a run of text without a blank line) are joined; a weak
candidate is reported only if its scope holds a secret, an identifier and, where both of these are weak, an
endpoint too. ``scan`` and ``redact`` join whole scopes; with a ``reach`` only parts that lie within so many
characters of each other meet. The join is one of intervals: by scope and kind, parts stand sorted by start with the
highest end so far, so one search tells whether any part meets a candidate. Base spans always stay.

Defined cases: null and empty texts have no spans; equal spans of one kind count once; rows are independent,
so repeated rows repeat their result; extra columns are ignored (``redact`` keeps them). Time is that of a sort of
the parts, whatever their lengths.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from mendwright.llm.common import blocks, row_blocks, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "identifier", "short_secret", "endpoint")
WEAK_IDENTIFIER = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"""\b(?:pass(?:word|wd|phrase)?|pwd|pin|secret(?:_?key)?|token|api_?key|private_?key|access_?key|auth(?:_?key)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%-]{4,})|(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b(?:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp|ssh)://[^\s"'<>]+|\b(?<![a-z0-9-])(?<![a-z0-9-]\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}\b|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}""", re.IGNORECASE | re.ASCII)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the three base kinds, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def linked_spans(text: str, base: list[Span], reach: int | None = 200) -> list[Span]:
    """The weak candidates whose complementary parts co-occur within their scope (and ``reach`` characters, unless None)."""
    weak = [("short_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text)] if "=" in text or ":" in text or "/" in text or base else []
    if not base and not weak:  # no secret of any kind, so nothing can be linked
        return []
    weak += [("identifier", m.start(), m.end()) for m in WEAK_IDENTIFIER.finditer(text)]
    if "://" in text or ":" in text or "=" in text:
        weak += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    taken = merged([(a, b) for _, a, b in base])
    weak = [w for w in dict.fromkeys(weak) if not _covered(w, taken)]
    if not weak:
        return []
    fences = [m.start() for m in BLANK_LINE.finditer(text)]
    within = reach if reach is not None else len(text)
    index: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
    for kind, a, b in sorted([*base, *weak], key=_order):
        starts, ends = index.setdefault((bisect_left(fences, a), kind), ([], []))
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)

    def meets(a: int, b: int) -> set[str]:
        """The kinds with a part in this scope whose interval, widened by the reach, overlaps this one."""
        scope, found = bisect_left(fences, a), set()
        for kind in KINDS:
            if part := index.get((scope, kind)):
                k = bisect_right(part[0], b + within)
                if k and part[1][k - 1] >= a - within:
                    found.add(kind)
        return found

    # what a rule asks for beside a part is never of the part's own kind, so the part itself may count
    return [w for w in weak if _linked(w[0], meets(w[1], w[2]))]


def _linked(kind: str, met: set[str]) -> bool:
    """Do the kinds that a weak candidate meets complete it?"""
    strong_secret, strong_identifier = bool(met & {"assign", "hex"}), "access" in met
    secret, identifier, endpoint = strong_secret or "short_secret" in met, strong_identifier or "identifier" in met, "endpoint" in met
    if kind == "identifier":
        return strong_secret or secret and endpoint
    if kind == "short_secret":
        return strong_identifier or identifier and endpoint
    return secret and identifier


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the spans, as disjoint ascending ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covered(span: Span, taken: list[tuple[int, int]]) -> bool:
    """Does one of the disjoint ascending spans overlap this one?"""
    k = bisect_left(taken, (span[2], 0))
    return k > 0 and taken[k - 1][1] > span[1]


def scan_text(text: str, reach: int | None = 200) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    return base, sorted([*base, *linked_spans(text, base, reach)], key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with the union of the spans replaced by ``[SECRET]``, but for endpoints."""
    out, at = [], 0
    for kind, a, b in spans:
        if kind == "endpoint" or b <= at:
            continue
        if a >= at and (a > at or not out or out[-1] != "[SECRET]"):
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans, the number of linked ones."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            rows = []
            for text in frame["text"]:
                base, spans = scan_text(text, reach)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    own = texts_of(docs, id_col, text_col)
    return own.mapInPandas(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """``docs`` with their columns, the found spans masked in ``text`` and ``n_chars`` (where there is one) counted anew."""
    counted = "n_chars" in docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_blocks(whole):
                text = [None if t is None else redacted(t, scan_text(t, reach)[1]) for t in batch.column("text").to_pylist()]
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))
                if counted:
                    at = batch.schema.get_field_index("n_chars")
                    batch = batch.set_column(at, batch.schema.field(at), pa.array([len(t or "") for t in text], batch.schema.field(at).type))
                yield batch

    return docs.mapInArrow(work, docs.schema)
