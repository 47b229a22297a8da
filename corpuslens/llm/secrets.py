"""Secret scans: fixed patterns, and strings on which a public vocabulary spends too many tokens."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, change_rows, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Fewest characters of a string that the token test judges, and characters for each token that it may have at most.
LEAST, RATIO = 15, 2.2
#: Unbroken strings; / . and = part them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
PART = re.compile(r"[^/.=]+")
#: Lengths of hex digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
#: A digest that is named, in base64.
NAMED_DIGEST = re.compile(r"""(?i:md5|sha-?(?:1|224|256|384|512))[-:=]["']?([A-Za-z0-9+/]+={0,2})""")
DIGEST_BYTES = (16, 20, 28, 32, 48, 64)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Identifiers: words, numbers and words with a few digits behind, joined by . _ - / or =
IDENTIFIER = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,4}|\d+)(?:[._/=-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,4}|\d+))*[._/=-]*")
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Changes between upper and lower case that a string without digits has at least.
CASE_CHANGES = 6
CASE_CHANGE = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")


@lru_cache(maxsize=2)
def _encoding(ranks_file: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


caches.append(_encoding)


def is_known(s: str) -> bool:
    """Whether the string is a UUID, a hex digest or an identifier."""
    return bool(UUID.fullmatch(s) or (len(s) in DIGESTS and HEX_ONLY.fullmatch(s)) or IDENTIFIER.fullmatch(s))


def looks_random(s: str, ranks_file: str, most_chars_per_token: float) -> bool:
    """Whether the string is neither digest nor identifier and has few characters for each of its tokens. It needs
    letters, and digits or a case that changes often."""
    if len(s) < LEAST or not any(c.isalpha() for c in s) or is_known(s):
        return False
    if not any(c.isdigit() for c in s) and len(CASE_CHANGE.findall(s)) < CASE_CHANGES:
        return False
    return len(s) <= most_chars_per_token * len(_encoding(ranks_file).encode_ordinary(s))


def _outside(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the taken ranges leave of a range."""
    for b, c in sorted(taken):
        if b < end and start < c:
            if start < b:
                yield start, b
            start = max(start, c)
    if start < end:
        yield start, end


def random_spans(text: str, taken: list[tuple[int, int]], ranks_file: str, most_chars_per_token: float) -> Iterator[tuple[int, int]]:
    """The spans of the token test outside the taken ranges and named digests.

    An unbroken string is judged by its parts between / . and =: known parts (identifiers, digests, UUIDs) are left
    alone, and what stands in a row between them is judged as one, so that neither a readable path in front hides a
    random part, nor a random part takes the path with it, nor a slash within a key splits it.
    """
    taken = list(taken)
    low = text.lower()
    if "md5" in low or "sha" in low:
        taken += [m.span() for m in NAMED_DIGEST.finditer(text) if len(m[1].rstrip("=")) in [-(-8 * n // 6) for n in DIGEST_BYTES]]
    for m in CANDIDATE.finditer(text):
        for start, end in _outside(*m.span(), taken) if taken else (m.span(),):
            run: list[tuple[int, int]] = []
            for p in [*PART.finditer(text, start, end), None]:
                if p is not None and not is_known(p[0]):
                    run.append(p.span())
                elif run:
                    s, e = run[0][0], run[-1][1]
                    if looks_random(text[s:e], ranks_file, most_chars_per_token):
                        yield s, e
                    run = []


def spans_of(text: str, ranks_file: str | None = None, most_chars_per_token: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of a text, in code points, by start and then the order of KINDS.

    Within a kind, matches are leftmost and do not overlap; a match that fails its length is dropped after it has taken
    its characters. The token test adds spans of kind random outside the base spans; without a ranks file only the base
    kinds are found.
    """
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if ranks_file:
        found += [(s, e, "random") for s, e in random_spans(text, [x[:2] for x in found], ranks_file, most_chars_per_token)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal run of overlapping spans replaced by one mark; nothing else changes."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _run(ranks_file: str, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, 1):
                rows = [spans_of(t, ranks_file, ratio) for t in texts]
                base = [[x for x in r if x[2] != "random"] for r in rows]
                count = [pa.array([sum(x[2] == k for x in r) for r in rows], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
                clean = pa.array([redact(t, r) if r else None for t, r in zip(texts, rows, strict=True)], pa.string())
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *count, sha, pa.array([joined(r) for r in rows]), clean], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    return run


def scan_secrets(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", most_chars_per_token: float = RATIO) -> DataFrame:
    """Per row (id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted): secrets of the whole text.

    spans has kind:start:end of all spans, base_sha256 the digest of the base ones; redacted is the text with marks in
    their place, null where there are none. A null text is an empty one, without spans. Ids, null or repeated, keep
    their rows; other columns are ignored. Rows are independent: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_run(ranks_file, most_chars_per_token), f"id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")
    return out.withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, ranks_file: str, text_col: str = "text", chars_col: str | None = "n_chars", most_chars_per_token: float = RATIO) -> DataFrame:
    """docs with marks in place of the secrets of their texts, and chars_col set to the new length where a text changed;
    all other rows and columns stay as they are, null texts, null and repeated ids and repeated rows included. An empty
    table stays empty. No shuffle."""
    text_at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        changed = {k: redact(t, s) for k, t in enumerate(texts) if (s := spans_of(t, ranks_file, most_chars_per_token))}
        if not changed:
            return batch
        columns = list(batch.columns)
        old = columns[text_at]
        columns[text_at] = pa.array([changed.get(k, t) for k, t in enumerate(old.to_pylist())], old.type)
        if chars_at is not None:
            n = columns[chars_at]
            columns[chars_at] = pa.array([len(changed[k]) if k in changed else x for k, x in enumerate(n.to_pylist())], n.type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return change_rows(docs, text_col, run)
