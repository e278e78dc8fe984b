"""Operator 8: secret scans by token efficiency.

Fixed patterns find assignments, access keys and hex runs. Beyond them, runs of
key-like characters that a byte-level vocabulary encodes with few characters a
token are random strings: prose and names cost about four characters a token
there, random keys about two. Each part between / = - _ is measured, and the run
as a whole. Known digests (hex of a digest's length), UUIDs, numbers, runs of a
few characters and identifiers (mostly dictionary-like parts) are left out.

A linear-time pattern first tells which texts can hold a kind at all; only
those are searched for places. Places count code points.

Results for odd rows: a null or empty text has no spans (the digest of the empty
list); texts are searched whole; repeated rows are searched each; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_rows, text_slices

#: The base patterns, with the least length of what they must hold.
BASE = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: What a text must hold to be searched for a kind (linear time, may say yes too often).
MAY = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": "AKIA[A-Z0-9]{14}",
    "hex": "[0-9a-f]{16}",
    "random": "[A-Za-z0-9+/_=-]{20}",
}
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX = re.compile(r"[0-9a-fA-F]+\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Lengths of hex digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
PART = re.compile(r"[^/=_-]+")
NAME = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
LEAST_PART = 20
#: Fewer characters a token than this: random.
MAX_CHARS_A_TOKEN = 2.2
#: Fewer different characters than this: a repetition or a small alphabet. Share of letters in words that are one token: an identifier.
LEAST_DISTINCT, NAME_SHARE = 8, 0.5
#: Share of a run that lies in key-like parts (digits among letters) from which it is a key in groups.
GROUP_SHARE = 0.8


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _kinds(run: str) -> tuple[bool, bool, bool]:
    return any("0" <= c <= "9" for c in run), any("a" <= c <= "z" for c in run), any("A" <= c <= "Z" for c in run)


def is_name(run: str, encoding) -> bool:
    """Whether dictionary-like words hold most of a run's characters."""
    return sum(len(w) for w in NAME.findall(run) if len(encoding.encode_ordinary(w)) == 1 or len(encoding.encode_ordinary(f" {w.lower()}")) == 1) >= NAME_SHARE * len(run)


def is_random(run: str, encoding, limit: float = MAX_CHARS_A_TOKEN) -> bool:
    """Whether a run of key-like characters is random by its token efficiency."""
    if UUID.match(run) or (HEX.match(run) and len(run) in DIGESTS):
        return False
    digit, lower, upper = _kinds(run)
    if not (lower or upper) or len(run) >= limit * len(encoding.encode_ordinary(run)):
        return False
    if digit and lower and upper:
        return True
    parts = PART.findall(run)
    if len(parts) > 1 and sum(len(x) for x in parts if len(x) >= 4 and sum(_kinds(x)) > 1 and _kinds(x)[0]) < GROUP_SHARE * sum(map(len, parts)):
        return False
    return len(set(run)) >= LEAST_DISTINCT and not is_name(run, encoding)


def base_spans(text: str, kinds=tuple(BASE)) -> list[tuple[int, int, str]]:
    found = []
    for kind in kinds:
        pattern, group, least = BASE[kind]
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def random_spans(text: str, base: list[tuple[int, int, str]], encoding, limit: float = MAX_CHARS_A_TOKEN) -> list[tuple[int, int, str]]:
    """Random runs, or else random parts of them, that no base span touches."""
    found = []
    for m in RUN.finditer(text):
        near = [(a, b) for a, b, _ in base if a < m.end() and m.start() < b]
        if not near and is_random(m[0], encoding, limit):
            found.append((m.start(), m.end(), "random"))
            continue
        if UUID.match(m[0]):
            continue
        for part in PART.finditer(text, m.start(), m.end()):
            a, b = part.span()
            if b - a >= LEAST_PART and b - a < m.end() - m.start() and not any(x < b and a < y for x, y in near) and is_random(part[0], encoding, limit):
                found.append((a, b, "random"))
    return found


def _scan(texts: pa.Array, path: str, limit: float) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of each text of a column."""
    texts = texts.fill_null("")
    may = {kind: pc.match_substring_regex(texts, rule).to_pylist() for kind, rule in MAY.items()}
    for i in range(len(texts)):
        kinds = [k for k in BASE if may[k][i]]
        if not kinds and not may["random"][i]:
            yield [], []
            continue
        text = texts[i].as_py()
        base = base_spans(text, kinds)
        more = random_spans(text, base, vocabulary(path), limit) if may["random"][i] else []
        yield base, sorted(base + more, key=lambda s: (s[0], ORDER[s[2]]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch], path: str, limit: float) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = list(_scan(batch.column(1), path, limit))
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in rows], pa.int64()) for kind in BASE]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows]), pa.array([listed(spans) for _, spans in rows])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, path: str | None = None, limit: float = MAX_CHARS_A_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and all spans of each row."""
    path = path or default_path()
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _scan_batches(b, path, limit), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with each run of touching spans replaced by the mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, path: str | None = None, limit: float = MAX_CHARS_A_TOKEN, text_col: str = "text", count_col: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, with the spans of each text masked, and the
    code points of such a text counted anew where a column holds them."""
    path, at = path or default_path(), docs.columns.index(text_col)
    count_at = docs.columns.index(count_col) if count_col in docs.columns else None

    def kernel(batches):
        for batch in text_slices(batches, at):
            texts = batch.column(at)
            new = {i: masked(texts[i].as_py(), spans, mark) for i, (_, spans) in enumerate(_scan(texts, path, limit)) if spans}
            columns = list(batch.columns)
            if new:
                columns[at] = pa.array([new.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
                if count_at is not None:
                    columns[count_at] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(columns[count_at].to_pylist())], columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return text_rows(docs).mapInArrow(kernel, docs.schema)
