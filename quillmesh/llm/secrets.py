"""Secret scans: three patterns, and a token-efficiency test for random strings that no pattern knows.

Ordinary words and identifiers take few tokens for their length; random strings take many. A run of key characters whose
characters per token fall below a limit under a tiktoken vocabulary is reported as `random`, unless it is a digest of a
known length, a UUID, a number, a date, a path or link, or an identifier made of words.

Cases: a null or empty text has no spans; overlapping spans of different kinds are all reported, in the order of start,
then kind; a very long run is looked at whole; repeated rows give repeated results; an empty table gives an empty result;
columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame

from quillmesh.llm.common import id_text, map_texts, sha256, spans_text

KINDS = ("assign", "access", "hex", "random")
#: Shortest run that the test looks at, and the characters per token below which it is random.
LEAST_CHARS, MOST_CHARS_PER_TOKEN = 16, 2.2
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_CHARS = frozenset({32, 40, 56, 64, 96, 128})

_FLAGS = re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS | re.IGNORECASE)
_ASSIGN_HINT = re.compile(r"pass?w|secret|token|api", _FLAGS | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", _FLAGS)
_HEX = re.compile(r"[0-9a-f]{24,}", _FLAGS)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}", _FLAGS)
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+", _FLAGS)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", _FLAGS)
_WORDS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}(?![a-z])", _FLAGS)


@lru_cache(maxsize=2)
def tokens(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text
    if "=" in low or ":" in low:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if _ASSIGN_HINT.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def known(run: str) -> bool:
    """Digests, UUIDs, numbers, and identifiers and paths that are mostly words."""
    if _UUID.fullmatch(run) or run.isdigit() or (_HEX_ONLY.fullmatch(run) and len(run) in DIGEST_CHARS):
        return True
    if not any(c.isdigit() for c in run) and (run.islower() or run.isupper() or run.istitle()):
        return True
    return sum(len(m) for m in _WORDS.findall(run)) >= 0.8 * sum(c.isalnum() for c in run)


def random_spans(text: str, encoding: tiktoken.Encoding, limit: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    out = []
    for m in _RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if len(run) >= LEAST_CHARS and not known(run) and len(run) < limit * len(encoding.encode_ordinary(run)):
            a = m.start() + m[0].index(run)
            out.append((a, a + len(run), "random"))
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secrets(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, counts by kind, spans (array of start, end, kind, secret); with digests the spans as text and a SHA-256."""
    tail = "base_sha256 string, spans string" if digests else "spans array<struct<start:int,end:int,kind:string,secret:string>>"

    def make():
        encoding = tokens(path, pattern)

        def kernel(ids, texts):
            counts, base_text, spans = [], [], []
            for text in texts:
                base = ordered(base_spans(text))
                extra = [s for s in random_spans(text, encoding) if not any(a < s[1] and s[0] < b for a, b, _ in base)]
                found = ordered(base + extra)
                counts.append([sum(s[2] == k for s in base) for k in KINDS[:3]] + [len(extra)])
                base_text.append(sha256(spans_text(base).encode()))
                spans.append(spans_text(found) if digests else [{"start": a, "end": b, "kind": k, "secret": text[a:b]} for a, b, k in found])
            return [ids, *([c[i] for c in counts] for i in range(4)), *([base_text, spans] if digests else [spans])]

        return kernel

    return map_texts(id_text(docs), make, f"doc_id long, n_assign long, n_access long, n_hex long, n_random long, {tail}")
