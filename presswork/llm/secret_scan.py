"""Secret scans: fixed forms of credentials, and runs that a text vocabulary encodes badly.

The base forms are assignments, access keys and long hexadecimal runs. The method adds kind ``token``:
a run of key characters that has a window of whole tokens, at least ``MIN_RUN`` characters long, whose
characters per token under a tiktoken vocabulary fall below ``MAX_RATIO``, which marks random strings.
Plain words beside a random part thus do not hide it; the span goes on from its windows to the next "/" or
"=" or the run's end. Left out is what has the form of a known digest or identifier: a UUID; a run behind the name
of a digest that is as long as this digest is in hexadecimal or base64; a DOI; numbers with dots or dashes
between them (addresses, dates, versions); windows without letters and digits; and characters of a base find.

Null and empty texts have no spans, an empty table gives an empty result; very long texts are scanned whole. Offsets
are code points, end exclusive. Repeated rows give equal answers; other columns pass through or are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import append_from_text, filter_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_RUN = 20
MAX_RATIO = 2.0
KINDS = ("assign", "access", "hex", "token")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
# Whole runs either way: a shorter quantifier would only find what is dropped for its length.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_UUID = re.compile(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])")
# Bytes of a digest by its name.
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha-1": 20, "sha224": 28, "sha-224": 28, "sha256": 32, "sha-256": 32, "sha384": 48, "sha-384": 48,
                "sha512": 64, "sha-512": 64, "sha3-256": 32, "sha3-512": 64, "blake2b": 64, "blake2s": 32, "blake3": 32, "commit": 20}
ANY_DIGEST = ("digest", "checksum", "integrity", "etag", "hash")
_NAME = "|".join(sorted(map(re.escape, [*DIGEST_BYTES, *ANY_DIGEST]), key=len, reverse=True))
# a whole word, and at most a few signs between it and the run
_NAMED_BEFORE = re.compile(rf"(?<![A-Za-z0-9])({_NAME})(?:sum)?[\"'=:,\s(/-]{{1,4}}$", re.ASCII | re.IGNORECASE)
_NAMED_AT = re.compile(rf"({_NAME})[-_=:/]", re.ASCII | re.IGNORECASE)
_HEX_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_BASE64_DIGEST = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_DOI = re.compile(r"10\.[0-9]{4,9}/\S+")
_NUMBERS = re.compile(r"[0-9._/=+-]*")


def is_digest(name: str, run: str) -> bool:
    """Whether a run has the form of the digest of that name."""
    own = DIGEST_BYTES.get(name.lower())
    sizes = [own] if own else sorted(set(DIGEST_BYTES.values()))
    if _HEX_DIGEST.fullmatch(run):
        return any(len(run) == 2 * n for n in sizes)
    return bool(_BASE64_DIGEST.fullmatch(run)) and any(
        len(run) == -(-n // 3) * 4 and run.endswith("=" * (-n % 3)) or len(run) == -(-8 * n // 6) and "=" not in run for n in sizes)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Scanner:
    def __init__(self, vocabulary: str = VOCABULARY, min_run: int = MIN_RUN, max_ratio: float = MAX_RATIO):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.run = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % min_run)
        self.min_run, self.max_ratio = min_run, max_ratio

    def random_parts(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Spans of the random parts of a run."""
        if self.known(text, start, end):
            return []
        parts: list[tuple[int, int]] = []
        ends = [start]  # of the run's tokens
        for token in self.encoding.encode_ordinary(text[start:end]):
            ends.append(ends[-1] + len(self.encoding.decode_single_token_bytes(token)))
        last = 0
        for first in range(len(ends) - 1):
            while last < len(ends) and ends[last] - ends[first] < self.min_run:
                last += 1
            if last == len(ends):
                break
            a, b = ends[first], ends[last]
            if parts and b <= parts[-1][1] or b - a >= self.max_ratio * (last - first) or not any(map(str.isalnum, text[a:b])) \
                    or _NUMBERS.fullmatch(text, a, b):
                continue
            a = max(a, parts[-1][1] if parts else start)  # so each character is passed once
            while a > (parts[-1][1] if parts else start) and text[a - 1] not in "/=":
                a -= 1
            while b < end and text[b] not in "/=":
                b += 1
            while b < end and text[b] == "=":
                b += 1
            if parts and a <= parts[-1][1]:
                parts[-1] = (parts[-1][0], max(b, parts[-1][1]))
            else:
                parts.append((a, b))
        return [(a, b) for a, b in parts if not self.known(text, a, b)]

    @staticmethod
    def known(text: str, start: int, end: int) -> bool:
        """Whether a run, or what follows a digest's name inside it, is a digest or a DOI."""
        stop = end
        while stop > start and text[stop - 1] == ".":  # the end of a sentence
            stop -= 1
        if _DOI.match(text, start, stop):
            return True
        before = _NAMED_BEFORE.search(text[max(0, start - 16):start])
        if before and is_digest(before[1], text[start:stop]):
            return True
        at = _NAMED_AT.match(text, start, stop)
        return bool(at) and is_digest(at[1], text[at.end():stop])

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans."""
        base = base_spans(text)
        found, i = list(base), 0
        reach: list[tuple[int, int]] = []  # base spans merged where they overlap
        for b, _, e in base:
            if reach and b < reach[-1][1]:
                reach[-1] = (reach[-1][0], max(e, reach[-1][1]))
            else:
                reach.append((b, e))
        for m in self.run.finditer(text):
            while i < len(reach) and reach[i][1] <= m.start():
                i += 1
            known, k = [u.span() for u in _UUID.finditer(text, m.start(), m.end())], i
            while k < len(reach) and reach[k][0] < m.end():
                known.append(reach[k])
                k += 1
            at = m.start()
            for b, e in [*sorted(known), (m.end(), m.end())]:
                if b - at >= self.min_run:
                    found += [(x, 3, y) for x, y in self.random_parts(text, at, b)]
                at = max(at, e)
        return base, sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per document the count of each base kind, ``n_token``, the digest of the base spans and all spans."""

    def make():
        scanner = Scanner(**settings)

        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(6)]
            for t in texts:
                base, every = scanner.spans(t)
                for kind in range(4):
                    out[kind].append(sum(k == kind for _, k, _ in every))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(every))
            return out

        return work

    return append_from_text(docs.select(key, text), text, "n_assign long, n_access long, n_hex long, n_token long, "
                            "base_sha256 string, spans string", make, drop_text=True)


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[secret]", **settings) -> DataFrame:
    """The same rows and columns with ``mask`` in place of every span; null texts stay null.

    A column ``n_chars`` is brought up to date where a text was changed.
    """

    def make():
        scanner = Scanner(**settings)

        def clean(t: str) -> str | None:
            _, every = scanner.spans(t)
            if not every:
                return None
            parts, at = [], 0
            for b, _, e in every:
                if b >= at:
                    parts += [t[at:b], mask]
                at = max(at, e)
            return "".join([*parts, t[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    def redact(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        rows = append_from_text(rows, names[text], "redacted string", make)
        if "n_chars" in names:
            kind = rows.schema[names["n_chars"]].dataType
            rows = rows.withColumn(names["n_chars"], F.coalesce(F.char_length("redacted").cast(kind), names["n_chars"]))
        return rows.withColumn(names[text], F.coalesce("redacted", names[text]))

    return filter_rows(docs, redact)
