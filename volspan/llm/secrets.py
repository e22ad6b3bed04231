"""Operator 10: secret scans over whole texts.

Base kinds are patterns (assignments to credential names, access keys, long lower-case hexadecimal runs). The method adds ``entropy`` spans: over each candidate string a
window slides with incremental character counts, and where the Shannon entropy of its characters passes the bound of the string's character class, the window is part of a
span. Classes are digits, hexadecimal, letters of one case, letters of both cases, letters and digits of one case, of both cases, and strings with signs between. Allow-listed strings
(words and numbers joined by signs, longer words by how likely their letter pairs are, identifiers in UUID form, runs of the alphabet, documentation keys) and whole forms (host names, e-mail addresses and URLs as far as they are
made of words and numbers) are suppressed. Base spans are subtracted from entropy spans; a rest of ``LEAST_REST`` characters or more stays a finding.

Only texts that could hold a finding (a colon, an equals sign or 20 candidate characters in a row, tested in the JVM) go to Python.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract's base rules.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the shorter ones that the rule drops hide none
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Window and bits per character for each character class.
BOUNDS = {"digits": (24, 2.8), "hex": (20, 3.0), "one case": (24, 3.6), "letters": (24, 3.85), "one case and digits": (20, 3.6), "letters and digits": (20, 3.7), "signs": (20, 3.9)}
_CLASSES = (
    ("digits", re.compile(r"[0-9]+")),
    ("hex", re.compile(r"(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)")),
    ("one case", re.compile(r"[a-z]+|[A-Z]+")),
    ("letters", re.compile(r"[A-Za-z]+")),
    ("one case and digits", re.compile(r"[a-z0-9]+|[A-Z0-9]+")),
    ("letters and digits", re.compile(r"[A-Za-z0-9]+")),
)
#: A word of up to 19 letters (lower case, capitalised, capitals, or several capitalised words in one) with up to 4 digits, or a number.
_WORDS = r"(?:(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19}|[A-Z]?[a-z]{2,18}(?:[A-Z][a-z]{2,18})+)[0-9]{0,4}|[0-9]{1,19})"
ALLOWED = re.compile(
    rf"[-_/=+]*{_WORDS}(?:[-_/=+]+{_WORDS})*[-_/=+]*"
    r"|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"  # UUIDs
    r"|[A-Za-z0-9+/_=-]*EXAMPLE(?:KEY)?"  # keys of documentation
)
#: Longer words have the case of words, and in every window of letters at least this mean log2 chance of a letter after the one before it.
_LONG, _WORD_CASE = re.compile("[A-Za-z]{20,}"), re.compile("[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+")
WORD_WINDOW, LEAST_LIKELY = 24, -5.35
_EXAMPLE = re.compile(r"EXAMPLE(?:KEY)?|example(?:key)?")
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_SEQUENCES = " ".join([_LETTERS * 3, _DIGITS * 8, (_DIGITS + _LETTERS) * 3, (_DIGITS + _LETTERS[:6]) * 5])
_HOST = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|[a-z]{2})(?![A-Za-z0-9_+=-]|\.[A-Za-z0-9])"
#: Forms that are allowed as a whole: a URL's scheme and host, then its path (judged part by part below); e-mail addresses with a local part of words; host names. Neither the
#: user nor the query of a URL is part of them. A host name outside a URL has at most 19 characters a label that mixes letters and digits.
_URL_REST = re.compile(r"://(?P<user>[^\s/?#@]*@)?(?P<host>[A-Za-z0-9.-]+)(?P<port>:[0-9]+)?(?P<path>(?:/[^\s/?#\"'<>]*)*)")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_.+/=:@%-])(?:{_WORDS}(?:[._+-]{_WORDS})*@)?{_HOST}|(?<=@){_HOST}")
_LABEL = re.compile(r"[a-z0-9-]{20,}")
_PIECE = re.compile(r"[A-Za-z0-9]{20,}")
LEAST_REST = 6
_XLOGX = [0.0, *(c * math.log2(c) for c in range(1, 65))]


def entropy_spans(text: str, width: int, bound: float) -> list[tuple[int, int]]:
    """Merged windows of ``width`` characters whose entropy is at least ``bound`` bits a character; counts change by one in, one out."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        total += _XLOGX[n + 1] - _XLOGX[n]
        counts[c] = n + 1
        if k >= width:
            gone = text[k - width]
            n = counts[gone]
            total += _XLOGX[n - 1] - _XLOGX[n]
            counts[gone] = n - 1
        if k >= width - 1 and math.log2(width) - total / width >= bound:
            if out and k - width + 1 <= out[-1][1]:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((k - width + 1, k + 1))
    return out


def letter_pairs(vocabulary: str) -> np.ndarray:
    """Log2 of the chance of a letter after a letter (26 x 26, floored), from the words and parts of words in a tokenizer's vocabulary (a file of ranks)."""
    counts = np.full((26, 26), 0.5)
    with open(vocabulary, "rb") as f:
        for line in f:
            for word in re.findall(rb"[a-z]{3,}", base64.b64decode(line.split(b" ")[0]).lower()):
                letters = np.frombuffer(word, np.uint8) - 97
                np.add.at(counts, (letters[:-1], letters[1:]), 1)
    return np.log2(counts / counts.sum(axis=1, keepdims=True))


@functools.cache
def default_pairs() -> np.ndarray:
    import public_tokenizers

    return letter_pairs(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def wordlike(letters: str, pairs: np.ndarray) -> bool:
    """Whether the letter pairs of every window are as likely as those of words (of letters drawn at random, one window in a hundred is)."""
    codes = np.frombuffer(letters.lower().encode(), np.uint8).astype(np.int64) - 97
    upto = np.append(0.0, np.cumsum(pairs[codes[:-1], codes[1:]]))
    width = min(WORD_WINDOW, len(codes)) - 1
    return bool(((upto[width:] - upto[:-width]).min() / width) >= LEAST_LIKELY)


def allowed(word: str, pairs: np.ndarray) -> bool:
    """Whether a string is made of words, numbers and other allow-listed forms; longer words than ``ALLOWED`` knows are judged by their letter pairs."""
    if ALLOWED.fullmatch(word) is not None or word.lower() in _SEQUENCES:
        return True
    short = _LONG.sub(lambda m: "a" if _WORD_CASE.fullmatch(m.group()) and wordlike(m.group(), pairs) else m.group(), word)
    return short != word and ALLOWED.fullmatch(short) is not None


def _urls(text: str) -> Iterator[tuple[int, re.Match[str]]]:
    """(start, match from ``://`` on) of the URLs: the scheme is read back from its end, so a long text without one is passed over."""
    upto = 0
    while (at := text.find("://", upto)) >= 0:
        lo = at
        while lo > upto and text[lo - 1] in _SCHEME:
            lo -= 1
        while lo < at and not text[lo].isalpha():
            lo += 1
        m = _URL_REST.match(text, at) if lo < at else None
        if m:
            yield lo, m
        upto = m.end() if m else at + 3


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, touching ones joined, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _within(united: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The spans of a union that share a character with a span."""
    lo = bisect.bisect_right(united, start, key=lambda x: x[1])
    hi = bisect.bisect_left(united, end, lo, key=lambda x: x[0])
    return united[lo:hi]


def _allowed_forms(text: str, pairs: np.ndarray) -> list[tuple[int, int]]:
    """The union of the parts of a text that whole allowed forms cover."""
    out = []
    for begin, m in _urls(text):
        out += [(begin, m.start("user") if m["user"] else m.start("host")), m.span("host")]
        at = m.start("path")
        for part in m["path"].split("/")[1:]:
            words = CANDIDATE.findall(part)
            if all(allowed(w, pairs) for w in words):
                out.append((at, at + 1 + len(part)))
            else:
                out.append((at, at + 1))
            at += 1 + len(part)
    for m in _ADDRESS.finditer(text):
        if all(allowed(w, pairs) for w in _LABEL.findall(m.group())):
            out.append(m.span())
    return _united(out + [m.span() for m in _EXAMPLE.finditer(text)])


def _minus(start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What a union leaves of a span."""
    out = []
    for s, e in _within(cuts, start, end):
        if start < s:
            out.append((start, s))
        start = max(start, e)
    return [*out, (start, end)] if start < end else out


def _dense(word: str, pairs: np.ndarray) -> list[tuple[int, int]]:
    """The union of a candidate's dense windows: of each long piece without signs by its class, and of the whole where signs stand between letters of both cases and digits."""
    out = []
    for m in _PIECE.finditer(word):
        if not allowed(m.group(), pairs):
            name = next(name for name, pattern in _CLASSES if pattern.fullmatch(m.group()))
            out += [(m.start() + s, m.start() + e) for s, e in entropy_spans(m.group(), *BOUNDS[name])]
    if not word.isalnum() and any(c.isupper() for c in word) and any(c.islower() for c in word) and any(c.isdigit() for c in word):
        out += entropy_spans(word, *BOUNDS["signs"])
    return _united(out)


def _entropy_findings(text: str, base: list[tuple[int, int]], pairs: np.ndarray) -> list[tuple[int, int]]:
    """``base``: the union of the base spans. Unions are looked up by bisection, and a candidate's parts are judged one by one, so the time is in proportion to the text."""
    out, forms = [], None
    for m in CANDIDATE.finditer(text):
        if allowed(m.group(), pairs) and not _within(base, *m.span()):
            continue
        if forms is None:
            forms = _allowed_forms(text, pairs)
        for start, end in _minus(*m.span(), forms):
            dense = [(start + s, start + e) for s, e in _dense(text[start:end], pairs)]
            for lo, hi in _minus(start, end, base):
                part = text[lo:hi]
                if allowed(part, pairs):
                    continue
                spans = [(max(s, lo), min(e, hi)) for s, e in _within(dense, lo, hi)]
                if (lo, hi) != (start, end):
                    spans += [(lo + s, lo + e) for s, e in _dense(part, pairs)]
                for s, e in _united(spans):
                    # The character that joins a rest to a base span is none of the rest's.
                    s += s == lo > start and text[s] in "/_=+-"
                    e -= e == hi < end and text[e - 1] in "/_=+-"
                    if e - s >= LEAST_REST:
                        out.append((s, e))
    return out


def scan(text: str, pairs: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings in a text, in code points, by start and then kind. ``pairs``: ``letter_pairs`` of a vocabulary (a public one if None)."""
    pairs = default_pairs() if pairs is None else pairs
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = _united([(s, e) for _, s, e in found])
    found += [("entropy", s, e) for s, e in _entropy_findings(text, base, pairs)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


_FOUND = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def _scanner(pairs: np.ndarray, listed: bool):
    spans = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))
    names = ["doc_id", *[c.split()[0] for c in _FOUND.split(", ")], *["findings"] * listed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                found = [scan(t, pairs) if t is not None else [] for t in batch["text"].to_pylist()]
                base = [[x for x in f if x[0] != "entropy"] for f in found]
                count = [pa.array([sum(x[0] == kind for x in f) for f in found], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])
                rows = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], spans)] if listed else []
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *count, digest, pa.array([_joined(f) for f in found]), *rows], names)

    return run


def suspect(text: Column) -> Column:
    """Whether a text could hold a finding: every finding has a colon, an equals sign or 20 candidate characters in a row. False for nulls.

    Such characters stand between spaces, so only long parts between them are matched.
    """
    long = F.exists(F.split(text, " "), lambda w: (F.octet_length(w) >= 20) & w.rlike(CANDIDATE.pattern.replace(",}", "}")))
    return F.coalesce(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")) | long, F.lit(False))


def find_secrets(docs: DataFrame, pairs: np.ndarray | None = None, listed: bool = True) -> DataFrame:
    """Findings of each document: counts by kind, ``base_sha256``, ``spans`` (``kind:start:end`` joined) and, if ``listed``, ``findings`` (the same as structs).

    Null and empty texts have none; an empty table gives none. Rows are independent, so null or repeated ids are kept; other columns are ignored. Findings that start at the same
    place are in the order of their kinds. ``pairs`` as in ``scan``.
    """
    docs = docs.select("doc_id", F.when(suspect(F.col("text")), F.col("text")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = ", findings array<struct<kind:string,start:bigint,end:bigint>>" if listed else ""
    return docs.mapInArrow(_scanner(default_pairs() if pairs is None else pairs, listed), f"doc_id {id_type}, {_FOUND}{rows}")


def redact_text(text: str, pairs: np.ndarray | None = None, mark: str = "[SECRET]") -> str:
    out, upto = [], 0
    for _, s, e in scan(text, pairs):
        if s >= upto:
            out += [text[upto:s], mark]
        upto = max(upto, e)
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, pairs: np.ndarray | None = None) -> DataFrame:
    """The same rows and columns with each finding replaced by a mark; ``n_chars``, where there is one, follows the text. Null texts stay null; an empty table gives an empty one."""
    pairs = default_pairs() if pairs is None else pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                texts = pa.array([None if t is None else redact_text(t, pairs) for t in batch["text"].to_pylist()], pa.string())
                yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    could = suspect(F.col("text"))
    out = docs.filter(~could).unionByName(docs.filter(could).mapInArrow(run, docs.schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
