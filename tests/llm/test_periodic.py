"""Operator 13 against a comparison of all words at all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from volspan.llm import periodic, queries
from volspan.llm.common import read_table

WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(words):
    """(start, length, period) of all runs: every maximal stretch at every period, kept where no smaller period fits it."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                length = i - start + q
                inside = words[start : start + length]
                if length >= max(6, 4 * q) and not any(inside[p:] == inside[:-p] for p in range(1, q)):
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs, drop = brute(w), set()
    for s, length, q in runs:
        drop |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def texts():
    r = random.Random(3)
    out = [None, "", " \n\t\x0b ", "a", "a a a a a", "a a a a a a", "A a " * 9, "    " * 12, "日本 語 " * 40, "x" * 50_000, "ab\tcd\n" * 700 + "ab x " * 300, "w " * 30_000]
    for _ in range(150):
        n = r.randint(1, 120)
        out.append(r.choice([" ", "  ", "\n"]).join(r.choices("abc", k=n)))
        parts = ["".join(r.choices("abcd", k=r.randint(1, 4))) for _ in range(r.randint(1, 12))]
        out.append(" ".join(r.choices("abxyz", k=r.randint(0, 9)) + parts * r.randint(2, 9) + parts[: r.randint(0, 9)] + r.choices("abxyz", k=r.randint(0, 9))))
    # Periods in periods, runs that overlap, and neighbours that share all but one word.
    out += [" ".join((["a"] * 7 + ["b"]) * 6), " ".join("ab" * 5 + "ba" * 5), " ".join(("abcabcabcabcd" * 5)), " ".join("abab" * 4 + "c" + "abab" * 4)]
    return out


@pytest.mark.parametrize("block", [1 << 19, 7])
def test_runs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    some = [t for t in texts() if block > 7 or len(t or "") < 2000]
    data = "".join(t or "" for t in some).encode()
    off = np.cumsum([0, *(len((t or "").encode()) for t in some)])
    starts, ends, upto, runs, drop = periodic.find_runs(np.frombuffer(data, np.uint8), off)
    out, cuts = periodic.joined_words(np.frombuffer(data, np.uint8), starts, ends, upto, ~drop)
    for k, t in enumerate(some):
        w = re.findall(WORD, t or "")
        want = brute(w) if len(w) < 5000 else [(0, len(w), 1)]
        got = [tuple(r[1:]) for r in runs.tolist() if r[0] == k]
        assert got == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert out[cuts[k] : cuts[k + 1]].tobytes().decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_a_misleading_fingerprint_is_read_again(monkeypatch):
    """With fingerprints that can't tell words apart, every text is still right."""
    real = periodic.PrefixHash

    class Blind(real):
        def of(self, starts, ends):
            return np.zeros(len(starts), np.uint64)

    monkeypatch.setattr(periodic, "PrefixHash", Blind)
    some = [t for t in texts() if len(t or "") < 2000][:60]
    data = "".join(t or "" for t in some).encode()
    off = np.cumsum([0, *(len((t or "").encode()) for t in some)])
    runs = periodic.find_runs(np.frombuffer(data, np.uint8), off)[3]
    for k, t in enumerate(some):
        assert [tuple(r[1:]) for r in runs.tolist() if r[0] == k] == brute(re.findall(WORD, t or ""))


def test_query_columns(spark):
    rows = [(k, t) for k, t in enumerate(texts()) if len(t or "") < 9000] * 2
    rows += [(None, "a b " * 9), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, g int, words string, runs int").repartition(3)
    got = periodic.run_digests(periodic.periodic_runs(periodic.planted(docs))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert periodic.run_digests(periodic.periodic_runs(periodic.planted(docs.limit(0)))).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert got == {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").collect()}
    assert sum(r[1] > 0 for r in got.values()) > 5
