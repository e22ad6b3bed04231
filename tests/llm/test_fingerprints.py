"""Texts made to collide under weak hashes, in one partition: two different ones are never taken for equal."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from volspan.llm import decontaminate, jaccard_join, packing, suffix_dedup, textscan, token_files, tokens
from volspan.llm.queries import tokenizer


def thue_morse(n, a, b):
    return "".join(a if k.bit_count() % 2 == 0 else b for k in range(n))


PAIRS = [(thue_morse(n, "x", "y"), thue_morse(n, "y", "x")) for n in (64, 128, 256, 512, 1024, 2048, 4096)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [t for pair in PAIRS for t in pair] + [f"a {x} b {y} c" for x, y in PAIRS]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), texts


def direct(items, point):
    return sum((int(x) + 1) * pow(point, k, textscan.PRIME) for k, x in enumerate(items)) % textscan.PRIME


def test_hashes_are_the_polynomial(monkeypatch):
    rng = np.random.default_rng(1)
    for items in (rng.integers(0, 256, 3000).astype(np.uint8), rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)):
        starts = rng.integers(0, 2000, 40)
        ends = starts + rng.integers(0, 1000, 40)
        for span in (1 << 24, 64):
            monkeypatch.setattr(textscan, "_SPAN", span)
            for which, point in enumerate(textscan.POINTS):
                want = textscan.mix(np.array([direct(items[a:b].tolist(), point) for a, b in zip(starts, ends, strict=True)], np.uint64))
                assert textscan.PrefixHash(items, which).of(starts, ends).tolist() == want.tolist()


def test_token_ids(spark, docs):
    from tokenizers import Tokenizer

    table, texts = docs
    ids = [[*x.ids, 2] for x in Tokenizer.from_file(tokenizer()).encode_batch(texts, add_special_tokens=False)]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    folder = token_files.new_folder(spark)
    got = token_files.read_token_files(token_files.write_token_files(table, folder, tokenizer()), folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(k, len(x), c) for k, (x, c) in enumerate(zip(ids, crc, strict=True))]
    whole = [r for r in packing.pack_documents(table, tokenizer()).collect() if len(ids[r["doc_id"]]) <= 1024]
    assert whole and all((r["length"], r["ids_crc32"]) == (len(ids[r["doc_id"]]), crc[r["doc_id"]]) for r in whole)


@pytest.mark.parametrize("known", [False, True])
def test_chunks_that_share_a_fingerprint_are_told_apart(known, monkeypatch):
    enc = tokens.Encoder(tokenizer())
    texts = ["some words of one size", "note that here are more", "", "and then some words of", "日本語 テキスト"] * 3
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    if known:
        enc.encode(data[: off[1]], off[:2])
    monkeypatch.setattr(enc, "prints", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    ids, upto = enc.encode(data, off)
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [x.ids for x in want]


@pytest.mark.parametrize("hot", [20_000, 3, 0])
def test_repeats(docs, hot):
    table, texts = docs
    texts = [t.encode() for t in texts]
    seen = collections.Counter(b[k : k + 200] for b in texts for k in range(len(b) - 199))
    for r in suffix_dedup.remove_repeats(table, hot_rows=hot).collect():
        b = texts[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert r["kept_sha256"] == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), r["doc_id"]


def test_links_and_matches(spark, docs):
    table, texts = docs
    assert all(r["n_links"] == 0 for r in jaccard_join.jaccard_classes(table).collect())
    bench = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(PAIRS)], "item_id long, text string")
    for r in decontaminate.find_contamination(table, bench).collect():
        assert r["items"] == sorted(str(k) for k, (x, _) in enumerate(PAIRS) if x in texts[r["doc_id"]].split(" "))


def test_cuts_end_with_their_text():
    """No cut looks past a text's end: with a tokenizer that has a token of two spaces, the ids of texts side by side are those of each alone."""
    encoder = tokens.Encoder(tokenizer())
    texts = ["x  ", "bcd", "", "a\n", "b .", ",c  ", " d", "e ", "", "f"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t) for t in texts)])
    cuts = set(encoder._chunks(data, off).tolist())
    alone = {int(off[k]) + c for k, t in enumerate(texts) if len(t) > 2 for c in encoder._chunks(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).tolist()}
    assert {c for c in cuts if any(off[k] <= c < off[k + 1] for k, t in enumerate(texts) if len(t) > 2)} == alone and 2 not in cuts
    ids, upto = encoder.encode(data, off)
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
