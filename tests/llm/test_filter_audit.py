"""Operator 11 against a direct application of the filters in every order."""

import collections
import itertools
import random
import re

from volspan.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, n long, word string, mask int, h long, part string, good int"


def brute(docs, labels):
    marks = {i: (any(q == 1 for j, q, _ in labels if j == i), any(t == 1 for j, _, t in labels if j == i)) for i, _, _ in labels if i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        failed.append((lang or "", {k for k, x in f.items() if x}, *marks.get(i, (False, False))))
    out, shapley = {}, collections.Counter()
    parts = {p for p, *_ in failed}
    for order in map("".join, itertools.permutations("ABCDE")):
        left = failed
        for step, x in enumerate(order, 1):
            gone = [r for r in left if x in r[1]]
            left = [r for r in left if x not in r[1]]
            for p in parts:
                mine = [r for r in gone if r[0] == p]
                shapley[p, x] += len(mine)
                all_x = [r for r in failed if r[0] == p and x in r[1]]
                out[p, order, step] = (sum(r[0] == p for r in left), len(mine), len(all_x) - len(mine), sum(r[1] == {x} for r in all_x), sum(r[2] for r in mine), sum(r[3] for r in mine))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdéß", k=r.randint(1, 7))) for _ in range(300)] + ["#tag", "A|B", "UPPER"]
    texts = [" ".join(r.choices(vocab[: r.choice([20, 90, 300, 303])], k=r.choice([5, 150, 199, 200, 201, 260]))) for _ in range(40)]
    texts += [None, "", " \n\x0b\t ", "A", "word\t\tword \r\n word", "same " * 300, "x" * 5000, texts[0].replace(" ", "  ", 9).replace(" ", "\n", 5), "日本 " * 250]
    docs = [(k, t, r.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    docs += [(90 - k, texts[k % 7], "en") for k in range(30)] + [(3, texts[3], "en")] * 5 + [(3, texts[4], "de")] * 2 + [(None, texts[5], None)] * 4 + [(None, None, "xx"), (-7, texts[6], "fr")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 95, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(i, t, lang, 1, "w", 2, 3, "p", 4) for i, t, lang in docs], SCHEMA).repartition(3)
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(docs, labels)
    assert filter_audit.audit(table.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
