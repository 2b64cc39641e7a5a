"""The filter audit against running every order over the rows."""

import itertools
import random
import re

import pytest

from gridweave.llm.filter_audit import filter_audit, step_matrices, text_mask

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text: str) -> str:
    w = WORD.findall(text)
    said = {
        "A": len(w) < 50,
        "B": 100 * len(set(w)) < 65 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
    }
    return "".join(k for k, v in said.items() if v)


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, text, source in rows:
        text = text or ""
        again = i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows)
        judged.append((i, source or "", fails(text) + "E" * again))
    out = {}
    for part in {p for _, p, _ in judged}:
        here = [(i, f) for i, p, f in judged if p == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                share[c] += len(gone)
                seen = sum(c in f for _, f in here)
                out[part, order, k + 1] = [
                    len(left), len(gone), sum(c in f and any(e in f for e in order[:k]) for _, f in here), sum(f == c for _, f in here),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                assert seen == out[part, order, k + 1][1] + out[part, order, k + 1][2]
        for (p, order, k), counts in out.items():
            if p == part:
                counts.append(share[order[k - 1]])
    return out


def table_of(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, source string, part string, mask int, key string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(spark, rows, labels):
    got = filter_audit(*table_of(spark, rows, labels)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert list(r[3:]) == want[r.part, r.filter_order, r.step], r


def test_every_order_over_small_tables(spark, odd, prose):
    r = random.Random(3)
    texts = [prose(k, 20 + 9 * k) for k in range(9)] + ["SHOUTED words " * 40, "a # b", "so | so " * 60, prose(1, 70) + " $"]
    rows = [(k, r.choice(texts), r.choice(["one", "two", "two", None, ""])) for k in range(150)]
    rows += [(None, texts[0], "one"), (None, None, None), (7, rows[7][1], "two"), (3, rows[3][1], rows[3][2])]
    rows += [(1000 + i, t, "odd") for i, t in odd]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 150, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5000, 1, 1)]
    held(spark, rows, labels)


def test_one_text_and_one_id_hold_most_rows(spark):
    rows = [(k, "the same text", "s") for k in range(2000)] + [(5, f"text {k} of one id", "s") for k in range(500)] + [(None, f"{k}", "s") for k in range(300)]
    held(spark, rows, [(5, 1, 0), (0, 0, 1)])


def test_no_rows(spark):
    assert filter_audit(*table_of(spark, [], [])).count() == 0
    assert filter_audit(*table_of(spark, [(1, None, None)], [])).count() == 600


def test_matrices():
    m = step_matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    assert (m["removed"] + m["redundant"]).sum(axis=1).tolist() == [120 * bin(k).count("1") for k in range(32)]


@pytest.mark.parametrize("text", ["", "é " * 60, "A" * 6 + "é" * 114, "A" * 5 + "é" * 95, "a\x1cb c\x0bd", "x\x85y " * 50])
def test_masks_of_texts(text):
    want = sum(1 << "ABCD".index(c) for c in fails(text))
    assert text_mask(text.encode()) == want

