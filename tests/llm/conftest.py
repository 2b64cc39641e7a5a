import random

import pytest

CLASH = ("n", "key", "component", "block", "runs", "spans", "base", "token", "rejected_by", "start", "row", "uid", "group")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(rows, clash=True):
        names = CLASH if clash else ()
        schema = "doc_id long, text string, n_chars long" + "".join(f", {c} string" for c in names)
        return spark.createDataFrame([(i, t, None if t is None else len(t), *["x"] * len(names)) for i, t in rows], schema)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "Éa ß 中文 😀 words"),
    (6, "same text twice here for all to see and to read again now"),
    (6, "same text twice here for all to see and to read again now"),
    (7, "x" * 120_000),
    (8, "7" * 120_000),
    (9, "word " * 30_000),
    (900, " ".join(str(k % 1000) for k in range(250_000))),
    (901, " " * 1_000_000 + "a"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


@pytest.fixture(scope="session")
def prose():
    def make(seed, words, vocabulary=3000):
        r = random.Random(seed)
        out = []
        for k in range(words):
            out.append("".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(1 + r.randrange(vocabulary) % 4)))
            if k % 9 == 8:
                out[-1] += "."
        return " ".join(out)

    return make
