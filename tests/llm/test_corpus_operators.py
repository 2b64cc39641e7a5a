"""Joins, deduplication, nearest neighbours, language model and pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridweave.llm import ann, lm, ngram_join, paragraphs
from gridweave.llm import queries as Q
from gridweave.llm.common import Forest, connected_components, most_frequent, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n):
    w = WORD.findall(folded(t))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, percent=90, n=3):
    ids, sets = [i for i, _ in rows], [shingles(t, n) for _, t in rows]
    f = Forest(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                f.join(a, b)
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(f.root(k), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}, {i: len(s) for i, s in zip(ids, sets, strict=True)}


def near_copies(prose):
    """Chains and groups of near copies around the threshold."""
    r = random.Random(6)
    rows = []
    for g in range(12):
        words = prose(g, 60 + 25 * g).split()
        for c in range(1 + g % 7):
            if c:
                words = list(words)
                for _ in range(r.randrange(4)):
                    words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows) * 7 + 3, " ".join(words)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [3, 2048])
def test_ngram_join(spark, docs_of, odd, prose, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "SET_TOKENS", 500 if tile == 3 else 10**6)
    rows = near_copies(prose) + [(10_000 + i, t) for i, t in odd if i != 6] + [(20_000, "A b"), (20_001, "a B"), (20_002, "b a")]
    comp, size = brute_components(rows)
    got = ngram_join.ngram_join(docs_of(rows), tile=tile).collect()
    assert {r.doc_id: r.component_id for r in got} == comp and {r.doc_id: r.n_shingles for r in got} == size
    assert len(got) == len(rows)


def test_ngram_join_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    comp, size = brute_components(rows)
    got = Q.op10_ngram_jaccard(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == comp and {r.doc_id: r.n_shingles for r in got} == size


def test_ngram_join_empty_and_repeated(spark, docs_of, odd):
    assert ngram_join.ngram_join(docs_of([])).count() == 0
    got = ngram_join.ngram_join(docs_of([r for r in odd if r[0] == 6])).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(6, 6), (6, 6)]


@pytest.mark.parametrize("kinds", [1, 2, 7])
def test_big_groups_are_searched_whole(spark, kinds):
    """Members of any kind meet, though no task sees more than two tiles of the group and tiles meet in turn only."""
    from gridweave.llm.common import Tables

    r = random.Random(kinds)
    rows = [(k, 10, str(r.randrange(kinds) if r.random() < 0.6 else 0)) for k in range(150)]

    def links(sizes, kinds_held):
        assert len(kinds_held) <= 40
        first = {}
        return [(first[x], k) for k, x in enumerate(kinds_held) if first.setdefault(x, k) != k]

    t = Tables()
    index = spark.createDataFrame([(9, d, n) for d, n, _ in rows], "token long, doc_id long, n long")
    blocks = t.stored(ngram_join.blocks_of(index, 90, 8, 3), "test-blocks")
    payload = spark.createDataFrame(rows, "doc_id long, n long, kind string")
    found = ngram_join.searched(blocks, payload, "kind", links, 8, ngram_join.F.lit(1), 3, "test-links", t)
    comp = {x.node: x.component for x in connected_components(found).collect()}
    for d, _, kind in rows:
        assert comp.get(d, d) == min(i for i, _, x in rows if x == kind)
    t.drop()


def test_signature_tree_loses_nothing():
    r = np.random.RandomState(3)
    sets = []
    for g in range(40):
        base = r.randint(0, 2**63, 20 + 10 * g, dtype=np.int64).astype(np.uint64)
        for _ in range(4):
            keep = r.random_sample(len(base)) > 0.04
            sets.append(np.unique(base[keep]))
    sets.sort(key=len)
    sizes = np.array(list(map(len, sets)))
    maps = np.stack([ngram_join.bitmap(s) for s in sets])
    f, want = Forest(len(sets)), Forest(len(sets))
    for a, b in ngram_join.tree_links(sizes, maps, 90):
        f.join(a, b)
    exact = Forest(len(sets))
    for a, b in ngram_join.set_links(sets, 90):
        exact.join(a, b)
    for a in range(len(sets)):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 90 * (len(sets[a]) + len(sets[b]) - k):
                assert f.root(a) == f.root(b)
                want.join(a, b)
    assert [want.root(k) for k in range(len(sets))] == [exact.root(k) for k in range(len(sets))]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    f = {}

    def root(x):
        while f.setdefault(x, x) != x:
            x = f[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            f[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_never_end_unsettled(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, rounds=1)
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_joins_on_hot_keys(spark):
    from gridweave.llm.common import Tables, joined_on

    t = Tables()
    rows = [(k, 1 if k % 3 == 0 else k) for k in range(6000)] + [(9000, None), (9001, 7_777)]
    count = Counter(key for _, key in rows if key is not None and key != 7_777)
    values = [(key, n, f"v{key}") for key, n in count.items()]
    df = spark.createDataFrame(rows, "id long, key long")
    got = joined_on(df, spark.createDataFrame(values, "key long, n long, value string"), "key", "n", t)
    assert set(got.columns) == {"id", "key", "value"}
    assert sorted((r.id, r.key, r.value) for r in got.where("key is not null").collect()) == sorted((i, k, None if k == 7_777 else f"v{k}") for i, k in rows if k is not None)
    assert got.where("key is null").count() == 1
    t.drop()


def test_local_sessions_need_no_folder(spark):
    from types import SimpleNamespace as Some

    from gridweave.llm import common

    unset = Some(isDefined=lambda: False)
    context = Some(applicationId="other", master="spark://host:7077", _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: unset)))
    session = Some(conf=Some(get=lambda key, other: other), sparkContext=context, _jvm=spark._jvm, _jsc=spark._jsc)
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_root(session)
    context.master = "local[2]"
    assert common.scratch_root(session) == common.scratch_root(session)


def test_most_frequent(spark):
    df = spark.createDataFrame([(k, 10_000 // (k + 1)) for k in range(2000)], "token long, c long")
    tokens, n = most_frequent(df, "token", "c", 100)
    assert 80 <= len(tokens) <= 120 and set(range(60)) <= set(tokens.tolist()) and list(n) == sorted(n, reverse=True)
    assert len(most_frequent(df, "token", "c", 5000)[0]) == 2000 and len(most_frequent(df.where("false"), "token", "c", 5)[0]) == 0


# --- paragraphs ------------------------------------------------------------------------------------------------


def test_repeated_passages_are_cut(spark, docs_of, odd, prose):
    passage = prose(77, 60)
    rows = [(k, f"{prose(k, 30)} {passage} {prose(100 + k, 30)}") for k in range(10, 14)]
    line = prose(500, 60)
    changed = line.split()
    changed[30] = "other"
    rows += [(20, f"{prose(20, 40)}\n{line}\n{prose(21, 30)}"), (21, f"{prose(22, 40)}\n{' '.join(changed)}\n{prose(23, 30)}")]
    rows += [(30 + k, prose(300 + k, 100)) for k in range(5)]
    df = docs_of([*rows, *odd])
    found = paragraphs.paragraph_duplicates(df).collect()
    assert {r.doc_id for r in found} >= {11, 12, 13, 21} and not {r.doc_id for r in found} & {10, 20, *range(30, 35)}
    assert all(r.kept_in < r.doc_id for r in found) and "line" in {r.kind for r in found if r.doc_id == 21}
    out = paragraphs.without_duplicates(df)
    by = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns
    assert passage in by[10].text and by[10].n_chars == len(by[10].text)
    for k in (11, 12, 13):
        assert len(by[k].text.split()) <= 70 and by[k].text.startswith(prose(k, 30)[:20]) and by[k].n_chars == len(by[k].text)
    assert line in by[20].text and "other" not in by[21].text.split()
    assert all(by[30 + k].text == prose(300 + k, 100) for k in range(5))
    assert by[1].text is None and by[2].text == "" and out.where("doc_id = 6").count() == 2


def test_copies_go_whole(spark, docs_of, prose):
    rows = [(k, prose(1, 90)) for k in range(5)]
    out = paragraphs.without_duplicates(docs_of(rows)).collect()
    assert [r.doc_id for r in out if r.text.strip() and len(r.text.split()) > 24] == [0]
    assert paragraphs.without_duplicates(docs_of([])).count() == 0


def test_all_long_repeats_are_found(spark):
    rows = {r.doc_id: WORD.findall(r.text or "") for r in table(spark, SF, "documents").collect()}
    at = {}
    for i, w in rows.items():
        for k in range(len(w) - 50):
            at.setdefault(tuple(w[k : k + 51]), set()).add(i)
    hit = {i for ids in at.values() if len(ids) > 1 for i in ids}
    found = Q.op5_paragraph_minhash(spark, SF).collect()
    caught = {x for r in found for x in (r.doc_id, r.kept_in)}
    assert len(hit - caught) <= 0.02 * len(hit)


def test_pasted_passages_go_whole(spark, docs_of, prose):
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    long, sentence = plain(700, 52), plain(701, 60)
    rows = [(k, f"{plain(710 + k, 41 + k)} {long} {plain(730 + k, 33)}") for k in range(1, 5)]
    rows += [(k, f"{plain(750 + k, 20 + k)}. {sentence} {plain(770 + k, 15)}") for k in range(5, 8)]
    rows += [(8, f"{plain(790, 30)} {' '.join(sentence.split()[:45])} {plain(791, 20)}")]
    by = {r.doc_id: r.text for r in paragraphs.without_duplicates(docs_of(rows)).collect()}
    assert by[1] == rows[0][1] and by[5] == rows[4][1]
    for k in (2, 3, 4):
        assert by[k].split() == f"{plain(710 + k, 41 + k)} {plain(730 + k, 33)}".split()
    for k in (6, 7):
        assert by[k].split() == f"{plain(750 + k, 20 + k)}. {plain(770 + k, 15)}".split()


def test_every_long_run_holds_a_window():
    r = np.random.RandomState(4)
    for _ in range(50):
        run = r.randint(0, 2**62, paragraphs.GUARANTEED, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        keys = []
        for _ in range(2):
            a, b = (r.randint(0, 2**62, r.randint(1, 90), dtype=np.int64).astype(np.uint64) * np.uint64(2) for _ in range(2))
            at, key = paragraphs.embedded(np.concatenate((a, run, b)))
            keys.append({int(k) for x, k in zip(at, key, strict=True) if len(a) <= x <= len(a) + paragraphs.REACH})
        assert keys[0] & keys[1]


def test_rows_without_id_hide_no_link(spark, docs_of, prose):
    line = prose(800, 60)
    near = line.split()
    near[20] = "other"
    rows = [(0, line), (1, " ".join(near))]
    want = {tuple(r)[:4] for r in paragraphs.paragraph_duplicates(docs_of(rows)).collect()}
    assert {r[0] for r in want} == {1}
    assert {tuple(r)[:4] for r in paragraphs.paragraph_duplicates(docs_of([*rows, (None, line), (None, None)])).collect()} == want


def test_every_removal_is_a_true_repeat(spark):
    """Each removed run is, word for word or as a near copy, in the document that keeps it: none rests on a hash alone."""
    rows = {r.doc_id: (r.text or "") for r in table(spark, SF, "documents").collect()}
    words = {i: WORD.findall(t) for i, t in rows.items()}
    found = Q.op5_paragraph_minhash(spark, SF).collect()
    lines = {}
    for i, t in rows.items():
        units = lines.setdefault(i, [])
        joins = False
        for w in map(WORD.findall, t.split("\n")):
            if w and len(w) < paragraphs.WINDOW and joins:
                units[-1] += w
            elif w:
                units.append(w)
            joins = 0 < len(w) < paragraphs.WINDOW
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    linked = {}
    for r in found:
        run = words[r.doc_id][r.at : r.at + r.words]
        if r.kind == "embedded":
            assert f" {' '.join(run)} " in f" {' '.join(words[r.kept_in])} "
        else:
            linked.setdefault(r.component, []).append((r.doc_id, run, r.kept_in))
    for members in linked.values():
        kept = [w for w in lines[members[0][2]] if len(w) >= paragraphs.WINDOW]
        known, rest = [grams(w) for w in kept], [grams(run) for _, run, _ in members]
        moved = True
        while rest and moved:  # links may lead over other members
            near = [g for g in rest if any(100 * len(g & k) >= 80 * len(g | k) for k in known)]
            known, rest, moved = known + near, [g for g in rest if g not in near], bool(near)
        assert not rest


def test_hard_wrapped_near_copies_are_cut(spark, docs_of, prose):
    words = prose(900, 70).split()
    other = [*words[:33], "changed", *words[34:]]
    wrapped = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    rows = [(1, f"{prose(901, 9)}\n\n{wrapped(words, 12)}\n\n{prose(902, 8)}"), (2, f"{prose(903, 7)}\n\n{wrapped(other, 11)}\n\n{prose(904, 9)}")]
    by = {r.doc_id: r.text for r in paragraphs.without_duplicates(docs_of(rows)).collect()}
    assert by[1] == rows[0][1] and by[2].split() == prose(903, 7).split() + prose(904, 9).split()
    found, starts = paragraphs.line_words(b"a b\nc\n \nd\n" + b"w " * 24 + b"\ne\nf g")
    assert len(found) == 31 and starts.tolist() == [0, 3, 4, 28, 31]


def test_repeated_keys_are_found_over_batches(spark):
    r = np.random.RandomState(5)
    rows = [(int(d), int(a), int(k)) for d, a, k in zip(r.randint(0, 40, 3000), range(3000), r.choice([1, 2, 3, *range(10, 3000)], 3000), strict=True)]
    rows += [(7, 5000 + k, -5) for k in range(1500)] + [(k, 9000 + k, -6) for k in range(1500)]
    docs = {}
    for d, _, k in rows:
        docs.setdefault(k, set()).add(d)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, at int, key long"), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((x.doc_id, x.at, x.key) for x in got) == sorted(x for x in rows if len(docs[x[2]]) > 1)


@pytest.mark.parametrize("line", ["Is onhe.", "again", "one two three four five"])
def test_words_said_over_and_over_go_in_few_rows(spark, docs_of, prose, line):
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    step, count = len(line.split()), {}
    for times in (80, 320):
        rows = [(k, f"{plain(1000 + k, 40)} {' '.join([line] * (times + k))} {plain(1100 + k, 40)}") for k in range(12)]
        words = {k: t.split() for k, t in rows}
        found = paragraphs.paragraph_duplicates(docs_of(rows)).collect()
        gone = {k: set() for k in words}
        for r in found:
            run = words[r.doc_id][r.at : r.at + r.words]
            assert r.kept_in < r.doc_id and f" {' '.join(run)} " in f" {' '.join(words[r.kept_in])} "
            gone[r.doc_id] |= set(range(r.at, r.at + r.words))
        assert not gone[0] and all(gone[k] >= set(range(40, 40 + step * (times + k))) for k in range(1, 12))
        assert all(len(gone[k]) <= step * (times + k) + 4 for k in range(1, 12))
        # a row for some 50 words, not one for each return
        assert all(sum(r.doc_id == k for r in found) <= step * (times + k) // 30 + 4 for k in range(1, 12))


def test_sides_of_two_places_make_no_run(spark, docs_of, prose):
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    left, window, right = plain(1200, 40), plain(1201, 24), plain(1202, 40)
    rows = [(1, f"{left} {window} {plain(1203, 40)} {plain(1204, 40)} {window} {right}"), (2, f"{plain(1205, 40)} {left} {window} {right} {plain(1206, 40)}")]
    rows += [(3, " ".join(["be"] * 60)), (4, f"{plain(1207, 40)} {' '.join(['be'] * 300)} {plain(1208, 40)}")]
    rows += [(5, " ".join(["so", "on"] * 30)), (6, f"{plain(1209, 40)} {' '.join(['so', 'on'] * 150)} {plain(1210, 40)}")]
    words = {k: t.split() for k, t in rows}
    found = paragraphs.paragraph_duplicates(docs_of(rows)).collect()
    assert {r.doc_id for r in found} == {2, 4, 6}
    for r in found:
        assert f" {' '.join(words[r.doc_id][r.at : r.at + r.words])} " in f" {' '.join(words[r.kept_in])} "


def test_stretches_hold_all_windows():
    r = np.random.RandomState(8)
    for _ in range(50):
        at = np.cumsum(r.choice([1, 2, 2, 2, 2, 24, 25, 40], r.randint(0, 60)))
        keys = r.choice([5, 5, 5, 9], len(at)).astype(np.uint64)
        first, key, step, n = paragraphs.stretches(at, keys)
        each = [(a + k * s, x) for a, x, s, m in zip(first, key, step, n, strict=True) for k in range(m)]
        assert each == list(zip(at, keys, strict=True)) and (step[n > 1] <= paragraphs.WINDOW).all()
    assert [x.tolist() for x in paragraphs.stretches(np.arange(3, 900, 2), np.full(449, 7, np.uint64))] == [[3], [7], [2], [449]]


def test_parts_of_a_stretch_have_the_same_surroundings():
    reach, window = paragraphs.REACH, paragraphs.WINDOW
    for step, n in ((1, 200), (2, 90), (5, 30), (24, 9), (2, 5), (7, 1)):
        period = [b"%d" % k for k in range(step)]
        words = [b"x", b"y"] * 20 + (period * (n + window))[: (n - 1) * step + window] + [b"z"] * 30
        around = lambda at: (at - max(0, at - reach), words[max(0, at - reach) : at + window + reach])  # noqa: B023, E731
        parts = paragraphs.surroundings(words, 40, step, n)
        assert [a + k * step for a, m in parts for k in range(m)] == [40 + k * step for k in range(n)]
        assert all(around(a + k * step) == around(a) for a, m in parts for k in range(m)) and len(parts) <= 2 * -(-reach // step) + 1
        words[40 + (n - 1) * step // 2 + 3] = b"other"  # another text under the same id: each window by itself
        parts = paragraphs.surroundings(words, 40, step, n)
        assert all(around(a + k * step) == around(a) for a, m in parts for k in range(m)) and sum(m for _, m in parts) == n


def test_covering_keeps_all_words():
    r = np.random.RandomState(9)
    for _ in range(300):
        runs = [(int(a), int(a + w), int(k)) for a, w, k in zip(r.randint(0, 60, 9), r.randint(1, 25, 9), r.randint(0, 3, 9), strict=True)][: r.randint(0, 10)]
        words = lambda some: {k for a, z, _ in some for k in range(a, z)}
        out = paragraphs.covering(runs)
        assert words(out) == words(runs) and set(out) <= set(runs)
        assert all(words([x for x in out if x is not y]) != words(runs) for y in out)


def test_sliding_min():
    r = np.random.RandomState(6)
    for n, w in ((1, 1), (5, 5), (30, 7), (27, 27), (100, 27)):
        x = r.randint(0, 50, n).astype(np.uint64)
        assert list(paragraphs.sliding_min(x, w)) == [min(x[k : k + w]) for k in range(n - w + 1)]


def test_scratch_tables_are_dropped(spark, docs_of, prose):
    import os

    from gridweave.llm.common import scratch_root

    folder = scratch_root(spark).removeprefix("file:") + "/gridweave"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [(k, prose(k % 3, 80)) for k in range(9)]
    for run in (paragraphs.paragraph_duplicates, ngram_join.ngram_join, lm.score_documents):
        run(docs_of(rows)).collect()
        made = set(os.listdir(folder)) - before
        before |= made
        assert len(made) == 1, made  # the result itself


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tuned_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands <= paragraphs.MOST_BANDS
    r = np.random.RandomState(0)
    met = 0
    for _ in range(400):
        shared = r.randint(0, 2**63, 80, dtype=np.int64)
        a, b = (np.concatenate((shared, r.randint(0, 2**63, 10, dtype=np.int64))).astype(np.uint64) for _ in range(2))
        x, y = (paragraphs.minhash_bands(s, np.array([0]), bands, rows)[0] for s in (a, b))
        met += bool((x == y).any())
    assert met >= 0.97 * 400


# --- nearest neighbours ----------------------------------------------------------------------------------------


def brute_nearest(ids, v, i, k=20):
    s = v @ v[i]
    s[i] = -np.inf
    order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
    return ids[order], s[order]


def test_nearest_query(spark):
    pdf = table(spark, SF, "embeddings").toPandas()
    v, ids = np.stack(pdf.embedding).astype(np.float64), pdf.vec_id.to_numpy()
    got = Q.op3_one_bit_codes(spark, SF).toPandas()
    hits = total = 0
    for i in np.nonzero(ids % 20 == 0)[0]:
        mine = got[got.query_id == ids[i]].sort_values("rank")
        want, score = brute_nearest(ids, v, i)
        hits += len(set(want) & set(mine.vec_id))
        total += len(want)
        assert list(mine["rank"]) == list(range(1, 21)) and mine.score.is_monotonic_decreasing
    assert hits >= 0.95 * total


def test_nearest_small_blocks_ties_and_odd_rows(spark):
    r = np.random.RandomState(4)
    rows = [(k, [float(x) for x in r.standard_normal(8)], 1) for k in range(120)]
    rows += [(200, rows[3][1], 2), (201, rows[3][1], 2), (40, rows[40][1], 1)]  # ties and a repeated row
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] * 8, 0), (304, [1.0, 2.0], 0), (305, [], 0), (None, [1.0] * 8, 0)]
    rows += [(320, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid int")
    got = ann.nearest(df, vector_block=37, query_block=3, k=20).toPandas()
    good = [x for x in rows if x[0] is not None and x[0] < 300]
    ids, v = np.array([x[0] for x in good]), np.array([x[1] for x in good])
    hits = total = 0
    for q in (0, 20, 60, 80, 100):
        want, score = brute_nearest(ids, v, int(np.nonzero(ids == q)[0][0]))
        mine = got[got.query_id == q].sort_values("rank")
        hits += len(set(want) & set(mine.vec_id))
        total += len(want)
    assert hits >= 0.9 * total
    assert (got[got.query_id == 40].groupby("rank").size() == 2).all()  # the repeated row asks for itself, too
    assert 320 not in set(got.query_id)
    assert ann.nearest(df.where("false")).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 1, 2.0), (0, 2, 2.0)]


def test_estimates_are_unbiased_and_bounded():
    r = np.random.RandomState(5)
    v, q = r.standard_normal((4000, 64)), r.standard_normal((20, 64))
    center, turn = v.mean(axis=0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, length, fit = ann.encode(v, center, turn)
    assert bits.shape == (4000, 8)
    guess, bound = ann.estimate(q, bits, length, fit, center, turn)
    error = guess - q @ v.T
    assert abs(error.mean()) < 0.05 and (np.abs(error) <= bound).mean() > 0.99


# --- language model --------------------------------------------------------------------------------------------


def test_language_model_base(spark, docs_of, odd, prose):
    rows = [(i, t) for i, t in odd if i not in (7, 8)] + [(400 + k, prose(k, 200, 50)) for k in range(40)]
    got = lm.score_documents(docs_of(rows)).collect()
    words = [(i, [*WORD.findall(folded(t)), None]) for i, t in rows]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in words if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = {i: (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words}
    assert len(got) == len(rows)
    for r in got:
        a, b, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (a, b, n, out[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score)
    assert lm.score_documents(docs_of([])).count() == 0


def test_language_model_beats_unigrams_on_held_out_texts(spark):
    got = [r for r in Q.op2_recurrent_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_gradients():
    r = np.random.RandomState(0)
    m = lm.Model(np.arange(lm.HEAD, 0, -1.0), np.ones(lm.TAIL))
    for name in m.NAMES:
        setattr(m, name, getattr(m, name).astype(np.float64))
    ids = r.randint(0, lm.HEAD + lm.TAIL, (7, 5))
    mask = np.ones((6, 5), bool)
    mask[4:, 1] = False
    state = r.standard_normal((5, lm.HIDDEN)) * 0.1
    grads, _, _ = m.gradients(state, ids[:-1], ids[1:], mask)
    for name in m.NAMES:
        v = getattr(m, name)
        k = np.unravel_index(np.argmax(np.abs(grads[name])), v.shape)
        old, e = v[k], 1e-4
        v[k] = old + e
        up = m.gradients(state, ids[:-1], ids[1:], mask)[2]
        v[k] = old - e
        down = m.gradients(state, ids[:-1], ids[1:], mask)[2]
        v[k] = old
        assert math.isclose(grads[name][k], -(up - down) / (2 * e), rel_tol=1e-3, abs_tol=1e-8)


def test_probabilities_sum_to_one():
    m = lm.Model(np.arange(lm.HEAD, 0, -1.0), np.ones(lm.TAIL))
    states = m.run(np.zeros((1, lm.HIDDEN), np.float32), np.array([[3]]))[0]
    every = m.likelihood(np.repeat(states, lm.HEAD + lm.TAIL, axis=0), np.arange(lm.HEAD + lm.TAIL))
    assert math.isclose(np.exp(every.astype(np.float64)).sum(), 1, rel_tol=1e-4)


def test_windows_carry_the_state():
    r = np.random.RandomState(1)
    m = lm.Model(np.ones(lm.HEAD), np.ones(lm.TAIL))
    texts = [r.randint(0, lm.HEAD + lm.TAIL, n).astype(np.int16) for n in (1, 2, 31, 32, 33, 100, 257, 5)]
    want = lm.score_texts(m, texts, 0, lanes=1, steps=1000)
    for lanes, steps in ((2, 7), (3, 32), (64, 32)):
        assert np.allclose(lm.score_texts(m, texts, 0, lanes, steps), want, rtol=1e-4)
    assert len(lm.score_texts(m, [], 0)) == 0


def test_training_raises_the_likelihood():
    r = np.random.RandomState(2)
    segments = [np.tile(r.permutation(6)[:3] + 10, 30)[: 64 + 1].astype(np.int64) for _ in range(200)]
    m = lm.Model(np.ones(lm.HEAD), np.ones(lm.TAIL))
    before = lm.score_texts(m, segments[:20], 0).sum()
    m, seen = lm.train(m, segments * 3, lm.RATE)
    assert lm.score_texts(m, segments[:20], 0).sum() > 0.7 * before and seen == 600 * 64


def test_training_sees_every_token_and_carries_the_state(spark, docs_of, prose, monkeypatch):
    r = np.random.RandomState(3)
    texts = [r.randint(0, lm.HEAD + lm.TAIL, n).astype(np.int16) for n in (2, 33, 34, 65, 400, 3000)]
    states = []
    gradients = lm.Model.gradients
    monkeypatch.setattr(lm.Model, "gradients", lambda self, state, *a: (states.append(state), gradients(self, state, *a))[1])
    _, seen = lm.train(lm.Model(np.ones(lm.HEAD), np.ones(lm.TAIL)), texts, lm.RATE)
    assert seen == sum(len(t) - 1 for t in texts)
    assert len(states) == -(-2999 // lm.STEPS) and all(s.any() for s in states[1:])
    monkeypatch.undo()
    rows = [(k, prose(k, 20 + 90 * k)) for k in range(30)] + [(90, None)]
    trained = []
    whole = lm._trained
    monkeypatch.setattr(lm, "_trained", lambda *a: trained.append(whole(*a)) or trained[0])
    (total,) = {r.train_tokens for r in lm.score_documents(docs_of(rows)).collect()}
    assert trained[0][1] == total > 20_000


def test_tokens_of_a_batch_are_looked_up_once(odd):
    """Against words one by one; each different word of a batch is numbered once, however often it is there."""

    def one(w):
        group = next((k + 1 for k, letters in enumerate(lm._LETTERS) if set(letters) & set(w)), 0)
        last = w[-1:]
        kind = 1 if last == b"," else 2 if last == b"." else 0 if last.isalpha() or last >= b"\x80" else 3
        return (xxhash.xxh64_intdigest(w) >> 1) // 16 * 16 + 4 * group + kind

    rng = random.Random(4)
    texts = [t for _, t in odd] + [None, "", " ", "\x1c\x85 \u00a0x\n"]
    texts += ["".join(rng.choice("aZé ñü,.\t\n\x0b\x1f0") for _ in range(rng.randrange(12))) for _ in range(800)]
    whole = pa.array(texts, pa.string())
    table = np.array([lm.END, *{one(w.encode()) for t in texts[::3] for w in WORD.findall(folded(t))}])
    rank = {h: k for k, h in enumerate(table.tolist())}
    for a, b in ((0, len(texts)), (0, 0), (5, 6), (7, 300)):
        words = [[w.encode() for w in WORD.findall(folded(t))] for t in texts[a:b]]
        seen = []
        got, size = lm.tokens_of(whole.slice(a, b - a), lambda w: seen.extend(w.to_pylist()) or lm.token_hashes(w), lm.END)
        assert size.tolist() == [len(w) + 1 for w in words]
        assert got.tolist() == [h for ws in words for h in (*map(one, ws), lm.END)]
        assert sorted(seen) == sorted({w for ws in words for w in ws})
        assert lm.Lexicon(table).of(got).tolist() == [rank.get(h, -1 - h) for h in got.tolist()]
        assert lm.Lexicon(table[:0]).of(got).tolist() == [-1 - h for h in got.tolist()]


# --- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from gridweave.llm.common import stored
    from gridweave.llm.quality import RULES, Features, verdict
    from tests.llm.test_text_operators import brute_secrets, check_packed

    docs = table(spark, SF, "documents")
    seen = {0: docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen[k + 1] = stored(stage(spark, seen[k], SF), f"test-{name}")
    rows = {k: {r.doc_id: r for r in df.collect()} for k, df in seen.items() if k < 5}
    assert all(seen[k].columns == docs.columns for k in range(5))
    assert set(rows[1]) == {i for i, r in rows[0].items() if verdict(Features((r.text or "").encode()), RULES) is None}
    comp, _ = brute_components([(i, r.text) for i, r in rows[1].items()], 80, 5)
    assert set(rows[2]) == set(comp.values())
    assert all(rows[3][i].text in rows[2][i].text or len(rows[3][i].text) < len(rows[2][i].text) for i in rows[3])
    for i, r in rows[3].items():
        if not brute_secrets(r.text):
            assert rows[4][i] == r
        assert not brute_secrets(rows[4][i].text.replace("[secret]", " "))
        assert rows[4][i].n_chars == len(rows[4][i].text)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(r.text, add_special_tokens=False).ids, 2] for i, r in rows[4].items()}
    last = seen[5].collect()
    check_packed(last, ids)
    assert {r.doc_id for r in last} == set(ids)
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, last))


def test_near_duplicates_stage(spark, docs_of, prose):
    import corpus_pipeline

    rows = near_copies(prose)
    words = prose(60, 100).split()
    changed = [*words[:50], "other", *words[51:]]
    far = [*words[:20], "other", *words[21:50], "others", *words[51:80], "more", *words[81:]]
    rows += [(2001, " ".join(words)), (2002, " ".join(changed)), (2003, " ".join(far))]
    want = set(brute_components(rows, 80, 5)[0].values())
    assert want != set(brute_components(rows)[0].values())
    got = corpus_pipeline.near_duplicates(spark, docs_of(rows, clash=False), SF)
    assert {r.doc_id for r in got.collect()} == want
    copies = [(1, rows[0][1]), (1, rows[0][1]), (None, rows[0][1]), (None, rows[0][1]), (2, rows[0][1])]
    copies += [(None, " ".join(words)), (None, " ".join(words)), (5, None), (6, ""), (None, None)]
    got = corpus_pipeline.near_duplicates(spark, docs_of(copies, clash=False), SF).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted([copies[0], (None, " ".join(words)), *copies[-3:]], key=key)
    docs = table(spark, SF, "documents")
    comp, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()], 80, 5)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == set(comp.values())
