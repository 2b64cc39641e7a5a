"""Paragraph-level substring deduplication with MinHash banding.

Two kinds of paragraphs are compared across documents:

* paragraphs of at least ``WINDOW`` words, by MinHash signatures of their five-word shingles: long lines, or short lines that follow each
  other up to a blank one. The bands are tuned so that a pair at the similarity threshold meets with at least ``RECALL`` probability;
  colliding ones are joined and verified by the exact Jaccard similarity of their shingles ('line' in names below);
* embedded paragraphs: every run of ``GUARANTEED`` words, wherever lines end. Its signature is the smallest hash of its
  ``WINDOW``-word shingles (a MinHash of one row, the same minimum for neighbouring runs). Paragraphs that collide are compared word by
  word where the minimum lies and grown in both directions as long as an earlier document has the same words.
  Where a text says the same words over and over, the windows that return make one stretch: a row, however often they return.

Linked paragraphs form components; the first occurrence (smallest document, then place) stays and
the other documents' occurrences are removals. Repeats within one document are left alone. Embedded paragraphs inside lines that are
removals already are not looked at again. Shorter paragraphs (headings, notices, list items) are never compared by themselves.
"""

from __future__ import annotations

import re
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, WordHashes, connected_components, ids_of, joined_on, lean, mixed, rewritten, shingle_hashes, small_batches, text_bytes
from gridweave.llm.ngram_join import PART_ROWS, blocks_of, searched, set_links
from gridweave.llm.spans import let, running

#: Words of a hashed window and fewest words of a compared paragraph.
WINDOW = 24
#: Words of an embedded paragraph. A shared one holds a window, so past its outermost windows a shared run goes on for less than ``REACH`` + 1 words.
GUARANTEED = 50
REACH = GUARANTEED - WINDOW
SHINGLE = 5
PERCENT = 80
RECALL = 0.99
MOST_BANDS = 10
TILE = 512


def tuned_bands(percent: int = PERCENT, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows to a band for which ``most`` bands or fewer reach the recall."""
    best = (most, 1)
    for rows in range(1, 20):
        p = (percent / 100) ** rows
        bands = max(1, ceil(log(1 - recall) / log(1 - p))) if p < 1 else 1
        if bands <= most:
            best = (bands, rows)
    return best


def line_words(raw: bytes, least: int = WINDOW) -> tuple[list[bytes], np.ndarray]:
    """All words of a text, and the word index at which each paragraph begins, with the end.

    A line of ``least`` words or more is a paragraph; shorter ones that follow each other without a blank line between, as in
    text with hard line breaks, make one together.
    """
    words: list[bytes] = []
    starts: list[int] = []
    joins = False  # whether a short line goes on with the paragraph before
    for line in raw.split(b"\n"):
        found = line.split()
        if not found:
            joins = False
            continue
        long = len(found) >= least
        if long or not joins:
            starts.append(len(words))
        joins = not long
        words += found
    return words, np.array([*starts, len(words)], np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    blocks = np.full((-(-len(x) // width), width), np.iinfo(x.dtype).max, x.dtype)
    blocks.reshape(-1)[: len(x)] = x
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


_BASE = 0x9E3779B97F4A7C15
_UNIT = pow(_BASE, -1, 1 << 64)


def embedded(h: np.ndarray, window: int = WINDOW, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the smallest window hash of every ``reach`` + 1 windows in a row."""
    n = len(h) - window + 1
    if n <= reach:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(h) - 1, _BASE, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(h * powers)]
    keys = mixed((sums[window:] - sums[:-window]) * np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _UNIT, np.uint64)]))
    low = np.pad(sliding_min(keys, reach + 1), reach)
    chosen = keys == ~sliding_min(~low, reach + 1)  # the largest of the minima that a window takes part in
    at = np.nonzero(chosen)[0]
    return at, keys[at]


def stretches(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word index, hash, step, windows): windows of one hash that overlap or touch, at equal steps, as one stretch."""
    if not len(at):
        return at, keys, at, at
    gap = np.diff(at)
    goes_on = (keys[1:] == keys[:-1]) & (gap <= WINDOW)
    goes_on[1:] &= ~goes_on[:-1] | (gap[1:] == gap[:-1])
    first = np.nonzero(np.r_[True, ~goes_on])[0]
    n = np.diff(np.r_[first, len(at)])
    step = np.where(n > 1, np.r_[gap, 1][first], 1)
    return at[first], keys[first], step, n


def line_key(shingles: np.ndarray) -> np.ndarray:
    """Key of one line's shingles, in order."""
    return mixed(mixed(shingles + np.arange(len(shingles), dtype=np.uint64)).sum(dtype=np.uint64)[None] + np.uint64(len(shingles)))


class Earlier:
    """Runs of words in order of their documents, as a tree that is unfolded only where runs part."""

    def __init__(self):
        self.root: dict = {}

    def longest(self, words: list[bytes], doc: int) -> tuple[int, int | None]:
        """Words at the start of ``words`` that a run of an earlier document shares and the first such document; keeps ``words``."""
        node, shared, keeper = self.root, 0, None
        for k, word in enumerate(words):
            arc = node.get(word)
            if arc is None:
                node[word] = [doc, b" ".join(words[k + 1 :])]
                break
            if arc[0] < doc:
                shared, keeper = k + 1, arc[0]
            if isinstance(arc[1], bytes):
                head, _, rest = arc[1].partition(b" ")
                arc[1] = {head: [arc[0], rest]} if head else {}
            node = arc[1]
        return shared, keeper


def minhash_bands(shingles: np.ndarray, cuts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (segments x bands) of segments of ``shingles`` that begin at ``cuts`` and touch."""
    out = np.empty((len(cuts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(cuts), b, np.uint64)
        for r in range(rows):
            odd = mixed(np.array([b * rows + r + 1], np.uint64)) | np.uint64(1)
            low = np.minimum.reduceat(mixed(shingles * odd), cuts)
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = key
    return out


def _paragraphs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, windows (stretches of them: first word, key, step, windows) and lines (first word, words, key, shingles, bands) of each text."""
    window = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.int64()), ("step", pa.int32()), ("n", pa.int32())]))
    line = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))]))
    kinds = pa.schema([("doc_id", pa.int64()), ("windows", window), ("lines", line)])

    def nested(kind, counts, *columns):
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))

    def run(batches):
        hashes = WordHashes()
        for b in small_batches(batches, 256):
            w_at, w_key, w_step, w_n, l_at, l_words, parts, w_count, l_count = ([] for _ in range(9))
            for raw in text_bytes(b.column("text")):
                words, starts = line_words(raw)
                h = hashes.of(words)
                at, keys, step, n = stretches(*embedded(h))
                w_at.append(at)
                w_key.append(keys)
                w_step.append(step)
                w_n.append(n)
                w_count.append(len(at))
                sizes = np.diff(starts)
                long = sizes >= WINDOW
                a, size = starts[:-1][long], sizes[long]
                l_count.append(len(a))
                if len(a):
                    s = shingle_hashes(h, SHINGLE)
                    parts += [s[x : x + n - SHINGLE + 1] for x, n in zip(a.tolist(), size.tolist(), strict=True)]
                    l_at.append(a)
                    l_words.append(size)
            l_key, l_n, l_bands = [], [], []
            if parts:  # all lines of the batch at once
                long = np.fromiter(map(len, parts), np.int64, len(parts))
                cuts = np.r_[0, np.cumsum(long)[:-1]]
                flat = np.concatenate(parts)
                order = mixed(flat + (np.arange(len(flat)) - np.repeat(cuts, long)).astype(np.uint64))
                l_key.append(mixed(np.add.reduceat(order, cuts) + long.astype(np.uint64)))
                l_n.append(np.fromiter((len(np.unique(p)) for p in parts), np.int64, len(parts)))
                l_bands.append(minhash_bands(flat, cuts, bands, rows))
            cat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
            as_long = lambda parts: pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
            all_bands = np.concatenate(l_bands) if l_bands else np.zeros((0, bands), np.uint64)
            band_lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(all_bands) + 1, dtype=np.int32) * bands), pa.array(np.ascontiguousarray(all_bands).reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    nested(window, w_count, pa.array(cat(w_at, np.int32)), as_long(w_key), pa.array(cat(w_step, np.int32)), pa.array(cat(w_n, np.int32))),
                    nested(line, l_count, pa.array(cat(l_at, np.int32)), pa.array(cat(l_words, np.int32)), as_long(l_key), pa.array(cat(l_n, np.int64)), band_lists),
                ],
                schema=kinds,
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, windows array<struct<at:int,key:bigint,step:int,n:int>>, "
        "lines array<struct<at:int,words:int,key:bigint,n:bigint,bands:array<bigint>>>",
    )


def _line_texts(docs: DataFrame, places: DataFrame, t: Tables) -> DataFrame:
    """(key, raw) of the lines at ``places(key, doc_id, at, words)``, one place and one row for each key."""
    per_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "words")).alias("want"))
    # only the texts that hold such lines are moved
    texts = docs.select("doc_id", "text").join(ids_of(places, "line-documents", t), "doc_id", "left_semi").join(per_doc, "doc_id")

    def run(batches):
        hashes = WordHashes()
        for b in small_batches(batches):
            keys, raws = [], []
            for raw, want in zip(text_bytes(b.column("text")), b.column("want").to_pylist(), strict=True):
                words = raw.split()
                for x in want:
                    line = words[x["at"] : x["at"] + x["words"]]
                    # another text under the same id does not have the line there
                    if len(line) == x["words"] and int(line_key(shingle_hashes(hashes.of(line), SHINGLE)).view(np.int64)[0]) == x["key"]:
                        keys.append(x["key"])
                        raws.append(b" ".join(line))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(raws, pa.binary())], names=["key", "raw"])

    return texts.select("text", "want").mapInArrow(run, "key long, raw binary").dropDuplicates(["key"])


def _short(word: bytes) -> bytes:
    """A word as it is compared: a very long one by its digest."""
    return word if len(word) <= 64 else b"\n" + xxhash.xxh3_128_digest(word).hex().encode()


def uncovered(base: DataFrame, by_line: DataFrame) -> DataFrame:
    """(doc_id, at, key, step, n) of the windows of ``base`` that do not lie in runs of words that ``by_line(doc_id, at, words)`` removes."""
    runs = by_line.groupBy("doc_id").agg(F.collect_list(F.struct("at", "words")).alias("runs"))
    kinds = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("key", pa.int64()), ("step", pa.int32()), ("n", pa.int32())])

    def run(batches):
        for b in batches:
            parts = []
            for doc, windows, gone in zip(b.column("doc_id").to_pylist(), b.column("windows"), b.column("runs"), strict=True):
                w = windows.values
                at, key, step, n = (w.field(x).to_numpy() for x in ("at", "key", "step", "n"))
                if gone.is_valid:
                    first, end = gone.values.field("at").to_numpy(), gone.values.field("words").to_numpy()
                    order = np.argsort(first, kind="stable")
                    first, end = first[order], np.maximum.accumulate((first + end)[order])
                    cut = np.nonzero(np.r_[True, first[1:] > end[:-1]])[0]  # runs that touch are one
                    first, end = first[cut], end[np.r_[cut[1:] - 1, len(end) - 1]]
                    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # of its stretch
                    at, key = np.repeat(at, n) + each * np.repeat(step, n), np.repeat(key, n)
                    k = np.searchsorted(first, at, side="right") - 1
                    keep = (k < 0) | (at + WINDOW > end[np.maximum(k, 0)])
                    at, key, step, n = stretches(at[keep], key[keep])
                parts.append((np.full(len(at), doc, np.int64), at, key, step, n))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    rows = base.where(F.size("windows") > 0).select("doc_id", "windows").join(runs, "doc_id", "left")
    return rows.select("doc_id", "windows", "runs").mapInArrow(run, "doc_id long, at int, key long, step int, n int")


def repeated(windows: DataFrame, parts: int) -> DataFrame:
    """The rows of ``windows(doc_id, at, key, ...)`` whose key several documents have: one shuffle, then one pass over sorted rows."""

    def run(batches):
        now, first, waiting, several = None, None, [], False  # of the last key so far
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            doc, key = columns[0], columns[2]
            if not len(key):
                continue
            edges = np.r_[0, np.nonzero(key[1:] != key[:-1])[0] + 1, len(key)]
            lone = np.zeros(len(key), bool)
            before = None  # what waits from batches before and turns out to be shared
            for a, z in ((edges[0], edges[1]), (edges[-2], edges[-1])) if len(edges) > 2 else ((0, len(key)),):
                if key[a] != now:
                    now, first, waiting, several = key[a], doc[a], [], False
                several = several or bool((doc[a:z] != first).any())
                if several:
                    before = (before or []) + waiting
                    waiting = []
                else:
                    waiting.append([c[a:z] for c in columns])
                    lone[a:z] = True
            inner = edges[1:-1]  # keys that lie in this batch as a whole
            if len(inner) > 1:
                low, high = (f.reduceat(doc[: inner[-1]], inner[:-1]) for f in (np.minimum, np.maximum))
                lone[inner[0] : inner[-1]] = np.repeat(low == high, np.diff(inner))
            out = [*(before or []), [c[~lone] for c in columns]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=b.schema)

    near = windows.select("doc_id", "at", "key", *windows.columns[3:])
    return near.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "at").mapInArrow(run, near.schema)


def surroundings(words: list[bytes], at: int, step: int, n: int) -> list[tuple[int, int]]:
    """(first word index, windows) of the parts of a stretch: windows with the same ``REACH`` words on both sides, those inside, are one."""
    low = -(-REACH // step)
    high = n - 1 - low
    end = at + (n - 1) * step + WINDOW
    if low < high and words[at : end - step] == words[at + step : end]:
        return [*((at + j * step, 1) for j in range(low)), (at + low * step, high - low + 1), *((at + j * step, 1) for j in range(high + 1, n))]
    return [(at + j * step, 1) for j in range(n)]


def covering(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The fewest of ``runs`` (first word, end, ...) that cover the words of all."""
    out, reach, best = [], -1, None
    for run in sorted(runs):
        if best and run[0] > reach:
            out.append(best)
            reach, best = best[1], None
        reach = max(reach, run[0])
        if run[1] > (best[1] if best else reach):
            best = run
    return [*out, best] if best else out


def grown_windows(docs: DataFrame, places: DataFrame, parts: int, t: Tables) -> DataFrame:
    """Removals (doc_id, at, words, kept_in, component) by ``places(doc_id, at, key, step, n)`` of windows that several documents share.

    Each window comes with ``REACH`` words on both sides; those of a stretch that have the same ones come once. In order of documents it
    is compared, word by word, with all earlier ones of its key, and grown on each side by what any of them shares. Of a document's
    removals by one key only as many are given as cover all their words.
    """
    per_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "step", "n")).alias("want"))
    texts = docs.select("doc_id", "text").join(ids_of(places, "window-documents", t), "doc_id", "left_semi").join(per_doc, "doc_id")
    kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("step", pa.int32()), ("n", pa.int32()), ("lead", pa.int32())]
    kinds = pa.schema([*kinds, ("raw", pa.binary())])

    def around(batches):
        for b in small_batches(batches, 16):
            rows = []
            for doc, raw, want in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), b.column("want").to_pylist(), strict=True):
                words = list(map(_short, raw.split()))
                for x in want:
                    for at, n in surroundings(words, x["at"], x["step"], x["n"]):
                        first = max(0, at - REACH)
                        rows.append((x["key"], doc, at, x["step"], n, at - first, b" ".join(words[first : at + WINDOW + REACH])))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    near = texts.select("doc_id", "text", "want").mapInArrow(around, "key long, doc_id long, at int, step int, n int, lead int, raw binary")
    found = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("kept_in", pa.int64()), ("component", pa.int64())])

    def grown(batches):
        now, same, runs = (None, None), {}, []  # runs: removals of the document that the key is at

        def ended():
            key, doc = now
            return [(doc, at, end - at, kept_in, key) for at, end, kept_in in (covering(runs) if len(runs) > 1 else runs)]

        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found, strict=True)], schema=found)

        for b in batches:
            rows = []
            for key, doc, at, step, n, lead, raw in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (key, doc) != now:
                    rows += ended()
                    runs = []
                    if key != now[0]:
                        same = {}
                    now = key, doc
                words = raw.split(b" ")
                window = b" ".join(words[lead : lead + WINDOW])
                if window not in same:
                    same[window] = (doc, Earlier(), Earlier(), {}, set())
                first, before, after, last, twice = same[window]  # twice: documents that have the window in several places
                if n > 1 or last.get(doc, (at, raw)) != (at, raw):
                    twice.add(doc)
                if doc not in last:
                    last.clear()
                    last[doc] = at, raw
                left, left_in = before.longest(words[:lead][::-1], doc)
                right, right_in = after.longest(words[lead + WINDOW :], doc)
                if first == doc:
                    continue
                # both sides make one run only if they are those of one place
                if not left or not right or (left_in == right_in and left_in not in twice):
                    grew = [(left, right, left_in if left else right_in if right else first)]
                else:
                    grew = [(left, 0, left_in), (0, right, right_in)]
                for left, right, kept_in in grew:
                    # of windows at equal steps, as many as leave no gap
                    places = {*range(0, n, max(1, (left + WINDOW + right) // step)), n - 1}
                    runs += [(at + k * step - left, at + k * step + WINDOW + right, kept_in) for k in places]
            yield batch(rows)
        yield batch(ended())

    near = near.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "at")
    return near.mapInArrow(grown, "doc_id long, at int, words int, kept_in long, component long").distinct()


def near_lines(docs: DataFrame, lines: DataFrame, percent: int, tile: int, parts: int, t: Tables) -> DataFrame:
    """(node, component) of line keys that are linked to another key: candidates by bands, verified exactly."""
    first = lines.groupBy("key").agg(F.min(F.struct("doc_id", "at", "words", "n", "bands")).alias("p"))
    first = t.stored(first.select("key", "p.*"), "line-keys")
    index = first.select(F.explode("bands").alias("token"), F.col("key").alias("doc_id"), "n")
    parts = max(parts, -(-first.count() * MOST_BANDS // PART_ROWS))
    blocks = t.stored(blocks_of(index, percent, tile, parts), "line-blocks")
    wanted = first.select("key", "doc_id", "at", "words", "n").join(blocks.select(F.col("doc_id").alias("key")), "key", "left_semi")
    wanted = t.stored(wanted, "line-places")
    payload = _line_texts(docs, wanted, t).join(wanted.select("key", "n"), "key").withColumnRenamed("key", "doc_id")
    payload = t.stored(payload.select("doc_id", "n", "raw"), "line-texts")

    def verified(sizes, raw_lines):
        hashes = WordHashes()
        sets = [np.unique(shingle_hashes(hashes.of(r.split()), SHINGLE)) for r in raw_lines]
        return set_links(sets, percent)

    links = searched(blocks, payload, "raw", verified, tile, F.lit(1), parts, "line-links", t)
    return t.kept(connected_components(links.distinct()))


def paragraph_duplicates(docs: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Removals: doc_id, at, words (a run of the text's words, from 0), kept_in, component, kind.

    ``kept_in`` is the document that keeps the paragraph; ``component`` names the set of linked
    paragraphs; kind is 'line' or 'embedded'. Null, empty and short texts have no removals, nor have rows without doc_id, which nothing
    can name; repeated texts under other ids are removals but for the first, which is also the one that stays of tied ones; repeated rows
    count once; of rows that share an id with different texts each is looked at, and a removal may speak of any of them; very long texts
    are cut at no length; other columns are ignored; an empty table gives an empty table.
    """
    lean(docs)
    bands, rows = tuned_bands(percent)
    t = Tables()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    base = t.stored(_paragraphs(docs, bands, rows), "paragraphs")
    lines = base.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.*")
    near = near_lines(docs, lines, percent, tile, parts, t)
    # one id for each set of linked lines; unlinked keys stand for themselves
    keys = lines.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    keys = keys.join(near.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sets = keys.groupBy("component").agg(F.min("first").alias("kept_in"), F.max("last").alias("last")).where("kept_in <> last").drop("last")
    keys = t.stored(keys.join(sets, "component").select("key", "n", "component", "kept_in"), "line-sets")
    by_line = joined_on(lines.select("doc_id", "at", "words", "key"), keys, "key", "n", t).where("doc_id <> kept_in")
    by_line = t.stored(by_line.select("doc_id", "at", "words", "kept_in", "component", F.lit("line").alias("kind")), "by-line")
    places = t.stored(repeated(uncovered(base, by_line), parts), "window-places")
    by_window = grown_windows(docs, places, parts, t).withColumn("kind", F.lit("embedded"))
    return t.result(by_line.union(by_window), "removals")


def _merged(spans: Column) -> Column:
    """Sorted (at, end) word runs with overlapping ones joined: a run begins where none before reaches."""

    def joined(sorted_spans: Column) -> Column:
        reach = running(F.transform(sorted_spans, lambda s: s["end"]), F.greatest)

        def begun(v: Column) -> Column:
            new = lambda i: (i == 0) | (F.element_at(v["spans"], i + 1)["at"] > F.element_at(v["reach"], F.greatest(i, F.lit(1))))
            last = lambda i: (i == F.size(v["spans"]) - 1) | new(F.least(i + 1, F.size(v["spans"]) - 1))
            starts = F.filter(F.transform(v["spans"], lambda s, i: F.when(new(i), s["at"])), lambda x: x.isNotNull())
            ends = F.filter(F.transform(v["reach"], lambda r, i: F.when(last(i), r)), lambda x: x.isNotNull())
            return F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("at"), z.alias("end")))

        return let(F.struct(sorted_spans.alias("spans"), reach.alias("reach")), begun)

    return let(F.array_sort(spans), joined)


def removal_runs(found: DataFrame) -> DataFrame:
    """doc_id, runs (word runs to remove, joined and in order), kept_in (documents that keep them): one row for
    each document that has removals in ``found``."""
    one = found.groupBy("doc_id").agg(
        F.collect_set(F.struct("at", (F.col("at") + F.col("words")).alias("end"))).alias("spans"),
        F.array_sort(F.collect_set("kept_in")).alias("kept_in"),
    )
    return one.select("doc_id", _merged(F.col("spans")).alias("runs"), "kept_in")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def without_runs(text: str, runs: list) -> str | None:
    """``text`` without the words of the sorted ``runs``; None if no word is left."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for s in runs:
        if s["end"] > len(places):
            break  # another text under the same id
        out.append(raw[at : places[s["at"]][0]])
        at = places[s["end"] - 1][1]
    left = b"".join([*out, raw[at:]])
    return left.decode() if left.split() else None


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with repeated paragraphs cut out of their texts; a text left without words goes.

    Other columns pass through but ``n_chars``, which follows the text. Texts without removals, null and
    empty ones and those without doc_id included, are unchanged. Repeated rows are cut alike; rows that share an id must share their
    text. An empty table gives an empty table.
    """
    mark, t = "_gridweave_runs", Tables()
    found = t.kept(paragraph_duplicates(docs, percent))
    runs = removal_runs(found).select("doc_id", F.col("runs").alias(mark))
    return rewritten(docs, runs, mark, without_runs, t)
