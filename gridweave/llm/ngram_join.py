"""Exact Jaccard self-join of documents over word shingles, with signature trees.

1. Every whole text becomes a set of 64-bit shingle hashes. Of equal sets only one representative, the
   smallest document, goes on (their links are certain).
2. A representative is indexed under the first tokens of its set: in any fixed order of all tokens, two sets
   whose Jaccard similarity reaches t share one of the first ``n - ceil(t n) + 1`` tokens of both, so no
   link is lost. The order is by hash, but with tokens last that many documents would be indexed under (a bounded
   table): passages that many documents share then bring no documents together.
3. Documents that share a hash form a block. Blocks are searched with signature trees: leaves
   hold token bitmaps and sizes, inner nodes their OR and size range; a dual traversal from the root pair
   drops node pairs whose largest possible overlap is too small. What is left is a spanning forest of pairs that may be similar.
   Its components are searched once more, each document once, with bitmaps as wide as large sets need.
4. The components that remain get the documents' full sets and are verified exactly.
5. Verified links give the final components.

No task holds a whole hot group, and no group is searched pair by pair. A large one is cut into tiles; first each tile is searched with the
next. In a group of near copies that makes one component of all. Only members outside the group's largest component, whose links could
still be in other tiles, are then searched against all tiles. Pairs within one component need no search, as they add nothing to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import (
    Forest,
    Tables,
    WordHashes,
    connected_components,
    joined_on,
    lean,
    most_frequent,
    shingle_hashes,
    small_batches,
    text_bytes,
)

BITS = 2048
#: Documents of a block's bitmaps that a task holds at once, and shingles of a component's sets.
TILE = 1024
SET_TOKENS = 1_000_000
#: A token is common from so many indexed documents on; most common tokens that the order puts last.
COMMON_FROM, COMMON_TOKENS = 3, 500_000
#: Index rows for each partition that blocks are made in, beyond the session's number of partitions.
PART_ROWS = 4_000_000


def words_of(raw: bytes) -> list[bytes]:
    """Words of the contract; ``lower`` on bytes folds A-Z only."""
    return raw.lower().split()


def shingle_set(raw: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(shingle_hashes(hashes.of(words_of(raw)), width))


def needed(n, percent: int):
    """Fewest shared elements that a set of n must have with any partner."""
    return -(-percent * n // 100)


def wide(n: int) -> int:
    """Bits of the bitmap of a set of n shingles that does not crowd: a power of two from 2 n on, ``BITS`` at least."""
    return max(BITS, 1 << (2 * n - 1).bit_length()) if n else BITS


def folded(raw: bytes, words: int) -> np.ndarray:
    """A bitmap's parts OR-combined into ``words`` 64-bit words, as if it had been made that small."""
    return np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)


def bitmap(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Token bitmap as unsigned 64-bit words; ``bits`` is a power of two."""
    out = np.zeros(bits, np.uint8)
    out[(tokens >> np.uint64(20)).astype(np.int64) % bits] = 1
    return np.packbits(out).view(np.uint64)


class SignatureTree:
    """Levels of OR-combined bitmaps and size ranges over documents in size order.

    ``levels[0]`` are the documents themselves; a node of level k+1 covers ``FAN`` nodes of level k.
    """

    FAN = 8

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        # spare: members beyond one for each set bit, at most, of a document below the node
        spare = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(sizes, sizes, spare, maps)]
        while len(self.levels[-1][0]) > 1:
            low, high, spare, maps = self.levels[-1]
            at = np.arange(0, len(low), self.FAN)
            self.levels.append(
                (
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(spare, at),
                    np.bitwise_or.reduceat(maps, at, axis=0),
                )
            )

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``node``, child) for all children one level down."""
        n = len(self.levels[level - 1][0])
        child = node[:, None] * self.FAN + np.arange(self.FAN)
        which = np.broadcast_to(np.arange(len(node))[:, None], child.shape)
        ok = child < n
        return which[ok], child[ok]


def may_link(nodes: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the node pairs (i, j) of one level can hold a linked pair.

    A linked pair of sizes x and y shares at least percent/(100+percent) (x+y). What two documents
    share lies on bits that both nodes have: at most one member for each such bit and the spare
    members that fall on a bit already taken. Documents are the nodes of the lowest level.
    """
    low, high, spare, maps = nodes
    ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
    at = np.nonzero(ok)[0]
    for k in range(0, len(at), 1 << 14):  # bounded temporary bitmaps
        part = at[k : k + (1 << 14)]
        a, b = i[part], j[part]
        common = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high[a], high[b]), common + np.minimum(spare[a], spare[b]))
        ok[part] = (100 + percent) * most >= percent * (low[a] + low[b])
    return ok


def tree_links(sizes: np.ndarray, maps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that ``may_link``. Documents must be in size order.

    The dual traversal descends both sides of a node pair; pairs whose documents are all in one
    tree of the forest already are dropped.
    """
    n = len(sizes)
    forest, out = Forest(n), []
    tree = SignatureTree(sizes, maps)
    level = len(tree.levels) - 1
    i = j = np.zeros(1, np.int64)
    stack = [(level, i, j)]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            keep = i < j
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            roots = np.fromiter((forest.root(x) for x in range(n)), np.int64, n)
            keep = roots[i] != roots[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            ok = may_link(tree.levels[0], i, j, percent)
            for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                if forest.join(a, b):
                    out.append((a, b))
            continue
        ok = may_link(tree.levels[level], i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        which, ci = tree.children(level, i)
        back, cj = tree.children(level, j[which])
        ci = ci[back]
        keep = ci <= cj
        ci, cj = ci[keep], cj[keep]
        step = 1 << 15
        stack.extend((level - 1, ci[k : k + step], cj[k : k + step]) for k in reversed(range(0, len(ci), step)))
    return out


def set_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the exactly verified links among ``sets`` (sorted arrays, size order).

    A breadth-first search: every found document is compared with those not reached yet, so near
    copies cost one comparison each and every link that joins two parts is found.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if n < 2 or not sizes.sum():
        return []
    tokens, inv = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(inv, minlength=len(tokens))
    del tokens
    inv = inv.astype(np.int32)
    shared_by = held[inv] > 1  # the others are in no intersection
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[shared_by]
    inv = inv[shared_by]
    holders, starts = owner[np.argsort(inv, kind="stable")], np.r_[0, np.cumsum(np.where(held > 1, held, 0))]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    unseen, out = np.ones(n, bool), []
    for first in range(n):
        if not unseen[first]:
            continue
        unseen[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            low, high = needed(sizes[x], percent), 100 * sizes[x] // percent
            if not (unseen & (sizes >= low) & (sizes <= high)).any():
                continue
            mine = inv[bounds[x] : bounds[x + 1]]
            long = starts[mine + 1] - starts[mine]
            at = np.repeat(starts[mine] - np.r_[0, np.cumsum(long)[:-1]], long) + np.arange(long.sum()) if len(mine) else mine
            shared = np.bincount(holders[at], minlength=n)
            hit = unseen & ((100 + percent) * shared >= percent * (sizes + sizes[x]))
            for y in np.nonzero(hit)[0].tolist():
                out.append((x, y))
                queue.append(y)
            unseen &= ~hit
    return out


def in_order(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set's tokens in index order: by hash, common ones (sorted array) last."""
    if not len(common):
        return tokens
    place = np.searchsorted(common, tokens)
    place[place == len(common)] = 0
    last = common[place] == tokens
    return np.concatenate((tokens[~last], tokens[last])) if last.any() else tokens


def _mapped(docs: DataFrame, width: int, schema: str, kinds: list, row) -> DataFrame:
    """doc_id, n and what ``row(set)`` gives of each text's shingle set."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *kinds])

    def run(batches):
        hashes = WordHashes()
        for b in small_batches(batches):
            sets = [shingle_set(raw, width, hashes) for raw in text_bytes(b.column("text"))]
            rows = [row(s) for s in sets]
            arrays = [b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            arrays += [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n long, {schema}")


def _key(s: np.ndarray) -> tuple[bytes, int]:
    """A set's key of 16 bytes, and half of it as a number."""
    key = xxhash.xxh3_128_digest(s.tobytes())
    return key, int.from_bytes(key[:8], "little", signed=True)


def _keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The set's key (16 bytes), half of it as ``half`` and a little more of its smallest hashes than the index takes."""

    def row(s):
        p = len(s) - needed(len(s), percent) + 1 if len(s) else 0
        return *_key(s), s[: p + p // 8 + 1].view(np.int64)

    kinds = [("key", pa.binary()), ("half", pa.int64()), ("early", pa.list_(pa.int64()))]
    return _mapped(docs, width, "key binary, half long, early array<long>", kinds, row)


def _index(docs: DataFrame, width: int, percent: int, common) -> DataFrame:
    """Half of the set's key, the tokens that it is indexed under, its bitmap and the wider one of a large set.

    ``common``: broadcast sorted array.
    """

    def row(s):
        n = len(s)
        p = n - needed(n, percent) + 1 if n else 0
        large = bitmap(s, wide(n)).tobytes() if wide(n) > BITS else None
        return _key(s)[1], in_order(s, common.value)[:p].view(np.int64), bitmap(s).tobytes(), large

    kinds = [("half", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("wide", pa.binary())]
    return _mapped(docs, width, "half long, prefix array<long>, bits binary, wide binary", kinds, row)


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    return _mapped(docs, width, "tokens binary", [("tokens", pa.binary())], lambda s: (s.tobytes(),))


def blocks_of(rows: DataFrame, percent: int, tile: int, parts: int) -> DataFrame:
    """(block, doc_id, big) of blocks that hold two or more documents of compatible size.

    ``rows`` has token, doc_id, n and, optionally, half: of equal sets, which share all their tokens, only the smallest
    doc_id goes on. Equal member lists become one block mostly; a block of more than two tiles becomes one block for each tile and the
    next, in size order, and ``big`` then names it, once for each member. Partitions are sorted and go by in pieces.
    """
    empty = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("big", pa.int64())])

    def made(token, doc, size, half, seen):
        if half:
            order = np.lexsort((doc, half[0], size, token))
            token, doc, size, half = token[order], doc[order], size[order], half[0][order]
            copy = (token[1:] == token[:-1]) & (size[1:] == size[:-1]) & (half[1:] == half[:-1])
            first = np.r_[True, ~copy]
            token, doc, size = token[first], doc[first], size[first]
        order = np.lexsort((doc, size, token))
        token, doc, size = token[order], doc[order], size[order]
        # a row stays only if a neighbour of its hash has a compatible size
        same = token[1:] == token[:-1]
        near = same & (100 * size[:-1] >= percent * size[1:])
        keep = np.r_[near, False] | np.r_[False, near]
        cut = np.r_[True, ~near][keep]  # a gap in sizes parts a block for good
        doc = doc[keep]
        starts = np.r_[np.nonzero(cut)[0], len(doc)]
        ids, docs, bigs = [], [], []
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            members = doc[a:z]
            key = xxhash.xxh3_64_intdigest(members.tobytes())
            if key in seen:
                continue
            seen.add(key)
            cuts = [members[k : k + tile] for k in range(0, z - a, tile)]
            if len(cuts) <= 2:
                pieces = [(key, members, np.zeros(len(members), bool))]
            else:
                pieces = [
                    (xxhash.xxh3_64_intdigest(f"{key}:{k}"), np.concatenate((x, y)), np.r_[np.full(len(x), k == 0), np.ones(len(y), bool)])
                    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                ]
            for k, m, own in pieces:
                ids.append(np.full(len(m), np.uint64(k)).view(np.int64))
                docs.append(m)
                bigs.append(pa.array(np.full(len(m), np.uint64(key)).view(np.int64), mask=~own))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(docs)), pa.concat_arrays(bigs)], schema=empty)

    def run(batches):
        held, count, seen = [], 0, set()
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy() for c in b.columns])
            count += b.num_rows
            if count >= 200_000 and held[-1][0][0] != held[-1][0][-1]:  # the last token may go on in the next batch
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(columns[0], columns[0][-1]))
                yield from made(*(c[:end] for c in columns[:3]), [c[:end] for c in columns[3:]], seen)
                held, count = [[c[end:] for c in columns]], len(columns[0]) - end
                if len(seen) > 500_000:
                    seen.clear()
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from made(*columns[:3], columns[3:], seen)

    return rows.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(run, "block long, doc_id long, big long")


def stray_blocks(members: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(block, doc_id) that bring the members of big groups outside their group's largest component together with all of the group.

    ``members`` has big, doc_id and weight; ``labels(node, component)`` the components so far. Tiles have a weight of about ``most``.
    """
    m = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    per = m.groupBy("big", "label").agg(F.sum("weight").alias("w"))
    top = per.groupBy("big").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("all"))
    top = top.select("big", F.col("top.label").alias("main"), F.ceil(F.col("all") / most).alias("tiles"), F.ceil((F.col("all") - F.col("top.w")) / most).alias("strays"))
    m = m.join(top.where("strays > 0"), "big")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    stray = m.where("label <> main").select("big", "doc_id", spot("strays").alias("a"), upto("tiles").alias("b"))
    every = m.select("big", "doc_id", spot("tiles").alias("b"), upto("strays").alias("a"))
    return stray.unionByName(every).select(F.xxhash64("big", "a", "b").alias("block"), "doc_id").distinct()


def searched(blocks: DataFrame, payload: DataFrame, column: str, links, most: int, weight, parts: int, label: str, t: Tables) -> DataFrame:
    """(a, b): a forest of the pairs that ``links`` finds in ``blocks(block, doc_id, big)``, a stored table, and in whole big groups.

    ``payload`` has doc_id, n and ``column``; ``weight`` is what a member weighs against ``most``.
    """

    def run(some: DataFrame, name: str) -> DataFrame:
        met = some.select("block", "doc_id").join(payload, "doc_id").repartition(parts, "block")
        return t.stored(linked_in_blocks(met, column, links).distinct(), name)

    first = run(blocks, label)
    big = blocks.where("big is not null").select("big", "doc_id")
    if big.isEmpty():
        return first
    labels = t.kept(connected_components(first))
    members = big.join(payload.select("doc_id", weight.alias("weight")), "doc_id")
    return first.union(run(t.stored(stray_blocks(members, labels, most), f"{label}-strays"), f"{label}-more"))


def linked_in_blocks(rows: DataFrame, payload: str, links) -> DataFrame:
    """Applies ``links(sizes, payloads)`` to every block; (a, b) document ids of its forest.

    Blocks come one after another in a sorted partition, so a task holds one block at a time.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(parts):
            t = pa.Table.from_batches(parts)
            doc, n = t.column("doc_id").to_numpy(), t.column("n").to_numpy()
            order = np.lexsort((doc, n))
            raw = t.column(payload).to_pylist()
            doc = doc[order]
            return [(int(doc[i]), int(doc[j])) for i, j in links(n[order], [raw[k] for k in order.tolist()])]

        done: list[tuple[int, int]] = []
        current = None
        for b in batches:
            block = b.column("block").to_numpy()
            edges = np.r_[0, np.nonzero(block[1:] != block[:-1])[0] + 1, len(block)]
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == z:
                    continue
                if held and block[a] != current:
                    done += solve(held)
                    held = []
                current = block[a]
                held.append(b.slice(a, z - a))
            if len(done) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": [x[0] for x in done], "b": [x[1] for x in done]})
                done = []
        if held:
            done += solve(held)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in done], pa.int64()), "b": pa.array([x[1] for x in done], pa.int64())})

    return rows.select("block", "doc_id", "n", payload).sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``.

    Links: 100 |A & B| >= percent |A | B|. Null, empty and blank texts have no shingles and link with
    nothing; repeated texts (and equal sets) link; rows that share an id are one document of all their texts' links; a row without
    doc_id has the component of the texts equal to its own, or null; very long texts are compared whole; other columns are ignored;
    an empty table gives an empty table.
    """
    lean(docs)
    spark, t = docs.sparkSession, Tables()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = t.stored(_keys(docs, width, percent), "sets")
    # common tokens: held by three texts or more that are not all copies of one
    early = base.select("half", F.explode("early").alias("token")).groupBy("token")
    often = early.agg(F.count("*").alias("df"), F.min("half").alias("a"), F.max("half").alias("z"))
    often = t.stored(often.where((F.col("df") >= COMMON_FROM) & (F.col("a") != F.col("z"))).select("token", "df"), "often")
    common = spark.sparkContext.broadcast(np.sort(most_frequent(often, "token", "df", COMMON_TOKENS)[0].view(np.uint64)))
    index = t.stored(_index(docs, width, percent, common).where("n > 0 and doc_id is not null"), "index")
    parts = max(parts, -(-(index.agg(F.sum(F.size("prefix"))).first()[0] or 0) // PART_ROWS))
    one = F.lit(1)
    blocks = t.stored(blocks_of(index.select(F.explode("prefix").alias("token"), "doc_id", "n", "half"), percent, tile, parts), "blocks")

    def by_bitmap(sizes, raws):
        return tree_links(sizes, np.frombuffer(b"".join(raws), np.uint64).reshape(len(raws), -1), percent)

    maybe = searched(blocks, index.select("doc_id", "n", "bits"), "bits", by_bitmap, tile, one, parts, "maybe", t)
    rough = t.kept(connected_components(maybe))
    # large sets crowd the blocks' bitmaps: what they brought together is searched again with bitmaps of their size
    wider = index.select("doc_id", "n", F.coalesce("wide", "bits").alias("wide"))

    def by_wide_bitmap(sizes, raws):
        words = min(map(len, raws)) // 8
        return tree_links(sizes, np.stack([folded(r, words) for r in raws]), percent)

    again = t.stored(_tiled(rough, index, SET_TOKENS), "rough-blocks")
    likely = searched(again, wider, "wide", by_wide_bitmap, SET_TOKENS, F.col("n"), parts, "likely", t)
    groups = t.kept(connected_components(likely))

    def by_set(sizes, raws):
        return set_links([np.frombuffer(r, np.uint64) for r in raws], percent)

    texts = docs.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    full = t.stored(_whole_sets(texts, width), "whole-sets")
    tiled = t.stored(_tiled(groups, index, SET_TOKENS), "group-blocks")
    links = searched(tiled, full, "tokens", by_set, SET_TOKENS, F.col("n"), parts, "links", t)
    comps = t.kept(connected_components(links))
    classes = base.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    keyed = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    keyed = t.stored(keyed.select("key", F.coalesce("component", "rep").alias("component"), "rows"), "classes")
    out = joined_on(base.select("doc_id", "n", "key"), keyed, "key", "rows", t).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return t.result(out, "ngram-join")


def _tiled(groups: DataFrame, base: DataFrame, most: int) -> DataFrame:
    """(block, doc_id, big): groups of up to two tiles whole, larger ones as each tile and the next, in a ring.

    A group with more than ``most`` shingles is dealt to tiles by hash. ``big`` names a group of more than two tiles, once for each member.
    """
    sized = groups.join(base.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n")), "node")
    tiles = sized.groupBy("component").agg(F.ceil(F.sum("n") / most).alias("k"))
    mine = F.pmod(F.xxhash64("node"), F.col("k"))
    pairs = F.when(F.col("k") <= 2, F.array(F.lit(0).cast("bigint"))).otherwise(F.array("mine", F.pmod(F.col("mine") + F.col("k") - 1, F.col("k"))))
    return (
        sized.join(tiles, "component")
        .withColumn("mine", mine)
        .withColumn("pair", F.explode(pairs))
        .select(
            F.xxhash64("component", "pair").alias("block"),
            F.col("node").alias("doc_id"),
            F.when((F.col("k") > 2) & (F.col("pair") == F.col("mine")), F.col("component")).alias("big"),
        )
    )
