"""Helpers shared by the corpus operators: tables, scratch tables, hashing, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of an Arrow batch while a table is stored: whole texts are long, and both sides hold a batch or two. (Spark bounds its bytes in any case.)
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` or the context's checkpoint folder; where neither is set: a temporary folder
    in local mode, an error on a cluster, whose machines share no other folder that is sure to exist."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        found = context._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.get(context.applicationId)
        if root is None:
            root = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridweave-")
            _file_system(spark, root).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(root))
    return root.rstrip("/")


#: Scratch folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a table of the shared folder and reads it back: a cut of lineage that
    survives the loss of any executor. What nobody dropped by then goes when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gridweave/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._gridweave_path = path
    return out


def lean(df: DataFrame) -> DataFrame:
    """Lets the Python workers of operators on ``df`` import this package."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *paths])
    return df


def dropped(df: DataFrame) -> None:
    """Deletes a table made by ``stored`` once nothing reads it any more."""
    path = getattr(df, "_gridweave_path", None)
    if path:
        files, at = _file_system(df.sparkSession, path), df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


class Tables:
    """The scratch tables of one operator: dropped together once its result is written."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def kept(self, table: DataFrame) -> DataFrame:
        self.made.append(table)
        return table

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        return self.kept(stored(df, label))

    def drop(self, *tables: DataFrame) -> None:
        for t in tables or self.made:
            dropped(t)
        self.made = [t for t in self.made if tables and all(t is not x for x in tables)]

    def result(self, df: DataFrame, label: str) -> DataFrame:
        out = stored(df, label)
        self.drop()
        return out


def ids_of(df: DataFrame, label: str, t: Tables) -> DataFrame:
    """The doc_ids of ``df``, once each, as a table: small files whose size the planner knows when it chooses a join."""
    return t.stored(df.select("doc_id").where("doc_id is not null").distinct().sortWithinPartitions("doc_id"), label)


#: A key is hot from this share of all rows on, so there are at most so many hot keys the other way round.
HOT_SHARE = 1000


def joined_on(rows: DataFrame, values: DataFrame, key: str, count: str, t: Tables) -> DataFrame:
    """``rows`` left-joined on ``key`` to ``values``, which has one row a key and in ``count`` the key's rows.

    Keys with more than one in ``HOT_SHARE`` of all rows, at most that many by counting, are broadcast with their values, so that
    their rows stay where they are; the others are shuffled as usual.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = t.stored(values.where(F.col(count) > max(1, total // HOT_SHARE)).drop(count), "hot-keys").coalesce(1)
    rest = values.where(F.col(count) <= max(1, total // HOT_SHARE)).drop(count)
    found = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return found.unionByName(cold.select(*found.columns))


def rewritten(docs: DataFrame, extra: DataFrame, column: str, new_text, t: Tables) -> DataFrame:
    """``docs`` with the texts that ``extra(doc_id, column)`` speaks of replaced by ``new_text(text, value)``; rows for which
    that is None go. ``n_chars``, if there, follows the text.

    Only those rows are joined and sent to Python: the others, found by their ids alone, keep their texts where they are as
    long as the ids are few enough to broadcast; beyond that the planner shuffles.
    """
    names = docs.columns
    extra = t.stored(extra.select("doc_id", column), "extra")
    ids = ids_of(extra, "extra-ids", t)
    found = docs.join(ids, "doc_id", "left_semi").join(extra, "doc_id").select(*names, column)
    rest = docs.join(ids, "doc_id", "left_anti").select(*names)

    def run(batches):
        for b in small_batches(batches):
            texts = b.column("text").to_pylist()
            new = [None if x is None else new_text(x, v) for x, v in zip(texts, b.column(column).to_pylist(), strict=True)]
            keep = pa.array([x is None or y is not None for x, y in zip(texts, new, strict=True)], pa.bool_())
            columns = {n: b.column(n) for n in names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in names:
                old = b.column("n_chars")
                columns["n_chars"] = pa.array([o if y is None else len(y) for y, o in zip(new, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_pydict(columns).filter(keep)

    return found.mapInArrow(run, docs.schema).union(rest)


def most_frequent(counts: DataFrame, token: str, count: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """About the ``most`` most frequent tokens of ``counts`` and their counts, by falling count, then token.

    A histogram of the counts, of a few thousand rows at most, tells from which count on tokens are taken; of those at the
    limit a share is taken by hash. So only what is taken goes to the driver, and nothing is sorted in one task.
    """
    c = F.col(count)
    level = F.when(c < 4096, c).otherwise((4096 + F.floor(F.log2(c) * 16)).cast("bigint"))
    rows = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level)
    taken, last, share = 0, None, 0.0
    for r in rows:
        last, share = r.level, min(1.0, (most - taken) / r.n)
        if share < 1:
            break
        taken += r.n
    if last is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    picked = F.pmod(F.xxhash64(token), F.lit(1_000_000)) < int(share * 1_000_000)
    top = counts.where((level > last) | ((level == last) & picked)).select(token, count).toArrow()
    tokens, n = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.lexsort((tokens, -n))
    return tokens[order], n[order]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; the cache is bounded, its values do not depend on it."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:  # common words come early
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; the whole sequence as one if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(width, n)
    out = hashes[: n - w + 1].copy()
    for k in range(1, w):
        out = out * _M1 + hashes[k : n - w + 1 + k]
    return mixed(out + np.uint64(w))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches, rows: int = 512):
    """Slices Arrow batches so that a task holds few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class Forest:
    """Union-find over 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest reachable id.

    Alternates large-star and small-star steps, each a grouped minimum and a join, over tables in
    the shared folder, until a round changes nothing; more than ``rounds``, if given, are an error. Isolated nodes (a = b only)
    are dropped. The result is such a table.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = state(now)
    done = 0
    while seen[0]:
        if done == rounds:
            raise RuntimeError(f"components not settled after {rounds} rounds")
        done += 1
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").toDF("a", "b").union(low.toDF("a", "b"))
        new = stored(small.distinct(), "small")
        after = state(new)
        dropped(now)
        dropped(large)
        now = new
        if after == seen:
            break
        seen = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
    out = stored(nodes.distinct(), "components")
    dropped(now)
    return out
