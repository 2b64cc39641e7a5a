"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector's difference from the mean is rotated by a fixed random orthogonal matrix; its code is the
sign bits, with two correction scalars: the difference's length and the inner product of
code and direction. A rotated query is written as bit planes of ``PLANES``-bit numbers; its inner products with codes are counts of common
bits, and with the scalars they estimate those with the vectors without bias, with an error bound. The most promising vectors are scored
exactly first; of the others only those are whose upper bound reaches the k-th best of these scores. Vectors and queries meet in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, lean

#: Vectors of a block: between these bounds, so that there are some ``BLOCKS`` of them.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 4096, 65536, 64
QUERY_BLOCK = 1024
#: Bits of a rotated query's components, and vectors scored first for each of the k wanted.
PLANES, FIRST = 6, 8
#: Width of the error bound in standard deviations of the estimate.
BOUND = 3.0


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    """A random orthogonal matrix, the same for equal arguments."""
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, length of the difference from the center, inner product of code and direction)."""
    diff = (vectors - center) @ turn
    length = np.linalg.norm(diff, axis=1)
    unit = diff / np.where(length > 0, length, 1.0)[:, None]
    signs = np.where(unit >= 0, 1.0, -1.0) / np.sqrt(vectors.shape[1])
    fit = np.where(length > 0, (signs * unit).sum(axis=1), 1.0)
    return np.packbits(unit >= 0, axis=1), length, fit


def words_of(bits: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, the last one filled up with zeros."""
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def bit_planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries as numbers of ``PLANES`` bits: words (planes, queries, words), the lowest value and the step of each query."""
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-30) / (2**PLANES - 1)
    number = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    return np.stack([words_of(np.packbits((number >> j) & 1, axis=1)) for j in range(PLANES)]), low, step


def estimate(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, center: np.ndarray, turn: np.ndarray):
    """Estimated inner products (queries x vectors) and their error bounds, from the packed bits."""
    dim = queries.shape[1]
    turned = queries @ turn
    codes = words_of(bits)
    planes, low, step = bit_planes(turned)
    common = np.zeros((len(queries), len(codes)), np.float32)
    for j in range(PLANES):
        for w in range(codes.shape[1]):
            common += np.bitwise_count(planes[j, :, w, None] & codes[None, :, w]) * np.float32(1 << j)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # sign bits are 0 and 1: code = (2 bit - 1) / sqrt(dim)
    dots = step[:, None] * common + low[:, None] * ones[None, :]
    dots = (2 * dots - turned.sum(axis=1)[:, None]) / np.sqrt(dim)
    scale = length / fit
    guess = (queries @ center)[:, None] + dots * scale[None, :]
    spread = np.sqrt(np.maximum(1 - fit**2, 0)) / np.sqrt(max(dim - 1, 1))
    coarse = step * np.sqrt(4 * ones.max(initial=0) / 12 / dim)  # of rounding the query's components
    deviation = np.sqrt((np.linalg.norm(queries, axis=1)[:, None] * spread[None, :]) ** 2 + coarse[:, None] ** 2)
    return guess, BOUND * deviation * scale[None, :]


def search_block(queries, query_uid, vectors, uids, ids, codes, center, turn, k: int):
    """For each query (index, vector index, exact score) of its k best of the block, its own row excepted."""
    bits, length, fit = codes
    out = []
    lot = max(1, (1 << 20) // max(1, len(vectors)))
    for a in range(0, len(queries), lot):
        part = queries[a : a + lot]
        guess, bound = estimate(part, bits, length, fit, center, turn)
        own = query_uid[a : a + lot][:, None] == uids[None, :]
        guess[own] = -np.inf
        promising = min(len(vectors), FIRST * k)
        early = np.argpartition(guess, len(vectors) - promising, axis=1)[:, len(vectors) - promising :]
        for i in range(len(part)):
            first = early[i][~own[i, early[i]]]
            score = vectors[first] @ part[i]
            floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
            may = guess[i] + bound[i] >= floor
            may[first] = False
            pick = np.nonzero(may & ~own[i])[0]
            score = np.concatenate((score, vectors[pick] @ part[i]))
            pick = np.concatenate((first, pick))
            best = np.lexsort((uids[pick], ids[pick], -score))[:k]
            out.append((np.full(len(best), a + i), pick[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """uid, id and v (array<double>) of rows with a vector that takes part."""
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return (
        vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v"))
        .withColumn("uid", F.monotonically_increasing_id())
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    )


def nearest(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20,
    vector_block: int | None = None, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    All other rows are candidates. Nearness is the largest inner product in double precision; ties go to the smaller
    vec_id. Null ids and null, empty, zero and not finite vectors take no part, nor do vectors of another length than the most
    frequent one (the smaller of equally frequent ones). A repeated row is a candidate for its copy. Other columns are ignored; no rows give no rows.
    """
    lean(vectors)
    spark, t = vectors.sparkSession, Tables()
    rows = t.stored(usable(vectors, id_column, vector_column), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        t.drop()
        return empty
    dim, total = sizes[0].d, sizes[0].n
    rows = rows.where(F.size("v") == dim)
    sums = rows.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
    center, turn = np.array([r.m for r in sums]), rotation(dim)
    vector_block = vector_block or min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS))
    blocks, lots = -(-total // vector_block), -(-total // (every * query_block))

    def packed(kind: str, size: int):
        """One row for each block: its vectors, ids and codes as bytes."""

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("uid", "ascending")])
            v = np.ascontiguousarray(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            bits, length, fit = encode(v, center, turn) if kind == "vectors" else (np.zeros(0, np.uint8),) * 3
            blob = [x.tobytes() for x in (v, table.column("uid").to_numpy(), table.column("id").to_numpy(), bits, length, fit)]
            names = ["v", "uid", "id", "bits", "length", "fit"]
            return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), **{n: pa.array([x], pa.binary()) for n, x in zip(names, blob, strict=True)}})

        return run

    schema = "block long, v binary, uid binary, id binary, bits binary, length binary, fit binary"
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("bigint").alias("block")
    index = t.stored(rows.select(spread(blocks), "uid", "id", "v").groupBy("block").applyInArrow(packed("vectors", vector_block), schema), "codes")
    asked = rows.where(F.col("id") % every == 0).select(spread(max(1, lots)), "uid", "id", "v")
    asked = asked.groupBy("block").applyInArrow(packed("queries", query_block), schema)
    asked = asked.select(
        F.col("v").alias("qv"), F.col("uid").alias("quid"), F.col("id").alias("qid"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
    )
    out = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = {n: b.column(n)[i].as_buffer() for n in b.schema.names if n != "block"}
                of = lambda n, t: np.frombuffer(raw[n], t)  # noqa: B023, E731
                q, v = of("qv", np.float64).reshape(-1, dim), of("v", np.float64).reshape(-1, dim)
                quid, qid, uid, ids = of("quid", np.int64), of("qid", np.int64), of("uid", np.int64), of("id", np.int64)
                codes = of("bits", np.uint8).reshape(len(v), -1), of("length", np.float64), of("fit", np.float64)
                which, at, score = search_block(q, quid, v, uid, ids, codes, center, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (quid[which], qid[which], ids[at], uid[at], score)], schema=out)

    # one row a block on either side; the queries' rows are dealt to every block of vectors
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    met = index.repartition(parts, "block").join(asked.repartition(parts, "block"), "block")
    found = met.drop("block").mapInArrow(run, "query long, query_id long, vec_id long, uid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return t.result(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
