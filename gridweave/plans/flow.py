"""The batch dataflow: index, epochs, shuffle, batches, layout, padding, collation.

Numbering never brings a whole epoch into one task: rows are ranked inside buckets (quantiles of the key, or prefixes of
the shuffle's hash), and the buckets' row counts, a small table, give each bucket its first number. Only ids and dimensions are numbered and
laid out; the tensors are joined to their places once.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from gridweave.plans.permute import Permutation

#: Rows that a bucket of a key should have, most buckets, and hexadecimal digits of the shuffle's hash that name a bucket.
BUCKET_ROWS, MOST_BUCKETS, HASH_DIGITS = 50_000, 1 << 13, 4


@dataclass(frozen=True)
class StreamOptions:
    """Options of a batch stream. ``max_steps`` counts the batches of all epochs together; without a ``seed`` a
    shuffled stream draws one when its plan is built. ``epochs`` None never ends: for iteration only."""

    batch_size: int
    epochs: int | None = 1
    shuffle: bool = False
    seed: int | None = None
    max_steps: int | None = None
    arithmetic: bool = False

    def __post_init__(self):
        if self.batch_size < 0 or (self.epochs is not None and self.epochs < 0) or (self.max_steps is not None and self.max_steps < 0):
            raise ValueError("options can't be negative")


def numbered(df: DataFrame, name: str, within: Sequence[str], bucket: Column, order: Sequence[Column]) -> DataFrame:
    """Adds ``name``: the row's number from 0 on, in each group of ``within``, in order of (bucket, *order).

    ``order`` must be a total order inside a bucket. The counts that are broadcast have one row for each
    group and bucket.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order))
    out = keyed.withColumn("_place", place).join(first, [*within, "_bucket"])
    return out.withColumn(name, (F.col("_first") + F.col("_place") - 1).cast("bigint")).drop("_bucket", "_place", "_first")


def quantile_bucket(key: Column, cuts: Sequence[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``, by halving."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*(F.lit(c).cast("bigint") for c in cuts))

    def halve(low: Column, k: Column) -> Column:
        at = low + F.pow(F.lit(2), k).cast("int")
        return F.when((at <= len(cuts)) & (F.try_element_at(bounds, at) <= key), at).otherwise(low)

    steps = F.sequence(F.lit(len(cuts).bit_length() - 1), F.lit(0))
    # never null, and said so: else the join of the counts tests each row of the source for it, by computing the bucket there
    return F.coalesce(F.aggregate(steps, F.lit(0), halve), F.lit(0))


def with_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Adds a dense index 0..n-1 in order of a unique integer key. Buckets are quantiles, so no outlier fills one."""
    keys = df.select(F.col(key))
    rows, cuts = keys.agg(F.count("*"), F.percentile_approx(key, [k / 64 for k in range(1, 64)], 1_000)).first()
    buckets = min(MOST_BUCKETS, -(-rows // BUCKET_ROWS))
    if buckets > 64:  # finer quantiles where 64 buckets would be too full
        cuts = keys.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 4 * buckets)).first()[0]
    bucket = quantile_bucket(F.col(key).cast("bigint"), sorted(set(cuts or ())))
    if not any(isinstance(f.dataType, (ArrayType, BinaryType, MapType, StringType, StructType)) for f in df.schema):
        return numbered(df, name, [], bucket, [F.col(key)])  # narrow rows are ranked as they are
    return df.join(numbered(keys, name, [], bucket, [F.col(key)]), key).select(*df.columns, name)


def with_epochs(df: DataFrame, epochs: int, first: int = 1) -> DataFrame:
    """Each row once for each of ``epochs`` epochs from ``first`` on."""
    if epochs < 1:
        return df.withColumn("epoch", F.lit(1)).where("false")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(first + epochs - 1))))


def shuffle_key(seed: int, epoch: Column, idx: Column) -> Column:
    """A hash that orders an epoch; every epoch has its own seed. The sum wraps at 64 bits."""
    total = (F.lit(seed).cast("decimal(20,0)") + epoch.cast("decimal(20,0)"))
    wrapped = F.pmod(total + F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")) - F.lit(
        "9223372036854775808"
    ).cast("decimal(20,0)")
    return F.md5(F.concat_ws(":", wrapped.cast("bigint").cast("string"), idx.cast("string")))


def with_positions(df: DataFrame, shuffle: bool, seed: int | None = None, name: str = "pos") -> DataFrame:
    """Adds the position of each row in its epoch: the index itself, or its place in the epoch's seeded shuffle.

    The same seed gives the same order; other epochs and seeds give others.
    """
    if not shuffle:
        return df.withColumn(name, F.col("idx").cast("bigint"))
    keyed = df.withColumn("_key", shuffle_key(drawn_seed(seed), F.col("epoch"), F.col("idx")))
    bucket = F.substr("_key", F.lit(1), F.lit(HASH_DIGITS))
    return numbered(keyed, name, ["epoch"], bucket, [F.col("_key"), F.col("idx")]).drop("_key")


def with_batches(df: DataFrame, batch_size: int) -> DataFrame:
    """Adds step (from 0 in each epoch) and pos_in_batch; the last batch may be short."""
    pos = F.col("pos")
    return df.withColumn("step", F.floor(pos / batch_size).cast("bigint")).withColumn("pos_in_batch", F.pmod(pos, F.lit(batch_size)).cast("bigint"))


def steps_per_epoch(count: Column, batch_size: int) -> Column:
    return F.ceil(count / batch_size).cast("bigint")


def drawn_seed(seed: int | None) -> int:
    return random.SystemRandom().getrandbits(62) if seed is None else seed


def total_steps(n: int, options: StreamOptions) -> int:
    """Steps of all epochs together, with the limit on them."""
    if options.batch_size == 0 or options.epochs is None:
        return 0
    steps = -(-n // options.batch_size) * options.epochs
    return steps if options.max_steps is None else min(steps, options.max_steps)


def placed(ids: DataFrame, options: StreamOptions, n: int | None = None, first: int = 1) -> DataFrame:
    """epoch, step, global_step, pos, pos_in_batch for every row of ``ids`` (idx 0..n-1 and what else should come along).

    ``n``, if known, spares a count; epochs are numbered from ``first`` on, global steps from 0.
    """
    if options.epochs is None:
        raise ValueError("an endless stream has no plan: iterate over it")
    every = with_epochs(ids, options.epochs, first)
    if options.batch_size == 0:
        return with_batches(with_positions(every, False), 1).where("false").withColumn("global_step", F.lit(0).cast("bigint"))
    several = options.max_steps is not None or options.epochs > 1
    if n is None and (several or (options.shuffle and options.arithmetic)):
        n = ids.count()
    if options.shuffle and options.arithmetic:
        out = Permutation(n, drawn_seed(options.seed)).with_positions(every, range(first, first + options.epochs))
    else:
        out = with_positions(every, options.shuffle, options.seed)
    out = with_batches(out, options.batch_size)
    if not several:
        return out.withColumn("global_step", F.col("step"))
    steps = -(-n // options.batch_size)
    out = out.withColumn("global_step", (F.col("epoch") - first) * F.lit(steps).cast("bigint") + F.col("step"))
    return out if options.max_steps is None else out.where(F.col("global_step") < options.max_steps)


def batches(items: DataFrame, options: StreamOptions, dims: Sequence[str] = ()) -> DataFrame:
    """epoch, step, global_step, pos, pos_in_batch and, for the columns ``dims``, ``max_<dim>`` of its batch for every item of the
    stream (``items`` has idx 0..n-1).

    An empty dataset or batch size 0 gives an empty stream. ``max_steps`` emits that many steps in all.
    """
    ids = items.select("idx", *dims)
    out = placed(ids, options)
    if dims:
        out = with_layout(out, dims)
    rest = [c for c in items.columns if c not in ids.columns]
    return out.join(items.select("idx", *rest), "idx") if rest else out


def batch_layout(df: DataFrame, dims: Sequence[str], by: Sequence[str] = ("epoch", "step")) -> DataFrame:
    """One row a batch: n items and, for each dimension, the batch's largest (``max_<dim>``)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.max(d).alias(f"max_{d}") for d in dims))


def with_layout(df: DataFrame, dims: Sequence[str], by: Sequence[str] = ("epoch", "step")) -> DataFrame:
    """Adds ``max_<dim>`` of its batch to each item; array columns (shapes) are compared place by place.

    A batch's largest shape is found by grouped maxima, a row a batch and dimension, and joined to its items.
    """
    w = Window.partitionBy(*by)
    arrays = [d for d in dims if df.schema[d].dataType.typeName() == "array"]
    out = df.withColumns({f"max_{d}": F.max(d).over(w) for d in dims if d not in arrays})
    for d in arrays:
        sizes = df.select(*by, F.posexplode(d).alias("_place", "_size")).groupBy(*by, "_place").agg(F.max("_size").alias("_size"))
        shapes = sizes.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_size"))), lambda r: r["_size"]).alias("_largest"))
        none = F.array().cast(df.schema[d].dataType)
        out = out.join(shapes, list(by), "left").withColumn(f"max_{d}", F.coalesce("_largest", none)).drop("_largest")
    return out


def with_user_layout(df: DataFrame, layout: Callable[[Sequence[int]], Sequence[int]], by: Sequence[str] = ("epoch", "step")) -> DataFrame:
    """Adds ``max_shape``, the item shape that ``layout(indices)`` gives for the batch, its indices in order of position."""

    @F.udf("array<bigint>")
    def shape(indices):
        return [int(d) for d in layout(indices)]

    per = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_in_batch", "idx"))), lambda r: r["idx"]).alias("indices"))
    return df.join(per.select(*by, shape("indices").alias("max_shape")), list(by))


def padded(flat: Column, shape: Column, target: Column, zero: Column) -> Column:
    """A row-major array of ``shape`` in the first corner of ``target`` (a shape of the same rank, no smaller anywhere) filled up with zeros.

    Whole rows of the last dimension are copied; an array that has the target's shape already stays as it is, and one that is short in the first
    dimension only gets its zeros behind it. Raises 'Shape' for
    another rank or a target that is too small.
    """
    longs = lambda x: x.cast("array<bigint>")
    shape, target = longs(shape), longs(target)
    one = F.array(F.lit(1).cast("bigint"))
    fits = (F.size(shape) == F.size(target)) & F.forall(F.zip_with(shape, target, lambda a, b: a <= b), lambda x: x)

    def rows(v: Column) -> Column:
        lead = F.slice(F.arrays_zip(v["s"].alias("s"), v["t"].alias("t")), F.lit(1), F.size(v["s"]) - 1)
        count = F.aggregate(lead, F.lit(1).cast("bigint"), lambda a, d: a * d["t"])
        width, wide = F.element_at(v["s"], -1), F.element_at(v["t"], -1)

        def place(k: Column) -> Column:
            """Number of the source row for row ``k`` of the target, or null outside."""
            return F.when(F.size(v["s"]) <= 2, F.when(k < v["s"][0], k)).when(F.size(v["s"]) == 3, place_of_3(k)).otherwise(place_of_any(k))

        def place_of_3(k: Column) -> Column:
            x, y = (k / v["t"][1]).cast("bigint"), k % v["t"][1]
            return F.when((x < v["s"][0]) & (y < v["s"][1]), x * v["s"][1] + y)

        def place_of_any(k: Column) -> Column:
            def step(a: Column, d: Column) -> Column:
                c = F.pmod(a["rest"], d["t"])
                return F.struct(
                    F.floor(a["rest"] / d["t"]).alias("rest"), (a["row"] + c * a["unit"]).alias("row"), (a["unit"] * d["s"]).alias("unit"), (a["inside"] & (c < d["s"])).alias("inside")
                )

            zero_long, one_long = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
            start = F.struct(k.alias("rest"), zero_long.alias("row"), one_long.alias("unit"), F.lit(True).alias("inside"))
            return F.aggregate(F.reverse(lead), start, step, lambda a: F.when(a["inside"], a["row"]))

        gap = F.array_repeat(zero, (wide - width).cast("int"))
        blank = F.array_repeat(zero, wide.cast("int"))

        def row(k: Column) -> Column:
            at = place(k)
            return F.when(at.isNull(), blank).otherwise(F.concat(F.slice(v["flat"], (F.coalesce(at, F.lit(0)) * width + 1).cast("int"), width.cast("int")), gap))

        empty = F.slice(v["flat"], 1, 0)
        return F.when(count * wide == 0, empty).otherwise(F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0).cast("bigint"))), row)))

    full = lambda x: F.when(F.size(x) == 0, one).otherwise(x)
    value = F.struct(flat.alias("flat"), full(shape).alias("s"), full(target).alias("t"))
    filled = F.element_at(F.transform(F.array(value), rows), 1)
    inner = lambda x: F.slice(x, F.lit(2), F.size(x))
    total = F.aggregate(target, F.lit(1).cast("bigint"), lambda a, d: a * d)
    behind = F.concat(flat, F.array_repeat(zero, (total - F.size(flat)).cast("int")))
    return F.when(~fits, F.raise_error("Shape")).when(shape == target, flat).when(inner(shape) == inner(target), behind).otherwise(filled)


def padded_1d(flat: Column, width: Column, zero: Column) -> Column:
    """The array with zeros behind it up to ``width``."""
    return F.concat(flat, F.array_repeat(zero, F.greatest(width.cast("int") - F.size(flat), F.lit(0))))


def padded_2d(flat: Column, h: Column, w: Column, max_h: Column, max_w: Column, zero: Column) -> Column:
    """A row-major h x w array in the upper left of max_h x max_w zeros."""
    return padded(flat, F.array(h, w), F.array(max_h, max_w), zero)


def collated(df: DataFrame, column: str, by: Sequence[str] = ("epoch", "step")) -> DataFrame:
    """One row a batch: its items' arrays end to end, in order of pos_in_batch, and their number."""
    rows = F.array_sort(F.collect_list(F.struct("pos_in_batch", column)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), rows.alias("_rows")).select(
        *by, "n", F.flatten(F.transform("_rows", lambda x: x[column])).alias(column)
    )
