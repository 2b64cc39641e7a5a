"""Near duplicates among vectors: epsilon grid order join.

Of unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2c). Vectors are sorted by the cells of a grid of that width over their
leading principal axes, so the table becomes a sequence in which near vectors tend to be near; intervals of it have boxes on these axes and balls in
all dimensions. The join of the sequence with itself is split into joins of intervals, again and again: pairs of intervals further apart than eps
are skipped, pairs of which every member is near every other are counted without looking at vectors, and the others are split. Down to blocks this is
done by Spark, a level at a time; inside a pair of blocks by numpy, down to short runs whose inner products are taken in double precision.

Equal vectors are one until the end, links are counted where they are found, and a pair of blocks gives the edges of a spanning forest only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, connected_components, joined_on, lean

#: Leading axes that make the grid, and vectors (chosen by hash) that the axes are fitted to. The result is the same for any axes.
AXES, SAMPLE = 8, 2048
#: Vectors of a block: between these bounds, so that there are some ``BLOCKS`` of them, and no more bytes than that in double precision.
LEAST_BLOCK, MOST_BLOCK, BLOCKS, BLOCK_BYTES = 8192, 65536, 64, 1 << 25
#: Vectors of the shortest runs, and blocks or intervals that an interval above them has.
RUN, FAN = 256, 16
#: Room for rounding wherever a pair is skipped or taken without looking at vectors.
ROOM = 1e-9


def units(raw: np.ndarray) -> np.ndarray:
    """Vectors at length one in double precision; neither huge nor tiny ones overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample, the axes along which they differ most (length x AXES at most)."""
    out = {}
    for dim in {len(x) for x in sample}:
        u = units(np.stack([x for x in sample if len(x) == dim]))
        _, axes = np.linalg.eigh(np.cov(u.T).reshape(dim, dim) if len(u) > 1 else np.eye(dim))
        out[dim] = axes[:, ::-1][:, :AXES]
    return out


def axes_of(axes: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """Lengths that the sample lacks have the grid over their first components."""
    return axes[dim] if dim in axes else np.eye(dim, min(dim, AXES))


def cells(places: np.ndarray, eps: float) -> np.ndarray:
    """Cells on the axes, then those of a grid four times as fine."""
    return np.floor(np.concatenate((places / eps, places / (eps / 4)), axis=1)).astype(np.int32)


def bounds(u: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box on the axes, and center and radius of a ball in all dimensions."""
    center = u.mean(axis=0)
    return places.min(axis=0), places.max(axis=0), center, float(np.sqrt(((u - center) ** 2).sum(axis=1).max()))


class Levels:
    """Boxes and balls of a block's runs, of pairs of runs, pairs of these and so on up to the whole block."""

    def __init__(self, u: np.ndarray, axes: np.ndarray):
        places = u @ axes
        self.edges = np.r_[np.arange(0, len(u), RUN), len(u)]
        starts = self.edges[:-1]
        n = np.diff(self.edges)
        low, high = np.minimum.reduceat(places, starts), np.maximum.reduceat(places, starts)
        center = np.add.reduceat(u, starts) / n[:, None]
        radius = np.sqrt(np.maximum.reduceat(((u - np.repeat(center, n, axis=0)) ** 2).sum(axis=1), starts))
        self.levels = [(low, high, center, radius)]
        while len(low) > 1:
            pairs = np.arange(0, len(low), 2)
            low, high = np.minimum.reduceat(low, pairs), np.maximum.reduceat(high, pairs)
            mean = np.add.reduceat(center * n[:, None], pairs) / np.add.reduceat(n, pairs)[:, None]
            reach = np.sqrt(((center - np.repeat(mean, 2, axis=0)[: len(center)]) ** 2).sum(axis=1)) + radius
            center, radius, n = mean, np.maximum.reduceat(reach, pairs), np.add.reduceat(n, pairs)
            self.levels.append((low, high, center, radius))


def run_pairs(a: Levels, b: Levels, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(left run, right run) that must be compared, and those of which all pairs are near; of a block with itself left <= right."""
    top = max(len(a.levels), len(b.levels)) - 1
    pairs = np.zeros((1, 2), np.int64)
    sure = np.zeros(1, bool)
    for k in range(top, -1, -1):
        if k < top:  # each into its halves
            pairs = (2 * pairs[:, None, :] + np.array([[0, 0], [0, 1], [1, 0], [1, 1]])).reshape(-1, 2)
            sure = np.repeat(sure, 4)
        left, right = (x.levels[min(k, len(x.levels) - 1)] for x in (a, b))
        fine = (pairs[:, 0] < len(left[3])) & (pairs[:, 1] < len(right[3]))
        if same:
            fine &= pairs[:, 0] <= pairs[:, 1]
        pairs, sure = pairs[fine], sure[fine]
        i, j = pairs.T
        gap = np.maximum(0, np.maximum(left[0][i] - right[1][j], right[0][j] - left[1][i]))
        between = np.sqrt(((left[2][i] - right[2][j]) ** 2).sum(axis=1))
        reach = left[3][i] + right[3][j]
        near = sure | (((gap**2).sum(axis=1) <= (eps + ROOM) ** 2) & (between - reach <= eps + ROOM))
        pairs, sure = pairs[near], (sure | (between + reach < eps - ROOM))[near]
    return pairs[~sure], pairs[sure]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0..n-1 that each of them is joined to by the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def joined_blocks(left: tuple, right: tuple | None, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of two blocks, or of one with itself, and the edges (a, b) of a spanning forest of them.

    A block is (units, weights); vectors are numbered from the left block's first to the right block's last. A vector's links are the weights of
    the others it is near, its own copies not among them.
    """
    eps = float(np.sqrt(2 - 2 * least))
    same = right is None
    (u, wu), (v, wv) = left, left if same else right
    a, shift = Levels(u, axes), 0 if same else len(u)
    b = a if same else Levels(v, axes)
    links = np.zeros(shift + len(v), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    some, sure = run_pairs(a, b, eps, same)
    for i, j in sure.tolist():
        x, y = np.arange(*a.edges[i : i + 2]), np.arange(*b.edges[j : j + 2])
        links[x] += wv[y].sum() - (wu[x] if same and i == j else 0)
        if not (same and i == j):
            links[y + shift] += wu[x].sum()
        edges.append((np.r_[np.full(len(y), x[0]), x], np.r_[y + shift, np.full(len(x), y[0] + shift)]))
    for i, j in some.tolist():
        (p, q), (s, t) = a.edges[i : i + 2], b.edges[j : j + 2]
        near = u[p:q] @ v[s:t].T >= least
        if same and i == j:
            near = np.triu(near, 1)
        r, c = np.nonzero(near)
        if not len(r):
            continue
        links[p:q] += np.bincount(r, wv[s + c], q - p).astype(np.int64)
        links[s + shift : t + shift] += np.bincount(c, wu[p + r], t - s).astype(np.int64)
        r, c = r + p, c + s + shift
        if len(r) > q - p + t - s:  # no more edges than there are vectors
            nodes, at = np.unique(np.r_[r, c], return_inverse=True)
            low = spanning(at[: len(r)], at[len(r) :], len(nodes))
            r, c = nodes, nodes[low]
        edges.append((r, c))
    if not edges:
        return links, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = spanning(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]), len(links))
    node = np.nonzero(low != np.arange(len(links)))[0]
    return links, node, low[node]


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _by_length(column: pa.Array):
    """(rows, matrix) of the vectors of each length in a column of arrays."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        rows = np.nonzero(sizes == dim)[0]
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _in_grid_order(distinct: DataFrame, axes, eps: float, kind: str) -> DataFrame:
    """dim, node, n, raw in the order of the grid's cells, over all partitions."""

    def run(batches):
        for b in batches:
            dims, raws = np.zeros(b.num_rows, np.int32), [b""] * b.num_rows
            cell: list[list[int]] = [[]] * b.num_rows
            for rows, m in _by_length(b.column("v")):
                at = cells(units(m) @ axes_of(axes.value, m.shape[1]), eps).tolist()
                data = np.ascontiguousarray(m, kind)
                dims[rows] = m.shape[1]
                for k, r in enumerate(rows.tolist()):
                    raws[r], cell[r] = data[k].tobytes(), at[k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims), pa.array(cell, pa.list_(pa.int32())), b.column("node"), b.column("n"), pa.array(raws, pa.binary())], names=["dim", "cell", "node", "n", "raw"]
            )

    rows = distinct.select("v", "node", "n").mapInArrow(run, "dim int, cell array<int>, node long, n long, raw binary")
    keys = ("dim", "cell", "node")
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "dim", "node", "n", "raw")


def _blocks(rows: DataFrame, axes, most: int, kind: str) -> DataFrame:
    """Runs of at most ``most`` vectors of one length, in order: nodes, weights and vectors of each, with box and ball."""
    schema = "part int, seq int, dim int, weight long, rep long, nodes binary, weights binary, vectors binary, low array<double>, high array<double>, center array<double>, radius double"
    names = [x.split()[0] for x in schema.split(", ")]

    def made(part: int, seq: int, dim: int, nodes: list, weights: list, raws: list) -> pa.RecordBatch:
        data = b"".join(raws)
        u = units(np.frombuffer(data, kind).reshape(-1, dim))
        low, high, center, radius = bounds(u, u @ axes_of(axes.value, dim))
        row = (part, seq, dim, sum(weights), nodes[0], np.array(nodes, np.int64).tobytes(), np.array(weights, np.int64).tobytes(), data, low.tolist(), high.tolist(), center.tolist(), radius)
        return pa.RecordBatch.from_pydict({k: pa.array([x], t) for k, x, t in zip(names, row, types, strict=True)})

    floats = pa.list_(pa.float64())
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), floats, floats, floats, pa.float64()]

    def run(batches):
        seq, held, now = 0, ([], [], []), None
        for b in batches:
            for part, dim, *row in zip(*(b.column(c).to_pylist() for c in ("part", "dim", "node", "n", "raw")), strict=True):
                if held[0] and (now != (part, dim) or len(held[0]) >= min(most, max(RUN, BLOCK_BYTES // (8 * dim)))):
                    yield made(now[0], seq, now[1], *held)
                    seq, held = seq + 1, ([], [], [])
                now = (part, dim)
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        if held[0]:
            yield made(now[0], seq, now[1], *held)

    return rows.mapInArrow(run, schema)


INTERVAL = ("id", "dim", "weight", "low", "high", "center", "radius")


def _above(level: DataFrame) -> DataFrame:
    """The intervals of up to ``FAN`` neighbours; those over vectors of several lengths (dim -1) are never skipped."""

    def run(table: pa.Table) -> pa.Table:
        dims = set(table.column("dim").to_pylist())
        weight, parent = table.column("weight").to_numpy(), table.column("parent")[0].as_py()
        if len(dims) > 1 or -1 in dims:
            row = (parent, -1, int(weight.sum()), [], [], [], 0.0)
        else:
            low, high, center = (np.array(table.column(c).to_pylist()) for c in ("low", "high", "center"))
            mean = (center * weight[:, None]).sum(axis=0) / weight.sum()
            reach = np.sqrt(((center - mean) ** 2).sum(axis=1)) + table.column("radius").to_numpy()
            row = (parent, dims.pop(), int(weight.sum()), low.min(axis=0).tolist(), high.max(axis=0).tolist(), mean.tolist(), float(reach.max()))
        return pa.Table.from_pydict({k: pa.array([x], level_types[k]) for k, x in zip(INTERVAL, row, strict=True)})

    floats = pa.list_(pa.float64())
    level_types = {"id": pa.int64(), "dim": pa.int32(), "weight": pa.int64(), "low": floats, "high": floats, "center": floats, "radius": pa.float64()}
    schema = "id long, dim int, weight long, low array<double>, high array<double>, center array<double>, radius double"
    return level.withColumn("parent", F.floor(F.col("id") / FAN)).groupBy("parent").applyInArrow(run, schema)


def _pairs(blocks: DataFrame, count: int, eps: float, t: Tables) -> DataFrame:
    """Pairs a <= b of blocks that may hold near vectors; ``sure`` where all of them are."""
    levels = [t.stored(blocks.select(*INTERVAL), "intervals")]
    while FAN ** (len(levels) - 1) < count:
        levels.append(t.stored(_above(levels[-1]), "intervals"))
    top = levels[-1].select("id")
    pairs = top.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(False).alias("sure"))
    for level in reversed(levels[:-1] or levels):
        kids = level.withColumn("parent", F.floor(F.col("id") / FAN))
        x, y = (kids.select("parent", F.struct(*INTERVAL).alias(c)).withColumnRenamed("parent", p) for c, p in (("x", "a"), ("y", "b")))
        both = pairs.join(x, "a").join(y, "b").where("x.id <= y.id")
        square = lambda s: F.aggregate(s, F.lit(0.0), lambda n, d: n + d * d)
        less = lambda p, q: F.zip_with(p, q, lambda m, n: m - n)
        gap = F.zip_with(less(F.col("x.low"), F.col("y.high")), less(F.col("y.low"), F.col("x.high")), lambda p, q: F.greatest(p, q, F.lit(0.0)))
        reach = F.col("x.radius") + F.col("y.radius")
        both = both.withColumn("open", F.expr("x.dim < 0 or y.dim < 0")).where("open or x.dim = y.dim")
        both = both.withColumn("between", F.when(~F.col("open"), F.sqrt(square(less(F.col("x.center"), F.col("y.center"))))))
        near = (square(gap) <= (eps + ROOM) ** 2) & (F.col("between") - reach <= eps + ROOM)
        sure = F.col("sure") | F.coalesce(F.col("between") + reach < eps - ROOM, F.lit(False))
        both = both.where(F.col("open") | F.col("sure") | near)
        pairs = t.stored(both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), sure.alias("sure")), "interval-pairs")
    return pairs


def _found(blocks: DataFrame, pairs: DataFrame, axes, least: float, kind: str) -> DataFrame:
    """node, links, other: links that a pair of blocks adds to a vector, and edges of its forest."""
    sides = [blocks.select(F.col("id").alias(c), F.struct("dim", "nodes", "weights", "vectors").alias(s)) for c, s in (("a", "x"), ("b", "y"))]
    rows = pairs.where("not sure").select("a", "b")
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(sides[0], "a").repartition(parts, "b").join(sides[1], "b").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                i, j, x, y = (b.column(c)[k].as_py() for c in ("a", "b", "x", "y"))
                sides = [(units(np.frombuffer(s["vectors"], kind).reshape(-1, s["dim"])), np.frombuffer(s["weights"], np.int64)) for s in ((x,) if i == j else (x, y))]
                nodes = np.concatenate([np.frombuffer(s["nodes"], np.int64) for s in ((x,) if i == j else (x, y))])
                links, node, other = joined_blocks(sides[0], sides[1] if i != j else None, axes_of(axes.value, x["dim"]), least)
                some = np.nonzero(links)[0]
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(np.r_[nodes[some], nodes[node]]), "links": pa.array(np.r_[links[some], np.zeros(len(node), np.int64)]),
                    "other": pa.array(np.r_[nodes[some], nodes[other]]),
                })

    return rows.mapInArrow(run, "node long, links long, other long")


def _sure(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for the pairs of blocks whose vectors are all near each other: a sum for each block."""
    sure = pairs.where("sure").select("a", "b")
    ways = sure.union(sure.where("a <> b").select("b", "a"))
    weight = blocks.select(F.col("id").alias("b"), "weight", F.col("rep").alias("first"))
    per = ways.join(weight, "b").groupBy("a").agg(F.sum("weight").alias("links"), F.max(F.col("a") == F.col("b")).alias("own"), F.min("first").alias("first"))
    rows = blocks.select(F.col("id").alias("a"), "nodes", "weights").join(per, "a")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                nodes, weights = (np.frombuffer(b.column(c)[k].as_py(), np.int64) for c in ("nodes", "weights"))
                links = b.column("links")[k].as_py() - weights * b.column("own")[k].as_py()
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "links": pa.array(links), "other": pa.array(np.full(len(nodes), b.column("first")[k].as_py()))})

    reps = blocks.select("id", "rep")
    across = sure.join(reps.toDF("a", "node"), "a").join(reps.toDF("b", "other"), "b").select("node", F.lit(0).cast("bigint").alias("links"), "other")
    return rows.mapInArrow(run, "node long, links long, other long").union(across)


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.95, block: int | None = None) -> DataFrame:
    """id, n_links, component_id and kept for every row of ``vectors``: other rows with a cosine of ``least`` or more, the smallest id that links lead to.

    Vectors that are null, empty or zero, or hold null or non-finite numbers link with nothing, nor do vectors of different lengths. Equal vectors link
    with each other; repeated rows do so, too, and count as vectors of their own. Rows without id count as links; their component is the smallest id
    they reach, null if there is none, and they are kept if it is. Other columns are ignored; an empty table gives an empty table.
    """
    if not -1 < least <= 1:
        raise ValueError("the least cosine lies between -1 and 1")
    lean(vectors)
    t, eps = Tables(), float(np.sqrt(2 - 2 * least))
    element = vectors.schema[vector_column].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    v = F.col(vector_column).cast(f"array<{'float' if element == 'float' else 'double'}>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")), F.col("v")))
    key = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("p"), F.xxhash64(F.lit(1), F.col("v")).alias("q")))
    distinct = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("low_id"))
    distinct = t.stored(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("key", key), "distinct-vectors")
    sample = distinct.select("v", "key").orderBy("key").limit(SAMPLE).select("v").toArrow().column("v")
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes([np.array(x, np.float64) for x in sample.to_pylist()]))
    most = block or min(MOST_BLOCK, max(LEAST_BLOCK, distinct.count() // BLOCKS))
    blocks = t.stored(_blocks(_in_grid_order(distinct, axes, eps, kind), axes, most, kind), "vector-blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.groupBy("part").agg(F.count("*").alias("k"), F.min("seq").alias("from")).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("from"))
    first = t.stored(first.select("part", "first", "k"), "block-numbers")
    numbered = blocks.join(first.select("part", "first"), "part").withColumn("id", (F.col("first") + F.col("seq")).cast("bigint")).drop("part", "seq", "first")
    pairs = _pairs(numbered, first.agg(F.sum("k")).first()[0] or 0, eps, t)
    found = t.stored(_found(numbered, pairs, axes, least, kind).union(_sure(numbered, pairs)), "near-vectors")
    comps = t.kept(connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = comps.join(distinct.select("node", "low_id"), "node")
    lows = t.stored(ids.groupBy("component").agg(F.min("low_id").alias("low"), F.count("*").alias("n")), "components-low")
    named = t.stored(joined_on(ids.select("node", "component"), lows, "component", "n", t).select("node", "low"), "named")
    classes = distinct.select("key", "n", "low_id", "node").join(links, "node", "left").join(named, "node", "left")
    classes = classes.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("low", "low_id").alias("component_id"))
    classes = t.stored(classes, "vector-classes")
    out = joined_on(rows.where("v is not null").select("id", key.alias("key")), classes, "key", "n", t).select("id", "n_links", "component_id")
    out = out.union(rows.where("v is null").select("id", F.lit(0).cast("bigint"), "id")).withColumnRenamed("id", id_column)
    return t.result(out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id"))), "near-vector-classes")
