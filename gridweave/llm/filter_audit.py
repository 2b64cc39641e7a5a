"""What each of five filters removes in every order: an incidence matrix times integer matrices.

A document's failures are a mask of five bits. For each part of the table the masks are counted three times: over all documents, those of good
quality and toxic ones. These histograms, stacked as rows of 32 numbers, are multiplied by fixed 32-by-600 matrices, whose columns stand for the
120 orders of the filters times 5 steps, so no order is ever run over the documents.

Whether a text was seen before needs no join back: every document counts as failing, and the first one of each text, found by a rank that Spark
limits before it shuffles, is counted back.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, lean, small_batches, text_bytes

FILTERS = "ABCDE"
#: Bit of the filter that needs other documents.
REPEATED = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Limits of the filters: words, percent of different words, percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
SYMBOL = re.compile(rb"[#$%&*|]")
CAPITALS, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Parts whose rows one batch of results holds.
PARTS_AT_ONCE = 32


def text_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text, as UTF-8, fails."""
    words = raw.split()
    n = len(words)
    return (
        (n < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(raw.translate(None, CONTINUED))) << 2
        | (SYMBOL.search(raw) is not None) << 3
    )


def step_matrices() -> dict[str, np.ndarray]:
    """32 x 600 matrices (mask, order and step) of what a document of that mask adds to each count."""
    bits = np.array([[1 << FILTERS.index(c) for c in o] for o in ORDERS])
    at = bits.reshape(-1)
    before = (np.cumsum(bits, axis=1) - bits).reshape(-1)
    mask = np.arange(MASKS)[:, None]
    fails, earlier = (mask & at) != 0, (mask & before) != 0
    removed = fails & ~earlier
    share = np.stack([removed[:, at == 1 << k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
    out = {
        "kept": ~fails & ~earlier, "removed": removed, "redundant": fails & earlier, "unique_fails": mask == at,
        "shapley": share[:, np.log2(at).astype(int)],
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def facts(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, mask (without the filter on repeats) and a digest of the text for every row."""

    def run(batches):
        for b in small_batches(batches):
            raw = text_bytes(b.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "part": b.column("part"), "mask": pa.array([text_mask(x) for x in raw], pa.int32()),
                "key": pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
            })

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return lean(rows).mapInArrow(run, "doc_id long, part string, mask int, key binary")


def histograms(docs: DataFrame, labels: DataFrame, part: str, t: Tables) -> DataFrame:
    """part, cells: the counts of a part's documents by mask, quality and toxicity (128 at most)."""
    rows = t.stored(facts(docs, part), "filter-facts")
    first = F.rank().over(Window.partitionBy("key").orderBy("doc_id"))
    firsts = rows.where("doc_id is not null").withColumn("first", first).where("first = 1")
    one = F.lit(1).cast("bigint")
    again = F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(REPEATED))
    signed = rows.select("doc_id", "part", again.alias("mask"), one.alias("n")).unionByName(
        firsts.select("doc_id", "part", F.explode(F.array(F.struct(again.alias("mask"), (-one).alias("n")), F.struct("mask", one.alias("n")))).alias("x")).select("doc_id", "part", "x.*")
    )
    counted = signed.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    said = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")))
    joined = counted.join(said.where("quality or toxic"), "doc_id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")]
    cells = joined.select("part", "mask", "n", *flags).groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "quality", "toxic", "n")).alias("cells"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    Null texts are empty, equal to each other and to empty ones; a null part is the empty string. A row without doc_id is never a repeat, nor does
    it make others one; rows that share an id and a text are no repeats of each other. A document that ``labels`` has several rows for is good, or
    toxic, if any of them says so; null labels say nothing. Very long texts are read whole; other columns are ignored; an empty table has no parts.
    """
    t = Tables()
    matrices = step_matrices()
    orders = pa.array([o for o in ORDERS for _ in FILTERS])
    steps = pa.array(list(range(1, len(FILTERS) + 1)) * len(ORDERS), pa.int32())

    def run(batches):
        for b in small_batches(batches, PARTS_AT_ONCE):
            parts = b.column("part")
            seen = np.zeros((3, b.num_rows, MASKS), np.int64)
            for i, cells in enumerate(b.column("cells").to_pylist()):
                for c in cells:
                    seen[:, i, c["mask"]] += np.array([1, c["quality"], c["toxic"]]) * c["n"]
            everyone, good, toxic = seen
            out = {k: everyone @ m for k, m in matrices.items()} | {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"]}
            columns = {
                "part": parts.take(pa.array(np.repeat(np.arange(len(parts)), len(orders)))),
                "filter_order": pa.concat_arrays([orders] * len(parts)), "step": pa.concat_arrays([steps] * len(parts)),
            }
            names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(out[k].reshape(-1)) for k in names})

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return t.result(histograms(docs, labels, part, t).mapInArrow(run, schema), "filter-audit")
