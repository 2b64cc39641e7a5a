"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Texts are tokenised whole; only documents longer than a sequence are cut, the short remainder first.
A full piece is a sequence by itself and is packed where it is. The other pieces are dealt by hash into
groups of some ten thousand sequences and every group is packed on its own: sequences are filled greedily, then
a sequence's smallest piece gives way to two unpacked pieces that fill the widened gap better. A
group leaves at most one badly filled sequence, so the loss against one global packing is below one
sequence in ``GROUP_SEQUENCES``.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.bpe import byte_symbols
from gridweave.llm.common import Tables, lean, small_batches

CAPACITY = 1024
#: Sequences that a packing group should fill.
GROUP_SEQUENCES = 16384
#: Most pieces that a group should have.
GROUP_PIECES = 1 << 19

# The pre-split of byte-level BPE (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class all Unicode versions agree on; other texts go to the library whole.
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e¡-ɏ]*+")
#: Runs of white space that the fast encoder's backtracking can't hold.
BLANK = re.compile(r"\s{10000}")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Equal to the library's encode without added special tokens. Ordinary texts take a faster encoder that is
    built from the same vocabulary (its ids are in merge order, so they are the ranks); a text
    with a special token's string, unusual characters or very long runs of white space is encoded by the library.
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spec = json.load(open(file, encoding="utf-8"))
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or BLANK.search(text) or any(s in text for s in self.special):
            return self.slow(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def pieces(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) of one document; the first piece may be shorter."""
    n = len(ids) // 4
    first = n - (max(1, -(-n // capacity)) - 1) * capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return [(k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def best_two_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of each bin. All lengths are in 1..capacity.

    A bin opens with the longest unpacked piece and takes the longest that fits until none fits.
    If a gap is left, its smallest piece may be swapped for the two unpacked pieces whose sum is the
    largest that fits the gap without it, if that is more than the piece itself.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k in sorted(range(len(lengths)), key=lambda k: -k):
        waiting[lengths[k]].append(k)
    there = 0  # bit n: a piece of length n waits
    for n in range(1, capacity + 1):
        if waiting[n]:
            there |= 1 << n

    def take(n: int) -> int:
        nonlocal there
        k = waiting[n].pop()
        if not waiting[n]:
            there &= ~(1 << n)
        return k

    def longest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    bins = []
    while there:
        n = there.bit_length() - 1
        held, gap = [take(n)], capacity - n
        while gap and (n := longest(gap)) > 0:
            held.append(take(n))
            gap -= n
        if gap and there:
            small = min(held, key=lambda k: (lengths[k], k))
            room, best, pair = gap + lengths[small], lengths[small], None
            a = longest(room - 1)
            while a > 0 and 2 * a > best:
                most = min(a, room - a)
                b = longest(most)
                if b == a and len(waiting[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(a - 1)
            if pair:
                held.remove(small)
                held += [take(pair[0]), take(pair[1])]
                waiting[lengths[small]].append(small)
                there |= 1 << lengths[small]
        bins.append(held)
    return bins


def tokenised_pieces(docs: DataFrame, file: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs(doc_id, text)``."""
    kinds = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("piece", "start", "length", "ids_crc32"))])
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = Encoder(file)
        for b in small_batches(batches):
            rows = [
                (doc, *p)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                for p in pieces(encode(text or "") + tail, capacity)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5, schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, file: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are one piece of the end token; repeated rows are packed each, and so are rows without doc_id; very long texts
    are cut only into pieces; other columns are ignored; an empty table gives an empty table. Equal lengths are taken in order of (doc_id, piece).
    Sequences of one full piece have negative numbers.
    """
    lean(docs)
    t = Tables()
    cut = tokenised_pieces(docs, file, end_id, capacity).withColumn("piece", F.col("piece").cast("int"))
    cut = t.stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full, short = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    tokens, rows = short.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-tokens // (capacity * GROUP_SEQUENCES)), -(-rows // GROUP_PIECES))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "row"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        first = int(pdf["group"].iloc[0]) << 32
        for k, held in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for x in held:
                sequence[x], offset[x] = first + k, at
                at += lengths[x]
        return pdf.assign(sequence_id=sequence, offset=offset)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    packed = (
        short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return t.result(packed.union(alone), "packed")
