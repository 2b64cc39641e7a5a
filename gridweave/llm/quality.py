"""Quality rules as a short-circuit cascade.

A document is kept when no rule rejects it. Rules are independent predicates, so any order gives
the same verdict; the order only decides how much work a rejected document costs. Cost (seconds)
and selectivity (share rejected) of every rule are measured on a bounded sample, and the rules then
run in order of falling rejection per second, each task stopping a document at its first rejection.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridweave.llm.common import lean, small_batches, text_bytes

#: Rows, about, of the sample that costs and selectivities are measured on.
SAMPLE_ROWS = 1000

SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a ``width``-word window found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    v = len(ids)
    key, base = w[:n], v
    for k in range(1, width):
        if base > (1 << 62) // v:  # dense ranks keep the key exact
            ranks, key = np.unique(key, return_inverse=True)
            base = len(ranks)
        key = key * v + w[k : n + k]
        base *= v
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= hit
    return int(covered.sum())


class Features:
    """Lazily computed measures of one text (UTF-8 bytes)."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.words = raw.split()  # ASCII white space: exactly the separators of the word rule
        self.n_words = len(self.words)

    def __getattr__(self, name: str):
        value = getattr(Features, f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    def _n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def _lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        return repeated_words(self.words)

    def _n_digits(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"0123456789"))

    def _most_frequent(self) -> int:
        return max(Counter(self.words).values(), default=0)


@dataclass(frozen=True)
class Rule:
    """``rejects(features)`` is true for a document to be thrown away."""

    name: str
    rejects: Callable[[Features], bool]


#: The two rules of the contract come first; the rest only reject what no prose reaches.
RULES = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", lambda f: 4 * f.n_symbols > f.word_chars),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 70 * len(f.lines)),
    Rule("digits", lambda f: 2 * f.n_digits > f.word_chars),
    Rule("word_length", lambda f: f.word_chars > 40 * f.n_words or 3 * f.word_chars < 4 * f.n_words),
    Rule("one_word", lambda f: 2 * f.most_frequent > f.n_words),
)


def measured(texts: Iterable[bytes], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(name, seconds per text, share rejected) of each rule on ``texts``, each on fresh features."""
    texts = list(texts)
    out = []
    for rule in rules:
        began, hits = time.perf_counter(), 0
        for x in texts:
            hits += bool(rule.rejects(Features(x)))
        n = max(1, len(texts))
        out.append((rule.name, (time.perf_counter() - began) / n, hits / n))
    return out


def ordered(stats: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by falling rejection per cost; ties keep the given order."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in stats}
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[str, ...]:
    """Names of the rules in the order that a sample of ``docs`` of about ``sample_rows`` rows suggests.

    Rules are measured where the sampled texts are; a few numbers a rule and task come to the driver.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))

    def run(batches):
        total: dict[str, list] = {r.name: [0.0, 0, 0] for r in rules}
        for b in small_batches(batches):
            texts = text_bytes(b.column("text"))
            for name, cost, hits in measured(texts, rules):
                total[name] = [total[name][0] + cost * len(texts), total[name][1] + round(hits * len(texts)), total[name][2] + len(texts)]
        rows = [(k, *v) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["rule", "cost", "hits", "n"])

    found = docs.select("text").sample(fraction=share, seed=7).mapInArrow(run, "rule string, cost double, hits long, n long")
    said = {r.rule: r for r in found.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("cost", "hits", "n"))).collect()}
    stats = [(r.name, x.cost / max(1, x.n), x.hits / max(1, x.n)) if (x := said.get(r.name)) else (r.name, 0.0, 0.0) for r in rules]
    return tuple(r.name for r in ordered(stats, rules))


def verdict(features: Features, order: tuple[Rule, ...]) -> str | None:
    """Name of the first rule that rejects, or None; later rules are not run."""
    for rule in order:
        if rule.rejects(features):
            return rule.name
    return None


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds ``rejected_by`` (null: kept) to every row of ``docs(text, ...)``: the rule that stopped the cascade, so which
    of several that apply it names depends on the measured order.

    Null text counts as empty and is rejected for too few words; an empty table gives an empty
    table; repeated rows each get their own verdict; other columns pass through (a column already
    called ``rejected_by`` is replaced).
    """
    lean(docs)
    names = plan_cascade(docs, rules, sample_rows)
    chain = tuple(next(r for r in rules if r.name == n) for n in names)
    docs = docs.drop("rejected_by")
    schema = StructType([*docs.schema.fields, StructField("rejected_by", StringType())])

    def run(batches):
        for b in small_batches(batches):
            said = [verdict(Features(x), chain) for x in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, "rejected_by"]
            )

    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures and verdict of each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Null or empty text has zero words, so base_failed; a null doc_id stays null; repeated rows each get a row; very long texts are measured whole; other
    columns are ignored; an empty table gives an empty table. The measures are needed whole here, so only
    the rules beyond them are spared by the cascade.
    """
    lean(docs)
    names = plan_cascade(docs, rules, sample_rows)
    chain = tuple(next(r for r in rules if r.name == n) for n in names)
    kinds = [("doc_id", pa.int64())] + [
        (k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ] + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    out = pa.schema(kinds)

    def run(batches):
        for b in small_batches(batches):
            rows: list[list] = [[] for _ in kinds[1:]]
            for x in text_bytes(b.column("text")):
                f = Features(x)
                failed = f.n_words < 10 or 100 * f.n_repeat_words > 20 * f.n_words
                kept = not failed and verdict(f, chain) is None
                said = (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, kept)
                for column, v in zip(rows, said, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(rows, kinds[1:], strict=True))], schema=out
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean",
    )
