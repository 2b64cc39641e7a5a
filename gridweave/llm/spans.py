"""Spans of regular expressions as column expressions: no Python on the executors.

Nothing here takes more than n log n steps for n matches in a text: arrays are never grown one by one, and running totals come from
log n passes over the whole array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,around:string>>"
#: Most characters of the text before a match that ``before`` has.
CONTEXT = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative ``both``: pass k combines each element with the one 2^k places before."""

    def one(now: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.transform(now, lambda x, i: F.when(i >= far, both(F.element_at(now, F.greatest(i - far, F.lit(0)) + 1), x)).otherwise(x))

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)
    return F.aggregate(passes, values, one)


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order: start and end in code points, value, and what stands beside it.

    ``before`` has the last characters up to the match, back to the start of the match before; ``around`` the one before and the one behind
    it. The text is split at its matches; the lengths of pieces and matches add up to the offsets. Patterns must not match the empty string.
    """
    size = lambda x: F.length(x).cast("bigint")

    def found(parts: Column) -> Column:
        hits, between = parts["hits"], parts["between"]

        def one(value: Column, i: Column) -> Column:
            last = F.when(i > 0, F.element_at(hits, F.greatest(i, F.lit(1)))).otherwise("")
            behind = F.concat(F.element_at(between, i + 2), F.coalesce(F.try_element_at(hits, i + 2), F.lit("")))
            before = F.right(F.concat(last, F.element_at(between, i + 1)), F.lit(CONTEXT))
            return F.struct(
                size(value).alias("n"), (size(F.element_at(between, i + 1)) + size(value)).alias("step"), value.alias("value"),
                before.alias("before"), F.concat(F.right(before, F.lit(1)), F.left(behind, F.lit(1))).alias("around"),
            )

        def placed(units: Column) -> Column:
            ends = running(F.transform(units, lambda u: u["step"]), lambda a, b: a + b)
            return F.zip_with(
                units, ends,
                lambda u, end: F.struct((end - u["n"]).alias("start"), end.alias("end"), u["value"].alias("value"), u["before"].alias("before"), u["around"].alias("around")),
            )

        return let(F.transform(hits, one), placed)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), let(parts, found)).otherwise(F.array().cast(SPAN))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn checksum."""
    backwards = F.split(F.reverse(digits), "")

    def doubled(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.filter(backwards, lambda d: d != ""), doubled), F.lit(0), lambda a, d: a + d) % 10 == 0


def joined(spans: Column) -> Column:
    """'kind:start:end' of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def clear_of(base: Column, spans: Column) -> Column:
    """The ``spans``, as ``find_spans`` gives them, that overlap none of ``base``, in order of their ends.

    A base span overlaps one if it begins before the other's end and reaches beyond its start: in order of these places, a span
    is clear if no base span before it has reached beyond its start.
    """

    def judged(m: Column) -> Column:
        reach = running(F.transform(m, lambda x: x["reach"]), F.greatest)
        both = F.zip_with(m, reach, lambda x, r: F.struct(x["side"].alias("side"), r.alias("reach"), x["span"].alias("span")))
        clear = F.filter(both, lambda x: (x["side"] == 0) & (x["reach"] <= x["span"]["start"]))
        return F.transform(clear, lambda x: x["span"])

    def cleared(v: Column) -> Column:
        begun = F.transform(v["base"], lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("side"), b["end"].alias("reach"), v["none"].alias("span")))
        ended = F.transform(v["spans"], lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("reach"), s.alias("span")))
        return F.when((F.size(v["base"]) == 0) | (F.size(v["spans"]) == 0), v["spans"]).otherwise(let(F.array_sort(F.concat(begun, ended)), judged))

    none = F.lit(None).cast(SPAN.removeprefix("array<").removesuffix(">"))
    return let(F.struct(base.alias("base"), spans.alias("spans"), none.alias("none")), cleared)
