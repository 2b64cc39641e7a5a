"""Personal data by weak supervision, in DataFrame expressions only.

Wide regular expressions propose candidate spans. Labelers vote on each (1: personal data, -1: not, 0:
abstains): a strict pattern, a checksum or range test, a gazetteer, cue words before the span, and
the characters around it. Votes have 3^5 patterns a kind at most, so their counts are a bounded
table; expectation-maximisation over it, one fold expression, estimates each labeler's
reliability and the posterior of each pattern. With the posteriors as soft labels a final
naive-Bayes classifier over span features is fitted by grouped sums, and decides which candidates are added. The
spans of the strict patterns are always kept.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Tables
from gridweave.llm.spans import clear_of, digits_of, find_spans, joined, luhn

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 25
#: Posterior of the final classifier from which a candidate is added.
ADD_FROM = 0.9

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Strict patterns. Possessive loops and look-behinds give the leftmost matches of the plain patterns
#: in time linear in the text and without recursion.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide patterns for candidates that the strict ones do not take: other ways of writing, and what only looks like them (times, numbers without a
#: right checksum), so that the classifier sees both.
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:\(at\)|\[at\]|@)\x20?{_LABEL}{{1,63}}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?{_LABEL}{{2,63}}+){{1,4}}+",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}+|00[1-9][0-9]?(?:[\x20.-]?[0-9]{2,4}){3,5}+)(?![0-9.-])",
}
#: A cheap test that every wide match passes (a regular expression).
HINT = {"email": r"@|\(at\)|\[at\]", "ip": r":[0-9A-Fa-f]{0,4}:", "card": r"[0-9](?:[\x20.-]?[0-9]){12}", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9\x20.-]{6}"}
# Gazetteers (fixed values): top-level domains, network prefixes, issuer prefixes, calling codes.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ch|at|be)$",
    "ip": r"^(?:10|127|172|192|2001|fe80|fd[0-9a-f]{2})[.:]",
    "card": r"^(?:4|5[1-5]|34|37|6011|65|35)",
    "phone": r"^\+?\(?(?:1|33|34|39|44|49|[2-9][0-9]{2}\)?[\x20.-])",
}
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write to|reach)\W{0,3}(?:\w+\W{1,3}){0,2}$",
    "ip": r"(?i)(?:\bip|addr(?:ess)?|host|server|client|from)\W{0,3}(?:\w+\W{1,3}){0,2}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|pay(?:ment)?)\W{0,3}(?:\w+\W{1,3}){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W{0,3}(?:\w+\W{1,3}){0,2}$",
}
AGAINST = r"(?i)(?:version|release|section|isbn|issn|order|invoice|serial|build|sha|md5|id)\W{0,3}$"
LABELERS = 5
#: Right votes that each labeler is taken to have given before any are seen: keeps the classes from trading places.
PRIOR = 8.0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (bare(p).try_cast("int") <= 255))
    if kind == "card":
        d = digits_of(value)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(value)).between(8, 15)
    return F.lit(True)


def plausible(kind: str, value: Column) -> Column:
    """The checksum or range labeler, for candidates of either pattern."""
    d = digits_of(value)
    return {
        "email": value.rlike(r"[A-Za-z]") & (F.length(value) <= 120),
        "ip": value.rlike(r"^[0-9.]+$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (value.rlike(r"^(?!.*::.*::)(?!.*:::).*::") & value.rlike("(?:[0-9A-Fa-f]:*){5}")),
        "card": F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False),
        "phone": F.length(F.regexp_replace(d, "^00", "")).between(10, 15),
    }[kind]


def _base(text: Column, kind: str) -> Column:
    good = F.filter(find_spans(text, STRICT[kind]), lambda s: valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), *(s[n].alias(n) for n in ("start", "end", "value", "before", "around"))))


def _votes(kind: str, value: Column, before: Column, around: Column, strict: Column) -> Column:
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    return F.array(
        F.when(strict, yes).otherwise(none),
        F.when(plausible(kind, value), yes).otherwise(no),
        F.when(value.rlike(GAZETTEER[kind]), yes).otherwise(none),
        F.when(before.rlike(AGAINST), no).when(before.rlike(CUES[kind]), yes).otherwise(none),
        F.when(around.rlike(r"^[\s(<\[\"':;,]?[\s)>\]\"':;,.]?$"), yes).otherwise(no),
    )


def _features(kind: str, value: Column, before: Column, around: Column) -> Column:
    """Bucketed features of a span, as 'kind|name=value' strings of a bounded set."""
    bucket = lambda n, most: F.least(n, F.lit(most)).cast("string")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]", "a"), r"[^9a]", "-")
    return F.transform(
        F.array(
            F.concat(F.lit("length="), bucket(F.floor(F.length(value) / 4), 10)),
            F.concat(F.lit("digits="), bucket(F.length(digits_of(value)), 20)),
            F.concat(F.lit("marks="), bucket(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), 8)),
            F.concat(F.lit("first="), F.substr(shape, F.lit(1), F.lit(1))),
            F.concat(F.lit("cue="), before.rlike(CUES[kind]).cast("string")),
            F.concat(F.lit("against="), before.rlike(AGAINST).cast("string")),
            F.concat(F.lit("around="), around.rlike(r"^\W*$").cast("string")),
            F.concat(F.lit("check="), plausible(kind, value).cast("string")),
            F.concat(F.lit("known="), value.rlike(GAZETTEER[kind]).cast("string")),
        ),
        lambda x: F.concat(F.lit(f"{kind}|"), x),
    )


def _candidates(text: Column, kind: str, base: Column) -> Column:
    """Base spans and wide matches of a kind, with votes and features."""

    def described(s: Column, strict: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), strict.alias("strict"),
            _votes(kind, s["value"], s["before"], s["around"], strict).alias("votes"),
            _features(kind, s["value"], s["before"], s["around"]).alias("features"),
        )

    wide = clear_of(base, find_spans(text, WIDE[kind]))
    wide = F.when(text.rlike(HINT[kind]), F.transform(wide, lambda s: described(s, F.lit(False))))
    own = F.transform(F.filter(base, lambda s: s["kind"] == kind), lambda s: described(s, F.lit(True)))
    return F.when(wide.isNotNull(), F.concat(own, wide)).otherwise(own)


def candidate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (sorted strict spans) and candidates of every row."""
    text = F.coalesce("text", F.lit(""))
    with_base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", *(_base(F.col("text"), k).alias(f"base_{k}") for k in KINDS)
    )
    base = with_base.withColumn("base", F.concat(*(F.col(f"base_{k}") for k in KINDS)))
    return base.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"),
        F.concat(*(_candidates(F.col("text"), k, F.col("base")) for k in KINDS)).alias("candidates"),
    )


def em_posteriors(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, votes, n, posterior, reliability) for the counted vote patterns ``votes(kind, votes, n)``.

    Two hidden classes; each labeler's vote is independent given the class. ``reliability`` has, for
    each labeler, the estimated share of its cast votes that are right. The patterns of a kind are at most 3^labelers.
    """
    spots = 3 * LABELERS
    grid = F.sequence(F.lit(0), F.lit(spots - 1))

    def weights(patterns: Column, q: Column, of_one: bool) -> Column:
        """P(vote | class) for each labeler and vote value; the prior favours right votes."""
        share = F.zip_with(patterns, q, lambda p, x: F.struct(p["votes"].alias("votes"), (p["n"] * (x if of_one else 1 - x)).alias("w")))
        total = F.aggregate(share, F.lit(0.0), lambda a, s: a + s["w"])
        return F.transform(
            grid,
            lambda k: (
                F.aggregate(
                    share, F.when(k % 3 == (2 if of_one else 0), 1.0 + PRIOR).otherwise(1.0),
                    lambda a, s: a + F.when(F.element_at(s["votes"], (F.floor(k / 3) + 1).cast("int")) + 1 == k % 3, s["w"]).otherwise(0.0),
                )
                / (total + 3.0 + PRIOR)
            ),
        )

    def step(state: Column, _: Column) -> Column:
        patterns = state["patterns"]
        q = state["q"]
        one = F.aggregate(F.zip_with(patterns, q, lambda p, x: p["n"] * x), F.lit(1.0), lambda a, x: a + x)
        zero = F.aggregate(F.zip_with(patterns, q, lambda p, x: p["n"] * (1 - x)), F.lit(1.0), lambda a, x: a + x)
        w1, w0 = state["w1"], state["w0"]

        def posterior(p: Column) -> Column:
            at = lambda l: (F.element_at(p["votes"], l) + 2 + 3 * (l - 1)).cast("int")  # noqa: E731, E741
            odds = F.aggregate(
                F.sequence(F.lit(1), F.lit(LABELERS)), F.log(one / zero),
                lambda a, l: a + F.log(F.element_at(w1, at(l)) / F.element_at(w0, at(l))),  # noqa: E741
            )
            return 1 / (1 + F.exp(-odds))

        new = F.transform(patterns, posterior)
        return F.struct(patterns.alias("patterns"), new.alias("q"), weights(patterns, new, True).alias("w1"), weights(patterns, new, False).alias("w0"))

    patterns = F.col("patterns")
    first = F.transform(patterns, lambda p: 1 / (1 + F.exp(-F.aggregate(p["votes"], F.lit(0.0), lambda a, v: a + v))))
    grouped = votes.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    grouped = grouped.withColumn("q0", first)
    start = F.struct(
        patterns.alias("patterns"), F.col("q0").alias("q"),
        weights(patterns, F.col("q0"), True).alias("w1"), weights(patterns, F.col("q0"), False).alias("w0"),
    )
    done = grouped.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s"))
    right = F.transform(
        F.sequence(F.lit(0), F.lit(LABELERS - 1)),
        lambda l: (F.element_at("s.w1", (3 * l + 3).cast("int")) + F.element_at("s.w0", (3 * l + 1).cast("int")))  # noqa: E741
        / (
            F.element_at("s.w1", (3 * l + 3).cast("int")) + F.element_at("s.w1", (3 * l + 1).cast("int"))
            + F.element_at("s.w0", (3 * l + 3).cast("int")) + F.element_at("s.w0", (3 * l + 1).cast("int"))
        ),
    )
    return done.select("kind", F.explode(F.arrays_zip(F.col("s.patterns").alias("p"), F.col("s.q").alias("q"))).alias("x"), right.alias("reliability")).select(
        "kind", F.col("x.p.votes").alias("votes"), F.col("x.p.n").alias("n"), F.col("x.q").alias("posterior"), "reliability"
    )


def span_classifier(found: DataFrame, t: Tables) -> dict[str, float]:
    """Log-odds of each feature and, under 'kind', of each kind: the final classifier.

    Fitted on every candidate, each weighted by its posterior. The feature set is fixed, so the
    table that reaches the driver has a few hundred rows at any input size.
    """
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    rows = t.stored(rows, "votes")
    posterior = em_posteriors(rows.groupBy("kind", "votes").agg(F.sum("n").alias("n"))).select("kind", "votes", "posterior")
    soft = rows.join(F.broadcast(posterior), ["kind", "votes"])  # at most 4 * 3^5 rows
    one, zero = F.sum(F.col("n") * F.col("posterior")).alias("one"), F.sum(F.col("n") * (1 - F.col("posterior"))).alias("zero")
    totals = {r.kind: (r.one, r.zero) for r in soft.groupBy("kind").agg(one, zero).collect()}
    loose = {r.kind: (r.one, r.zero) for r in soft.where(F.element_at("votes", 1) == 0).groupBy("kind").agg(one, zero).collect()}
    per_feature = soft.select("kind", "n", "posterior", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(one, zero).collect()
    seen = {r.feature: (r.kind, r.one, r.zero) for r in per_feature}
    return feature_odds(totals, loose, seen)


#: Features that say what labelers say, the value that speaks for personal data, and whether the other value speaks against it or for nothing.
TELLING = {"cue": ("true", False), "against": ("false", True), "around": ("true", True), "check": ("true", True), "known": ("true", False)}
#: Candidates of either class that have the features all candidates have, beside those seen.
POOL = 20.0


def feature_odds(totals: dict[str, tuple[float, float]], loose: dict[str, tuple[float, float]], seen: dict[str, tuple[str, float, float]]) -> dict[str, float]:
    """Log-odds by feature and kind from soft counts (one, zero): of kinds in ``totals``, of their candidates that no strict pattern takes in ``loose``,
    of features, with their kind, in ``seen``.

    The kind's own odds are those of loose candidates, the only ones decided on. A class with few candidates is filled up: with ``PRIOR`` for what
    labelers say, right in either class, as in the EM; else with ``POOL`` candidates that are like all of the kind, so that a value which is rare speaks
    neither for nor against as long as one class only has been seen. A labeler that abstains says nothing.
    """
    out = {}
    for kind, (one, zero) in totals.items():
        yes, no = loose.get(kind, (0.0, 0.0))
        out[kind] = log((yes + PRIOR) / (no + PRIOR))
        for name, (right, counts_against) in TELLING.items():
            for value in ("true", "false"):
                _, a, b = seen.get(f"{kind}|{name}={value}", (kind, 0.0, 0.0))
                for_, against = (PRIOR, 0.0) if value == right else (0.0, PRIOR)
                odds = log((a + for_ + 1) / (one + PRIOR + 2)) - log((b + against + 1) / (zero + PRIOR + 2))
                silent = value == "false" and name in ("cue", "against", "known")
                out[f"{kind}|{name}={value}"] = 0.0 if silent else odds if counts_against else max(odds, 0.0)
    for feature, (kind, a, b) in seen.items():
        if feature not in out:
            (one, zero), share = totals[kind], (a + b) / sum(totals[kind])
            out[feature] = log((a + POOL * share) / (one + POOL)) - log((b + POOL * share) / (zero + POOL))
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (arrays of kind, start, end).

    Offsets are code points of the whole text. Null text counts as empty and has no spans; a null doc_id stays null; repeated
    rows stay; other columns are ignored; an empty table gives an empty table. Very long texts with very many matches take time in
    proportion to n log n. Spans are in order of kind, then start, then end; a candidate that overlaps a base span is never added.
    """
    t = Tables()
    found = t.stored(candidate_spans(docs), "personal")
    odds = span_classifier(found, t)
    weights = F.create_map(*(F.lit(x) for kv in sorted(odds.items()) for x in kv)) if odds else F.lit(None).cast("map<string,double>")
    limit = log(ADD_FROM / (1 - ADD_FROM))

    def score(c: Column) -> Column:
        return F.aggregate(
            c["features"], F.coalesce(F.try_element_at(weights, c["kind"]), F.lit(0.0)),
            lambda a, f: a + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)),
        )

    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    added = F.transform(F.filter("candidates", lambda c: ~c["strict"] & (score(c) >= limit)), bare)
    place = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = F.array_sort(F.transform(F.concat("base", added), place))
    return t.result(found.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.transform(spans, bare).alias("spans")), "personal-data")


def personal_data_digests(docs: DataFrame) -> DataFrame:
    """The report of ``find_personal_data`` with the base spans hashed and all spans joined."""
    found = find_personal_data(docs)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
