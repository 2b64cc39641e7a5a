"""Secrets by grammar inference over credential strings.

Plain patterns give the base spans of every whole text and all long runs of token characters give the other
candidates. The base values are labelled credentials: of each kind a bounded number of distinct values
(by hash, so in no order of the input), together with made-up ones of well-known formats, is written as strings of character classes, put into a prefix
tree with counts, and the tree's states are merged where a Hoeffding test finds their futures compatible. The
probabilistic automata score every candidate by its log-likelihood a character against a background of ordinary
long words. What a candidate must reach is what values of its kind that were held out of learning reach; those that do are added to the base spans.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, lean, rewritten
from gridweave.llm.spans import clear_of, find_spans, joined

KINDS = ("assign", "access", "hex")
#: Most distinct values of a kind (and of the background) that an automaton is learned from.
SAMPLE = 400
#: Lengths of the background's words, and how many a text may give.
ORDINARY, WORDS = (12, 40), 4
#: Passages of a state that are taken to follow the classes' shares in all strings; classes there are about.
BACK_OFF, CLASSES = 4.0, 12
#: Confidence parameter of the compatibility test.
ALPHA = 0.05
#: Share of a kind's held-out values that its threshold must accept; one value in so many is held out.
ACCEPTED, HELD_OUT = 0.98, 4
#: Share of held-out ordinary forms that it must refuse.
REFUSED = 0.99
#: How much likelier than the background a candidate must be at least.
LIKELIER = log(1000)
_MIXED, _URL = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-"
#: Well-known formats (fixed values): kind, what the credential begins with, the characters behind it, and how many, from and to.
FORMATS = (
    ("assign", "", _MIXED, 20, 44),
    ("assign", "", _MIXED + "+/", 28, 64),
    ("assign", "ghp_", _MIXED, 36, 36),
    ("assign", "sk-", _MIXED, 32, 48),
    ("assign", "eyJ", _URL, 17, 80),
    ("assign", "", _URL, 24, 64),
    ("access", "AKIA", string.ascii_uppercase + "234567", 16, 16),
    ("hex", "", "0123456789abcdef", 32, 32),
    ("hex", "", "0123456789abcdef", 40, 64),
)
#: Made-up values of each format.
MADE = 60

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
}
VALUE = r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Fewest characters of a labelled value of each kind.
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Other candidates: all whole runs of token characters from the shortest labelled length on; the likelihood decides.
RUN = rf"[A-Za-z0-9+/_=-]{{{min(LEAST.values())},}}+"


def secret_value(kind: str, value: Column) -> Column:
    """The credential in a match: the value after the sign, or the whole match."""
    return F.regexp_extract(value, VALUE, 1) if kind == "assign" else value


def candidate_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and other spans (kind, start, end, value) of every row; null text counts as empty."""
    text = F.col("text")

    def base(kind: str) -> Column:
        made = F.transform(
            find_spans(text, PATTERNS[kind]),
            lambda s: F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), secret_value(kind, s["value"]).alias("value")
            ),
        )
        return F.filter(made, lambda s: F.length(s["value"]) >= LEAST[kind])

    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.concat(*(base(k) for k in KINDS)).alias("base")
    )
    # the background's words: of each text those with the smallest hashes, so that the choice does not depend on how rows are laid out
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.length(w).between(*ORDINARY))
    words = F.slice(F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct(F.xxhash64(w).alias("hash"), w.alias("word")))), 1, WORDS)
    plain = F.transform(clear_of(F.col("base"), find_spans(text, RUN)), lambda s: F.struct(*(s[n].alias(n) for n in ("start", "end", "value"))))
    return found.select("doc_id", "base", plain.alias("other"), F.transform(words, lambda w: w["word"]).alias("words"))


def classes(value: str) -> str:
    """A string of character classes: 0 digit, a/A hexadecimal letter, z/Z other letter, else itself."""
    out = []
    for c in value:
        if "0" <= c <= "9":
            out.append("0")
        elif "a" <= c <= "f":
            out.append("a")
        elif "g" <= c <= "z":
            out.append("z")
        elif "A" <= c <= "F":
            out.append("A")
        elif "G" <= c <= "Z":
            out.append("Z")
        else:
            out.append(c)
    return "".join(out)


def coarse(value: str) -> str:
    """The same with all small letters and all capitals alike."""
    return classes(value).replace("z", "a").replace("Z", "A")


class Grammar:
    """A probabilistic automaton learned by state merging from strings with counts."""

    def __init__(self, strings: Counter, alpha: float = ALPHA):
        self.seen, self.ends, self.next = [0], [0], [{}]
        for s, n in sorted(strings.items()):
            at = 0
            self.seen[0] += n
            for c in s:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                at = to
                self.seen[at] += n
            self.ends[at] += n
        self.bound = sqrt(0.5 * log(2 / alpha))
        self.merge_states()
        self.symbols = len({c for s in strings for c in s}) + 2

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / sqrt(n1) + 1 / sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if a == b:
                continue
            n1, n2 = self.seen[a], self.seen[b]
            if self.differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self.differ(self.seen[x] if x is not None else 0, n1, self.seen[y] if y is not None else 0, n2):
                    return False
                if x is not None and y is not None:
                    pairs.append((x, y))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, y in sorted(self.next[b].items()):
                x = self.next[a].get(c)
                if x is None:
                    self.next[a][c] = y
                elif x != y:
                    pairs.append((x, y))

    def merge_states(self) -> None:
        """Red states are settled; each blue one, behind a red state, joins the first compatible red one or turns red."""
        red = [0]
        settled = {0}
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda x: -self.seen[self.next[x[0]][x[1]]])
            source, c = blue.pop(0)
            b = self.next[source][c]
            if b in settled:
                continue
            for r in red:
                if self.compatible(r, b):
                    self.next[source][c] = r
                    self.fold(r, b)
                    break
            else:
                red.append(b)
                settled.add(b)
            blue = [(r, c) for r in red for c, to in sorted(self.next[r].items()) if to not in settled]
        self.states = red

    def score(self, s: str) -> float:
        """Log-likelihood of a string. A state's arcs are mixed with the classes' shares in all strings, which also stand in where there is no arc."""
        at: int | None = 0
        total = 0.0
        for c in s:
            share = self.share.get(c, self.rare)
            if at is None:
                total += log(share)
                continue
            total += log((self.seen_arc(at, c) + BACK_OFF * share) / (self.seen[at] + BACK_OFF))
            at = self.next[at].get(c)
        if at is None:
            return total + log(0.01)
        return total + log((self.ends[at] + 0.1) / (self.seen[at] + 0.1 * self.symbols))

    def seen_arc(self, at: int, c: str) -> float:
        """Passages of an arc: what does not end is shared out by the arcs' learned counts."""
        return self.arcs[at].get(c, 0.0) if at in self.arcs else 0.0

    def trained(self, strings: Counter) -> "Grammar":
        """Counts each arc's passages by running the strings through the finished automaton."""
        self.arcs = {}
        self.seen = [0] * len(self.seen)
        self.ends = [0] * len(self.ends)
        for s, n in strings.items():
            at = 0
            for c in s:
                self.seen[at] += n
                row = self.arcs.setdefault(at, {})
                row[c] = row.get(c, 0) + n
                at = self.next[at][c]
            self.seen[at] += n
            self.ends[at] += n
        classes_seen = Counter()
        for s, n in strings.items():
            for c in s:
                classes_seen[c] += n
        total = sum(classes_seen.values()) + 0.5 * CLASSES
        self.rare = 0.5 / total
        self.share = {c: (n + 0.5) / total for c, n in classes_seen.items()}
        return self


def learned(strings: list[str], view=classes) -> Grammar:
    counts = Counter(map(view, strings))
    return Grammar(counts).trained(counts)


def made_up(kind: str) -> list[str]:
    """Values of the kind's well-known formats, always the same: what is learned from where a table labels few or none."""
    out = []
    for _, start, characters, low, high in (f for f in FORMATS if f[0] == kind):
        for k in range(MADE):
            drawn = hashlib.shake_128(f"{start} {characters} {k}".encode()).digest(2 * high + 2)
            n = low + int.from_bytes(drawn[:2], "little") % (high - low + 1)
            out.append(start + "".join(characters[int.from_bytes(drawn[2 * i : 2 * i + 2], "little") % len(characters)] for i in range(1, n + 1)))
    return out


def ordinary_forms(words: list[str]) -> list[str]:
    """What long runs of token characters are made of when they are no secret: words as they are, in capitals, with a number, in rows joined in the usual
    ways; numbers and dates; lines of one mark."""
    out = []
    for i, w in enumerate(words):
        other = words[(7 * i + 3) % len(words)][: 4 + i % 9]
        number = str(int.from_bytes(hashlib.shake_128(f"number {i}".encode()).digest(6), "little"))
        joined_by = "-_/"[i % 3]
        out += [w, w.upper(), w.title(), w.lower() + other.title(), f"{w}{joined_by}{other}", f"{w.upper()}{joined_by}{other.upper()}"]
        out += [f"{w}{joined_by if i % 2 else ''}{number[: 1 + i % 4]}", number[: 12 + i % 3]]
        out += [joined_by.join(x for x in (w[:4], other[:5], w[4:9], other[5:], w[9:]) if x)]
        out += [f"{1900 + i % 200}{joined_by}{1 + i % 12:02d}{joined_by}{1 + i % 31:02d}{joined_by}{other}"]
    return out + [mark * (12 + 3 * k) for mark in "-_=/+" for k in range(8)]


class View:
    """Automata of the kinds and of the background over one kind of classes, with a threshold for each kind: above what values held out reach at
    least, and above what nearly all ordinary forms held out reach at most."""

    def __init__(self, view, values: dict[str, list[str]], plain: list[str]):
        self.view = view
        self.background = learned([x for i, x in enumerate(plain) if i % HELD_OUT], view)
        self.kinds, self.least = {}, {}
        for k in KINDS:
            self.kinds[k] = learned([x for i, x in enumerate(values[k]) if i % HELD_OUT], view)
            reached = sorted(self.gain(k, x) for x in values[k][::HELD_OUT])
            others = sorted(self.gain(k, x) for x in plain[::HELD_OUT])
            self.least[k] = max(reached[int((1 - ACCEPTED) * len(reached))], others[int(REFUSED * (len(others) - 1))])

    def gain(self, kind: str, value: str) -> float:
        """How much likelier than the background a value is, in logarithms a character."""
        s = self.view(value)
        return (self.kinds[kind].score(s) - self.background.score(s)) / (len(s) + 1)

    def best(self, value: str) -> tuple[float, str] | None:
        """How far above its threshold the best kind is, and which it is."""
        s = self.view(value)
        plain, best = self.background.score(s), None
        for k, g in self.kinds.items():
            x = g.score(s) - plain
            over = x / (len(s) + 1) - self.least[k]
            if over >= 0 and x > LIKELIER and (best is None or over > best[0]):
                best = (over, k)
        return best


class Detector:
    """A value is a credential of the kind that either view finds it likely of."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        plain = ordinary_forms([w for w in ordinary if w])
        values = {k: labelled.get(k, []) + made_up(k) for k in KINDS}
        self.views = [View(v, values, plain) for v in (classes, coarse)]

    def __call__(self, value: str) -> str | None:
        """The kind that a candidate's format is likely of, or None."""
        found = [b for v in self.views if (b := v.best(value))]
        return max(found)[1] if found else None


def _sampled(values: DataFrame) -> list[str]:
    """A bounded sample of distinct values, by hash."""
    return [r.value for r in values.distinct().orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every row of ``docs(doc_id, text)``.

    Offsets are code points of the whole text. Null and empty texts have no spans; a null doc_id stays null; repeated rows stay;
    other columns are ignored; an empty table gives an empty table; very long texts with very many matches take time in proportion to
    n log n. Spans are in order of start, then kind. Added spans never overlap base spans. A table that labels no values has the automata of
    well-known formats.
    """
    lean(docs)
    t = Tables()
    found = t.stored(candidate_secrets(docs), "secrets")
    base = found.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    labelled = {k: _sampled(base.where(F.col("kind") == k).select("value")) for k in KINDS}
    ordinary = _sampled(found.select(F.explode("words").alias("value")))
    detector = Detector(labelled, ordinary)

    def kinds_of(batches):
        kept: dict[str, str | None] = {}
        for b in batches:
            out = []
            for spans in b.column(2).to_pylist():
                row = []
                for s in spans or ():
                    v = s["value"]
                    if v not in kept:
                        if len(kept) > 100_000:
                            kept.clear()
                        kept[v] = detector(v)
                    if kept[v]:
                        row.append({"kind": kept[v], "start": s["start"], "end": s["end"]})
                out.append(row)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["doc_id", "base", "added"])

    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    scored = found.select("doc_id", F.transform("base", bare).alias("base"), "other").mapInArrow(kinds_of, f"doc_id long, base {spans}, added {spans}")
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    in_order = lambda c: F.transform(F.array_sort(F.transform(c, place)), bare)
    return t.result(scored.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.concat("base", "added")).alias("spans")), "secret-spans")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the report of ``find_secrets``."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def blanked(text: str, spans: list) -> str:
    """``text`` with each of the sorted spans, or what they cover together, as ``[secret]``."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], "[secret]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret span of its texts replaced by ``[secret]``.

    ``n_chars``, if there, follows the text. Rows without secrets are unchanged, null and empty texts included; so are rows
    without doc_id. Repeated rows are blanked alike; rows that share an id must share their text; other columns pass through.
    Blanking takes time in proportion to the text's length. An empty table gives an empty table.
    """
    mark, t = "_gridweave_spans", Tables()
    found = t.kept(find_secrets(docs))
    hit = found.where(F.size("spans") > 0).select("doc_id", F.col("spans").alias(mark)).dropDuplicates(["doc_id"])
    return rewritten(docs, hit, mark, blanked, t)
