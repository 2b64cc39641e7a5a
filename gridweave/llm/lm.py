"""Scoring of whole texts by a gated recurrent language model.

1. One pass counts every token of all training documents. Counts are grouped by token; those of the ``TABLE`` most frequent tokens go to the workers (a
   fixed bound), the others stay distributed.
2. The model predicts the class of the next token, then the token: the ``HEAD`` most frequent tokens are in
   classes of ``CLASS_WORDS`` with a softmax in each; all other tokens are in ``TAIL`` classes by their letters
   and last character, and share a class's probability by smoothed counts. It is trained by truncated
   backpropagation in numpy on every window of every training text, in shards whose number grows with the input; a text's
   state goes on from window to window. The shards' parameters are averaged after each round; each text is in one round.
3. A pass scores every whole text. Texts run in parallel lanes, window after window; a lane's state goes on from window
   to window until its text ends. Counts of rare tokens are joined by a shuffle.

Tokens are 63-bit hashes whose lowest four bits are the tail class.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from itertools import islice
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, lean, most_frequent, small_batches

#: Most frequent tokens (about so many) whose counts every worker has.
TABLE = 1 << 18
HEAD, CLASS_WORDS, TAIL, HIDDEN = 1024, 64, 16, 16
#: Tokens of a window of backpropagation and of one in scoring; lanes that texts run in, in training and in scoring.
STEPS, SCORE_STEPS, BATCH, LANES = 16, 32, 256, 512
ROUNDS, RATE = 3, 0.02
#: Training tokens of a shard (over all rounds), as long as there are no more than ``MOST_SHARDS``: beyond that shards grow, not their number.
#: Texts of more than ``LONG`` tokens train first.
SHARD_TOKENS, MOST_SHARDS, LONG = 4_000_000, 1024, 1024
#: Bounds of output weights and biases: with states in -1..1 no exponential of a logit leaves float32.
WEIGHT, BIAS = 3.0, 30.0
#: Tokens of texts that a scoring task holds at once (but always a whole text).
HOLD = 2_000_000
END = (1 << 62) | 3

_CLASSES = HEAD // CLASS_WORDS
#: Second bytes of accented letters, in three groups; by byte, the bit of its group; by the bits of a word, its lowest group.
_LETTERS = (b"\xa9\xa8\xaa\xa7\xa0\xb9\xae", b"\xb1\xad\xb3\xba\xa1", b"\xbc\xa4\xb6\x9f")
_BITS = np.array([sum(1 << k for k, letters in enumerate(_LETTERS) if c in letters) for c in range(256)], np.uint8)
_GROUP = np.array([0, 1, 2, 1, 3, 1, 2, 1])
#: By last byte: letter, comma, full stop, anything else.
_KIND = np.array([1 if c == 44 else 2 if c == 46 else 0 if bytes([c]).isalpha() or c >= 128 else 3 for c in range(256)])


def tail_classes(words: pa.Array) -> np.ndarray:
    """Class of each word (none empty) as a rare token: its accented letters and its last character."""
    if not len(words):
        return np.zeros(0, np.int64)
    cuts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    groups = _GROUP[np.bitwise_or.reduceat(_BITS[data[: cuts[-1]]], cuts[:-1])]
    return 4 * groups + _KIND[data[cuts[1:] - 1]]


def token_hashes(words: pa.Array) -> np.ndarray:
    """Hash of each word (bytes, none empty), with its tail class in the lowest four bits."""
    if not len(words):
        return np.zeros(0, np.int64)
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    said = pc.binary_join(whole, b" ")[0].as_py().split(b" ")  # far faster than a list of Arrow's values
    h = np.fromiter(map(xxhash.xxh64_intdigest, said), np.uint64, len(said))
    return ((h >> np.uint64(1)).view(np.int64) & ~15) | tail_classes(words)


def held_out(doc_id) -> bool:
    """Whether a document is kept from training."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens_of(texts: pa.Array, number: Callable[[pa.Array], np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of all ``texts`` (null: empty), ``end`` behind each text's words, and each text's number of tokens.

    Arrow splits, and tells words apart: ``number`` gets each different word of ``texts`` once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string()).fill_null("")))
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    words = lists.flatten().view(pa.binary())
    real = pc.binary_length(words).to_numpy() > 0  # white space on a text's edge and empty texts give empty words
    if not real.all():
        size = np.diff(np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(size)]])
        words = words.filter(pa.array(real))
    said = words.dictionary_encode()
    ends = np.cumsum(size + 1) - 1
    out, inner = np.empty(len(words) + len(size), np.int64), np.ones(len(words) + len(size), bool)
    inner[ends] = False
    out[inner] = number(said.dictionary)[said.indices.to_numpy()]
    out[ends] = end
    return out, size + 1


def _gathered(docs: DataFrame) -> DataFrame:
    """Rows (token, n) with counts of a part of the training texts."""
    out = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def counted(parts):
        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n)], schema=out)

    def run(batches):
        held, size = [], 0
        for b in small_batches(batches):
            training = pa.array([not held_out(doc) for doc in b.column("doc_id").to_pylist()], pa.bool_())
            t, _ = tokens_of(b.column("text").filter(training), token_hashes, END)
            if len(t):
                held.append(t)
                size += len(t)
            if size > 4_000_000:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return docs.select("doc_id", "text").mapInArrow(run, "token long, n long")


class Model:
    """Parameters and passes of the recurrent network."""

    NAMES = ("x", "u", "wc", "bc", "ww", "bw")

    def __init__(self, head_counts: np.ndarray, tail_totals: np.ndarray, seed: int = 5):
        """Starts at the unigram model: biases from counts, small random weights."""
        rng = np.random.RandomState(seed)
        h = HIDDEN
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        n = np.zeros(HEAD)
        n[: len(head_counts)] = head_counts
        words = n.reshape(_CLASSES, CLASS_WORDS) + 0.01
        mass = np.r_[words.sum(axis=1), tail_totals + 1.0]
        self.x, self.u = small(HEAD + TAIL, 3 * h), small(h, 3 * h)
        self.wc, self.bc = small(h, _CLASSES + TAIL), np.log(mass / mass.sum()).astype(np.float32)
        self.ww, self.bw = small(_CLASSES, h, CLASS_WORDS), np.log(words / words.sum(axis=1, keepdims=True)).astype(np.float32)

    def values(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def bounded(self) -> "Model":
        for weights, bias in ((self.wc, self.bc), (self.ww, self.bw)):
            np.clip(weights, -WEIGHT, WEIGHT, out=weights)
            np.clip(bias, -BIAS, BIAS, out=bias)
        return self

    def packed(self) -> bytes:
        return b"".join(v.astype("<f4").tobytes() for v in self.values())

    def unpack(self, flat: np.ndarray) -> "Model":
        at = 0
        for name in self.NAMES:
            v = getattr(self, name)
            setattr(self, name, flat[at : at + v.size].astype(np.float32).reshape(v.shape))
            at += v.size
        return self

    def run(self, state: np.ndarray, inputs: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step (steps, lanes, hidden) from ``state`` on; ``keep`` gets what backward needs."""
        h = HIDDEN
        out = np.empty((*inputs.shape, h), np.float32)
        given = self.x[inputs]
        for t in range(len(inputs)):
            x = given[t]
            hu = state @ self.u
            gates = x[:, : 2 * h] + hu[:, : 2 * h]  # the logistic function by tanh
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = r * hu[:, 2 * h :]
            new += x[:, 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, z, r, new, hu[:, 2 * h :]))
            state = state - new
            state *= z
            state += new
            out[t] = state
        return out

    def likelihood(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each target from each state (a target >= HEAD is a tail class).

        With ``grads`` it also adds the gradients of the mean negative log-likelihood and returns that of the states.
        """
        n = len(targets)
        cls = np.where(targets < HEAD, targets // CLASS_WORDS, targets - HEAD + _CLASSES)
        # no logit leaves the range of exp() in float32, as weights are bounded; sums are products with ones
        logits = states @ self.wc
        logits += self.bc
        at = np.arange(n)
        own = logits[at, cls]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        out = own - np.log(total)
        if grads is not None:
            logits /= total[:, None]
            logits[at, cls] -= 1
            logits /= n
            grads["wc"] += states.T @ logits
            grads["bc"] += logits.sum(axis=0)
            back = logits @ self.wc.T
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(_CLASSES + 1))
        for c in range(_CLASSES):
            a, b = cuts[c], cuts[c + 1]
            if a == b:
                continue
            rows = order[a:b]
            s = states[rows]
            inner = s @ self.ww[c]
            inner += self.bw[c]
            w = targets[rows] % CLASS_WORDS
            k = np.arange(b - a)
            own = inner[k, w]
            np.exp(inner, out=inner)
            total = inner @ np.ones(CLASS_WORDS, inner.dtype)
            out[rows] += own - np.log(total)
            if grads is not None:
                inner /= total[:, None]
                inner[k, w] -= 1
                inner /= n
                grads["ww"][c] += s.T @ inner
                grads["bw"][c] += inner.sum(axis=0)
                back[rows] += inner @ self.ww[c].T
        return out if grads is None else (out, back)

    def gradients(self, state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of one window, the state behind it and the mean log-likelihood; masked targets don't count."""
        h = HIDDEN
        grads = {n: np.zeros_like(v) for n, v in zip(self.NAMES, self.values(), strict=True)}
        keep: list = []
        states = self.run(state, inputs, keep)
        real = np.nonzero(mask.reshape(-1))[0]
        said, back = self.likelihood(states.reshape(-1, h)[real], targets.reshape(-1)[real], grads)
        outer = np.zeros((states.shape[0] * states.shape[1], h), np.float32)
        outer[real] = back
        outer = outer.reshape(states.shape)
        dx = np.empty((*inputs.shape, 3 * h), np.float32)
        du = np.empty((*inputs.shape, 3 * h), np.float32)
        dh = np.zeros_like(state)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, new, hun = keep[t]
            dh += outer[t]
            d, own = dx[t], du[t]
            rest = 1 - z
            dn = dh * rest
            dn *= 1 - new * new
            d[:, :h] = dh * (before - new) * z * rest
            d[:, h : 2 * h] = dn * hun * r * (1 - r)
            d[:, 2 * h :] = dn
            own[:, : 2 * h] = d[:, : 2 * h]
            own[:, 2 * h :] = dn * r
            dh *= z
            dh += own @ self.u.T
        earlier = np.concatenate((state[None], states[:-1])).reshape(-1, h)
        grads["u"] += earlier.T @ du.reshape(-1, 3 * h)
        flat = inputs.reshape(-1)
        order = np.argsort(flat, kind="stable")
        rows, first = np.unique(flat[order], return_index=True)
        grads["x"][rows] = np.add.reduceat(dx.reshape(-1, 3 * h)[order], first, axis=0)
        return grads, states[-1], float(said.mean()) if len(said) else 0.0


def train(model: Model, texts: Iterable[np.ndarray], rate: float, lanes: int = BATCH) -> tuple[Model, int]:
    """One pass of truncated backpropagation (Adam) over all windows of sequences of numbers, each with the token before it first.

    Sequences are taken from the stream as lanes fall free, so no more than one a lane is held. As in scoring, a lane's state goes on from
    window to window until its sequence ends.
    """
    moment = [np.zeros_like(v) for v in model.values()]
    square = [np.zeros_like(v) for v in model.values()]
    step, seen, coming = 0, 0, iter(texts)
    held: list[np.ndarray] = []
    at, state = np.zeros(0, np.int64), np.zeros((0, HIDDEN), np.float32)
    while True:
        live = np.array([at[k] + 1 < len(x) for k, x in enumerate(held)], bool)
        if not live.all():
            held = [x for x, on in zip(held, live, strict=True) if on]
            at, state = at[live], state[live]
        new = [x for x in islice(coming, lanes - len(held)) if len(x) > 1] if len(held) < lanes else []
        if new:
            held += new
            at, state = np.r_[at, np.zeros(len(new), np.int64)], np.concatenate((state, np.zeros((len(new), HIDDEN), np.float32)))
        if not held:
            return model, seen
        ids, mask = np.zeros((STEPS + 1, len(held)), np.int64), np.zeros((STEPS, len(held)), bool)
        for k, (x, a) in enumerate(zip(held, at.tolist(), strict=True)):
            piece = x[a : a + STEPS + 1]
            ids[: len(piece), k] = piece
            mask[: len(piece) - 1, k] = True
        at += STEPS
        grads, state, _ = model.gradients(state, ids[:-1], ids[1:], mask)  # the state goes on, the gradient does not
        state = state.copy()
        step += 1
        real = int(mask.sum())
        seen += real
        pace = rate * real / mask.size * len(held) / lanes  # few lanes left, as at the end of a stream, learn slowly: a token counts alike
        for v, m1, m2, name in zip(model.values(), moment, square, model.NAMES, strict=True):
            g = np.clip(grads[name], -1, 1)
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        model.bounded()


class Lexicon:
    """Numbers of the tokens in the table: their rank; for others minus one minus the hash."""

    def __init__(self, tokens: np.ndarray):
        self.rank = np.argsort(tokens)
        self.hashes = tokens[self.rank]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return -1 - hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], -1 - hashes)


def inputs_of(numbers: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Network numbers of tokens: the rank of head tokens, HEAD + tail class of others. ``tails``: classes by rank."""
    rank = np.maximum(numbers, 0)
    cls = np.where(numbers < 0, (-1 - numbers) & 15, tails[rank])
    return np.where((numbers >= 0) & (numbers < HEAD), numbers, HEAD + cls)


def score_texts(model: Model, texts: list[np.ndarray], first: int, lanes: int = LANES, steps: int = SCORE_STEPS) -> np.ndarray:
    """Natural log-probability of each text (network numbers, its end included), without the tail's counts."""
    total = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lanes = max(1, min(lanes, len(texts)))
    doc = np.full(lanes, -1)
    at = np.zeros(lanes, np.int64)
    state = np.zeros((lanes, HIDDEN), np.float32)
    last = np.zeros(lanes, np.int64)
    ahead = 0
    while True:
        for k in range(lanes):
            if (doc[k] < 0 or at[k] >= len(texts[doc[k]])) and ahead < len(order):
                doc[k], at[k], state[k], last[k] = order[ahead], 0, 0, first
                ahead += 1
        live = np.array([d >= 0 and at[k] < len(texts[d]) for k, d in enumerate(doc)])
        if not live.any():
            return total
        if not live.all():
            doc, at, state, last = doc[live], at[live], state[live], last[live]
            lanes = len(doc)
        targets = np.full((steps, lanes), -1, np.int64)
        for k in range(lanes):
            piece = texts[doc[k]][at[k] : at[k] + steps]
            targets[: len(piece), k] = piece
        at += steps
        inputs = np.concatenate((last[None, :], np.maximum(targets[:-1], 0)))
        states = model.run(state, inputs)
        state, last = states[-1].copy(), np.maximum(targets[-1], 0)
        real = np.nonzero(targets.reshape(-1) >= 0)[0]
        said = model.likelihood(states.reshape(-1, HIDDEN)[real], targets.reshape(-1)[real])
        total += np.bincount(np.tile(doc, steps)[real], said, minlength=len(texts))


def _numbered(docs: DataFrame, tokens: np.ndarray, logs: np.ndarray, tails: np.ndarray, tail_logs: np.ndarray) -> DataFrame:
    """One row a text: its network numbers, its counts and base score as far as the table goes, and the hashes of its rare tokens.

    ``ids`` has the end's number first, then the tokens with the end. ``round`` is null for texts that are kept from training.
    """
    given = docs.sparkSession.sparkContext.broadcast((tokens, logs, tails, tail_logs))
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("round", pa.int32()), ("long", pa.bool_()), ("ids", pa.binary()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base", pa.float64()), ("in_tail", pa.float64()), ("rare", pa.list_(pa.int64())),
    ])

    def run(batches):
        table, log, classes, tail_logs_of = given.value
        classes = classes if len(classes) else np.zeros(1, np.int64)
        log = log if len(log) else np.zeros(1)
        lexicon = Lexicon(table)
        (end,) = lexicon.of(np.array([END])).tolist()
        for b in small_batches(batches, 128):
            docs_in = b.column("doc_id").to_pylist()
            if not docs_in:
                continue
            n, size = tokens_of(b.column("text"), lambda words: lexicon.of(token_hashes(words)), end)
            first = np.r_[0, np.cumsum(size)[:-1]]
            ids = inputs_of(n, classes)
            known, tail = n >= 0, ids >= HEAD
            own = np.where(known, log[np.maximum(n, 0)], 0.0)
            in_tail = np.where(tail, np.where(known, own, 0.0) - tail_logs_of[np.maximum(ids - HEAD, 0)], 0.0)
            held = np.concatenate([x for a, z in zip(first.tolist(), (first + size).tolist(), strict=True) for x in (ids[z - 1 : z], ids[a:z])]).astype("<i2").tobytes()
            ends = np.cumsum(size + 1) * 2
            rare = np.add.reduceat((~known).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs_in, pa.int64()),
                    pa.array([None if held_out(d) else zlib.crc32(f"{d}:round".encode()) % ROUNDS for d in docs_in], pa.int32()),
                    pa.array(size > LONG),
                    pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(held)]),
                    pa.array(size),
                    pa.array(np.add.reduceat(known.astype(np.int64), first)),
                    pa.array(np.add.reduceat(own, first)),
                    pa.array(np.add.reduceat(in_tail, first)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare)].astype(np.int32)), pa.array(-1 - n[~known])),
                ],
                schema=kinds,
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, round int, long boolean, ids binary, n_tokens long, n_known long, base double, in_tail double, rare array<long>"
    )


def _trained(texts: DataFrame, total: int, model: Model, t: Tables) -> tuple[Model, int]:
    """Rounds of training on shards of all ``total`` training tokens, and the tokens seen; each text is used in one round."""
    shards = min(MOST_SHARDS, -(-total // SHARD_TOKENS))
    seen = 0
    for number in range(ROUNDS if total else 0):
        now, rate = model, RATE * (1 - number / (ROUNDS + 1))

        def shard(batches, now=now, rate=rate):
            got, weight = train(now, (np.frombuffer(x.as_buffer(), "<i2") for b in batches for x in b.column("ids")), rate)
            if weight:
                yield pa.RecordBatch.from_pydict({"weight": pa.array([weight], pa.int64()), "model": pa.array([got.packed()], pa.binary())})

        def summed(batches):
            flat, weight = None, 0
            for b in batches:
                for w, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    part = np.frombuffer(m.as_buffer(), "<f4").astype(np.float64) * w
                    flat, weight = part if flat is None else flat + part, weight + w
            if flat is not None:
                yield pa.RecordBatch.from_pydict({"weight": pa.array([weight], pa.int64()), "model": pa.array([flat.tobytes()], pa.binary())})

        own = texts.where(f"round = {number}").select("ids", "long").repartition(shards).sortWithinPartitions(F.desc("long"), F.xxhash64("ids"))
        models = t.stored(own.mapInArrow(shard, "weight long, model binary"), "models")
        parts = models.coalesce(16).mapInArrow(summed, "weight long, model binary").collect()
        weight = sum(r.weight for r in parts)
        if weight:
            model.unpack(sum(np.frombuffer(bytes(r.model), np.float64) for r in parts) / weight)
        seen += weight
        t.drop(models)
    return model, seen


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs(doc_id, text)``.

    Null and empty texts are one end token; a null doc_id is split as the empty string is. Repeated rows stay, each scored and counted; very long
    texts are scored whole, window by window; other columns are ignored; an empty table gives an empty
    table. Without training documents all counts are zero and the model is uniform over its classes. Tokens are told apart by 59 bits
    of hash, so counts are exact but for tokens that collide.
    """
    lean(docs)
    spark = docs.sparkSession
    t = Tables()
    got = t.stored(_gathered(docs), "gathered")
    counts = t.stored(got.groupBy("token").agg(F.sum("n").alias("c")), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, c = most_frequent(counts, "token", "c", TABLE)
    tails = tokens & 15
    # tail classes: all tokens that are not head tokens
    per_class = counts.groupBy(F.col("token").bitwiseAND(15).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for r in per_class:
        tail_n[r.k], tail_v[r.k] = r.n, r.v
    tail_n -= np.bincount(tails[:HEAD], c[:HEAD], TAIL)
    tail_v -= np.bincount(tails[:HEAD], minlength=TAIL)
    t.drop(got)
    texts = _numbered(docs, tokens, np.log10(c + 1.0), tails, np.log10(tail_n + tail_v + 1)).withColumn("row", F.monotonically_increasing_id())
    texts = t.stored(texts, "numbered")
    model, _ = _trained(texts, sums.n, Model(c[:HEAD], tail_n), t)
    given = spark.sparkContext.broadcast(model)
    out = pa.schema([("row", pa.int64()), ("net", pa.float64())])

    def run(batches):
        rows, held, size = [], [], 0

        def done():
            said = score_texts(given.value, [x[1:] for x in held], int(held[0][0])) / np.log(10)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(said, pa.float64())], schema=out)

        for b in batches:
            for row, ids in zip(b.column("row").to_pylist(), b.column("ids"), strict=True):
                rows.append(row)
                held.append(np.frombuffer(ids.as_buffer(), "<i2").copy())
                size += len(held[-1])
                if size > HOLD:
                    yield done()
                    rows, held, size = [], [], 0
        if rows:
            yield done()

    net = t.stored(texts.select("row", "ids").mapInArrow(run, "row long, net double"), "net")
    rare = texts.select("row", F.explode("rare").alias("token")).join(counts, "token").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1.0)).alias("s"))
    every = log10(sums.n + sums.v + 1)
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = texts.drop("ids", "rare").join(net, "row").join(rare, "row", "left").select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"),
        "n_tokens",
        plus("n_known", "n").alias("n_known"),
        F.lit(sums.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * every).alias("base_score"),
        (F.col("in_tail") + F.col("net") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
    return t.result(out, "scores")
