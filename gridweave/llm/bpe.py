"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton over tokens starts with one state that loops on every base symbol. The merge rules are applied to
it in order; the gadget for a rule ``u v -> t`` makes, behind every arc ``u`` whose target has an
arc ``v``, a copy of that target without the arc ``v``, and adds an arc ``t`` past both. A state therefore
is decided by the last token, and the arcs it lacks are those that some gadget removed, directly
or because the arc that a later arc is made of was gone. States are kept as what their gadget changed: the state they were copied
from and the arcs removed since, one entry for each rule. The paths of this automaton are
exactly the token sequences that BPE gives, and every word is spelled by exactly one of them.

For encoding it is determinised over symbols. A state of the symbol automaton has the arcs that are under way, each as its place
in the tree of token spellings and the state that it left, and the label of the arc that ends here. As every beginning of a word
is spelled by one path too, one arc at most ends anywhere. States and their transitions are tabulated when a word first
needs them (all of them would be too many), and a word is encoded by one table look-up a symbol; the labels passed give its tokens from the end on.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from gridweave.llm.common import lean, small_batches

#: Words and compared arcs that a worker keeps, and states of the symbol automaton before the table is begun anew.
CACHE, STATES = 400_000, 100_000

# Pre-split pattern of the vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Mark of a word's last token in the file, and the one symbol that stands for it in spelled words.
END, END_SYMBOL = "</w>", "\ue000"
#: Characters that normalisation leaves alone but for case, in all Unicode versions.
PLAIN = regex.compile(r"[\x09-\x0d\x20-\x7e¡-įı-ſ]*+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in prints:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Automaton:
    """States, arcs and labels compiled from a vocabulary and its ordered merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], states: int = STATES):
        self.labels = {i: t for t, i in vocab.items()}
        n = max(vocab.values(), default=-1) + 1
        #: what the gadgets removed from the state behind a token: {token: step}
        self.removed: list[dict[int, int]] = [{} for _ in range(n)]
        #: the state it was copied from and the step of the copy; left part and step of a merged token
        self.copied: list[tuple[int, int] | None] = [None] * n
        self.left: list[tuple[int, int] | None] = [None] * n
        self.arcs: dict[int, bool] = {}
        self.width = n
        for step, (u, v) in enumerate(merges):
            self.gadget(vocab[u], vocab[v], vocab[u + v], step)
        #: tree of spellings: {node << 16 | symbol: node}, the token that ends at a node, nodes with children
        self.tree: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: set[int] = set()
        self.size = [0] * n
        for t, i in vocab.items():
            self.add(t[: -len(END)] + END_SYMBOL if t.endswith(END) else t, i)
        self.most = states
        self.clear()

    def add(self, symbols: str, token: int) -> None:
        node = 0
        for c in symbols:
            key = node << 16 | ord(c)
            self.inner.add(node)
            node = self.tree.setdefault(key, len(self.token))
            if node == len(self.token):
                self.token.append(-1)
        self.token[node], self.size[token] = token, len(symbols)

    def clear(self) -> None:
        """Begins the table anew with the start state."""
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.open: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.number = {(-1, self.open[0]): 0}

    def gadget(self, u: int, v: int, t: int, step: int) -> None:
        """Applies the merge gadget of rule ``u v -> t``."""
        self.removed[u].setdefault(v, step)
        if self.left[t] is None:
            self.copied[t] = (v, step)
            self.left[t] = (u, step)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state behind token ``state`` has an arc ``token``; kept in the transition table."""
        key = state * self.width + token
        known = self.arcs.get(key)
        if known is None:
            known = self._has_arc(state, token)
            if len(self.arcs) < 2 * CACHE:
                self.arcs[key] = known
        return known

    def _has_arc(self, state: int, token: int) -> bool:
        before = None  # only removals before the copy are inherited
        while True:
            gone = self.removed[state]
            part, until = token, None
            while True:
                step = gone.get(part)
                if step is not None and (before is None or step < before) and (until is None or step <= until):
                    return False
                up = self.left[part]
                if up is None:
                    break
                part, until = up
            up = self.copied[state]
            if up is None:
                return True
            state, before = up

    def move(self, state: int, symbol: str) -> int:
        """The transition of ``state`` under ``symbol``, made and tabulated."""
        going, ended, code = [], -1, ord(symbol)
        tree, tokens, inner = self.tree, self.token, self.inner
        for node, last in self.open[state]:
            to = tree.get(node << 16 | code)
            if to is None:
                continue
            token = tokens[to]
            if token >= 0 and ended < 0 and (last < 0 or self.has_arc(last, token)):  # one arc ends here at most, mostly the longest
                ended = token
            if to in inner:
                going.append((to, last))
        if ended >= 0:
            going.append((0, ended))  # what follows leaves the state behind the token
        if not going and ended < 0:
            raise ValueError("no path spells the word")
        key = (ended, tuple(going))
        new = self.number.setdefault(key, len(self.moves))
        if new == len(self.moves):
            self.moves.append({})
            self.ends.append(ended)
            self.open.append(key[1])
        self.moves[state][symbol] = new
        return new

    def spell(self, symbols: str) -> list[int]:
        """Ids on the one path that spells ``symbols`` (a word's byte symbols and its end mark)."""
        if len(self.moves) > self.most:
            self.clear()
        moves, state, passed = self.moves, 0, []
        for c in symbols:
            to = moves[state].get(c)
            state = self.move(state, c) if to is None else to
            passed.append(state)
        at, ids, ends = len(symbols), [], self.ends
        while at:
            token = ends[passed[at - 1]]
            if token < 0:
                raise ValueError("no path spells the word")
            ids.append(token)
            at -= self.size[token]
        return ids[::-1]


class Kept(dict):
    """word -> (number of ids, the ids in decimal, the decoded text); bounded, so that what is kept never changes a value."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, str, str]:
        got = self.codec.ids(word)
        value = (len(got), " ".join(map(str, got)), self.codec.decode(got))
        if len(self) < CACHE:  # common words come early
            self[word] = value
        return value


class Codec:
    """Encodes and decodes texts like the library does with this vocabulary file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        spec = json.load(open(file, encoding="utf-8"))
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.automaton = Automaton(spec["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.find = regex.compile(SPLIT).findall
        self.library = Tokenizer.from_file(file)
        self.symbols = byte_symbols()
        self.kept = Kept(self)

    def words(self, text: str) -> list[str]:
        """Normalised, pre-split words. Unusual characters are normalised and split by the library's own steps."""
        if PLAIN.fullmatch(text):
            return self.find(text.lower())
        got = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [self.back(w) for w, _ in got]

    def back(self, symbols: str) -> str:
        table = self.__dict__.setdefault("bytes_of", {s: b for b, s in enumerate(self.symbols)})
        return bytes(table[s] for s in symbols).decode("utf-8", "surrogateescape")

    def ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogateescape")
        return self.automaton.spell("".join([self.symbols[b] for b in raw]) + END_SYMBOL)

    def segments(self, text: str) -> list[str]:
        return self.at_special.split(text) if self.special else [text]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.segments(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in self.words(part):
                    out += self.ids(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, parted by single spaces: this vocabulary file names no decoder."""
        return " ".join([self.labels[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, the ids in decimal, the decoded text), word by word from what is kept."""
        kept, n, ids, labels = self.kept, 0, [], []
        for part in self.segments(text):
            if part in self.special:
                n += 1
                ids.append(str(self.special[part]))
                labels.append(part)
                continue
            got = list(map(kept.__getitem__, self.words(part)))
            n += sum(map(itemgetter(0), got))
            ids += map(itemgetter(1), got)
            labels += map(itemgetter(2), got)
        return n, " ".join(ids), " ".join(labels)


@lru_cache(maxsize=1)
def codec_of(file: str) -> Codec:
    """A worker's codec, kept with its tables for the next task."""
    return Codec(file)


def encode_documents(docs: DataFrame, file: str) -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded`` to ``docs(text, ...)``; null text counts as empty
    and gives no ids and empty decoded text. Columns called so before are replaced."""
    lean(docs)
    docs = docs.drop("ids", "decoded")
    schema = StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())

    def run(batches):
        codec = codec_of(file)
        for b in small_batches(batches):
            ids = [codec.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())],
                names=[*b.schema.names, "ids", "decoded"],
            )

    return docs.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs(doc_id, text)``.

    Null and empty texts have no tokens and the digests of the empty string. Repeated rows and null ids stay; very long texts and words are
    encoded whole, in time in proportion to their length; other columns are ignored; an empty table gives an empty table.
    """
    lean(docs)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        codec = codec_of(file)
        for b in small_batches(batches):
            rows = [codec.digest(t or "") for t in b.column("text").to_pylist()]
            hexed = lambda k: pa.array([hashlib.sha256(r[k].encode("utf-8", "surrogateescape")).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), hexed(1), hexed(2)], schema=kinds
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
