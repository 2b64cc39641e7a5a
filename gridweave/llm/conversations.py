"""Repair of conversations by cheapest edits: Dial's bucket queue, then the least audit along tight arcs.

A conversation's rows are the columns of a small graph: at each row the repaired conversation so far is empty, ends with a system turn, with a
user's or with an assistant's. Edits are arcs whose costs are 0 to 3, so distances to the end are found with a queue of few buckets, for all
conversations of a batch at once; from the start, arcs on which the distance falls by exactly their cost are followed, the smallest letter first.

Rows are sorted by conversation and turn across all partitions, so no conversation, however long, has to fit into one task. One that lies within a
partition and is short is solved where it is. Others are cut into segments: each gives the 4 x 4 distances between its ends, which are summed up
backwards, one small row a segment; then each segment is solved for its own distances and each way of entering it, and a last pass in order chooses.
Only that pass, which feeds the repaired text to one hash, is sequential.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Tables, joined_on, lean

BLANKS = " \t\n\x0b\x0c\r"
#: Faults of a row.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States of the repaired conversation, and the one after a turn of user or assistant, whichever may follow.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = np.array([USER, USER, ASSISTANT, USER])
#: Initials of roles as numbers; all others are 3. KEPT[initial, state] is the state after keeping such a row, -1 where it may not be kept.
INITIAL = {"s": 0, "u": 1, "a": 2}
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4])
LEGAL = {(0, 1), (1, 2), (2, 1)}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Distances to the end behind the last row, and the edits made there.
GOAL, TAIL = np.array([0, 4, 2, 0]), (b"", b"II", b"I", b"")
FAR = 1 << 40
#: Rows and characters of a segment; conversations of up to so many rows are solved together.
SEGMENT_ROWS, SEGMENT_CHARS, ROWS_AT_ONCE = 512, 1 << 21, 8192


class Segments:
    """Rows of several segments end to end: ``initial`` and ``fault`` of each row, ``sizes`` of the segments.

    Each segment has one layer of four nodes before each of its rows and one behind the last.
    """

    def __init__(self, initial: np.ndarray, fault: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        self.first = np.r_[0, np.cumsum(sizes + 1)][:n]
        self.last = self.first + sizes
        layers = int((sizes + 1).sum())
        self.end, self.start = np.zeros(layers, bool), np.zeros(layers, bool)
        self.end[self.last] = True
        self.start[self.first] = True
        self.initial, self.must, self.cut = np.full(layers, 3), np.ones(layers, bool), np.zeros(layers, np.int64)
        self.initial[~self.end] = initial
        self.must[~self.end] = (fault == BLANK) | (fault == DUPLICATE)
        self.cut[~self.end] = np.where(fault == TRUNCATED, CUT, 0)

    def distances(self, goals: np.ndarray) -> np.ndarray:
        """Distance of each node (layers x 4) to its segment's end, where the distances (segments x 4) are ``goals``."""
        base = goals.min(axis=1, initial=FAR)
        goals = np.where(goals < FAR, goals - base[:, None], FAR)
        dist = np.full(len(self.end) * 4, FAR)
        ends = (self.last[:, None] * 4 + np.arange(4)).reshape(-1)
        near = goals.reshape(-1) < FAR
        dist[ends[near]] = goals.reshape(-1)[near]
        ring = max(DELETE, REROLE + CUT, int(goals[goals < FAR].max(initial=0))) + 1
        buckets: list[list[np.ndarray]] = [[] for _ in range(ring)]
        for c in range(ring):
            buckets[c].append(ends[near & (goals.reshape(-1) == c)])
        done = np.zeros(len(dist), bool)
        waiting, at = int(near.sum()), 0

        def reach(nodes: np.ndarray, cost: np.ndarray | int) -> int:
            """Takes ``nodes`` into their buckets where they come nearer."""
            new = at + cost
            better = dist[nodes] > new
            nodes, new = nodes[better], np.broadcast_to(new, better.shape)[better]
            dist[nodes] = new
            for c in range(ring):
                if len(part := nodes[new == at + c]):
                    buckets[(at + c) % ring].append(part)
            return len(nodes)

        while waiting:
            while held := buckets[at % ring]:
                buckets[at % ring] = []
                nodes = np.concatenate(held)
                waiting -= len(nodes)
                nodes = nodes[(dist[nodes] == at) & ~done[nodes]]
                done[nodes] = True
                waiting += self._arcs(nodes, reach)
            at += 1
        out = dist.reshape(-1, 4)
        return np.where(out < FAR, out + np.repeat(base, self.last - self.first + 1)[:, None], FAR)

    def _arcs(self, nodes: np.ndarray, reach) -> int:
        """Relaxes the arcs into ``nodes``."""
        layer, state = nodes >> 2, nodes & 3
        inner = ~self.end[layer]
        n = 0
        for s, sources in ((USER, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            here = layer[inner & (state == s)] * 4
            if len(here):
                n += sum(reach(here + p, INSERT) for p in sources)
        behind = ~self.start[layer]
        layer, state = layer[behind] - 1, state[behind]
        n += reach(layer * 4 + state, DELETE)
        free = ~self.must[layer]
        layer, state = layer[free], state[free]
        for s, own, sources in ((SYSTEM, 0, (EMPTY,)), (USER, 1, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, 2, (USER,))):
            here = layer[state == s]
            if s == SYSTEM:  # there is no changing a role to system
                here = here[self.initial[here] == own]
            if len(here):
                cost = self.cut[here] + np.where(self.initial[here] == own, 0, REROLE)
                n += sum(reach(here * 4 + p, cost) for p in sources)
        return n

    def walks(self, dist: np.ndarray, entry: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The least audit of each segment from its ``entry`` state on, and the state at its end."""
        layer, state, way = self.first.copy(), np.array(entry), np.arange(len(self.first))
        out_state = np.array(entry)
        said: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            over = self.end[layer]
            out_state[way[over]] = state[over]
            layer, state, way = layer[~over], state[~over], way[~over]
            if not len(way):
                break
            here, follows = dist[layer, state], FOLLOWS[state]
            kept = KEPT[self.initial[layer], state]
            cut = self.cut[layer]
            gone = dist[layer + 1, state] + DELETE == here
            put = ~gone & (dist[layer, follows] + INSERT == here)
            keep = ~gone & ~put & (kept >= 0) & ~self.must[layer] & (dist[layer + 1, kept] + cut == here)
            said.append((way, np.where(gone, ord("D"), np.where(put, ord("I"), np.where(keep, ord("K"), ord("R"))))))
            state = np.where(gone, state, np.where(keep, kept, follows))
            layer = layer + ~put
        if not said:
            return [b""] * len(self.first), out_state
        ways, letters = (np.concatenate(x) for x in zip(*said, strict=True))
        order = np.argsort(ways, kind="stable")
        ends = np.cumsum(np.bincount(ways, minlength=len(self.first)))
        flat = letters[order].astype(np.uint8).tobytes()
        return [flat[a:z] for a, z in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)], out_state


def faults(rows: list[tuple[str, str]], seen: set) -> np.ndarray:
    """Each row's first fault: blank, role and text ``seen`` before, or an end without a closing mark."""
    out = np.zeros(len(rows), np.int8)
    for k, row in enumerate(rows):
        text = row[1].rstrip(BLANKS)
        if not text:
            out[k] = BLANK
        elif row in seen:
            out[k] = DUPLICATE
        elif text[-1] not in ".!?":
            out[k] = TRUNCATED
        seen.add(row)
    return out


def initials(rows: list[tuple[str, str]]) -> np.ndarray:
    return np.fromiter((INITIAL.get(role[:1], 3) for role, _ in rows), np.int8, len(rows))


def illegal_pairs(initial: np.ndarray, before: int | None = None) -> int:
    """Neighbours whose initials may not follow each other; ``before`` is the one before the first."""
    line = initial.tolist() if before is None else [before, *initial.tolist()]
    return sum(p not in LEGAL for p in zip(line, line[1:], strict=False))


def repaired(rows: list[tuple[str, str]], audit: bytes, state: int) -> list[str]:
    """'role:text' of what is left of ``rows`` and of what ``audit`` inserts, from ``state`` on."""
    out, k = [], 0
    for c in audit:
        if c == 75:  # K
            role, text = rows[k]
            state = KEPT[INITIAL[role[:1]], state]
            out.append(f"{role}:{text}")
        elif c != 68:  # not D
            state = FOLLOWS[state]
            out.append(("user:" if state == USER else "assistant:") + (rows[k][1] if c == 82 else ""))
        k += c != 73
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
OPEN = "part int, seq long, low long, high long, turns long, roles array<string>, texts array<string>, initial binary, fault binary, digests array<binary>"


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)


def _solved(held: list[tuple]) -> list[tuple]:
    """Result rows of whole conversations (id, low, high, turns, rows)."""
    found = [faults(rows, set()) for *_, rows in held]
    first = [initials(rows) for *_, rows in held]
    graph = Segments(np.concatenate(first), np.concatenate(found), np.array([len(x) for x in found]))
    dist = graph.distances(np.tile(GOAL, (len(held), 1)))
    audits, states = graph.walks(dist, np.full(len(held), EMPTY))
    out = []
    for k, (i, low, high, turns, rows) in enumerate(held):
        audit = audits[k] + TAIL[states[k]]
        text = "\n".join(repaired(rows, audit, EMPTY)).encode()
        n = np.bincount(found[k], minlength=4).tolist()
        cost = int(dist[graph.first[k], EMPTY])
        out.append((i, _gaps(low, high, turns), n[BLANK], n[DUPLICATE], n[TRUNCATED], illegal_pairs(first[k]), cost, audit.decode(), hashlib.sha256(text).hexdigest()))
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 to 2) of ``rows`` after the damage that crc32 of 'conv_id:turn' says; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    role, text = space("role"), space("text")
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"), role.alias("role"), text.alias("text")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") != 0, F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (1) of ``rows`` as they are; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.lit(1).alias("copies"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation, turn, role and a hash of the text, over all partitions. The number of a row, last, deals equal rows out."""
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("deal", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie", "deal")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "copies")


def _first_pass(rows: DataFrame, t: Tables, segment_rows: int) -> DataFrame:
    """Whole conversations solved (part is null) and segments of the others."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        done: list[tuple] = []
        whole: list[tuple] = []
        waiting = 0
        nobody = object()
        now, first, begun = nobody, True, False
        held: list[tuple[str, str]] = []
        size, low, high, turns = 0, None, None, 0
        id_type = None

        def out():
            nonlocal done
            lists = list(zip(*done, strict=True)) or [()] * 19
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            done = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(lists, types, strict=True)], names=names)

        def cut():
            """The rows held become a segment."""
            nonlocal held, size, low, high, turns, seq, begun
            said = repr(now).encode()
            digests = [xxhash.xxh3_128_digest(b"%d:%s%d:%s%s" % (len(said), said, len(r.encode()), r.encode(), x.encode())) for r, x in held]
            fault = faults(held, set())
            roles, texts = [r for r, _ in held], [x for _, x in held]
            done.append((now, *[None] * 8, part, seq, low, high, turns, roles, texts, initials(held).tobytes(), fault.tobytes(), digests))
            held, size, low, high, turns, begun = [], 0, None, None, 0, True
            seq += 1

        def close(last: bool):
            """The conversation at hand has ended, in this partition at least."""
            nonlocal held, size, low, high, turns, waiting, first, begun
            if first or last or begun:
                cut()
            else:
                whole.append((now, low, high, turns, held))
                waiting += len(held) + 1
                held, size, low, high, turns = [], 0, None, None, 0
            first, begun = False, False

        def solve():
            nonlocal whole, waiting
            if whole:
                done.extend((*r, *[None] * 10) for r in _solved(whole))
                whole, waiting = [], 0

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for i, turn, role, text, copies in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")), strict=True):
                if i != now:
                    if now is not nobody:
                        close(False)
                        if waiting >= ROWS_AT_ONCE:
                            solve()
                            yield out()
                    now = i
                for _ in range(copies):
                    if len(held) >= segment_rows or size > SEGMENT_CHARS:
                        cut()
                        yield out()
                    held.append((role, text))
                    size += len(text)
                    if turn is not None and turn != high:
                        low, high, turns = turn if low is None else low, turn, turns + 1
        if now is not nobody:
            close(True)
            solve()
            yield out()

    schema = f"conv_id {kind}, {RESULT}, {OPEN}"
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256", "part", "seq", "low", "high", "turns", "roles", "texts", "initial", "fault", "digests"]
    return t.stored(_in_order(rows).mapInArrow(run, schema), "conversations")


def _faults_across(open_: DataFrame, t: Tables) -> DataFrame:
    """The segments, with rows that an earlier segment of their conversation holds marked as duplicates."""
    place = F.struct("part", "seq")
    rows = open_.select("part", "seq", F.explode(F.array_distinct("digests")).alias("digest"))
    again = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = joined_on(rows, t.stored(again, "repeated-turns"), "digest", "n", t).where(place > F.col("first"))
    late = late.groupBy("part", "seq").agg(F.collect_list("digest").alias("late"))
    joined = open_.join(late, ["part", "seq"], "left")

    def run(batches):
        for b in batches:
            fault = []
            for raw, digests, late in zip(*(b.column(c).to_pylist() for c in ("fault", "digests", "late")), strict=True):
                if late:
                    gone = set(late)
                    raw = bytes(DUPLICATE if x != BLANK and d in gone else x for x, d in zip(raw, digests, strict=True))
                fault.append(raw)
            columns = {n: b.column(n) for n in b.schema.names if n not in ("digests", "late")}
            yield pa.RecordBatch.from_pydict(columns | {"fault": pa.array(fault, pa.binary())})

    names = [c for c in joined.columns if c not in ("digests", "late")]
    return t.stored(joined.mapInArrow(run, joined.select(*names).schema), "segments")


def _graph(b: pa.RecordBatch, times: int = 1) -> Segments:
    """The graph of a batch of segments, each ``times`` over."""
    fault, initial = b.column("fault").to_pylist() * times, b.column("initial").to_pylist() * times
    sizes = np.array([len(x) for x in fault], np.int64)
    return Segments(np.frombuffer(b"".join(initial), np.int8), np.frombuffer(b"".join(fault), np.int8), sizes)


def _slices(batches, rows: int = 64):
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _walked(segments: DataFrame, t: Tables) -> DataFrame:
    """part, seq and, for each state a segment may be entered in: cost to the conversation's end, audit, and the state at its end."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def between(batches):
        for b in _slices(batches):
            n = b.num_rows
            graph = _graph(b, 4)
            ways = graph.distances(np.repeat(np.where(np.eye(4, dtype=bool), 0, FAR), n, axis=0))[graph.first]
            ways = ways.reshape(4, n, 4).transpose(1, 2, 0).reshape(n, 16)  # entered, left
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names} | {"ways": pa.array(ways.tolist(), pa.list_(pa.int64()))})

    def backwards(batches):
        now, behind = object(), GOAL
        for b in batches:
            found = []
            for i, ways in zip(b.column("conv_id").to_pylist(), b.column("ways").to_pylist(), strict=True):
                if i != now:
                    now, behind = i, GOAL
                found.append(behind.tolist())
                behind = (np.array(ways).reshape(4, 4) + behind).min(axis=1)
            columns = {c: b.column(c) for c in ("part", "seq", "initial", "fault")}
            yield pa.RecordBatch.from_pydict(columns | {"behind": pa.array(found, pa.list_(pa.int64()))})

    def walk(batches):
        for b in _slices(batches):
            graph = _graph(b)
            dist = graph.distances(np.array(b.column("behind").to_pylist()))
            audits, states = zip(*(graph.walks(dist, np.full(b.num_rows, s)) for s in range(4)), strict=True)
            yield pa.RecordBatch.from_pydict({
                "part": b.column("part"), "seq": b.column("seq"), "costs": pa.array(dist[graph.first].tolist(), pa.list_(pa.int64())),
                "audits": pa.array([list(x) for x in zip(*audits, strict=True)], pa.list_(pa.binary())),
                "states": pa.array(np.stack(states, axis=1).tolist(), pa.list_(pa.int32())),
            })

    small = segments.select("conv_id", "part", "seq", "initial", "fault")
    ways = small.mapInArrow(between, f"conv_id {kind}, part int, seq long, initial binary, fault binary, ways array<long>")
    ways = ways.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    behind = t.stored(ways.mapInArrow(backwards, "part int, seq long, initial binary, fault binary, behind array<long>"), "behind")
    return t.stored(behind.mapInArrow(walk, "part int, seq long, costs array<long>, audits array<binary>, states array<int>"), "walks")


def _last_pass(segments: DataFrame, walked: DataFrame) -> DataFrame:
    """Result rows of the conversations in segments: a walk in order that only chooses and hashes."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = segments.join(walked, ["part", "seq"])
    rows = rows.select("conv_id", "part", "seq", "low", "high", "turns", "roles", "texts", "initial", "fault", "costs", "audits", "states")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches):
        now, begun, id_type = None, False, None
        done: list[tuple] = []

        def begin():
            nonlocal state, digest, some, counts, low, high, turns, last, cost, audit
            state, digest, some, counts, low, high, turns, last, cost, audit = EMPTY, hashlib.sha256(), False, np.zeros(5, np.int64), None, None, 0, None, 0, []

        def add(lines: list[str]):
            nonlocal some
            if lines:
                digest.update((("\n" if some else "") + "\n".join(lines)).encode())
                some = True

        def end():
            tail = TAIL[state]
            add(repaired([], tail, state))
            n = counts.tolist()
            done.append((now, _gaps(low, high, turns), n[BLANK], n[DUPLICATE], n[TRUNCATED], n[4], cost, b"".join([*audit, tail]).decode(), digest.hexdigest()))

        state = digest = some = counts = low = high = turns = last = cost = audit = None
        begin()

        def out():
            nonlocal done
            lists = list(zip(*done, strict=True)) or [()] * 9
            done = []
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(lists, types, strict=True)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for b in _slices(batches, 16):
            id_type = b.schema.field("conv_id").type
            for r in b.to_pylist():
                if not begun or r["conv_id"] != now:
                    if begun:
                        end()
                    now, begun = r["conv_id"], True
                    begin()
                    cost = r["costs"][EMPTY]
                initial = np.frombuffer(r["initial"], np.int8)
                counts[:4] += np.bincount(np.frombuffer(r["fault"], np.int8), minlength=4)
                counts[4] += illegal_pairs(initial, last)
                last = int(initial[-1]) if len(initial) else last
                if r["low"] is not None:
                    turns += r["turns"] - (r["low"] == high)
                    low, high = r["low"] if low is None else low, r["high"]
                add(repaired(list(zip(r["roles"], r["texts"], strict=True)), r["audits"][state], state))
                audit.append(r["audits"][state])
                state = r["states"][state]
            if done:
                yield out()
        if begun:
            end()
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, {RESULT}")


def repair_conversations(conversations: DataFrame, prepare=undamaged, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of ``conversations(conv_id, turn, role, text)``.

    ``prepare`` gives the rows to repair and how often each counts (``damaged`` for the query). Rows are taken by turn, nulls first; of equal turns by
    role, then by a hash of the text. A null role or text is one space; rows with a null conv_id are one conversation. Repeated rows follow each
    other as duplicates. Conversations without rows have zeros, no audit and the hash of nothing; gaps stop at the largest long. Long conversations
    and texts are worked on in segments; other columns are ignored; an empty table gives an empty table.
    """
    t = Tables()
    rows = prepare(lean(conversations).select("conv_id", "turn", "role", "text"))
    first = _first_pass(rows, t, segment_rows)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    segments = _faults_across(first.where("part is not null").drop(*names[1:]), t)
    rest = _last_pass(segments, _walked(segments, t))
    return t.result(first.where("part is null").select(*names).unionByName(rest), "repaired")


def conversation_report(conversations: DataFrame) -> DataFrame:
    """``repair_conversations`` of damaged rows."""
    return repair_conversations(conversations, damaged)
