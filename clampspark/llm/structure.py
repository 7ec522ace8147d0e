"""Repair of conversation structure by a dynamic programme over a grammar.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. Every row is one of 16 symbols (role class times fault). Re-Pair
turns the symbol strings of a batch of conversations into a grammar; each rule gets one min-plus transfer matrix over the four
states of that pattern, the product of its two parts' matrices, so a pattern of rows that many conversations share is worked
out once. An entry is (cost, audit): the cheapest edits and, of equally cheap ones, the ASCII-least initials, kept as a rope.
Of two audits of the same rows and cost neither begins with the other, so the order of two parts stays right in any context.

Spark does the rest: rows are range-sorted and landed once, repeats are found by a shuffle of digests, strings are cut into
bounded segments, whose matrices are folded per conversation from the end. A conversation's rows are never gathered.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clampspark.llm.repair import compress
from clampspark.llm.text import column
from clampspark.session import materialise

PART_BYTES = 48 << 20
SEGMENT_ROWS = 1024
BATCH_SYMBOLS = 1 << 18  # symbols that share one grammar
LEAST = 2

# Role classes, faults and the pattern's states.
ROLES = "sua?"                         # system, user, assistant, any other
FAULTS = ("ok", "truncated", "blank", "duplicate")
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last output row is; start and assistant may end a conversation
STATES = 4
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

Rope = str | tuple  # a string or (left, right, length)


def join(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    n = _len(a) + _len(b)
    return a + b if n <= 64 and isinstance(a, str) and isinstance(b, str) else (a, b, n)


def _len(a: Rope) -> int:
    return len(a) if isinstance(a, str) else a[2]


def leaves(a: Rope):
    todo = [a]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += [x[1], x[0]]


def flat(a: Rope) -> str:
    return "".join(leaves(a))


def less(a: Rope, b: Rope) -> bool:
    """ASCII order of two ropes, read only up to their first difference."""
    if a is b:
        return False
    xs, ys, x, y = leaves(a), leaves(b), "", ""
    while True:
        x, y = x or next(xs, ""), y or next(ys, "")
        if not x or not y:
            return bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def better(a, b):
    """The cheaper of two entries (cost, rope); None is none."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if not less(b[1], a[1]) else b


def product(a, b):
    """Min-plus product of two transfer matrices."""
    out = []
    for p in range(STATES):
        row = [None] * STATES
        for r in range(STATES):
            left = a[p][r]
            if left is not None:
                for q in range(STATES):
                    right = b[r][q]
                    if right is not None and (row[q] is None or left[0] + right[0] <= row[q][0]):
                        row[q] = better(row[q], (left[0] + right[0], join(left[1], right[1])))
        out.append(row)
    return out


@lru_cache(None)
def closure():
    """Any number of insertions."""
    out = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        at, n = p, 0
        while out[p][at] is None:
            out[p][at] = (n * INSERT, "I" * n)
            at, n = (ASSISTANT if at == USER else USER), n + 1
    return out


def symbol(role: int, fault: int) -> int:
    return role * len(FAULTS) + fault


@lru_cache(None)
def terminal(sym: int):
    """Insertions, then the edit of one row."""
    role, fault = ROLES[sym // len(FAULTS)], sym % len(FAULTS)
    edit = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        edit[p][p] = (DELETE, "D")
        if fault < 2:
            for to in "sua":
                q = NEXT.get((p, to))
                if q is not None and (to == role or to != "s"):
                    edit[p][q] = (fault * TRUNCATED, "K") if to == role else (fault * TRUNCATED + RENAME, "R")
    return product(closure(), edit)


def matrices(strings: list[np.ndarray], least: int = LEAST):
    """One transfer matrix per symbol string, by way of a grammar of all of them."""
    lens = np.array([len(s) for s in strings])
    base = len(ROLES) * len(FAULTS)
    sym, per, rules, _ = compress(np.concatenate(strings), lens, base, least)
    known = {}
    for i, (a, b) in enumerate(rules.tolist()):  # parts come before the rules that use them
        known[base + i] = product(known[a] if a >= base else terminal(a), known[b] if b >= base else terminal(b))
    out, done, at = [], {}, 0
    for n in per.tolist():
        part = tuple(sym[at:at + n].tolist())
        at += n
        if part not in done:
            m = None
            for s in part:
                t = known[s] if s >= base else terminal(s)
                m = t if m is None else product(m, t)
            done[part] = m
        out.append(done[part])
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of the contract: a null role or text is one space; by crc32 of ``conv_id:turn`` mod 20, 0 drops a row, 1 empties its text,
    2 takes out its ``[.!?]``, 3 gives it twice, 4 makes it a user's."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("_how"))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_how") == 3, 2).otherwise(1)))
    out = rows.where("_how <> 0").select("conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return out.drop("_copy")


ORDER = ["conv_id", "turn", "role", "text"]


def land(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` sorted and written once, with ``pos``: a long that grows with (conv_id, turn, role, text), nulls first.

    Partitions are ranges of that order, so one long conversation lies in many of them.
    """
    if parts is None:
        total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        parts = max(1, -(-total // PART_BYTES))
    head = F.substring("text", 1, 32)  # partition bounds are held by the driver: not whole texts
    cut = rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in ORDER[:3]], head.asc_nulls_first())
    out = cut.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER])
    return materialise(out.withColumn("pos", F.monotonically_increasing_id()), "turns")


def symbols(landed: DataFrame) -> DataFrame:
    """``(conv_id, pos, sym)``: role class and first fault of each row. A repeat is told by a 128-bit digest of role and text."""
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    kept = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    blank = F.length(kept) == 0
    cut = ~F.substring(kept, -1, 1).isin(".", "!", "?")
    digest = F.unhex(F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text").cast("binary")))
    rows = landed.select("conv_id", "pos", role.alias("role"), blank.alias("blank"), cut.alias("cut"), digest.alias("digest"))
    firsts = rows.where("not blank").groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 2).when(F.col("new").isNull(), 3).when(F.col("cut"), 1).otherwise(0)
    return rows.join(firsts, "pos", "left").select("conv_id", "pos", (F.col("role") * len(FAULTS) + fault).alias("sym"))


SEGMENT = "conv_id {kind}, pos long, costs array<int>, audits array<string>, faults array<long>, first int, last int"
AUDIT = "conv_id {kind}, cost long, audit string, blank long, duplicate long, truncated long, illegal long"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def segments(syms: DataFrame, size: int = SEGMENT_ROWS, batch: int = BATCH_SYMBOLS) -> DataFrame:
    """Transfer matrix, fault counts and illegal neighbours of each run of at most ``size`` rows of one conversation."""
    kind = syms.schema["conv_id"].dataType.simpleString()
    block = F.floor(F.col("pos") / size)  # positions of a partition begin at a multiple of 2^33
    ordered = F.sort_array(F.collect_list(F.struct("pos", "sym")))
    runs = syms.groupBy("conv_id", block.alias("_block")).agg(ordered.alias("s")).select("conv_id", F.col("s")[0]["pos"].alias("pos"), F.col("s")["sym"].alias("s"))
    legal = np.zeros((4, 4), bool)
    legal[tuple(zip(*LEGAL))] = True

    def flush(held):
        strings = [s for _, _, s in held]
        ms = matrices(strings)
        rows = {c: [] for c in ("conv_id", "pos", "costs", "audits", "faults", "first", "last")}
        done: dict[int, tuple] = {}
        for (conv, pos, s), m in zip(held, ms):
            if id(m) not in done:
                entries = [e for row in m for e in row]
                done[id(m)] = [None if e is None else e[0] for e in entries], [None if e is None else flat(e[1]) for e in entries]
            roles, faults = s // len(FAULTS), s % len(FAULTS)
            rows["conv_id"].append(conv)
            rows["pos"].append(pos)
            rows["costs"].append(done[id(m)][0])
            rows["audits"].append(done[id(m)][1])
            rows["faults"].append([int((faults == f).sum()) for f in (2, 3, 1)] + [int((~legal[roles[:-1], roles[1:]]).sum())])
            rows["first"].append(int(roles[0]))
            rows["last"].append(int(roles[-1]))
        types = dict(pos=pa.int64(), costs=pa.list_(pa.int32()), audits=pa.list_(pa.string()), faults=pa.list_(pa.int64()), first=pa.int32(), last=pa.int32())
        for at in range(0, len(held), 500):
            yield pa.RecordBatch.from_pydict({c: pa.array(v[at:at + 500], types.get(c, conv_type[0])) for c, v in rows.items()})

    conv_type = [None]

    def run(batches):
        held, n = [], 0
        for b in batches:
            conv_type[0] = column(b, "conv_id").type
            s = column(b, "s")
            flat_syms, off = s.flatten().to_numpy(zero_copy_only=False).astype(np.int64), s.offsets.to_numpy()
            off = off - off[0]
            for i, (conv, pos) in enumerate(zip(column(b, "conv_id").to_pylist(), column(b, "pos").to_pylist())):
                held.append((conv, pos, flat_syms[off[i]:off[i + 1]]))
                n += off[i + 1] - off[i]
            if n >= batch:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return runs.mapInArrow(run, SEGMENT.format(kind=kind))


def audits(segs: DataFrame) -> DataFrame:
    """Cheapest edits of each conversation, its segments folded from the last to the first."""
    kind = segs.schema["conv_id"].dataType.simpleString()
    ordered = segs.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("pos").desc())
    none = object()

    def run(batches):
        conv, tail, counts, follower = none, None, None, None
        out: list[tuple] = []
        kind_of = None

        def close():
            cost, audit = tail[START]
            out.append((conv, cost, flat(audit), *counts))

        def ship():
            cols = list(zip(*out))
            out.clear()
            types = [kind_of, pa.int64(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "cost", "audit", "blank", "duplicate", "truncated", "illegal"])

        for b in batches:
            kind_of = column(b, "conv_id").type
            for r in b.to_pylist():
                if r["conv_id"] != conv:
                    if conv is not none:
                        close()
                    conv, counts, follower = r["conv_id"], [0] * 4, None
                    # Behind the last row: insertions that end in a state where a conversation may end.
                    tail = [None] * STATES
                    for p in range(STATES):
                        for q in (START, ASSISTANT):
                            tail[p] = better(tail[p], closure()[p][q])
                now = [None] * STATES
                for p in range(STATES):
                    for q in range(STATES):
                        c, rest = r["costs"][p * STATES + q], tail[q]
                        if c is not None and rest is not None:
                            now[p] = better(now[p], (c + rest[0], join(r["audits"][p * STATES + q], rest[1])))
                tail = now
                counts = [a + x for a, x in zip(counts, r["faults"])]
                if follower is not None and (r["last"], follower) not in LEGAL:
                    counts[3] += 1
                follower = r["first"]
            if len(out) >= 500:
                yield ship()
        if conv is not none:
            close()
        if out:
            yield ship()

    return ordered.mapInArrow(run, AUDIT.format(kind=kind))


def analyse(rows: DataFrame, parts: int | None = None, size: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``rows(conv_id, turn, role, text)`` -> (landed rows, edits per conversation as in ``AUDIT``).

    Role and text must not be null (see ``damaged``); a null conv_id is one conversation, a null turn comes first, rows of one turn are
    taken by role and text. Other columns are ignored. An empty table has no conversations.
    """
    landed = land(rows.select(*ORDER), parts)
    return landed, audits(segments(symbols(landed), size))


DIGEST = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_repaired long"
REPAIRED = "conv_id {kind}, place long, role string, text string, edit string"
FULL = {"s": "system", "u": "user", "a": "assistant"}


class _Walk:
    """Applies an audit to the rows of one conversation as they pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.put("", "", "I")

    def put(self, role: str, text: str, edit: str):
        to = role[:1] if edit == "K" else ("a" if self.state == USER else "u")
        self.state = NEXT[self.state, to]
        return role if edit == "K" else FULL[to], text, edit

    def row(self, role: str, text: str):
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.put(role, text, edit)


def _stream(conv_ids: DataFrame, landed: DataFrame, edits: DataFrame) -> DataFrame:
    """Per conversation: its edits first, then its rows in order; a conversation's rows pass through one task but are not held."""
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    lead = conv_ids.select("conv_id").distinct().select("conv_id", F.lit(-2).cast("long").alias("pos"))
    known = edits.select("conv_id", F.lit(-1).cast("long").alias("pos"), *counts)
    both = lead.unionByName(known, allowMissingColumns=True).unionByName(landed.select("conv_id", "pos", "turn", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def digests(conv_ids: DataFrame, landed: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conv_id of ``conv_ids``, with the hash of its repaired rows and its gaps in turns."""
    kind = landed.schema["conv_id"].dataType.simpleString()
    none = object()

    def run(batches):
        conv, head, walk, sha, n, turns, out, kind_of = none, None, None, None, 0, None, [], None

        def emit(items):
            nonlocal n
            for role, text, _ in items:
                sha.update((("\n" if n else "") + role + ":" + text).encode())
                n += 1

        def close():
            if walk is not None:
                emit(walk.inserts())
            gaps = 0 if turns is None else min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1)
            out.append((conv, gaps, *(head or (0, 0, 0, 0, 0, "")), sha.hexdigest(), n))

        def ship():
            cols = list(zip(*out))
            out.clear()
            types = [kind_of, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in DIGEST.split(", ")])

        for b in batches:
            kind_of = column(b, "conv_id").type
            for r in b.to_pylist():
                if r["pos"] == -2:
                    if conv is not none:
                        close()
                    conv, head, walk, sha, n, turns = r["conv_id"], None, None, hashlib.sha256(), 0, None
                elif r["pos"] == -1:
                    head = tuple(r[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit"))
                    walk = _Walk(r["audit"])
                else:
                    t = r["turn"]
                    if t is not None:
                        turns = (t, t, 1) if turns is None else (turns[0], t, turns[2] + (t != turns[1]))
                    emit(walk.row(r["role"], r["text"]))
            if len(out) >= 500:
                yield ship()
        if conv is not none:
            close()
        if out:
            yield ship()

    return _stream(conv_ids, landed, edits).mapInArrow(run, DIGEST.format(kind=kind))


def repaired(landed: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations as rows (``REPAIRED``): kept and reroled rows and inserted ones, numbered from 0."""
    kind = landed.schema["conv_id"].dataType.simpleString()
    return _stream(landed, landed, edits).mapInArrow(_walked, REPAIRED.format(kind=kind))


def _walked(batches):
    conv, walk, place, out, kind_of = None, None, 0, [], None

    def take(items):
        nonlocal place
        for role, text, edit in items:
            out.append((conv, place, role, text, edit))
            place += 1

    def ship():
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind_of, pa.int64(), *[pa.string()] * 3])], names=["conv_id", "place", "role", "text", "edit"])

    for b in batches:
        kind_of = column(b, "conv_id").type
        for r in b.to_pylist():
            if r["pos"] == -2:
                if walk is not None:
                    take(walk.inserts())
                conv, walk, place = r["conv_id"], None, 0
            elif r["pos"] == -1:
                walk = _Walk(r["audit"])
            else:
                take(walk.row(r["role"], r["text"]))
            if len(out) >= 1000:
                yield ship()
    if walk is not None:
        take(walk.inserts())
    if out:
        yield ship()
