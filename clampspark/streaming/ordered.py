"""Chunks of a stream taken in order, whatever batches they arrive in.

State is keyed by ``chunk_seq``: a chunk that comes early waits in a map, one that was already taken is rejected, and a gap
is given up when the watermark passes the time the first waiting chunk was seen plus a grace period. What an operator carries from chunk to
chunk is one small value of its own.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "recording_id bigint, channel_index int, chunk_seq bigint, kind string, {columns}"


class InOrder(StatefulProcessor):
    """Base of ordered operators. ``fields`` are the input columns beside the keys, ``payload`` their types, ``carry`` the state's.

    A subclass gives ``start`` (the first carry) and ``take(carry, seq, row) -> (carry, outputs)`` with outputs as tuples of ``columns``. A rejected chunk
    is a row of kind ``late``, a gap given up one of kind ``gap`` whose ``chunk_seq`` is the first missing chunk.
    """
    payload = ""
    carry = ""
    columns: list[str] = []
    start: tuple = ()

    def __init__(self, keys: int = 1, grace_ms: int = 0, each: bool = True):
        self.n_keys, self.grace, self.each = keys, grace_ms, each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long")
        self.kept = handle.getValueState("carry", self.carry)
        self.early = handle.getMapState("early", "seq long", self.payload)

    def take(self, carry: tuple, seq: int, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def _row(self, key, seq: int, kind: str, values: tuple) -> tuple:
        return (int(key[0]), int(key[1]) if self.n_keys > 1 else 0, int(seq), kind, *values)

    def _drain(self, key, seq: int, carry: tuple, out: list, held: bool = True) -> tuple[int, tuple]:
        """Chunks that waited for this one; ``held`` tells whether any chunk of an earlier batch waits."""
        while held and self.early.containsKey((seq,)):
            row = tuple(self.early.getValue((seq,)))
            self.early.removeKey((seq,))
            carry, made = self.take(carry, seq, row)
            out += [self._row(key, seq, "chunk", m) for m in made]
            seq += 1
        return seq, carry

    def _frame(self, out: list) -> pd.DataFrame:
        if not self.each:  # only the last state of the batch, and what is not a chunk
            chunks = [r for r in out if r[3] == "chunk"]
            out = [r for r in out if r[3] != "chunk"] + chunks[-1:]
        return pd.DataFrame(out, columns=["recording_id", "channel_index", "chunk_seq", "kind", *self.columns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq = int(self.next.get()[0]) if self.next.exists() else 0
        carry = tuple(self.kept.get()) if self.kept.exists() else self.start
        out: list[tuple] = []
        none = (None,) * len(self.columns)
        p = pd.concat(list(rows)).sort_values("chunk_seq", kind="stable")
        fields = [c.split()[0] for c in self.payload.split(", ")]
        first_wait = None
        # The batch is taken in order, so only chunks of earlier batches can fill in behind one of its own: without any the map is not asked.
        held, mine = self.early.exists(), set()
        for at, *values in p[["chunk_seq", *fields]].itertuples(index=False, name=None):
            at = int(at)
            if at < seq or at in mine or held and self.early.containsKey((at,)):
                out.append(self._row(key, at, "late", none))
            elif at == seq:
                carry, made = self.take(carry, at, tuple(values))
                out += [self._row(key, at, "chunk", m) for m in made]
                seq, carry = self._drain(key, at + 1, carry, out, held)
            else:
                mine.add(at)
                self.early.updateValue((at,), tuple(v.tolist() if hasattr(v, "tolist") else v for v in values))
                first_wait = at if first_wait is None else first_wait
        self.next.update((seq,))
        self.kept.update(carry)
        if self.grace and first_wait is not None:
            self.handle.registerTimer(int(timerValues.getCurrentWatermarkInMs()) + self.grace)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Time is up for the gap: go on with the first chunk that waits."""
        waiting = sorted(int(k[0]) for k in self.early.keys())
        out: list[tuple] = []
        if waiting:
            seq = int(self.next.get()[0]) if self.next.exists() else 0
            carry = tuple(self.kept.get()) if self.kept.exists() else self.start
            out.append(self._row(key, seq, "gap", (None,) * len(self.columns)))
            seq, carry = self._drain(key, waiting[0], carry, out)
            self.next.update((seq,))
            self.kept.update(carry)
            if any(True for _ in self.early.keys()):
                self.handle.registerTimer(int(timerValues.getCurrentWatermarkInMs()) + self.grace)
        yield self._frame(out)

    def close(self) -> None:
        pass


def in_order(chunks: DataFrame, processor: InOrder, keys: list[str], columns: str, time: str | None = None, lateness: str = "10 seconds") -> DataFrame:
    """Run ``processor`` over ``chunks``. With ``time`` (an event-time column) gaps are given up after the processor's grace."""
    schema = OUT.format(columns=columns)
    src = chunks if time is None else chunks.withWatermark(time, lateness)
    return src.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None" if time is None else "EventTime")


def on_time(out: DataFrame) -> DataFrame:
    """Results of chunks taken in order."""
    return out.where("kind = 'chunk'").drop("kind")


def rejects(out: DataFrame) -> DataFrame:
    """Chunks that came twice or after their gap was given up, and the gaps."""
    return out.where(F.col("kind").isin("late", "gap")).select("recording_id", "channel_index", "chunk_seq", "kind")
