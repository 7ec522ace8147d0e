"""An error channel for Python steps: a row that raises gives an error text, and its neighbours their results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

ERROR = "_error"


def guarded(batches: Iterable[pa.RecordBatch], step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], keys: list[str], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """``step`` on each batch, with a column ``_error``.

    A batch that raises is taken again row by row; each row that raises alone becomes one row of its ``keys``, nulls, and the error. ``types`` are the
    columns of ``step`` besides the keys, in order.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        try:
            done = list(step(batch))
        except Exception:  # noqa: BLE001
            done = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    done += list(step(row))
                except Exception as exc:  # noqa: BLE001
                    ident = [row.column(row.schema.get_field_index(k)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*ident, *[pa.nulls(1, t) for t in types.values()], pa.array([f"{type(exc).__name__}: {exc}"[:500]])], names=[*keys, *types, ERROR])
        for out in done:
            yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.string())], names=[*out.schema.names, ERROR])
