"""Which keys occur with more than one member: one exchange, and no task gets a frequent key's rows.

Each task of the producer looks at its own batch first. A key that it holds with two members or more is
known to repeat: its rows need no partner and are dealt out at random, with one marker for the key. Only
rows that are still alone travel to their key's partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from weftbase.llm.textbatch import lean, mix64, signed

#: ``kind``: one of the four below, and four times the pair's note.
ROUTED = "route long, key long, member long, kind long"
ALONE, MARKER, KNOWN = 0, 1, 2


def routed(key: np.ndarray, member: np.ndarray, sure: np.ndarray | None = None, note: np.ndarray | None = None, more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """Rows to exchange for a batch of (key, member) pairs (64-bit values); equal pairs become one.
    ``sure``: keys (sorted) that repeat in any case; ``note``: a number that stays with each pair; ``more``: other columns
    that do."""
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    key, member = key[fresh], member[fresh]
    note = np.zeros(len(key), np.int64) if note is None else note[order][fresh]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    again = same.copy()
    again[:-1] |= same[1:]
    if sure is not None and len(sure) and len(key):
        again |= sure[np.minimum(np.searchsorted(sure, key), len(sure) - 1)] == key
    head = again & ~same
    alone = ~again
    route = np.concatenate([key[alone], key[head], mix64(key[again] ^ mix64(member[again]))])
    n = alone.sum(), head.sum(), again.sum()
    zero = np.zeros(n[0] + n[1], np.uint64)
    which = pa.array(order[fresh][np.concatenate([np.flatnonzero(x) for x in (alone, head, again)])]) if more else None
    more = {name: column.take(which) for name, column in (more or {}).items()}
    return pa.RecordBatch.from_arrays(
        [
            pa.array(signed(route)),
            pa.array(signed(np.concatenate([zero, key[again]]))),
            pa.array(signed(np.concatenate([member[alone], zero[: n[1]], member[again]]))),
            pa.array(np.repeat(np.array([ALONE, MARKER, KNOWN]), n) + 4 * np.concatenate([note[alone], np.zeros(n[1], np.int64), note[again]])),
            *more.values(),
        ],
        ["route", "key", "member", "kind", *more],
    )


@lean
def _reduce(batches):
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    route, key, member, kind = (rows.column(c).to_numpy() for c in ("route", "key", "member", "kind"))
    more = rows.drop_columns(["route", "key", "member", "kind"])

    def made(key, which):
        own = more.take(pa.array(which)).combine_chunks()
        columns = [pa.array(key[which]), pa.array(member[which]), pa.array(note[which]), *(c.combine_chunks() for c in own.columns)]
        return pa.RecordBatch.from_arrays(columns, ["key", "member", "note", *own.column_names])

    note, kind = kind >> 2, kind & 3
    known = np.flatnonzero(kind == KNOWN)
    if len(known):
        yield made(key, known)
    order = np.flatnonzero(kind != KNOWN)
    order = order[np.lexsort((kind[order], member[order], route[order]))]
    by = [x[order] for x in (route, member, kind)]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in by], 0)
    order, place, alone = order[fresh], by[0][fresh], by[2][fresh] == ALONE
    same = np.zeros(len(order), bool)
    same[1:] = place[1:] == place[:-1]
    again = same.copy()
    again[:-1] |= same[1:]
    yield made(route, order[again & alone])


def repeated(rows: DataFrame) -> DataFrame:
    """(key, member, note, other columns) for all pairs whose key has two members or more, from ``routed`` rows; a pair can
    come more than once."""
    schema = StructType().add("key", "long").add("member", "long").add("note", "long")
    for field in rows.schema.fields[4:]:
        schema = schema.add(field)
    return rows.repartition("route").mapInArrow(_reduce, schema)
