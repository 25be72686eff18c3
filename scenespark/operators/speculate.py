"""Shots of streams of any length, in parallel: pieces are folded from their own beginnings and stitched where they meet.

After a cut the state of a fold is the frame alone. A stream's pieces, which lie in the partitions of a sort by
ranges, are folded side by side as if each began a shot. Then each piece whose stream began earlier is
folded again from the state in which the piece before it ended, but only up to the first frame at which both folds cut: from
there on they are the same. A piece without such a frame passes its own end on, and the next is folded
again if that differs from what was assumed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..store import checkpoint
from .folds import values

SPEC = "_sim double, _cut boolean, _at int"
ADDS = "sim_to_shot_mean double, is_shot_start boolean, segment_id int"


@dataclass
class Piece:
    """What the driver knows of a partition: its first and last stream, how many it has, and the state of the last one's fold at its end."""

    part: int
    first: Any
    last: Any
    keys: int
    end: tuple
    cuts: int


def state_of(s) -> tuple:
    """A fold's state without its number of shots: what decides all later frames."""
    return (s.mean.tobytes(), s.start, s.count)


def resumed(make, state: tuple, segment: int):
    s = make()
    s.mean, s.start, s.count, s.segment = np.frombuffer(state[0]).copy(), state[1], state[2], segment
    return s


def rows_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, list(zip(*[values(batch.column(c)) for c in columns], strict=True))


def speculated(frames: DataFrame, key: str, order: list[str], make) -> DataFrame:
    """Sorted pieces with the results of their own folds, kept with their partitions, and on each one's last row a summary."""
    schema = T.StructType([*frames.schema.fields, *T._parse_datatype_string(SPEC).fields, T.StructField("_end", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = s = None
        keys, waiting = 0, None

        def out(batch: pa.RecordBatch, made: list[tuple], end: bytes | None) -> pa.RecordBatch:
            ends = [None] * (batch.num_rows - 1) + [end]
            return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *(pa.array(x, f.type) for x, f in zip([*zip(*made, strict=True), ends], list(arrow)[-4:], strict=True))], schema=arrow)

        for batch, rows in rows_of(batches, [key, "embedding", "timestamp_sec"]):
            if waiting:
                yield out(*waiting, None)
            made = []
            for k, e, t in rows:
                if s is None or k != last:
                    first, last, keys, s = k if s is None else first, k, keys + 1, make()
                made.append(s.ingest(e, t))
            waiting = batch, made
        if waiting:
            yield out(*waiting, pickle.dumps(Piece(TaskContext.get().partitionId(), first, last, keys, state_of(s), s.segment)))

    return checkpoint(frames.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema))


def heads_from(rows: list[tuple], s, first: Any, done: int) -> tuple[int, bool, int]:
    """Fold a batch of a piece's first stream again, ``done`` frames of which came before, up to the first frame at which both folds cut: frames folded, whether they met, the own fold's shot there."""
    n = 0
    for k, e, t, _, cut, at in rows:
        if k != first:
            break
        _, begins, _ = s.ingest(e, t)
        n += 1
        if begins and cut and done + n > 1:
            return n, True, at
    return n, False, -1


def stitched(frames: DataFrame, key: str, order: list[str], make) -> tuple[DataFrame, dict[str, int]]:
    """Frames with ADDS as one serial fold of each stream would give them, and counts: pieces, rounds, frames folded again."""
    pieces = speculated(frames, key, order, make)
    needs = [key, "embedding", "timestamp_sec", "_sim", "_cut", "_at"]
    info = sorted((pickle.loads(bytes(r["_end"])) for r in pieces.where("_end is not null").select("_end").collect()), key=lambda p: p.part)  # a row for each partition
    follows = {b.part: a for a, b in zip(info, info[1:], strict=False) if a.last == b.first}
    by_part = {p.part: p for p in info}
    # what each piece is assumed to begin with, and what its stream's fold is at its end
    begins = {p: follows[p].end for p in follows}
    ends = {p.part: p.end for p in info}
    told: dict[int, tuple] = {}
    todo, rounds, again = dict(begins), 0, 0
    while todo:
        rounds += 1
        asked = todo

        def fold_heads(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            if part not in asked:
                return
            s, n, met, at = resumed(make, asked[part], 0), 0, False, -1
            for _, rows in rows_of(batches, needs):
                if n == 0:
                    first = rows[0][0]
                m, met, at = heads_from(rows, s, first, n)
                n += m
                if met or m < len(rows):
                    break
            yield pa.RecordBatch.from_pydict({"x": [pickle.dumps((part, n, met, at, s.segment, None if met else state_of(s)))]}, pa.schema([("x", pa.binary())]))

        for part, n, met, at, cuts, end in (pickle.loads(bytes(r["x"])) for r in pieces.select(*needs).mapInArrow(fold_heads, "x binary").collect()):
            told[part] = (met, at, cuts)
            again += n
            # a piece that ends in another stream than it began with ends as its own fold did
            if by_part[part].keys == 1:
                ends[part] = by_part[part].end if met else end
        # those whose stream's state before them is certain by now, and not what was assumed: no piece is folded again more than twice
        certain: set[int] = set()
        for p in info:
            before = follows.get(p.part)
            if before is None or p.keys > 1 or before.part in certain and begins[p.part] == ends[before.part]:
                certain.add(p.part)
        todo = {p: ends[a.part] for p, a in follows.items() if a.part in certain and ends[a.part] != begins[p]}
        begins |= todo
    # shots before each piece, from the counts of cuts
    numbers: dict[int, int] = {}
    for p in info:
        if p.part in follows:
            numbers[p.part] = last_number
        one = p.keys == 1 and p.part in follows
        met, at, cuts = told.get(p.part, (True, 0, 0))
        last_number = (numbers[p.part] + cuts + (p.cuts - at if met else 0)) if one else p.cuts
    schema = T.StructType([*frames.schema.fields, *T._parse_datatype_string(ADDS).fields])
    arrow = to_arrow_schema(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        s = resumed(make, begins[part], numbers[part]) if part in begins else None
        first, shift, n = None, 0, 0
        for batch, rows in rows_of(batches, needs):
            first = rows[0][0] if n == 0 else first
            made = []
            for k, e, t, sim, cut, at in rows:
                n += 1
                if k != first:
                    s, shift = None, 0
                if s is None:
                    made.append((sim, cut, at + shift))
                    continue
                got = s.ingest(e, t)
                made.append(got)
                if got[1] and cut and n > 1:
                    s, shift = None, got[2] - at
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[: len(arrow) - 3], arrow, strict=False)), *(pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), list(arrow)[-3:], strict=True))], schema=arrow)

    return pieces.mapInArrow(finish, schema), {"pieces": len(info), "rounds": rounds, "again": again}

