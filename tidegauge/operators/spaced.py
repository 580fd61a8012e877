"""Points kept at a distance, over tracks of any length.

From the left, a point is kept if it is ``apart`` or more behind the last one that was. That is a walk, but what a
piece of a track does to it is small: it turns the last kept place before the piece into the last one in
it, and only places close to its beginning make a difference. So pieces are read once for these maps, the maps of
a track are composed, and pieces are read again, each one knowing where the walk enters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a piece.
WIDTH = 1 << 20


def walk(at: np.ndarray, apart: int, last: int | None = None) -> np.ndarray:
    """The points of ``at`` (ascending) that are kept, behind one kept at ``last``."""
    step = np.searchsorted(at, at + max(apart, 1)).tolist()  # the next point that can be kept behind each
    k, kept = 0 if last is None else int(np.searchsorted(at, last + apart)), []
    while k < len(at):
        kept.append(k)
        k = step[k]
    return at[kept]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the rows at which groups begin and the end: rows come sorted by ``keys``, and a group may go on in the next batch."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            code = t[k].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new |= code[1:] != code[:-1]
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        if starts[-1]:
            yield t.slice(0, int(starts[-1])), starts
        held = t.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def spaced(points: DataFrame, apart: int, width: int = WIDTH) -> DataFrame:
    """track, at: the points (track, at) that are kept; tracks are texts, numbers or dates. Points without a place are not kept; equal ones are one.

    A null track is a track. Rows are dealt and sorted by track and piece, so a task holds the points of ``width`` places at
    most, and many short tracks go through it in one batch; the maps of a track's pieces are a few numbers each, whatever lies in them.
    """
    width = max(width, apart, 1)
    kind = points.schema["track"].dataType.simpleString()
    rows = points.filter(F.col("at").isNotNull()).select("track", F.col("at").cast("long").alias("at"), F.floor(F.col("at") / width).cast("long").alias("piece"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _groups(batches, ["track", "piece"]):
            places, piece, enters, leaves = t["at"].to_numpy(), t["piece"].to_numpy(), [], []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = np.unique(places[a:z])
                step, ends = np.searchsorted(at, at + max(apart, 1)).tolist(), at.tolist()
                for k in range(len(at) - 1, -1, -1):
                    if step[k] < len(at):
                        ends[k] = ends[step[k]]
                near = int(np.searchsorted(at, int(piece[a]) * width + apart)) + 1  # where the walk can enter
                enters.append(at[:near].tobytes())
                leaves.append(np.array(ends[:near], np.int64).tobytes())
            first = pa.array(cuts[:-1])
            yield from pa.table({"track": t["track"].take(first), "piece": t["piece"].take(first), "enters": pa.array(enters, pa.binary()), "leaves": pa.array(leaves, pa.binary())}).to_batches()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _groups(batches, ["track"]):
            before: list[int | None] = []
            enters, leaves = t["enters"].to_pylist(), t["leaves"].to_pylist()
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                last = None
                for r in range(a, z):
                    before.append(last)
                    at = np.frombuffer(enters[r], np.int64)
                    k = 0 if last is None else int(np.searchsorted(at, last + apart))
                    if k < len(at):
                        last = int(np.frombuffer(leaves[r], np.int64)[k])
            yield from pa.table({"track": t["track"], "piece": t["piece"], "last": pa.array(before, pa.int64())}).to_batches()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _groups(batches, ["track", "piece"]):
            places, last, out, of = t["at"].to_numpy(), t["last"].to_pylist(), [], []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out.append(walk(np.unique(places[a:z]), apart, last[a]))
                of.append(np.full(len(out[-1]), a))
            yield from pa.table({"track": t["track"].take(pa.array(np.concatenate(of))), "at": pa.array(np.concatenate(out))}).to_batches()

    dealt = lambda df, *keys: df.repartition(*keys[:-1]).sortWithinPartitions(*keys)
    found = dealt(rows, "track", "piece", "at").mapInArrow(maps, f"track {kind}, piece long, enters binary, leaves binary")
    entered = dealt(found, "track", "piece").mapInArrow(compose, f"track {kind}, piece long, last long").filter("last is not null")
    x, y = rows.alias("x"), entered.alias("y")  # first pieces have nothing before them
    both = x.join(y, F.col("x.track").eqNullSafe(F.col("y.track")) & (F.col("x.piece") == F.col("y.piece")), "left").select("x.track", "x.piece", "x.at", "y.last")
    return dealt(both, "track", "piece", "at").select("track", "piece", "at", "last").mapInArrow(kept, f"track {kind}, at long")
