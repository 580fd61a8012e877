"""Approximate nearest neighbours by inner product: inverted lists and adaptive dimension scans.

Vectors are assigned to the lists of a k-means index that is fitted on a bounded sample. A query probes
the lists whose centroids are nearest to it, until they hold a given share of all vectors; a part of the
same sample gives it a bound that its last result will reach. Inside a list, vectors are rotated and their columns are read in blocks: after a random rotation
the first d of D columns hold d/D of an inner product, give or take a known deviation, so a candidate
whose partial product is too low for the bound is abandoned after a few columns. What is left is scored
on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, parallelism

#: Vectors (those of the smallest hash) on which centroids are fitted and bounds are taken; also the bound of what is broadcast.
SAMPLE = 20_000
#: A query's bound comes from one vector in so many, at most, so that it is a bound and not the search.
BOUND = 16
#: Share of the vectors that the probed lists hold. Vectors without any structure need more than half of them for a recall of 0.9.
PROBE = 0.75
#: Vectors of a tile, at least and at most, in between so many that each worker has some tiles; queries of a block, about.
TILES, QUERIES = (256, 8192), 65536
#: Vectors of the sample for each list, at least.
PER_LIST = 4
#: Columns of a block; standard deviations below its share at which a pair is abandoned; pairs that are scored at once.
BLOCK, DEVIATIONS, PAIRS = 16, 2.5, 1 << 20


def centroids(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, c)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scan(turned: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) whose product may reach the query's bound; both sides are rotated.

    Products grow by blocks of columns. After each block a pair is abandoned if what it has is too far
    below its share of the bound. While many pairs are alive they are read as matrices, then one by one.
    """
    size = turned.shape[1]
    scale = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(turned, axis=1)[None, :]
    with np.errstate(over="ignore"):
        spread = DEVIATIONS / size * np.sqrt(scale * scale + np.minimum(np.square(np.where(np.isfinite(bound), bound, 0.0))[:, None], scale * scale))
    partial, d = np.zeros((len(queries), len(turned))), 0
    while d < size:
        partial += queries[:, d : d + BLOCK] @ turned[:, d : d + BLOCK].T
        d = min(size, d + BLOCK)
        alive = partial >= bound[:, None] * (d / size) - spread * np.sqrt(d * (1 - d / size))
        if 8 * np.count_nonzero(alive) < alive.size:
            break
    i, j = np.nonzero(alive)
    sums, spread = partial[i, j], spread[i, j]
    while d < size and len(i):
        sums = sums + np.einsum("ij,ij->i", queries[i, d : d + BLOCK], turned[j, d : d + BLOCK])
        d = min(size, d + BLOCK)
        keep = sums >= bound[i] * (d / size) - spread * np.sqrt(d * (1 - d / size))
        i, j, sums, spread = i[keep], j[keep], sums[keep], spread[keep]
    return i, j


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, probe: float = PROBE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products in double precision, ties to the smaller vec_id.

    Both tables have vec_id and embedding; a query's own vec_id is no candidate. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do null ids, nor vectors of another
    dimension than the most common one (the larger, in a tie). Rows with the same id and vector are one.
    Equal vectors are searched and stored once with their k + 1 smallest ids, which is all of them that
    any result can show. Fewer than k candidates give as many rows; none give none.
    """
    names = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    base, asked = _valid(vectors), _valid(queries)
    dims = base.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    if dims is None:
        return spark.createDataFrame([], names)
    size = dims["d"]
    base, asked = base.filter(F.size("embedding") == size), asked.filter(F.size("embedding") == size).distinct()
    few = W.partitionBy("embedding").orderBy("vec_id")
    kept = base.distinct().withColumn("k", F.row_number().over(few)).filter(F.col("k") <= k + 1)  # cut down before the shuffle, too
    classes = cut(kept.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]))
    mine = asked.join(classes.select("embedding", "cid"), "embedding", "left")

    # At most `sample` rows reach the driver, and go out again.
    rows = classes.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(sample).toArrow()
    some, some_ids = _matrix(rows["embedding"]), rows["cid"].to_numpy()
    total = classes.count()
    lists = max(1, min(round(total**0.5), len(some) // PER_LIST))
    middle = centroids(some, lists)
    bounding = slice(0, min(len(some), -(-total // BOUND)))
    tile_size = int(np.clip(total // (4 * parallelism(spark)), *TILES))
    shared = spark.sparkContext.broadcast((middle, some[bounding], some_ids[bounding], rotation(size)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest(_matrix(b.column(1)), shared.value[0]) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], names=["cid", "embedding", "ids", "list"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    listed = cut(classes.select("cid", "embedding", "ids").mapInArrow(assign, f"cid long, embedding {kind}, ids array<long>, list int"))
    counts = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list: at most a quarter of the sample
    # Small lists share a tile, a large one is spread over several by id.
    first: dict[int, tuple[int, int]] = {}
    tile, filled = 0, 0
    for x in range(lists):
        n = counts.get(x, 0)
        if n > tile_size:
            tile, filled = tile + (filled > 0), 0
            first[x] = (tile, -(-n // tile_size))
            tile += first[x][1]
        else:
            if filled + n > tile_size:
                tile, filled = tile + 1, 0
            first[x] = (tile, 1)
            filled += n
    searched = cut(mine.groupBy("embedding").agg(F.coalesce(F.min("cid"), F.xxhash64("embedding")).alias("cid")))
    parts = max(1, -(-int(searched.count() * min(1.0, probe * 1.5)) // QUERIES))
    where, spread = (F.get(F.lit([first[x][k] for x in range(lists)]), F.col("list")) for k in (0, 1))
    cells = listed.withColumn("tile", where + F.pmod(F.xxhash64("cid"), spread).cast("int"))
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else cells.withColumn("part", F.lit(0))

    held = np.array([counts.get(x, 0) for x in range(lists)])
    need = max(int(np.ceil(probe * total)), min(total, 4 * k))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, some, some_ids, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q, cid = _matrix(b.column(1)), b.column(0).to_numpy()
            best = np.argsort(-(q @ c.T), axis=1, kind="stable")
            probes = (np.cumsum(held[best], axis=1) < need).sum(1) + 1
            score = q @ some.T
            score[cid[:, None] == some_ids[None, :]] = -np.inf
            # The k-th best of the sample is reached by the k-th best of all; a little is given for rounding.
            bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
            bound = np.where(np.isfinite(bound), bound - 1e-9 * np.abs(bound), -np.inf)
            row, tiles, own = [], [], []
            for i in range(len(q)):
                to: dict[int, list[int]] = {}
                for x in best[i, : probes[i]].tolist():
                    for t in range(first[x][0], first[x][0] + first[x][1]):
                        to.setdefault(t, []).append(x)
                for t, xs in to.items():
                    row.append(i)
                    tiles.append(t)
                    own.append(xs)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(tiles, pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(bound).take(at)], names=["cid", "embedding", "tile", "lists", "bound"])

    sent = searched.select("cid", "embedding").mapInArrow(ask, f"cid long, embedding {kind}, tile int, lists array<int>, bound double").withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int"))

    def look(cells: pa.Table, sent: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if cells.num_rows and sent.num_rows:
            x, ids, own = _matrix(cells["embedding"]), cells["ids"].to_pylist(), cells["list"].to_numpy()
            turn = shared.value[3]
            xt = x @ turn
            q, cid, bound = _matrix(sent["embedding"]), sent["cid"].to_numpy(), sent["bound"].to_numpy()
            qt = q @ turn
            xs = sent["lists"].combine_chunks()
            asks, asked = np.repeat(np.arange(len(q)), np.diff(xs.offsets.to_numpy())), xs.flatten().to_numpy()
            near, far, score = [], [], []
            for z in np.unique(own):
                at, who = np.flatnonzero(own == z), asks[asked == z]
                for part in np.array_split(who, -(-len(who) * len(at) // PAIRS)) if len(who) else []:
                    i, j = scan(xt[at], qt[part], bound[part] - 1e-9 * np.abs(np.where(np.isfinite(bound[part]), bound[part], 0.0)))
                    i, j = part[i], at[j]
                    exact = np.einsum("ij,ij->i", q[i], x[j])
                    good = exact >= bound[i]
                    near.append(i[good])
                    far.append(j[good])
                    score.append(exact[good])
            near, far, score = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (near, far, score))
            many = np.array([len(v) for v in ids])[far] if len(far) else far
            flat = np.array([v for j in far.tolist() for v in ids[j]], np.int64)
            near, score = np.repeat(near, many), np.repeat(score, many)
            order = np.lexsort((flat, -score, near))
            near, flat, score = near[order], flat[order], score[order]
            keep = np.arange(len(near)) - np.searchsorted(near, near) <= k
            out = [cid[near[keep]], flat[keep], score[keep]]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["cid", "vec_id", "score"])

    found = cells.groupBy("tile", "part").cogroup(sent.groupBy("tile", "part")).applyInArrow(look, "cid long, vec_id long, score double")
    top = found.withColumn("k", F.row_number().over(W.partitionBy("cid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= k + 1)
    best = top.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))
    asked_ids = mine.join(searched.select(F.col("embedding"), F.col("cid").alias("of")), "embedding").select(F.col("vec_id").alias("query_id"), "of")
    rows = asked_ids.join(best, F.col("of") == F.col("cid"))
    rows = rows.select("query_id", F.expr(f"posexplode(slice(filter(best, b -> b.vec_id <> query_id), 1, {k}))").alias("pos", "b"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & sound & F.exists(e, lambda x: x != 0))
