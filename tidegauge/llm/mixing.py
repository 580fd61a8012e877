"""Mixing sources to target weights.

Targets come from water-filling over the sources' sizes. Every source's documents stand in a permuted
order; whole passes and a last part of that order make up the target. The passes' documents are the
blocks of the mix. A splitting tree deals the blocks to output shards: a node with all sources' block
counts gives its left half a multivariate hypergeometric draw of them, down to single shards, so the
quotas of each source add up exactly and no list of blocks is ever shuffled as a whole. A block's rank
in its source's order then says which shard's quota it fills; inside a shard blocks are ordered by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, words

#: Order buckets of a source: rows of a hot source are ranked in this many pieces.
BUCKET_BITS = 12


def targets(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, floor: float = 0.0) -> DataFrame:
    """One row a source: skey, source, source_size, n_docs, weight, target.

    ``docs`` has skey, source, size. Each source first gets ``floor`` times its size; the rest of
    ``share`` times all sizes is shared by weight, and what goes over ``cap`` times a source's size is
    shared again among the others.
    """
    per = docs.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(W.orderBy("skey")) - 1).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("room", (cap - floor) * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("weight"))
    # Sources by the level at which they are full; the level that all others reach is the first that stays below the next one's.
    w = W.orderBy("ratio", "skey")
    per = (
        per.withColumn("left", (share - floor) * F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(whole))
    )
    most = F.col("room")
    extra = F.when(F.col("final").isNull(), most).otherwise(F.least(most, F.col("final.level") * F.col("weight")))
    return per.select("skey", "source", "source_size", "n_docs", "weight", (floor * F.col("source_size") + extra).alias("target"))


def split_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """skey, first[shard] -> rank at which each shard's quota of a source begins; ``quotas`` has skey, blocks.

    ``n_shards`` is a power of two. Sizes of shards differ by at most one block.
    """
    levels = n_shards.bit_length() - 1
    if 1 << levels != n_shards:
        raise ValueError("n_shards must be a power of two")
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("skey", "blocks"))).alias("held"))
    node = node.select(F.lit(0).alias("first"), F.lit(n_shards).alias("shards"), "held", F.expr("aggregate(held, 0L, (a, x) -> a + x.blocks)").alias("total"))
    node = node.withColumn("begin", F.lit(0).cast("long")).withColumn("all", F.col("total"))
    # A univariate hypergeometric draw by inversion: weights relative to the window's start, summed once, then walked to u.
    ratio = "((n - x) * 1D * (s.l - x)) / ((x + 1) * 1D * (s.r - n - s.l + x + 1))"
    draw = f"""
        transform(array(named_struct('lo', greatest(0L, s.l - (s.r - n), cast(floor(m - 10 * d - 5) as bigint)),
                                     'hi', least(n, s.l, cast(ceil(m + 10 * d + 5) as bigint)))), k ->
          aggregate(sequence(k.lo, k.hi),
            named_struct('x', k.lo, 'w', 1D, 'c', 0D, 'g', u * aggregate(sequence(k.lo, k.hi), named_struct('w', 1D, 't', 0D),
                (a, x) -> named_struct('w', a.w * {ratio}, 't', a.t + a.w), a -> a.t)),
            (a, x) -> named_struct('x', if(a.c + a.w <= a.g and x < k.hi, x + 1, a.x), 'w', if(a.c + a.w <= a.g, a.w * {ratio}, a.w),
                                   'c', if(a.c + a.w <= a.g, a.c + a.w, a.c), 'g', a.g), a -> a.x))[0]"""
    def over(names: str, values: list[str], body: str) -> str:  # names for values inside an expression
        for n, v in reversed(list(zip(names.split(), values, strict=True))):
            body = f"transform(array({v}), {n} -> {body})[0]"
        return body
    one = over(
        "n m d u",
        ["b.blocks", "if(s.r = 0, 0D, s.l * 1D * n / s.r)", "if(s.r <= 1, 0D, sqrt(greatest(0D, m * (s.r - n) / s.r * (s.r - s.l) / (s.r - 1))))",
         f"(shiftrightunsigned(xxhash64({seed}L, first, shards, b.skey), 11) + 0.5D) / {2**53}D"],
        draw,
    )
    for _ in range(levels):
        node = node.withColumn("take", F.expr("(all * (first + shards div 2)) div {0} - (all * first) div {0}".format(n_shards)))
        node = node.withColumn("left", F.expr(f"""aggregate(held, named_struct('r', total, 'l', take, 'out', cast(array() as array<bigint>)),
            (s, b) -> transform(array({one}), v -> named_struct('r', s.r - b.blocks, 'l', s.l - v, 'out', concat(s.out, array(v))))[0], s -> s.out)"""))
        half = F.expr("""inline(array(
            named_struct('first', first, 'shards', shards div 2, 'total', take, 'held', zip_with(held, left, (h, v) -> named_struct('skey', h.skey, 'blocks', v))),
            named_struct('first', first + shards div 2, 'shards', shards div 2, 'total', total - take, 'held', zip_with(held, left, (h, v) -> named_struct('skey', h.skey, 'blocks', h.blocks - v)))))""")
        node = node.select("all", half)
    leaf = node.select(F.col("first").alias("shard"), F.expr("inline(held)"))
    upto = W.partitionBy("skey").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    leaf = leaf.withColumn("begin", F.coalesce(F.sum("blocks").over(upto), F.lit(0)))
    return leaf.groupBy("skey").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "begin"))), lambda x: x["begin"]).alias("begins"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, floor: float = 0.0, n_shards: int = 8, seed: int = 11, keep=()) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards, plus the columns named in ``keep``.

    Size is the number of words (null text: 0). Sources are in code-point order, null last, and take
    ``weights`` in turn. ``taken`` words come to the source's target exactly (rounded): documents in
    permuted order are taken whole ``passes`` times, and the document at the edge in part. ``shards``
    holds one output shard for each time the document is taken (an empty document: none). The order
    depends on the seed, doc_id and text only; equal rows are interchangeable. Null ids are ids like
    others; documents without words take nothing; no rows give no rows; other columns are ignored.
    """
    source = F.col("source")
    # Written once: words are counted once, and what follows reads a few numbers a document.
    rows = docs.select(
        "doc_id", F.struct(F.lit(0), *keep).alias("kept"), words(F.col("text")).alias("size"), source,
        F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source.cast("string"), F.lit(""))).alias("skey"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).alias("h"),
    )
    rows = cut(rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int")))
    goal = targets(rows, weights, share, cap, floor)
    goal = goal.withColumn("want", F.round("target").cast("long")).withColumn("passes", F.expr("if(source_size = 0, 0L, want div source_size)")).withColumn("rest", F.expr("if(source_size = 0, 0L, want % source_size)"))
    # Running sums in each source's order, in pieces: a bucket's start from the totals of those before it, then inside the bucket.
    upto = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    filled = F.col("size") > 0
    starts = (
        rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.count_if(filled).alias("n"))
        .select("skey", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("word0"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("rank0"),
                F.sum("n").over(W.partitionBy("skey")).alias("filled"))
    )
    inside = W.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        rows.join(starts.join(goal.drop("source"), "skey"), ["skey", "bucket"])
        .withColumn("begin", F.col("word0") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("rank", F.col("rank0") + F.sum(filled.cast("long")).over(inside) - 1)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begin"))))
    )
    quotas = placed.groupBy("skey").agg(F.sum(F.when(filled, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(0)).alias("blocks"))
    begins = split_tree(quotas, n_shards, seed)
    # A block's rank: a document's first whole pass, its second, then the part; the last shard that begins at or before it holds it.
    ranks = "transform(sequence(0L, passes - if(part > 0, 0L, 1L)), p -> p * filled + rank)"
    shards = F.expr(f"if(size = 0 or passes + if(part > 0, 1, 0) = 0, cast(array() as array<int>), transform({ranks}, r -> cast(size(filter(begins, b -> b <= r)) - 1 as int)))")
    return placed.join(begins, "skey").select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"), shards.alias("shards"), *[F.col("kept")[c].alias(c) for c in keep],
    )


def mixed_rows(mixed: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: a row for each block, with its shard and ``at``, the hash that orders blocks inside their shard."""
    rows = mixed.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards")
    return rows.withColumn("at", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size"), F.col("copy")))
