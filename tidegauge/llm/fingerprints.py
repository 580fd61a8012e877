"""Document fingerprints by consistent weighted sampling.

A document's weighted terms are its word pairs with their counts. For each of the signature's samples a
term draws r and c from Gamma(2, 1) and b from (0, 1), all from a hash of term and sample alone; with
t = floor(ln w / r + b) it scores ln c - r (t - b + 1), and the lowest score's (term, t) is the sample.
Two documents agree on a sample with the probability of their generalised Jaccard similarity, the sum of
the smaller weights over the sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

SAMPLES = 16
#: Bits of a sample in the fingerprint; the rest of a long orders the scores.
BITS = 24


def terms(text: Column) -> Column:
    """Hashes of all pairs of neighbouring words, sorted; a single word is a term itself."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _sample(j: int) -> Column:
    """Score and identity of sample ``j`` in one long, lowest score first."""
    h1 = F.xxhash64(F.col("term"), F.lit(j))
    h2 = F.xxhash64(h1)
    def u(h: Column, shift: int, bits: int) -> Column:
        return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)
    r = -F.ln(u(h1, 32, 32) * u(h1, 0, 32))
    c = -F.ln(u(h2, 40, 24) * u(h2, 16, 24))
    b = u(h2, 0, 16)
    t = F.floor(F.col("lnw") / r + b)
    score = F.ln(c) - r * (t - b + 1)
    # Scores lie between -1e4 and 1e4; 39 bits order them to about 4e-8.
    rank = F.greatest(F.lit(0.0), F.least(F.lit(2.0), score / 1e4 + 1)) * float(1 << 37)
    ident = F.shiftrightunsigned(h1, 17).bitwiseXOR(F.shiftleft(t, 3)).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.shiftleft(rank.cast("long"), BITS).bitwiseOR(ident)


def signatures(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, for each text column, ``<column>_fp``: the hex fingerprint of its text, null without words.

    Terms are exploded and their scores reduced by ``min`` in the tasks that read them, so what is
    shuffled is one row a text. Rows with equal keys must have equal texts. A row stays even if no text
    has words.
    """
    which = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.coalesce(F.col(c), F.lit("")).alias("text")) for k, c in enumerate(columns)]))
    rows = texts.select(*keys, which.alias("x")).select(*keys, "x.which", terms(F.col("x.text")).alias("h"))
    pairs = F.when(F.size("h") < 2, F.col("h")).otherwise(F.sort_array(F.zip_with(F.slice("h", F.lit(1), F.size("h") - 1), F.slice("h", F.lit(2), F.size("h") - 1), lambda a, b: F.xxhash64(a, b))))
    # A term's weight is the length of its run in the sorted hashes.
    rows = rows.select(*keys, "which", pairs.alias("s")).withColumn("at", F.expr("filter(transform(s, (x, i) -> if(x <=> get(s, i - 1), -1, i)), i -> i >= 0)"))
    each = F.expr("explode_outer(transform(at, (i, k) -> named_struct('term', s[i], 'w', coalesce(get(at, k + 1), size(s)) - i)))")
    rows = rows.select(*keys, "which", each.alias("x")).select(*keys, "which", F.col("x.term").alias("term"), F.ln(F.col("x.w").cast("double")).alias("lnw"))
    low = rows.groupBy(*keys, "which").agg(*[F.min(F.when(F.col("term").isNotNull(), _sample(j))).alias(f"s{j}") for j in range(samples)])
    mask = F.lit((1 << BITS) - 1)
    fp = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"s{j}").bitwiseAND(mask))), BITS // 4, "0") for j in range(samples)])
    return low.select(*keys, "which", fp.alias("fp")).groupBy(*keys).agg(*[F.max(F.when(F.col("which") == k, F.col("fp"))).alias(f"{c}_fp") for k, c in enumerate(columns)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints, in [0, 1]."""
    k = BITS // 4
    same = [(F.substring(a, 1 + k * j, k) == F.substring(b, 1 + k * j, k)).cast("int") for j in range(samples)]
    return sum(same[1:], same[0]) / float(samples)


def next_documents(docs: DataFrame) -> DataFrame:
    """The key (h1, h2) of each distinct row's follower in descending doc_id, as (n1, n2); the last is followed by the first.

    Ids and keys alone are range-partitioned; a partition's last row takes the first row of the next one.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h1"), F.col("h2")]
    ids = docs.select("doc_id", "h1", "h2", F.length("text").alias("n")).distinct()
    laid = cut(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    me = F.struct("h1", "h2")
    inside = W.partitionBy("part").orderBy(*order)
    # One row a partition.
    firsts = laid.withColumn("k", F.row_number().over(inside)).filter("k = 1").select("part", me.alias("first"))
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(W.orderBy("part")), F.first("first").over(whole)).alias("after"))
    rows = laid.withColumn("next", F.lead(me).over(inside)).join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "after"))
    return cut(rows.select("h1", "h2", F.col("next.h1").alias("n1"), F.col("next.h2").alias("n2"), "n"))


def edited_and_fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row a document.

    The edited text is the document without its last floor(n_chars / 2) code points and with as many
    of the next document's first ones (all, where it has fewer). Rows with the same id and text are one
    document in the order and each get its result. Null texts are empty; empty texts share one
    fingerprint and are alike; a null id comes last. No rows give no rows; other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    key = ["h1", "h2"]
    after = next_documents(base)
    before = after.select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), F.col("n1").alias("h1"), F.col("n2").alias("h2"), "n")
    # Each document's start goes to the one before it; repeated rows send the same start.
    tails = base.select(*key, "text").join(before, key).select(F.col("of1").alias("h1"), F.col("of2").alias("h2"), F.col("n"), F.expr("substring(text, 1, n div 2)").alias("tail"))
    tails = tails.groupBy(*key).agg(F.first("n").alias("n"), F.first("tail").alias("tail"))
    both = base.select(*key, "text").join(tails, key).select(*key, "n", "text", F.expr("concat(substring(text, 1, n - n div 2), tail)").alias("edited"))
    # A digest is carried through as four longs, next to the scores that min reduces.
    sha = F.sha2("edited", 256)
    sums = [F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"d{k}") for k in range(4)]
    carried = [*key, "n", *[f"d{k}" for k in range(4)]]
    low = signatures(both.select(*key, "n", *sums, "text", "edited"), carried, ["text", "edited"], samples)
    none = F.lit("-" * (BITS // 4 * samples))
    digest = F.lower(F.concat(*[F.lpad(F.hex(f"d{k}"), 16, "0") for k in range(4)]))
    fps = cut(low.select(*key, "n", digest.alias("edited_sha256"), F.coalesce("text_fp", none).alias("fingerprint"), F.coalesce("edited_fp", none).alias("edited_fingerprint")))
    chain = after.join(fps.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("fingerprint").alias("next_fp")), ["n1", "n2"]).select(*key, "next_fp")
    rows = base.select("doc_id", *key).join(fps, key).join(chain, key)
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp"), samples).alias("near_next"),
    )
