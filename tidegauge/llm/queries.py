"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, fingerprints, infill, mixing, neighbours, ngrams, packing, quality, resampling, sharding, suffixes, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs).drop("text")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=8)


def op4_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_text")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_fingerprinted(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restore(infill.transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngrams": op1_ngrams,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_suffixes": op5_suffixes,
    "op6_mixing": op6_mixing,
    "op7_chunks": op7_chunks,
    "op8_neighbours": op8_neighbours,
    "op9_fingerprints": op9_fingerprints,
    "op10_chat": op10_chat,
    "op11_toxicity": op11_toxicity,
    "op12_infill": op12_infill,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}



def _half_byte(x: int) -> int:
    """What four bits add to a CRC32, whose polynomial this is, bits reversed."""
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


ORACLES = {
    # Shingles of each distinct text, pairs of texts by what they share, and what can be reached by links.
    "op1_ngrams": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        t as (select w, min(doc_id) as node from d group by w),
        g as (select node, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from t),
        n as (select node, cast(len(s) as bigint) as n from g),
        i as (select s, row_number() over () as id from (select unnest(s) as s from g) group by s having count(*) > 1),
        k as (select node, id from (select node, unnest(s) as s from g) join i using (s)),
        p as (select x.node as a, y.node as b, count(*) as common from k x join k y on x.id = y.id and x.node < y.node group by all),
        l as (select a, b from p join n x on x.node = a join n y on y.node = b where 100 * common >= 90 * (x.n + y.n - common)),
        e as (select a, b from l union all select b, a from l),
        c as (select node, node as other from n union select c.node, e.b from c join e on c.other = e.a),
        m as (select node, min(other) as component from c group by node)
        select d.doc_id, n.n as n_shingles, case when n.n = 0 then d.doc_id else m.component end as component_id
        from d join t using (w) join n using (node) join m using (node)""",
    # The CRC is taken half byte by half byte, the lower one of a byte first.
    "op3_sharding": rf"""
        with d as (select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g') as digits from documents),
        r as (select doc_id, size, xor(4294967295, list_reduce(list_transform(regexp_extract_all(digits, '.'), lambda x: cast('0x' || x as bigint)),
                lambda c, x: xor(c >> 4, list_extract({[_half_byte(x) for x in range(16)]}, 1 + (xor(c, x) & 15))), cast(4294967295 as bigint))) as text_crc32 from d),
        p as (select *, cast(sum(size) over (order by doc_id nulls last, text_crc32, size rows unbounded preceding) as bigint) - size as start_byte, cast(sum(size) over () as bigint) as total from r),
        s as (select *, cast((2 * start_byte + size) * 8 // (2 * total) as int) as shard from p)
        select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by start_byte) - 1 as slot, cast(null as int) as grown_shard, start_byte from s""",
    # Strings of 50 bytes with the smallest document of each; runs of what they cover; what is left between runs.
    "op5_suffixes": r"""
        with d as (select doc_id, encode(coalesce(text, '')) as b, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
        q as (select doc_id, i, array_slice(b, i, i + 49) as s from (select doc_id, b, unnest(range(1, n - 48)) as i from d)),
        m as (select s, min(doc_id) as least from q group by s having min(doc_id) < max(doc_id)),
        h as (select doc_id, i from q join m using (s) where doc_id > least),
        r as (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as run
              from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from h)),
        y as (select doc_id, min(i) as a, max(i) + 49 as z from r group by doc_id, run),
        g as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as f, a - 1 as t from y
              union all select doc_id, coalesce(max(z), 0) + 1, n from d left join y using (doc_id) group by doc_id, n),
        k as (select doc_id, string_agg(case when f <= t then hex(array_slice(b, f, t)) else '' end, '' order by f) as kept from g join d using (doc_id) group by doc_id),
        v as (select doc_id, cast(sum(z - a + 1) as bigint) as n_removed, count(*) as n_spans from y group by doc_id)
        select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256
        from d join k using (doc_id) left join v using (doc_id)""",
    "op10_chat": r"""
        with t as (select conv_id, turn, case when role is null then 'unknown' when regexp_matches(role, '^unknown_*\z') then role || '_' else role end as speaker, replace(coalesce(text, ''), '<|', '< |') as said from conversations),
        n as (select *, replace(regexp_replace(speaker, '[\x00-\x1F\x7F' || chr(133) || chr(8232) || chr(8233) || ']+', ' ', 'g'), '<|', '< |') as name from t),
        p as (select distinct conv_id as c, speaker as perspective from t where speaker <> 'system')
        select conv_id, perspective, turn, speaker,
               '<|im_start|>' || case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user name=' || name end
                 || chr(10) || said || '<|im_end|>' || chr(10) as rendered,
               coalesce(speaker = perspective, false) as train, cast(length(said) as bigint) as n_chars
        from n left join p on n.conv_id is not distinct from p.c""",
    # Cuts, then the parts in their order. What is rebuilt is the text itself.
    "op12_infill": r"""
        with d as (select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        k as (select *, cast('0x' || h[1:8] as bigint) % (n + 1) as u, cast('0x' || h[9:16] as bigint) % (n + 1) as v, cast('0x' || h[17:24] as bigint) % 100 as rate, cast('0x' || h[25:32] as bigint) % 100 as first from d),
        f as (select *, least(u, v) as a, greatest(u, v) as z, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or rate >= 90 then 'plain' when first < 20 then 'spm' else 'psm' end as form from k),
        p as (select *, substring(t, 1, a) as p, substring(t, a + 1, z - a) as m, substring(t, z + 1, n - z) as s from f)
        select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then z - a end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
        from p""",
    # The CRC of each distinct feature is taken half byte by half byte, as for op3.
    "op13_resampling": rf"""
        with words as (select 0 as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
            union all select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
        f as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words),
        g as (select side, id, f, count(*) as c from f group by all),
        x as (select f, xor(4294967295, list_reduce(list_transform(regexp_extract_all(regexp_replace(hex(encode(f)), '(.)(.)', '\2\1', 'g'), '.'), lambda x: cast('0x' || x as bigint)),
                lambda c, x: xor(c >> 4, list_extract({[_half_byte(x) for x in range(16)]}, 1 + (xor(c, x) & 15))), cast(4294967295 as bigint))) % 10000 as b from (select distinct f from g)),
        b as (select side, id, b, sum(c) as c from g join x using (f) group by all),
        s as (select b, coalesce(sum(c) filter (side = 0), 0)::double as s, coalesce(sum(c) filter (side = 1), 0)::double as t from b group by b),
        n as (select sum(s) as s, sum(t) as t from s),
        y as (select s.b, cast(floor(1000 * ln((s.t + 1) * (n.s + 10000) / ((s.s + 1) * (n.t + 10000)))) as bigint) as gain from s, n),
        m as (select id as doc_id, cast(sum(c) as bigint) as n_features, cast(sum(c * gain) as bigint) as total from b join y using (b) where side = 0 group by id),
        w as (select w.id as doc_id, len(w.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(case when total >= 0 then total // n_features else -((n_features - 1 - total) // n_features) end, 0) as weight,
                cast('0x' || sha256('7:' || coalesce(cast(w.id as varchar), ''))[1:8] as bigint) as h from words w left join m on m.doc_id = w.id where w.side = 0),
        z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from w),
        r as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from z where n_words >= 20)
        select z.doc_id, cast(z.n_features as bigint) as n_features, cast(z.weight as bigint) as weight, z.score, case when r.r <= r.n * 25 // 100 then r.r end as rank from z left join r using (doc_id)""",
}
