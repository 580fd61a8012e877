"""Queries over the tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import WaveformConfig
from .engine import Engine
from .functions import arrays as A
from .functions import serde
from .functions.scalar import clamp01, curve, display_resolution, duration_ms, duration_text, duration_us, progress_text, seek_position, size_text
from .operators import bins as B
from .operators import configured
from .operators import geometry as G
from .operators import samples as ST
from .operators import stats as S
from .operators.ordered import Ordered, shared_path
from .operators.signals import Signals, waveform_array
from .plans import files as P
from .sources import flac, headers, wav
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# --- signals

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def event_frames(spark, d) -> DataFrame:
    return B.frames(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value")


def line_frames(spark, d) -> DataFrame:
    return B.frames(table(spark, d, "lineitem"), "l_suppkey", LINE_ORDER, "l_extendedprice")


EVENTS = "fr as (select event_type as track, row_number() over (partition by event_type order by ts, event_id) - 1 as frame, count(*) over (partition by event_type) as frames, cast(value as double) as v from events)"
LINES = f"fr as (select l_suppkey as track, row_number() over (partition by l_suppkey order by {', '.join(LINE_ORDER)}) - 1 as frame, count(*) over (partition by l_suppkey) as frames, cast(l_extendedprice as double) as v from lineitem)"
SQL_OF = {"rms": "sqrt(avg(v * v))", "peak": "max(case when not isnan(v) then abs(v) end)", "average": "avg(abs(v))", "median": "median(abs(v))"}


def sql_bins(r: int, source: str = EVENTS, of: str = "rms") -> str:
    """CTEs that end in bins(track, bin, amp)."""
    return f"{source}, {sql_after(r, of)}"


def sql_after(r: int, of: str = "rms") -> str:
    return f"""
        g as (select *, cast(frames as double) / {r} as s, ((frame + 1) * {r} - 1) // frames as k0 from fr),
        h as (select *, case when frame < floor(k0 * s) then k0 - 1 when frame >= floor((k0 + 1) * s) then k0 + 1 else k0 end as k from g),
        bins as (select track, cast(k as bigint) as bin, {SQL_OF[of]} as amp from h where k < {r} group by 1, 2)"""


SQL_PEAK = "norm as (select track, bin, case when max(amp) over (partition by track) = 0 then 0.0 else amp / max(amp) over (partition by track) end as amp from {})"
SQL_RMS = "norm as (select track, bin, case when sqrt(avg(amp * amp) over (partition by track)) = 0 then 0.0 else amp / sqrt(avg(amp * amp) over (partition by track)) end as amp from {})"
SQL_CURVE = {"linear": "amp * {f}", "logarithmic": "case when amp > 0 then ln(1 + 9 * amp) / ln(10) * {f} else 0.0 end", "exponential": "amp * amp * {f}", "sqrt": "sqrt(amp) * {f}"}


def sql_smooth(k: int, source: str = "bins", name: str = "sm") -> str:
    return f"{name} as (select track, bin, avg(amp) over (partition by track order by bin rows between {k // 2} preceding and {k // 2} following) as amp from {source})"


def sql_clamp(x: str) -> str:
    return f"case when isnan({x}) then {x} else greatest(0.0, least(1.0, {x})) end"


for _a in ("rms", "peak", "average", "median"):
    query(f"down_{_a}", f"with {sql_bins(100, EVENTS, _a)} select track, bin, round(amp, 6) as amp from bins")(
        lambda s, d, a=_a: rounded(B.downsample(event_frames(s, d), 100, a), "amp"))
    query(f"down_lines_{_a}", f"with {sql_bins(50, LINES, _a)} select track, bin, round(amp, 6) as amp from bins")(
        lambda s, d, a=_a: rounded(B.downsample(line_frames(s, d), 50, a), "amp"))

_ODD = f"with {sql_bins(49, EVENTS.replace('event_type', 'user_id'))} select track, bin, round(amp, 6) as amp from bins where track in (select track from fr where frames > 49) union all select track, cast(frame as bigint) as bin, round(v, 6) as amp from fr where frames <= 49"
query("down_odd_resolution", _ODD)(lambda s, d: rounded(B.downsample(B.frames(table(s, d, "events"), "user_id", ["ts", "event_id"], "value"), 49, "rms"), "amp"))


def _of_all(spark, d) -> DataFrame:
    """Bins by all four algorithms; frames are numbered once, where Spark reuses the exchange."""
    framed = B.frames(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    parts = [rounded(B.downsample(framed, 49, a), "amp").select(F.lit(a).alias("algorithm"), "track", "bin", "amp") for a in B.OF]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


query("down_odd_resolution_all", " union all ".join(f"(select '{a}' as algorithm, * from ({_ODD.replace(SQL_OF['rms'] + ' as amp', SQL_OF[a] + ' as amp')}))" for a in SQL_OF))(_of_all)
query("median_exact", "select l_returnflag, l_linestatus, round(median(l_extendedprice * (1 - l_discount)), 6) as median from lineitem group by 1, 2")(
    lambda s, d: rounded(B.exact_median(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice") * (1 - F.col("l_discount"))), "median"))

EMB = "em as (select vec_id as track, cast(embedding as double[]) as a from embeddings)"
EMB_LONG = f"{EMB}, lo as (select track, unnest(range(len(a))) as i, unnest(a) as x, len(a) as n from em)"


def emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.col("embedding").cast("array<double>").alias("a"))


def spread(df: DataFrame, of: Column) -> DataFrame:
    """track, bin, amp of an array column."""
    return df.select("track", F.posexplode(of).alias("bin", "amp")).select("track", F.col("bin").cast("long").alias("bin"), r6("amp").alias("amp"))


query("down_passthrough", f"with {EMB_LONG} select track, cast(i as bigint) as bin, round(x, 6) as amp from lo")(
    lambda s, d: spread(emb(s, d), A.downsample(F.col("a"), 100, "rms", 2)))
query("down_zero_fill", f"""with {EMB_LONG}, fr as (select track, i // 2 as frame, 32 as frames, avg(x) as v from lo group by 1, 2), {sql_after(40)}
    select e.track, cast(b.b as bigint) as bin, coalesce(round(amp, 6), 0.0) as amp from em e cross join (select unnest(range(40)) as b) b left join bins on bins.track = e.track and bins.bin = b.b""")(
    lambda s, d: rounded(Signals.arrays(emb(s, d), "track", "a", 2).downsample(40, "rms", "zero_fill").bins, "amp"))
query("down_array", f"""with {EMB_LONG}, fr as (select track, i as frame, n as frames, x as v from lo), {sql_after(10, 'median')} select track, bin, round(amp, 6) as amp from bins""")(
    lambda s, d: spread(emb(s, d), A.downsample(F.col("a"), 10, "median")))
query("mixdown_stereo", f"with {EMB_LONG} select track, cast(i // 2 as bigint) as bin, round(avg(x), 6) as amp from lo group by 1, 2")(
    lambda s, d: spread(emb(s, d), A.mixdown(F.col("a"), 2)))
query("mixdown_odd", f"with {EMB_LONG} select track, cast(i // 3 as bigint) as bin, round(avg(x), 6) as amp from lo where i // 3 < n // 3 group by 1, 2")(
    lambda s, d: spread(emb(s, d), A.mixdown(F.col("a"), 3)))

# --- plain aggregates

CUST = "select c_nationkey, {} from customer group by 1"
for _name, _agg, _sql in (
    ("agg_rms", lambda v: {"rms": B.rms(v)}, "round(sqrt(avg(c_acctbal * c_acctbal)), 6) as rms"),
    ("agg_peak", lambda v: {"peak": B.peak(v)}, "round(max(abs(c_acctbal)), 6) as peak"),
    ("agg_rms_peak", lambda v: {"rms": B.rms(v), "peak": B.peak(v)}, "round(sqrt(avg(c_acctbal * c_acctbal)), 6) as rms, round(max(abs(c_acctbal)), 6) as peak"),
    ("agg_mean_abs", lambda v: {"average": B.average(v)}, "round(avg(abs(c_acctbal)), 6) as average"),
    ("agg_median_abs", lambda v: {"median": B.median(v)}, "round(median(abs(c_acctbal)), 6) as median"),
):
    query(_name, CUST.format(_sql))(lambda s, d, f=_agg: table(s, d, "customer").groupBy("c_nationkey").agg(*[r6(c).alias(n) for n, c in f(F.col("c_acctbal")).items()]))

# --- steps after binning


def event_bins(spark, d, r: int = 100, of: str = "rms") -> DataFrame:
    return B.downsample(event_frames(spark, d), r, of)


query("norm_peak", f"with {sql_bins(100)}, {SQL_PEAK.format('bins')} select track, bin, round(amp, 6) as amp from norm")(lambda s, d: rounded(B.normalize(event_bins(s, d)), "amp"))
query("norm_rms", f"with {sql_bins(100)}, {SQL_RMS.format('bins')} select track, bin, round(amp, 6) as amp from norm")(lambda s, d: rounded(B.normalize(event_bins(s, d), "rms"), "amp"))
query("norm_zero", f"with {sql_bins(100)} select track, bin, 0.0 as amp from bins")(lambda s, d: B.normalize(event_bins(s, d).withColumn("amp", F.lit(0.0))))
query("norm_signed", f"with {EMB_LONG} select track, cast(i as bigint) as bin, round(x / max(x) over (partition by track), 6) as amp from lo")(lambda s, d: spread(emb(s, d), A.normalize(F.col("a"))))
for _c, _f in (("linear", 1.5), ("logarithmic", 1.0), ("exponential", 1.0), ("sqrt", 1.0)):
    query(f"scale_{_c}", f"with {sql_bins(100)}, {SQL_PEAK.format('bins')} select track, bin, round({sql_clamp(SQL_CURVE[_c].format(f=_f))}, 6) as amp from norm")(
        lambda s, d, c=_c, f=_f: rounded(B.normalize(event_bins(s, d)).withColumn("amp", curve(F.col("amp"), c, f)), "amp"))
for _k in (3, 5):
    query(f"smooth_k{_k}", f"with {sql_bins(100)}, {sql_smooth(_k)} select track, bin, round(amp, 6) as amp from sm")(lambda s, d, k=_k: rounded(B.smooth(event_bins(s, d), k), "amp"))
query("smooth_array", f"with {EMB_LONG}, bins as (select track, i as bin, x as amp from lo), {sql_smooth(7)} select track, cast(bin as bigint) as bin, round(amp, 6) as amp from sm")(lambda s, d: spread(emb(s, d), A.smooth(F.col("a"), 7)))

SQL_TOP = "top as (select * from (select track, bin, amp, lag(amp) over w as p, lead(amp) over w as n from {} window w as (partition by track order by bin)) where amp > {} and amp > p and amp > n)"
query("peaks_basic", f"with {sql_bins(100)}, {SQL_TOP.format('bins', 0.1)} select track, bin, round(amp, 6) as amp from top")(lambda s, d: rounded(B.peaks(event_bins(s, d), 0.1), "amp"))
query("peaks_min_distance", f"""with recursive {EMB_LONG}, bins as (select track, i as bin, x as amp from lo), {SQL_TOP.format('bins', 0.05)},
    walk as (select track, min(bin) as bin from top group by track union all select t.track, (select min(u.bin) from top u where u.track = t.track and u.bin >= t.bin + 5) from walk t where t.bin is not null)
    select track, cast(bin as bigint) as bin from walk where bin is not null""")(
    lambda s, d: emb(s, d).select("track", F.explode(A.peaks(F.col("a"), 0.05, 5)).alias("bin")).select("track", F.col("bin").cast("long").alias("bin")))
# Maxima of a user's own values, 4 or more frames apart: signals as long as they are.
query("peaks_long", f"""with recursive {EVENTS.replace('event_type', 'user_id')}, bins as (select track, frame as bin, v as amp from fr), {SQL_TOP.format('bins', 20.0)},
    walk as (select track, min(bin) as bin from top group by track union all select t.track, (select min(u.bin) from top u where u.track = t.track and u.bin >= t.bin + 4) from walk t where t.bin is not null)
    select track, cast(bin as bigint) as bin from walk where bin is not null""")(
    lambda s, d: B.spaced_peaks(B.frames(table(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("track", F.col("frame").alias("bin"), F.col("v").alias("amp")), 20.0, 4))


def sql_pipeline(c: WaveformConfig) -> str:
    parts, last = [sql_bins(c.resolution, EVENTS, c.algorithm)], "bins"
    if c.smooth:
        parts.append(sql_smooth(c.window, last))
        last = "sm"
    if c.normalize:
        parts.append((SQL_PEAK if c.normalization == "peak" else SQL_RMS).format(last))
        last = "norm"
    amp = sql_clamp(SQL_CURVE[c.curve].format(f=c.factor)) if c.scales else "amp"
    return f"with {', '.join(parts)} select track, bin, round({amp}, 6) as amp from {last}"


for _n, _case in (("music", "musicVisualization"), ("speech", "speechAnalysis"), ("peak", "peakDetection"), ("memory", "memoryEfficient")):
    _cfg = WaveformConfig.preset(_case, {"music": 100, "speech": 80, "peak": 60, "memory": 40}[_n])
    query(f"pipeline_{_n}", sql_pipeline(_cfg))(lambda s, d, c=_cfg: rounded(Signals(event_frames(s, d)).waveform(c).bins, "amp"))
FLAGSHIP = WaveformConfig(100, smooth=True, window=5, curve="logarithmic")
query("wf_rms_events", sql_pipeline(FLAGSHIP))(lambda s, d: rounded(Signals(event_frames(s, d)).waveform(FLAGSHIP).bins, "amp"))
query("wf_rms_events_long", sql_pipeline(FLAGSHIP))(lambda s, d: rounded(Signals(B.frames(table(s, d, "events").withColumn("at", F.col("ts").cast("string")), "event_type", ["at", "event_id"], "value")).waveform(FLAGSHIP).bins, "amp"))
query("wf_array", f"""with {EMB_LONG}, fr as (select track, i as frame, n as frames, x as v from lo), {sql_after(16)}, {SQL_PEAK.format('bins')}
    select track, bin, round({sql_clamp('sqrt(amp)')}, 6) as amp from norm""")(lambda s, d: spread(emb(s, d), waveform_array(F.col("a"), WaveformConfig(16, curve="sqrt"))))

ARRAY_STEPS = WaveformConfig(16, smooth=True, window=5, curve="logarithmic", factor=1.2)
query("wf_array_smooth", sql_pipeline(ARRAY_STEPS).replace(sql_bins(16), f"{EMB_LONG}, fr as (select track, i as frame, n as frames, abs(x) as v from lo), {sql_after(16)}"))(
    lambda s, d: spread(emb(s, d), waveform_array(F.transform("a", lambda x: F.abs(x)), ARRAY_STEPS)))

# --- a configuration for each track

CONFIGS = """cf as (select c_custkey as track, cast(10 + c_nationkey as int) as resolution, (['rms', 'peak', 'average', 'median'])[c_custkey % 4 + 1] as algorithm, (cast([null, 3, 5] as int[]))[c_nationkey % 3 + 1] as w,
    ([null, 'peak', 'rms'])[c_custkey % 3 + 1] as normalization, (['linear', 'logarithmic', 'exponential', 'sqrt', null])[c_custkey % 5 + 1] as curve, 1 + c_nationkey / 50.0::double as factor from customer)"""


def configs(spark, d) -> DataFrame:
    """Customers as configurations of the users that have their number."""
    pick = lambda of, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (of + 1).cast("int"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        k.alias("track"), (n + 10).cast("int").alias("resolution"), pick(k % 4, "rms", "peak", "average", "median").alias("algorithm"), pick(n % 3, None, 3, 5).cast("int").alias("window"),
        pick(k % 3, None, "peak", "rms").alias("normalization"), pick(k % 5, "linear", "logarithmic", "exponential", "sqrt", None).alias("curve"), (1 + n / 50).alias("factor"))


query("configured_tracks", f"""with {EVENTS.replace('event_type', 'user_id')}, {CONFIGS},
    g as (select fr.*, cf.resolution as r, algorithm, cast(frames as double) / cf.resolution as s, ((frame + 1) * cf.resolution - 1) // frames as k0 from fr join cf using (track)),
    h as (select *, case when frames <= r then frame when frame < floor(k0 * s) then k0 - 1 when frame >= floor((k0 + 1) * s) then k0 + 1 else k0 end as k from g),
    b as (select track, cast(k as bigint) as bin, case when any_value(frames <= r) then any_value(v) when any_value(algorithm) = 'rms' then {SQL_OF['rms']} when any_value(algorithm) = 'peak' then {SQL_OF['peak']} when any_value(algorithm) = 'average' then {SQL_OF['average']} else {SQL_OF['median']} end as amp from h where frames <= r or k < r group by 1, 2),
    l as (select track, list(bin order by bin) as bins, list(amp order by bin) as a from b group by 1),
    m as (select l.track, l.bins, cf.*, case when w is null then a else list_transform(range(1, len(a) + 1), lambda i: list_avg(a[greatest(1, i - w // 2):least(len(a), i + w // 2)])) end as a from l join cf on cf.track = l.track),
    n as (select *, case normalization when 'peak' then list_max(a) when 'rms' then sqrt(list_avg(list_transform(a, lambda x: x * x))) end as unit from m),
    o as (select track, curve, factor, unnest(bins) as bin, unnest(case when unit is null then a when unit = 0 then list_transform(a, lambda x: 0.0) else list_transform(a, lambda x: x / unit) end) as amp from n)
    select track, bin, round(case curve when 'linear' then {sql_clamp(SQL_CURVE['linear'].format(f='factor'))} when 'logarithmic' then {sql_clamp(SQL_CURVE['logarithmic'].format(f='factor'))} when 'exponential' then {sql_clamp(SQL_CURVE['exponential'].format(f='factor'))} when 'sqrt' then {sql_clamp(SQL_CURVE['sqrt'].format(f='factor'))} else amp end, 6) as amp from o""")(
    lambda s, d: rounded(configured.waveforms(B.frames(table(s, d, "events"), "user_id", ["ts", "event_id"], "value"), configs(s, d)), "amp"))

SHAKY = """sh as (select c_custkey as track, cast(c_nationkey - 1 as int) as resolution, (['rms', 'peak', 'loudest', 'median'])[c_custkey % 4 + 1] as algorithm, cast(case when c_custkey % 6 > 0 then c_nationkey % 8 + 1 end as int) as w,
    ([null, 'peak', 'sum'])[c_custkey % 3 + 1] as normalization, (['linear', 'cube', 'exponential', null])[c_nationkey % 4 + 1] as curve, round(c_acctbal / 100, 2) as factor from customer)"""


def shaky(spark, d) -> DataFrame:
    """Customers as configurations of which many are wrong."""
    pick = lambda of, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (of + 1).cast("int"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        k.alias("track"), (n - 1).cast("int").alias("resolution"), pick(k % 4, "rms", "peak", "loudest", "median").alias("algorithm"), F.when(k % 6 > 0, n % 8 + 1).cast("int").alias("window"),
        pick(k % 3, None, "peak", "sum").alias("normalization"), pick(n % 4, "linear", "cube", "exponential", None).alias("curve"), F.round(F.col("c_acctbal") / 100, 2).cast("double").alias("factor"))


query("config_problems", f"""with {SHAKY} select track, case when not resolution > 0 then 'resolution' when algorithm = 'loudest' then 'algorithm' when w < 3 or w % 2 = 0 then 'window' when normalization = 'sum' then 'normalization'
    when curve = 'cube' then 'curve' when factor < 0 then 'factor' end as problem from sh""")(
    lambda s, d: shaky(s, d).select("track", configured.problem(*[F.col(c) for c in configured.COLUMNS]).alias("problem")))
query("config_json", f"with {SHAKY} select track, resolution, algorithm, w as window_bins, normalization, curve, factor from sh")(
    lambda s, d: configured.from_json(configured.to_json(shaky(s, d))).withColumnRenamed("window", "window_bins"))

# --- display

SQL_GROUPS = "gr as (select e.track, t.t as bin, unnest(list_slice(a, cast(floor(t.t * (64.0 / {0})) as int) + 1, cast(least(ceil((t.t + 1) * (64.0 / {0})), 64) as int))) as x from em e cross join (select unnest(range({0})) as t) t)"
for _m, _sql in (("max", "max(x)"), ("minMax", "max(x)"), ("rms", "sqrt(avg(x * x))"), ("average", "avg(x)")):
    query(f"disp_down_{_m.lower()}", f"with {EMB}, {SQL_GROUPS.format(10)} select track, cast(bin as bigint) as bin, round({_sql}, 6) as amp from gr group by 1, 2")(
        lambda s, d, m=_m: spread(emb(s, d), A.resample(F.col("a"), 10, m)))
SQL_UP = f"""with {EMB}, p as (select track, a, t.t as i, t.t * (63.0 / 149) as pos from em cross join (select unnest(range(150)) as t) t),
    q as (select *, least(cast(floor(pos) as int), 63) as lo, least(cast(floor(pos) as int) + 1, 63) as hi from p)
    select track, cast(i as bigint) as bin, round(a[lo + 1] + (a[hi + 1] - a[lo + 1]) * (pos - lo), 6) as amp from q"""
for _u in ("linear", "cubic"):
    query(f"disp_up_{_u}", SQL_UP)(lambda s, d, u=_u: spread(emb(s, d), A.resample(F.col("a"), 150, "max", u)))
query("disp_up_repeat", f"with {EMB} select track, cast(t.t as bigint) as bin, round(a[cast(floor(t.t * 64 / 150.0) as int) + 1], 6) as amp from em cross join (select unnest(range(150)) as t) t")(
    lambda s, d: spread(emb(s, d), A.resample(F.col("a"), 150, "max", "repeat")))
query("disp_equal", f"with {EMB_LONG} select track, cast(i as bigint) as bin, round(x, 6) as amp from lo")(lambda s, d: spread(emb(s, d), A.resample(F.col("a"), 64)))


def _widths(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 800 - 5).cast("double").alias("w"))


query("display_resolution", """with w as (select c_custkey as k, cast(c_custkey % 800 - 5 as double) as w from customer)
    select k, cast(case when w > 0 then greatest(1, floor(w / 4)) else 0 end as bigint) as bars, cast(case when w > 0 then greatest(1, floor(w / 8)) else 0 end as bigint) as wide,
           cast(case when w > 0 then greatest(1, round(w / 100)) else 0 end as bigint) as line, cast(case when w > 0 then greatest(1, round(w * 0.5)) else 0 end as bigint) as filled from w""")(
    lambda s, d: _widths(s, d).select("k", display_resolution(F.col("w"), "bars").alias("bars"), display_resolution(F.col("w"), "bars", 6, 2).alias("wide"), display_resolution(F.col("w"), "line").alias("line"), display_resolution(F.col("w"), "filled").alias("filled")))
query("seek_position", "with w as (select c_custkey as k, c_acctbal as x, cast(c_custkey % 800 - 5 as double) as w from customer) select k, round(case when w > 0 then greatest(0.0, least(1.0, x / w)) else 0 end, 6) as at from w")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"), r6(seek_position(F.col("c_acctbal"), (F.col("c_custkey") % 800 - 5).cast("double"))).alias("at")))

PB = f"with {sql_bins(100)}, {SQL_PEAK.format('bins')}"


def shown(spark, d) -> DataFrame:
    return B.normalize(event_bins(spark, d))


PLAYED = G.played_width(400.0, 0.35)
query("geom_bars", f"""{PB} select track, bin, 10.0 + bin * 4.0 as x, round(60.0 - h / 2, 6) as top, round(h, 6) as h, bin * 4.0 < {PLAYED} as played
    from (select *, least(120.0, greatest(2.0, greatest(0.0, least(1.0, amp)) * 60.0)) as h from norm)""")(lambda s, d: rounded(G.bars(shown(s, d), 120, PLAYED, 10), "top", "h"))
SQL_PTS = f"{PB}, pts as (select track, bin, 10.0 + bin / 99.0 * 400 as x, 60.0 - greatest(0.0, least(1.0, amp)) * 60.0 as y from norm)"
query("geom_line", f"""{SQL_PTS}, q as (select *, lag(x) over w as px, lag(y) over w as py from pts window w as (partition by track order by bin)),
    c as (select *, x - 10 > {PLAYED} and px is not null and px - 10 <= {PLAYED} as cut from q)
    select track, bin, round(x, 6) as x, round(y, 6) as y, x - 10 <= {PLAYED} as played, case when cut then 10.0 + {PLAYED} end as cut_x, case when cut then round(py + (y - py) * ((10.0 + {PLAYED} - px) / (x - px)), 6) end as cut_y from c""")(
    lambda s, d: rounded(G.line(shown(s, d), 400, 120, PLAYED, 10), "x", "y", "cut_y"))
query("geom_filled", f"{SQL_PTS} select track, bin, round(x, 6) as x, round(y, 6) as y, x - 10 <= {PLAYED} as played from pts")(lambda s, d: rounded(G.filled(shown(s, d), 400, 120, PLAYED, 10), "x", "y"))
query("section_extract", f"with {sql_bins(100)} select track, bin, round(amp, 6) as amp from bins where bin >= round(12.34 / 60 * 100) and bin < round(40.0 / 60 * 100)")(lambda s, d: rounded(B.section(event_bins(s, d), 12.34, 40.0, 60.0), "amp"))
query("section_array", f"with {EMB_LONG} select track, cast(i - 13 as bigint) as bin, round(x, 6) as amp from lo where i >= 13 and i < 43")(
    lambda s, d: spread(emb(s, d), A.section(F.col("a"), F.lit(2.0), F.lit(6.7), F.lit(10.0))))
query("position_changes", """with p as (select event_type as track, event_id as seq, round(least(1.0, value / 100), 1) as position from events), q as (select *, lag(position) over (partition by track order by seq) as b from p)
    select track, seq, position from q where b is null or b <> position""")(
    lambda s, d: G.changes(table(s, d, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("seq"), F.round(clamp01(F.col("value") / 100), 1).alias("position"))))

# --- files, chunks, plans

EXT = ["mp3", "WAV", "flac", "ogg", "Opus", "mp4", "m4a", "xyz", ""]
SQL_PATH = "'/data.v1/' || source || '/' || doc_id || case when doc_id % 9 = 8 then '' else '.' || (['" + "','".join(EXT) + "'])[doc_id % 9 + 1] end"
SQL_EXT = "case when contains(path, '.') then lower(split_part(path, '.', -1)) else '' end"
SQL_FMT = f"case {SQL_EXT} when 'mp3' then 'mp3' when 'wav' then 'wav' when 'flac' then 'flac' when 'ogg' then 'ogg' when 'opus' then 'opus' when 'mp4' then 'mp4' when 'm4a' then 'mp4' else 'unknown' end"
FILES = f"fl as (select doc_id, {SQL_PATH} as path, cast(strlen(text) as bigint) * 4001 as size from documents), fm as (select *, {SQL_FMT} as fmt from fl)"


def files(spark, d) -> DataFrame:
    k = F.col("doc_id") % 9
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT]), (k + 1).cast("int"))
    path = F.concat(F.lit("/data.v1/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(k == 8, "").otherwise(F.concat(F.lit("."), ext)))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), (F.octet_length("text").cast("long") * 4001).alias("size")).withColumn("fmt", P.format_of(F.col("path")))


query("format_detect", f"with {FILES} select doc_id, path, fmt, fmt <> 'unknown' as supported from fm")(lambda s, d: files(s, d).select("doc_id", "path", "fmt", (F.col("fmt") != "unknown").alias("supported")))
query("format_counts", f"with {FILES} select fmt, count(*) as n, cast(sum(size) as bigint) as bytes from fm group by 1")(lambda s, d: files(s, d).groupBy("fmt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
query("extension_supported", f"with {FILES} select doc_id, {SQL_EXT} in ('mp3','wav','flac','ogg','opus','mp4','m4a') as supported from fl")(lambda s, d: files(s, d).select("doc_id", P.extension_supported(F.concat(F.lit("."), P.extension(F.col("path")))).alias("supported")))
query("format_table", f"with {FILES}, t as (select * from (values ('mp3','mp3'),('wav','wav'),('flac','flac'),('ogg','ogg'),('opus','opus'),('mp4','mp4'),('m4a','mp4')) t(extension, format)) select t.extension, t.format, count(*) as n, cast(sum(size) as bigint) as bytes from fl join t on {SQL_EXT} = t.extension group by 1, 2")(
    lambda s, d: files(s, d).withColumn("extension", P.extension(F.col("path"))).join(F.broadcast(P.extensions(s)), "extension").groupBy("extension", "format").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))  # one row an extension
query("file_validate", "select doc_id, case when n = 0 then 'empty' when n < 12 then 'too_small' else 'ok' end as status from (select doc_id, strlen(text) - strlen(text) % 5 - 10 * (doc_id % 2) * (case when strlen(text) < 20 then 1 else 0 end) as n from documents)")(
    lambda s, d: table(s, d, "documents").withColumn("b", F.octet_length("text")).select("doc_id", P.status(F.col("b") - F.col("b") % 5 - 10 * (F.col("doc_id") % 2) * F.when(F.col("b") < 20, 1).otherwise(0)).alias("status")))
query("file_strategy", f"with {FILES} select doc_id, case when size <= 52428800 then 'in_memory' else 'streaming' end as strategy from fl")(lambda s, d: files(s, d).select("doc_id", P.strategy(F.col("size")).alias("strategy")))
query("chunk_plan", f"""with {FILES} select path, cast(i as bigint) as idx, cast(i * 1048576 as bigint) as "offset", cast(least(1048576, size - i * 1048576) as bigint) as length, i = n - 1 as is_last, cast(n as bigint) as total
    from (select *, unnest(range(n)) as i from (select *, cast(ceil(size / 1048576.0) as bigint) as n from fl where size > 0))""")(lambda s, d: P.chunks(files(s, d), 1 << 20).drop("progress"))
query("chunk_progress", f"""with {FILES} select path, cast(i as bigint) as idx, round((i + 1) / n, 6) as progress
    from (select *, unnest(range(n)) as i from (select *, cast(ceil(size / 1048576.0) as bigint) as n from fl where size > 0))""")(lambda s, d: rounded(P.chunks(files(s, d), 1 << 20).select("path", "idx", "progress"), "progress"))
query("chunk_reassemble", "select cast(doc_id as varchar) as path, md5(text) as md5 from documents where strlen(text) > 0")(
    lambda s, d: _reassembled(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"))))


def _reassembled(f: DataFrame) -> DataFrame:
    return P.reassemble(P.with_content(f, 1000)).select("path", F.md5("content").alias("md5"))


RATIO = "case fmt when 'mp3' then 10 when 'ogg' then 8 when 'opus' then 12 when 'flac' then 2 when 'wav' then 1 when 'mp4' then 12 else 10 end"
query("mem_estimate", f"with {FILES} select doc_id, cast(size * {RATIO} as bigint) as decoded, size * {RATIO} > 104857600 as too_large, size * 8 + 1024 as waveform, size * 8 + 2048 as audio from fm")(
    lambda s, d: files(s, d).select("doc_id", P.decoded_bytes(F.col("size"), F.col("fmt")).cast("long").alias("decoded"), P.over_limit(F.col("size"), F.col("fmt")).alias("too_large"), P.waveform_bytes(F.col("size")).alias("waveform"), P.audio_bytes(F.col("size")).alias("audio")))
query("chunk_advice", f"""with {FILES} select doc_id, cast(size // (case fmt when 'wav' then 50 when 'flac' then 80 when 'ogg' then 120 when 'opus' then 150 else 100 end) as bigint) as chunk,
    cast(case when size < 2097152 then round(greatest(8192.0, least(524288.0, size * 0.4))) when size < 104857600 then 4194304 else 8388608 end as bigint) as mp4,
    cast(greatest(1024, least(1048576, round(size * 0.25))) as bigint) as small, cast(10485760 as bigint) as large from fm""")(
    lambda s, d: files(s, d).select("doc_id", P.chunk_size(F.col("size"), F.col("fmt")).alias("chunk"), P.mp4_chunk_size(F.col("size")).alias("mp4"), P.chunk_advice(F.col("size"), "small").alias("small"), P.chunk_advice(F.col("size"), "large").alias("large")))
query("quality_advice", """select event_id, case when u > 0.9 then 'critical' when u > 0.8 then 'high' else 'normal' end as pressure,
    case when u > 0.9 then 0.25 when u > 0.8 then 0.5 when u > 0.7 then 0.75 end as factor, case when u > 0.8 then true when u > 0.7 then false end as streaming from (select event_id, (event_id % 100) / 100.0::double as u from events)""")(
    lambda s, d: table(s, d, "events").withColumn("u", F.col("event_id") % 100 / 100.0).withColumn("q", P.quality_advice(F.col("u"))).select("event_id", P.pressure(F.col("u")).alias("pressure"), "q.factor", "q.streaming"))
query("memory_curve", """with c as (select user_id as track, event_id as seq, case when event_id % 2 = 0 then floor(value) else -floor(value) end as change from events),
    s as (select *, sum(change) over (partition by track order by seq) as s from c), u as (select track, seq, s - least(0, min(s) over (partition by track order by seq)) as used from s)
    select track, seq, cast(used as bigint) as used, case when used / 500 > 0.9 then 'critical' when used / 500 > 0.8 then 'high' else 'normal' end as level from u""")(lambda s, d: S.memory_curve(table(s, d, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.floor("value")).otherwise(-F.floor("value")).cast("long").alias("change")), 500))


def _memory_stream(spark, d) -> DataFrame:
    """Events of users in four parts that come one after another, each of them a batch of a stream that goes on.

    Changes count by id, and times need not follow ids: rows are late only beyond all the time that there is.
    """
    folder, base, e = shared_path(spark, "events"), shared_path(spark, "stream"), table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    most, span = e.agg(F.coalesce(F.max("event_id"), F.lit(0)), F.coalesce(F.max(at) - F.min(at), F.lit(0))).first()
    change = F.when(F.col("event_id") % 2 == 0, F.floor("value")).otherwise(-F.floor("value")).cast("long")
    rows = e.select(F.col("user_id").cast("string").alias("track"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), change.alias("change"))
    for k in range(4):
        rows.filter((F.col("seq") * 4 > most * k) & (F.col("seq") * 4 <= most * (k + 1)) | (F.lit(k == 0) & (F.col("seq") <= 0))).write.mode("append").parquet(folder)
        stream = incremental.memory(spark.readStream.schema(rows.schema).parquet(folder), 500, late=f"{span + 2} seconds")
        settled = incremental.settle(stream, "append", base)
    return settled.filter("kind = 'change'").select(F.col("track").cast("long").alias("track"), "seq", "used", "level")


query("memory_stream", ORACLES["memory_curve"])(_memory_stream)
query("durations", "select c_custkey as k, cast((c_custkey * 1000) // (44100 * (c_custkey % 2 + 1)) as bigint) as ms, cast(round(c_custkey / 44100.0::double * 1000000 / (c_custkey % 2 + 1)) as bigint) as us from customer")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"), duration_ms(F.col("c_custkey"), F.lit(44100), F.col("c_custkey") % 2 + 1).alias("ms"), duration_us(F.col("c_custkey"), F.lit(44100), F.col("c_custkey") % 2 + 1).alias("us")))

# --- statistics of operations

OPS = "op as (select event_id as seq, event_type as name, cast(floor(value * 20 * (len(event_type) - 3)) as bigint) as ms, event_id % 7 <> 0 as ok, user_id * 20000 * len(event_type) as mem from events)"
STATS = f"""{OPS}, st as (select name, count(*) as n, count(*) filter (ok) as ok, (count(*) - count(*) filter (ok)) / count(*) as failure_rate, avg(ms) as avg_ms, cast(median(ms) as double) as median_ms, cast(sum(ms) as bigint) as sum_ms, min(ms) as min_ms, max(ms) as max_ms,
    stddev_pop(ms) as stddev_ms, avg(mem) as avg_memory, cast(sum(mem) as bigint) as sum_memory from op group by 1)"""


def ops(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), (F.col("value") * 20 * (F.length("event_type") - 3)).alias("duration_ms"), (F.col("event_id") % 7 != 0).alias("success"), (F.col("user_id") * 20000 * F.length("event_type")).alias("memory_bytes"))


query("op_stats", f"with {STATS} select name, n, ok, round(failure_rate, 6) as failure_rate, round(avg_ms, 6) as avg_ms, round(median_ms, 6) as median_ms, sum_ms, min_ms, max_ms, round(stddev_ms, 6) as stddev_ms, round(avg_memory, 6) as avg_memory, sum_memory from st")(
    lambda s, d: rounded(S.statistics(ops(s, d)), "failure_rate", "avg_ms", "median_ms", "stddev_ms", "avg_memory"))
query("op_report", f"""with {STATS} select cast(sum(n) as bigint) as total, cast(sum(n - ok) as bigint) as failed, round(sum(n - ok) / sum(n), 6) as failure_rate, cast(sum(sum_ms) as bigint) as total_ms, cast(sum(sum_memory) as bigint) as total_memory, count(*) as names,
    coalesce(string_agg(case when avg_ms > 1000 then name end, ',' order by name), '') as slow, coalesce(string_agg(case when avg_memory > 10485760 then name end, ',' order by name), '') as heavy from st""")(
    lambda s, d: rounded(S.report(ops(s, d)), "failure_rate").withColumn("slow", F.array_join("slow", ",")).withColumn("heavy", F.array_join("heavy", ",")))
query("op_last100", f"with {OPS} select name, seq from (select *, row_number() over (partition by name order by seq desc) as r from op) where r <= 100")(lambda s, d: S.newest(ops(s, d), "seq").select("name", "seq"))
query("op_bottlenecks", f"with {STATS} select name, avg_ms > 1000 as slow, avg_memory > 10485760 as heavy from st where avg_ms > 1000 or avg_memory > 10485760")(lambda s, d: S.bottlenecks(ops(s, d)))
query("op_best", f"with {STATS} select min_by(name, (avg_ms, name)) as fastest, min_by(name, (avg_memory, name)) as lightest, min_by(name, (failure_rate, name)) as most_reliable from st")(lambda s, d: S.best(ops(s, d)))
query("op_names", "select distinct event_type as name from events")(lambda s, d: ops(s, d).select("name").distinct())
query("benchmark_summary", "select event_type as name, round(avg(value), 6) as avg, min(value) as min, max(value) as max from events group by 1")(
    lambda s, d: rounded(S.benchmark(table(s, d, "events").select(F.create_map("event_type", F.array("value")).alias("results"))), "avg"))

# --- JSON and sample tables

query("waveform_json_roundtrip", f"with {EMB_LONG} select track, cast(i as bigint) as bin, round(x, 6) as amp from lo")(
    lambda s, d: spread(emb(s, d).withColumn("w", serde.waveform_from_json(serde.waveform_to_json(serde.waveform(F.col("a"))))), F.col("w.amplitudes")))
query("waveform_json_facts", "select vec_id as track, cast(1000000 as bigint) as duration, 44100 as rate, cast(len(embedding) as int) as resolution, 'bars' as type, true as normalized from embeddings")(
    lambda s, d: emb(s, d).select("track", serde.waveform_from_json(serde.waveform_to_json(serde.waveform(F.col("a"), kind="stars"))).alias("w")).select("track", "w.duration", F.col("w.sampleRate").alias("rate"), "w.metadata.resolution", "w.metadata.type", "w.metadata.normalized"))
query("amp_string_parse", f"with {EMB_LONG} select track, cast(i as bigint) as bin, round(x, 6) as amp from lo")(lambda s, d: spread(emb(s, d), serde.amplitudes_from_text(F.to_json("a"))))


def samples(spark, d) -> DataFrame:
    """Events as the sample tables of their types: offset, size, time, keyframes."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("seq"), (F.col("event_id") * 1000).alias("offset"), (F.col("user_id") + 1).alias("size"), ts.alias("ts_us"), (F.col("event_id") % 10 == 0).alias("is_key"))


SAMPLES = "sa as (select event_type as track, event_id as seq, event_id * 1000 as \"offset\", user_id + 1 as size, epoch_us(ts) as ts_us, event_id % 10 = 0 as is_key, lead(epoch_us(ts)) over (partition by event_type order by ts, event_id) as next_us from events)"
query("sample_durations", f"with {SAMPLES} select track, seq, \"offset\" + size as end_offset, next_us - ts_us as us from sa")(lambda s, d: ST.durations(samples(s, d)))


def _seek(spark, d) -> DataFrame:
    """Ten times spread over each track."""
    t = samples(spark, d)
    span = t.groupBy("track").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    asks = span.select("track", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("q"), "lo", "hi").select("track", "q", (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * F.col("q") / 10)).cast("long").alias("ts_us"))
    return ST.seek(t, asks)


query("sample_table_seek", f"""with {SAMPLES}, sp as (select track, min(ts_us) as lo, max(ts_us) as hi from sa group by 1),
    q as (select track, cast(k as int) as q, cast(lo + floor((hi - lo) * k / 10) as bigint) as t from sp cross join (select unnest(range(10)) as k) r)
    select q.track, q.q, max_by(sa.seq, (sa.ts_us, sa.seq)) as seq, max_by(sa.seq, (sa.ts_us, sa.seq)) filter (is_key) as key from q join sa on sa.track = q.track and sa.ts_us <= q.t group by 1, 2""")(_seek)
query("container_facts", "select event_type as track, count(*) as samples, round(count(*) * 1000000.0::double / (max(epoch_us(ts)) - min(epoch_us(ts))), 6) as rate, round(max(value) / avg(value), 6) as ratio from events group by 1")(
    lambda s, d: ST.facts(samples(s, d)).join(table(s, d, "events").groupBy(F.col("event_type").alias("track")).agg(F.avg("value").alias("b"), F.max("value").alias("m")), "track").select("track", "samples", r6(serde.sample_rate_estimate(F.col("samples"), F.col("us"))).alias("rate"), r6(serde.bitrate_ratio(F.col("b"), F.col("m"))).alias("ratio")))

query("container_map", "select c_custkey as k, coalesce(case when c_custkey % 3 > 0 then c_custkey * 1000 end, 0) as duration, coalesce(case when c_custkey % 2 = 0 then c_nationkey end, 0) as bitrate, cast(0 as bigint) as \"maxBitrate\", case when c_custkey % 5 > 0 then c_mktsegment else 'Unknown' end as \"codecName\", cast(case when c_custkey % 7 > 0 then c_nationkey + 2 else 1 end as int) as \"trackId\" from customer")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"), serde.container(F.map_filter(F.create_map(
        F.lit("duration"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") * 1000).cast("string"), F.lit("bitrate"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).cast("string"),
        F.lit("codecName"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")), F.lit("trackId"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey") + 2).cast("string")), lambda k, v: v.isNotNull())).alias("c")).select("k", "c.*"))
query("size_text", f"with {FILES} select doc_id, case when size < 1024 then size || 'B' when size < 1048576 then format('{{:.1f}}KB', size / 1024) when size < 1073741824 then format('{{:.1f}}MB', size / 1048576) else format('{{:.1f}}GB', size / 1073741824) end as text from fl")(
    lambda s, d: files(s, d).select("doc_id", size_text(F.col("size")).alias("text")))
query("samples_concatenate", f"with {EMB_LONG} select cast(track as varchar) as path, cast(i as bigint) as bin, round(x, 6) as amp from lo")(
    lambda s, d: wav.concatenate(emb(s, d).select(F.col("track").cast("string").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("idx"), "a").select("path", "idx", F.slice("a", F.col("idx") * 8 + 1, 8).alias("samples"), F.lit(8000).alias("sample_rate"), F.lit(1).alias("channels")))
    .select("path", F.posexplode("samples").alias("bin", "amp")).select("path", F.col("bin").cast("long").alias("bin"), r6("amp").alias("amp")))

# --- audio and streams

def _waves(spark, d) -> DataFrame:
    """Documents as WAVE files of their own rate and width, with their text as data; every third one has a chunk of its source's name (of even length) before it."""
    big = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))
    little = lambda c, n: F.concat(*[F.substring(big(c, n), k, 1) for k in range(n, 0, -1)])
    bits, channels, rate = 8 * (F.col("doc_id") % 4 + 1), F.col("doc_id") % 2 + 1, 8000 + F.col("doc_id") * 10 % 40000
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    name = F.concat("source", F.lit(" ")).cast("binary")
    name = F.when(F.octet_length(name) % 2 == 0, name).otherwise(F.col("source").cast("binary"))
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"LIST"), little(F.octet_length(name), 4), name)).otherwise(F.lit(b""))
    fmt = F.concat(F.lit(b"fmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), little(rate * channels * bits / 8, 4), little(channels * bits / 8, 2), little(bits, 2))
    body = F.concat(F.lit(b"WAVE"), fmt, note, F.lit(b"data"), little(F.octet_length(data), 4), data)
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), F.concat(F.lit(b"RIFF"), little(F.octet_length(body), 4), body).alias("content"))


#: Samples of the documents as little-endian numbers of 8 to 32 bits; those of 8 bits have no sign.
PCM = """w as (select doc_id, 8 * (doc_id % 4 + 1) as bits, doc_id % 2 + 1 as channels, 8000 + doc_id * 10 % 40000 as rate, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::int) as b from documents),
    p as (select *, doc_id % 4 + 1 as wide, len(b) // (doc_id % 4 + 1) as n from w),
    x as (select *, list_transform(range(n), lambda i: b[i * wide + 1]::bigint + coalesce(b[i * wide + 2] * case when wide > 1 then 256 else 0 end, 0) + coalesce(b[i * wide + 3]::bigint * case when wide > 2 then 65536 else 0 end, 0) + coalesce(b[i * wide + 4]::bigint * case when wide > 3 then 16777216 else 0 end, 0)) as u from p),
    pcm as (select doc_id, bits, channels, rate, n, list_transform(u, lambda v: case when bits = 8 then (v - 128) / 128.0::double when v >= 1::bigint << (bits - 1) then (v - (1::bigint << bits)) / (1::bigint << (bits - 1))::double else v / (1::bigint << (bits - 1))::double end) as v from x)"""


def _decoded(spark, d, trim: int = 0) -> DataFrame:
    rows = wav.decode_files(_waves(spark, d), trim)
    return rows.select("path", F.size("samples").cast("long").alias("samples"), "sample_rate", "channels", "duration_us", F.round(A.rms(A.doubles(F.col("samples"))), 3).alias("rms"), "error")


SQL_DECODED = "select doc_id || '.wav' as path, cast({n} as bigint) as samples, cast(rate as int) as sample_rate, cast(channels as int) as channels, cast(round_even({n} / rate::double * 1e6 / channels, 0) as bigint) as duration_us, round(coalesce(sqrt(list_avg(list_transform({v}, lambda x: x * x))), 0), 3) as rms, cast(null as varchar) as error from pcm"
query("wav_decode", f"with {PCM} " + SQL_DECODED.format(n="n", v="v"))(_decoded)
query("wav_trim", f"with {PCM} " + SQL_DECODED.format(n="greatest(0, n - 24 * channels)", v="v[24 * channels + 1:]"))(lambda s, d: _decoded(s, d, 24))
query("wav_format", "select doc_id || '.wav' as path, 'wav' as format, 'unknown' as of_text from documents")(
    lambda s, d: _waves(s, d).select("path", P.format_of_content(F.col("content")).alias("format"), P.format_of_content(F.substring_index("path", ".", 1).cast("binary")).alias("of_text")))


def _damaged_waves(spark, d) -> DataFrame:
    """The documents' files, of which some are cut short, others hold plain text or nothing, or are of a format without a decoder."""
    k, c = F.col("id") % 5, F.col("content")
    rows = _waves(spark, d).withColumn("id", F.substring_index("path", ".", 1).cast("long"))
    body = F.when(k == 1, F.substring(c, 1, 20)).when(k == 2, F.concat(F.lit(b"text "), c)).when(k == 3, F.lit(b"")).otherwise(c)
    return rows.select(F.when(k == 4, F.concat(F.col("id").cast("string"), F.lit(".mp3"))).otherwise(F.col("path")).alias("path"), body.alias("content"))


query("file_errors", "select doc_id || case when doc_id % 5 = 4 then '.mp3' else '.wav' end as path, case doc_id % 5 when 1 then 'corrupted' when 2 then 'corrupted' when 3 then 'decoding' when 4 then 'unsupported_format' end as error, doc_id % 5 = 0 as decoded from documents")(
    lambda s, d: wav.decode_files(_damaged_waves(s, d)).select("path", "error", F.col("samples").isNotNull().alias("decoded")))


def _recordings(spark, d) -> DataFrame:
    """Files of the values of each user's events, FLAC for every third user, else WAVE."""
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, ".flac").otherwise(".wav"))
    rows = B.short_frames(table(spark, d, "events").withColumn("path", name), "path", ["ts", "event_id"], "value")
    v = F.round("v") / 32767 * F.when(F.col("frame") % 2 == 0, 1).otherwise(-1)
    return wav.encode_rows(rows.select(F.col("track").alias("path"), "frame", F.lit(0).alias("channel"), v.alias("v")), 8000, 1)


def _recorded(spark, d) -> str:
    return _counted(spark, d)[0]


def _counted(spark, d) -> tuple[str, int]:
    """The folder of the recordings, and how many there are."""
    folder = shared_path(spark, "recordings")
    return folder, wav.write_files(_recordings(spark, d), folder)


def _streamed(spark, d) -> DataFrame:
    folder, n = _counted(spark, d)
    return incremental.settle(wav.stream_chunks(spark, folder, 16, files=wav.files_of(n)), "append")


RECORDED = """fr as (select 'user_' || user_id || case when user_id % 3 = 0 then '.flac' else '.wav' end as track, row_number() over w - 1 as frame, count(*) over (partition by user_id) as frames,
    cast(round(value) * case when (row_number() over w - 1) % 2 = 0 then 1 else -1 end as double) / 32768 as v from events window w as (partition by user_id order by ts, event_id))"""
SQL_CHUNKS = f"with {RECORDED} select track as path, frames, 1 as ends, cast(sum(v * 32768) as bigint) as total, cast(sum(v * 32768 * (frame + 1)) as bigint) as weighted from fr group by 1, 2"


def _chunk_facts(chunks: DataFrame) -> DataFrame:
    """What chunks of a file add up to: its samples, and the samples times their places."""
    whole = F.transform("samples", lambda x: F.round(x * 32768).cast("long"))
    rows = chunks.select(F.substring_index("path", "/", -1).alias("path"), "frames", "is_last", "first", whole.alias("x"))
    total, weighted = F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x), F.aggregate(F.transform("x", lambda x, i: x * (F.col("first") + i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.groupBy("path", "frames").agg(F.count_if("is_last").cast("int").alias("ends"), F.sum(total).alias("total"), F.sum(weighted).alias("weighted"))


query("signal_chunks", SQL_CHUNKS)(lambda s, d: _chunk_facts(wav.read_chunks(s, _recorded(s, d), 16, "*.{wav,flac}")))
query("signal_stream", SQL_CHUNKS)(lambda s, d: _chunk_facts(_streamed(s, d)))


def _sought(spark, d) -> DataFrame:
    """Recordings from 4 ms on: what a chunk adds up to of the frames that are left."""
    folder = _recorded(spark, d)
    indexed = wav.index(wav.plan_chunks(spark, folder, 16))
    return _chunk_facts(wav.seek_chunks(indexed, 4)).drop("ends")


query("seek_chunks", f"with {RECORDED} select track as path, frames, cast(sum(v * 32768) as bigint) as total, cast(sum(v * 32768 * (frame + 1)) as bigint) as weighted from fr where frame >= 32 group by 1, 2")(_sought)


def _facade(spark, d, large: int) -> DataFrame:
    rows = Engine(spark, WaveformConfig(20, smooth=True)).waveforms(_recorded(spark, d), large=large)
    rows = rows.select(F.substring_index("path", "/", -1).alias("path"), "duration_us", "sample_rate", "error", F.posexplode("amplitudes").alias("bin", "amp"))
    return rows.select("path", "duration_us", "sample_rate", "error", F.col("bin").cast("long").alias("bin"), r6("amp").alias("amp"))


SQL_FACADE = f"with {sql_bins(20, RECORDED)}, {sql_smooth(3)}, {SQL_PEAK.format('sm')} select norm.track as path, cast(n.frames * 125 as bigint) as duration_us, 8000 as sample_rate, cast(null as varchar) as error, bin, round(amp, 6) as amp from norm join (select distinct track, frames from fr) n using (track)"
query("facade_waveforms", SQL_FACADE)(lambda s, d: _facade(s, d, P.IN_MEMORY))
query("facade_streamed", SQL_FACADE)(lambda s, d: _facade(s, d, 0))
LINE_TRACKS = f"""li as (select l_suppkey as k, row_number() over w - 1 as i, count(*) over (partition by l_suppkey) as n, cast(round(l_extendedprice / 10) as bigint) % 30000 * case when l_linenumber % 2 = 0 then 1 else -1 end as x
    from lineitem window w as (partition by l_suppkey order by {', '.join(LINE_ORDER)}))"""


def _flacs(spark, d) -> DataFrame:
    """Suppliers' lines as FLAC files of one channel, decoded again: what samples and squares add up to, and samples by their places."""
    rows = B.short_frames(table(spark, d, "lineitem").withColumn("path", F.concat(F.col("l_suppkey").cast("string"), F.lit(".flac"))), "path", LINE_ORDER, F.round(F.col("l_extendedprice") / 10).cast("long") % 30000 * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1))
    files = wav.encode_rows(rows.select(F.col("track").alias("path"), "frame", F.lit(0).alias("channel"), (F.col("v") / 32767).alias("v")), 44100, 1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    decoded = wav.decode_files(files).withColumn("x", F.transform("samples", lambda v: F.round(v * 32768).cast("long")))
    return decoded.select("path", F.size("x").cast("long").alias("samples"), "channels", "duration_us", total(F.col("x")).alias("total"), total(F.transform("x", lambda v: v * v)).alias("squares"), total(F.transform("x", lambda v, i: v * i)).alias("weighted"))


query("flac_decode", f"with {LINE_TRACKS} select k || '.flac' as path, count(*) as samples, 1 as channels, cast(round_even(any_value(n) / 44100.0::double * 1e6, 0) as bigint) as duration_us, cast(sum(x) as bigint) as total, cast(sum(x * x) as bigint) as squares, cast(sum(x * i) as bigint) as weighted from li group by k")(_flacs)
query("duration_text", "select event_id, (us // 3600000000) || ':' || lpad(cast(us // 60000000 % 60 as varchar), 2, '0') || ':' || lpad(cast(us // 1000000 % 60 as varchar), 2, '0') || '.' || lpad(cast(us % 1000000 as varchar), 6, '0') as text from (select event_id, epoch_us(ts) // 1000 + event_id as us from events)")(
    lambda s, d: table(s, d, "events").select("event_id", duration_text(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) + F.col("event_id")).alias("text")))
query("container_to_map", "select c_custkey as k, c_custkey * 1000 as duration, c_nationkey as bitrate, 'aac' || c_nationkey as codec, 5 as n from customer")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"), serde.container_to_map(serde.container(F.create_map(F.lit("duration"), (F.col("c_custkey") * 1000).cast("string"), F.lit("bitrate"), F.col("c_nationkey").cast("string"), F.lit("codecName"), F.concat(F.lit("aac"), F.col("c_nationkey").cast("string"))))).alias("m"))
    .select("k", F.col("m")["durationMicros"].cast("long").alias("duration"), F.col("m")["bitrate"].cast("long").alias("bitrate"), F.col("m")["codecName"].alias("codec"), F.size("m").alias("n")))
query("sample_to_map", "select event_id as seq, event_id * 1000 as \"offset\", user_id + 1 as size, epoch_us(ts) as ts_us, cast(event_id % 10 = 0 as varchar) as is_key from events")(
    lambda s, d: samples(s, d).select("seq", serde.sample_to_map(F.col("offset"), F.col("size"), F.col("ts_us"), F.col("is_key")).alias("m")).select("seq", F.col("m")["offset"].cast("long").alias("offset"), F.col("m")["size"].cast("long").alias("size"), F.col("m")["timestampMicros"].cast("long").alias("ts_us"), F.col("m")["isKeyframe"].alias("is_key")))
query("wav_header", """with w as (select *, 8 * (doc_id % 4 + 1) as bits, doc_id % 2 + 1 as channels, 8000 + doc_id * 10 % 40000 as rate, strlen(coalesce(text, '')) as n from documents)
    select doc_id || '.wav' as path, cast(1 as bigint) as kind, channels, rate as sample_rate, cast(bits as bigint) as bits, cast(n as bigint) as data_bytes,
        cast(case when doc_id % 3 = 0 then 52 + strlen(source) + strlen(source) % 2 else 44 end as bigint) as data_at, cast(n * 8000 // (rate * channels * bits) as bigint) as duration_ms from w""")(lambda s, d: wav.header(_waves(s, d)))
query("stream_bins", "select event_type as track, date_trunc('day', ts) as start, count(*) as n, round(sqrt(avg(value * value)), 6) as rms, round(max(abs(value)), 6) as peak, round(avg(abs(value)), 6) as average from events group by 1, 2")(
    lambda s, d: incremental.settle(incremental.windowed(incremental.read(s, d, "events.parquet"), "ts", "event_type", "value", late=None)).select("track", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("rms").alias("rms"), r6("peak").alias("peak"), r6("average").alias("average")))

def _checksums(spark, d, *keep: str) -> DataFrame:
    return table(spark, d, "documents").select(*keep, F.col("doc_id").cast("string").alias("path"), wav.checksum(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("checksum"))


def _with_sources(c: DataFrame) -> DataFrame:
    """path, checksum, source, and the checksum of all contents of that source (null is a source, too)."""
    whole = c.groupBy(F.col("source").alias("of")).agg(wav.checksum_of_all(F.col("checksum")).alias("source_checksum"))
    return c.join(whole, F.col("source").eqNullSafe(F.col("of"))).select("path", "checksum", "source", "source_checksum")


#: Starts of files: formats in the order of doc_id, and one that is none.
KINDS = ["mp3", "flac", "ogg", "wav", "opus", "none"]


def _marked(spark, d) -> DataFrame:
    """Documents as files that begin with the marks of the formats in turn; header fields hold parts of the id. ``fmt`` is what the name claims, wrongly for every seventh."""
    k, i = (F.col("doc_id") % 6).cast("int"), F.col("doc_id")
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    pad = lambda n: F.lit(bytes(n))
    mark = (
        F.when(k == 0, F.concat(F.lit(b"\xff"), byte(0xE0 + i % 4 * 8 + F.floor(i / 4) % 3 * 2), byte(i % 15 * 16 + i % 3 * 4), byte(i % 4 * 64)))
        .when(k == 1, F.concat(F.lit(b"fLaC"), byte(i % 2), pad(3), byte(i % 16 + 1), byte(i % 256), byte(i % 32 + 16), pad(31)))
        .when(k == 2, F.concat(F.lit(b"OggS"), pad(1), byte(i % 8), pad(22)))
        .when(k == 3, F.concat(F.lit(b"RIFF"), pad(4), F.lit(b"WAVE")))
        .when(k == 4, F.concat(F.lit(b"OggS"), pad(1), byte(i % 8), pad(22), F.lit(b"OpusHead")))
        .otherwise(F.lit(b"none"))
    )
    claim = F.when(F.col("doc_id") % 7 == 0, "ogg").otherwise(F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1))
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), claim.alias("fmt"), F.concat(mark, F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))


query("signatures", """with f as (select doc_id, doc_id % 6 as k, case when doc_id % 7 = 0 then 'ogg' else ['mp3','flac','ogg','wav','opus','none'][doc_id % 6 + 1] end as fmt from documents)
    select cast(doc_id as varchar) as path, ['mp3','flac','ogg','wav','opus','unknown'][k + 1] as detected, case fmt when 'mp3' then k = 0 when 'flac' then k = 1 when 'ogg' then k in (2, 4) when 'wav' then k = 3 else false end as matches, k = 0 as is_mp3 from f""")(
    lambda s, d: _marked(s, d).select("path", P.format_of_content(F.col("content")).alias("detected"), headers.signature_matches(F.col("content"), F.col("fmt")).alias("matches"), headers.signature_matches(F.col("content"), F.lit("mp3")).alias("is_mp3")))
query("header_fields", """with f as (select doc_id as i, doc_id % 6 as k from documents)
    select cast(i as varchar) as path, cast(case when k = 0 then i % 4 end as int) as version, cast(case when k = 0 then i // 4 % 3 end as int) as layer, cast(case when k = 0 then i % 15 end as int) as bitrate_index, cast(case when k = 0 then i % 3 end as int) as sample_rate_index, cast(case when k = 0 then i % 4 end as int) as channel_mode,
    cast(case when k = 1 then (i % 16 + 1) * 256 + i % 256 end as int) as min_block, cast(case when k = 1 then (i % 32 + 16) * 256 end as int) as max_block, case when k = 1 then i % 2 = 0 end as has_stream_info, cast(case when k in (2, 4) then i % 8 end as int) as header_type from f""")(
    lambda s, d: _marked(s, d).withColumn("k", F.col("doc_id") % 6).select("path", F.when(F.col("k") == 0, headers.mp3_header(F.col("content"))).alias("m"), F.when(F.col("k") == 1, headers.flac_header(F.col("content"))).alias("f"), F.when(F.col("k").isin(2, 4), headers.ogg_header(F.col("content"))).alias("o")).select("path", "m.version", "m.layer", "m.bitrate_index", "m.sample_rate_index", "m.channel_mode", "f.min_block", "f.max_block", "f.has_stream_info", "o.header_type"))
#: A frame's mark, the text, the mark again; then a page's mark, the text, the mark again. Texts hold neither, so the second mark counts if the jump does not pass it.
SQL_MARKS = """select cast(doc_id as varchar) as path, cast(case when strlen(coalesce(text, '')) + 2 >= 417 then 2 else 1 end as bigint) as mp3_frames, cast(case when strlen(coalesce(text, '')) + 4 >= 4096 then 2 else 1 end as bigint) as ogg_pages from documents"""


def _between_marks(spark, d) -> DataFrame:
    t = table(spark, d, "documents").withColumn("t", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return t.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit(b"\xff\xfb"), "t", F.lit(b"\xff\xfbOggS"), "t", F.lit(b"OggS")).alias("content"))


query("pattern_counts", SQL_MARKS)(lambda s, d: headers.count_patterns(_between_marks(s, d)))
query("pattern_counts_chunks", SQL_MARKS)(lambda s, d: headers.count_in_chunks(P.with_content(_between_marks(s, d), 1000)))
query("byte_checksum", "select cast(doc_id as varchar) as path, lpad(lower(to_hex(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::int)), 0)::bigint)), 8, '0') as checksum from documents")(
    lambda s, d: _checksums(s, d).select("path", "checksum"))
#: Both whole: a row a document with its own checksum, and with that of all contents of its source.
query("byte_checksum_all", """with c as (select doc_id, source, coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::int)), 0)::bigint as n from documents)
    select cast(doc_id as varchar) as path, lpad(lower(to_hex(n)), 8, '0') as checksum, source, lpad(lower(to_hex(sum(n) over (partition by source)::bigint % 4294967296)), 8, '0') as source_checksum from c""")(lambda s, d: _with_sources(_checksums(s, d, "source")))
query("byte_checksum_sources", "select source, lpad(lower(to_hex(sum(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::int)), 0))::bigint % 4294967296)), 8, '0') as checksum from documents group by source")(
    lambda s, d: _checksums(s, d, "source").groupBy("source").agg(wav.checksum_of_all(F.col("checksum")).alias("checksum")))
query("harmonics", "select event_id, round(greatest(-1.0, least(1.0, (0.5 * sin(w) + 0.25 * sin(2 * w) + 0.125 * sin(3 * w)) * (1 + 0.3 * sin(2 * t)) * 0.7)), 6) as v from (select event_id, event_id / 8000.0::double as t, 2 * pi() * (440 + 220 * (user_id % 2)) * (event_id / 8000.0::double) as w from events)")(
    lambda s, d: table(s, d, "events").select("event_id", r6(wav.harmonics(F.col("event_id"), F.col("user_id") % 2, 8000)).alias("v")))
LISTED = f"with {FILES}, li as (select '/d.x/' || ['corrupted_', 'tone_', ''][doc_id % 3 + 1] || ['small', 'large', 'X1'][doc_id % 4 % 3 + 1] || '_' || doc_id || '.' || ['wav', 'MP3'][doc_id % 2 + 1] as path, doc_id from fl), lj as (select *, lower(split_part(path, '.', -1)) as extension, regexp_extract(split_part(path, '/', -1), '_([a-z]+)_[^_]*$', 1) as size_tag from li)"


def _listed(spark, d) -> DataFrame:
    pick = lambda of, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (of + 1).cast("int"))
    i = F.col("doc_id")
    return files(spark, d).select(F.concat(F.lit("/d.x/"), pick(i % 3, "corrupted_", "tone_", ""), pick(i % 4 % 3, "small", "large", "X1"), F.lit("_"), i.cast("string"), F.lit("."), pick(i % 2, "wav", "MP3")).alias("path"))


query("file_listing", f"{LISTED} select path, split_part(path, '/', -1) as name, extension, size_tag from lj")(lambda s, d: headers.listing(_listed(s, d)))
query("file_listing_counts", f"{LISTED} select extension, size_tag, count(*) as n from lj group by 1, 2")(lambda s, d: headers.listed(_listed(s, d)))
query("file_damaged", f"{LISTED} select path from lj where path like '%corrupted%'")(lambda s, d: headers.damaged(_listed(s, d)))
query("seek_frames", f"with {EVENTS} select track, frame from fr where frame >= case when 1500 >= frames then greatest(0, frames - 10) else 1500 end")(lambda s, d: wav.seek(event_frames(s, d), 15000, 100).select("track", "frame"))
