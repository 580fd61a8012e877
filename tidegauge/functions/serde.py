"""Waveforms, containers and samples from and to JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META = "struct<resolution: int, type: string, normalized: boolean, generatedAt: string>"
WAVEFORM = f"struct<amplitudes: array<double>, duration: bigint, sampleRate: int, metadata: {META}>"
KINDS = ["bars", "line", "filled"]


def waveform_from_json(text: Column) -> Column:
    """A waveform; a text that is none fails the query. An unknown type is bars."""
    w = F.from_json(text, WAVEFORM, {"mode": "FAILFAST"})
    kind = w["metadata"]["type"]
    meta = w["metadata"].withField("type", F.when(kind.isin(KINDS), kind).otherwise("bars"))
    return w.withField("metadata", meta)


def waveform_to_json(waveform: Column) -> Column:
    return F.to_json(waveform)


def waveform(amplitudes: Column, duration_us: Column | None = None, rate: int = 44100, kind: str = "bars", normalized: bool = True, generated_at: str | None = None) -> Column:
    """A waveform of bare amplitudes; one second by default."""
    return F.struct(
        amplitudes.alias("amplitudes"), (F.lit(1_000_000).cast("long") if duration_us is None else duration_us).alias("duration"), F.lit(rate).alias("sampleRate"),
        F.struct(F.size(amplitudes).alias("resolution"), F.lit(kind).alias("type"), F.lit(normalized).alias("normalized"), F.lit(generated_at).cast("string").alias("generatedAt")).alias("metadata"),
    )


def amplitudes_from_text(text: Column) -> Column:
    """Amplitudes of a text like ``[0.1, 0.5]``; null if it is no such list."""
    return F.from_json(text, "array<double>")


#: Names of container facts in maps, the serialised form first; others are read, too.
FACTS = {"duration": ("durationMicros", "duration"), "bitrate": ("bitrate",), "maxBitrate": ("maxBitrate",), "codecName": ("codecName",), "trackId": ("audioTrackId", "trackId")}


def container(fields: Column) -> Column:
    """Container facts of a map<string,string>: missing ones are 0, empty or Unknown."""
    of = lambda k: F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in FACTS[k]])
    num = lambda k: F.coalesce(of(k).cast("long"), F.lit(0).cast("long")).alias(k)
    return F.struct(num("duration"), num("bitrate"), num("maxBitrate"), F.coalesce(of("codecName"), F.lit("Unknown")).alias("codecName"), F.coalesce(of("trackId").cast("int"), F.lit(1)).alias("trackId"))


def sample_rate_estimate(samples: Column, duration_us: Column) -> Column:
    """Samples a second; 0 if there are none or no time."""
    return F.when((samples == 0) | (duration_us == 0), F.lit(0.0)).otherwise(F.try_divide(samples * 1e6, duration_us))


def bitrate_ratio(bitrate: Column, most: Column) -> Column:
    return F.when(bitrate == 0, F.lit(1.0)).otherwise(F.try_divide(most, bitrate))


def container_to_map(facts: Column) -> Column:
    """The map<string,string> of which ``container`` makes these facts."""
    return F.map_from_arrays(F.array(*[F.lit(n[0]) for n in FACTS.values()]), F.array(*[facts[k].cast("string") for k in FACTS]))


def sample_to_map(offset: Column, size: Column, ts_us: Column, is_key: Column) -> Column:
    """A sample of a container's table as map<string,string>."""
    return F.create_map(F.lit("offset"), offset.cast("string"), F.lit("size"), size.cast("string"), F.lit("timestampMicros"), ts_us.cast("string"), F.lit("isKeyframe"), is_key.cast("string"))
