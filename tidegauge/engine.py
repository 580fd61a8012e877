"""One object over a session: waveforms of files, what is supported, advice about the session."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import WaveformConfig
from .errors import Disposed, UnsupportedFormat
from .functions import serde
from .operators.signals import Signals, waveform_array
from .plans import files as P
from .sources import wav

log = logging.getLogger("tidegauge")
#: Formats by number, and levels of the log by number (others are errors).
FORMAT_CODES = {"unknown": 0, "mp3": 1, "wav": 2, "flac": 3, "ogg": 4, "opus": 5, "mp4": 6}
LEVELS = {-1: logging.CRITICAL, 0: logging.CRITICAL, 1: logging.CRITICAL, 2: logging.ERROR, 3: logging.WARNING, 4: logging.INFO, 5: logging.INFO, 6: logging.DEBUG}


def format_code(fmt: str) -> int:
    return FORMAT_CODES.get(fmt, 0)


def format_name(code: int) -> str:
    return next((f for f, c in FORMAT_CODES.items() if c == code), "unknown")


class Engine:
    """Lazy: methods that give a table only plan it, but ``waveforms`` writes down which ranges of files it is to read. After ``dispose`` nothing is planned any more; the session stays open."""

    def __init__(self, spark: SparkSession, config: WaveformConfig | None = None, log_level: int = 3) -> None:
        self.spark, self.config, self.disposed = spark, config or WaveformConfig(), False
        self.callbacks: list = []
        log.setLevel(LEVELS.get(log_level, logging.ERROR))

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.dispose()

    def _open(self) -> None:
        if self.disposed:
            raise Disposed("this engine has been disposed")

    def dispose(self) -> None:
        self.disposed = True

    def is_supported(self, path: str) -> bool:
        self._open()
        ext = path.rsplit(".", 1)[1].lower() if "." in path else ""
        return any(ext in f[2] for f in P.FORMATS)

    def formats(self) -> DataFrame:
        self._open()
        return P.formats(self.spark)

    def waveforms(self, path: str, config: WaveformConfig | None = None, large: int = P.IN_MEMORY) -> DataFrame:
        """path, amplitudes, duration_us, sample_rate, error of all audio files below ``path``, channels mixed.

        WAVE and FLAC files of more than ``large`` bytes are read in ranges and binned as rows, all others
        are decoded whole; both give the same. A file of no more frames than bins passes through as it is, unmixed.
        Formats without a registered decoder give rows with the error ``unsupported_format``.
        """
        self._open()
        if "." in path.rsplit("/", 1)[-1] and "*" not in path and not self.is_supported(path):
            raise UnsupportedFormat(path)
        c = config or self.config
        others = [e for f in P.FORMATS for e in f[2] if e not in ("wav", "flac")]
        rows = wav.read_signals(self.spark, path, "*.{" + ",".join(x for e in others for x in (e, e.upper())) + "}", least=large + 1)
        if large > 0:  # no file that Spark lists is empty
            rows = rows.unionByName(wav.read_signals(self.spark, path, most=large))
        amps = F.when(F.size("samples") > 0, waveform_array(F.col("samples"), c, F.col("channels")))
        error = F.coalesce("error", F.when(F.size("samples") == 0, "invalid_waveform"))
        whole = rows.select("path", amps.alias("amplitudes"), "duration_us", "sample_rate", error.alias("error"))
        return whole.unionByName(self._streamed(path, c, large + 1))

    def _streamed(self, path: str, c: WaveformConfig, least: int) -> DataFrame:
        """The same of WAVE and FLAC files of ``least`` bytes or more, no one of which is ever held whole. Headers are read once; FLAC ranges are read once more for damage."""
        planned = wav.planned_once(wav.plan_chunks(self.spark, path, least=least))
        passes = F.lit(False) if c.short == "zero_fill" else F.col("frames") <= c.resolution
        bins = Signals(wav.chunk_frames(wav.read_planned(planned.filter(~passes)))).waveform(c).bins
        grid = F.sequence(F.lit(0), F.lit(c.resolution - 1))
        # A bin without frames is 0, as in the array form.
        made = bins.groupBy("track").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "amp"))).alias("at"))
        made = made.select("track", F.transform(grid, lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0))).alias("amplitudes"))
        # Files of no more frames than bins are small, whatever stands around their data.
        short = wav.read_planned(planned.filter(passes & (F.col("frames") > 0))).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first", "samples"))).alias("parts"), F.max("channels").alias("channels"))
        short = short.select(F.col("path").alias("track"), F.flatten(F.col("parts.samples")).alias("samples"), "channels")
        made = made.unionByName(short.select("track", waveform_array(F.col("samples"), c, F.col("channels")).alias("amplitudes")))
        damaged = wav.read_planned(planned.filter(F.col("kind") == wav.FLAC)).filter("error is not null").groupBy(F.col("path").alias("track")).agg(F.min("error").alias("damage"))
        files = planned.filter("idx = 0").select("path", "frames", "sample_rate", F.coalesce("error", F.when(F.col("frames") == 0, "invalid_waveform")).alias("said"))
        rows = files.join(made, F.col("path") == made["track"], "left").drop("track").join(damaged, F.col("path") == damaged["track"], "left")
        rows = rows.withColumn("error", F.coalesce("said", "damage"))
        sound = F.col("damage").isNull()
        return rows.select("path", F.when(sound, F.col("amplitudes")).alias("amplitudes"), F.when(sound, F.round(F.col("frames") / F.col("sample_rate") * 1e6)).cast("long").alias("duration_us"), F.when(sound, F.col("sample_rate")).alias("sample_rate"), "error")

    def waveforms_json(self, path: str, config: WaveformConfig | None = None) -> DataFrame:
        """path and the waveform as JSON, of the files without error."""
        c = config or self.config
        rows = self.waveforms(path, c).filter("error is null")
        return rows.select("path", serde.waveform_to_json(serde.waveform(F.col("amplitudes"), F.col("duration_us"), kind=c.kind, normalized=c.normalize)).alias("json"))

    def on_pressure(self, callback) -> None:
        """Registers a function that ``check_memory`` calls with the level of pressure."""
        self.callbacks.append(callback)

    def check_memory(self, used: int, limit: int) -> str:
        """normal, high or critical; callbacks hear of the last two, and their errors are logged only."""
        share = used / limit
        level = "critical" if share > 0.9 else "high" if share > 0.8 else "normal"
        if level != "normal":
            for f in list(self.callbacks):
                try:
                    f(level)
                except Exception:
                    log.exception("a pressure callback failed")
        return level

    def environment(self) -> DataFrame:
        """name, value, advice about the session."""
        self._open()
        conf, sc = self.spark.conf, self.spark.sparkContext
        adaptive = conf.get("spark.sql.adaptive.enabled", "true")
        rows = [
            ("spark", self.spark.version, ""), ("parallelism", str(sc.defaultParallelism), ""),
            ("adaptive", adaptive, "" if adaptive == "true" else "adaptive execution splits skewed joins: turn it on"),
            ("checkpoint", conf.get("spark.checkpoint.dir", ""), "" if conf.get("spark.checkpoint.dir", "") else "long tracks need spark.checkpoint.dir on a cluster"),
            ("timezone", conf.get("spark.sql.session.timeZone"), "" if conf.get("spark.sql.session.timeZone") == "UTC" else "event times are read in this zone"),
        ]
        return self.spark.createDataFrame(rows, "name string, value string, advice string")
