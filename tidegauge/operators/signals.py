"""The fluent face of the library: lazy steps over many signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WaveformConfig
from ..functions import arrays as A
from ..functions.scalar import curve
from . import bins as B


class Signals:
    """Signals as rows of frames (``framed``) or as bins; every step gives a new one and nothing runs before an action."""

    def __init__(self, framed: DataFrame | None = None, bins: DataFrame | None = None) -> None:
        self.framed, self.bins = framed, bins

    @classmethod
    def rows(cls, rows: DataFrame, track: str, order: list, value: str) -> Signals:
        return cls(B.frames(rows, track, order, value))

    @classmethod
    def arrays(cls, rows: DataFrame, track: str, samples: str, channels: int = 1) -> Signals:
        return cls(B.explode_frames(rows, track, samples, channels))

    def downsample(self, resolution: int, algorithm: str = "rms", short: str = "passthrough") -> Signals:
        return Signals(self.framed, B.downsample(self.framed, resolution, algorithm, short))

    def smooth(self, window: int = 3) -> Signals:
        return Signals(self.framed, B.smooth(self.bins, window))

    def normalize(self, method: str = "peak") -> Signals:
        return Signals(self.framed, B.normalize(self.bins, method))

    def scale(self, name: str = "linear", factor: float = 1.0) -> Signals:
        return Signals(self.framed, self.bins.withColumn("amp", curve(F.col("amp"), name, factor)))

    def resample(self, count: int, down: str = "max", up: str = "linear") -> Signals:
        rows = B.collect(self.bins).select("track", F.posexplode(A.resample(F.col("amplitudes"), count, down, up)).alias("bin", "amp"))
        return Signals(self.framed, rows.withColumn("bin", F.col("bin").cast("long")))

    def waveform(self, config: WaveformConfig) -> Signals:
        """Downsample, smooth, normalise and scale, in this order, as configured."""
        out = self.downsample(config.resolution, config.algorithm, config.short)
        if config.smooth:
            out = out.smooth(config.window)
        if config.normalize:
            out = out.normalize(config.normalization)
        return out.scale(config.curve, config.factor) if config.scales else out


def waveform_array(samples, config: WaveformConfig, channels: int = 1):
    """The same pipeline on one array column: no shuffle."""
    out = A.downsample(samples, config.resolution, config.algorithm, channels, config.short)
    if config.smooth:
        out = A.smooth(out, config.window)
    if config.normalize:
        out = A.normalize(out, config.normalization)
    return A.scale(out, config.curve, config.factor) if config.scales else out
