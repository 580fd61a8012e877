"""Settings of a waveform, checked when they are made."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from .errors import ConfigurationError

ALGORITHMS = ("rms", "peak", "average", "median")
NORMALIZATIONS = ("peak", "rms")
CURVES = ("linear", "logarithmic", "exponential", "sqrt")
DOWN_METHODS = ("max", "rms", "average", "minMax")
UP_METHODS = ("linear", "repeat", "cubic")
KINDS = ("bars", "line", "filled")
USE_CASES = ("musicVisualization", "speechAnalysis", "peakDetection", "memoryEfficient")


@dataclass(frozen=True)
class WaveformConfig:
    resolution: int = 1000
    kind: str = "bars"
    normalize: bool = True
    normalization: str = "peak"
    algorithm: str = "rms"
    curve: str = "linear"
    factor: float = 1.0
    smooth: bool = False
    window: int = 3
    #: What a signal of fewer frames than bins gives: its own samples, or empty bins of 0.
    short: str = "passthrough"

    def __post_init__(self) -> None:
        if self.resolution <= 0:
            raise ConfigurationError("resolution must be positive")
        if self.factor < 0:
            raise ConfigurationError("factor must not be negative")
        if self.window < 3 or self.window % 2 == 0:
            raise ConfigurationError("window must be odd and at least 3")
        for value, domain in ((self.algorithm, ALGORITHMS), (self.normalization, NORMALIZATIONS), (self.curve, CURVES), (self.kind, KINDS), (self.short, ("passthrough", "zero_fill"))):
            if value not in domain:
                raise ConfigurationError(f"{value!r} is not one of {domain}")

    @property
    def scales(self) -> bool:
        """A linear curve with factor 1 is skipped, and with it the clamp to [0, 1]."""
        return not (self.curve == "linear" and self.factor == 1.0)

    def copy(self, **changes) -> WaveformConfig:
        return dataclasses.replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> WaveformConfig:
        """Missing and unknown entries take the defaults."""
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known and v is not None})

    @classmethod
    def preset(cls, use_case: str, resolution: int | None = None) -> WaveformConfig:
        presets = {
            "musicVisualization": cls(1000, curve="logarithmic", smooth=True),
            "speechAnalysis": cls(2000),
            "peakDetection": cls(500, algorithm="peak"),
            "memoryEfficient": cls(200, algorithm="average"),
        }
        if use_case not in presets:
            raise ConfigurationError(f"{use_case!r} is not one of {USE_CASES}")
        found = presets[use_case]
        return found if resolution is None else found.copy(resolution=resolution)
