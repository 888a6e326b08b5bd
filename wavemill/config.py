"""Pipeline settings, their validation, and device names."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Device names and their aliases.
DEVICES = ("auto", "cpu", "directml", "cuda", "tensorrt", "openvino", "qnn", "vitis", "nvrtx", "webgpu", "tvm", "xnnpack", "onednn")
ALIASES = {"dml": "directml", "trt": "tensorrt", "ov": "openvino", "vitisai": "vitis", "wgpu": "webgpu", "dnnl": "onednn"}
MS = 1_000_000


class ConfigError(ValueError):
    code = "invalid_config"


def parse_device(name: str) -> str:
    """The canonical device of a name or alias, trimmed and in any case."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in DEVICES:
        raise ConfigError(f"unknown device: {name.strip()}")
    return key


def samples_of_ms(ns: int) -> int:
    """Samples of a duration cut down to whole milliseconds."""
    return ns // MS * 16


@dataclass(frozen=True)
class GateConfig:
    """Voice-activity settings; durations in nanoseconds."""

    threshold: float = 0.5
    min_speech: int = 250 * MS
    min_silence: int = 100 * MS
    pad: int = 30 * MS
    max_speech: int = 30_000 * MS
    frame: int = 512
    neg_gap: float = 0.15

    def validate(self) -> None:
        """The first broken rule, in a fixed order, is the one reported."""
        if not math.isfinite(self.threshold) or not 0 <= self.threshold <= 1:
            raise ConfigError("vad_threshold must be between 0 and 1")
        if self.min_speech < MS:
            raise ConfigError("vad_min_speech must be at least 1 ms")
        if self.min_silence < MS:
            raise ConfigError("vad_min_silence must be at least 1 ms")
        if 0 < self.pad < MS or self.pad < 0:
            raise ConfigError("vad_speech_pad must be 0 or at least 1 ms")
        if self.max_speech <= 0:
            raise ConfigError("vad_max_speech must be positive")
        if samples_of_ms(self.max_speech) - self.frame - 2 * samples_of_ms(self.pad) < samples_of_ms(self.min_speech):
            raise ConfigError("vad_max_speech leaves no room for min_speech and padding")


@dataclass(frozen=True)
class PipelineConfig:
    model_dir: str
    device: str = "cpu"
    input_capacity: int = 32
    max_sources: int = 2
    gate: GateConfig = GateConfig()

    def validate(self) -> None:
        if not self.model_dir:
            raise ConfigError("model_dir must not be empty")
        if self.input_capacity <= 0:
            raise ConfigError("input_capacity must be positive")
        if self.max_sources <= 0:
            raise ConfigError("max_sources must be positive")
        self.gate.validate()
