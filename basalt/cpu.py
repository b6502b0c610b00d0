"""Instruction sets of the driver's machine; for reports, nothing depends on it."""

from __future__ import annotations

import platform
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class CpuFeatures:
    sse42: bool = False
    avx2: bool = False
    avx512f: bool = False
    neon: bool = False


def cpu_features(path: str = "/proc/cpuinfo") -> CpuFeatures:
    try:
        words = set(Path(path).read_text().replace(":", " ").split())
    except OSError:
        words = set()
    return CpuFeatures("sse4_2" in words, "avx2" in words, "avx512f" in words, "asimd" in words or platform.machine() in ("arm64", "aarch64"))
