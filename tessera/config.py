"""Options of the engine, with their defaults, and its errors."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TextConfig:
    lowercase: bool = True
    min_bytes: int = 2
    max_bytes: int = 50
    strip_punctuation: bool = True
    remove_numbers: bool = False


@dataclass(frozen=True)
class FingerprintConfig:
    max_active_bits: int = 328
    weighted: bool = True


@dataclass(frozen=True)
class SomConfig:
    dimension: int = 128
    iterations: int = 100_000
    rate: tuple[float, float] = (0.1, 0.01)
    radius: tuple[float, float] = (64.0, 1.0)
    half_window: int = 2
    weight_dimension: int = 100
    toroidal: bool = True
    seed: int = 42

    @property
    def total_neurons(self) -> int:
        return self.dimension * self.dimension


@dataclass(frozen=True)
class SegmentationConfig:
    block: int = 3
    depth: float = 0.5
    min_sentences: int = 2
    sigma: float = 1.0


@dataclass(frozen=True)
class LookupConfig:
    radius: float = 1.8
    sigma: float = 1.5
    kernel: int = 7
    adaptive: tuple[float, float] = (1.0, 4.0)
    levels: tuple[int, ...] = (256, 64, 16)
    smoothing: float = 1.0


class EngineError(Exception):
    """Base of the engine's errors."""


class WordNotFound(EngineError):
    """A word is not in the vocabulary."""


class NoIndex(EngineError):
    """A search needs postings that the model doesn't have."""


class BadDimension(EngineError):
    """Vectors or grids don't fit together."""
