"""Parameter records, checked on the driver when they are built."""

from __future__ import annotations

from dataclasses import dataclass

START = "<start>"
END = "<end>"
NOISE = "-1"


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class PhenotypeParams:
    """Thresholds of the sequence measures."""

    rare_share: float = 0.02
    repeat_significance: float = 0.4
    adaptive_factor: float = 0.25
    dyad_share: float = 0.95
    intro_share: float = 0.5
    min_repeat: int = 2
    max_repeat: int = 19
    boundary: str = "song"
    denominator: str = "in"
    cap: str = "exact"
    ignored_labels: tuple[str, ...] = ("\r",)

    def __post_init__(self) -> None:
        _check(self.boundary in ("song", "subject"), "boundary is 'song' or 'subject'")
        _check(self.denominator in ("in", "out"), "denominator is 'in' or 'out'")
        _check(self.cap in ("exact", "reference"), "cap is 'exact' or 'reference'")
        _check(2 <= self.min_repeat <= self.max_repeat, "need 2 <= min_repeat <= max_repeat")
        for name in ("rare_share", "repeat_significance", "dyad_share", "intro_share"):
            _check(0 <= getattr(self, name) <= 1, f"{name} lies in [0, 1]")


@dataclass(frozen=True)
class SpectrogramParams:
    """Framing of signal arrays."""

    nfft: int = 1024
    hop: int = 1
    sample_rate: float = 32000.0
    min_freq: float = 400.0
    max_freq: float = 10000.0
    max_dur_ms: float = 80.0

    def __post_init__(self) -> None:
        _check(self.nfft > 0, "nfft must be positive")
        _check(self.hop > 0, "hop must be positive")
        _check(self.sample_rate > 0, "sample_rate must be positive")
        _check(self.min_freq < self.max_freq, "min_freq must lie below max_freq")
        _check(self.max_dur_ms > 0, "max_dur_ms must be positive")


@dataclass(frozen=True)
class EmbeddingParams:
    n_neighbors: int = 15
    min_dist: float = 0.1
    metric: str = "euclidean"

    def __post_init__(self) -> None:
        _check(self.n_neighbors >= 2, "n_neighbors must be at least 2")
        _check(0 <= self.min_dist <= 1, "min_dist lies in [0, 1]")


@dataclass(frozen=True)
class ClusterParams:
    min_cluster_size: int = 5
    min_samples: int = 5
    eps: float = 0.1

    def __post_init__(self) -> None:
        _check(self.min_cluster_size >= 1, "min_cluster_size must be positive")
        _check(self.min_samples >= 1, "min_samples must be positive")
        _check(self.eps > 0, "eps must be positive")
