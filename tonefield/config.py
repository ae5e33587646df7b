"""Parameters of the stages, and presets that name published settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Of every table that holds one grid or signal segment.
KEYS = ("signal_id", "seg_id")


@dataclass(frozen=True)
class Stft:
    length: int = 2048
    hop: int = 512
    taper: str = "gaussian"
    sigma: float | None = 8.0  # None: a sixth of the length
    two_sided: bool = False
    rate: float = 44100.0

    @property
    def bins(self) -> int:
        return self.length if self.two_sided else self.length // 2 + 1

    def frames(self, n: int) -> int:
        return -(-max(n, self.length) // self.hop) + 1


@dataclass(frozen=True)
class Cfar:
    method: str = "ca"  # ca, goca, soca, goca_sides, soca_bands, os
    guard: int = 2
    train: int = 4
    pfa: float = 1e-3
    threshold: str = "rayleigh"  # or k
    strict: bool = False  # > instead of >=
    count: str = "corners"  # cells that the factor counts: corners or ring
    value: str = "power"  # or magnitude

    @property
    def reach(self) -> int:
        return self.guard + self.train

    def fitted(self, n_freq: int, n_time: int) -> Cfar | None:
        """The window shrunk to a grid, training cells first, then the guard; None where not even one cell fits."""
        most = (min(n_freq, n_time) - 1) // 2
        if most < 1:
            return None
        guard = min(self.guard, most)
        return replace(self, guard=guard, train=max(0, min(self.train, most - guard)))


@dataclass(frozen=True)
class Cluster:
    method: str = "dbscan"  # dbscan, dbscan_iso, hdbscan, agglomerative
    eps: float = 5.0
    min_samples: int = 10
    weights: tuple[float, float] = (1 / 3, 1.5)  # of a step in k and in m


@dataclass(frozen=True)
class Fractal:
    threshold: float = 0.15
    window: int = 64
    frames: int = 24
    step: int = 12
    band: int = 9
    stride: int = 4
    power_percentile: float = 0.85


@dataclass(frozen=True)
class Preset:
    stft: Stft
    cfar: Cfar = field(default_factory=Cfar)
    cluster: Cluster = field(default_factory=Cluster)
    growth: str = "bounded"  # or full


PRESETS = {
    "default": Preset(Stft()),
    "chirp": Preset(Stft(512, 8, two_sided=True, rate=12.5e6), Cfar("goca", 4, 8, 0.4, "k"), Cluster(eps=3, min_samples=3)),
    "sea_statistics": Preset(Stft(128, 16, two_sided=True, rate=1000.0), Cfar("ca", 4, 8, 0.1), Cluster(eps=3, min_samples=5)),
    "sea_figures": Preset(Stft(128, 16, two_sided=True, rate=1000.0), Cfar("goca", 4, 8, 0.1, "k"), Cluster(eps=3, min_samples=5)),
    "sea_frames": Preset(Stft(256, 32, two_sided=True, rate=1000.0), Cfar("goca", 3, 12, 1e-3, "k"), Cluster(eps=8, min_samples=3)),
    "acoustic": Preset(Stft(2048, 256), Cfar("ca", 2, 4, 5e-4), Cluster(eps=8, min_samples=15)),
    "demo": Preset(Stft(1024, 256), Cfar("ca", 2, 4, 1e-2), Cluster(eps=5, min_samples=5)),
    "extended": Preset(Stft(sigma=None), Cfar("os", 2, 4, 1e-3, count="ring", value="magnitude"), Cluster("hdbscan", 5, 10)),
    "extended_chirp": Preset(Stft(256, 1, "hamming", two_sided=True, rate=12.5e6), Cfar("ca", 8, 8, 0.4, count="ring", value="magnitude"), Cluster("hdbscan", 3, 3)),
    "extended_sea": Preset(Stft(512, 16, "hamming", two_sided=True, rate=1000.0), Cfar("ca", 4, 8, 0.6, count="ring", value="magnitude"), Cluster("hdbscan", 5, 2)),
    "simple": Preset(Stft(512, 256, rate=1000.0), Cfar("ca", 8, 8, 1e-2, strict=True, count="ring"), Cluster("dbscan_iso", 3, 5, (1.0, 1.0)), "full"),
    "basic": Preset(Stft(512, 256, "hann_periodic", rate=1000.0), Cfar("ca", 4, 8, 1e-2, strict=True, count="ring")),
}
