"""Parameters of the analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Thresholds of the published analysis.
    min_common: int = 120
    min_common_share: float = 0.9
    min_peers: int = 3
    quantiles: tuple[float, float] = (1 / 3, 2 / 3)
    min_symbol_obs: int = 30
    windows: tuple[int, ...] = (120, 240, 360, 480)
    hub_windows: tuple[int, ...] = (120, 240, 480)
    replicas: int = 1000
    band_replicas: int = 2000
    random_trees: int = 10_000
    link_ci: tuple[float, float] = (0.025, 0.975)
    band_ci: tuple[float, float] = (0.05, 0.95)
    attempts: int = 5
    perturbed: tuple[int, ...] = (1, 5, 10, 20, 50)
    perturbation_replicas: int = 100

    def common(self, window: int | None = None) -> int:
        """Least number of common observations: of a snapshot, or of a window."""
        return self.min_common if window is None else max(10, int(self.min_common_share * window))
