"""All cutoffs, windows and thresholds, each written once."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Config:
    cutoff: date = date(1999, 6, 30)
    target_days: int = 30
    max_lead: int = 59
    #: Demand that a group needs for a completion curve of its own.
    min_city_support: int = 20_000
    min_province_support: int = 50_000
    min_fraction: float = 0.005
    prior_window_days: int = 120
    history_days: int = 752
    train_window_days: int = 752
    mart_days: int = 180
    momentum_days: int = 7
    train_horizons: tuple[int, ...] = (1, 2, 3, 5, 7, 10, 14, 18, 21, 25, 30)
    snapshot_horizons: tuple[int, ...] = (30, 21, 14, 7, 3, 1)
    horizon_buckets: tuple[tuple[int, int], ...] = ((1, 3), (4, 7), (8, 14), (15, 21), (22, 30))
    demand_quantiles: tuple[float, ...] = (0.0, 0.5, 0.75, 0.9, 0.99, 1.0)
    fold_cutoffs: tuple[date, ...] = (date(1998, 6, 30), date(1998, 12, 31), date(1999, 6, 30))
    calibration_shrinkage: float = 500_000.0
    hub_share: float = 0.001
    #: The zero prior's slot for horizon h holds pairs whose first event came later than h - 1 days
    #: out; with True, later than h days out less one, as its definition says.
    strict_zero_prior: bool = False

    @property
    def target_start(self) -> date:
        return self.cutoff + timedelta(days=1)

    @property
    def target_end(self) -> date:
        return self.cutoff + timedelta(days=self.target_days)

    def at(self, cutoff: date) -> Config:
        from dataclasses import replace

        return replace(self, cutoff=cutoff)


DEFAULT = Config()
#: What queries run with: a city of the test tables has a demand of about 15,000 at every scale and a province of a
#: multiple of 50,000 that differs by scale, so curves of all three levels occur with these supports.
TABLES = Config(min_city_support=10_000, min_province_support=200_000)
#: Added to divisors of feature ratios.
EPS = 1e-6
