"""Settings of the operators; plain argument checks, no data access."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, inf, isfinite

MINUTE = 60_000_000  # microseconds

RESAMPLING_METHODS = ("none", "mean", "median", "last")
FILTER_METHODS = ("none", "first_order", "trailing_mean", "trailing_median")
DIRECTIONS = ("higher_is_better", "lower_is_better", "target_range")

# Rows a shard of one series holds when it has no gaps.
SHARD_ROWS = 65_536


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and isfinite(value)


def _is_int(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class StateFilter:
    """Keep rows whose `column` lies in [minimum, maximum]; one bound may be open."""

    column: str
    minimum: float | None = None
    maximum: float | None = None

    def __post_init__(self):
        _require(bool(self.column.strip()), "state filter needs a column")
        bounds = [b for b in (self.minimum, self.maximum) if b is not None]
        _require(bool(bounds), "state filter needs a minimum or a maximum")
        _require(all(_is_number(b) for b in bounds), "state filter bounds must be finite numbers")
        _require(len(bounds) < 2 or bounds[0] <= bounds[1], "state filter bounds are reversed")


@dataclass(frozen=True)
class PreprocessingConfig:
    """One causal preprocessing recipe; all lengths are minutes."""

    sample_interval_minutes: int = 5
    smoothing_window_minutes: int = 10
    max_lag_minutes: int = 60
    lag_step_minutes: int = 5
    resampling_method: str = "none"
    filter_method: str = "none"
    first_order_alpha: float | None = None
    gap_threshold_minutes: float | None = None
    state_filters: tuple[StateFilter, ...] = ()

    def __post_init__(self):
        lengths = {
            "sample_interval_minutes": 1,
            "smoothing_window_minutes": 0,
            "max_lag_minutes": 0,
            "lag_step_minutes": 1,
        }
        for name, least in lengths.items():
            value = getattr(self, name)
            _require(_is_int(value) and value >= least, f"{name} must be an integer >= {least}")
        _require(
            self.resampling_method in RESAMPLING_METHODS,
            f"unknown resampling method {self.resampling_method}",
        )
        _require(self.filter_method in FILTER_METHODS, f"unknown filter method {self.filter_method}")
        alpha = self.first_order_alpha
        if self.filter_method == "first_order":
            _require(_is_number(alpha) and 0 < alpha <= 1, "first_order_alpha must lie in (0, 1]")
        else:
            _require(alpha is None or _is_number(alpha), "first_order_alpha must be finite")
        _require(
            self.max_lag_minutes % self.lag_step_minutes == 0,
            "max_lag_minutes must be a multiple of lag_step_minutes",
        )
        _require(
            self.lag_step_minutes % self.sample_interval_minutes == 0,
            "lag_step_minutes must be a multiple of sample_interval_minutes",
        )
        if self.filter_method in ("trailing_mean", "trailing_median"):
            _require(
                self.smoothing_window_minutes >= self.sample_interval_minutes
                and self.smoothing_window_minutes % self.sample_interval_minutes == 0,
                "smoothing_window_minutes must be a multiple of sample_interval_minutes",
            )
        gap = self.gap_threshold_minutes
        _require(
            gap is None or (gap > 0 and gap >= self.sample_interval_minutes),
            "gap_threshold_minutes must not be shorter than sample_interval_minutes",
        )
        filters = tuple(
            f if isinstance(f, StateFilter) else StateFilter(**f) for f in self.state_filters
        )
        object.__setattr__(self, "state_filters", filters)

    @property
    def interval_us(self) -> int:
        return self.sample_interval_minutes * MINUTE

    @property
    def gap_us(self) -> int:
        """Longest step between two rows of one segment once rows sit on the target grid."""
        return int((self.gap_threshold_minutes or self.sample_interval_minutes) * MINUTE)

    @property
    def resamples(self) -> bool:
        return self.resampling_method != "none"

    @property
    def filter_rows(self) -> int:
        if self.filter_method in ("none", "first_order"):
            return 1
        return self.smoothing_window_minutes // self.sample_interval_minutes

    @property
    def lag_rows(self) -> int:
        return self.max_lag_minutes // self.sample_interval_minutes

    @property
    def lags(self) -> list[int]:
        return list(range(0, self.max_lag_minutes + 1, self.lag_step_minutes))

    @property
    def context_minutes(self) -> int:
        """History a window needs before its start so that its first row can be scored."""
        smoothing = (
            0
            if self.filter_method == "none"
            else max(0, self.smoothing_window_minutes - self.sample_interval_minutes)
        )
        bucket = self.sample_interval_minutes if self.resamples else 0
        return self.max_lag_minutes + smoothing + bucket

    def margin_us(self, raw_gap_us: int) -> int:
        """Halo a shard copies from the one before it.

        Neighbours inside a segment are at most one gap threshold apart, so this many
        thresholds always cover the rows a lag or a trailing filter can reach, plus one
        step to see whether the oldest of them starts a segment, plus one bucket.
        """
        step = max(self.gap_us, raw_gap_us, self.interval_us)
        return (self.lag_rows + self.filter_rows + 1) * step + 2 * self.interval_us

    def shard_us(
        self, raw_gap_us: int, shard_minutes: int | None = None, source_interval_minutes: float | None = None
    ) -> int:
        """Width of a time shard, a multiple of the interval and no shorter than the halo.

        A shard holds raw rows first, so its width follows whichever interval is shorter.
        """
        interval = self.interval_us
        if shard_minutes is None:
            densest = min(interval, int((source_interval_minutes or self.sample_interval_minutes) * MINUTE))
            rows = max(1, SHARD_ROWS * densest // interval)
        else:
            rows = ceil(shard_minutes * MINUTE / interval)
        need = self.margin_us(raw_gap_us)
        rows = max(rows, ceil(need / interval))
        return rows * interval


@dataclass(frozen=True)
class ExplorationConfig:
    cluster_count: int = 4
    random_state: int = 0
    minimum_candidate_duration_minutes: int = 30
    candidate_count_per_cluster: int = 3
    maximum_plot_points: int = 1200

    def __post_init__(self):
        _require(_is_int(self.cluster_count) and 2 <= self.cluster_count <= 10,
                 "cluster_count must be between 2 and 10")
        _require(_is_int(self.random_state), "random_state must be an integer")
        for name in ("minimum_candidate_duration_minutes", "candidate_count_per_cluster"):
            _require(_is_int(getattr(self, name)) and getattr(self, name) > 0,
                     f"{name} must be a positive integer")
        _require(_is_int(self.maximum_plot_points) and self.maximum_plot_points >= 2,
                 "maximum_plot_points must be at least 2")


@dataclass(frozen=True)
class PerformanceConfig:
    performance_tag: str
    direction: str
    target_min: float | None = None
    target_max: float | None = None
    minimum_duration_minutes: int = 30
    candidate_count: int = 3

    def __post_init__(self):
        _require(isinstance(self.performance_tag, str) and bool(self.performance_tag.strip()),
                 "performance_tag must not be empty")
        _require(self.direction in DIRECTIONS, f"direction must be one of {', '.join(DIRECTIONS)}")
        targets = (self.target_min, self.target_max)
        if self.direction == "target_range":
            _require(all(_is_number(t) for t in targets), "target_range needs finite targets")
            _require(targets[0] <= targets[1], "target_min must not exceed target_max")
        else:
            _require(targets == (None, None), "targets belong to target_range only")
        for name in ("minimum_duration_minutes", "candidate_count"):
            _require(_is_int(getattr(self, name)) and getattr(self, name) > 0,
                     f"{name} must be a positive integer")

    @property
    def lower(self) -> float:
        return -inf if self.target_min is None else self.target_min

    @property
    def upper(self) -> float:
        return inf if self.target_max is None else self.target_max
