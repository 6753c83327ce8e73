"""Process monitoring with dynamic PCA as Spark DataFrame operators."""

from procmon.config import (
    ExplorationConfig,
    PerformanceConfig,
    PreprocessingConfig,
    StateFilter,
)
from procmon.session import build_session

__all__ = [
    "ExplorationConfig",
    "PerformanceConfig",
    "PreprocessingConfig",
    "StateFilter",
    "build_session",
]
