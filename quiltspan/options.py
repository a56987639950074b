"""Options of a scoring run."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScoringOptions:
    """Frozen, so that it can go into any closure. ``digits``: round positions, components and weights to so many
    decimals, as result files do (None: not at all); ``exact_rounding``: round the binary value, by a Python function
    over Arrow batches, instead of the shortest decimal, which Spark's own function rounds."""

    feature_evalue: float = 0.001
    instance_evalue: float = 0.01
    max_overlap: int = 0
    max_overlap_share: float = 0.4
    max_features: int = 30
    max_paths: int = 500
    paths_limit: int = 1  # 1: off
    weight_multiplicity: float = 0.7
    weight_clan: float = 0.0
    weight_position: float = 0.3
    count_correction: str = "loge"
    uniform_weights: bool = True
    empty_as_1: bool = False
    linearize: bool = True
    digits: int | None = None
    exact_rounding: bool = False
    constraints: dict[str, float] = field(default_factory=dict)
    distance_default: float = 0.5  # the distance variant's weight of features that its weight file does not name

    def __post_init__(self) -> None:
        weights = (self.weight_multiplicity, self.weight_clan, self.weight_position)
        if not math.isclose(sum(weights), 1.0, abs_tol=1e-9) or min(weights) < 0:
            raise ValueError(f"score weights must be positive and sum to 1, not {weights}")
        if not 0 <= self.max_overlap_share <= 1:
            raise ValueError("max_overlap_share must lie between 0 and 1")
        if self.count_correction not in ("linear", "loge", "log10", "root4", "root8"):
            raise ValueError(f"unknown count correction {self.count_correction}")
        if sum(self.constraints.values()) > 1 + 1e-9:
            raise ValueError("constraints must not sum to more than 1")
