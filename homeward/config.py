"""Parameters of the jobs. Everything a run can vary is an argument, not an environment setting."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class KnnConfig:
    """Physical choices of the nearest-neighbour join; none of them changes its result."""

    strategy: str = "auto"  # auto | broadcast_base | broadcast_queries | blocked
    # Most bytes of vectors, and of columns carried beside them, shipped to every worker.
    broadcast_bytes: int = 64 << 20
    spread_below: int = 1_000_000  # query rows up to which they are spread over all cores
    task_results: int = 1_000_000  # queries x k held by one task
    block_bytes: int = 256 << 20  # vectors of one query block, held by a task
    task_bytes: int = 1 << 30  # vectors of one base block, streamed through a task
    stream_bytes: int = 32 << 20  # vectors of base rows scored at a time while streaming
    merge_fan_in: int = 64  # base partitions whose results are merged at a time
    # Rows of either block, instead of the above, where that makes 64 blocks of a side at most.
    block_rows: int | None = None
    max_pivots: int = 1024
    rows_per_pivot: int = 50_000
    tile: tuple[int, int] = (256, 4096)  # rows of both sides scored in one matrix product


@dataclass(frozen=True)
class MatchConfig:
    """Matching rules. Weights and cut-offs are fixed values of the scoring model."""

    as_of_year: int
    dim: int = 512
    face_threshold: float = 0.80
    candidate_threshold: float = 0.45
    pool_factor: int = 5
    limit: int = 10
    metadata_weight: float = 0.3
    age_tolerance: int = 5
    accept_combined: float = 0.55
    accept_face: float = 0.50
    accept_metadata: float = 0.60
    gender_conflict_factor: float = 0.4
    gender_weight: float = 0.30
    age_weight: float = 0.30
    marks_weight: float = 0.25
    location_weight: float = 0.15
    validate_both: bool = False
    prefilter: bool = False
    knn: KnnConfig = field(default_factory=KnnConfig)

    @property
    def face_weight(self) -> float:
        return 1.0 - self.metadata_weight

    @property
    def pool_size(self) -> int:
        return self.limit * self.pool_factor


@dataclass(frozen=True)
class ConfidenceConfig:
    """Confidence weights (normalised to sum to one) and level cut-offs."""

    face: float = 0.5
    metadata: float = 0.2
    age: float = 0.15
    location: float = 0.1
    features: float = 0.05
    very_high: float = 0.90
    high: float = 0.75
    medium: float = 0.60
    low: float = 0.40
    gender_conflict_factor: float = 0.5

    @property
    def weights(self) -> dict[str, float]:
        raw = {
            "face_similarity": self.face,
            "metadata_consistency": self.metadata,
            "age_plausibility": self.age,
            "location_proximity": self.location,
            "distinctive_features": self.features,
        }
        total = sum(raw.values())
        return {name: value / total for name, value in raw.items()}
