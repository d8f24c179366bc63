"""Threshold sets for scanning and growing. The numbers are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    name: str
    merge_cutoff: float = 0.1
    max_k: int = 10
    max_dims: int = 2
    bic: str = "bic"
    # eligibility of a single marker
    unique_per_cells: float = 30.0      # distinct values must exceed n / this …
    unique_cap: int = 100               # … or this many, whichever is smaller
    fixed_unique: int | None = None     # a plain minimum instead of the two above
    dip_slope: float | None = 0.01      # dip must reach (1 - cutoff) * slope …
    dip_floor: float = 0.006            # … and this floor
    max_fitted_k: int | None = 8
    few_k: int | None = 5               # more components than this need …
    few_unique: int = 100               # … this many distinct values
    # merging
    tail_merge: str = "none"            # none | always | small_n
    tail_limit: float = 0.049
    tail_cells: int = 1000
    # pair rescan: similarity band (as multiples of the cutoff, capped) and pair cutoff
    band_low: float = 1.0
    band_high: float = 2.0
    band_cap: float = 0.8
    pair_factor: float = 1.2
    pair_cap: float = 0.8
    # scoring
    min_side: int = 100
    min_cluster: int = 5
    similarity_bonus: float = 0.0       # + bonus * (cutoff - similarity)
    low_similarity: float | None = 0.01  # below it the score loses 10
    spread_guard: bool = False
    # stopping
    min_cells: int = 300
    stop_score: float = -10.0
    min_partition: int = 30
    # soft second pass when the strict gate leaves nothing separable
    soft: tuple[float, int, float, float] | None = (40.0, 50, 0.004, 0.006)

    def with_options(self, **options) -> "Profile":
        return replace(self, **options)


PROFILES = {
    # single surface-marker table
    "marker": Profile("marker", tail_merge="small_n"),
    # components of expression
    "component": Profile(
        "component", fixed_unique=50, dip_slope=0.002, dip_floor=0.0, max_fitted_k=None, few_k=None,
        tail_merge="always", tail_limit=0.05, band_low=0.0, band_high=4.0, pair_factor=2.0, pair_cap=0.6,
        low_similarity=None, min_cells=200, soft=None,
    ),
    # batches voting for a shared split
    "consensus": Profile(
        "consensus", unique_cap=50, dip_slope=None, max_fitted_k=None, few_k=None, band_low=0.0, band_cap=0.9,
        pair_factor=1.0, min_side=20, min_cluster=10, similarity_bonus=2.0, low_similarity=None, spread_guard=True,
        min_cells=100, stop_score=-90.0, soft=None,
    ),
    # first generation: entropy score, few gates
    "entropy": Profile(
        "entropy", fixed_unique=50, dip_slope=None, max_fitted_k=None, few_k=None, band_low=1.0, band_high=5.0,
        band_cap=0.5, pair_factor=1.0, min_side=1, min_cluster=1, low_similarity=None, min_cells=21, min_partition=1,
        soft=None,
    ),
}
