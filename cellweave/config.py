"""One dataclass per stage. The defaults are fixed values of the analysis method."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QcConfig:
    """Thresholds in pixels; every rule is strict and fails on NaN."""

    position_x: str = "nucleus_Location_Center_X"
    position_y: str = "nucleus_Location_Center_Y"
    cell_area: str = "cell_AreaShape_Area"
    nucleus_area: str = "nucleus_AreaShape_Area"
    # nucleus measure the cytoplasm rule compares with; the nucleus area unless set
    ratio_area: str | None = None
    solidity: str = "nucleus_AreaShape_Solidity"
    min_dist_left: float = 100
    min_dist_right: float = 100
    min_dist_top: float = 100
    min_dist_bottom: float = 100
    image_width: float = 1344
    image_height: float = 1024
    # pixels of an image for the background rule; width times height unless set
    image_area: float | None = None
    min_nucleus_area: float = 1000
    max_nucleus_area: float = 4000
    min_area_fraction: float = 1.5
    max_area_fraction: float = 15
    min_solidity: float = 0.9
    min_cells: int = 1
    max_cells: int = 300
    min_background_area: float = 50000


@dataclass(frozen=True)
class FilterConfig:
    """Control-like split. Modes: 0 med + c·MAD, 1 c·med, 2 and 3 the same with the 10 % limit."""

    features: tuple[str, ...] = ()
    control_treatments: tuple[str, ...] = ()
    cutoff_threshold: float = 1.0
    cutoff_fraction: float = 0.8
    mode: int = 0
    run_mahal_dist: bool = True
    valid_only: bool = False
    threshold_fraction: float = 0.2
    min_stddev: float = 0.01
    max_correlation: float = 0.9


@dataclass(frozen=True)
class ClusterConfig:
    method: str = "k-means"
    k: int = 100
    p: float = 2.0
    discard_size: int = 20
    dissolve_size: int = 200
    swap_threshold: int = 1
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    sharpness: float = 1.0
    max_depth: int = 4
    target: int | None = None
    # small clusters whose centroids average, complete and weighted linkage start from
    micro: int = 256


@dataclass(frozen=True)
class ProfileConfig:
    exp_factor: float = -1.0
    metric: str = "quadratic_chi"
    threshold: float = 0.0
    normalization: float = 0.5
    p: float = 2.0
    linkage: str = "average"


@dataclass(frozen=True)
class SplitConfig:
    random_splits: int = 3
    random_fraction: float = 0.5
    penetrance_threshold: float = 0.0
    replicate_distance_threshold: float = float("inf")
    seed: int = 1


@dataclass(frozen=True)
class SweepConfig:
    methods: tuple[str, ...] = ("k-means",)
    param1: tuple = (100,)
    param2: tuple = (-1,)
    param3: tuple = (2,)
    param4: tuple = (20,)
    exp_factors: tuple = (-1.0,)
    metrics: tuple[str, ...] = ("summed_minmax",)
    splits: SplitConfig = field(default_factory=SplitConfig)
    penetrance_filter: bool = True
