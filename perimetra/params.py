"""Thresholds of every operator, with their published default values.

Each family is a frozen dataclass; operators take an instance, so a site may run
with its own numbers without touching the logic.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sensor:
    rows: int = 192
    cols: int = 256
    frame_rows: int = 344
    optical_rows: int = 480
    optical_cols: int = 640
    fps: float = 25.0
    stale_after_s: float = 2.0
    warn_after_failures: int = 25
    warn_every_failures: int = 150
    frame_bytes: int = 256 * 344 * 2
    slack_bytes: int = 4096
    pair_tolerance_s: float = 0.040


@dataclass(frozen=True)
class Calibration:
    raw_zero: float = 4850.0
    raw_per_degree: float = 31.0
    ambient_scale: float = 100.0
    gain: float = 1.0157
    offset: float = 3.37
    knee: float = 150.0
    quad: float = -0.00294
    lin: float = 1.129
    const: float = -3.12
    above_knee: float = 49.92


@dataclass(frozen=True)
class Tracking:
    max_step_px: float = 28.0
    max_misses: int = 12
    history: int = 40
    min_flap_obs: int = 8


@dataclass(frozen=True)
class Classify:
    w_flap: float = 0.45
    w_hot: float = 0.30
    w_shape: float = 0.15
    w_straight: float = 0.10
    flap_bird: float = 0.30
    flap_rigid: float = 0.15
    hot_drone_c: float = 6.0
    hot_flat_c: float = 2.0
    straight_drone: float = 0.90
    min_hits: int = 8
    decision: float = 0.58
    min_travel_px: float = 8.0
    max_area_px: float = 2000.0
    landed_parts: int = 2
    landed_aspect: float = 2.6
    landed_extent: float = 0.25
    landed_contrast_c: float = 3.0
    shape_area_px: float = 25.0


@dataclass(frozen=True)
class Threat:
    unknown_risk: float = 0.15
    watch: float = 0.45
    alert: float = 0.75
    site_when_permitted: float = 0.25
    hot_hint_c: float = 8.0


@dataclass(frozen=True)
class ThermalSite:
    cell_px: int = 8
    noise_floor_c: float = 0.35
    z_enter: float = 4.5
    min_dev_c: float = 1.0
    persist_s: float = 3.0
    persist_decay: int = 3
    adapt_s: float = 90.0
    max_anomalous: float = 0.10
    max_region_cells: int = 80
    slowdown: float = 40.0
    min_learned: int = 125
    scene_frames: int = 400
    activity_obs: int = 1500
    familiar_count: float = 20.0
    min_traffic_px: float = 0.5
    dwell_warn_s: float = 5.0
    dwell_full_s: float = 20.0
    feature_alpha: float = 1.0 / 3000.0
    fps: float = 25.0
    grid_rows: int = 24
    grid_cols: int = 32

    @property
    def persist_frames(self) -> int:
        return max(1, int(self.persist_s * self.fps))

    @property
    def alpha_floor(self) -> float:
        return 1.0 / max(1.0, self.adapt_s * self.fps)


@dataclass(frozen=True)
class OpticalSite:
    cell_px: int = 32
    min_learned: int = 90
    warm_n: float = 8.0
    adapt_s: float = 240.0
    persist_s: float = 6.0
    structure_floor: float = 0.10
    tone_floor: float = 0.15
    z_anomalous: float = 3.5
    z_full: float = 9.0
    mature_at: float = 0.9
    activity_floor: float = 0.02
    activity_full: float = 0.25
    activity_alpha: float = 0.01
    max_dev_sigma: float = 4.0
    hot_gain: float = 0.05
    min_region_cells: int = 3
    max_region_cells: int = 30
    min_region_fill: float = 0.45
    max_regions: int = 6
    settled_novelty: float = 0.75
    fps: float = 25.0
    grid_rows: int = 15
    grid_cols: int = 20

    @property
    def persist_frames(self) -> int:
        return max(1, int(self.persist_s * self.fps))

    @property
    def alpha_floor(self) -> float:
        return 1.0 / max(1.0, self.adapt_s * self.fps)


@dataclass(frozen=True)
class Detect:
    threshold_c: float = 1.5
    min_area: float = 4.0
    max_area: float = 4000.0
    alpha: float = 0.02
    warmup: int = 20
    merge_gap_px: int = 6
    optical_threshold: float = 18.0
    optical_min_area: float = 12.0
    optical_max_area: float = 30000.0
    noise_sigma: float = 6.0
    mad_scale: float = 1.4826
    max_box_frac: float = 0.22
    max_side_ratio: float = 6.0
    min_fill: float = 0.14
    optical_gap_px: float = 8.0
    optical_gap_frac: float = 0.35
    roi_pad_px: int = 12


@dataclass(frozen=True)
class Fusion:
    match_px: float = 28.0
    name_cover: float = 0.15
    held_cover: float = 0.40
    hold_s: float = 12.0
    name_trust: float = 0.50
    aircraft_trust: float = 0.12
    static_pad_px: int = 6
    optical_pad_px: int = 16
    warm_c: float = 1.2
    hot_core_c: float = 5.0
    patch_margin_px: int = 2
    ring_px: int = 6
    crop_margin_px: int = 10
    min_shape_px: float = 60.0
    good_shape_px: float = 400.0
    drone_aspect_lo: float = 0.55
    drone_aspect_hi: float = 1.80
    drone_solidity: float = 0.62
    bird_aspect: float = 2.10
    bird_solidity: float = 0.52
    contact_cell_px: int = 24
    contact_gap_s: float = 2.0
    contact_purge_s: float = 10.0
    settle_radius_px: float = 3.0
    settle_min_hits: int = 4
    interest: float = 0.30


@dataclass(frozen=True)
class Alerting:
    open_after: int = 8
    close_after_s: float = 5.0
    threshold: float = 0.75
    keep_closed: int = 20
    forget_number_s: float = 8.0
    watch_min_dwell_s: float = 6.0
    watch_limit: int = 12
    optical_shown: int = 8
    trail_limit: int = 14


@dataclass(frozen=True)
class Escalate:
    at: float = 0.75
    doubt_at: float = 0.35
    unsure_conf: float = 0.65
    cold_dwell_s: float = 20.0
    cooldown_s: float = 60.0
    min_gap_s: float = 6.0
    max_queue: int = 4


@dataclass(frozen=True)
class Rig:
    """Camera-to-camera calibration."""

    thermal_per_frame: int = 2
    optical_per_frame: int = 3
    min_inliers: int = 12
    min_frames: int = 8
    max_pairs: int = 600
    fit_every: int = 12
    scenery_window: int = 90
    scenery_share: float = 0.85
    scenery_warmup: int = 30
    settled_pairs: int = 40
    dedupe_px: float = 3.0
    min_bbox: float = 0.25
    min_minor: float = 0.05
    accept_px: float = 8.0
    ransac_iters: int = 8000
    ransac_px: float = 3.0
    manual_px: float = 5.0


@dataclass(frozen=True)
class Scoring:
    match_px: float = 22.0


SENSOR = Sensor()
CALIBRATION = Calibration()
TRACKING = Tracking()
CLASSIFY = Classify()
THREAT = Threat()
THERMAL_SITE = ThermalSite()
OPTICAL_SITE = OpticalSite()
DETECT = Detect()
FUSION = Fusion()
ALERTING = Alerting()
ESCALATE = Escalate()
RIG = Rig()
SCORING = Scoring()

# Rows of one key that may share a window partition: every ordered operator cuts its
# key at this many steps of the frame clock (about 11.6 hours at 25 frames a second).
CHUNK_FRAMES = 1 << 20
# Boxes that ride together with a copy of their frame's pixels.
BUNDLE = 4096
