"""The rule profile and channel names."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """Fixed values of the shipped rule profile; tests use a shorter reset gap."""

    shelf_off_value: float = 850.0
    shelf_off_tolerance: float = 0.5
    start_vacuum_upper: float = 2.0
    stop_vacuum_lower: float = 4.0
    defrost_start_temperature_c: float = 0.0
    defrost_stop_power_upper: float = 5.0
    state_reset_gap_minutes: float = 180.0
    parallel_window_minutes: float = 30.0
    parallel_window_tolerance_minutes: float = 10.0
    minimum_s4_s2_change_c: float = 3.0
    minimum_vacuum_change: float = 0.2
    maximum_energy_gap_minutes: float = 15.0


SHELVES = ["RAF1", "RAF2", "RAF3", "RAF4"]
COILS = ["S1", "S2", "S3", "S4"]
# fixed values: other names of channels
ALIASES = {
    "RAF1 HEDEF": "RAF1", "RAF2 HEDEF": "RAF2", "RAF3 HEDEF": "RAF3", "RAF4 HEDEF": "RAF4",
    "RAF 1": "RAF1", "RAF 2": "RAF2", "RAF 3": "RAF3", "RAF 4": "RAF4",
    "S 1": "S1", "S 2": "S2", "S 3": "S3", "S 4": "S4",
    "SERP1": "S1", "SERP2": "S2", "SERP3": "S3", "SERP4": "S4",
    "KOND": "KONDANSER", "VACUUM": "VACUM",
}
STEP_COLUMNS = ["RECETE NO", "RECETE ADIM"]
# fixed values: other names under which stored rows may hold a channel of the rules, the first present one counts
LOOKUPS = {
    "E.GUC": ["E.GUC", "E_GUC", "POWER"], "TARTIM": ["TARTIM", "WEIGHT"], "VACUM": ["VACUM", "VACUUM"],
    "S1": ["S1", "S 1"], "S2": ["S2", "S 2", "SERP2"], "S3": ["S3", "S 3"], "S4": ["S4", "S 4", "SERP4"],
}
SHELF_AVERAGE = "RAF_AVG"
# fixed values: unit, group and axis of the channels, in their order
CHANNELS = {
    "RAF1": ("°C", "shelf", "main"), "RAF2": ("°C", "shelf", "main"), "RAF3": ("°C", "shelf", "main"), "RAF4": ("°C", "shelf", "main"), "RAF_AVG": ("°C", "shelf", "main"),
    "L_PRES": (None, "pressure", "main"), "H_PRES": (None, "pressure", "main"), "VACUM": (None, "vacuum", "vacuum"),
    "S1": ("°C", "cooling", "main"), "S2": ("°C", "cooling", "main"), "S3": ("°C", "cooling", "main"), "S4": ("°C", "cooling", "main"),
    "SERP2": ("°C", "cooling", "main"), "SERP4": ("°C", "cooling", "main"), "KONDANSER": ("°C", "cooling", "main"),
    "TARTIM": ("kg", "other", "main"), "E.GUC": (None, "other", "main"), "E.TUKETIM": (None, "other", "main"),
}
GROUPS = ["shelf", "pressure", "vacuum", "cooling", "other"]
