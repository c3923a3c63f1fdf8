"""Cleaning plan: the configuration surface, validated once, never mutated by a run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

STRATEGIES = ("mean", "median", "ffill", "drop", "time")
OUTLIER_METHODS = ("iqr", "zscore", "none")


@dataclass(frozen=True)
class CleanPlan:
    numeric_columns: tuple[str, ...] = ()  # empty: every numeric column after coercion (row id excluded)
    categorical_columns: tuple[str, ...] = ()
    date_columns: tuple[str, ...] = ()
    dedup_keys: tuple[str, ...] = ()
    missing_strategy: str = "median"
    missing_drop_threshold: float = 0.5
    outlier_method: str = "iqr"
    outlier_iqr_multiplier: float = 1.5
    physical_bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    auto_unit_conversion: bool = False
    unit_range_heuristic: bool = False
    max_yield: float | None = None
    salinity_tolerance: float | None = None  # carried for reporting; no rule reads it
    harvest_months: tuple[int, ...] = ()
    soil_texture: str | None = None  # carried for reporting; no rule reads it
    soft_cleaning: bool = False
    calculate_gdd: bool = False
    t_base: float | None = None
    # explicit row identity and roles (pandas has an implicit index; we do not)
    row_id: str = "rid"
    date_col: str = "date"
    field_col: str = "field_id"
    categorical_by: tuple[str, ...] = ()  # empty: categorical fill is global by date
    protect_columns: tuple[str, ...] = ()  # never dropped by the sparse-column rule
    preset_name: str | None = None
    checkpoint: bool = False  # cut lineage after the window-heavy steps
    quantile_accuracy: int | None = None  # None: exact quantiles; else percentile_approx accuracy

    def __post_init__(self) -> None:
        if self.missing_strategy not in STRATEGIES:
            raise ValueError(f"missing_strategy must be one of {STRATEGIES}")
        if self.outlier_method not in OUTLIER_METHODS:
            raise ValueError(f"outlier_method must be one of {OUTLIER_METHODS}")
        if not 0.0 <= self.missing_drop_threshold <= 1.0:
            raise ValueError("missing_drop_threshold must be in [0, 1]")
        if self.outlier_iqr_multiplier <= 0:
            raise ValueError("outlier_iqr_multiplier must be > 0")
        if self.max_yield is not None and self.max_yield < 0:
            raise ValueError("max_yield must be >= 0")
        if self.salinity_tolerance is not None and self.salinity_tolerance < 0:
            raise ValueError("salinity_tolerance must be >= 0")
        for c, (lo, hi) in self.physical_bounds.items():
            if lo > hi:
                raise ValueError(f"lower bound {lo} of {c!r} is above upper bound {hi}")

    def with_(self, **kw) -> "CleanPlan":
        return replace(self, **kw)

    @staticmethod
    def from_dict(d: dict) -> "CleanPlan":
        kw = dict(d)
        for k in ("numeric_columns", "categorical_columns", "date_columns", "dedup_keys", "harvest_months"):
            if k in kw and kw[k] is not None:
                kw[k] = tuple(kw[k])
        if "physical_bounds" in kw:
            kw["physical_bounds"] = {c: (float(v[0]), float(v[1])) for c, v in (kw["physical_bounds"] or {}).items()}
        known = set(CleanPlan.__dataclass_fields__)
        return CleanPlan(**{k: v for k, v in kw.items() if k in known})

    @staticmethod
    def from_yaml(path: str) -> "CleanPlan":
        import yaml

        with open(path, encoding="utf-8") as f:
            return CleanPlan.from_dict(yaml.safe_load(f) or {})


# --- fixed values: the default plan file's content -----------------------------------------------
DEFAULT_PLAN = CleanPlan(
    numeric_columns=("temp", "humidity", "ph", "yield", "rainfall"),
    categorical_columns=("field_id", "crop_type"),
    date_columns=("date",),
    dedup_keys=("field_id", "date"),
    missing_strategy="median",
    missing_drop_threshold=0.5,
    outlier_method="iqr",
    outlier_iqr_multiplier=1.5,
    physical_bounds={"ph": (0.0, 14.0), "humidity": (0.0, 100.0), "temp": (-30.0, 60.0), "rainfall": (0.0, 2000.0)},
)
