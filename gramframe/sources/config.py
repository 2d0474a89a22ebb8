"""Job parameters with precedence explicit value > config mapping > default, and the
reduced 'quick' profile (one map, size 16, one repeat, one map repeat, two folds)."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class StudyConfig:
    # Fixed defaults of the studied configuration.
    test_size: float = 0.20
    seed: int = 20260802
    cv_folds: int = 5
    feature_maps: tuple = ("zz", "pauli", "custom")
    circuit_repetitions: int = 2
    map_repeats: int = 3
    subset_sizes: tuple = (16, 32, 64)
    repeats: int = 5
    remote_subset_size: int = 8
    remote_shots: int = 200
    remote_feature_map: str = "custom"
    output_dir: str = "results/output"
    extra: dict = field(default_factory=dict)

    def quick(self) -> "StudyConfig":
        return replace(self, feature_maps=("custom",), subset_sizes=(16,), repeats=1, map_repeats=1, cv_folds=2)


REMOTE_SECTION = {"subset_size": "remote_subset_size", "n_shots": "remote_shots", "feature_map": "remote_feature_map"}


def from_mapping(config: dict, quick: bool = False, **overrides) -> StudyConfig:
    """One merged mapping over the defaults: the file's values, its ``remote`` section, explicit values.
    An override of None counts as not given; names that are no parameter are left out."""
    section = config.get("remote") or {}
    merged = {**config, **{REMOTE_SECTION[k]: v for k, v in section.items() if k in REMOTE_SECTION},
              **{k: v for k, v in overrides.items() if v is not None}}
    names = {f.name for f in fields(StudyConfig)} - {"extra"}
    cfg = StudyConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items() if k in names})
    return cfg.quick() if quick else cfg
