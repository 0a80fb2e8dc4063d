"""Plain settings passed to the operators, with the presets and their checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

NORMALIZATIONS = ("zscore", "minmax", "percentile")
INTERPOLATIONS = ("trilinear", "nearest")


@dataclass(frozen=True)
class CohortConfig:
    root: str = ""
    session_3t: str = "ses-1"
    session_7t: str = "ses-2"
    modalities: tuple[str, ...] = ("T1w", "T2w")
    file_pattern: str = "*_defaced.nii.gz"
    mask_pattern: str = "*brain_mask.nii.gz"


@dataclass(frozen=True)
class PreprocessConfig:
    orientation: str = "RAS"
    spacing: tuple[float, float, float] | None = (1.0, 1.0, 1.0)
    interpolation: str = "trilinear"
    skull_strip: bool = True
    normalization: str = "zscore"
    percentile_lower: float = 1.0
    percentile_upper: float = 99.0
    clip_values: bool = True
    clip_lower: float = 0.5
    clip_upper: float = 99.5
    size: tuple[int, int, int] | None = None


@dataclass(frozen=True)
class SplitConfig:
    seed: int = 42
    train: float = 0.6
    val: float = 0.2
    test: float = 0.2
    k_folds: int | None = None


@dataclass(frozen=True)
class AugmentConfig:
    enabled: bool = True
    affine_prob: float = 0.5
    rotate: tuple[float, float, float] = (0.1, 0.1, 0.1)
    translate: tuple[float, float, float] = (10.0, 10.0, 10.0)
    scale: tuple[float, float, float] = (0.1, 0.1, 0.1)
    flip_prob: float = 0.5
    flip_axes: tuple[int, ...] = (0,)
    shift_prob: float = 0.3
    shift_offset: float = 0.1
    scale_prob: float = 0.3
    scale_factor: float = 0.1
    noise_prob: float = 0.2
    noise_std: float = 0.01
    smooth_prob: float = 0.2
    smooth_sigma: tuple[float, float] = (0.5, 1.5)
    dropout_prob: float = 0.0
    dropout_holes: tuple[int, int] = (6, 10)
    dropout_side: tuple[int, int] = (8, 32)


@dataclass(frozen=True)
class Config:
    cohort: CohortConfig = field(default_factory=CohortConfig)
    preprocess: PreprocessConfig = field(default_factory=PreprocessConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    augment: AugmentConfig = field(default_factory=AugmentConfig)
    batch_size: int = 2

    @classmethod
    def default(cls) -> "Config":
        return cls()

    @classmethod
    def highres(cls) -> "Config":
        return cls(
            preprocess=PreprocessConfig(spacing=(0.5, 0.5, 0.5), size=(256, 256, 256)),
            batch_size=1,
        )

    @classmethod
    def fast(cls) -> "Config":
        return cls(
            preprocess=PreprocessConfig(spacing=(2.0, 2.0, 2.0), size=(96, 96, 96)),
            batch_size=4,
        )

    def with_root(self, root: str) -> "Config":
        return replace(self, cohort=replace(self.cohort, root=root))

    def validate(self, check_root: bool = False) -> "Config":
        check_ratios(self.split.train, self.split.val, self.split.test)
        check_choice("normalization", self.preprocess.normalization, NORMALIZATIONS)
        check_choice("interpolation", self.preprocess.interpolation, INTERPOLATIONS)
        if check_root and "://" not in self.cohort.root and not os.path.exists(self.cohort.root):
            raise ValueError(f"cohort root does not exist: {self.cohort.root}")
        return self


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios)}")


def check_choice(what: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; expected one of {', '.join(allowed)}")
