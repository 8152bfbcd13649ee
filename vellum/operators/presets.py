"""Augmentation presets as rows of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The parameters of the default preset, and what the others set otherwise. Pairs are ranges.
DEFAULT = {
    "model_size": 224, "local_size": 96, "global_crops_scale": (0.35, 1.0), "local_crops_scale": (0.10, 0.40), "global_crops_number": 2, "local_crops_number": 6,
    "rotation_prob": 0.5, "rotation_degrees": 4.0, "rotation_fill": 255, "color_jitter_prob": 0.5, "brightness": 0.3, "contrast": 0.3, "saturation": 0.2, "hue": 0.03,
    "grayscale_prob": 0.3, "blur_prob_global1": 0.3, "blur_prob_global2": 0.1, "blur_prob_local": 0.4, "jpeg_prob": 0.3, "jpeg_quality": (35, 95), "erosion_dilation_prob": 0.3,
}
MILD = {
    "global_crops_scale": (0.50, 1.0), "local_crops_scale": (0.20, 0.50), "local_crops_number": 4, "rotation_prob": 0.0, "color_jitter_prob": 0.3, "brightness": 0.2, "contrast": 0.2,
    "saturation": 0.1, "hue": 0.02, "grayscale_prob": 0.2, "blur_prob_global1": 0.2, "blur_prob_global2": 0.1, "blur_prob_local": 0.3, "jpeg_prob": 0.2, "jpeg_quality": (50, 95), "erosion_dilation_prob": 0.2,
}
AGGRESSIVE = {
    "global_crops_scale": (0.25, 1.0), "local_crops_scale": (0.05, 0.40), "local_crops_number": 8, "rotation_prob": 0.7, "rotation_degrees": 4.0, "color_jitter_prob": 0.8, "brightness": 0.4, "contrast": 0.4,
    "saturation": 0.3, "hue": 0.05, "grayscale_prob": 0.4, "blur_prob_global1": 0.5, "blur_prob_global2": 0.2, "blur_prob_local": 0.5, "jpeg_prob": 0.5, "jpeg_quality": (25, 90), "erosion_dilation_prob": 0.5,
}
PRESETS = {"mild": MILD, "default": {}, "aggressive": AGGRESSIVE}


def preset(name: str = "default", **overrides) -> dict:
    """All parameters of a preset, overrides on top; an unknown preset or parameter is an error."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; known: {sorted(PRESETS)}")
    if unknown := set(overrides) - set(DEFAULT):
        raise ValueError(f"no such parameters: {sorted(unknown)}")
    return DEFAULT | PRESETS[name] | overrides


def preset_rows(spark: SparkSession, **overrides) -> DataFrame:
    """(preset, parameter, low, high): every parameter of every preset; a single value is both ends of its range."""
    rows = []
    for name in PRESETS:
        for k, v in preset(name, **overrides).items():
            low, high = v if isinstance(v, tuple) else (v, v)
            rows.append((name, k, float(low), float(high)))
    return spark.createDataFrame(rows, "preset string, parameter string, low double, high double")
