"""Confidence and status ladders, names and precedence, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence classes in order of preference; anything else ranks 9.
CONFIDENCE_RANK = {"subpixel": 0, "subpixel_or_scalar": 1, "model_strong": 2}
OTHER_RANK = 9
# Bonus added to the score of a detection by its confidence class.
CONFIDENCE_BONUS = {"subpixel_strong": 1e6, "subpixel_partial": 8e5, "model_strong": 5e5, "model_partial": 2e5}
# Stand-in frame number of a detection without one (sorts last).
NO_FRAME = 1_000_000_000


def _lookup(c: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(c == name, F.lit(value)).otherwise(out)
    return out


def confidence_rank(c: Column) -> Column:
    return _lookup(c, CONFIDENCE_RANK, OTHER_RANK)


def confidence_bonus(c: Column) -> Column:
    return _lookup(c, CONFIDENCE_BONUS, 0.0)


def partial_grid_confidence(method: Column, cols: Column, rows: Column, corr: Column, score: Column, nx: Column, ny: Column) -> Column:
    """Class of a partial-grid candidate of the mosaic cameras."""
    corr, score = F.coalesce(corr, F.lit(0.0)), F.coalesce(score, F.lit(0.0))
    full = (cols >= 7) & (rows >= 3)
    return (
        F.when(method.startswith("opencv") & full, "subpixel_strong")
        .when(method.startswith("opencv"), "subpixel_partial")
        .when((corr >= 0.58) & (score >= 150) & (nx >= 8) & (ny >= 4), "model_strong")
        .when((corr >= 0.42) & (score >= 118) & (nx >= 7) & (ny >= 3), "model_partial")
        .otherwise("weak_reject")
    )


def template_confidence(sensor: Column, corr: Column, score: Column) -> Column:
    """Class of a template match, with one threshold pair per sensor group."""
    corr, score = F.coalesce(corr, F.lit(0.0)), F.coalesce(score, F.lit(0.0))
    strong = (
        F.when(sensor == "rgb", (corr >= 0.45) & (score >= 125))
        .when(sensor.isin("vis", "nir"), (corr >= 0.50) & (score >= 140))
        .otherwise((corr >= 0.55) & (score >= 150))
    )
    partial = (sensor != "rgb") & (corr >= 0.38) & (score >= 118)
    return F.when(strong, "strong").when(partial, "partial_visual_check").otherwise("weak_reject")


def intrinsics_status(sensor: Column, rms: Column, median: Column) -> Column:
    mosaic = F.when((rms <= 3.5) & (median <= 1.5), "candidate_partial_subpixel").otherwise("weak_candidate_high_reprojection_error")
    thermal = F.when(rms <= 2.0, "candidate_model_assisted").otherwise("weak_candidate_model_assisted")
    return F.when(sensor.isin("vis", "nir"), mosaic).when(sensor == "thermal", thermal).otherwise("candidate")


def homography_status(sensor: Column, median: Column) -> Column:
    mosaic = sensor.isin("vis", "nir")
    good, weak = F.when(mosaic, 18.0).otherwise(15.0), F.when(mosaic, 35.0).otherwise(30.0)
    return (
        F.when(median <= good, "target_plane_homography_candidate")
        .when(median <= weak, "target_plane_homography_weak_high_error")
        .otherwise("target_plane_homography_rejected_high_error")
    )


def stereo_status(rms: Column) -> Column:
    return (
        F.when(rms <= 10.0, "physical_extrinsic_candidate")
        .when(rms <= 25.0, "physical_extrinsic_weak_high_stereo_rms")
        .otherwise("physical_extrinsic_rejected_high_stereo_rms")
    )


def rescue_confidence(full: Column, plane_ok: Column, rotation_ok: Column) -> Column:
    """Class of a rescued detection, with a warning suffix for a doubtful rotation."""
    name = F.when(full & plane_ok & rotation_ok, "subpixel_full_rescue").when(full & ~plane_ok, "subpixel_full_alt_plane").otherwise("subpixel_partial_rescue")
    return F.when(rotation_ok, name).otherwise(F.concat(name, F.lit("_rotation_warning")))


def label_of(label_norm: Column, label_raw: Column, bag: Column) -> Column:
    """First non-empty of normalised label, raw label, recording name."""
    empty = F.lit("")
    return F.coalesce(F.nullif(label_norm, empty), F.nullif(label_raw, empty), bag)


def safe_topic(topic: Column) -> Column:
    """Topic as a folder name."""
    return F.regexp_replace(F.regexp_replace(topic, "^/+", ""), "[^A-Za-z0-9_.-]+", "_")


def frame_name(sensor: Column, index: Column, stamp_ns: Column, suffix: str = ".png") -> Column:
    """``sensor/000012_1700000000000000000.png``."""
    return F.concat(sensor, F.lit("/"), F.lpad(index.cast("string"), 6, "0"), F.lit("_"), stamp_ns.cast("string"), F.lit(suffix))
