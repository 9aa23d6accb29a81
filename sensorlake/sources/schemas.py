"""Fixed schemas of the tables the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MANIFEST_TEXT = ("include_default", "bag", "bag_path", "label_raw", "label_norm", "pose_index", "height_level", "pose", "repeat_group", "all_labels")
MANIFEST_DOUBLE = ("size_gb", "duration_s")
MANIFEST_INT = ("messages", "rgb_msgs", "vis_msgs", "nir_msgs", "thermal_c_msgs", "cloud_msgs", "gps_msgs")

MESSAGES = _struct(bag_id=_S, topic=_S, ts_ns=_L, seq=_L, msgtype=_S, raw=T.BinaryType())

DETECTION = _struct(
    checker_detected=_B,
    panel_detected=_B,
    method=_S,
    confidence=_S,
    frame_index=_I,
    stamp_ns=_L,
    score=_D,
    quality=_D,
    rotation_ok=_B,
    corners_px=T.ArrayType(T.ArrayType(_D)),
    pattern_internal_corners=T.ArrayType(_I),
    panel_box_xyxy=T.ArrayType(_D),
)
DETECTION_DOCUMENT = _struct(
    results=T.ArrayType(
        _struct(
            bag=_S,
            label_raw=_S,
            label_norm=_S,
            processed=_B,
            reason=_S,
            detections=T.MapType(_S, DETECTION),
            projected_boxes_from_rgb=T.MapType(_S, T.ArrayType(_D)),
        )
    )
)

MATRIX = T.ArrayType(T.ArrayType(_D))
HOMOGRAPHY_DOCUMENT = _struct(homographies=T.MapType(_S, MATRIX))

IMU = "bag_id string, bag_ts_ns bigint, seq bigint, diag_ts_ns bigint, accel_ts_ns bigint, gyro_ts_ns bigint, buf_len int, ax float, ay float, az float, gx float, gy float, gz float, error string"
POINTS = "bag_id string, cloud_ts bigint, i int, x float, y float, z float, intensity float, t bigint, reflectivity int, noise int, range bigint"
PIXELS = "frame_id string, r int, c int, band int, value float, error string"
