"""Typed stream export: the window is cut before decoding, failures stay beside the rows, keys survive the write."""

import numpy as np

from sensorlake.plans import exports
from sensorlake.sources import decode

CLOUD = "bag_id string, cloud_ts bigint, height int, width int, point_step int, fields array<struct<name:string,offset:int,datatype:int>>, data binary"


def _packet(v):
    rec = np.zeros(1, decode.IMU_DTYPE)
    rec["a"][:] = v
    return rec.tobytes()


def _streams(spark, centre):
    fields = [{"name": n, "offset": 4 * i, "datatype": 7} for i, n in enumerate(("x", "y", "z"))]
    pts = np.arange(6, dtype="<f4").tobytes()
    imu = spark.createDataFrame([("007", 100, 1, _packet(1.0)), ("007", 110, 2, b"short"), ("007", 151, 3, _packet(2.0)), (None, 150, 4, _packet(3.0))], "bag_id string, ts_ns bigint, seq bigint, raw binary")
    clouds = spark.createDataFrame([("007", 100, 1, 2, 12, fields, pts), ("b", 50, 1, 2, 12, fields, pts[:-1]), ("b", 49, 1, 2, 12, fields, pts)], CLOUD)
    fixes = spark.createDataFrame([("007", 100, 1, 0, 1.0, 2.0, 3.0), ("007", 100, 2, -1, 1.0, 2.0, 3.0)], "bag_id string, ts_ns bigint, seq bigint, status int, lat double, lon double, alt double")
    vel = spark.createDataFrame([("007", 100, 1, (3.0, 4.0, 0.0)), ("007", 101, 2, None)], "bag_id string, ts_ns bigint, seq bigint, v struct<x:double,y:double,z:double>")
    vel = vel.selectExpr("bag_id", "ts_ns", "seq", "CASE WHEN v IS NOT NULL THEN named_struct('linear', v) END AS twist")
    return exports.typed_streams(imu, clouds, fixes, vel, centre, 50)


def test_export_keeps_failures_and_keys(spark, tmp_path):
    w = exports.write_streams(_streams(spark, 100), str(tmp_path))
    rows = {(r.stream, r.bag_id): tuple(r)[2:] for r in exports.stream_manifest(w).collect()}
    assert rows == {
        ("imu", "007"): (1, 1, 100, 100), ("imu", None): (1, 0, 150, 150), ("cloud", "007"): (2, 0, 100, 100), ("cloud", "b"): (0, 1, None, None),
        ("gnss", "007"): (1, 0, 100, 100), ("velocity", "007"): (1, 1, 100, 100),
    }
    assert [r.error for r in w["imu"].where("failed").collect()] == ["packet too short: 5 bytes"]
    assert [(r.x, r.y, r.z) for r in w["cloud"].where("bag_id = '007'").orderBy("seq").collect()] == [(0.0, 1.0, 2.0), (3.0, 4.0, 5.0)]
    assert w["velocity"].where("NOT failed").first().speed_mps == 5.0


def test_export_without_a_window_and_of_nothing(spark, tmp_path):
    everything = exports.stream_manifest(exports.write_streams(_streams(spark, None), str(tmp_path / "all")))
    assert {(r.stream, r.bag_id): r.rows for r in everything.collect()}[("imu", "007")] == 2
    nothing = exports.write_streams(_streams(spark, 10_000), str(tmp_path / "none"))
    assert exports.stream_manifest(nothing).count() == 0


def test_export_writes_a_file_per_task_not_per_recording(spark, tmp_path):
    vel = spark.range(0, 300, 1, 2).selectExpr("IF(id = 7, '', concat('b', id % 150)) AS bag_id", "100 - id AS ts_ns", "id AS seq", "CAST(NULL AS struct<linear:struct<x:double,y:double,z:double>>) AS twist")
    streams = {"velocity": vel.selectExpr("*", "IF(seq % 3 = 0, 'no twist', NULL) AS error")}
    w = exports.write_streams(streams, str(tmp_path))["velocity"]
    assert len(list(tmp_path.rglob("*.parquet"))) <= 4  # two tasks, good and failed rows
    rows = w.collect()
    assert len(rows) == 300 and sum(r.failed for r in rows) == 100 and {r.bag_id for r in rows} == {"", *(f"b{i}" for i in range(150))}
    for part in tmp_path.rglob("*.parquet"):
        got = [(r.bag_id, r.ts_ns) for r in spark.read.parquet(str(part)).collect()]
        assert got == sorted(got)
