"""Binary message decoding as Arrow jobs: inertial packets, point clouds, raw frames.

Spark partitions the messages; each task turns a batch of buffers into rows.
Buffers can be megabytes, so keep ``spark.sql.execution.arrow.maxRecordsPerBatch``
small (tens) for clouds and frames.  Bad buffers become rows with ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.sources import schemas as sc

# Packet layout (3 little-endian u64 stamps, then acceleration in
# g and rotation in deg/s as f32), useful length, and standard gravity.
IMU_DTYPE = np.dtype([("diag", "<u8"), ("accel_ts", "<u8"), ("gyro_ts", "<u8"), ("a", "<f4", 3), ("w", "<f4", 3)])
IMU_BYTES = 48
GRAVITY = 9.80665


# Rows collected before a batch is handed back to Spark.
FLUSH_ROWS = 500_000


def _stack(parts: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate([np.asarray(p[k]) for p in parts]) for k in parts[0]})


def decode_imu(messages: DataFrame) -> DataFrame:
    """Decoded packets of ``bag_id, ts_ns, seq, raw``, with SI units; short packets keep only ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["raw"].map(lambda b: 0 if b is None else len(b)).astype("int32")
            ok = (size >= IMU_BYTES).to_numpy()
            rec = np.frombuffer(b"".join(bytes(b[:IMU_BYTES]) for b in pdf["raw"][ok]), IMU_DTYPE)
            out = pd.DataFrame({"bag_id": pdf["bag_id"], "bag_ts_ns": pdf["ts_ns"], "seq": pdf["seq"]})

            def put(values, dtype):
                col = pd.array([None] * len(pdf), dtype=dtype)
                col[ok] = values
                return col

            for name, f in (("diag_ts_ns", "diag"), ("accel_ts_ns", "accel_ts"), ("gyro_ts_ns", "gyro_ts")):
                out[name] = put(rec[f].astype("int64"), "Int64")
            out["buf_len"] = size
            for i, axis in enumerate("xyz"):
                out[f"a{axis}"] = put(rec["a"][:, i], "Float32")
                out[f"g{axis}"] = put(rec["w"][:, i], "Float32")
            out["error"] = np.where(ok, None, "packet too short: " + size.astype(str) + " bytes")
            yield out[[c.split()[0] for c in sc.IMU.split(", ")]]

    d = messages.select("bag_id", "ts_ns", "seq", "raw").mapInPandas(run, sc.IMU)
    a = [F.col(f"a{x}").cast("double") for x in "xyz"]
    g = [F.col(f"g{x}").cast("double") for x in "xyz"]
    return d.select(
        "bag_id", "bag_ts_ns", "seq", "diag_ts_ns", "accel_ts_ns", "gyro_ts_ns", "buf_len", "error",
        *[c.alias(f"accel_{x}_g") for c, x in zip(a, "xyz")], *[(c * GRAVITY).alias(f"accel_{x}_mps2") for c, x in zip(a, "xyz")],
        *[c.alias(f"gyro_{x}_dps") for c, x in zip(g, "xyz")], *[F.radians(c).alias(f"gyro_{x}_radps") for c, x in zip(g, "xyz")],
    )


# Point-field datatype codes.
POINT_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
POINT_FIELDS = ("x", "y", "z", "intensity", "t", "reflectivity", "noise", "range")


def explode_clouds(clouds: DataFrame, fields: Sequence[str] = POINT_FIELDS) -> DataFrame:
    """Points of ``bag_id, cloud_ts, height, width, point_step, fields, data``.

    ``fields`` (array of name, offset, datatype) describes the layout; the
    argument ``fields`` limits which are decoded.  Clouds are stored azimuth by
    azimuth, so ring = i mod height and column = i div height.  A missing or
    short buffer gives one row with ``error`` and no point.
    """
    wanted = [f for f in POINT_FIELDS if f in fields]
    kinds = {"x": "f4", "y": "f4", "z": "f4", "intensity": "f4", "t": "i8", "reflectivity": "i4", "noise": "i4", "range": "i8"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # messages of one layout are decoded together, as many at once as give FLUSH_ROWS points
            points, step = pdf["height"].astype("int64") * pdf["width"].astype("int64"), pdf["point_step"].astype("int64")
            size = pdf["data"].map(lambda b: -1 if b is None else len(b)).astype("int64")
            good = (size >= points * step) & (size >= 0)
            layouts = pdf["fields"].map(lambda fs: tuple((f["name"], f["offset"], POINT_TYPES.get(f["datatype"])) for f in fs))
            for layout, of in pdf.groupby([layouts, step], sort=False).indices.items():
                kept = dict((n, (o, t)) for n, o, t in layout[0])
                have = [f for f in wanted if kept.get(f, (0, None))[1]]
                dtype = np.dtype({"names": have, "formats": [kept[f][1] for f in have], "offsets": [kept[f][0] for f in have], "itemsize": int(layout[1])})
                ok = good.to_numpy()[of] & (dtype.itemsize > 0)
                bad, of = pdf.iloc[of[~ok]], of[ok]
                if len(bad):
                    why = np.where(bad["data"].isna(), "no data", "short buffer")
                    yield pd.DataFrame({"bag_id": bad["bag_id"], "cloud_ts": bad["cloud_ts"], "i": None, "h": bad["height"].astype("int32"), **dict.fromkeys(POINT_FIELDS), "error": why})
                n = points.to_numpy()[of]
                ends = np.cumsum(n)
                cuts = np.searchsorted(ends, np.arange(FLUSH_ROWS, ends[-1] if len(ends) else 0, FLUSH_ROWS))
                for part in np.split(np.arange(len(of)), np.unique(cuts)):
                    if not len(part):
                        continue
                    m, k = pdf.iloc[of[part]], n[part]
                    rec = np.frombuffer(b"".join(d[: c * dtype.itemsize] for d, c in zip(m["data"], k)), dtype)
                    first = np.repeat(np.cumsum(k) - k, k)
                    out = {c: np.repeat(m[c].to_numpy(), k) for c in ("bag_id", "cloud_ts")}
                    out.update({"i": (np.arange(len(rec)) - first).astype("int32"), "h": np.repeat(m["height"].to_numpy("int32"), k)})
                    out.update({f: rec[f].astype(kinds[f]) if f in have else np.full(len(rec), None, object) for f in POINT_FIELDS})
                    yield pd.DataFrame({**out, "error": np.full(len(rec), None, object)})

    schema = sc.POINTS + ", h int, error string"
    names = [c.split()[0] for c in schema.split(", ")]
    d = clouds.select("bag_id", "cloud_ts", "height", "width", "point_step", "fields", "data").mapInPandas(lambda it: (p[names] for p in run(it)), schema)
    ring, col = F.pmod("i", "h"), F.floor(F.col("i") / F.col("h")).cast("int")
    return d.select("bag_id", "cloud_ts", "i", ring.alias("ring"), col.alias("col"), *POINT_FIELDS, "error")


# Sample type and bands (in blue, green, red order) per encoding.
ENCODINGS = {
    "mono8": ("u1", (0,)), "8uc1": ("u1", (0,)), "mono16": ("<u2", (0,)), "16uc1": ("<u2", (0,)), "16sc1": ("<i2", (0,)),
    "32fc1": ("<f4", (0,)), "64fc1": ("<f8", (0,)), "bgr8": ("u1", (0, 1, 2)), "rgb8": ("u1", (2, 1, 0)),
}


def explode_frames(frames: DataFrame) -> DataFrame:
    """Pixels ``frame_id, r, c, band, value`` of ``frame_id, encoding, height, width, data``.

    Bands are in blue, green, red order.  Unknown encodings and short buffers
    give one row with ``error``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, pending = [], 0
            for m in pdf.itertuples(index=False):
                kind = ENCODINGS.get(str(m.encoding).lower().strip())
                h, w = int(m.height), int(m.width)
                need = 0 if kind is None else h * w * len(kind[1]) * np.dtype(kind[0]).itemsize
                if kind is None or m.data is None or len(m.data) < need:
                    why = "unknown encoding" if kind is None else "short buffer"
                    parts.append({"frame_id": [m.frame_id], "r": [None], "c": [None], "band": [None], "value": [None], "error": [why]})
                    continue
                b = len(kind[1])
                img = np.frombuffer(m.data, kind[0], count=h * w * b).reshape(h, w, b)[:, :, list(kind[1])]
                r, c, k = np.indices((h, w, b), dtype="int32")
                n = r.size
                parts.append({"frame_id": np.full(n, m.frame_id, object), "r": r.ravel(), "c": c.ravel(), "band": k.ravel(), "value": img.ravel().astype("float32"), "error": np.full(n, None, object)})
                pending += n
                if pending >= FLUSH_ROWS:
                    yield _stack(parts)
                    parts, pending = [], 0
            if parts:
                yield _stack(parts)

    return frames.select("frame_id", "encoding", "height", "width", "data").mapInPandas(run, sc.PIXELS)
