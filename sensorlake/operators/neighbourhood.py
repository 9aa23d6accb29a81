"""Neighbourhood work on cell tables ``(frame..., r, c, value)``.

A kernel is applied separably: every cell is copied to the few cells it
contributes to along one axis (``explode`` of a literal array, no shuffle),
then reduced by target cell with map-side combining; then the other axis.
Nothing depends on a frame fitting into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.operators.ordered import _null_safe
from sensorlake.session import cut_lineage


def _spread(df: DataFrame, axis: str, offsets: Sequence[int], weights: Sequence[float] | None = None) -> DataFrame:
    if weights is None:
        arr = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(1.0).alias("w")) for o in offsets])
    else:
        arr = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(w)).alias("w")) for o, w in zip(offsets, weights)])
    d = df.withColumn("_k", F.explode(arr))
    return d.withColumn(axis, F.col(axis) + F.col("_k.o")).withColumn("_w", F.col("_k.w")).drop("_k")


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is sorted and merged, never broadcast.

    Spark judges exploded cells by the few rows they come from, and written
    cells by their packed size; it would collect millions of cells on the driver.
    """
    return df.hint("merge")


def _reach(k: int) -> list[int]:
    return list(range(-(k // 2), k // 2 + 1))


def morph(df: DataFrame, keys: Sequence[str], value: str, k: int, grow: bool, r: str = "r", c: str = "c") -> DataFrame:
    """Maximum (``grow``) or minimum over a k x k window.

    Growing may reach new cells; shrinking keeps the given cells and looks only
    at cells that exist (outside the frame nothing shrinks a value).
    """
    cells = df.select(*keys, r, c)
    d = df.select(*keys, r, c, value)
    red = F.max if grow else F.min
    for axis in (c, r):
        d = _spread(d, axis, _reach(k)).groupBy(*keys, r, c).agg(red(value).alias(value))
    if grow:
        return d
    return cells.join(_sorted(d), [*keys, r, c], "inner")


def dilate(df, keys, value, k, r="r", c="c", bounds: tuple[int, int] | None = None) -> DataFrame:
    """k x k maximum, cut to ``bounds`` (rows, columns) when given."""
    d = morph(df, keys, value, k, True, r, c)
    if bounds is not None:
        d = d.where((F.col(r) >= 0) & (F.col(r) < bounds[0]) & (F.col(c) >= 0) & (F.col(c) < bounds[1]))
    return d


def erode(df, keys, value, k, r="r", c="c") -> DataFrame:
    return morph(df, keys, value, k, False, r, c)


def opened(df, keys, value, k, r="r", c="c") -> DataFrame:
    """Erode, then dilate, on the cells of ``df``."""
    d = dilate(erode(df, keys, value, k, r, c), keys, value, k, r, c)
    return df.select(*keys, r, c).join(_sorted(d), [*keys, r, c])


def closed(df, keys, value, k, r="r", c="c") -> DataFrame:
    """Dilate, then erode, on the cells of ``df``."""
    d = dilate(df, keys, value, k, r, c)
    d = df.select(*keys, r, c).join(_sorted(d), [*keys, r, c])
    return erode(d, keys, value, k, r, c)


def splat(df: DataFrame, keys: Sequence[str], values: Sequence[str], k: int, r: str = "r", c: str = "c") -> DataFrame:
    """Several sparse layers grown together: each to its own maximum over k x k cells (odd ``k``), NULLs left out."""
    if k % 2 == 0:
        raise ValueError("a splat needs an odd size")
    d = df.select(*keys, r, c, *values)
    for axis in (c, r):
        d = _spread(d, axis, _reach(k)).groupBy(*keys, r, c).agg(*[F.max(v).alias(v) for v in values])
    return d


def mirror(i: Column, n: Column) -> Column:
    """Index folded back into 0..n-1 without repeating the edge cell."""
    j = F.abs(i)
    return F.when(j > n - 1, 2 * (n - 1) - j).otherwise(j)


def frame_size(df: DataFrame, keys: Sequence[str], r: str = "r", c: str = "c") -> DataFrame:
    return df.groupBy(*keys).agg((F.max(r) + 1).alias("_nr"), (F.max(c) + 1).alias("_nc"))


def convolve(df: DataFrame, keys: Sequence[str], value: str, row_kernel: Sequence[float], col_kernel: Sequence[float], name: str = "out", r: str = "r", c: str = "c", dense: bool = True, repeat: bool = False) -> DataFrame:
    """Separable correlation; the border of a dense frame is mirrored (or, with ``repeat``, its edge cells go on), a sparse one is normalised by weight.

    ``row_kernel`` runs down the rows, ``col_kernel`` along the columns.  A
    mirrored border is produced by sending each near-border cell to its mirror
    image as well.
    """
    d = df.select(*keys, r, c, F.col(value).cast("double").alias("_v"))
    size = frame_size(d, keys, r, c) if dense else None
    cells = d.select(*keys, r, c)
    for axis, kernel, n in ((c, col_kernel, "_nc"), (r, row_kernel, "_nr")):
        h = len(kernel) // 2
        if dense:
            d = _null_safe(d, size, keys, "inner") if keys else d.withColumn("_z", size.select(F.struct("*")).scalar()).select("*", "_z.*").drop("_z")
            x, m = F.col(axis), F.col(n)
            beyond = lambda a, b: F.transform(F.sequence(a, b), lambda p: F.struct(p.alias("p")))
            images = F.concat(
                F.array(F.struct(x.alias("p"))), F.when(x == 0, beyond(x - h, x - 1)).otherwise(F.array()), F.when(x == m - 1, beyond(x + 1, x + h)).otherwise(F.array())
            ) if repeat else F.filter(
                F.array(F.struct(x.alias("p")), F.struct(F.when((x >= 1) & (x <= h), -x).alias("p")), F.struct(F.when((x >= m - 1 - h) & (x < m - 1), 2 * (m - 1) - x).alias("p"))),
                lambda s: s["p"].isNotNull(),
            )
            d = d.withColumn("_i", F.explode(images)).withColumn(axis, F.col("_i.p")).drop("_i")
            d = _spread(d, axis, [-o for o in _reach(len(kernel))], kernel).where((F.col(axis) >= 0) & (F.col(axis) < m))
            d = d.groupBy(*keys, r, c).agg(F.sum(F.col("_w") * F.col("_v")).alias("_v"))
        else:
            d = _spread(d, axis, [-o for o in _reach(len(kernel))], kernel)
            d = d.groupBy(*keys, r, c).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_v"))
    if not dense:
        d = cells.join(d, [*keys, r, c])
    return d.withColumnRenamed("_v", name)


def gaussian_kernel(sigma: float, reach: int | None = None) -> list[float]:
    h = max(1, math.ceil(4 * sigma)) if reach is None else reach
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-h, h + 1)]
    s = sum(w)
    return [v / s for v in w]


def blur(df, keys, value, sigma: float, name="out", r="r", c="c", dense=True, reach=None) -> DataFrame:
    k = gaussian_kernel(sigma, reach)
    return convolve(df, keys, value, k, k, name, r, c, dense)


# 3 x 3 Sobel as smoothing and difference.
SMOOTH3 = (1.0, 2.0, 1.0)
DIFF3 = (-1.0, 0.0, 1.0)


def sobel(df, keys, value, r="r", c="c") -> DataFrame:
    """``gx, gy`` per cell."""
    gx = convolve(df, keys, value, SMOOTH3, DIFF3, "gx", r, c)
    gy = convolve(df, keys, value, DIFF3, SMOOTH3, "gy", r, c)
    return gx.join(gy, [*keys, r, c])


def unsharp(df, keys, value, sigma: float, amount: float, name="out", r="r", c="c") -> DataFrame:
    """Value plus ``amount`` times its difference to the blurred value, in 0..255."""
    b = blur(df, keys, value, sigma, "_b", r, c)
    v = F.col(value).cast("double")
    d = df.join(b, [*keys, r, c])
    sharp = F.bround(v * (1.0 + amount) - amount * F.col("_b"))
    return d.withColumn(name, F.least(F.greatest(sharp, F.lit(0.0)), F.lit(255.0)).cast("int")).drop("_b")


def local_detail(df, keys, value, sigma: float, name="detail", r="r", c="c") -> DataFrame:
    """Value minus its low-frequency background."""
    b = blur(df, keys, value, sigma, "_b", r, c)
    return df.join(b, [*keys, r, c]).withColumn(name, F.col(value) - F.col("_b")).drop("_b")


def median3(df, keys, value, name="med", r="r", c="c") -> DataFrame:
    """3 x 3 median; the edge cell is repeated outside a dense frame."""
    size = frame_size(df, keys, r, c)
    d = _null_safe(df.select(*keys, r, c, value), size, keys, "inner") if keys else df.select(r, c, value).withColumn("_z", size.select(F.struct("*")).scalar()).select("*", "_z.*").drop("_z")
    for axis, n in ((c, "_nc"), (r, "_nr")):
        x, m = F.col(axis), F.col(n)
        to = F.array(x - 1, x, x + 1)
        # a border cell also stands in for its missing neighbour
        extra = F.concat(F.when(x == 0, F.array(x)).otherwise(F.array().cast("array<int>")), F.when(x == m - 1, F.array(x)).otherwise(F.array().cast("array<int>")))
        d = d.withColumn("_t", F.explode(F.concat(to.cast("array<int>"), extra.cast("array<int>")))).where((F.col("_t") >= 0) & (F.col("_t") < m)).withColumn(axis, F.col("_t")).drop("_t")
    nine = F.array_sort(F.collect_list(value))  # nine values per cell by construction
    return d.groupBy(*keys, r, c).agg(F.get(nine, F.lit(4)).alias(name))


def nearest_fill(cells: DataFrame, keys: Sequence[str], values: Sequence[str], radius: int, r: str = "row", c: str = "col") -> DataFrame:
    """Empty cells within ``radius`` cells of a valid one take the nearest one's values; ``filled`` marks them.

    Equal distances go to the smaller row, then column.  Two passes: the nearest
    valid cell of each column up or down, then the nearest of those sideways, so
    a cell is copied along two lines, not over the whole disc.
    """
    line = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    up = cells.select(*keys, F.col(r).alias("_r0"), F.col(c).alias("_c0"), *values, line.alias("_i"))
    up = up.groupBy(*keys, (F.col("_r0") + F.col("_i")).alias("_r"), "_c0").agg(F.min(F.struct(F.abs("_i").alias("a"), F.col("_r0").alias("r0"), *values)).alias("_v"))
    side = up.select(*keys, "_r", "_c0", "_v", line.alias("_j")).withColumn("_d2", F.col("_v.a") * F.col("_v.a") + F.col("_j") * F.col("_j")).where((F.col("_d2") > 0) & (F.col("_d2") <= radius * radius))
    cand = F.min(F.struct(F.col("_d2").alias("d2"), F.col("_v.r0").alias("r0"), F.col("_c0").alias("c0"), *[F.col(f"_v.{v}").alias(v) for v in values]))
    to = side.groupBy(*keys, "_r", (F.col("_c0") + F.col("_j")).alias("_c")).agg(cand.alias("_n"))
    to = to.select(*keys, F.col("_r").alias(r), F.col("_c").alias(c), *[F.col(f"_n.{v}").alias(v) for v in values], F.lit(True).alias("filled"))
    empty = to.join(cells.select(*keys, r, c), [*keys, r, c], "left_anti")
    return cells.select(*keys, r, c, *values, F.lit(False).alias("filled")).unionByName(empty)


def canopy(cells: DataFrame, keys: Sequence[str], height: str, k: int, sigma: float, r: str = "row", c: str = "col") -> DataFrame:
    """Height above the blurred lower envelope (k x k minimum), not below 0."""
    low = erode(cells.select(*keys, r, c, height), keys, height, k, r, c).withColumnRenamed(height, "_low")
    low = blur(low, keys, "_low", sigma, "_env", r, c, dense=False, reach=max(1, math.ceil(2 * sigma)))
    return cells.join(low, [*keys, r, c]).withColumn("canopy", F.greatest(F.col(height) - F.col("_env"), F.lit(0.0))).drop("_env")


# Edge of the square blocks that source pixels are packed into for a warp.
WARP_TILE = 16


def _blocks(source: DataFrame, keys: Sequence[str], value: str, r: str, c: str) -> DataFrame:
    """Source pixels packed into square blocks that share their last row and column with the next ones.

    Per block (``_k_*, _tr, _tc``) row-major ``_vals``, pixels given twice added
    up, and ``_has``: 0 without a pixel, 1 if it is NULL, 2 with a value.
    """
    t = WARP_TILE
    home = lambda x: F.floor(F.col(x) / t).cast("int")
    reach = lambda x: F.when(F.pmod(F.col(x), F.lit(t)) == 0, F.array(home(x), home(x) - 1)).otherwise(F.array(home(x)))
    s = source.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(r).cast("int").alias("_r0"), F.col(c).cast("int").alias("_c0"), F.col(value).cast("double").alias("_v"))
    s = s.where(F.col("_r0").isNotNull() & F.col("_c0").isNotNull())
    s = s.withColumn("_tr", F.explode(reach("_r0"))).withColumn("_tc", F.explode(reach("_c0")))
    at = (F.col("_r0") - F.col("_tr") * t) * (t + 1) + F.col("_c0") - F.col("_tc") * t
    g = s.groupBy(*[f"_k_{k}" for k in keys], "_tr", "_tc").agg(F.collect_list(F.struct(at.alias("i"), F.coalesce("_v", F.lit(0.0)).alias("v"), F.col("_v").isNotNull().cast("int").alias("f"))).alias("_p"))

    @F.pandas_udf("struct<vals:array<double>,has:array<tinyint>>")
    def dense(at: pd.Series, v: pd.Series, full: pd.Series) -> pd.DataFrame:
        vals, has = [], []
        for i, x, f in zip(at, v, full):
            block, there = np.zeros((t + 1) ** 2), np.zeros((t + 1) ** 2, np.int8)
            np.add.at(block, i, x)
            np.maximum.at(there, i, f.astype(np.int8) + np.int8(1))
            vals.append(block)
            has.append(there)
        return pd.DataFrame({"vals": vals, "has": has})

    b = g.select(*[f"_k_{k}" for k in keys], "_tr", "_tc", dense(F.col("_p.i"), F.col("_p.v"), F.col("_p.f")).alias("_d"))
    return b.select(*[f"_k_{k}" for k in keys], "_tr", "_tc", F.col("_d.vals").alias("_vals"), F.col("_d.has").alias("_has"))


def warp(source: DataFrame, targets: DataFrame, keys: Sequence[str], h_inv: Column, value: str, r: str = "r", c: str = "c") -> DataFrame:
    """Source pixels resampled at the target cells: bilinear ``value`` and nearest ``valid``.

    ``h_inv`` maps target (column, row) to source.  A target cell meets one
    block of source pixels, which holds all (up to four) neighbours it asks
    for; cells without any of them are left out.  A NULL pixel is there but
    adds nothing.
    """
    from sensorlake.functions.geometry import h_apply

    u, v = h_apply(h_inv, F.col(c).cast("double"), F.col(r).cast("double"))
    t = targets.select(*keys, r, c, u.alias("_u"), v.alias("_v")).where(F.col("_u").isNotNull())
    fu, fv = F.floor("_u").cast("int"), F.floor("_v").cast("int")
    t = t.select(*keys, r, c, fu.alias("_fu"), fv.alias("_fv"), (F.col("_u") - fu).alias("_a"), (F.col("_v") - fv).alias("_b"))
    t = t.withColumn("_tr0", F.floor(F.col("_fv") / WARP_TILE).cast("int")).withColumn("_tc0", F.floor(F.col("_fu") / WARP_TILE).cast("int"))
    s = _blocks(source, keys, value, r, c)
    j = t.join(_sorted(s), [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_tr0") == F.col("_tr"), F.col("_tc0") == F.col("_tc")])
    first = (F.col("_fv") - F.col("_tr") * WARP_TILE) * (WARP_TILE + 1) + F.col("_fu") - F.col("_tc") * WARP_TILE
    offset = lambda i, k: i * (WARP_TILE + 1) + k
    corners = [(i, k) for i in (0, 1) for k in (0, 1)]
    j = j.select(*keys, r, c, "_a", "_b", *[F.get("_has", first + offset(i, k)).alias(f"_h{i}{k}") for i, k in corners], *[F.get("_vals", first + offset(i, k)).alias(f"_v{i}{k}") for i, k in corners])
    near = F.when(F.col("_b") >= 0.5, F.when(F.col("_a") >= 0.5, F.col("_h11")).otherwise(F.col("_h10"))).otherwise(F.when(F.col("_a") >= 0.5, F.col("_h01")).otherwise(F.col("_h00")))
    there, filled, total = F.lit(False), F.lit(False), F.lit(0.0)
    for i, k in corners:
        w = (F.col("_a") if k else 1.0 - F.col("_a")) * (F.col("_b") if i else 1.0 - F.col("_b"))
        full = F.col(f"_h{i}{k}") == 2
        there, filled, total = there | (F.col(f"_h{i}{k}") > 0), filled | full, total + F.when(full, w * F.col(f"_v{i}{k}")).otherwise(0.0)
    return j.where(there).select(*keys, r, c, F.when(filled, total).alias(value), (near > 0).alias("valid"))


def label_components(cells: DataFrame, keys: Sequence[str], tile: int = 256, r: str = "r", c: str = "c") -> DataFrame:
    """8-connected labels of the given cells: the smallest cell id of each component as ``label``.

    Cells are labelled inside square tiles of bounded size, then only the
    labels that touch across tile borders are joined, by repeated hooking of
    each label to the smallest neighbour and pointer jumping.  Loop results are
    written to the checkpoint folder.
    """
    width = 1 << 31
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name in keys)
    schema = (key_types + ", " if key_types else "") + f"`{r}` int, `{c}` int, lab bigint"

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        rr, cc = pdf[r].to_numpy(np.int64), pdf[c].to_numpy(np.int64)
        r0, c0 = rr.min(), cc.min()
        box = np.full((rr.max() - r0 + 3, cc.max() - c0 + 3), np.iinfo(np.int64).max)
        at = (rr - r0 + 1, cc - c0 + 1)
        ids = rr * width + cc
        box[at] = ids
        while True:
            cur = box[at]
            best = cur
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    best = np.minimum(best, box[at[0] + i, at[1] + j])
            # follow the chain of labels inside the tile
            br, bc = best // width, best % width
            best = np.minimum(best, box[br - r0 + 1, bc - c0 + 1])
            if (best == cur).all():
                break
            box[at] = best
        return pdf[[*keys, r, c]].assign(lab=box[at])

    tiled = cells.select(*keys, F.col(r).cast("int").alias(r), F.col(c).cast("int").alias(c)).distinct()
    tiled = tiled.withColumn("_tr", F.floor(F.col(r) / tile)).withColumn("_tc", F.floor(F.col(c) / tile))
    lab = cut_lineage(tiled.groupBy(*keys, "_tr", "_tc").applyInPandas(local, schema))
    edge = lambda v: F.pmod(F.col(v), F.lit(tile)).isin(0, tile - 1)
    border = lab.where(edge(r) | edge(c))
    near = border.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) > (0, 0)])))
    near = near.select(*keys, (F.col(r) + F.col("_o.i")).alias(r), (F.col(c) + F.col("_o.j")).alias(c), F.col("lab").alias("a"))
    pairs = near.join(border.withColumnRenamed("lab", "b"), [*keys, r, c]).where("a <> b").select(*keys, "a", "b").distinct()
    both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both)
    root = cut_lineage(both.select(*keys, F.col("a").alias("v")).distinct().withColumn("root", F.col("v")))
    while True:
        seen = both.join(root.withColumnRenamed("v", "b").withColumnRenamed("root", "_nb"), [*keys, "b"])
        low = seen.groupBy(*keys, F.col("a").alias("v")).agg(F.min("_nb").alias("_low"))
        hooked = root.join(low, [*keys, "v"]).select(*keys, "v", F.least("root", "_low").alias("_h"), F.col("root").alias("_was"))
        jump = hooked.select(*keys, F.col("v").alias("_h"), F.col("_h").alias("_up"))
        nxt = hooked.join(jump, [*keys, "_h"], "left").select(*keys, "v", F.least(F.col("_h"), F.coalesce("_up", "_h")).alias("root"), "_was")
        nxt = cut_lineage(nxt)
        root = nxt.select(*keys, "v", "root")
        if nxt.where("root <> _was").isEmpty():
            break
    out = lab.join(root.withColumnRenamed("v", "lab"), [*keys, "lab"], "left")
    return out.select(*keys, r, c, F.coalesce("root", "lab").alias("label"))


def component_table(labelled: DataFrame, keys: Sequence[str], r: str = "r", c: str = "c") -> DataFrame:
    """Area, half-open box and centroid per component."""
    return labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.min(c).alias("x0"), F.min(r).alias("y0"), (F.max(c) + 1).alias("x1"), (F.max(r) + 1).alias("y1"), F.avg(c).alias("cx"), F.avg(r).alias("cy")
    )


def largest_rectangle(mask: DataFrame, keys: Sequence[str], r: str = "r", c: str = "c") -> DataFrame:
    """Largest axis-aligned rectangle of set cells per frame: ``area, x0, y0, x1, y1`` (half-open).

    Column heights come from a gaps-and-islands window per (frame, column).
    Each raster row then becomes one record of at most ``width`` heights, and a
    vectorised helper finds the best rectangle that ends in that row; the frame
    maximum is an aggregate.  Ties go to the upper-left rectangle.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys, c).orderBy(r)
    d = mask.select(*keys, r, c).distinct().withColumn("_run", F.col(r) - F.row_number().over(w))
    h = Window.partitionBy(*keys, c, "_run").orderBy(r)
    d = d.select(*keys, r, c, F.row_number().over(h).alias("_h"))
    rows = d.groupBy(*keys, r).agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("c"), F.col("_h").alias("h")))).alias("_l"))

    @F.pandas_udf("struct<area:bigint,x0:int,x1:int,h:int>")
    def widest(cs: pd.Series, hs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_best_in_row(a, b) for a, b in zip(cs, hs)], columns=["area", "x0", "x1", "h"])

    best = rows.select(*keys, r, widest(F.transform("_l", lambda x: x["c"]), F.transform("_l", lambda x: x["h"])).alias("_b"))
    y0 = (F.col(r) + 1 - F.col("_b.h")).alias("y0")
    top = F.min(F.struct((-F.col("_b.area")).alias("a"), y0, F.col("_b.x0").alias("x0"), F.col("_b.x1").alias("x1"), (F.col(r) + 1).alias("y1")))
    g = best.groupBy(*keys).agg(top.alias("_t"))
    return g.select(*keys, (-F.col("_t.a")).alias("area"), "_t.x0", "_t.y0", "_t.x1", "_t.y1")


def _best_in_row(cols, heights) -> tuple[int, int, int, int]:
    """Best (area, x0, x1, height) over one row of column heights (gaps count as 0)."""
    best = (0, 0, 0, 0)
    open_: list[tuple[int, int]] = []  # (start column, height), heights rising
    prev = None

    def close(limit: int, end: int) -> int:
        nonlocal best
        start = end
        while open_ and open_[-1][1] >= limit:
            start, h = open_.pop()
            area = h * (end - start)
            if area > best[0] or (area == best[0] and (-h, start) < (-best[3], best[1])):
                best = (area, start, end, h)
        return start

    for col, h in zip(cols, heights):
        col, h = int(col), int(h)
        if prev is not None and col != prev + 1:
            close(1, prev + 1)
        start = close(h, col)
        open_.append((start, h))
        prev = col
    if prev is not None:
        close(1, prev + 1)
    return best
