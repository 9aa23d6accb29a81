"""Queries on pixel rasters: kernels, fills, components, band and frame statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.functions import geometry as gm
from sensorlake.operators import frames as fr
from sensorlake.operators import neighbourhood as nb
from sensorlake.operators import pixels as px
from sensorlake.plans.fixtures import fx_pixels, with_sql
from sensorlake.plans.q_points import TIE, _cells, cells_sql
from sensorlake.plans.registry import query

K = ["frame"]


def _px(spark, sf):
    return fx_pixels(spark, sf).select("frame", "r", "c", "v")


@query(
    "raster_dilate",
    "RAS-02",
    with_sql(
        "SELECT a.frame, a.r, a.c, max(b.v) AS v FROM fx_pixels a JOIN (SELECT frame, r+i AS r, c+j AS c, v FROM fx_pixels, (SELECT unnest([-2,-1,0,1,2]) AS i), (SELECT unnest([-2,-1,0,1,2]) AS j)) b ON a.frame=b.frame AND a.r=b.r AND a.c=b.c GROUP BY a.frame, a.r, a.c",
        "fx_pixels",
    ),
)
def raster_dilate(spark, sf):
    p = _px(spark, sf)
    return p.select("frame", "r", "c").join(nb.dilate(p, K, "v", 5, bounds=(64, 64)), ["frame", "r", "c"])


OPEN = """e AS (SELECT a.frame, a.r, a.c, min(b.v) AS v FROM fx_pixels a JOIN (SELECT frame, r+i AS r, c+j AS c, v FROM fx_pixels, (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j)) b ON a.frame=b.frame AND a.r=b.r AND a.c=b.c GROUP BY a.frame, a.r, a.c)"""


@query(
    "raster_open",
    "RAS-02",
    with_sql(
        "SELECT a.frame, a.r, a.c, max(b.v) AS v FROM e a JOIN (SELECT frame, r+i AS r, c+j AS c, v FROM e, (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j)) b ON a.frame=b.frame AND a.r=b.r AND a.c=b.c GROUP BY a.frame, a.r, a.c",
        "fx_pixels",
        OPEN,
    ),
)
def raster_open(spark, sf):
    return nb.opened(_px(spark, sf), K, "v", 3)


SOBEL = """sz AS (SELECT frame, max(r) AS mr, max(c) AS mc FROM fx_pixels GROUP BY frame),
nb AS (SELECT a.frame, a.r, a.c, i, j, b.v FROM fx_pixels a JOIN sz USING (frame), (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), fx_pixels b
  WHERE b.frame=a.frame AND b.r=CASE WHEN abs(a.r+i)>mr THEN 2*mr-abs(a.r+i) ELSE abs(a.r+i) END AND b.c=CASE WHEN abs(a.c+j)>mc THEN 2*mc-abs(a.c+j) ELSE abs(a.c+j) END),
sb AS (SELECT frame, r, c, sum(v*j*(2-abs(i)))::DOUBLE AS gx, sum(v*i*(2-abs(j)))::DOUBLE AS gy FROM nb GROUP BY frame, r, c)"""


@query("sobel_gradient", "RAS-03", with_sql("SELECT frame, r, c, gx, gy FROM sb", "fx_pixels", SOBEL))
def sobel_gradient(spark, sf):
    return nb.sobel(_px(spark, sf), K, "v")


@query(
    "sobel_quality",
    "AGG-29 RAS-03",
    with_sql(
        "SELECT frame, round(s+0.35::DOUBLE*g-25*sat,6) AS quality FROM (SELECT frame, stddev_pop(v) AS s, avg((v<=2 OR v>=253)::INT) AS sat FROM fx_pixels GROUP BY frame) JOIN (SELECT frame, avg(abs(gx)+abs(gy)) AS g FROM sb GROUP BY frame) USING (frame)",
        "fx_pixels",
        SOBEL,
    ),
)
def sobel_quality(spark, sf):
    q = px.image_quality(_px(spark, sf), K, "v", *px.QUALITY_WEIGHTS["campaign"])
    return q.select("frame", F.round("quality", 6).alias("quality"))


@query(
    "gradient_energy_roi",
    "AGG-44",
    with_sql(
        """SELECT frame, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM (SELECT *, (x1-x0)*(y1-y0)<=0.8::DOUBLE*nr*nc AS ok FROM (
  SELECT frame, nr, nc, greatest(0,min(j)*bw-trunc(nc*0.1::DOUBLE)::INT)::INT AS x0, greatest(0,min(i)*bh-trunc(nr*0.1::DOUBLE)::INT)::INT AS y0, least(nc,(max(j)+1)*bw+trunc(nc*0.1::DOUBLE)::INT)::INT AS x1, least(nr,(max(i)+1)*bh+trunc(nr*0.1::DOUBLE)::INT)::INT AS y1 FROM (
    SELECT *, row_number() OVER (PARTITION BY frame ORDER BY s DESC, i DESC, j DESC) AS rn FROM (SELECT frame, nr, nc, bh, bw, r//bh AS i, c//bw AS j, var_pop(gx*gx+gy*gy) AS s FROM (
      SELECT sb.*, mr+1 AS nr, mc+1 AS nc, (mr+1)//4 AS bh, (mc+1)//4 AS bw FROM sb JOIN sz USING (frame)) WHERE bh>=8 AND bw>=8 AND r//bh<4 AND c//bw<4 GROUP BY ALL)) WHERE rn<=4 GROUP BY frame, nr, nc, bh, bw))""",
        "fx_pixels",
        SOBEL,
    ),
)
def gradient_energy_roi(spark, sf):
    return px.gradient_roi(_px(spark, sf), K, "v")


def _gauss_sql(sigma):
    k = nb.gaussian_kernel(sigma)
    h = len(k) // 2
    ks = ",".join(f"{w!r}::DOUBLE" for w in k)
    fold = lambda a, o, m: f"CASE WHEN abs({a}+{o})>{m} THEN 2*{m}-abs({a}+{o}) ELSE abs({a}+{o}) END"
    return f"""sz AS (SELECT frame, max(r) AS mr, max(c) AS mc FROM fx_pixels GROUP BY frame),
kn AS (SELECT unnest(range(-{h},{h + 1})) AS o, unnest([{ks}]) AS w),
g1 AS (SELECT a.frame, a.r, a.c, sum(w*b.v) AS v FROM fx_pixels a JOIN sz USING (frame), kn, fx_pixels b WHERE b.frame=a.frame AND b.r=a.r AND b.c={fold("a.c", "o", "mc")} GROUP BY a.frame, a.r, a.c),
g2 AS (SELECT a.frame, a.r, a.c, sum(w*b.v) AS v FROM g1 a JOIN sz USING (frame), kn, g1 b WHERE b.frame=a.frame AND b.c=a.c AND b.r={fold("a.r", "o", "mr")} GROUP BY a.frame, a.r, a.c)"""


@query("gaussian_blur", "RAS-03", with_sql("SELECT frame, r, c, round(v,7) AS blur FROM g2", "fx_pixels", _gauss_sql(1.5)))
def gaussian_blur(spark, sf):
    return nb.blur(_px(spark, sf), K, "v", 1.5, "blur").withColumn("blur", F.round("blur", 7))


@query(
    "local_detail_unsharp",
    "RAS-03",
    with_sql(
        "SELECT frame, r, c, round(a.v-g2.v,7) AS detail FROM fx_pixels a JOIN g2 USING (frame, r, c)",
        "fx_pixels",
        _gauss_sql(2.0),
    ),
)
def local_detail_unsharp(spark, sf):
    d = nb.local_detail(_px(spark, sf), K, "v", 2.0)
    return d.select("frame", "r", "c", F.round("detail", 7).alias("detail"))


@query(
    "median_3x3",
    "RAS-04",
    with_sql(
        """SELECT frame, r, c, list_sort(list(v))[5] AS med FROM (SELECT a.frame, a.r, a.c, b.v FROM fx_pixels a JOIN (SELECT frame, max(r) AS mr, max(c) AS mc FROM fx_pixels GROUP BY frame) USING (frame), (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), fx_pixels b
  WHERE b.frame=a.frame AND b.r=least(greatest(a.r+i,0),mr) AND b.c=least(greatest(a.c+j,0),mc)) GROUP BY frame, r, c""",
        "fx_pixels",
    ),
)
def median_3x3(spark, sf):
    return nb.median3(_px(spark, sf), K, "v")


@query(
    "nearest_fill",
    "RAS-06",
    with_sql(
        """SELECT row, col, z, false AS filled FROM m UNION ALL SELECT row, col, z, true FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, r0, c0) AS rn FROM (
  SELECT row+i AS row, col+j AS col, z, i*i+j*j AS d2, row AS r0, col AS c0 FROM m, (SELECT unnest([-2,-1,0,1,2]) AS i), (SELECT unnest([-2,-1,0,1,2]) AS j) WHERE i*i+j*j BETWEEN 1 AND 4)
  WHERE (row, col) NOT IN (SELECT (row, col) FROM m)) WHERE rn=1""",
        "fx_points",
        cells_sql(0.15),
        "m AS (SELECT row, col, max(z) AS z FROM cells GROUP BY row, col)",
    ),
)
def nearest_fill(spark, sf):
    from sensorlake.operators.rasterize import surface_max

    m = surface_max(_cells(spark, sf, 0.15), ["row", "col"], "z", TIE, []).drop("n")
    return nb.nearest_fill(m, [], ["z"], 2)


def _canopy_sql() -> str:
    """Lower envelope over 7 x 7 cells, blurred by columns, then by rows, each time with the weights that are there."""
    from sensorlake.plans.q_points import cells_sql

    return with_sql(
        "SELECT t.row, t.col, round(greatest(z-env,0),6) AS canopy FROM top t JOIN down USING (row, col)",
        "fx_points",
        cells_sql(0.5),
        """top AS (SELECT row, col, max(z) AS z FROM cells GROUP BY row, col),
seven AS (SELECT unnest([-3,-2,-1,0,1,2,3]) AS i), kernel AS (SELECT i, exp(-0.5::DOUBLE*(i/1.5::DOUBLE)*(i/1.5::DOUBLE)) AS w FROM seven),
wide AS (SELECT row, col+i AS col, min(z) AS z FROM top, seven GROUP BY row, col+i),
low AS (SELECT t.row, t.col, m.z FROM top t JOIN (SELECT row+i AS row, col, min(z) AS z FROM wide, seven GROUP BY row+i, col) m USING (row, col)),
across AS (SELECT row, col+i AS col, sum(w*z)/sum(w) AS v FROM low, kernel GROUP BY row, col+i),
down AS (SELECT row+i AS row, col, sum(w*v)/sum(w) AS env FROM across, kernel GROUP BY row+i, col)""",
    )


@query("canopy_height", "RAS-07", _canopy_sql())
def canopy_height(spark, sf):
    from sensorlake.operators.rasterize import surface_max

    m = surface_max(_cells(spark, sf, 0.5), ["row", "col"], "z", TIE, []).drop("n")
    return nb.canopy(m, [], "z", 7, 1.5).select("row", "col", F.round("canopy", 6).alias("canopy"))


H = (0.97, 0.06, 3.0, -0.04, 1.02, 2.0, 0.0003, -0.0002, 1.0)


@query(
    "homography_warp",
    "RAS-01 SCL-10",
    with_sql(
        f"""SELECT frame, r, c, round(sum(w*v),6) AS v, bool_or(near) AS valid FROM (SELECT t.frame, t.r, t.c, s.v, (CASE WHEN j=1 THEN a ELSE 1-a END)*(CASE WHEN i=1 THEN b ELSE 1-b END) AS w, j=(a>=0.5)::INT AND i=(b>=0.5)::INT AS near FROM (
  SELECT *, u-floor(u) AS a, w0-floor(w0) AS b FROM (SELECT frame, r, c, ({H[0]}::DOUBLE*c+{H[1]}::DOUBLE*r+{H[2]}::DOUBLE)/({H[6]}::DOUBLE*c+{H[7]}::DOUBLE*r+1.0::DOUBLE) AS u, ({H[3]}::DOUBLE*c+{H[4]}::DOUBLE*r+{H[5]}::DOUBLE)/({H[6]}::DOUBLE*c+{H[7]}::DOUBLE*r+1.0::DOUBLE) AS w0 FROM fx_pixels)) t,
  (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j), fx_pixels s WHERE s.frame=t.frame AND s.r=floor(w0)::INT+i AND s.c=floor(u)::INT+j) GROUP BY frame, r, c""",
        "fx_pixels",
    ),
)
def homography_warp(spark, sf):
    p = _px(spark, sf)
    return nb.warp(p, p, K, F.array(*[F.lit(v) for v in H]), "v").withColumn("v", F.round("v", 6))


# Components by reachability, and the half-open box and area of each.
LABELLED = """hot AS MATERIALIZED (SELECT frame, r, c, r*2147483648::BIGINT+c AS id FROM fx_pixels WHERE v>=150),
near AS MATERIALIZED (SELECT a.frame, a.id AS a, b.id AS b FROM hot a JOIN (SELECT frame, r+i AS r, c+j AS c, id FROM hot, (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j)) b ON a.frame=b.frame AND a.r=b.r AND a.c=b.c),
reach(frame, id, root) AS (SELECT frame, id, id FROM hot UNION SELECT reach.frame, near.b, reach.root FROM reach JOIN near ON near.frame=reach.frame AND near.a=reach.id WHERE near.b>reach.root),
lab AS (SELECT frame, id, min(root) AS label FROM reach GROUP BY frame, id),
comp AS (SELECT frame, label, count(*) AS area, min(id%2147483648)::INT AS x0, min(id//2147483648)::INT AS y0, (max(id%2147483648)+1)::INT AS x1, (max(id//2147483648)+1)::INT AS y1 FROM lab GROUP BY frame, label)"""


@query("label_components", "RAS-05", with_sql("SELECT frame, label, area, x0, y0, x1, y1 FROM comp", "fx_pixels", LABELLED, recursive=True))
def label_components(spark, sf):
    lab = nb.label_components(_px(spark, sf).where("v >= 150"), K, tile=32)
    return nb.component_table(lab, K).select("frame", "label", "area", "x0", "y0", "x1", "y1")


@query(
    "component_panel_choice",
    "AGG-42 RAS-05",
    with_sql(
        """SELECT frame, label, area, x0, y0, x1, y1, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, label) AS rn FROM (
  SELECT *, 4.0::DOUBLE*inter/((x1-x0)*(y1-y0)+1024.0::DOUBLE-inter)+1.2::DOUBLE*least(area/((x1-x0)*(y1-y0))::DOUBLE,1)+0.8::DOUBLE*least(area/4096.0::DOUBLE,1)
    -0.8::DOUBLE*sqrt(pow((x0+x1)*0.5::DOUBLE-32,2)+pow((y0+y1)*0.5::DOUBLE-32,2))/sqrt(2048.0::DOUBLE)
    -0.5::DOUBLE*(abs(ln(greatest((x1-x0)/32.0::DOUBLE,0.1)))+abs(ln(greatest((y1-y0)/32.0::DOUBLE,0.1))))-CASE WHEN (x1-x0)/(y1-y0)::DOUBLE BETWEEN 0.55 AND 4.0 THEN 0 ELSE 1 END AS score
  FROM (SELECT *, greatest(least(x1,48)-greatest(x0,16),0)*greatest(least(y1,48)-greatest(y0,16),0)::DOUBLE AS inter FROM comp))) WHERE rn=1""",
        "fx_pixels",
        LABELLED,
        recursive=True,
    ),
)
def component_panel_choice(spark, sf):
    from sensorlake.operators.ranking import first_by

    lab = nb.label_components(_px(spark, sf).where("v >= 150"), K, tile=32)
    s = fr.component_score(nb.component_table(lab, K), gm.box(16.0, 16.0, 48.0, 48.0), 64.0 * 64.0)
    return first_by(s, K, [F.desc("score"), F.asc("label")]).select("frame", "label", "area", "x0", "y0", "x1", "y1", F.round("score", 6).alias("score"))


@query(
    "largest_rectangle",
    "AGG-35",
    with_sql(
        """SELECT frame, area, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, y0, x0, x1, y1) AS rn FROM (
  SELECT frame, y0, y1, min(c)::INT AS x0, (max(c)+1)::INT AS x1, ((max(c)+1-min(c))*(y1-y0))::BIGINT AS area FROM (
    SELECT *, c-row_number() OVER (PARTITION BY frame, y0, y1 ORDER BY c) AS run FROM (SELECT frame, c, (r+1-k)::INT AS y0, (r+1)::INT AS y1 FROM hs, range(1,65) t(k) WHERE k<=h)) GROUP BY frame, y0, y1, run)) WHERE rn=1""",
        "fx_pixels",
        """ok AS (SELECT frame, r, c, r-row_number() OVER (PARTITION BY frame, c ORDER BY r) AS run FROM fx_pixels WHERE v<150),
hs AS (SELECT frame, r, c, row_number() OVER (PARTITION BY frame, c, run ORDER BY r) AS h FROM ok)""",
    ),
)
def largest_rectangle(spark, sf):
    return nb.largest_rectangle(_px(spark, sf).where("v < 150"), K)


@query(
    "band_statistics",
    "AGG-30 SCL-25",
    with_sql(
        """SELECT frame, (r//4)::INT AS br, (c//4)::INT AS bc, round(avg(v),6) AS mean, median(v) AS median, max(v) AS max, min(v) AS min, max(v)-min(v) AS range, round(stddev_pop(v),6) AS std
FROM fx_pixels JOIN (SELECT frame, max(r)+1 AS nr, max(c)+1 AS nc FROM fx_pixels GROUP BY frame) USING (frame) WHERE r<nr-nr%4 AND c<nc-nc%4 GROUP BY 1, 2, 3""",
        "fx_pixels",
    ),
)
def band_statistics(spark, sf):
    b = px.band_statistics(_px(spark, sf), K, "v", 4)
    return b.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


BAND = """bd AS (SELECT frame, r, c, v, ((r%4)*4+c%4)::INT AS band FROM fx_pixels JOIN (SELECT frame, max(r)+1 AS nr, max(c)+1 AS nc FROM fx_pixels GROUP BY frame) USING (frame) WHERE r<nr-nr%4 AND c<nc-nc%4),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY k DESC, band DESC) AS rank FROM (SELECT frame, band, stddev_pop(v)+0.02::DOUBLE*(max(v)-min(v)) AS k FROM bd GROUP BY frame, band))"""


@query("band_contrast_rank", "AGG-30 WIN-15", with_sql("SELECT frame, band, round(k,6) AS contrast, rank FROM rk", "fx_pixels", BAND))
def band_contrast_rank(spark, sf):
    b = px.band_contrast(_px(spark, sf), K, "v", 4)
    return b.select("frame", "band", F.round("contrast", 6).alias("contrast"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "band_normalised_difference",
    "AGG-30",
    with_sql(
        """SELECT frame, (r//4)::INT AS br, (c//4)::INT AS bc, round((max(v) FILTER (band=b1)-max(v) FILTER (band=b2))/(max(v) FILTER (band=b1)+max(v) FILTER (band=b2)+1.0::DOUBLE),6) AS ndi
FROM bd JOIN (SELECT frame, max(band) FILTER (rank=1) AS b1, max(band) FILTER (rank=2) AS b2 FROM rk GROUP BY frame) USING (frame) GROUP BY 1, 2, 3""",
        "fx_pixels",
        BAND,
    ),
)
def band_normalised_difference(spark, sf):
    return px.band_difference(_px(spark, sf), K, "v", 4).withColumn("ndi", F.round("ndi", 6))


@query("band_components", "AGG-31")
def band_components(spark, sf):
    b = px.band_pca(_px(spark, sf), K, "v", 4)
    return b.select("frame", "br", "bc", *[F.round(f"pc{i}", 4).alias(f"pc{i}") for i in range(3)])


@query(
    "composite_median",
    "AGG-32",
    with_sql(
        """SELECT rows, cols, r, c, round(median(v),6) AS median, round(avg(v),6) AS mean, count(*) AS n FROM fx_pixels JOIN (SELECT frame, rows, cols FROM (SELECT *, count(*) OVER (PARTITION BY rows, cols) AS k FROM (SELECT frame, (max(r)+1)::INT AS rows, (max(c)+1)::INT AS cols FROM fx_pixels GROUP BY frame)) WHERE k>=2) USING (frame) GROUP BY rows, cols, r, c""",
        "fx_pixels",
    ),
)
def composite_median(spark, sf):
    c = px.composites(_px(spark, sf), "frame", "v")
    return c.withColumn("median", F.round("median", 6)).withColumn("mean", F.round("mean", 6))


@query(
    "bad_pixel_repair",
    "AGG-45 RAS-04",
    with_sql(
        """SELECT frame, r, c, CASE WHEN bad THEN med ELSE v END AS v, bad FROM (SELECT *, abs(v-med)>2.5::DOUBLE*(median(abs(v-med)) OVER (PARTITION BY frame)+1e-6::DOUBLE) AS bad FROM fx_pixels JOIN (
  SELECT frame, r, c, list_sort(list(v))[5] AS med FROM (SELECT a.frame, a.r, a.c, b.v FROM fx_pixels a JOIN (SELECT frame, max(r) AS mr, max(c) AS mc FROM fx_pixels GROUP BY frame) USING (frame), (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), fx_pixels b
  WHERE b.frame=a.frame AND b.r=least(greatest(a.r+i,0),mr) AND b.c=least(greatest(a.c+j,0),mc)) GROUP BY frame, r, c) USING (frame, r, c))""",
        "fx_pixels",
    ),
)
def bad_pixel_repair(spark, sf):
    return px.repair_bad_pixels(_px(spark, sf), K, "v", 2.5)


@query(
    "destripe",
    "AGG-45",
    with_sql(
        "SELECT frame, r, c, round(v-median(v) OVER (PARTITION BY frame, r)+median(v) OVER (PARTITION BY frame),6) AS v FROM (SELECT frame, r, c, v-median(v) OVER (PARTITION BY frame, c)+median(v) OVER (PARTITION BY frame) AS v FROM (SELECT frame, r, c, v::DOUBLE AS v FROM fx_pixels))",
        "fx_pixels",
    ),
)
def destripe(spark, sf):
    return px.destripe(_px(spark, sf), K, "v").withColumn("v", F.round("v", 6))


@query(
    "threshold_variant_counts",
    "RAS-08 WIN-13",
    with_sql(
        "SELECT frame, count_if(v>=quantile_cont_60)::BIGINT AS hot_60, count_if(v>=q80)::BIGINT AS hot_80, count_if(v<=q40)::BIGINT AS cold_60, count_if(v<=q20)::BIGINT AS cold_80 FROM fx_pixels JOIN (SELECT frame, quantile_cont(v,0.6) AS quantile_cont_60, quantile_cont(v,0.8) AS q80, quantile_cont(v,0.4) AS q40, quantile_cont(v,0.2) AS q20 FROM fx_pixels GROUP BY frame) USING (frame) GROUP BY frame",
        "fx_pixels",
    ),
)
def threshold_variant_counts(spark, sf):
    d = px.threshold_variants(_px(spark, sf), K, "v")
    return d.groupBy("frame").agg(*[F.count_if(c).alias(c) for c in ("hot_60", "hot_80", "cold_60", "cold_80")])


@query(
    "parity_cell_score",
    "AGG-28",
    with_sql(
        """SELECT frame, cand, round(abs(sum(m*p)-avg(m)*sum(p))/(sqrt(var_pop(m)*count(*)*count(*))+1e-6),6) AS corr, round(100*(abs(sum(m*p)-avg(m)*sum(p))/(sqrt(var_pop(m)*count(*)*count(*))+1e-6))+0.25::DOUBLE*abs(avg(m) FILTER (p>0)-avg(m) FILTER (p<0)),6) AS score FROM (SELECT frame, cand, ci, cj, avg(v) AS m, CASE WHEN (ci+cj)%2=0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS p FROM (
  SELECT frame, cand, v, floor((r+0.5::DOUBLE-y0)/h)::INT AS ci, floor((c+0.5::DOUBLE-x0)/w)::INT AS cj, (r+0.5::DOUBLE-y0)/h AS vv, (c+0.5::DOUBLE-x0)/w AS uu FROM fx_pixels, (SELECT i AS cand, i*7.0::DOUBLE AS x0, i*3.0::DOUBLE AS y0, (5+i)::DOUBLE AS w, (6+i)::DOUBLE AS h FROM range(4) t(i)))
  WHERE uu-cj BETWEEN 0.18 AND 0.82 AND vv-ci BETWEEN 0.18 AND 0.82 AND ci BETWEEN 0 AND 3 AND cj BETWEEN 0 AND 4 GROUP BY frame, cand, ci, cj) GROUP BY frame, cand""",
        "fx_pixels",
    ),
)
def parity_cell_score(spark, sf):
    p = _px(spark, sf)
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("cand")
    c = p.select("frame").distinct().select("frame", i)
    c = c.select("frame", "cand", (F.col("cand") * 7.0).alias("x0"), (F.col("cand") * 3.0).alias("y0"), (F.col("cand") + 5.0).alias("w"), (F.col("cand") + 6.0).alias("h"), F.lit(5).alias("nx"), F.lit(4).alias("ny"))
    m = px.inner_cell_means(p, c, K, "v")
    s = px.parity_score(m, ["frame", "cand"], "ci", "cj", "mean")
    return s.select("frame", "cand", F.round("corr", 6).alias("corr"), F.round("score", 6).alias("score"))


def _masks(spark, sf):
    p = _px(spark, sf)
    s = F.explode(F.filter(F.array(F.when((F.col("r") > 2) & (F.col("v") > 20), "vis"), F.when((F.col("c") > 3) & (F.col("v") < 240), "nir"), F.when((F.col("r") < 60) & (F.col("c") < 58), "thermal")), lambda x: x.isNotNull()))
    return p.select("frame", "r", "c", s.alias("sensor"))


MASKS = "ok AS (SELECT frame, r, c FROM fx_pixels WHERE r>2 AND v>20 AND c>3 AND v<240 AND r<60 AND c<58)"


@query(
    "common_valid_box",
    "AGG-34 AGG-36",
    with_sql("SELECT frame, (max(c)-min(c)-1)::INT AS w, (max(r)-min(r)-4)::INT AS h, ((max(c)-min(c)-1)*(max(r)-min(r)-4))::INT AS area, round((max(c)-min(c)-1)*(max(r)-min(r)-4)/4096.0::DOUBLE,6) AS fraction, CASE WHEN max(c)-min(c)-1<30 OR max(r)-min(r)-4<30 THEN 'crop_too_small' ELSE 'ok' END AS status FROM ok GROUP BY frame", "fx_pixels", MASKS),
)
def common_valid_box(spark, sf):
    b = fr.common_valid_box(_masks(spark, sf), K, "sensor", 3, margin=1, shave_bottom=3)
    return fr.coverage(b, K, 64, 64, 30, 30).withColumn("fraction", F.round("fraction", 6))


@query(
    "valid_area_fraction",
    "AGG-46",
    with_sql(
        "SELECT frame, count_if(r>2 AND v>20)/4096.0::DOUBLE AS vis, count_if(c>3 AND v<240)/4096.0::DOUBLE AS nir, count_if(r<60 AND c<58)/4096.0::DOUBLE AS thermal, count_if(r>2 AND v>20 AND c>3 AND v<240 AND r<60 AND c<58)/4096.0::DOUBLE AS common FROM fx_pixels GROUP BY frame",
        "fx_pixels",
    ),
)
def valid_area_fraction(spark, sf):
    return fr.valid_fraction(_masks(spark, sf), "frame", "sensor", ["vis", "nir", "thermal"], 4096)


@query(
    "frame_scan_statistics",
    "AGG-47",
    with_sql("SELECT frame, min(v) AS lo, max(v) AS hi, round(avg(v),6) AS mean, count(*) AS cells, count_if(v>128)::BIGINT AS bright FROM fx_pixels GROUP BY frame", "fx_pixels"),
)
def frame_scan_statistics(spark, sf):
    g = _px(spark, sf).groupBy("frame").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col("v") > 128).alias("bright"))
    return g


def _mirrored(x: str, n: str) -> str:
    return f"CASE WHEN abs({x})>{n} THEN 2*{n}-abs({x}) ELSE abs({x}) END"


MASK_FLAGS = ["otsu_hot", "otsu_cold", "hot_60", "cold_40", "hot_70", "cold_30", "hot_80", "cold_20", "adaptive_hot", "adaptive_cold", "edge"]
MASKS = f"""sz AS (SELECT frame, max(r) AS mr, max(c) AS mc FROM fx_pixels GROUP BY frame),
taps AS (SELECT * FROM (VALUES (-2,1),(-1,4),(0,6),(1,4),(2,1)) t(o,w)),
b1 AS (SELECT a.frame, a.r, a.c, sum(w*b.v) AS v FROM (SELECT f.frame, r, c, w, {_mirrored("c+o", "mc")} AS at FROM fx_pixels f JOIN sz USING (frame), taps) a JOIN fx_pixels b ON b.frame=a.frame AND b.r=a.r AND b.c=a.at GROUP BY a.frame, a.r, a.c),
bl AS (SELECT a.frame, a.r, a.c, floor(sum(w*b.v)/256+0.5)::BIGINT AS v FROM (SELECT f.frame, r, c, w, {_mirrored("r+o", "mr")} AS at FROM b1 f JOIN sz USING (frame), taps) a JOIN b1 b ON b.frame=a.frame AND b.c=a.c AND b.r=a.at GROUP BY a.frame, a.r, a.c),
wide AS (SELECT o, e/sum(e) OVER () AS w FROM (SELECT o::INT AS o, exp(-0.5::DOUBLE*(o/6.5::DOUBLE)*(o/6.5::DOUBLE)) AS e FROM range(-20,21) t(o))),
m1 AS (SELECT a.frame, a.r, a.c, sum(w*b.v) AS v FROM (SELECT f.frame, r, c, w, greatest(0,least(mc,c+o)) AS at FROM bl f JOIN sz USING (frame), wide) a JOIN bl b ON b.frame=a.frame AND b.r=a.r AND b.c=a.at GROUP BY a.frame, a.r, a.c),
mn AS (SELECT a.frame, a.r, a.c, floor(sum(w*b.v)+0.5) AS mean FROM (SELECT f.frame, r, c, w, greatest(0,least(mr,r+o)) AS at FROM bl f JOIN sz USING (frame), wide) a JOIN m1 b ON b.frame=a.frame AND b.c=a.c AND b.r=a.at GROUP BY a.frame, a.r, a.c),
gr AS (SELECT a.frame, a.r, a.c, (abs(sum(b.v*j*(2-abs(i))))+abs(sum(b.v*i*(2-abs(j)))))::DOUBLE AS g FROM (
  SELECT f.frame, r, c, i, j, {_mirrored("r+i", "mr")} AS ar, {_mirrored("c+j", "mc")} AS ac FROM bl f JOIN sz USING (frame), (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j)) a
  JOIN bl b ON b.frame=a.frame AND b.r=a.ar AND b.c=a.ac GROUP BY a.frame, a.r, a.c),
st AS (SELECT frame, quantile_cont(g,0.05) AS lo, quantile_cont(g,0.99) AS hi FROM gr GROUP BY frame),
ed AS (SELECT frame, r, c, trunc(least(greatest((g-lo)*255/(CASE WHEN hi<=lo THEN 1 ELSE hi-lo END),0),255)) AS u FROM gr JOIN st USING (frame)),
eq AS (SELECT frame, floor(quantile_cont(u,0.8)) AS cut FROM ed GROUP BY frame),
ot AS (SELECT frame, bin AS t FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY b DESC, bin) AS rn FROM (
  SELECT frame, bin, CASE WHEN n>w0 THEN w0*(n-w0)*(s0/w0-(s-s0)/(n-w0))*(s0/w0-(s-s0)/(n-w0)) ELSE 0 END AS b FROM (
    SELECT frame, bin, sum(c) OVER w AS w0, sum(c*bin) OVER w AS s0, sum(c) OVER (PARTITION BY frame) AS n, sum(c*bin) OVER (PARTITION BY frame) AS s
    FROM (SELECT frame, v AS bin, count(*)::DOUBLE AS c FROM bl GROUP BY frame, v) WINDOW w AS (PARTITION BY frame ORDER BY bin)))) WHERE rn=1),
qs AS (SELECT frame, {", ".join(f"floor(quantile_cont(v::DOUBLE,{p / 100})) AS q{p}" for p in (20, 30, 40, 60, 70, 80))} FROM bl GROUP BY frame),
ms AS (SELECT bl.frame, bl.r, bl.c, bl.v>t AS otsu_hot, bl.v<=t AS otsu_cold, {", ".join(f"bl.v>=q{p} AS hot_{p}, bl.v<=q{100 - p} AS cold_{100 - p}" for p in (60, 70, 80))},
  CASE WHEN least(mr,mc)>=41 THEN bl.v>mean-2 END AS adaptive_hot, CASE WHEN least(mr,mc)>=41 THEN bl.v<=mean-2 END AS adaptive_cold, u>=cut AS edge
  FROM bl JOIN mn USING (frame, r, c) JOIN ed USING (frame, r, c) JOIN ot USING (frame) JOIN qs USING (frame) JOIN eq USING (frame) JOIN sz USING (frame))"""


@query(
    "mask_variants",
    "RAS-08 WIN-13 RAS-03",
    with_sql(f"SELECT frame, r, c, {', '.join(MASK_FLAGS)} FROM ms", "fx_pixels", MASKS),
)
def mask_variants(spark, sf):
    return px.mask_variants(_px(spark, sf), K, "v")
