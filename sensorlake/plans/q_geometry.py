"""Queries on geometry: projections, rotations, fits, spatial joins, boxes and corner grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.functions import geometry as gm
from sensorlake.operators import fit, spatial
from sensorlake.operators.pointfilters import in_front, in_image, projected
from sensorlake.operators.robust import residual_metrics
from sensorlake.plans.fixtures import fx_pairs, fx_points, fx_stream, with_sql
from sensorlake.plans.registry import query


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _utm_sql() -> str:
    fwd_e = "+".join(f"{a!r}::DOUBLE*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(gm.ALPHA, 1))
    fwd_n = "+".join(f"{a!r}::DOUBLE*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(gm.ALPHA, 1))
    k = repr(gm.UTM_K0 * gm.KRUEGER_A) + "::DOUBLE"
    return f"""SELECT seq, (floor((lon+180)/6)::INT+1 + CASE WHEN lat>=0 THEN 32600 ELSE 32700 END)::INT AS epsg, round(500000+{k}*(eta+{fwd_e}),4) AS e,
  round({k}*(xi+{fwd_n})+CASE WHEN lat>=0 THEN 0 ELSE 10000000 END,4) AS n, round(lon,8) AS lon, round(lat,8) AS lat
FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM (
  SELECT *, sinh(atanh(sin(phi))-{gm._ECC!r}::DOUBLE*atanh({gm._ECC!r}::DOUBLE*sin(phi))) AS t FROM (
    SELECT *, radians(lat) AS phi, radians(lon-9) AS lam FROM (SELECT seq, 7+v/30 AS lon, (seq%1200)/10.0::DOUBLE-60 AS lat FROM fx_stream))))"""


@query("utm_round_trip", "SCL-01 SCL-02", with_sql(_utm_sql(), "fx_stream"))
def utm_round_trip(spark, sf):
    s = fx_stream(spark, sf).select("seq", (7 + F.col("v") / 30).alias("lon0"), (F.pmod("seq", F.lit(1200)) / F.lit(10.0) - 60).alias("lat0"))
    z = F.lit(32)
    s = s.withColumn("u", gm.utm_forward(F.col("lon0"), F.col("lat0"), z))
    s = s.withColumn("g", gm.utm_inverse(F.col("u.e"), F.col("u.n"), z, F.col("lat0") >= 0))
    return s.select(
        "seq", gm.utm_epsg(F.col("lon0"), F.col("lat0")).alias("epsg"), F.round("u.e", 4).alias("e"), F.round("u.n", 4).alias("n"), F.round("g.lon", 8).alias("lon"), F.round("g.lat", 8).alias("lat")
    )


@query(
    "quaternion_rotation",
    "SCL-04 SCL-06 SCL-07 SCL-22",
    with_sql(
        """SELECT seq, round(qx,6) AS qx, round(qy,6) AS qy, round(qz,6) AS qz, round(qw,6) AS qw, round(cos(b)*cos(c),6) AS m00, round(sin(a)*cos(b),6) AS m21,
  round(degrees(atan2(sin(c)*cos(b), cos(b)*cos(c))),6) AS yaw, round(cos(b)*cos(c)*1+(sin(a)*sin(b)*cos(c)-cos(a)*sin(c))*2+(cos(a)*sin(b)*cos(c)+sin(a)*sin(c))*3+10,6) AS px,
  round(degrees(acos(least(greatest((cos(b)*cos(c)+sin(a)*sin(b)*sin(c)+cos(a)*cos(c)+cos(a)*cos(b)-1)/2,-1),1))),5) AS angle
FROM (SELECT *, sin(a/2)*cos(b/2)*cos(c/2)-cos(a/2)*sin(b/2)*sin(c/2) AS qx, cos(a/2)*sin(b/2)*cos(c/2)+sin(a/2)*cos(b/2)*sin(c/2) AS qy,
  cos(a/2)*cos(b/2)*sin(c/2)-sin(a/2)*sin(b/2)*cos(c/2) AS qz, cos(a/2)*cos(b/2)*cos(c/2)+sin(a/2)*sin(b/2)*sin(c/2) AS qw
FROM (SELECT seq, v/100+0.1::DOUBLE AS a, v/150-0.3::DOUBLE AS b, (seq%60)/20.0::DOUBLE-1.41::DOUBLE AS c FROM fx_stream))""",
        "fx_stream",
    ),
)
def quaternion_rotation(spark, sf):
    v, c = F.col("v"), F.pmod("seq", F.lit(60)) / F.lit(20.0) - 1.41
    s = fx_stream(spark, sf).select("seq", gm.quat_from_rpy(v / 100 + 0.1, v / 150 - 0.3, c).alias("q"))
    s = s.withColumn("m", gm.quat_to_matrix(F.col("q"))).withColumn("back", gm.quat_from_matrix(F.col("m")))
    sign = F.when(F.signum("back.w") != F.signum("q.w"), -1.0).otherwise(1.0)
    p = gm.rigid_apply(F.col("m"), F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0)), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    return s.select(
        "seq",
        *[F.round(F.col(f"back.{k}") * sign, 6).alias(f"q{k}") for k in "xyzw"],
        F.round(gm.m(F.col("m"), 0, 0), 6).alias("m00"),
        F.round(gm.m(F.col("m"), 2, 1), 6).alias("m21"),
        F.round(gm.yaw_deg(F.col("m")), 6).alias("yaw"),
        F.round(p[0], 6).alias("px"),
        F.round(gm.rotation_angle_deg(F.col("m")), 5).alias("angle"),
    )


@query(
    "accelerometer_tilt",
    "SCL-05 SCL-23",
    with_sql(
        """SELECT seq, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, round(w,6) AS w FROM (
  SELECT seq, -cos(r/2)*sin(p/2) AS x, sin(r/2)*cos(p/2) AS y, -cos(r/2)*cos(p/2) AS z, sin(r/2)*sin(p/2)*-1 AS w FROM (
    SELECT seq, atan2(-ay, az) AS r, atan2(ax, sqrt(ay*ay+az*az)) AS p FROM (SELECT seq, v/500 AS ax, (seq%7)/70.0::DOUBLE AS ay, 0.98::DOUBLE AS az FROM fx_stream)))""",
        "fx_stream",
    ),
)
def accelerometer_tilt(spark, sf):
    ext = gm.design_extrinsic("lidar_frame")
    rot = F.array(*[F.lit(ext[4 * i + j]) for i in range(3) for j in range(3)])
    s = fx_stream(spark, sf).select("seq", (F.col("v") / 500).alias("ax"), (F.pmod("seq", F.lit(7)) / F.lit(70.0)).alias("ay"))
    s = s.select("seq", gm.accel_tilt_input(F.col("ax"), F.col("ay"), F.lit(0.98), rot).alias("q"))
    return s.select("seq", *[F.round(F.col(f"q.{k}") + 0.0, 6).alias(k) for k in "xyzw"])


SIM = """c AS (SELECT g, avg(sx) AS a, avg(sy) AS b, avg(dx) AS c, avg(dy) AS d, count(*) AS n FROM fx_pairs GROUP BY g),
s AS (SELECT p.g, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, any_value(n) AS n, sum((sx-a)*(dx-c)+(sy-b)*(dy-d)) AS p, sum((sx-a)*(dy-d)-(sy-b)*(dx-c)) AS q,
  sum((sx-a)*(sx-a)+(sy-b)*(sy-b)) AS r FROM fx_pairs p JOIN c ON p.g=c.g GROUP BY p.g),
f AS (SELECT g, n, a, b, c, d, atan2(q,p) AS theta, sqrt(p*p+q*q)/r AS scale FROM s)"""


@query(
    "similarity2d_fit",
    "AGG-22",
    with_sql(
        "SELECT g, n, round(scale,6) AS scale, round(theta,6) AS theta, round(c-scale*(cos(theta)*a-sin(theta)*b),5) AS tx, round(d-scale*(sin(theta)*a+cos(theta)*b),5) AS ty FROM f",
        "fx_pairs",
        SIM,
    ),
)
def similarity2d_fit(spark, sf):
    f = fit.similarity_fit(fx_pairs(spark, sf), ["g"])
    return f.select("g", "n", *r6("scale", "theta"), F.round("tx", 5).alias("tx"), F.round("ty", 5).alias("ty"))


@query(
    "rigid2d_residuals",
    "AGG-22 AGG-19 SCL-08",
    with_sql(
        """SELECT g, count(*) AS n, round(avg(e),5) AS mean, round(median(e),5) AS median, round(quantile_cont(e,0.9),5) AS p90, round(max(e),5) AS max, round(sqrt(avg(e*e)),5) AS rms FROM (
  SELECT p.g, sqrt(pow(cos(theta)*(sx-a)-sin(theta)*(sy-b)+c-dx,2)+pow(sin(theta)*(sx-a)+cos(theta)*(sy-b)+d-dy,2)) AS e FROM fx_pairs p JOIN f ON p.g=f.g) GROUP BY g""",
        "fx_pairs",
        SIM,
    ),
)
def rigid2d_residuals(spark, sf):
    p = fx_pairs(spark, sf)
    j = p.join(fit.similarity_fit(p, ["g"], rigid=True).drop("n"), "g")
    x, y = gm.similarity_apply(F.col("sx"), F.col("sy"), F.col("scale"), F.col("theta"), F.col("tx"), F.col("ty"))
    e = F.sqrt((x - F.col("dx")) * (x - F.col("dx")) + (y - F.col("dy")) * (y - F.col("dy")))
    m = residual_metrics(j.select("g", e.alias("e")), ["g"], "e")
    return m.select("g", "n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "p90", "max", "rms")])


@query(
    "similarity_round_trip",
    "SCL-08",
    with_sql("SELECT id, round(sx,6) AS x, round(sy,6) AS y FROM fx_pairs", "fx_pairs"),
)
def similarity_round_trip(spark, sf):
    a = [F.lit(v) for v in (1.3, 0.7, 250.0, -80.0)]
    p = fx_pairs(spark, sf)
    u, v = gm.similarity_apply(F.col("sx"), F.col("sy"), *a)
    p = p.select("id", u.alias("u"), v.alias("v"))
    x, y = gm.similarity_invert(F.col("u"), F.col("v"), *a)
    return p.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


K = (900.0, 880.0, 320.0, 240.0)
DIST = (-0.21, 0.07, 0.0011, -0.0007, 0.013)


@query(
    "camera_projection",
    "SCL-09 FLT-15 JN-18",
    with_sql(
        f"""SELECT seq, sub, round(u,7) AS u, round(v,7) AS v FROM (SELECT *, {K[0]}*(a*rad+2*{DIST[2]}::DOUBLE*a*b+{DIST[3]}::DOUBLE*(r2+2*a*a))+{K[2]} AS u, {K[1]}*(b*rad+{DIST[2]}::DOUBLE*(r2+2*b*b)+2*{DIST[3]}::DOUBLE*a*b)+{K[3]} AS v FROM (
  SELECT *, 1+r2*({DIST[0]}::DOUBLE+r2*({DIST[1]}::DOUBLE+r2*{DIST[4]}::DOUBLE)) AS rad FROM (SELECT *, a*a+b*b AS r2 FROM (SELECT seq, sub, (x-50)/20/z AS a, (y-5)/z AS b, z FROM fx_points WHERE z>2))))
WHERE u>=0 AND u<640 AND v>=0 AND v<480 AND u>=20 AND u<600 AND v>=10 AND v<470""",
        "fx_points",
    ),
)
def camera_projection(spark, sf):
    p = fx_points(spark, sf).where(in_front(F.col("z"), 2.0))
    p = projected(p.select("seq", "sub", "x", "y", "z"), (F.col("x") - 50) / 20, F.col("y") - 5, F.col("z"), K, DIST)
    p = p.where(in_image(F.col("u"), F.col("v"), 640, 480, (20, 10, 600, 470)))
    return p.select("seq", "sub", F.round("u", 7).alias("u"), F.round("v", 7).alias("v"))


H1 = (1.1, 0.05, 12.0, -0.03, 0.95, 7.0, 0.0002, -0.0001, 1.0)
H2 = (0.9, -0.02, 3.0, 0.04, 1.05, -5.0, 0.0001, 0.0003, 1.0)


def _h(h):
    return F.array(*[F.lit(v) for v in h])


def _happ(h, x, y):
    w = f"({h[6]}::DOUBLE*{x}+{h[7]}::DOUBLE*{y}+{h[8]}::DOUBLE)"
    return f"(({h[0]}::DOUBLE*{x}+{h[1]}::DOUBLE*{y}+{h[2]}::DOUBLE)/{w})", f"(({h[3]}::DOUBLE*{x}+{h[4]}::DOUBLE*{y}+{h[5]}::DOUBLE)/{w})"


@query(
    "homography_apply_invert_compose",
    "SCL-10",
    with_sql(
        f"SELECT id, round({_happ(H1, 'sx', 'sy')[0]},6) AS x1, round({_happ(H1, 'sx', 'sy')[1]},6) AS y1, round({_happ(H1, 'x2', 'y2')[0]},6) AS xc, round({_happ(H1, 'x2', 'y2')[1]},6) AS yc, round(sx,5) AS xb, round(sy,5) AS yb FROM (SELECT *, {_happ(H2, 'sx', 'sy')[0]} AS x2, {_happ(H2, 'sx', 'sy')[1]} AS y2 FROM fx_pairs)",
        "fx_pairs",
    ),
)
def homography_apply_invert_compose(spark, sf):
    p = fx_pairs(spark, sf)
    x1, y1 = gm.h_apply(_h(H1), F.col("sx"), F.col("sy"))
    xc, yc = gm.h_apply(gm.h_compose(_h(H1), _h(H2)), F.col("sx"), F.col("sy"))
    p = p.select("id", x1.alias("x1"), y1.alias("y1"), xc.alias("xc"), yc.alias("yc"))
    xb, yb = gm.h_apply(gm.h_inverse(_h(H1)), F.col("x1"), F.col("y1"))
    return p.select("id", *r6("x1", "y1", "xc", "yc"), F.round(xb, 5).alias("xb"), F.round(yb, 5).alias("yb"))


BOX_SQL = "bx AS (SELECT seq, k, st, v*4 AS x0, (seq%150)::DOUBLE AS y0, v*4+(seq%90)-5 AS x1, (seq%150)+v*2 AS y1 FROM fx_stream)"


def _boxes(spark, sf):
    s, v = fx_stream(spark, sf), F.col("v")
    return s.select("seq", "k", "st", gm.box(v * 4, F.pmod("seq", F.lit(150)).cast("double"), v * 4 + F.pmod("seq", F.lit(90)) - 5, F.pmod("seq", F.lit(150)) + v * 2).alias("b"))


def _flat(col, prefix=""):
    return [F.round(F.col(f"{col}.{k}").cast("double"), 6).alias(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")]


@query(
    "box_expand_clip",
    "SCL-11",
    with_sql(
        """SELECT seq, CASE WHEN ok THEN ex0 END AS x0, CASE WHEN ok THEN ey0 END AS y0, CASE WHEN ok THEN ex1 END AS x1, CASE WHEN ok THEN ey1 END AS y1 FROM (
  SELECT *, x1>x0 AND y1>y0 AND ex1-ex0>=35 AND ey1-ey0>=25 AS ok FROM (SELECT *, greatest(0,floor(x0)-px)::DOUBLE AS ex0, greatest(0,floor(y0)-py)::DOUBLE AS ey0, least(420,ceil(x1)+px)::DOUBLE AS ex1, least(300,ceil(y1)+py)::DOUBLE AS ey1 FROM (
    SELECT *, greatest(14,trunc((x1-x0)*0.65::DOUBLE)) AS px, greatest(14,trunc((y1-y0)*0.65::DOUBLE)) AS py FROM bx)))""",
        "fx_stream",
        BOX_SQL,
    ),
)
def box_expand_clip(spark, sf):
    b = _boxes(spark, sf).withColumn("e", gm.expand_box(F.col("b"), 420, 300, 0.65, 14, 35, 25))
    return b.select("seq", *_flat("e"))


@query(
    "box_project_iou",
    "SCL-11 SCL-12",
    with_sql(
        f"""SELECT seq, round(CASE WHEN ok THEN p0 END,5) AS x0, round(CASE WHEN ok THEN q0 END,5) AS y0, round(CASE WHEN ok THEN p1 END,5) AS x1, round(CASE WHEN ok THEN q1 END,5) AS y1, round(CASE WHEN u>0 THEN i/u ELSE 0 END,6) AS iou FROM (
  SELECT *, p1>p0 AND q1>q0 AS ok, greatest(x1-x0,0)*greatest(y1-y0,0)+20000-i AS u FROM (SELECT *, greatest(0,least(xa,xb,xc,xd)) AS p0, greatest(0,least(ya,yb,yc,yd)) AS q0, least(419,greatest(xa,xb,xc,xd)) AS p1, least(299,greatest(ya,yb,yc,yd)) AS q1,
    greatest(least(x1,250)-greatest(x0,50),0)*greatest(least(y1,140)-greatest(y0,40),0) AS i FROM (
    SELECT *, {_happ(H1, "x0", "y0")[0]} AS xa, {_happ(H1, "x0", "y0")[1]} AS ya, {_happ(H1, "x0", "y1")[0]} AS xb, {_happ(H1, "x0", "y1")[1]} AS yb, {_happ(H1, "x1", "y0")[0]} AS xc, {_happ(H1, "x1", "y0")[1]} AS yc, {_happ(H1, "x1", "y1")[0]} AS xd, {_happ(H1, "x1", "y1")[1]} AS yd FROM bx)))""",
        "fx_stream",
        BOX_SQL,
    ),
)
def box_project_iou(spark, sf):
    b = _boxes(spark, sf)
    b = b.withColumn("p", gm.project_box(F.col("b"), _h(H1), 420, 300)).withColumn("iou", gm.box_iou(F.col("b"), gm.box(50.0, 40.0, 250.0, 140.0)))
    return b.select("seq", *[F.round(F.col(f"p.{k}"), 5).alias(k) for k in ("x0", "y0", "x1", "y1")], F.round("iou", 6).alias("iou"))


@query(
    "box_union",
    "AGG-43",
    with_sql(
        """SELECT k, CASE WHEN b>a AND d>c THEN a END AS x0, CASE WHEN b>a AND d>c THEN c END AS y0, CASE WHEN b>a AND d>c THEN b END AS x1, CASE WHEN b>a AND d>c THEN d END AS y1 FROM (
  SELECT k, greatest(0,min(x0)) AS a, greatest(0,min(y0)) AS c, least(419,max(x1)) AS b, least(299,max(y1)) AS d FROM bx WHERE st='error' GROUP BY k)""",
        "fx_stream",
        BOX_SQL,
    ),
)
def box_union(spark, sf):
    from sensorlake.operators.frames import union_boxes

    return union_boxes(_boxes(spark, sf).where("st = 'error'"), ["k"], "b", 420, 300).select("k", *[F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "guide_box_precedence",
    "JN-19 SCL-11",
    with_sql(
        """SELECT k, src, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM (SELECT *, x1>x0 AND y1>y0 AS ok FROM (
  SELECT k, src, greatest(0,least(419,x0)) AS x0, greatest(0,least(299,y0)) AS y0, least(419,greatest(0,x1)) AS x1, least(299,greatest(0,y1)) AS y1 FROM (SELECT k, CASE WHEN p.k2 IS NOT NULL THEN 'projected' WHEN o.k3 IS NOT NULL THEN 'panel' ELSE 'frame' END AS src, coalesce(p.x0,o.x0,0) AS x0, coalesce(p.y0,o.y0,0) AS y0, coalesce(p.x1,o.x1,419) AS x1, coalesce(p.y1,o.y1,299) AS y1
  FROM (SELECT DISTINCT k FROM fx_stream) LEFT JOIN (SELECT k, k AS k2, arg_max(x0,seq) AS x0, arg_max(y0,seq) AS y0, arg_max(x1,seq) AS x1, arg_max(y1,seq) AS y1 FROM bx WHERE st='error' AND x1-x0>40 GROUP BY k) p USING (k)
  LEFT JOIN (SELECT k, k AS k3, arg_max(x0,seq) AS x0, arg_max(y0,seq) AS y0, arg_max(x1,seq) AS x1, arg_max(y1,seq) AS y1 FROM bx WHERE st='purchase' AND x1>x0 AND x0<300 GROUP BY k) o USING (k))))""",
        "fx_stream",
        BOX_SQL,
    ),
)
def guide_box_precedence(spark, sf):
    from sensorlake.operators.frames import guide_boxes
    from sensorlake.operators.merging import last_per_label

    b = _boxes(spark, sf)
    proj = last_per_label(b.where("st = 'error' AND b.x1 - b.x0 > 40").select("k", "seq", "b"), "k", "seq").select("k", F.col("b").alias("box"))
    own = last_per_label(b.where("st = 'purchase' AND b.x1 > b.x0 AND b.x0 < 300").select("k", "seq", "b"), "k", "seq").select("k", F.col("b").alias("box"))
    g = guide_boxes(b.select("k").distinct(), proj, own, ["k"], 420, 300)
    return g.select("k", "src", *[F.col(f"guide.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "search_region_counts",
    "SCL-32 SET-03",
    with_sql(
        """SELECT name, count(*) AS n, sum((x1-x0)*(y1-y0))::BIGINT AS area FROM (
  SELECT *, row_number() OVER (PARTITION BY seq, x0, y0, x1, y1 ORDER BY pos) AS rn FROM (SELECT seq, unnest([
    {'pos':0,'name':'full','x0':0,'y0':0,'x1':w,'y1':h}, {'pos':1,'name':'left','x0':0,'y0':0,'x1':w//2,'y1':h}, {'pos':2,'name':'right','x0':w//2,'y0':0,'x1':w,'y1':h},
    {'pos':3,'name':'top','x0':0,'y0':0,'x1':w,'y1':h//2}, {'pos':4,'name':'bottom','x0':0,'y0':h//2,'x1':w,'y1':h},
    {'pos':5,'name':'top_left','x0':0,'y0':0,'x1':trunc(w*0.72::DOUBLE)::INT,'y1':trunc(h*0.72::DOUBLE)::INT}, {'pos':6,'name':'top_right','x0':trunc(w*0.28::DOUBLE)::INT,'y0':0,'x1':w,'y1':trunc(h*0.72::DOUBLE)::INT},
    {'pos':7,'name':'bottom_left','x0':0,'y0':trunc(h*0.28::DOUBLE)::INT,'x1':trunc(w*0.72::DOUBLE)::INT,'y1':h}, {'pos':8,'name':'bottom_right','x0':trunc(w*0.28::DOUBLE)::INT,'y0':trunc(h*0.28::DOUBLE)::INT,'x1':w,'y1':h}], recursive:=true)
  FROM (SELECT seq, (40+seq%50)::INT AS w, (20+seq%30)::INT AS h FROM fx_stream)) WHERE x1-x0>=35 AND y1-y0>=25) WHERE rn=1 GROUP BY name""",
        "fx_stream",
    ),
)
def search_region_counts(spark, sf):
    s = fx_stream(spark, sf)
    regs = gm.search_regions(F.pmod("seq", F.lit(50)) + 40, F.pmod("seq", F.lit(30)) + 20, "campaign")
    d = s.select("seq", F.inline(regs))
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("bigint").alias("area"))


@query(
    "corner_grid_rules",
    "SCL-13 SCL-15 SCL-16",
    with_sql(
        """SELECT seq, flipped, round(degrees(atan2(ay, ax)),6) AS angle, CASE WHEN flipped THEN -cr ELSE cr END > 0 AND sqrt(ax*ax+ay*ay)>=0.55::DOUBLE*sqrt(dx*dx+dy*dy) AS rotation_ok FROM (
  SELECT seq, ax*dy-ay*dx AS cr, ax*dy-ay*dx<0 AS flipped, ax, ay, dx, dy FROM (SELECT seq, 3*(v-40) AS ax, 3*((seq%31)-12)::DOUBLE AS ay, 2*((seq%17)-6)::DOUBLE AS dx, 2*(v/3-9) AS dy FROM fx_stream))""",
        "fx_stream",
    ),
)
def corner_grid_rules(spark, sf):
    s, v = fx_stream(spark, sf), F.col("v")
    a = (v - 40, (F.pmod("seq", F.lit(31)) - 12).cast("double"))
    d = ((F.pmod("seq", F.lit(17)) - 6).cast("double"), v / 3 - 9)
    cols, rows = F.lit(4), F.lit(3)
    g = F.array(*[F.struct((a[0] * c + d[0] * r).alias("x"), (a[1] * c + d[1] * r).alias("y")) for r in range(3) for c in range(4)])
    s = s.select("seq", g.alias("g")).withColumn("cg", gm.canonical_grid(F.col("g"), cols, rows))
    flipped = F.get("g", F.lit(0)) != F.get("cg", F.lit(0))
    return s.select(
        "seq",
        (flipped | (gm._cross(F.col("g"), cols, rows) < 0)).alias("flipped"),
        F.round(gm.grid_angle_deg(F.col("cg"), cols, rows), 6).alias("angle"),
        gm.rotation_ok(F.col("cg"), cols, rows, gm.ROTATION_RATIO["intrinsics"]).alias("rotation_ok"),
    )


@query(
    "corner_spacing_score",
    "SCL-13 SCL-31 SCL-34",
    with_sql(
        """SELECT seq, round(sp+80*least(greatest(3*dx*2*dy,1)/307039.0::DOUBLE,1)+5,6) AS score, round((5+dx)/2+7,6) AS back_x FROM (
  SELECT *, list_sort([dx,dx,dx,dx,dx,dx,dx,dx,dx,dy,dy,dy,dy,dy,dy,dy,dy])[9] AS sp FROM (SELECT seq, v+1 AS dx, (seq%40)+3.5::DOUBLE AS dy FROM fx_stream))""",
        "fx_stream",
    ),
)
def corner_spacing_score(spark, sf):
    s = fx_stream(spark, sf)
    dx, dy = F.col("v") + 1, F.pmod("seq", F.lit(40)) + 3.5
    g = F.array(*[F.struct((5 + dx * c).alias("x"), (3 + dy * r).alias("y")) for r in range(3) for c in range(4)])
    s = s.select("seq", g.alias("g"))
    score = gm.residual_bonus(gm.spacing_score(F.col("g"), F.lit(4), F.lit(3), 641, 479), F.lit(0.4))
    back = gm.back_map(F.col("g"), F.lit(2.0), F.lit(7.0), F.lit(0.0))
    return s.select("seq", F.round(score, 6).alias("score"), F.round(F.get(back, F.lit(1))["x"], 6).alias("back_x"))


@query(
    "plane_fit_lsq",
    "AGG-24",
    with_sql(
        """SELECT flag, n, round((xz*yy-yz*xy)/(xx*yy-xy*xy),6) AS a, round((yz*xx-xz*xy)/(xx*yy-xy*xy),6) AS b, round(mz-(xz*yy-yz*xy)/(xx*yy-xy*xy)*mx-(yz*xx-xz*xy)/(xx*yy-xy*xy)*my,5) AS c FROM (
  SELECT flag, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, covar_pop(x,y) AS xy, var_pop(y) AS yy, covar_pop(x,z) AS xz, covar_pop(y,z) AS yz FROM fx_points GROUP BY flag)""",
        "fx_points",
    ),
)
def plane_fit_lsq(spark, sf):
    p = fit.plane_lsq(fx_points(spark, sf), ["flag"])
    return p.select("flag", "n", *r6("a", "b"), F.round("c", 5).alias("c"))


@query(
    "ground_relative_height",
    "AGG-24",
    with_sql(
        """SELECT seq, sub, round(greatest(rel-quantile_cont(rel,0.05) OVER (PARTITION BY flag),0),5) AS height FROM (
  SELECT p.*, z-((xz*yy-yz*xy)/(xx*yy-xy*xy)*(x-mx)+(yz*xx-xz*xy)/(xx*yy-xy*xy)*(y-my)+mz) AS rel FROM fx_points p JOIN (
    SELECT p.flag, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, covar_pop(x,y) AS xy, var_pop(y) AS yy, covar_pop(x,z) AS xz, covar_pop(y,z) AS yz
    FROM fx_points p JOIN (SELECT flag, quantile_cont(z,0.65) AS q FROM fx_points GROUP BY flag) l ON p.flag=l.flag WHERE z<=q GROUP BY p.flag) f ON p.flag=f.flag)""",
        "fx_points",
    ),
)
def ground_relative_height(spark, sf):
    p = fx_points(spark, sf).select("seq", "sub", "flag", "x", "y", "z")
    return fit.ground_height(p, ["flag"]).select("seq", "sub", F.round("height", 5).alias("height"))


# Smallest eigenvalue of the covariance in closed form; its direction is the longest cross product of two rows of (covariance - eigenvalue).
PLANE_SQL = """m AS (SELECT flag, count(*) AS n, covar_pop(x,x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,y) AS yy, covar_pop(y,z) AS yz, covar_pop(z,z) AS zz FROM fx_points GROUP BY flag),
q AS (SELECT *, (xx+yy+zz)/3 AS q FROM m),
p AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
e AS (SELECT *, q+2*p*cos(acos(least(greatest(((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*p*p*p),-1),1))/3+2*pi()/3) AS l FROM p),
c AS (SELECT flag, n, l, unnest([{'a': xy*yz-xz*(yy-l), 'b': xz*xy-(xx-l)*yz, 'c': (xx-l)*(yy-l)-xy*xy}, {'a': xy*(zz-l)-xz*yz, 'b': xz*xz-(xx-l)*(zz-l), 'c': (xx-l)*yz-xy*xz}, {'a': (yy-l)*(zz-l)-yz*yz, 'b': yz*xz-xy*(zz-l), 'c': xy*yz-(yy-l)*xz}]) AS v FROM e),
b AS (SELECT *, sqrt(v.a*v.a+v.b*v.b+v.c*v.c)*CASE WHEN v.c<0 THEN -1 ELSE 1 END AS s FROM c QUALIFY row_number() OVER (PARTITION BY flag ORDER BY v.a*v.a+v.b*v.b+v.c*v.c DESC)=1)"""


@query("plane_fit_pca", "AGG-24", with_sql("SELECT flag, n, round(v.a/s,6)+0.0 AS n0, round(v.b/s,6)+0.0 AS n1, round(v.c/s,6)+0.0 AS n2, round(sqrt(greatest(l,0)),6) AS rms FROM b", "fx_points", PLANE_SQL))
def plane_fit_pca(spark, sf):
    p = fit.plane_pca(fx_points(spark, sf), ["flag"])
    return p.select("flag", "n", *[F.round(F.get("normal", F.lit(i)), 6).alias(f"n{i}") for i in range(3)], F.round("rms", 6).alias("rms"))


RIGID_SQL = """SELECT flag, count(*) AS n, round(cos(b)*cos(c),6) AS r0, round(sin(a)*sin(b)*cos(c)-cos(a)*sin(c),6) AS r1, round(cos(a)*sin(b)*cos(c)+sin(a)*sin(c),6) AS r2,
  round(cos(b)*sin(c),6) AS r3, round(sin(a)*sin(b)*sin(c)+cos(a)*cos(c),6) AS r4, round(cos(a)*sin(b)*sin(c)-sin(a)*cos(c),6) AS r5, round(-sin(b),6) AS r6, round(sin(a)*cos(b),6) AS r7, round(cos(a)*cos(b),6) AS r8,
  3.0::DOUBLE AS t0, -2.0::DOUBLE AS t1, 0.5::DOUBLE AS t2 FROM fx_points, (SELECT 0.2::DOUBLE AS a, -0.1::DOUBLE AS b, 0.4::DOUBLE AS c) GROUP BY flag, a, b, c"""


@query("rigid3d_fit", "AGG-23", with_sql(RIGID_SQL, "fx_points"))
def rigid3d_fit(spark, sf):
    p = fx_points(spark, sf)
    r = spark.range(1).select(gm.quat_to_matrix(gm.quat_from_rpy(F.lit(0.2), F.lit(-0.1), F.lit(0.4))).alias("r")).scalar()
    q = gm.rigid_apply(r, F.array(F.lit(3.0), F.lit(-2.0), F.lit(0.5)), [F.col(c) for c in "xyz"])
    f = fit.rigid3d_fit(p.select("flag", "x", "y", "z", *[c.alias(f"q{i}") for i, c in enumerate(q)]), ["flag"], ["x", "y", "z"], ["q0", "q1", "q2"])
    return f.select("flag", "n", *[F.round(F.get("r", F.lit(i)), 6).alias(f"r{i}") for i in range(9)], *[F.round(F.get("t", F.lit(i)), 5).alias(f"t{i}") for i in range(3)])


@query("ransac_plane", "AGG-25")
def ransac_plane(spark, sf):
    p = fx_points(spark, sf)
    flat = F.when(F.col("tax") < 6, 0.02 * F.col("x") - 0.1 * F.col("y") + 1 + 0.001 * F.col("intensity")).otherwise(F.col("z") / 5)
    p = p.select("flag", F.struct("seq", "sub").alias("pid"), "x", "y", flat.alias("z"))
    f = fit.ransac_plane(p, ["flag"], "pid", hypotheses=32)
    return f.select("flag", "points", "n", "detected", *[F.round(F.get("normal", F.lit(i)), 5).alias(f"n{i}") for i in range(3)], F.round("rms", 6).alias("rms"))


def _h_pairs(spark, sf):
    p = fx_pairs(spark, sf)
    u, v = gm.h_apply(_h(H1), F.col("sx") * 5, F.col("sy") * 5)
    bad = F.pmod("id", F.lit(6)) == 0
    return p.select("id", "g", (F.col("sx") * 5).alias("sx"), (F.col("sy") * 5).alias("sy"), F.when(bad, u + 40 + F.col("sx")).otherwise(u).alias("dx"), F.when(bad, v - 30).otherwise(v).alias("dy"))


@query(
    "homography_fit",
    "AGG-26",
    with_sql(
        "SELECT g, count(*) AS n, count_if(id%6<>0)::BIGINT AS inliers, count_if(id%6<>0)::BIGINT AS used, "
        + ", ".join(f"round({v}::DOUBLE,5) AS h{i}" for i, v in enumerate(H1))
        + " FROM fx_pairs GROUP BY g",
        "fx_pairs",
    ),
)
def homography_fit(spark, sf):
    f = fit.homography_ransac(_h_pairs(spark, sf), ["g"], "id", 6.0, hypotheses=48)
    return f.select("g", "n", "inliers", "used", *[F.round(F.get("h", F.lit(i)), 5).alias(f"h{i}") for i in range(9)])


@query(
    "grid_residual",
    "AGG-27 SCL-15",
    with_sql("SELECT k, st, 0.0::DOUBLE AS mean_px, 0.0::DOUBLE AS max_px, true AS ok FROM (SELECT DISTINCT k, st FROM fx_stream)", "fx_stream"),
)
def grid_residual(spark, sf):
    g = fx_stream(spark, sf).groupBy("k", "st").agg(F.max("v").alias("s"))
    p = g.select("k", "st", "s", F.explode(gm.lattice(9, 6, 1.0)).alias("o"))
    x, y = gm.h_apply(_h(H1), F.col("o.x") * F.col("s") + 5, F.col("o.y") * F.col("s"))
    c = p.select("k", "st", F.col("o.x").alias("c"), F.col("o.y").alias("r"), x.alias("x"), y.alias("y"))
    r = fit.grid_residual(c, ["k", "st"])
    return r.select("k", "st", (F.round("mean_px", 5) + 0.0).alias("mean_px"), (F.round("max_px", 5) + 0.0).alias("max_px"), "ok")


PLOT_W, PLOT_H = 18.0, 4.0


def _plots(spark):
    """Ten plots with gaps between them: layer order runs along x, then y."""
    rows = spark.range(10).select(
        F.col("id").cast("int").alias("pos"), (F.col("id") + 1).cast("string").alias("plot_id"), (F.pmod("id", F.lit(5)) * 20.0 + 1.0).alias("x0"), (F.floor(F.col("id") / 5) * 5.0 + 0.5).alias("y0")
    )
    pt = lambda a, b: F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y"))
    return rows.select("pos", "plot_id", F.array(pt(0.0, 0.0), pt(PLOT_W, 0.0), pt(PLOT_W, PLOT_H), pt(0.0, PLOT_H)).alias("ring"))


PLOTS_SQL = "pl AS (SELECT i AS pos, (i+1)::VARCHAR AS plot_id, (i%5)*20.0::DOUBLE+1 AS x0, (i//5)*5.0::DOUBLE+0.5::DOUBLE AS y0 FROM range(10) t(i))"


@query(
    "plot_point_in_polygon",
    "JN-12 SRC-13 AGG-02",
    with_sql(
        """SELECT plot_id, count(*) AS frames, min(ts_ns) AS first_ns, arg_min(p.seq, {'t': ts_ns, 's': p.seq, 'b': sub}) AS first_seq FROM fx_points p LEFT JOIN pl ON x>x0 AND x<x0+18 AND y>y0 AND y<y0+4 GROUP BY plot_id""",
        "fx_points",
        PLOTS_SQL,
    ),
)
def plot_point_in_polygon(spark, sf):
    p = fx_points(spark, sf).select("seq", "sub", "x", "y", "ts_ns")
    d = spatial.assign_plot(p, _plots(spark), ["seq", "sub"], 5.0)
    g = d.groupBy("plot_id").agg(F.count(F.lit(1)).alias("frames"), F.min(F.struct("ts_ns", "seq", "sub")).alias("f"))
    return g.select("plot_id", "frames", F.col("f.ts_ns").alias("first_ns"), F.col("f.seq").alias("first_seq"))


@query(
    "nearest_polygon_fallback",
    "JN-13",
    with_sql(
        """SELECT seq, sub, plot_id, CASE WHEN inside THEN 'inside_polygon' ELSE 'nearest_polygon' END AS assignment, round(d,2) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY seq, sub ORDER BY d, NOT inside, pos) AS rn FROM (SELECT seq, sub, plot_id, pos, x>x0 AND x<x0+18 AND y>y0 AND y<y0+4 AS inside,
    sqrt(pow(greatest(x0-x,0,x-x0-18),2)+pow(greatest(y0-y,0,y-y0-4),2)) AS d FROM fx_points, pl)) WHERE rn=1""",
        "fx_points",
        PLOTS_SQL,
    ),
)
def nearest_polygon_fallback(spark, sf):
    p = fx_points(spark, sf).select("seq", "sub", "x", "y")
    d = spatial.assign_plot(p, _plots(spark), ["seq", "sub"], 5.0, levels=3)
    return d.select("seq", "sub", "plot_id", "assignment", "distance")


def _track(spark, sf):
    """One smoothed vehicle track per recording class, derived from the points' own positions by date."""
    p = fx_points(spark, sf)
    t = p.groupBy(F.expr("ts_ns div 86400000000000 div 30").alias("month")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return t.select("month", (F.col("x") * 10 - 450).alias("x"), (F.col("y") * 10 - 45).alias("y"))


@query(
    "polyline_corridor",
    "JN-11 FLT-13 WIN-08",
    with_sql(
        """SELECT seq, sub, round(min(d2),6) AS d2 FROM (SELECT seq, sub, pow(x-(ax+t*vx),2)+pow(y-(ay+t*vy),2) AS d2 FROM (
  SELECT *, CASE WHEN vx*vx+vy*vy>1e-12::DOUBLE THEN least(greatest(((x-ax)*vx+(y-ay)*vy)/(vx*vx+vy*vy),0),1) ELSE 0 END AS t FROM (SELECT p.seq, p.sub, p.x, p.y, s.ax, s.ay, s.bx-s.ax AS vx, s.by-s.ay AS vy FROM fx_points p, seg s WHERE s.ax IS NOT NULL))) WHERE d2<=1.44::DOUBLE GROUP BY seq, sub""",
        "fx_points",
        """tr AS (SELECT m, avg(x)*10-450 AS x, avg(y)*10-45 AS y FROM (SELECT *, ts_ns//86400000000000//30 AS m FROM fx_points) GROUP BY m),
seg AS (SELECT lag(x) OVER (ORDER BY m) AS ax, lag(y) OVER (ORDER BY m) AS ay, x AS bx, y AS by FROM tr)""",
    ),
)
def polyline_corridor(spark, sf):
    seg = spatial.track_segments(_track(spark, sf), [], ["month"])
    d = spatial.corridor(fx_points(spark, sf).select("seq", "sub", "x", "y"), seg, ["seq", "sub"], 1.2, 0.5)
    return d.select("seq", "sub", F.round("d2", 6).alias("d2"))


@query(
    "corridor_counts",
    "FLT-13 SNK-05",
    with_sql(
        """SELECT (SELECT count(*) FROM fx_points) AS before,
  (SELECT count(*) FROM fx_points, (SELECT min(least(seg.ax,seg.bx))-1.7::DOUBLE AS x0, max(greatest(seg.ax,seg.bx))+1.7::DOUBLE AS x1, min(least(seg.ay,seg.by))-1.7::DOUBLE AS y0, max(greatest(seg.ay,seg.by))+1.7::DOUBLE AS y1 FROM seg WHERE ax IS NOT NULL) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS box,
  (SELECT count(*) FROM (SELECT seq, sub FROM (SELECT seq, sub, pow(x-(ax+t*vx),2)+pow(y-(ay+t*vy),2) AS d2 FROM (
    SELECT *, CASE WHEN vx*vx+vy*vy>1e-12::DOUBLE THEN least(greatest(((x-ax)*vx+(y-ay)*vy)/(vx*vx+vy*vy),0),1) ELSE 0 END AS t FROM (SELECT p.seq, p.sub, p.x, p.y, s.ax, s.ay, s.bx-s.ax AS vx, s.by-s.ay AS vy FROM fx_points p, seg s WHERE s.ax IS NOT NULL))) WHERE d2<=1.44::DOUBLE GROUP BY seq, sub)) AS after""",
        "fx_points",
        """tr AS (SELECT m, avg(x)*10-450 AS x, avg(y)*10-45 AS y FROM (SELECT *, ts_ns//86400000000000//30 AS m FROM fx_points) GROUP BY m),
seg AS (SELECT lag(x) OVER (ORDER BY m) AS ax, lag(y) OVER (ORDER BY m) AS ay, x AS bx, y AS by FROM tr)""",
    ),
)
def corridor_counts(spark, sf):
    seg = spatial.track_segments(_track(spark, sf), [], ["month"])
    return spatial.corridor_counted(fx_points(spark, sf).select("seq", "sub", "x", "y"), seg, ["seq", "sub"], 1.2, 0.5)[1]


@query(
    "nearest_point_join",
    "JN-15",
    with_sql(
        """SELECT id, t_id, round(d2,8) AS d2 FROM (SELECT a.id, b.id AS t_id, pow(a.sx-b.sx,2)+pow(a.sy-b.sy,2) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.sx-b.sx,2)+pow(a.sy-b.sy,2), b.id) AS rn
  FROM fx_pairs a JOIN fx_pairs b ON a.g=b.g AND a.id%2=0 AND b.id%2=1 WHERE pow(a.sx-b.sx,2)+pow(a.sy-b.sy,2)<25) WHERE rn=1""",
        "fx_pairs",
    ),
)
def nearest_point_join(spark, sf):
    p = fx_pairs(spark, sf).select("id", "g", "sx", "sy")
    odd = F.pmod("id", F.lit(2)) == 1
    d = spatial.nearest_point(p.where(~odd), p.where(odd), ["g"], ["id"], "id", ["sx", "sy"], 5.0)
    return d.select("id", "t_id", F.round("d2", 8).alias("d2"))


@query(
    "colour_lut_lookup",
    "JN-16",
    with_sql(
        """SELECT r, g, b, i, round(i/63.0::DOUBLE,6) AS value, round(sqrt(d2),6) AS dist FROM (SELECT r, g, b, i, d2, row_number() OVER (PARTITION BY r, g, b ORDER BY d2, i) AS rn FROM (
  SELECT r, g, b, i, pow(r-i*4,2)+pow(g-abs(i*8-255),2)+pow(b-(255-i*4),2) AS d2 FROM (SELECT DISTINCT (z*5)::INT AS r, (intensity*20)::INT AS g, (tax*30)::INT AS b FROM fx_points), range(64) t(i))) WHERE rn=1""",
        "fx_points",
    ),
)
def colour_lut_lookup(spark, sf):
    lut = spark.range(64).select(F.col("id").alias("i"), (F.col("id") * 4).alias("r"), F.abs(F.col("id") * 8 - 255).alias("g"), (255 - F.col("id") * 4).alias("b"))
    c = fx_points(spark, sf).select((F.col("z") * 5).cast("int").alias("r"), F.round(F.col("intensity") * 20).cast("int").alias("g"), F.round(F.col("tax") * 30).cast("int").alias("b"))
    d = spatial.nearest_lut(c, lut, ["r", "g", "b"])
    return d.select("r", "g", "b", "i", *r6("value", "dist"))


@query(
    "panel_window_filter",
    "SCL-26 JOB-12",
    with_sql(
        """SELECT seq, sub, abs(al)<0.1::DOUBLE AND la<0.42::DOUBLE AS tight FROM (SELECT *, sqrt(pow(dx-al*nx,2)+pow(dy-al*ny,2)+pow(dz-al*nz,2)) AS la FROM (SELECT *, dx*nx+dy*ny+dz*nz AS al FROM (
  SELECT seq, sub, x/100-0.5::DOUBLE AS dx, y/10-0.5::DOUBLE AS dy, z/100-0.25::DOUBLE AS dz, 0.36::DOUBLE/sqrt(0.36::DOUBLE*0.36::DOUBLE+0.48::DOUBLE*0.48::DOUBLE+0.64::DOUBLE) AS nx, 0.48::DOUBLE/sqrt(0.36::DOUBLE*0.36::DOUBLE+0.48::DOUBLE*0.48::DOUBLE+0.64::DOUBLE) AS ny, 0.8::DOUBLE/sqrt(0.36::DOUBLE*0.36::DOUBLE+0.48::DOUBLE*0.48::DOUBLE+0.64::DOUBLE) AS nz FROM fx_points))) WHERE abs(al)<0.2::DOUBLE AND la<0.62::DOUBLE""",
        "fx_points",
    ),
)
def panel_window_filter(spark, sf):
    p = fx_points(spark, sf)
    n, _ = gm.plane_normalise([F.lit(0.36), F.lit(0.48), F.lit(0.8)], F.lit(1.0))
    at = [F.col("x") / 100, F.col("y") / 10, F.col("z") / 100]
    c = [F.lit(0.5), F.lit(0.5), F.lit(0.25)]
    return p.where(gm.panel_window(at, c, n, gm.PANEL_BROAD)).select("seq", "sub", gm.panel_window(at, c, n, gm.PANEL_TIGHT).alias("tight"))
