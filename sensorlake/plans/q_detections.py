"""Queries on detection tables: ranking, merging, sets, counts, robust rules, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.functions import labels as lb
from sensorlake.operators import merging as mg
from sensorlake.operators import ranking as rk
from sensorlake.operators import robust
from sensorlake.operators.trajectory import trajectory_quality, trajectory_score
from sensorlake.plans.fixtures import fx_docs, fx_stream, table, with_sql
from sensorlake.plans.registry import query

CONF = "cf AS (SELECT *, CASE st WHEN 'purchase' THEN 'subpixel' WHEN 'view' THEN 'subpixel_or_scalar' WHEN 'click' THEN 'model_strong' ELSE 'weak' END AS confidence FROM fx_stream)"


def _views(spark, sf):
    c = F.col("st")
    conf = F.when(c == "purchase", "subpixel").when(c == "view", "subpixel_or_scalar").when(c == "click", "model_strong").otherwise("weak")
    return fx_stream(spark, sf).withColumn("confidence", conf)


@query(
    "choose_one_per_label",
    "WIN-03",
    with_sql(
        "SELECT k, seq, v, st FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN st='view' THEN 0 ELSE 1 END, v DESC, seq) AS rn FROM fx_stream) WHERE rn=1",
        "fx_stream",
    ),
)
def choose_one_per_label(spark, sf):
    d = fx_stream(spark, sf).withColumn("source", F.when(F.col("st") == "view", "scan").otherwise("refined"))
    return rk.one_view_per_label(d, "k", "source", "v", "seq").select("k", "seq", "v", "st")


@query(
    "confidence_priority",
    "WIN-04",
    with_sql(
        """SELECT k, seq, confidence, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE confidence WHEN 'subpixel' THEN 0 WHEN 'subpixel_or_scalar' THEN 1 WHEN 'model_strong' THEN 2 ELSE 9 END, v DESC, seq) AS rn FROM cf) WHERE rn=1""",
        "fx_stream",
        CONF,
    ),
)
def confidence_priority(spark, sf):
    return rk.candidate_by_confidence(_views(spark, sf), "k", "confidence", "v", "seq").select("k", "seq", "confidence", "v")


@query(
    "best_attempt",
    "WIN-05 SCL-21",
    with_sql(
        """SELECT k, seq, conf, round(c,6) AS combined_score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, seq) AS rn FROM (
  SELECT *, CASE conf WHEN 'model_strong' THEN 5e5::DOUBLE WHEN 'model_partial' THEN 2e5::DOUBLE ELSE 0 END + v + 0.1::DOUBLE*(seq%97) AS c FROM (
    SELECT *, CASE WHEN v/100>=0.58 AND v>=55 AND 8>=8 THEN 'model_strong' WHEN v/100>=0.42 AND v>=43 THEN 'model_partial' ELSE 'weak_reject' END AS conf FROM fx_stream))) WHERE rn=1""",
        "fx_stream",
    ),
)
def best_attempt(spark, sf):
    d = fx_stream(spark, sf)
    v = F.col("v")
    conf = F.when((v / 100 >= 0.58) & (v >= 55), "model_strong").when((v / 100 >= 0.42) & (v >= 43), "model_partial").otherwise("weak_reject")
    d = d.withColumn("conf", conf).withColumn("q", F.pmod("seq", F.lit(97)))
    b = rk.best_attempt(d, ["k"], "conf", "v", "q", ["seq"])
    return b.select("k", "seq", "conf", F.round("combined_score", 6).alias("combined_score"))


@query(
    "confidence_ladders",
    "SCL-21 FLT-16",
    with_sql(
        """SELECT seq, CASE WHEN st='purchase' AND cols>=7 AND rows>=3 THEN 'subpixel_strong' WHEN st='purchase' THEN 'subpixel_partial'
    WHEN corr>=0.58 AND score>=150 AND cols>=8 AND rows>=4 THEN 'model_strong' WHEN corr>=0.42 AND score>=118 AND cols>=7 AND rows>=3 THEN 'model_partial' ELSE 'weak_reject' END AS grid_class,
  CASE WHEN sensor='rgb' THEN CASE WHEN corr>=0.45 AND score>=125 THEN 'strong' ELSE 'weak_reject' END
    WHEN sensor IN ('vis','nir') THEN CASE WHEN corr>=0.5 AND score>=140 THEN 'strong' WHEN corr>=0.38 AND score>=118 THEN 'partial_visual_check' ELSE 'weak_reject' END
    ELSE CASE WHEN corr>=0.55 AND score>=150 THEN 'strong' WHEN corr>=0.38 AND score>=118 THEN 'partial_visual_check' ELSE 'weak_reject' END END AS template_class,
  CASE WHEN sensor IN ('vis','nir') THEN CASE WHEN rms<=3.5 AND rms/2<=1.5 THEN 'candidate_partial_subpixel' ELSE 'weak_candidate_high_reprojection_error' END
    WHEN sensor='thermal' THEN CASE WHEN rms<=2 THEN 'candidate_model_assisted' ELSE 'weak_candidate_model_assisted' END ELSE 'candidate' END AS intrinsics_status,
  CASE WHEN rms*4<=CASE WHEN sensor IN ('vis','nir') THEN 18 ELSE 15 END THEN 'target_plane_homography_candidate'
    WHEN rms*4<=CASE WHEN sensor IN ('vis','nir') THEN 35 ELSE 30 END THEN 'target_plane_homography_weak_high_error' ELSE 'target_plane_homography_rejected_high_error' END AS homography_status,
  CASE WHEN rms*3<=10 THEN 'physical_extrinsic_candidate' WHEN rms*3<=25 THEN 'physical_extrinsic_weak_high_stereo_rms' ELSE 'physical_extrinsic_rejected_high_stereo_rms' END AS stereo_status
FROM (SELECT *, v/100 AS corr, v*2 AS score, (seq%10)::INT AS cols, (seq%6)::INT AS rows, v/10 AS rms,
  CASE st WHEN 'click' THEN 'rgb' WHEN 'view' THEN 'vis' WHEN 'error' THEN 'nir' ELSE 'thermal' END AS sensor FROM fx_stream)""",
        "fx_stream",
    ),
)
def confidence_ladders(spark, sf):
    s, v = F.col("st"), F.col("v")
    cols, rows = F.pmod("seq", F.lit(10)).cast("int"), F.pmod("seq", F.lit(6)).cast("int")
    sensor = F.when(s == "click", "rgb").when(s == "view", "vis").when(s == "error", "nir").otherwise("thermal")
    method = F.when(s == "purchase", "opencv_sb").otherwise("template")
    return fx_stream(spark, sf).select(
        "seq",
        lb.partial_grid_confidence(method, cols, rows, v / 100, v * 2, cols, rows).alias("grid_class"),
        lb.template_confidence(sensor, v / 100, v * 2).alias("template_class"),
        lb.intrinsics_status(sensor, v / 10, v / 10 / 2).alias("intrinsics_status"),
        lb.homography_status(sensor, v / 10 * 4).alias("homography_status"),
        lb.stereo_status(v / 10 * 3).alias("stereo_status"),
    )


@query(
    "rescue_top_with_promoted",
    "WIN-06",
    with_sql(
        """SELECT k, seq, v, CASE WHEN rn<=3 THEN rn END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, seq) AS rn,
  row_number() OVER (PARTITION BY k, st='purchase' ORDER BY v DESC, seq) AS pn FROM fx_stream) WHERE rn<=3 OR (st='purchase' AND pn=1)""",
        "fx_stream",
    ),
)
def rescue_top_with_promoted(spark, sf):
    d = fx_stream(spark, sf).select("k", "seq", "v", (F.col("st") == "purchase").alias("ok"))
    return rk.top_with_promoted(d, ["k"], "v", "ok", 3, ["seq"]).select("k", "seq", "v", F.col("rank").cast("bigint").alias("rank"))


@query(
    "best_option_per_label",
    "WIN-07",
    with_sql(
        """SELECT k, st, round(m,6) AS median, n, m<=45 AS accepted, CASE WHEN m>45 THEN 'robust_pair_error_too_high' END AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY m, st) AS rn FROM (SELECT k, st, median(v) AS m, count(*) AS n FROM fx_stream GROUP BY k, st)) WHERE rn=1""",
        "fx_stream",
    ),
)
def best_option_per_label(spark, sf):
    b = rk.best_option(fx_stream(spark, sf).select("k", "st", "v"), ["k"], "st", "v", 45.0)
    return b.select("k", "st", F.round("median", 6).alias("median"), "n", "accepted", "reason")


@query("label_equi_join", "JN-08", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id=l.doc_id")
def label_equi_join(spark, sf):
    return fx_docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query(
    "precedence_merge",
    "JN-09",
    with_sql(
        """SELECT doc_id, CASE WHEN coalesce(a.det,false) THEN 'raw_production' WHEN coalesce(b.det,false) THEN 'scalar_fallback' ELSE 'none' END AS source_priority,
  CASE WHEN coalesce(a.det,false) THEN true WHEN coalesce(b.det,false) THEN true ELSE false END AS detected,
  CASE WHEN coalesce(a.det,false) THEN a.score WHEN coalesce(b.det,false) THEN b.score ELSE coalesce(a.score,b.score) END AS score
FROM (SELECT doc_id, n_chars>2000 AS det, n_chars AS score FROM fx_docs) a FULL JOIN (SELECT doc_id, quality=1 AS det, quality*50::BIGINT+toxic AS score FROM labels) b USING (doc_id)""",
        "fx_docs",
    ),
)
def precedence_merge(spark, sf):
    a = fx_docs(spark, sf).select("doc_id", (F.col("n_chars") > 2000).alias("detected"), F.col("n_chars").alias("score"))
    b = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("detected"), (F.col("quality") * 50 + F.col("toxic")).cast("bigint").alias("score"))
    return mg.precedence_merge(a, b, ["doc_id"], "detected", ["score"])


@query(
    "gapfill_antijoin",
    "JN-10",
    with_sql(
        """SELECT doc_id, quality::BIGINT AS score, 'guided' AS source FROM labels UNION ALL
SELECT doc_id, n_chars AS score, 'fallback_intensity' AS source FROM fx_docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "fx_docs",
    ),
)
def gapfill_antijoin(spark, sf):
    g = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("score"))
    return mg.fill_gaps(g, fx_docs(spark, sf).select("doc_id", F.col("n_chars").alias("score")), ["doc_id"])


@query(
    "existing_or_new",
    "JN-17",
    with_sql(
        """SELECT doc_id, (b.score IS NOT NULL AND (a.score IS NULL OR b.score>a.score)) AS used_existing,
  CASE WHEN b.score IS NOT NULL AND (a.score IS NULL OR b.score>a.score) THEN b.score ELSE a.score END AS score,
  CASE WHEN b.score IS NOT NULL AND (a.score IS NULL OR b.score>a.score) THEN b.method ELSE a.method END AS method,
  CASE WHEN b.score IS NOT NULL AND (a.score IS NULL OR b.score>a.score) THEN a.score END AS alternative_score
FROM (SELECT doc_id, n_chars/100.0::DOUBLE AS score, lang AS method FROM fx_docs) a
FULL JOIN (SELECT doc_id, quality*20.0::DOUBLE+toxic AS score, 'label' AS method FROM labels) b USING (doc_id)""",
        "fx_docs",
    ),
)
def existing_or_new(spark, sf):
    a = fx_docs(spark, sf).select("doc_id", (F.col("n_chars") / F.lit(100.0)).alias("score"), F.col("lang").alias("method"))
    b = table(spark, sf, "labels").select("doc_id", (F.col("quality") * F.lit(20.0) + F.col("toxic")).alias("score"), F.lit("label").alias("method"))
    return mg.keep_better(a, b, ["doc_id"], "score", ["method"])


@query(
    "lookup_last_wins",
    "SRC-16",
    with_sql(
        "SELECT k, seq, v, st FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM fx_stream) WHERE rn=1",
        "fx_stream",
    ),
)
def lookup_last_wins(spark, sf):
    return mg.last_per_label(fx_stream(spark, sf).select("k", "seq", "v", "st"), "k", "seq")


@query(
    "union_of_sources",
    "SET-01",
    with_sql(
        "SELECT source, count(*) AS n, sum(has_lang)::BIGINT AS with_lang FROM (SELECT 'docs' AS source, 1 AS has_lang FROM fx_docs UNION ALL SELECT 'labels', 0 FROM labels UNION ALL SELECT 'pages', 0 FROM pages) GROUP BY source",
        "fx_docs",
    ),
)
def union_of_sources(spark, sf):
    a = fx_docs(spark, sf).select("doc_id", "lang", F.lit("docs").alias("source"))
    b = table(spark, sf, "labels").select("doc_id", F.lit("labels").alias("source"))
    c = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pages").alias("source"))
    return mg.union_sources(a, b, c).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"))


@query(
    "label_sets",
    "SET-02",
    "SELECT doc_id, CASE WHEN a.doc_id2 IS NOT NULL AND b.doc_id3 IS NOT NULL THEN 'both' WHEN a.doc_id2 IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT page_id AS doc_id, page_id AS doc_id2 FROM pages) a FULL JOIN (SELECT DISTINCT doc_id, doc_id AS doc_id3 FROM labels) b USING (doc_id)",
)
def label_sets(spark, sf):
    return mg.label_sets(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id")), table(spark, sf, "labels"), "doc_id")


@query(
    "distinct_keep_first",
    "SET-03",
    with_sql("SELECT k, st, min(seq) AS seq, arg_min(v, seq) AS v FROM fx_stream GROUP BY k, st", "fx_stream"),
)
def distinct_keep_first(spark, sf):
    return mg.keep_first(fx_stream(spark, sf), ["k", "st"], "seq", ["v"])


@query("missing_labels", "SET-04", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, sf):
    return mg.missing_labels(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "detection_counts",
    "AGG-33",
    with_sql(
        "SELECT lang, count(*) AS n, count_if(n_chars>500)::BIGINT AS detected, count_if(quality=1)::BIGINT AS good, count_if(toxic=1)::BIGINT AS flagged FROM fx_docs LEFT JOIN labels USING (doc_id) GROUP BY lang",
        "fx_docs",
    ),
)
def detection_counts(spark, sf):
    d = fx_docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    flags = {"detected": F.col("n_chars") > 500, "good": F.col("quality") == 1, "flagged": F.col("toxic") == 1}
    return mg.detection_counts(d, ["lang"], flags)


@query(
    "selection_summary",
    "AGG-33",
    with_sql(
        "SELECT source, string_agg(lang || '=' || c, ',' ORDER BY lang) AS patterns FROM (SELECT source, lang, count(*) AS c FROM fx_docs GROUP BY source, lang) GROUP BY source",
        "fx_docs",
    ),
)
def selection_summary(spark, sf):
    return mg.summary_text(fx_docs(spark, sf), ["source"], "lang", "patterns")


@query(
    "detection_counts_pivot",
    "SNK-07 AGG-33",
    with_sql(
        """SELECT k, max(CASE WHEN st='click' THEN v END) AS click_v, max(CASE WHEN st='click' THEN seq END) AS click_seq, max(CASE WHEN st='view' THEN v END) AS view_v, max(CASE WHEN st='view' THEN seq END) AS view_seq,
  max(CASE WHEN st='purchase' THEN v END) AS purchase_v, max(CASE WHEN st='purchase' THEN seq END) AS purchase_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY k, st ORDER BY v DESC, seq DESC) AS rn FROM fx_stream) WHERE rn=1 GROUP BY k""",
        "fx_stream",
    ),
)
def detection_counts_pivot(spark, sf):
    return mg.wide_by_sensor(fx_stream(spark, sf), ["k"], "st", ["click", "view", "purchase"], ["v", "seq"])


MASK = """st AS (SELECT k, median(v) AS m FROM fx_stream GROUP BY k),
dv AS (SELECT f.*, m, abs(v-m) AS dev FROM fx_stream f JOIN st USING (k)),
sg AS (SELECT k, CASE WHEN median(dev)*1.4826::DOUBLE>1e-9::DOUBLE THEN median(dev)*1.4826::DOUBLE ELSE stddev_pop(v) END AS s FROM dv GROUP BY k),"""


@query(
    "mad_outlier_mask",
    "AGG-20",
    with_sql(
        "SELECT seq, k, round(m,6) AS median, round(s,6) AS sigma, v<=lim AND seq%1000<=greatest(10,5*m) AS keep FROM x",
        "fx_stream",
        MASK + "x AS (SELECT *, greatest(3.0::DOUBLE, m+3*s, 3*m) AS lim FROM dv JOIN sg USING (k))",
    ),
)
def mad_outlier_mask(spark, sf):
    d = fx_stream(spark, sf).select("seq", "k", "v", F.pmod("seq", F.lit(1000)).alias("mx"))
    m = robust.robust_mask(d, ["k"], "v", robust.view_rule, max_error="mx")
    return m.select("seq", "k", F.round("median", 6).alias("median"), F.round("sigma", 6).alias("sigma"), "keep")


@query(
    "mad_mask_min_keep",
    "AGG-20",
    with_sql(
        """SELECT seq, k, CASE WHEN kept<40 THEN rn<=40 ELSE ok END AS keep FROM (SELECT *, count_if(ok) OVER (PARTITION BY k) AS kept, row_number() OVER (PARTITION BY k ORDER BY v, seq) AS rn FROM (
  SELECT *, v<=greatest(1.5::DOUBLE, 0.6::DOUBLE*m, m-0.9::DOUBLE*s) AS ok FROM dv JOIN sg USING (k)))""",
        "fx_stream",
        MASK.rstrip(","),
    ),
)
def mad_mask_min_keep(spark, sf):
    d = fx_stream(spark, sf).select("seq", "k", "v")
    rule = lambda m, s: F.greatest(F.lit(1.5), 0.6 * m, m - 0.9 * s)
    return robust.robust_mask(d, ["k"], "v", rule, min_keep=40, tie=["seq"]).select("seq", "k", "keep")


@query(
    "pose_outlier_gate",
    "AGG-21",
    with_sql(
        """SELECT seq, k, CASE WHEN kept<12 THEN rn<=12 ELSE ok END AS keep FROM (SELECT *, count_if(ok) OVER (PARTITION BY k) AS kept, row_number() OVER (PARTITION BY k ORDER BY e, seq) AS rn FROM (
  SELECT *, e<=greatest(0.06::DOUBLE, 3*m) AND ang<=30 AS ok FROM (SELECT seq, k, v/1000 AS e, seq%180 AS ang FROM fx_stream) JOIN (SELECT k, median(v/1000) AS m FROM fx_stream GROUP BY k) USING (k)))""",
        "fx_stream",
    ),
)
def pose_outlier_gate(spark, sf):
    d = fx_stream(spark, sf).select("seq", "k", (F.col("v") / 1000).alias("e"), F.pmod("seq", F.lit(180)).alias("ang"))
    return robust.pose_gate(d, ["k"], "e", "ang", 12, ["seq"]).select("seq", "k", "keep")


@query(
    "model_selection",
    "AGG-40",
    with_sql(
        """SELECT k, name, round(rms_px,6) AS rms_px, rank<2 AS constrained FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, CASE WHEN rank=2 THEN rms_px ELSE 0 END, name) AS rn FROM (
  SELECT m.*, CASE WHEN m.rms_px<=f.rms_px+0.35 AND abs(m.fx-f.fx)<=300 AND abs(m.cx-f.cx)<=100 THEN CASE m.name WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END ELSE 2 END AS rank
  FROM m LEFT JOIN m f ON m.k=f.k AND f.name='view')) WHERE rn=1""",
        "fx_stream",
        "m AS (SELECT k, st AS name, avg(v)/10 AS rms_px, max(v)*3 AS fx, min(v)*3 AS cx FROM fx_stream GROUP BY k, st)",
    ),
)
def model_selection(spark, sf):
    m = fx_stream(spark, sf).groupBy("k", F.col("st").alias("name")).agg((F.avg("v") / 10).alias("rms_px"), (F.max("v") * 3).alias("fx"), (F.min("v") * 3).alias("cx"))
    m = m.select("k", "name", F.col("name").alias("pos"), "rms_px", "fx", F.col("fx").alias("fy"), "cx", F.col("cx").alias("cy"))
    s = rk.select_model(m, ["k"], "view", ["purchase", "click"])
    return s.select("k", "name", F.round("rms_px", 6).alias("rms_px"), "constrained")


@query(
    "homography_selection",
    "AGG-41",
    with_sql(
        """SELECT k, CASE WHEN d<=c THEN 'direct' ELSE 'composed' END AS selected, CASE WHEN d IS NULL OR c IS NULL THEN 'no_direct_validation' WHEN d<=c THEN 'direct_median_lte_composed' ELSE 'composed_median_better' END AS reason
FROM (SELECT k, median(v) FILTER (st='purchase') AS d, median(v) FILTER (st='click') AS c FROM fx_stream GROUP BY k)""",
        "fx_stream",
    ),
)
def homography_selection(spark, sf):
    from sensorlake.operators.quantiles import exact_quantiles

    s = fx_stream(spark, sf).select("k", F.when(F.col("st") == "purchase", F.col("v")).alias("d"), F.when(F.col("st") == "click", F.col("v")).alias("c"))
    d = exact_quantiles(s, ["k"], "d", {"dm": 0.5})
    c = exact_quantiles(s, ["k"], "c", {"cm": 0.5})
    j = s.select("k").distinct().join(d, "k", "left").join(c, "k", "left")
    return rk.select_homography(j, "dm", "cm").select("k", "selected", "reason")


@query(
    "trajectory_quality",
    "AGG-37",
    with_sql(
        """SELECT k, n, r AS n_reliable, f AS n_fallback, round(r/n,3) AS reliable_fraction, round(f/n,3) AS fallback_fraction,
  CASE WHEN f=0 AND r/n>=0.85 THEN 'production_candidate' ELSE 'visual_review_only' END AS quality FROM (
  SELECT k, count(*) AS n, count_if(st IN ('view','click'))::BIGINT AS r, count_if(st='error' AND v>95)::BIGINT AS f FROM fx_stream GROUP BY k)""",
        "fx_stream",
    ),
)
def trajectory_quality_q(spark, sf):
    s = fx_stream(spark, sf).withColumn("method", F.when((F.col("st") == "error") & (F.col("v") > 95), "fallback_shift").otherwise(F.col("st")))
    return trajectory_quality(s, ["k"], "method", ["view", "click"])


@query(
    "trajectory_score",
    "AGG-37",
    with_sql(
        "SELECT k, round(area+0.08::DOUBLE*path-0.8::DOUBLE*coalesce(rmse,0.3::DOUBLE)-0.5::DOUBLE*coalesce(corr,0),6) AS score FROM (SELECT k, max(v) AS area, sum(v) AS path, min(v) FILTER (st='purchase') AS rmse, min(v) FILTER (st='error') AS corr FROM fx_stream GROUP BY k)",
        "fx_stream",
    ),
)
def trajectory_score_q(spark, sf):
    g = fx_stream(spark, sf).groupBy("k").agg(
        F.max("v").alias("area"), F.sum("v").alias("path"), F.min(F.when(F.col("st") == "purchase", F.col("v"))).alias("rmse"), F.min(F.when(F.col("st") == "error", F.col("v"))).alias("corr")
    )
    return trajectory_score(g).select("k", F.round("score", 6).alias("score"))


@query(
    "rank_unique_names",
    "WIN-15",
    with_sql(
        "SELECT k, st, v, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, st) AS rank FROM (SELECT k, st, max(v) AS v FROM fx_stream GROUP BY k, st)) WHERE rank<=3",
        "fx_stream",
    ),
)
def rank_unique_names(spark, sf):
    d = rk.rank_unique(fx_stream(spark, sf), ["k"], "st", "v", 3)
    return d.select("k", "st", "v", F.col("rank").cast("bigint").alias("rank"))


def _suppression_sql(distance: float, keep: int) -> str:
    """The rounds one after the other: the best of what is left, then what it leaves."""
    parts = ["l0 AS (SELECT flag, seq, sub, x, y, price FROM fx_points)"]
    for i in range(keep):
        parts.append(f"b{i} AS MATERIALIZED (SELECT * FROM l{i} QUALIFY row_number() OVER (PARTITION BY flag ORDER BY price DESC, seq, sub)=1)")
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT l.* FROM l{i} l JOIN b{i} b USING (flag) WHERE sqrt((l.x-b.x)*(l.x-b.x)+(l.y-b.y)*(l.y-b.y))>{distance}::DOUBLE)")
    return with_sql(" UNION ALL ".join(f"SELECT flag, price, seq, sub, x, y, {i + 1} AS rank FROM b{i}" for i in range(keep)), "fx_points", *parts)


@query("greedy_suppression", "WIN-14", _suppression_sql(12.0, 8))
def greedy_suppression(spark, sf):
    from sensorlake.plans.fixtures import fx_points

    p = fx_points(spark, sf).select("flag", "seq", "sub", "x", "y", "price")
    return rk.greedy_suppression(p, ["flag"], "price", "x", "y", 12.0, 8, ["seq", "sub"])


@query("checkpoint_resume", "SNK-08", "SELECT doc_id, lang, n_chars::BIGINT AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def checkpoint_resume(spark, sf):
    return mg.resume(fx_docs(spark, sf), table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "n_chars")
