"""Series queries over the events of a user (time in seconds, value), and features of the frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake import adapters as ad
from strandlake.operators import annotate, landscape, persistence, replicas, series
from strandlake.queries.base import Registry
from strandlake.session import materialize

R = Registry()
ser = ad.series
NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY frame) - 1 i, count(*) OVER (PARTITION BY traj_id) n FROM series)"
BLOCKS = NUM + """, bk AS (SELECT *, CASE WHEN n // 5 < 10 THEN greatest(2, n // 10) ELSE 5 END k FROM num),
bl AS (SELECT traj_id, least(i // greatest(1, n // k), k - 1) AS block, count(*) n, avg(value) AS mean, stddev_pop(value) AS std FROM bk GROUP BY ALL)"""
MOVING = NUM + ", mv AS (SELECT *, avg(value) OVER (PARTITION BY traj_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) moving FROM num QUALIFY i >= 9)"


@R.add("w04_block_means", "series", "WITH " + BLOCKS + " SELECT * FROM bl", "mean std")
def _(spark, d):
    return series.block_means(ser(spark, d))


@R.add("w04_block_stability", "series", "WITH " + BLOCKS + """ SELECT traj_id, count(*) n_blocks, CASE WHEN avg(mean) > 0 THEN stddev_pop(mean)/avg(mean) ELSE 0.0 END AS stability,
 abs(arg_max(mean, block) - list(mean ORDER BY block)[-2]) / abs(arg_max(mean, block)) last_two, abs(arg_max(mean, block) - arg_min(mean, block)) / abs(arg_min(mean, block)) first_last FROM bl GROUP BY 1 HAVING count(*) >= 2""", "stability last_two first_last")
def _(spark, d):
    return series.block_stability(series.block_means(ser(spark, d)))


@R.add("w05_moving_average", "series", "WITH " + MOVING + " SELECT traj_id, frame, moving FROM mv", "moving")
def _(spark, d):
    return series.moving_average(ser(spark, d)).select("traj_id", "frame", "moving")


@R.add("w05_trend", "series", "WITH " + MOVING + """, sp AS (SELECT traj_id, max(time_s)-min(time_s) span FROM series GROUP BY 1), g AS (SELECT traj_id, count(*) c, regr_slope(moving, time_s - 1.7e9) s FROM mv GROUP BY 1)
SELECT traj_id, (CASE WHEN c > 10 THEN s ELSE 0.0 END) * 1e6 slope, abs(CASE WHEN c > 10 THEN s ELSE 0.0 END) > 0.05/span has_drift FROM g JOIN sp USING (traj_id)""", "slope")
def _(spark, d):
    s = ser(spark, d).withColumn("time_s", F.col("time_s") - 1.7e9)
    return series.trend(s).withColumn("slope", F.col("slope") * 1e6)


@R.add("w06_convergence_point", "series", "WITH " + MOVING + """, m2 AS (SELECT traj_id, time_s, moving, row_number() OVER (PARTITION BY traj_id ORDER BY frame) - 1 j, count(*) OVER (PARTITION BY traj_id) m FROM mv),
sd AS (SELECT a.traj_id, a.j, a.m, any_value(a.time_s) t, sqrt(greatest(0, avg(b.moving*b.moving) - avg(b.moving)*avg(b.moving))) std FROM m2 a JOIN m2 b ON a.traj_id=b.traj_id AND b.j BETWEEN a.j - greatest(10, a.m // 10) AND a.j GROUP BY ALL),
rs AS (SELECT *, avg(CASE WHEN std < 3.0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY traj_id ORDER BY j DESC) rest FROM sd), f AS (SELECT traj_id, min(j) AS "index", arg_min(t, j) AS "time" FROM rs WHERE m >= 20 AND std < 3.0 AND m - j > m*0.2 AND rest > 0.8 GROUP BY 1)
SELECT s.traj_id, CAST("index" AS INTEGER) AS "index", "time" FROM (SELECT DISTINCT traj_id FROM series) s LEFT JOIN f USING (traj_id)""")
def _(spark, d):
    return series.convergence_point(ser(spark, d), threshold=3.0)


@R.add("w07_series_grade", "series", """WITH g AS (SELECT traj_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS "min", max(value) AS "max", count(*) n FROM series GROUP BY 1)
SELECT *, CASE WHEN mean/100 > 0.8 OR std/1000 > 0.15 THEN 'D' WHEN std/mean < 0.10 THEN 'A' WHEN std/mean < 0.15 THEN 'B' WHEN std/mean < 0.20 THEN 'C' ELSE 'D' END grade FROM g""", "mean std")
def _(spark, d):
    m, s = F.col("mean"), F.col("std")
    g = series.series_summary(ser(spark, d))
    # the grade's limits are absolute: the series' unit is scaled, and every series counts as converged early
    cv = F.when(m > 0, s / m)
    return g.withColumn("grade", F.when((m / 100 > 0.8) | (s / 1000 > 0.15), "D").otherwise(series.grade(F.lit(0.5), cv * 0.5, F.lit(True), F.lit(0.1))))


@R.add("w09_drift", "series", "WITH " + NUM + " SELECT traj_id, regr_slope(value, i) slope, regr_r2(value, i) r_squared, avg(value) AS mean, 100*abs(regr_slope(value, i)*count(*)/avg(value)) drift_pct FROM num GROUP BY 1", "slope r_squared mean drift_pct")
def _(spark, d):
    return series.drift(ser(spark, d))


@R.add("w10_stability_grades", "series", """WITH g AS (SELECT traj_id, 100*stddev_pop(value)/abs(avg(value)) pct FROM series GROUP BY 1), k AS (SELECT *, CASE WHEN pct < 85 THEN 'A' WHEN pct < 95 THEN 'B' WHEN pct < 105 THEN 'C' ELSE 'D' END grade FROM g)
SELECT *, CASE grade WHEN 'A' THEN 100.0 WHEN 'B' THEN 80.0 WHEN 'C' THEN 60.0 ELSE 40.0 END AS points FROM k""", "pct")
def _(spark, d):
    return series.stability_grades(ser(spark, d), (85.0, 95.0, 105.0))


@R.add("w12_equilibration", "series", "WITH " + NUM + """, s AS (SELECT *, i >= n // 10 tail, i >= floor(n*0.8) last FROM num WHERE n >= 10),
g AS (SELECT traj_id, avg(value) FILTER (WHERE tail) tail_mean, stddev_pop(value) FILTER (WHERE tail) tail_std, max(value) FILTER (WHERE tail) tail_max, max(value) FILTER (WHERE tail) - min(value) FILTER (WHERE tail) tail_variation, avg(value) FILTER (WHERE last) final_mean,
 CASE WHEN count(*) FILTER (WHERE last) > 2 THEN coalesce(regr_slope(value, (time_s-1.7e9)/1e5) FILTER (WHERE last), 0.0) ELSE 0.0 END drift_slope FROM s GROUP BY 1)
SELECT *, CASE WHEN tail_mean > 60 OR tail_max > 500 THEN 'outlier' WHEN drift_slope > 0.5 THEN 'drifting' ELSE 'ok' END equilibration FROM g""", "tail_mean tail_std tail_variation final_mean drift_slope")
def _(spark, d):
    s = ser(spark, d).withColumn("time_s", F.col("time_s") - 1.7e9)
    return series.equilibration(s, 60.0, 500.0, 0.5, 1e5)


@R.add("w13_tail_variation", "series", "WITH " + NUM + """, s AS (SELECT *, i >= least(n - 1, floor(n*0.1)) t FROM num) SELECT traj_id, max(value)-min(value) full_variation, max(value) FILTER (WHERE t) - min(value) FILTER (WHERE t) tail_variation, avg(value) FILTER (WHERE t) tail_mean, stddev_pop(value) FILTER (WHERE t) tail_std,
 min(time_s) FILTER (WHERE t) tail_start, max(time_s) FILTER (WHERE t) tail_end, count(*) FILTER (WHERE t) tail_n FROM s GROUP BY 1""", "full_variation tail_variation tail_mean tail_std")
def _(spark, d):
    return series.tail_variation(ser(spark, d))


@R.add("w14_drift_table", "series", "WITH " + NUM + """, s AS (SELECT *, i >= round_even(0.1*(n-1), 0) t, i >= round_even(0.8*(n-1), 0) l FROM num)
SELECT traj_id, avg(value) FILTER (WHERE t) tail_mean, quantile_cont(value, 0.95) FILTER (WHERE t) - quantile_cont(value, 0.05) FILTER (WHERE t) tail_band, regr_slope(value, (time_s-1.7e9)/1e5) FILTER (WHERE l) slope FROM s GROUP BY 1""", "tail_mean tail_band slope")
def _(spark, d):
    return series.drift_table(ser(spark, d).withColumn("time_s", (F.col("time_s") - 1.7e9) / 1e5))


@R.add("w03_dwell_segments", "series", """WITH s AS (SELECT traj_id, frame, CAST(floor(value) AS BIGINT) % 3 AS state, frame*200.0 time_ps FROM series), c AS (SELECT *, sum(ch) OVER (PARTITION BY traj_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY traj_id ORDER BY frame) <> state THEN 1 ELSE 0 END ch FROM s))
SELECT traj_id, CAST(run AS BIGINT) AS run, state, min(frame) AS "first", max(frame) AS "last", count(*) n, max(time_ps)-min(time_ps)+200.0 AS duration FROM c GROUP BY ALL""")
def dwells(spark, d):
    s = ser(spark, d).select("traj_id", "frame", (F.floor("value") % 3).alias("state"), (F.col("frame") * 200.0).alias("time_ps"))
    return persistence.dwell_segments(s)


@R.add("w03_dwell_summary", "series", """WITH s AS (SELECT traj_id, frame, CAST(floor(value) AS BIGINT) % 3 AS state FROM series), c AS (SELECT *, sum(ch) OVER (PARTITION BY traj_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY traj_id ORDER BY frame) <> state THEN 1 ELSE 0 END ch FROM s)),
r AS (SELECT traj_id, run, state, min(frame) f, count(*) n, max(run) OVER (PARTITION BY traj_id) mr FROM c GROUP BY ALL)
SELECT traj_id, state, count(*) n_visits, CAST(sum(n) AS BIGINT) n_frames, avg(n*200.0) mean_dwell, min(f) first_seen, count(*) FILTER (WHERE run > 0) transitions_in, count(*) FILTER (WHERE run < (SELECT max(run) FROM r q WHERE q.traj_id = r.traj_id)) transitions_out FROM r GROUP BY ALL""".replace(", max(run) OVER (PARTITION BY traj_id) mr", ""), "mean_dwell")
def _(spark, d):
    return persistence.dwell_summary(dwells(spark, d))


DAYS = "dy AS (SELECT CAST(user_id AS VARCHAR) traj_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) frame, avg(value) AS \"value\" FROM events GROUP BY ALL)"


@R.add("j08_windowed_nearest", "", "WITH " + DAYS + """, r AS (SELECT traj_id, min(frame) a, max(frame) b FROM dy GROUP BY 1), an AS (SELECT traj_id, CAST(unnest(range(a, b + 1)) AS INTEGER) frame FROM r), i AS (SELECT a.traj_id, a.frame, avg(value) v FROM an a JOIN dy s ON a.traj_id=s.traj_id AND abs(a.frame - s.frame) <= 2 GROUP BY ALL),
n AS (SELECT a.traj_id, a.frame, arg_min(value, (abs(a.frame - s.frame), s.frame)) v FROM an a JOIN dy s ON a.traj_id=s.traj_id GROUP BY ALL) SELECT n.traj_id, n.frame, coalesce(i.v, n.v) AS "value", i.v IS NOT NULL in_window FROM n LEFT JOIN i USING (traj_id, frame)""", "value")
def _(spark, d):
    """Every day between a user's first and last one is an anchor, the days' means are the samples."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("int")
    s = ad.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("traj_id"), day.alias("frame")).agg(F.avg("value").alias("value"))
    anchors = s.groupBy("traj_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("traj_id", F.explode(F.sequence("a", "b")).alias("frame"))
    return series.nearest_window(anchors, s, 2)


@R.add("j06_align_series", "frames", "SELECT traj_id, round(frame*200.0, 6) AS \"time\", CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b FROM frames WHERE frame % 2 = 0", "a b")
def _(spark, d):
    f = ad.frames(spark, d).select("traj_id", (F.col("frame") * 200.0).alias("time_ps"), "frame", "embedding")
    a = f.select("traj_id", "time_ps", F.lit("a").alias("metric"), F.col("embedding")[0].cast("double").alias("value"))
    b = f.where("frame % 2 = 0").select("traj_id", (F.col("time_ps") + 1e-8).alias("time_ps"), F.lit("b").alias("metric"), F.col("embedding")[1].cast("double").alias("value"))
    return series.align_series(a.unionByName(b), ["a", "b"])


def complex_id(traj):
    return (traj.cast("int") % 3).cast("string").alias("complex_id")


@R.add("u02_common_times", "series", "WITH s AS (SELECT DISTINCT CAST(CAST(traj_id AS INTEGER) // 3 AS VARCHAR) complex_id, traj_id, frame FROM series) SELECT a.complex_id, a.traj_id \"first\", b.traj_id \"second\", a.frame FROM s a JOIN s b ON a.complex_id=b.complex_id AND a.frame=b.frame AND a.traj_id < b.traj_id")
def _(spark, d):
    """Three users with adjoining numbers are replicas."""
    replica_of = F.floor(F.col("traj_id").cast("int") / 3).cast("string").alias("complex_id")
    return series.common_times(ser(spark, d).select(replica_of, "traj_id", "frame"), "complex_id")


@R.add("f03_downsample", "series", "WITH " + NUM + " SELECT traj_id, frame, value FROM num WHERE i % greatest(1, n // 20) = 0")
def _(spark, d):
    return annotate.downsample(ser(spark, d), 20).select("traj_id", "frame", "value")


@R.add("a64_time_envelope", "series", "SELECT frame, count(*) n, quantile_cont(value, 0.05) p5, quantile_cont(value, 0.25) p25, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.75) p75, quantile_cont(value, 0.95) p95 FROM series GROUP BY 1", "p5 p25 p50 p75 p95")
def _(spark, d):
    return replicas.time_envelope(ser(spark, d), "frame", "value")


@R.add("a65_pooled_percentiles", "series", "SELECT traj_id, count(*) n, quantile_cont(value, 0.05) p5, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95 FROM series GROUP BY 1", "p5 p50 p95")
def _(spark, d):
    return replicas.time_envelope(ser(spark, d), "traj_id", "value", (0.05, 0.5, 0.95))


@R.add("a62_duplicate_series", "replicas", "WITH a AS (SELECT complex_id, string_agg(label, ',' ORDER BY run) v FROM replicas GROUP BY 1) SELECT count(*) AS n, min(complex_id) AS \"first\" FROM a GROUP BY v HAVING count(*) > 1")
def _(spark, d):
    """Complexes whose replicas have the same labels in the same order, from the first replica to the last."""
    return replicas.duplicate_series(ad.replicas(spark, d), "complex_id", "run", "label").withColumn("n", F.col("n").cast("long"))


@R.add("a58_spread_vs_band", "replicas", "WITH g AS (SELECT complex_id, max(crossing)-min(crossing) spread, quantile_cont(crossing, 0.95)-quantile_cont(crossing, 0.05) band, stddev_samp(crossing) sd FROM replicas WHERE crossing < 400000 GROUP BY 1 HAVING count(*) >= 2) SELECT complex_id, spread / nullif(band, 0) ratio, sd within_sd FROM g", "ratio within_sd")
def _(spark, d):
    r = ad.replicas(spark, d).where("crossing < 400000")
    q = F.percentile("crossing", F.array(F.lit(0.05), F.lit(0.95)))
    g = r.groupBy("complex_id").agg((F.max("crossing") - F.min("crossing")).alias("s"), q.alias("q"), F.stddev_samp("crossing").alias("within_sd"), F.count("*").alias("k")).where("k >= 2")
    return g.select("complex_id", F.try_divide(F.col("s"), F.col("q")[1] - F.col("q")[0]).alias("ratio"), "within_sd")


def long_features(spark, d, n=6):
    return ad.frames(spark, d).select("traj_id", "frame", F.posexplode(F.slice("embedding", 1, n)).alias("j", "x")).select("traj_id", "frame", F.col("j").cast("int").alias("j"), F.col("x").cast("double").alias("x"))


FEATURES = "ft AS (SELECT traj_id, frame, CAST(j AS INTEGER) j, CAST(embedding[j+1] AS DOUBLE) x FROM frames, (SELECT unnest(range(0,6)) j))"


@R.add("w19_lagged_covariance", "frames", "WITH " + FEATURES + """, l AS (SELECT *, lead(x, 5) OVER (PARTITION BY traj_id, j ORDER BY frame) b FROM ft QUALIFY b IS NOT NULL)
SELECT p.traj_id, p.j AS i, q.j AS j, covar_samp(p.x, q.x) c00, covar_samp(p.b, q.b) ctt, covar_samp(p.x, q.b) c0t FROM l p JOIN l q ON p.traj_id=q.traj_id AND p.frame=q.frame GROUP BY ALL""", "c00 ctt c0t")
def _(spark, d):
    return series.lagged_covariance(long_features(spark, d), 5)


@R.add("m24_feature_covariance", "frames", "WITH " + FEATURES + " SELECT p.traj_id, p.j AS i, q.j AS j, covar_pop(p.x, q.x) cov, corr(p.x, q.x) corr FROM ft p JOIN ft q ON p.traj_id=q.traj_id AND p.frame=q.frame AND p.j <= q.j GROUP BY ALL", "cov corr")
def _(spark, d):
    return landscape.covariance(long_features(spark, d))


@R.add("m24_feature_moments", "frames", "WITH " + FEATURES + " SELECT traj_id, j, avg(x) AS mean, stddev_pop(x) AS std FROM ft GROUP BY ALL", "mean std")
def _(spark, d):
    return landscape.moments(long_features(spark, d))


@R.add("m24_principal_components")
def components(spark, d):
    return landscape.principal_components(long_features(spark, d))


@R.add("m25_tica")
def _(spark, d):
    return landscape.tica(long_features(spark, d), 5)


@R.add("m26_feature_component_correlation", "frames", "WITH " + FEATURES + " SELECT f.traj_id, f.j, corr(f.x, g.x) r FROM ft f JOIN ft g ON f.traj_id=g.traj_id AND f.frame=g.frame AND g.j = 0 GROUP BY ALL", "r")
def _(spark, d):
    f = long_features(spark, d)
    score = f.where("j = 0").select("traj_id", "frame", F.col("x").alias("score"))
    return f.join(score, ["traj_id", "frame"]).groupBy("traj_id", "j").agg(F.corr("x", "score").alias("r"))


def cvs(spark, d):
    return ad.frames(spark, d).select("traj_id", "frame", F.col("embedding")[0].cast("double").alias("cv1"), F.col("embedding")[1].cast("double").alias("cv2"))


GRID = """cv AS (SELECT traj_id, frame, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y FROM frames),
st AS (SELECT traj_id, count(*) c, min(x) xl, max(x) xh, min(y) yl, max(y) yh, quantile_cont(x,0.75)-quantile_cont(x,0.25) xi, quantile_cont(y,0.75)-quantile_cont(y,0.25) yi FROM cv GROUP BY 1),
nb AS (SELECT traj_id, xl, xh, yl, yh, CAST(greatest(10, least(100, ceil((xh-xl)/(2*xi/pow(c,1.0/3))))) AS INTEGER) nx, CAST(greatest(10, least(100, ceil((yh-yl)/(2*yi/pow(c,1.0/3))))) AS INTEGER) ny FROM st),
hs AS (SELECT traj_id, nx, ny, CAST(least(floor((x-xl)/(xh-xl)*nx), nx-1) AS INTEGER) ix, CAST(least(floor((y-yl)/(yh-yl)*ny), ny-1) AS INTEGER) iy, count(*) n FROM cv JOIN nb USING (traj_id) GROUP BY ALL)"""
FULL = GRID + """, gd AS (SELECT traj_id, CAST(a AS INTEGER) ix, CAST(b AS INTEGER) iy FROM nb, (SELECT unnest(range(0,100)) a), (SELECT unnest(range(0,100)) b) WHERE a < nx AND b < ny),
pp AS (SELECT traj_id, ix, iy, coalesce(n, 0) n, n / sum(n) OVER (PARTITION BY traj_id) p FROM gd LEFT JOIN hs USING (traj_id, ix, iy)),
ge AS (SELECT traj_id, ix, iy, n, coalesce(p, 0.0) p, -2.4942*ln(coalesce(p, min(p) OVER (PARTITION BY traj_id)*0.01)) g0 FROM pp), fe AS (SELECT traj_id, ix, iy, n, p, g0 - min(g0) OVER (PARTITION BY traj_id) g FROM ge)"""


@R.add("m16_histogram", "frames", "WITH " + GRID + " SELECT * FROM hs")
def _(spark, d):
    return landscape.histogram(cvs(spark, d), "cv1", "cv2")


def energy(spark, d):
    return landscape.free_energy(landscape.histogram(cvs(spark, d), "cv1", "cv2"))


@R.add("m16_free_energy", "frames", "WITH " + FULL + " SELECT * FROM fe", "p g")
def _(spark, d):
    return energy(spark, d)


@R.add("m16_smoothed", "frames", "WITH " + FULL + """, w AS (SELECT o, exp(-0.5*o*o) / sum(exp(-0.5*o*o)) OVER () w FROM (SELECT unnest(range(-4, 5)) o)),
sx AS (SELECT a.traj_id, a.ix, a.iy, sum(w*b.g) g FROM fe a JOIN nb USING (traj_id) CROSS JOIN w JOIN fe b ON b.traj_id=a.traj_id AND b.iy=a.iy AND b.ix = CASE WHEN a.ix+o < 0 THEN -1-a.ix-o WHEN a.ix+o >= nx THEN 2*nx-1-a.ix-o ELSE a.ix+o END GROUP BY ALL),
sy AS (SELECT a.traj_id, a.ix, a.iy, sum(w*b.g) g FROM sx a JOIN nb USING (traj_id) CROSS JOIN w JOIN sx b ON b.traj_id=a.traj_id AND b.ix=a.ix AND b.iy = CASE WHEN a.iy+o < 0 THEN -1-a.iy-o WHEN a.iy+o >= ny THEN 2*ny-1-a.iy-o ELSE a.iy+o END GROUP BY ALL)
SELECT traj_id, ix, iy, g - min(g) OVER (PARTITION BY traj_id) g FROM sy""", "g")
def _(spark, d):
    return landscape.smoothed(energy(spark, d))


@R.add("m17_free_energy_sparse", "frames", "WITH " + GRID + ", q AS (SELECT traj_id, ix, iy, n, n / sum(n) OVER (PARTITION BY traj_id) p FROM hs), e AS (SELECT *, -0.0019872041*300.0*ln(p) g0 FROM q) SELECT traj_id, ix, iy, n, p, g0 - min(g0) OVER (PARTITION BY traj_id) g FROM e", "p g")
def _(spark, d):
    return landscape.free_energy(landscape.histogram(cvs(spark, d), "cv1", "cv2"), kt=landscape.KT_KCAL, fill=False)


@R.add("m18_minima", "frames", "WITH " + FULL + """, r AS (SELECT * REPLACE (round(g, 9) AS g) FROM fe), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY g, ix, iy) k FROM r) WHERE k = 1), mx AS (SELECT traj_id, max(ix) mx, max(iy) my, min(g) g0 FROM r GROUP BY 1),
lo AS (SELECT a.traj_id, a.ix, a.iy, a.g, min(b.g) low FROM r a JOIN r b ON a.traj_id=b.traj_id AND abs(a.ix-b.ix) <= 1 AND abs(a.iy-b.iy) <= 1 AND a.g <> b.g GROUP BY ALL)
SELECT traj_id, ix, iy, g, true is_global FROM f UNION ALL SELECT lo.traj_id, lo.ix, lo.iy, lo.g, false FROM lo JOIN mx USING (traj_id) WHERE g < low AND ix > 0 AND iy > 0 AND ix < mx AND iy < my AND g - g0 <= 5.0 AND (traj_id, ix, iy) NOT IN (SELECT (traj_id, ix, iy) FROM f)""", "g")
def _(spark, d):
    return landscape.minima(energy(spark, d).withColumn("g", F.round("g", 9)))


@R.add("m20_representative_frames", "frames", "WITH " + GRID + """, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY n DESC, ix, iy) k FROM hs) WHERE k <= 3), c AS (SELECT traj_id, CAST(k AS INTEGER) AS state, xl + (ix+0.5)*(xh-xl)/tp.nx cx, yl + (iy+0.5)*(yh-yl)/tp.ny cy FROM tp JOIN nb USING (traj_id))
SELECT traj_id, state, arg_min(frame, (round((x-cx)*(x-cx)+(y-cy)*(y-cy), 12), frame)) AS frame FROM cv JOIN c USING (traj_id) GROUP BY ALL""")
def _(spark, d):
    p = cvs(spark, d)
    c = centres(spark, d).select("traj_id", "state", F.col("cv1").alias("cx"), F.col("cv2").alias("cy"))
    d2 = F.round((F.col("cv1") - F.col("cx")) * (F.col("cv1") - F.col("cx")) + (F.col("cv2") - F.col("cy")) * (F.col("cv2") - F.col("cy")), 12)
    return p.join(c, "traj_id").groupBy("traj_id", "state").agg(F.min_by("frame", F.struct(d2, "frame")).alias("frame"))


def centres(spark, d):
    """The middles of the three fullest cells of each trajectory."""
    from strandlake.operators.summaries import top_k

    p = cvs(spark, d)
    top = top_k(landscape.histogram(p, "cv1", "cv2"), 3, [F.desc("n"), "ix", "iy"], "traj_id", rank="state")
    e = p.groupBy("traj_id").agg(F.min("cv1").alias("xl"), F.max("cv1").alias("xh"), F.min("cv2").alias("yl"), F.max("cv2").alias("yh"))
    mid = lambda lo, hi, i, n: F.col(lo) + (F.col(i) + 0.5) * (F.col(hi) - F.col(lo)) / F.col(n)
    return top.join(e, "traj_id").select("traj_id", "state", mid("xl", "xh", "ix", "nx").alias("cv1"), mid("yl", "yh", "iy", "ny").alias("cv2"))


@R.add("j09_nearest_centre", "frames", "WITH " + GRID + """, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY n DESC, ix, iy) k FROM hs) WHERE k <= 3), c AS (SELECT traj_id, CAST(k AS INTEGER) AS state, xl + (ix+0.5)*(xh-xl)/tp.nx cx, yl + (iy+0.5)*(yh-yl)/tp.ny cy FROM tp JOIN nb USING (traj_id))
SELECT traj_id, frame, arg_min(state, ((x-cx)*(x-cx)+(y-cy)*(y-cy), state)) AS state, min((x-cx)*(x-cx)+(y-cy)*(y-cy)) d2 FROM cv JOIN c USING (traj_id) GROUP BY ALL""", "d2")
def _(spark, d):
    return landscape.nearest_centre(cvs(spark, d), centres(spark, d), ("cv1", "cv2"))


def two_states(spark, d):
    s = lambda i, k: (F.floor((F.col("embedding")[i].cast("double") + 4) * 2) % k)
    return ad.frames(spark, d).select("traj_id", "frame", s(0, 3).alias("p"), s(1, 2).alias("c"))


@R.add("m23_state_coupling", "frames", """WITH s AS (SELECT traj_id, CAST(floor((CAST(embedding[1] AS DOUBLE)+4)*2) AS BIGINT) % 3 p, CAST(floor((CAST(embedding[2] AS DOUBLE)+4)*2) AS BIGINT) % 2 c FROM frames), j AS (SELECT traj_id, p, c, count(*) n FROM s GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY traj_id) f, sum(n) OVER (PARTITION BY traj_id) t FROM j), m AS (SELECT *, sum(f) OVER (PARTITION BY traj_id, p) fp, sum(f) OVER (PARTITION BY traj_id, c) fc FROM f), e AS (SELECT *, f/(fp*fc) en FROM m),
g AS (SELECT traj_id, CAST(any_value(t) AS BIGINT) n_frames, sum(f*ln(en)) mi, -sum(f*ln(fp)) hp, -sum(f*ln(fc)) hc, count(DISTINCT p) np, count(DISTINCT c) nc, arg_max({'p': p, 'c': c, 'f': f}, (en, -p, -c)) FILTER (WHERE f >= 0.05) t FROM e GROUP BY 1),
v AS (SELECT *, np < 2 OR nc < 2 OR least(hp, hc) <= 1e-12 dg, CASE WHEN np < 2 OR nc < 2 OR least(hp, hc) <= 1e-12 THEN 0.0 ELSE mi/least(hp,hc) END nmi FROM g)
SELECT traj_id, n_frames, nmi, CASE WHEN dg THEN 'n/a' WHEN nmi < 0.05 THEN 'independent' WHEN nmi < 0.20 THEN 'weak' WHEN nmi < 0.40 THEN 'moderate' ELSE 'strong' END coupling, t.p top_p, t.c top_c, t.f top_occupancy FROM v WHERE n_frames >= 10""", "nmi top_occupancy")
def _(spark, d):
    return landscape.state_coupling(two_states(spark, d))


def grids_of(spark, d):
    """Grids of all trajectories over one set of cells, with the complex that each is a replica of."""
    cells = cvs(spark, d).select("traj_id", F.floor(F.col("cv1") * 5).cast("int").alias("ix"), F.floor(F.col("cv2") * 5).cast("int").alias("iy"), F.lit(1).alias("nx"), F.lit(1).alias("ny"))
    g = landscape.free_energy(cells.groupBy("traj_id", "nx", "ny", "ix", "iy").agg(F.count("*").alias("n")), fill=False)
    return materialize(g.select(complex_id(F.col("traj_id")), "*"), "grids")


PAIRS = """h AS (SELECT traj_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*5) AS INTEGER) ix, CAST(floor(CAST(embedding[2] AS DOUBLE)*5) AS INTEGER) iy, count(*) n FROM frames GROUP BY ALL), q AS (SELECT *, n/sum(n) OVER (PARTITION BY traj_id) p FROM h), e AS (SELECT *, CAST(CAST(traj_id AS INTEGER) % 3 AS VARCHAR) complex_id, -2.4942*ln(p) + 2.4942*ln(max(p) OVER (PARTITION BY traj_id)) g FROM q),
t AS (SELECT DISTINCT complex_id, traj_id FROM e), rp AS (SELECT a.complex_id, a.traj_id "first", b.traj_id "second" FROM t a JOIN t b ON a.complex_id=b.complex_id AND a.traj_id < b.traj_id)"""


@R.add("u04_region_jaccard", "frames", "WITH " + PAIRS + """, lo AS (SELECT * FROM e WHERE g <= 4)
SELECT complex_id, "first", "second", count(*) FILTER (WHERE c = 2)/count(*) jaccard, count(*) n_union FROM (SELECT rp.complex_id, rp."first", rp."second", ix, iy, count(*) c FROM rp JOIN lo ON lo.traj_id IN (rp."first", rp."second") GROUP BY ALL) GROUP BY ALL""", "jaccard")
def _(spark, d):
    return landscape.region_jaccard(grids_of(spark, d), 4.0, "complex_id")


@R.add("m27_compare_grids", "frames", "WITH " + PAIRS + """, u AS (SELECT rp.complex_id, rp."first", rp."second", ix, iy, max(CASE WHEN e.traj_id = rp."first" THEN p ELSE 0.0 END) p, max(CASE WHEN e.traj_id = rp."second" THEN p ELSE 0.0 END) q FROM rp JOIN e ON e.traj_id IN (rp."first", rp."second") GROUP BY ALL),
f AS (SELECT *, greatest(p, 1e-10) a, greatest(q, 1e-10) b FROM u) SELECT complex_id, "first", "second", round(sum(least(p,q)), 9) AS overlap, sum(a*ln(a/b)) kl_ab, sum(b*ln(b/a)) kl_ba FROM f GROUP BY ALL""", "kl_ab kl_ba")
def _(spark, d):
    return landscape.compare_grids(grids_of(spark, d), "complex_id").withColumn("overlap", F.round("overlap", 9))


@R.add("m21_kde_basins")
def _(spark, d):
    return landscape.kde_basins(cvs(spark, d), "cv1", "cv2", most=4)


@R.add("m22_substates")
def _(spark, d):
    return landscape.substates(cvs(spark, d), ("cv1", "cv2"))
