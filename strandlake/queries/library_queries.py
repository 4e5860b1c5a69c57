"""Replica, library, rule and quality queries over ``orders``, ``customer``, ``lineitem``, ``part`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake import adapters as ad
from strandlake.functions import labels
from strandlake.operators import joins, replicas, rules, summaries
from strandlake.queries.base import Registry

R = Registry()
reps = ad.replicas
PRIMARY = "pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY (run = 3) DESC, crossing DESC, run) k FROM replicas) WHERE k = 1)"


@R.add("a10_decomposition", "contacts", """WITH g AS (SELECT traj_id, region, partner, chain, count(*) n, sum(occupancy) occupancy FROM contacts GROUP BY GROUPING SETS ((traj_id, region, partner), (traj_id, chain), (traj_id))),
l AS (SELECT *, CASE WHEN region IS NOT NULL THEN 'region' WHEN chain IS NOT NULL THEN 'chain' ELSE 'total' END AS "level" FROM g)
SELECT *, coalesce(occupancy / nullif(max(occupancy) FILTER (WHERE "level"='total') OVER (PARTITION BY traj_id), 0), 0.0) ratio FROM l""", "occupancy ratio")
def _(spark, d):
    return summaries.decomposition(ad.contacts(spark, d))


@R.add("a11_reliability", "contacts", """WITH t AS (SELECT traj_id, count(*) n_pairs, sum(occupancy) occupancy_total, sum(occupancy) FILTER (WHERE region IN ('cdr1','cdr2','cdr3')) cdr_occupancy, sum(occupancy) FILTER (WHERE chain='alpha') a, sum(occupancy) FILTER (WHERE chain='beta') b,
 sum(occupancy) FILTER (WHERE region='cdr3' AND partner='peptide') pr, sum(occupancy) FILTER (WHERE region IN ('cdr1','cdr2') AND partner='mhc') hr FROM contacts GROUP BY 1),
s AS (SELECT traj_id, n_pairs, occupancy_total, cdr_occupancy, coalesce(a/occupancy_total, 0.0) alpha, coalesce(b/occupancy_total, 0.0) beta, coalesce(pr/occupancy_total, 0.0) peptide_recognition, coalesce(hr/occupancy_total, 0.0) hla_restriction FROM t)
SELECT *, CASE WHEN occupancy_total > 0 AND cdr_occupancy = 0 THEN 'degenerate' WHEN n_pairs > 500 THEN 'pair_count_outlier' WHEN occupancy_total > 0 AND least(alpha, beta) < 0.02 THEN 'single_chain_collapse' END unreliable_reason FROM s""", "occupancy_total cdr_occupancy alpha beta peptide_recognition hla_restriction")
def _(spark, d):
    return summaries.reliability(summaries.decomposition(ad.contacts(spark, d)))


@R.add("f16_withhold_unreliable", "contacts", "WITH t AS (SELECT traj_id, count(*) n, avg(occupancy) v FROM contacts GROUP BY 1) SELECT traj_id, CASE WHEN n <= 600 THEN v END ratio, CASE WHEN n > 600 THEN 'pair_count_outlier' END unreliable_reason FROM t", "ratio")
def _(spark, d):
    t = ad.contacts(spark, d).groupBy("traj_id").agg(F.count("*").alias("n"), F.avg("occupancy").alias("v"))
    ok = F.col("n") <= 600
    return t.select("traj_id", F.when(ok, F.col("v")).alias("ratio"), F.when(~ok, "pair_count_outlier").alias("unreliable_reason"))


@R.add("a43_primary_replica", "replicas", "WITH " + PRIMARY + " SELECT complex_id, run, crossing, label FROM pr", "crossing")
def _(spark, d):
    return replicas.primary_replica(reps(spark, d)).select("complex_id", "run", "crossing", "label")


@R.add("a44_collapse_replicas", "replicas", "WITH " + PRIMARY + " SELECT pr.complex_id, m.crossing, pr.label, pr.grp, pr.host, m.n n_replicas FROM pr JOIN (SELECT complex_id, avg(crossing) crossing, count(*) n FROM replicas GROUP BY 1) m USING (complex_id)", "crossing")
def _(spark, d):
    return replicas.collapse(reps(spark, d), ["crossing"], ["label", "grp", "host"])


@R.add("a45_replica_spread", "replicas", "SELECT complex_id, avg(crossing) mean, count(crossing) n, (max(crossing)-min(crossing))/2 spread, CASE WHEN count(crossing) >= 2 THEN max(crossing)-min(crossing) <= 50000.0 END reproducible FROM replicas GROUP BY 1", "mean spread")
def _(spark, d):
    return replicas.replica_spread(reps(spark, d), "crossing", 50000.0)


@R.add("a46_numeric_consensus", "replicas", "SELECT complex_id, avg(crossing) mean, coalesce(stddev_samp(crossing), 0.0) sd, min(crossing) AS \"min\", max(crossing) AS \"max\", max(crossing)-min(crossing) AS \"range\", count(crossing) n FROM replicas GROUP BY 1", "mean sd range")
def _(spark, d):
    return replicas.numeric_consensus(reps(spark, d), "crossing")


@R.add("a47_majority_label", "replicas", "WITH " + PRIMARY + """, c AS (SELECT complex_id, label, count(*) c FROM replicas GROUP BY ALL), t AS (SELECT *, max(c) OVER (PARTITION BY complex_id) m FROM c),
g AS (SELECT t.complex_id, sum(c) n, count(*) k, count(*) FILTER (WHERE c=m) tied, min(t.label) FILTER (WHERE c=m) low, max(t.label) FILTER (WHERE c=m AND t.label=pr.label) prim FROM t JOIN pr USING (complex_id) GROUP BY 1)
SELECT complex_id, CASE WHEN tied=1 THEN low ELSE coalesce(prim, low) END label, CASE WHEN n >= 2 THEN k = 1 END agree, CAST(n AS BIGINT) n_observed FROM g""")
def _(spark, d):
    r = reps(spark, d)
    return replicas.majority_label(r, "label", replicas.primary_replica(r).select("complex_id", F.col("label").alias("primary_label")))


@R.add("a48_majority_bool", "replicas", """WITH g AS (SELECT complex_id, count(reversed_polarity) n, count(*) FILTER (WHERE reversed_polarity) t, avg(crossing/400000.0) w FROM replicas GROUP BY 1)
SELECT complex_id, CASE WHEN 2*t <> n THEN 2*t > n ELSE w > 0.5 END AS "value", CASE WHEN n >= 2 THEN t = 0 OR t = n END agree, n n_observed FROM g WHERE n > 0""")
def _(spark, d):
    return replicas.majority_bool(reps(spark, d).withColumn("w", F.col("crossing") / 400000.0), "reversed_polarity", "w")


EQ = "CASE WHEN crossing > 300000 THEN 'outlier' WHEN crossing > 150000 THEN 'drifting' ELSE 'ok' END"


def equilibrated(spark, d):
    return reps(spark, d).withColumn("eq", F.when(F.col("crossing") > 300000, "outlier").when(F.col("crossing") > 150000, "drifting").otherwise("ok"))


@R.add("a49_worst_label", "replicas", f"""WITH e AS (SELECT *, {EQ} eq FROM replicas) SELECT complex_id, CASE max(CASE eq WHEN 'outlier' THEN 2 WHEN 'drifting' THEN 1 ELSE 0 END) WHEN 2 THEN 'outlier' WHEN 1 THEN 'drifting' ELSE 'ok' END consensus,
 count(*) FILTER (WHERE eq='ok') n_ok, count(*) FILTER (WHERE eq='drifting') n_drifting, count(*) FILTER (WHERE eq='outlier') n_outlier, CASE WHEN count(*) >= 2 THEN count(DISTINCT eq) = 1 END reproducible, count(*) n FROM e GROUP BY 1""")
def _(spark, d):
    return replicas.worst_label(equilibrated(spark, d), "eq", ["ok", "drifting", "outlier"])


@R.add("a50_complex_rows", "replicas", "SELECT complex_id, string_agg(CAST(run AS VARCHAR) || ':' || label, ';' ORDER BY run) AS replicas, bool_and(reversed_polarity) all_flag, count(*) n_replicas FROM replicas GROUP BY 1")
def _(spark, d):
    c = replicas.complex_rows(reps(spark, d), ["label", "crossing"], "reversed_polarity")
    return c.withColumn("replicas", labels.list_text(F.transform("replicas", lambda s: F.concat(s["run"].cast("string"), F.lit(":"), s["label"]))))


DIST = "count(crossing) n, avg(crossing) mean, quantile_cont(crossing, 0.25) p25, quantile_cont(crossing, 0.5) median, quantile_cont(crossing, 0.75) p75, min(crossing) AS \"min\", max(crossing) AS \"max\""


@R.add("a51_distribution", "replicas", f"SELECT grp, {DIST} FROM replicas GROUP BY 1", "mean p25 median p75")
def _(spark, d):
    return replicas.distribution(reps(spark, d), "crossing", "grp")


@R.add("a52_grouped_distribution", "replicas", f"SELECT host, {DIST} FROM replicas GROUP BY 1 HAVING count(crossing) >= 5 ORDER BY n DESC, host LIMIT 8", "mean p25 median p75")
def _(spark, d):
    return replicas.grouped_distribution(reps(spark, d), "crossing", "host")


@R.add("a53_value_counts", "replicas", "SELECT label, grp, count(*) n FROM replicas GROUP BY ALL")
def _(spark, d):
    return replicas.value_counts(reps(spark, d), "label", "grp")


@R.add("a54_reproducibility", "replicas", """WITH u AS (SELECT complex_id, 'crossing' metric, crossing v FROM replicas UNION ALL SELECT complex_id, 'scaled', crossing/1000.0 FROM replicas), p AS (SELECT complex_id, metric, max(v)-min(v) r FROM u GROUP BY ALL HAVING count(*) >= 2)
SELECT metric, count(*) n_complexes, avg(CASE WHEN r <= CASE metric WHEN 'crossing' THEN 60000.0 ELSE 90.0 END THEN 1.0 ELSE 0.0 END) share_reproducible FROM p GROUP BY 1""", "share_reproducible")
def _(spark, d):
    return replicas.reproducibility(reps(spark, d).select("complex_id", "crossing", (F.col("crossing") / 1000.0).alias("scaled")), {"crossing": 60000.0, "scaled": 90.0})


@R.add("a56_coupling_agreement", "replicas", "SELECT complex_id, count(*) n, count(*) FILTER (WHERE crossing/400000.0 >= 0.4) n_coupled, count(*) FILTER (WHERE crossing/400000.0 >= 0.4) > 0 AND 2 * count(*) FILTER (WHERE crossing/400000.0 >= 0.4) >= count(*) reproducible FROM replicas GROUP BY 1")
def _(spark, d):
    from strandlake.operators.landscape import coupling_agreement

    return coupling_agreement(reps(spark, d).withColumn("nmi", F.col("crossing") / 400000.0), limit=0.4)


@R.add("a57_icc", "replicas", """WITH g AS (SELECT complex_id, avg(crossing) m, var_pop(crossing) v FROM replicas WHERE run <= 3 GROUP BY 1 HAVING count(*) = 3), s AS (SELECT count(*) groups, 3*var_samp(m) msb, avg(v)*3/2 msw FROM g)
SELECT groups, (msb-msw)/(msb+2*msw) icc1, (msb-msw)/msb icck FROM s""", "icc1 icck")
def _(spark, d):
    return replicas.icc(reps(spark, d).where("run <= 3"), "crossing", "complex_id", 3)


@R.add("a59_tukey_fences", "replicas", """WITH q AS (SELECT host, quantile_cont(crossing, 0.25) a, quantile_cont(crossing, 0.75) b FROM replicas GROUP BY 1 HAVING count(*) >= 8)
SELECT complex_id, run, crossing, host, crossing > b + 3*(b-a) OR crossing < a - 3*(b-a) far FROM replicas JOIN q USING (host) WHERE crossing > b + 0.5*(b-a) OR crossing < a - 0.5*(b-a)""", "crossing")
def _(spark, d):
    return replicas.tukey_fences(reps(spark, d), "crossing", "host", k=0.5).select("complex_id", "run", "crossing", "host", "far")


@R.add("a60_flag_tally", "replicas", """WITH f AS (SELECT complex_id, 'size' axis, crossing > 400000 far FROM replicas WHERE crossing > 250000 UNION ALL SELECT complex_id, 'label', false FROM replicas WHERE label LIKE '1%' UNION ALL SELECT complex_id, 'polarity', false FROM replicas WHERE reversed_polarity)
SELECT complex_id, count(DISTINCT axis) n_axes, count(*) FILTER (WHERE far) n_far FROM f GROUP BY 1 HAVING count(DISTINCT axis) >= 2""")
def _(spark, d):
    r = reps(spark, d)
    axis = lambda cond, name, far: r.where(cond).select("complex_id", F.lit(name).alias("axis"), far.alias("far"))
    no = F.lit(False)
    flags = axis(F.col("crossing") > 250000, "size", F.col("crossing") > 400000).unionByName(axis(F.col("label").startswith("1"), "label", no)).unionByName(axis(F.col("reversed_polarity"), "polarity", no))
    return replicas.flag_tally(flags, "complex_id")


@R.add("a61_widest_coupling", "replicas", """WITH e AS (SELECT *, length(label) ll, crossing/(run+1.0) x, crossing*run y FROM replicas), g AS (SELECT complex_id, count(*) n, arg_max(x, crossing) ax, min(x) mx, arg_max(y, crossing) ay, max(y) my FROM e GROUP BY 1 HAVING count(*) >= 3)
SELECT complex_id, n, CAST(ax = mx AS INTEGER) + CAST(ay = my AS INTEGER) hits FROM g""")
def _(spark, d):
    r = reps(spark, d).withColumns({"x": F.col("crossing") / (F.col("run") + 1.0), "y": F.col("crossing") * F.col("run")})
    return joins.widest_run_coupling(r, "complex_id", "run", "crossing", ["x"], ["y"])


@R.add("a63_declared_vs_found", "replicas", "SELECT complex_id, 'declared_only' AS side FROM (SELECT DISTINCT complex_id FROM replicas WHERE crossing > 200000) WHERE complex_id NOT IN (SELECT complex_id FROM replicas WHERE reversed_polarity) UNION ALL SELECT complex_id, 'found_only' FROM (SELECT DISTINCT complex_id FROM replicas WHERE reversed_polarity) WHERE complex_id NOT IN (SELECT complex_id FROM replicas WHERE crossing > 200000)")
def _(spark, d):
    r = reps(spark, d)
    return replicas.declared_vs_found(r.where("crossing > 200000"), r.where("reversed_polarity"), "complex_id")


@R.add("a66_correlation", "replicas", "SELECT grp, corr(crossing, run) r, count(*) n FROM replicas GROUP BY 1", "r")
def _(spark, d):
    return reps(spark, d).groupBy("grp").agg(F.corr("crossing", "run").alias("r"), F.count("*").alias("n"))


@R.add("a67_composition", "replicas", "WITH c AS (SELECT locus, grp, count(*) n FROM replicas GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY locus) AS \"share\" FROM c", "share")
def _(spark, d):
    from pyspark.sql import Window as W

    c = reps(spark, d).groupBy("locus", "grp").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("locus")))


@R.add("a68_reuse_groups", "replicas", "SELECT host, count(DISTINCT complex_id) n_entities, count(DISTINCT label) n_labels, count(DISTINCT grp) n_groups FROM replicas GROUP BY 1 HAVING count(DISTINCT complex_id) > 1")
def _(spark, d):
    g = reps(spark, d).groupBy("host").agg(F.countDistinct("complex_id").alias("n_entities"), F.countDistinct("label").alias("n_labels"), F.countDistinct("grp").alias("n_groups"))
    return g.where("n_entities > 1").orderBy(F.desc("n_entities"), "host")


@R.add("a70_trust_tier", "replicas", """WITH e AS (SELECT complex_id, run, CASE WHEN crossing > 300000 THEN 'low' WHEN crossing > 150000 THEN 'medium' ELSE 'high' END lv, crossing < 250000 cons, NOT reversed_polarity rel, run % 3 soft FROM replicas),
s AS (SELECT *, CASE lv WHEN 'low' THEN 2.0 WHEN 'medium' THEN 1.0 ELSE 0.0 END + CASE WHEN NOT cons THEN 1.0 ELSE 0.0 END + CASE WHEN NOT rel THEN 1.0 ELSE 0.0 END + least(soft, 2)*0.5 demerits FROM e)
SELECT complex_id, run, CAST(demerits AS DOUBLE) demerits, CASE WHEN demerits < 1 THEN 'A' WHEN demerits < 3 THEN 'B' ELSE 'C' END tier FROM s""")
def _(spark, d):
    e = reps(spark, d).withColumns(
        {"lv": F.when(F.col("crossing") > 300000, "low").when(F.col("crossing") > 150000, "medium").otherwise("high"), "cons": F.col("crossing") < 250000, "rel": ~F.col("reversed_polarity"), "soft": F.col("run") % 3}
    )
    return replicas.trust_tier(e, "lv", "cons", "rel", "soft").select("complex_id", "run", "demerits", "tier")


@R.add("a71_histogram", "replicas", "WITH e AS (SELECT min(crossing) lo, max(crossing) hi FROM replicas) SELECT CAST(least(floor((crossing-lo)/((hi-lo)/20)), 19) AS INTEGER) AS bin, grp, count(*) n FROM replicas, e GROUP BY ALL")
def _(spark, d):
    return replicas.equal_width_histogram(reps(spark, d), "crossing", 20, "grp")


@R.add("a73_box_profile", "replicas", "SELECT run, count(*) n, quantile_cont(crossing, 0.1) p10, quantile_cont(crossing, 0.25) p25, quantile_cont(crossing, 0.5) p50, quantile_cont(crossing, 0.75) p75, quantile_cont(crossing, 0.9) p90 FROM replicas GROUP BY 1", "p10 p25 p50 p75 p90")
def _(spark, d):
    return replicas.box_profile(reps(spark, d), "crossing", "run")


@R.add("j12_replica_pairs", "replicas", "SELECT a.complex_id, a.label, a.run run_1, b.run run_2 FROM replicas a JOIN replicas b ON a.complex_id=b.complex_id AND a.label=b.label AND a.run < b.run")
def _(spark, d):
    return replicas.replica_pairs(reps(spark, d), same="label")


@R.add("j11_borrow_labels", "replicas", """WITH l AS (SELECT complex_id, run, 'pri' item, label FROM replicas), bad AS (SELECT complex_id, run FROM replicas WHERE reversed_polarity), g AS (SELECT * FROM l ANTI JOIN bad USING (complex_id, run)), dn AS (SELECT complex_id, min(run) donor FROM g GROUP BY 1)
SELECT l.complex_id, l.run, l.item, l.label, dn.donor, g.label borrowed FROM l JOIN bad USING (complex_id, run) JOIN dn USING (complex_id) JOIN g ON g.complex_id=l.complex_id AND g.run=dn.donor""")
def _(spark, d):
    r = reps(spark, d)
    return replicas.borrow_labels(r.select("complex_id", "run", F.lit("pri").alias("item"), "label"), r.where("reversed_polarity").select("complex_id", "run"))


@R.add("j03_manifest_join", "replicas", "SELECT c_custkey complex_id, c_name AS \"name\", run, crossing FROM customer LEFT JOIN replicas ON c_custkey = complex_id", "crossing")
def _(spark, d):
    m = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("complex_id"), F.col("c_name").alias("name"))
    return m.join(reps(spark, d).select("complex_id", "run", "crossing"), "complex_id", "left")


METRICS_SQL = "m AS (SELECT 'mean_' || grp metric, run, avg(crossing) v FROM replicas GROUP BY ALL)"


@R.add("j10_metric_comparison", "replicas", "WITH " + METRICS_SQL + " SELECT coalesce(x.metric, y.metric) metric, x.v a, y.v b, y.v - x.v delta, CASE WHEN x.v <> 0 THEN 100*(y.v-x.v)/abs(x.v) END relative_pct FROM (SELECT * FROM m WHERE run=1) x FULL JOIN (SELECT * FROM m WHERE run=2) y ON x.metric=y.metric", "a b delta relative_pct")
def compared(spark, d):
    m = reps(spark, d).groupBy(F.concat(F.lit("mean_"), "grp").alias("metric"), "run").agg(F.avg("crossing").alias("value"))
    return replicas.compare_metrics(m.where("run = 1").drop("run"), m.where("run = 2").drop("run"))


@R.add("k04_strongest_delta", "replicas", "WITH " + METRICS_SQL + ", j AS (SELECT x.metric, y.v - x.v delta FROM (SELECT * FROM m WHERE run=1) x JOIN (SELECT * FROM m WHERE run=2) y USING (metric)) SELECT metric, delta FROM j ORDER BY abs(delta) DESC LIMIT 1", "delta")
def _(spark, d):
    return compared(spark, d).where("delta IS NOT NULL").agg(F.max_by(F.struct("metric", "delta"), F.abs("delta")).alias("m")).select("m.metric", "m.delta")


@R.add("k05_comparability", "replicas", "WITH s AS (SELECT complex_id, max(crossing)-min(crossing) sp, stddev_pop(crossing) va, count(*) n FROM replicas WHERE run <= 3 GROUP BY 1) SELECT a.complex_id, CASE WHEN least(a.sp, b.sp)/greatest(a.sp, b.sp) >= 0.8 AND least(a.va, b.va)/greatest(a.va, b.va) >= 0.7 THEN 'comparable' ELSE 'caution' END label FROM s a JOIN s b ON b.complex_id = a.complex_id + 1 WHERE a.n = 3 AND b.n = 3")
def _(spark, d):
    s = reps(spark, d).where("run <= 3").groupBy("complex_id").agg((F.max("crossing") - F.min("crossing")).alias("sp"), F.stddev_pop("crossing").alias("va"), F.count("*").alias("n")).where("n = 3")
    b = s.select((F.col("complex_id") - 1).alias("complex_id"), F.col("sp").alias("sp2"), F.col("va").alias("va2"))
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    return s.join(b, "complex_id").select("complex_id", F.when((ratio("sp", "sp2") >= 0.8) & (ratio("va", "va2") >= 0.7), "comparable").otherwise("caution").alias("label"))


@R.add("k06_preflight", "replicas", """WITH f AS (SELECT complex_id, run, unnest(['label','grp']) field, unnest([label, grp]) v FROM replicas)
SELECT coalesce(x.complex_id, y.complex_id) complex_id, coalesce(x.field, y.field) field, x.v a, y.v b, CASE WHEN x.v IS NULL OR y.v IS NULL OR x.v='' OR y.v='' THEN 'missing' WHEN x.v = y.v THEN 'passed' ELSE 'failed' END status
FROM (SELECT * FROM f WHERE run=1) x FULL JOIN (SELECT * FROM f WHERE run=2) y ON x.complex_id=y.complex_id AND x.field=y.field""")
def _(spark, d):
    r = reps(spark, d)
    return replicas.preflight(r.where("run = 1"), r.where("run = 2"), ["label", "grp"], "complex_id")


@R.add("k03_top_contributors", "contacts", "SELECT traj_id, partner_id, occupancy, CAST(k AS INTEGER) AS \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY round(occupancy, 6) DESC, partner_id) k FROM (SELECT traj_id, partner_id, sum(occupancy) occupancy FROM contacts GROUP BY ALL)) WHERE k <= 10", "occupancy")
def _(spark, d):
    s = ad.contacts(spark, d).groupBy("traj_id", "partner_id").agg(F.sum("occupancy").alias("occupancy"))
    return summaries.top_k(s, 10, [F.round("occupancy", 6).desc(), "partner_id"], "traj_id")


@R.add("a08_heatmap_long", "contacts", "SELECT region, partner, max(occupancy) occupancy, count(*) n FROM contacts WHERE chain = 'alpha' GROUP BY ALL", "occupancy")
def _(spark, d):
    return ad.contacts(spark, d).where("chain = 'alpha'").groupBy("region", "partner").agg(F.max("occupancy").alias("occupancy"), F.count("*").alias("n"))


@R.add("u03_completion", "", "SELECT count(*) n_expected, count(*) FILTER (WHERE done) n_processed, count(*) FILTER (WHERE done) / count(*) rate FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) done FROM customer)", "rate")
def _(spark, d):
    expected = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    done = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("done", F.lit(True))
    j = expected.join(done, "id", "left")
    return j.agg(F.count("*").alias("n_expected"), F.count("done").alias("n_processed"), (F.count("done") / F.count("*")).alias("rate"))


@R.add("u03_missing", "", "SELECT c_custkey id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    expected = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return expected.join(ad.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti")


@R.add("a34_completeness", "", "SELECT o_custkey dir, bool_or(o_orderstatus='F') has_structure, bool_or(o_orderstatus='O') has_trajectory, CASE WHEN bool_or(o_orderstatus='F') AND bool_or(o_orderstatus='O') THEN 'complete' ELSE 'incomplete' END status, CASE WHEN bool_or(o_orderstatus='F') AND bool_or(o_orderstatus='O') THEN 100.0 WHEN bool_or(o_orderstatus='O') THEN 50.0 ELSE 0.0 END score FROM orders GROUP BY 1")
def _(spark, d):
    from strandlake.operators.inventory import completeness

    o = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("dir"), (F.col("o_orderstatus") == "F").alias("is_structure"), (F.col("o_orderstatus") == "O").alias("is_trajectory"))
    return completeness(o)


@R.add("a35_issue_frequency", "", "WITH i AS (SELECT unnest(list_filter([CASE WHEN o_orderstatus='F' THEN 'missing_trajectory' END, CASE WHEN o_totalprice > 200000 THEN 'too_large' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low_priority' END], lambda x: x IS NOT NULL)) issue FROM orders) SELECT issue, count(*) n, CAST(count(*) * CASE issue WHEN 'missing_trajectory' THEN 3 WHEN 'too_large' THEN 2 ELSE 1 END AS BIGINT) impact FROM i GROUP BY 1 ORDER BY impact DESC LIMIT 10")
def _(spark, d):
    from strandlake.operators.inventory import issue_frequency

    o = ad.table(spark, d, "orders").select(
        F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "missing_trajectory"), F.when(F.col("o_totalprice") > 200000, "too_large"), F.when(F.col("o_orderpriority").startswith("5"), "low_priority"))).alias("issues")
    )
    return issue_frequency(o, {"missing_trajectory": 3, "too_large": 2}, 10)


@R.add("a36_chain_counts", "", "WITH c AS (SELECT o_custkey, count(*) n_chains FROM orders GROUP BY 1) SELECT n_chains, n, n / sum(n) OVER () AS \"share\" FROM (SELECT n_chains, count(*) n FROM c GROUP BY 1)", "share")
def _(spark, d):
    from strandlake.operators.inventory import count_shares

    return count_shares(ad.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_chains")), "n_chains")


@R.add("a37_batch_duplicates", "", "WITH e AS (SELECT regexp_extract(o_orderpriority, '^([0-9])', 1) batch, o_custkey id FROM orders) SELECT id, count(*) n, count(DISTINCT batch) n_batches FROM e GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    from strandlake.operators.inventory import duplicates

    return duplicates(ad.table(spark, d, "orders").select(F.regexp_extract("o_orderpriority", "^([0-9])", 1).alias("batch"), F.col("o_custkey").alias("id")))


@R.add("a38_retention", "", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def _(spark, d):
    from strandlake.operators.inventory import retained

    o = ad.table(spark, d, "orders")
    known = ad.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return retained(o, "o_orderdate", 365, known, "o_custkey").select("o_orderkey", "o_custkey")


@R.add("a39_batch_success", "", "SELECT o_orderpriority batch, count(*) n, count(*) FILTER (WHERE o_orderstatus='F') n_ok, count(*) FILTER (WHERE o_orderstatus<>'F') n_failed, count(*) FILTER (WHERE o_orderstatus='F') / count(*) rate FROM orders GROUP BY 1", "rate")
def _(spark, d):
    from strandlake.operators.inventory import success

    return success(ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch"), (F.col("o_orderstatus") == "F").alias("ok")))


@R.add("a72_lineage", "", "SELECT p_brand lineage, count(DISTINCT p_type) n_variants, CASE WHEN count(DISTINCT p_type) <= 3 THEN string_agg(DISTINCT p_type, ', ' ORDER BY p_type) ELSE CAST(count(DISTINCT p_type) AS VARCHAR) || ' variants' END AS \"text\", max(p_retailprice)/min(p_retailprice) fold FROM part GROUP BY 1", "fold")
def _(spark, d):
    from strandlake.operators.inventory import lineage

    return lineage(ad.table(spark, d, "part"), "p_brand", "p_type", "p_retailprice")


@R.add("f10_antigen_category", "", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%self%' THEN 'tumor/self' WHEN p_brand = 'Brand#11' THEN CASE WHEN p_size % 2 = 0 THEN 'tumor/self' ELSE 'other' END ELSE NULL END category FROM part")
def _(spark, d):
    o = F.when(F.col("p_brand") == "Brand#11", F.when(F.col("p_size") % 2 == 0, "Homo sapiens").otherwise("Gallus gallus"))
    return ad.table(spark, d, "part").select("p_partkey", rules.antigen_category(o, F.when(F.col("p_name").contains("self"), F.col("p_name")), F.lit(None)).alias("category"))


@R.add("f11_antigen_name", "", "SELECT p_partkey, CASE WHEN upper(replace(p_name,' ','')) = upper(CASE WHEN p_size % 2 = 0 THEN replace(p_name,' ','') ELSE p_brand END) THEN NULL ELSE p_name END AS \"name\" FROM part")
def _(spark, d):
    seq = F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_brand"))
    return ad.table(spark, d, "part").select("p_partkey", rules.antigen_name(F.col("p_name"), seq).alias("name"))


@R.add("f12_normalize_allele", "", "SELECT p_partkey, 'HLA-' || ['A','B','C'][p_partkey % 3 + 1] || '*' || lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN ':' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') ELSE '' END allele FROM part")
def _(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    gene = F.element_at(F.array(F.lit("A"), F.lit("b"), F.lit("C")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("hla-"), gene, F.when(F.col("p_partkey") % 5 == 0, "*").otherwise(" "), two(F.col("p_size")), F.when(F.col("p_partkey") % 2 == 0, two(F.col("p_partkey") % 100)).otherwise(" heavy chain"))
    return ad.table(spark, d, "part").select("p_partkey", rules.normalize_allele(text).alias("allele"))


@R.add("f13_entity_role", "", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'b2m' WHEN p_partkey % 5 = 1 THEN 'mhc' WHEN p_partkey % 5 = 2 THEN 'tcr_alpha' WHEN p_partkey % 5 = 3 THEN 'tcr_beta' WHEN p_size <= 30 THEN 'peptide' ELSE 'other' END AS role FROM part")
def _(spark, d):
    text = F.element_at(F.array(*map(F.lit, ("Beta-2-microglobulin", "HLA class I heavy chain", "T-cell receptor alpha", "TCR beta chain", "unnamed"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return ad.table(spark, d, "part").select("p_partkey", rules.entity_role(text, F.col("p_size")).alias("role"))


@R.add("f09_host_species", "", "WITH e AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END rk, l_linestatus o FROM lineitem) SELECT l_suppkey, arg_min(o, (rk, o)) host FROM e GROUP BY 1")
def _(spark, d):
    role = F.when(F.col("l_returnflag") == "A", "b2m").when(F.col("l_returnflag") == "N", "mhc").otherwise("tcr_alpha")
    return rules.host_species(ad.table(spark, d, "lineitem").select("l_suppkey", role.alias("role"), F.col("l_linestatus").alias("organism")), "l_suppkey")


@R.add("f07_resolve_allele", "", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'M' WHEN p_size < 20 THEN p_brand WHEN p_size < 40 THEN p_type END allele, CASE WHEN p_size < 5 THEN 'manual' WHEN p_size < 20 THEN 'precise' WHEN p_size < 40 THEN 'coarse' END allele_source FROM part")
def _(spark, d):
    s = F.col("p_size")
    p = ad.table(spark, d, "part").select("p_partkey", F.when(s < 5, "M").alias("manual"), F.when(s < 20, F.col("p_brand")).otherwise("").alias("precise"), F.when(s < 40, F.col("p_type")).alias("coarse"))
    return rules.resolve_allele(p, ["manual", "precise", "coarse"]).select("p_partkey", "allele", "allele_source")


@R.add("f08_best_typed_allele", "", "WITH c AS (SELECT p_brand k, 1 - (p_size % 3)/100.0 identity, CASE WHEN p_partkey % 7 = 0 THEN 'low' ELSE 'high' END conf, CAST(p_size AS BIGINT) g, p_partkey % 50 p FROM part), o AS (SELECT *, max(identity) OVER (PARTITION BY k) m FROM c WHERE identity >= 0.98 AND conf='high'), r AS (SELECT k, min((g, p)) t, max(identity) identity FROM o WHERE identity = m GROUP BY 1) SELECT k, 'HLA-A*' || lpad(CAST(t[1] AS VARCHAR), 2, '0') || ':' || lpad(CAST(t[2] AS VARCHAR), 2, '0') allele, CAST(identity AS DOUBLE) identity FROM r", "identity")
def _(spark, d):
    p = ad.table(spark, d, "part").select(
        F.col("p_brand").alias("k"), (1 - (F.col("p_size") % 3) / 100.0).alias("identity"), F.lit(0.9).alias("coverage"), F.when(F.col("p_partkey") % 7 == 0, "low").otherwise("high").alias("confidence"),
        F.format_string("HLA-A*%02d:%02d", F.col("p_size"), (F.col("p_partkey") % 50).cast("int")).alias("allele"),
    )
    return rules.best_typed_allele(p, "k")


@R.add("f14_coarse_allele", "", "SELECT split_part('HLA-' || p_brand || '*' || CAST(p_size AS VARCHAR), '*', 1) locus, count(*) n FROM part GROUP BY 1")
def _(spark, d):
    a = F.concat(F.lit("HLA-"), "p_brand", F.lit("*"), F.col("p_size").cast("string"))
    return ad.table(spark, d, "part").groupBy(labels.coarse_allele(a).alias("locus")).agg(F.count("*").alias("n"))


@R.add("f15_feature_encoding", "", "SELECT o_orderkey, sin(radians(o_totalprice % 360)) angle_sin, cos(radians(o_totalprice % 360)) angle_cos, ln(greatest(0.02, least(0.98, (o_totalprice % 100)/100)) / (1 - greatest(0.02, least(0.98, (o_totalprice % 100)/100)))) share_logit, ln(o_totalprice/1000.0) log_ratio, o_totalprice/7.0 per_unit FROM orders", "angle_sin angle_cos share_logit log_ratio per_unit")
def _(spark, d):
    o = ad.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") % 360).alias("ang"), ((F.col("o_totalprice") % 100) / 100).alias("sh"), F.col("o_totalprice").alias("a"), F.lit(1000.0).alias("b"), F.lit(7.0).alias("t"))
    return rules.feature_encoding(o, "ang", "sh", "a", "b", "t").select("o_orderkey", "angle_sin", "angle_cos", "share_logit", "log_ratio", "per_unit")


@R.add("x10_chain_roles", "", """WITH c AS (SELECT p_brand k, p_partkey chain_id, CAST(p_size AS INTEGER) * 3 n_residues FROM part), r AS (SELECT *, n_residues BETWEEN 4 AND 25 sh, n_residues BETWEEN 80 AND 130 li FROM c),
w AS (SELECT *, sh AND row_number() OVER (PARTITION BY k ORDER BY NOT sh, n_residues, chain_id) = 1 p, row_number() OVER (PARTITION BY k ORDER BY n_residues DESC, chain_id) = 1 m, li AND row_number() OVER (PARTITION BY k ORDER BY NOT li, chain_id) = 1 b FROM r)
SELECT k, chain_id, CASE WHEN p THEN 'peptide' WHEN m THEN 'mhc' WHEN b THEN 'b2m' ELSE 'other' END AS role FROM w""")
def _(spark, d):
    c = ad.table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("chain_id"), (F.col("p_size") * 3).alias("n_residues"), F.lit(None).cast("string").alias("role"))
    return rules.chain_roles(c, "k").select("k", "chain_id", "role")


@R.add("x11_receptor_type", "", """WITH c AS (SELECT o_custkey k, CASE WHEN o_orderkey % 2 = 0 THEN 'alpha' ELSE 'beta' END slot, ['TRA','TRB','TRG','TRD'][o_orderkey % 4 + 1] locus, o_orderkey chain_id FROM orders), s AS (SELECT k, slot, arg_min(chain_id, (locus NOT IN ('TRA','TRB'), chain_id)) c FROM c GROUP BY ALL)
SELECT k, CASE WHEN bool_or(locus='TRG') THEN 'gd' ELSE 'ab' END receptor_type, any_value(a.c) alpha, any_value(b.c) beta FROM c LEFT JOIN (SELECT * FROM s WHERE slot='alpha') a USING (k) LEFT JOIN (SELECT * FROM s WHERE slot='beta') b USING (k) GROUP BY k""")
def _(spark, d):
    k = F.col("o_orderkey")
    c = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(k % 2 == 0, "alpha").otherwise("beta").alias("slot"), F.element_at(F.array(*map(F.lit, ("TRA", "TRB", "TRG", "TRD"))), (k % 4 + 1).cast("int")).alias("locus"), k.alias("chain_id"))
    return rules.receptor_type(c, "k")


@R.add("x08_segments_json", "presence", "SELECT traj_id, pair_id, len(list(frame)) n FROM presence GROUP BY ALL")
def _(spark, d):
    from strandlake.operators.persistence import pair_persistence
    from strandlake.session import materialize

    p = pair_persistence(ad.presence(spark, d)).withColumn("text", rules.segments_json(F.col("frame_segments")))
    # written: else the check below is pushed into the segments' own expressions, which are then found anew for every frame
    p = materialize(p.select("traj_id", "pair_id", "contact_frames", "n_segments", "text"), "segments")
    back = p.withColumn("seg", rules.parse_segments(F.col("text"))).where(F.size("seg") == F.col("n_segments"))
    return back.select("traj_id", "pair_id", F.col("contact_frames").alias("n"))


@R.add("s09_wide_features", "replicas", "SELECT complex_id, max(crossing) FILTER (WHERE run=1) run1, max(crossing) FILTER (WHERE run=2) run2, max(crossing) FILTER (WHERE run=3) run3 FROM replicas GROUP BY 1")
def _(spark, d):
    return reps(spark, d).groupBy("complex_id").pivot("run", [1, 2, 3]).agg(F.max("crossing")).select("complex_id", *(F.col(str(i)).alias(f"run{i}") for i in (1, 2, 3)))


@R.add("s10_long_features", "replicas", "SELECT complex_id, run, unnest(['label','grp','host']) feature, unnest([label, grp, host]) AS \"value\" FROM replicas")
def _(spark, d):
    long = reps(spark, d).unpivot(["complex_id", "run"], ["label", "grp", "host"], "feature", "value")
    return long.where("value IS NOT NULL AND value <> ''")


@R.add("x09_run_label", "replicas", "SELECT CAST(complex_id AS VARCHAR) || '_run' || CAST(run AS VARCHAR) traj_id, 'run' || CAST(run AS VARCHAR) run_label FROM replicas")
def _(spark, d):
    t = F.concat(F.col("complex_id").cast("string"), F.lit("_run"), F.col("run").cast("string"))
    return reps(spark, d).select(t.alias("traj_id")).withColumn("run_label", labels.run_label(F.col("traj_id")))


@R.add("a40_conservation", "", """WITH m AS (SELECT source, i pos, lower(substr(text, CAST(i AS BIGINT), 1)) aa FROM documents, (SELECT unnest(range(1, 13)) i)), c AS (SELECT source, pos, aa, count(*) c FROM m WHERE aa SIMILAR TO '[a-z]' GROUP BY ALL), t AS (SELECT source, count(*) n FROM documents GROUP BY 1),
h AS (SELECT source, pos, sum(c) k, -sum(p*ln(p)) h FROM (SELECT *, c / sum(c) OVER (PARTITION BY source, pos) p FROM c) GROUP BY ALL)
SELECT source, CAST(pos AS INTEGER) pos, CAST(k AS BIGINT) n_observed, CASE WHEN k >= 0.5*n THEN greatest(0.0, least(1.0, 1 - h/ln(20.0))) END conservation FROM h JOIN t USING (source)""", "conservation")
def _(spark, d):
    docs = ad.table(spark, d, "documents").select("source", "text")
    pos = docs.select("source", F.posexplode(F.split(F.substring("text", 1, 12), "")).alias("pos", "aa"))
    msa = pos.select("source", (F.col("pos") + 1).cast("int").alias("pos"), F.lower("aa").alias("aa")).withColumn("aa", F.when(F.col("aa").rlike("^[a-z]$"), F.col("aa")).otherwise("-"))
    return summaries.conservation(msa, docs.groupBy("source").agg(F.count("*").alias("n")), ("source", "pos"))


@R.add("a41_first_allele", "", "SELECT p_brand gene, min(p_partkey) p_partkey FROM part GROUP BY 1")
def _(spark, d):
    return summaries.top_k(ad.table(spark, d, "part").select(F.col("p_brand").alias("gene"), "p_partkey"), 1, ["p_partkey"], "gene").drop("rank")


@R.add("x03_imgt_region", "", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 26 THEN 'FR1' WHEN p_size BETWEEN 27 AND 38 THEN 'CDR1' WHEN p_size BETWEEN 39 AND 55 THEN 'FR2' ELSE 'unknown' END region FROM part WHERE p_size <= 55")
def _(spark, d):
    from strandlake.functions.numbering import imgt_region

    return ad.table(spark, d, "part").where("p_size <= 55").select("p_partkey", imgt_region(F.col("p_size")).alias("region"))


@R.add("j14_locate_loop", "", "WITH h AS (SELECT doc_id, strpos(text, 'the ') a FROM documents) SELECT doc_id, CAST(a + i AS BIGINT) resid FROM h, (SELECT unnest(range(0, 4)) i) WHERE a > 0 UNION ALL SELECT doc_id, NULL FROM h WHERE a = 0")
def _(spark, d):
    from strandlake.operators.annotate import locate

    docs = ad.table(spark, d, "documents")
    c = docs.select(F.col("doc_id").alias("chain_id"), F.col("text").alias("sequence"), F.expr("sequence(1L, cast(length(text) as bigint))").alias("resids"))
    loops = docs.select(F.col("doc_id").alias("chain_id"), F.lit("l").alias("loop"), F.lit("the ").alias("seq"))
    return locate(c, loops).select(F.col("chain_id").alias("doc_id"), "resid")
