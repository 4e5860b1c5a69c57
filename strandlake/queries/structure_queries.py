"""Structures, trends and the library as a whole: burial, validation, convergence, groove frames, views, balanced components, basins, typing, records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandlake import adapters as ad
from strandlake.operators import contacts, geometry, library, series, summaries
from strandlake.operators.landscape import kde_basins
from strandlake.queries.base import Registry
from strandlake.queries.motion_queries import dense
from strandlake.queries.series_queries import BLOCKS, NUM, cvs
from strandlake.session import shared_dir
from strandlake.sources import tables

R = Registry()

BURIAL = """WITH p AS (SELECT traj_id, frame, atom_id, x, y, z, CASE element WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 WHEN 'H' THEN 1.2 ELSE 1.5 END + 1.4 r FROM placed),
t AS (SELECT traj_id, frame, count(*) n_atoms, 4*pi()*sum(r*r) total_area FROM p GROUP BY ALL),
d AS (SELECT a.traj_id, a.frame, a.r ra, b.r rb, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) d FROM p a JOIN p b ON a.traj_id=b.traj_id AND a.frame=b.frame AND a.atom_id < b.atom_id),
s AS (SELECT traj_id, frame, sum(4*pi()*least(ra,rb)*least(ra,rb)*(ra+rb-d)/(ra+rb)) buried FROM d WHERE d < ra+rb GROUP BY ALL)
SELECT t.traj_id, t.frame, n_atoms, total_area, coalesce(buried, 0.0) buried_area, greatest(0.0, total_area - coalesce(buried, 0.0)) accessible_area, coalesce(buried, 0.0)/total_area burial_fraction FROM t LEFT JOIN s USING (traj_id, frame)"""


@R.add("a32_sphere_burial", "placed", BURIAL, "total_area buried_area accessible_area burial_fraction")
def _(spark, d):
    return contacts.sphere_burial(ad.placed_atoms(spark, d))


# The standard amino acids' names.
STANDARD = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
SPAN, MISSING = 18.0, 0.7
VALID = f"""WITH f AS (SELECT traj_id, frame, count(DISTINCT chain_id) n_chains, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) span, count(DISTINCT resname) FILTER (WHERE resname IN {STANDARD})/20.0 c FROM placed GROUP BY ALL),
i AS (SELECT *, list_filter([CASE WHEN n_chains <> 5 THEN 'unusual_chain_count' END, CASE WHEN span > {SPAN} THEN 'unreasonable_coordinates' END, CASE WHEN c < {1 - MISSING} THEN 'significant_missing_residues' END], lambda x: x IS NOT NULL) issues FROM f),
va AS (SELECT traj_id, frame, n_chains, array_to_string(issues, ';') issues, CASE len(issues) WHEN 0 THEN 'valid' WHEN 1 THEN 'acceptable' ELSE 'problematic' END status, least(100.0, CASE WHEN n_chains = 5 THEN 30.0 ELSE 15.0 END + CASE WHEN span <= {SPAN} THEN 25.0 ELSE 0.0 END + 25.0 + 20*c) score FROM i)"""


def validated(spark, d):
    p = ad.placed_atoms(spark, d)
    span = F.greatest(*(F.max(a) - F.min(a) for a in "xyz"))
    f = p.groupBy("traj_id", "frame").agg(
        F.countDistinct("chain_id").alias("n_chains"),
        (span <= SPAN).alias("coordinates_ok"),
        (F.count("resname") > 0).alias("has_protein"),
        (F.countDistinct(F.when(F.col("resname").isin(*STANDARD), F.col("resname"))) / len(STANDARD)).alias("completeness"),
    )
    v = summaries.validation(f.withColumn("chains_normal", F.col("n_chains") == 5), MISSING)
    return v.select("traj_id", "frame", "n_chains", F.array_join("issues", ";").alias("issues"), "status", "score")


@R.add("a33_structure_validation", "placed", VALID + " SELECT * FROM va", "score")
def _(spark, d):
    return validated(spark, d)


@R.add("a33_validation_summary", "placed", VALID + """ SELECT traj_id, count(*) total, count(*) FILTER (WHERE status='valid') valid, count(*) FILTER (WHERE status='acceptable') acceptable, count(*) FILTER (WHERE status='problematic') problematic,
 100.0*count(*) FILTER (WHERE status IN ('valid','acceptable'))/count(*) validation_rate, avg(score) average_score, avg(n_chains) mean_chains, count(*) FILTER (WHERE contains(issues, 'unreasonable_coordinates')) n_unreasonable FROM va GROUP BY 1""", "validation_rate average_score mean_chains")
def _(spark, d):
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return validated(spark, d).groupBy("traj_id").agg(
        F.count("*").alias("total"), n("valid"), n("acceptable"), n("problematic"),
        (100.0 * F.count_if(F.col("status").isin("valid", "acceptable")) / F.count("*")).alias("validation_rate"),
        F.avg("score").alias("average_score"), F.avg("n_chains").alias("mean_chains"), F.count_if(F.contains("issues", F.lit("unreasonable_coordinates"))).alias("n_unreasonable"),
    )


# two-sided p of Student's t with one to three degrees of freedom has closed forms
TREND = "WITH " + BLOCKS + """, g AS (SELECT traj_id, count(*) n_blocks, arg_max(mean, block) l, list(mean ORDER BY block)[-2] b, arg_min(mean, block) f, regr_slope(mean, block) slope, corr(mean, block) r FROM bl GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT *, n_blocks - 2 df, CASE WHEN n_blocks > 2 AND abs(r) <= 1 - 1e-12 THEN abs(r)*sqrt((n_blocks-2)/(1-r*r)) END t FROM g),
p AS (SELECT *, CASE WHEN df > 0 AND abs(r) > 1 - 1e-12 THEN 0.0 WHEN df = 1 THEN 1 - 2*atan(t)/pi() WHEN df = 2 THEN 1 - t/sqrt(2 + t*t) WHEN df = 3 THEN 1 - 2/pi()*(atan(t/sqrt(3)) + (t/sqrt(3))/(1 + t*t/3)) END p FROM t),
q AS (SELECT traj_id, n_blocks, 100*abs(b-l)/abs(l) last_two_pct, 100*abs(l-f)/abs(f) first_last_pct, slope, r*r r_squared, p p_value, coalesce(r*r > 0.49 AND p < 0.05, false) has_trend FROM p)
SELECT *, last_two_pct < 40 AND first_last_pct < 60 AND NOT has_trend is_converged FROM q"""


@R.add("w08_energy_trend", "series", TREND, "last_two_pct first_last_pct slope r_squared p_value")
def _(spark, d):
    return series.energy_trend(series.block_means(ad.series(spark, d)), 0.4, 0.6)


CONVERGED = "WITH " + NUM + """, w AS (SELECT *, greatest(8, n // 20) w, greatest(8, n // 10) h FROM num WHERE n >= 8),
sd AS (SELECT a.traj_id, a.i, a.n, a.w, a.h, stddev_pop(b.value) s FROM w a JOIN w b ON a.traj_id = b.traj_id AND b.i >= a.i - a.w AND b.i < a.i + a.w GROUP BY ALL),
bd AS (SELECT *, s > 1.2*avg(s) FILTER (WHERE i >= floor(n*0.8)) OVER (PARTITION BY traj_id) bad FROM sd),
nb AS (SELECT *, min(CASE WHEN bad THEN i END) OVER (PARTITION BY traj_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nx FROM bd),
f AS (SELECT traj_id, any_value(n) n, min(i) FILTER (WHERE (nx IS NULL OR nx >= i + h) AND i >= w AND i < n - w) k FROM nb GROUP BY 1)
SELECT traj_id, coalesce(CAST(k AS DOUBLE), n*0.2)*2.0 AS "time" FROM (SELECT DISTINCT traj_id FROM series) LEFT JOIN f USING (traj_id)"""


@R.add("w11_convergence_time", "series", CONVERGED, "time")
def _(spark, d):
    return series.convergence_time(ad.series(spark, d), 8)


@R.add("m07_reference_docking")
def _(spark, d):
    return geometry.reference_docking(dense(spark, d), [0, 1, 2, 3], [4, 5, 6], list(range(7)), list(range(13, 21)))


@R.add("m38_view_axes")
def _(spark, d):
    return geometry.view_axes(dense(spark, d), [list(range(0, 7)), [7, 8], [9, 10, 11, 12], [13, 14, 15, 16], [17, 18, 19, 20]])


@R.add("m15_balanced_components")
def _(spark, d):
    e = F.col("embedding")
    turn = lambda i: [f(3.0 * e[i].cast("double")) for f in (F.cos, F.sin)]
    vector = F.array(*turn(0), *turn(1), *turn(2), *turn(3), *(F.abs(e[i].cast("double")) for i in range(4, 9)))
    return library.balanced_components(ad.frames(spark, d).select("traj_id", "frame", vector.alias("vector")), {"backbone": 4, "side chains": 4, "distances": 5})


@R.add("m33_basin_distances")
def _(spark, d):
    b = kde_basins(cvs(spark, d), "cv1", "cv2", most=4).where("frame IS NOT NULL")
    b = b.join(dense(spark, d), ["traj_id", "frame"])
    return library.basin_distances(b.select((F.col("traj_id").cast("int") % 3).cast("string").alias("complex_id"), F.col("traj_id").alias("run"), "basin", "population", "xyz"), "complex_id")


GEOMETRY, DYNAMICS = ["mean_price", "spread", "least_price", "top_price"], ["n_orders", "n_open", "n_urgent", "balance"]


def complexes(spark, d):
    """A row of features for each customer with orders; some are null where there is but one."""
    o = ad.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("complex_id")).agg(
        F.avg("o_totalprice").alias("mean_price"),
        F.stddev_samp("o_totalprice").alias("spread"),
        F.min("o_totalprice").alias("least_price"),
        F.max("o_totalprice").alias("top_price"),
        F.count("*").alias("n_orders"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_urgent"),
    )
    c = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("complex_id"), F.col("c_acctbal").alias("balance"))
    return o.join(c, "complex_id")


@R.add("m34_library_map")
def _(spark, d):
    return library.library_map(complexes(spark, d), "complex_id", {"geometry": GEOMETRY, "dynamics": DYNAMICS})[0]


@R.add("m34_map_loadings")
def _(spark, d):
    return library.library_map(complexes(spark, d), "complex_id", {"geometry": GEOMETRY, "dynamics": DYNAMICS})[1]


@R.add("j15_best_matches")
def _(spark, d):
    """Part names as queries, brands and types as the reference library."""
    p = ad.table(spark, d, "part")
    letters = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    queries = p.select(F.col("p_partkey").alias("query_id"), letters(F.concat("p_name", "p_type")).alias("sequence"))
    references = p.select(letters(F.concat("p_type", F.col("p_name"))).alias("sequence"), "p_type", "p_name").distinct()
    references = references.select(F.concat_ws("*", "p_type", "p_name").alias("allele"), F.col("p_type").alias("locus"), "sequence")
    return library.best_matches(queries, references)


@R.add("s02_json_records", "", "SELECT CAST(s_suppkey AS VARCHAR) traj_id, s_suppkey AS \"id\", s_name AS \"name\", s_acctbal balance, s_nationkey nation FROM supplier", "balance")
def _(spark, d):
    """A record file for each supplier, written first: as many files as records is this format's nature."""
    meta = F.struct(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")).alias("meta")
    record = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), meta))
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    tables.write_records(ad.table(spark, d, "supplier").select(F.concat(F.lit("traj_"), F.col("s_suppkey").cast("string")).alias("dir"), record.alias("value")), path)
    found = tables.read_records(spark, path, "id bigint, name string, meta struct<balance:double,nation:bigint>", "dir=traj_([^/]+)/[^/]+$")
    return found.select("traj_id", "id", "name", "meta.balance", "meta.nation")
