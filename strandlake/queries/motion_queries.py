"""Geometry, flexibility, structure and dynamics queries over the points of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake import adapters as ad
from strandlake.operators import annotate, contacts, dynamics, geometry, series, summaries
from strandlake.queries.base import Registry

R = Registry()
points = ad.placed_atoms


def dense(spark, d):
    """Frames as 21 points of three doubles, straight from the arrays."""
    xyz = F.transform(F.slice("embedding", 1, 3 * ad.N_ATOMS), lambda x: F.lit(ad.SCALE) * x.cast("double"))
    return ad.frames(spark, d).select("traj_id", "frame", xyz.alias("xyz"))


def at(chain):
    return F.col("chain_id") == chain


@R.add("f01_atom_selection", "placed", "SELECT traj_id, frame, atom_id, chain_id, resid, name FROM placed WHERE chain_id IN ('A','C') AND name NOT LIKE 'H%'")
def _(spark, d):
    return annotate.select_atoms(points(spark, d), chains=["A", "C"], heavy_only=True).select("traj_id", "frame", "atom_id", "chain_id", "resid", "name")


@R.add("f02_atom_criteria", "placed", "SELECT traj_id, frame, atom_id FROM placed WHERE element = 'O' AND resname IN ('ASP','GLU') AND bfactor >= 15")
def _(spark, d):
    return annotate.select_atoms(points(spark, d), element="O", resnames=["ASP", "GLU"], min_bfactor=15.0).select("traj_id", "frame", "atom_id")


@R.add("f03_frame_stride", "frames", "SELECT traj_id, frame FROM frames WHERE frame % 5 = 0")
def _(spark, d):
    return ad.frames(spark, d).where("frame % 5 = 0").select("traj_id", "frame")


RMSF = "fl AS (SELECT traj_id, atom_id, chain_id, resid, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) rmsf FROM placed GROUP BY ALL)"


@R.add("m03_rmsf", "placed", "WITH " + RMSF + " SELECT traj_id, atom_id, rmsf FROM fl", "rmsf")
def _(spark, d):
    return geometry.rmsf(points(spark, d))


def flexible(spark, d):
    return geometry.rmsf(points(spark, d)).join(F.broadcast(ad.atoms(spark)), "atom_id")


@R.add("a19_rmsf_summary", "placed chains", "WITH " + RMSF + " SELECT traj_id, role component, count(*) n, avg(rmsf) AS mean, max(rmsf) AS \"max\", quantile_cont(rmsf, 0.5) median FROM fl JOIN chains USING (chain_id) GROUP BY ALL", "mean max median")
def _(spark, d):
    f = flexible(spark, d).join(F.broadcast(ad.chains(spark)), "chain_id")
    return summaries.describe(f, "rmsf", "traj_id", F.col("role").alias("component")).select("traj_id", "component", "n", "mean", "max", "median")


@R.add("a20_rmsf_by_chain", "placed", "WITH " + RMSF + " SELECT traj_id, chain_id, avg(rmsf) AS mean, stddev_pop(rmsf) AS std, min(rmsf) AS \"min\", max(rmsf) AS \"max\", quantile_cont(rmsf, 0.5) median, count(rmsf) n FROM fl GROUP BY ALL", "mean std min max median")
def _(spark, d):
    return summaries.describe(flexible(spark, d), "rmsf", "traj_id", "chain_id", std="pop")


@R.add("a21_backbone_sidechain", "placed", "WITH " + RMSF + ", r AS (SELECT traj_id, chain_id, resid, avg(rmsf) FILTER (WHERE a.name IN ('N','CA','C')) bb, avg(rmsf) FILTER (WHERE a.name NOT IN ('N','CA','C')) sc FROM fl JOIN atoms a USING (atom_id, chain_id, resid) GROUP BY ALL) SELECT *, sc/nullif(bb, 0) ratio FROM r", "bb sc ratio")
def _(spark, d):
    bb = F.col("name").isin("N", "CA", "C")
    g = flexible(spark, d).groupBy("traj_id", "chain_id", "resid").agg(F.avg(F.when(bb, F.col("rmsf"))).alias("bb"), F.avg(F.when(~bb, F.col("rmsf"))).alias("sc"))
    return g.withColumn("ratio", F.try_divide("sc", "bb"))


@R.add("a17_rmsf_profile", "placed regions", "WITH " + RMSF + " SELECT traj_id, coalesce(region, chain_id) region, avg(rmsf) AS mean, max(rmsf) AS \"max\", count(*) n FROM fl LEFT JOIN regions g ON fl.chain_id = g.chain_id AND resid BETWEEN resid_start AND resid_end GROUP BY traj_id, coalesce(region, fl.chain_id)".replace("coalesce(region, chain_id) region", "coalesce(region, fl.chain_id) region"), "mean max")
def _(spark, d):
    g = ad.regions(spark).withColumnRenamed("chain_id", "_c")
    f = flexible(spark, d).join(F.broadcast(g), (F.col("chain_id") == F.col("_c")) & F.col("resid").between(F.col("resid_start"), F.col("resid_end")), "left")
    return f.groupBy("traj_id", F.coalesce("region", "chain_id").alias("region")).agg(F.avg("rmsf").alias("mean"), F.max("rmsf").alias("max"), F.count("*").alias("n"))


@R.add("m04_com_distance", "placed", "WITH c AS (SELECT traj_id, frame, avg(x) FILTER (WHERE chain_id='C') px, avg(y) FILTER (WHERE chain_id='C') py, avg(z) FILTER (WHERE chain_id='C') pz, avg(x) FILTER (WHERE chain_id='D') qx, avg(y) FILTER (WHERE chain_id='D') qy, avg(z) FILTER (WHERE chain_id='D') qz FROM placed GROUP BY ALL) SELECT traj_id, frame, sqrt((px-qx)*(px-qx)+(py-qy)*(py-qy)+(pz-qz)*(pz-qz)) distance FROM c", "distance")
def com(spark, d):
    return geometry.com_distance(points(spark, d), at("C"), at("D"))


@R.add("m05_radius_of_gyration", "placed", "SELECT traj_id, frame, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) rg FROM placed GROUP BY ALL", "rg")
def gyration(spark, d):
    return geometry.radius_of_gyration(points(spark, d))


@R.add("w16_rg_variation", "placed", "WITH r AS (SELECT traj_id, frame, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) rg FROM placed GROUP BY ALL) SELECT traj_id, stddev_pop(rg)/avg(rg) variation, max(rg)-min(rg) AS \"range\" FROM r GROUP BY 1", "variation range")
def _(spark, d):
    return gyration(spark, d).groupBy("traj_id").agg((F.stddev_pop("rg") / F.avg("rg")).alias("variation"), (F.max("rg") - F.min("rg")).alias("range"))


@R.add("w15_centre_drift", "placed", "WITH c AS (SELECT traj_id, frame, avg(x) x, avg(y) y, avg(z) z FROM placed GROUP BY ALL), m AS (SELECT traj_id, avg(x) mx, avg(y) my, avg(z) mz FROM c GROUP BY 1) SELECT traj_id, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) max_drift FROM c JOIN m USING (traj_id) GROUP BY 1", "max_drift")
def _(spark, d):
    return geometry.centre_drift(points(spark, d))


@R.add("w17_integrity", "frames", "SELECT traj_id, count(*) n_frames, count(*) FILTER (WHERE len(embedding) = 0) n_empty, count(*) = 50 AND count(*) FILTER (WHERE len(embedding) = 0) = 0 AS complete FROM frames GROUP BY 1")
def _(spark, d):
    return geometry.frame_integrity(dense(spark, d), 50)


@R.add("a30_basic_geometry", "placed", "SELECT traj_id, frame, avg(x) com_x, avg(y) com_y, avg(z) com_z, (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) box_volume, 21*(var_pop(y)+var_pop(z)) ixx, 21*(var_pop(x)+var_pop(z)) iyy, 21*(var_pop(x)+var_pop(y)) izz, -21*covar_pop(x,y) ixy, -21*covar_pop(x,z) ixz, -21*covar_pop(y,z) iyz FROM placed GROUP BY ALL", "com_x com_y com_z box_volume ixx iyy izz ixy ixz iyz")
def _(spark, d):
    return geometry.basic_geometry(points(spark, d))


@R.add("a31_consecutive_geometry", "placed", """WITH v AS (SELECT traj_id, frame, atom_id, lead(x) OVER w - x dx, lead(y) OVER w - y dy, lead(z) OVER w - z dz FROM placed WINDOW w AS (PARTITION BY traj_id, frame ORDER BY atom_id)),
u AS (SELECT *, lead(dx) OVER w ex, lead(dy) OVER w ey, lead(dz) OVER w ez FROM v WINDOW w AS (PARTITION BY traj_id, frame ORDER BY atom_id)),
q AS (SELECT traj_id, frame, sqrt(dx*dx+dy*dy+dz*dz) len, degrees(acos(greatest(-1.0, least(1.0, -(dx*ex+dy*ey+dz*ez)/sqrt((dx*dx+dy*dy+dz*dz)*(ex*ex+ey*ey+ez*ez)))))) ang FROM u)
SELECT traj_id, frame, avg(len) len_mean, stddev_pop(len) len_std, min(len) len_min, max(len) len_max, avg(ang) ang_mean, stddev_pop(ang) ang_std, min(ang) ang_min, max(ang) ang_max FROM q GROUP BY ALL""", "len_mean len_std len_min len_max ang_mean ang_std ang_min ang_max")
def _(spark, d):
    return geometry.consecutive_geometry(points(spark, d))


TORSION = """t AS (SELECT traj_id, frame, any_value(x) FILTER (WHERE atom_id=0) x0, any_value(y) FILTER (WHERE atom_id=0) y0, any_value(z) FILTER (WHERE atom_id=0) z0, any_value(x) FILTER (WHERE atom_id=3) x1, any_value(y) FILTER (WHERE atom_id=3) y1, any_value(z) FILTER (WHERE atom_id=3) z1,
 any_value(x) FILTER (WHERE atom_id=6) x2, any_value(y) FILTER (WHERE atom_id=6) y2, any_value(z) FILTER (WHERE atom_id=6) z2, any_value(x) FILTER (WHERE atom_id=9) x3, any_value(y) FILTER (WHERE atom_id=9) y3, any_value(z) FILTER (WHERE atom_id=9) z3 FROM frame_atoms GROUP BY ALL),
b AS (SELECT traj_id, frame, x1-x0 ax, y1-y0 ay, z1-z0 az, x2-x1 bx, y2-y1 byy, z2-z1 bz, x3-x2 cx, y3-y2 cy, z3-z2 cz FROM t),
n AS (SELECT *, ay*bz-az*byy px, az*bx-ax*bz py, ax*byy-ay*bx pz, byy*cz-bz*cy qx, bz*cx-bx*cz qy, bx*cy-byy*cx qz FROM b)
SELECT traj_id, frame, 'chi' AS "name", degrees(atan2(((py*qz-pz*qy)*bx+(pz*qx-px*qz)*byy+(px*qy-py*qx)*bz)/sqrt(bx*bx+byy*byy+bz*bz), px*qx+py*qy+pz*qz)) "degrees" FROM n"""


def torsions(spark, d):
    q = spark.createDataFrame([("chi", 0, 3, 6, 9)], "name string, a int, b int, c int, d int")
    return geometry.dihedrals(ad.frame_atoms(spark, d), q)


@R.add("m14_dihedrals", "frame_atoms", "WITH " + TORSION, "degrees")
def _(spark, d):
    return torsions(spark, d)


@R.add("a22_rotamer_entropy", "frame_atoms", "WITH tt AS (WITH " + TORSION + """), b AS (SELECT traj_id, floor(((round("degrees",9) % 360 + 360) % 360)/60) b, count(*) n FROM tt GROUP BY ALL), p AS (SELECT *, n/sum(n) OVER (PARTITION BY traj_id) p FROM b)
SELECT traj_id, -sum(p*log2(p)) entropy_bits, count(*) FILTER (WHERE p >= 0.05) n_populated FROM p GROUP BY 1""", "entropy_bits")
def _(spark, d):
    return summaries.rotamer_entropy(torsions(spark, d).withColumn("degrees", F.round("degrees", 9)), ("traj_id",), "degrees")


@R.add("x04_rotamer_labels", "frame_atoms", "WITH tt AS (WITH " + TORSION + """) SELECT traj_id, CASE WHEN "degrees" >= 0 AND "degrees" < 120 THEN 'g+' WHEN "degrees" >= -120 AND "degrees" < 0 THEN 'g-' ELSE 't' END label, count(*) n FROM tt GROUP BY ALL""")
def _(spark, d):
    from strandlake.functions.labels import rotamer_label

    return torsions(spark, d).groupBy("traj_id", rotamer_label(F.col("degrees")).alias("label")).agg(F.count("*").alias("n"))


@R.add("x07_axial_angle", "placed", """WITH g AS (SELECT traj_id, frame, sum(CASE atom_id WHEN 6 THEN x WHEN 0 THEN -x END) ax, sum(CASE atom_id WHEN 6 THEN y WHEN 0 THEN -y END) ay, sum(CASE atom_id WHEN 6 THEN z WHEN 0 THEN -z END) az, sum(CASE atom_id WHEN 20 THEN x WHEN 14 THEN -x END) bx, sum(CASE atom_id WHEN 20 THEN y WHEN 14 THEN -y END) byy, sum(CASE atom_id WHEN 20 THEN z WHEN 14 THEN -z END) bz FROM placed GROUP BY ALL)
SELECT traj_id, frame, degrees(acos(least(1.0, abs((ax*bx+ay*byy+az*bz)/sqrt((ax*ax+ay*ay+az*az)*(bx*bx+byy*byy+bz*bz)))))) "degrees" FROM g""", "degrees")
def _(spark, d):
    return geometry.axial_angle(ad.frame_atoms(spark, d), (0, 6), (14, 20))


@R.add("m37_loop_geometry", "placed", """WITH c AS (SELECT traj_id, frame, avg(x) FILTER (WHERE chain_id='C') px, avg(y) FILTER (WHERE chain_id='C') py, avg(z) FILTER (WHERE chain_id='C') pz, sum(CASE atom_id WHEN 16 THEN x WHEN 13 THEN -x END) dx, sum(CASE atom_id WHEN 16 THEN y WHEN 13 THEN -y END) dy, sum(CASE atom_id WHEN 16 THEN z WHEN 13 THEN -z END) dz,
 any_value(x) FILTER (WHERE atom_id=15) tx, any_value(y) FILTER (WHERE atom_id=15) ty, any_value(z) FILTER (WHERE atom_id=15) tz FROM placed GROUP BY ALL) SELECT traj_id, frame, sqrt(dx*dx+dy*dy+dz*dz) span, sqrt((tx-px)*(tx-px)+(ty-py)*(ty-py)+(tz-pz)*(tz-pz)) tip_distance FROM c""", "span tip_distance")
def _(spark, d):
    return geometry.loop_geometry(points(spark, d), at("D"), at("C"))


@R.add("j13_distance_trim", "placed", """WITH r AS (SELECT traj_id, frame, chain_id, resid, avg(x) x, avg(y) y, avg(z) z FROM placed GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, frame ORDER BY chain_id, resid) - 1 i, count(*) OVER (PARTITION BY traj_id, frame) n FROM r WHERE chain_id='C') WHERE i = n // 2)
SELECT r.traj_id, r.frame, r.chain_id, r.resid, sqrt((r.x-m.x)*(r.x-m.x)+(r.y-m.y)*(r.y-m.y)+(r.z-m.z)*(r.z-m.z)) distance, sqrt((r.x-m.x)*(r.x-m.x)+(r.y-m.y)*(r.y-m.y)+(r.z-m.z)*(r.z-m.z)) <= 6.0 kept FROM r JOIN m ON r.traj_id=m.traj_id AND r.frame=m.frame""", "distance")
def _(spark, d):
    return geometry.distance_trim(points(spark, d), at("C"), 6.0)


@R.add("m08_cross_correlation", "placed", """WITH c AS (SELECT p.traj_id, p.atom_id AS i, q.atom_id AS j, covar_pop(p.x,q.x)+covar_pop(p.y,q.y)+covar_pop(p.z,q.z) cov FROM placed p JOIN placed q ON p.traj_id=q.traj_id AND p.frame=q.frame AND p.atom_id <= q.atom_id GROUP BY ALL)
SELECT c.traj_id, c.i, c.j, c.cov, greatest(-1.0, least(1.0, c.cov/sqrt(a.cov*b.cov))) v FROM c JOIN c a ON a.traj_id=c.traj_id AND a.i=c.i AND a.j=c.i JOIN c b ON b.traj_id=c.traj_id AND b.i=c.j AND b.j=c.j""", "cov v")
def correlation(spark, d):
    return dynamics.cross_correlation(dense(spark, d))


@R.add("m08_block_coupling", "placed chains", """WITH c AS (SELECT p.traj_id, p.atom_id AS i, q.atom_id AS j, covar_pop(p.x,q.x)+covar_pop(p.y,q.y)+covar_pop(p.z,q.z) cov FROM placed p JOIN placed q ON p.traj_id=q.traj_id AND p.frame=q.frame AND p.atom_id <= q.atom_id GROUP BY ALL),
v AS (SELECT c.traj_id, c.i, c.j, greatest(-1.0, least(1.0, c.cov/sqrt(a.cov*b.cov))) v FROM c JOIN c a ON a.traj_id=c.traj_id AND a.i=c.i AND a.j=c.i JOIN c b ON b.traj_id=c.traj_id AND b.i=c.j AND b.j=c.j WHERE c.i < c.j)
SELECT traj_id, least(x.role, y.role) block_1, greatest(x.role, y.role) block_2, avg(abs(v)) coupling, count(*) n_pairs FROM v JOIN (SELECT atom_id, role FROM atoms JOIN chains USING (chain_id)) x ON x.atom_id = v.i JOIN (SELECT atom_id, role FROM atoms JOIN chains USING (chain_id)) y ON y.atom_id = v.j GROUP BY ALL""", "coupling")
def _(spark, d):
    blocks = ad.atoms(spark).join(ad.chains(spark), "chain_id").select("atom_id", F.col("role").alias("block"))
    return dynamics.block_coupling(correlation(spark, d), blocks)


@R.add("c18_persistent_network", "placed", """WITH c AS (SELECT p.traj_id, p.atom_id AS i, q.atom_id AS j, covar_pop(p.x,q.x)+covar_pop(p.y,q.y)+covar_pop(p.z,q.z) cov, avg(CASE WHEN sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) <= 10.0 THEN 1.0 ELSE 0.0 END) occ FROM placed p JOIN placed q ON p.traj_id=q.traj_id AND p.frame=q.frame AND p.atom_id <= q.atom_id GROUP BY ALL),
v AS (SELECT c.traj_id, c.i, c.j, c.occ, abs(greatest(-1.0, least(1.0, c.cov/sqrt(a.cov*b.cov)))) w FROM c JOIN c a ON a.traj_id=c.traj_id AND a.i=c.i AND a.j=c.i JOIN c b ON b.traj_id=c.traj_id AND b.i=c.j AND b.j=c.j WHERE c.i < c.j)
SELECT traj_id, i, j, occ occupancy, w weight, -ln(w) "length" FROM v WHERE occ >= 0.75 AND w >= 1e-6""", "occupancy weight length")
def _(spark, d):
    return contacts.persistent_network(ad.frame_atoms(spark, d), correlation(spark, d).select("traj_id", "i", "j", "v"))


@R.add("a28_bfactor_by_residue", "placed", "WITH b AS (SELECT traj_id, chain_id, resid, x*x + y*y + z*z b FROM placed) SELECT traj_id, chain_id, resid, avg(b) AS mean, stddev_samp(b) AS std, min(b) AS \"min\", max(b) AS \"max\", quantile_cont(b, 0.5) median, count(b) n FROM b GROUP BY ALL", "mean std min max median")
def _(spark, d):
    """The squared distance to the origin stands for the factor: the views' own is a constant of the topology."""
    p = points(spark, d).withColumn("b", F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return summaries.describe(p, "b", "traj_id", "chain_id", "resid")


@R.add("a28_high_bfactor", "placed", "SELECT traj_id, frame, atom_id, x FROM placed WHERE x > (SELECT quantile_cont(x, 0.9) FROM placed)", "x")
def _(spark, d):
    return summaries.above_percentile(points(spark, d).select("traj_id", "frame", "atom_id", "x"), "x")


@R.add("a29_structure_summary", "placed", "SELECT traj_id, frame, element, count(*) n, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z FROM placed GROUP BY ALL", "min_x max_x min_y max_y min_z max_z")
def _(spark, d):
    return points(spark, d).groupBy("traj_id", "frame", "element").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


@R.add("a29_residue_centres", "placed", "SELECT traj_id, frame, chain_id, resid, count(*) n, avg(x) x, avg(y) y, avg(z) z FROM placed GROUP BY ALL", "x y z")
def _(spark, d):
    return points(spark, d).groupBy("traj_id", "frame", "chain_id", "resid").agg(F.count("*").alias("n"), *((F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in "xyz"))


@R.add("a25_buried_area", "frames", "WITH a AS (SELECT traj_id, frame, 100+10*CAST(embedding[1] AS DOUBLE) a, 80+10*CAST(embedding[2] AS DOUBLE) b, 150+10*CAST(embedding[3] AS DOUBLE) ab FROM frames) SELECT traj_id, avg((a+b-ab)/2) AS mean, stddev_pop((a+b-ab)/2) AS std, min((a+b-ab)/2) AS \"min\", max((a+b-ab)/2) AS \"max\", avg(coalesce((a+b-ab)/nullif(a+b,0),0)) ratio FROM a GROUP BY 1", "mean std min max ratio")
def _(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    a = ad.frames(spark, d).select("traj_id", (100 + 10 * e(0)).alias("sasa_a"), (80 + 10 * e(1)).alias("sasa_b"), (150 + 10 * e(2)).alias("sasa_ab"))
    b = summaries.buried_area(a)
    return b.groupBy("traj_id").agg(F.avg("bsa").alias("mean"), F.stddev_pop("bsa").alias("std"), F.min("bsa").alias("min"), F.max("bsa").alias("max"), F.avg("interface_ratio").alias("ratio"))


@R.add("a24_residue_sasa", "placed", """WITH s AS (SELECT traj_id, chain_id, resid, avg(abs(x)) bound, avg(abs(x)+abs(y)) unbound FROM placed GROUP BY ALL), e AS (SELECT *, unbound-bound delta, bound/nullif(unbound,0) rel FROM s)
SELECT traj_id, chain_id, resid, bound, unbound, delta, rel relative_exposure, CASE WHEN unbound < 3 THEN 'core' WHEN delta < 1.5 THEN 'exposed' WHEN rel < 0.5 THEN 'interface_core' ELSE 'interface_rim' END burial FROM e""", "bound unbound delta relative_exposure")
def _(spark, d):
    from strandlake.functions.labels import burial_state

    s = points(spark, d).groupBy("traj_id", "chain_id", "resid").agg(F.avg(F.abs("x")).alias("bound"), F.avg(F.abs("x") + F.abs("y")).alias("unbound"))
    s = s.withColumns({"delta": F.col("unbound") - F.col("bound"), "relative_exposure": F.try_divide("bound", "unbound")})
    return s.withColumn("burial", burial_state(F.col("delta"), F.col("relative_exposure"), F.col("unbound"), 3.0, 1.5, 0.5))


@R.add("a26_bsa_split", "placed chains", "WITH r AS (SELECT traj_id, chain_id, resid, avg(abs(x)+y) iso, avg(abs(x)) com FROM placed GROUP BY ALL) SELECT traj_id, role component, sum(greatest(0.0, iso-com)) bsa FROM r JOIN chains USING (chain_id) GROUP BY ALL HAVING sum(greatest(0.0, iso-com)) > 0.5", "bsa")
def _(spark, d):
    r = points(spark, d).groupBy("traj_id", "chain_id", "resid").agg(F.avg(F.abs("x") + F.col("y")).alias("iso"), F.avg(F.abs("x")).alias("com"))
    s = r.join(F.broadcast(ad.chains(spark)), "chain_id").groupBy("traj_id", F.col("role").alias("component")).agg(F.sum(F.greatest(F.lit(0.0), F.col("iso") - F.col("com"))).alias("bsa"))
    return s.where("bsa > 0.5")


@R.add("a27_bsa_reconciliation", "frames", "WITH a AS (SELECT traj_id, avg(100+10*CAST(embedding[1] AS DOUBLE)) h, avg(100+12*CAST(embedding[2] AS DOUBLE)) o, avg(50+9*CAST(embedding[3] AS DOUBLE)) s FROM frames GROUP BY 1) SELECT traj_id, 100*abs(h-o)/greatest(o, 1e-6) gap_pct, 100*abs(2*s-h)/greatest(h, 1e-6) asymmetry_pct, 100*abs(h-o)/greatest(o, 1e-6) <= 20 AND 100*abs(2*s-h)/greatest(h, 1e-6) <= 12 consistent FROM a", "gap_pct asymmetry_pct")
def _(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    a = ad.frames(spark, d).groupBy("traj_id").agg(F.avg(100 + 10 * e(0)).alias("half"), F.avg(100 + 12 * e(1)).alias("other"), F.avg(50 + 9 * e(2)).alias("side"))
    return summaries.reconcile_area(a, "half", "other", "side").select("traj_id", "gap_pct", "asymmetry_pct", "consistent")


@R.add("a23_secondary_structure", "frames", """WITH c AS (SELECT traj_id, frame % 10 resid, ['H','G','E','B','T','S','-'][CAST(floor(abs(CAST(embedding[1] AS DOUBLE))*20) AS BIGINT) % 7 + 1] code FROM frames), s AS (SELECT traj_id, resid, avg(CASE WHEN code IN ('H','G','I') THEN 1.0 ELSE 0.0 END) helix, avg(CASE WHEN code IN ('E','B') THEN 1.0 ELSE 0.0 END) sheet, avg(CASE WHEN code IN ('T','S','-') THEN 1.0 ELSE 0.0 END) AS loop FROM c GROUP BY ALL)
SELECT *, CASE WHEN round(helix,9) >= round(greatest(sheet, loop),9) THEN 'helix' WHEN round(sheet,9) >= round(loop,9) THEN 'sheet' ELSE 'loop' END dominant, greatest(helix, sheet, loop) "stability" FROM s""", "helix sheet loop stability")
def _(spark, d):
    code = F.element_at(F.array(*map(F.lit, "HGEBTS-")), (F.floor(F.abs(F.col("embedding")[0].cast("double")) * 20) % 7 + 1).cast("int"))
    return summaries.secondary_structure(ad.frames(spark, d).select("traj_id", (F.col("frame") % 10).alias("resid"), code.alias("code")))


@R.add("w18_angle_summary", "frames", "WITH a AS (SELECT traj_id, 90*abs(CAST(embedding[1] AS DOUBLE)) ang, sign(CAST(embedding[2] AS DOUBLE)) pol FROM frames) SELECT traj_id, avg(ang) AS mean, stddev_pop(ang) AS std, min(ang) AS \"min\", max(ang) AS \"max\", avg(CASE WHEN pol < 0 THEN 180-ang ELSE ang END) directed_mean, avg(CASE WHEN pol < 0 THEN 1.0 WHEN pol > 0 THEN 0.0 END) reversed_fraction FROM a GROUP BY 1", "mean std min max directed_mean reversed_fraction")
def _(spark, d):
    a = ad.frames(spark, d).select("traj_id", (90 * F.abs(F.col("embedding")[0].cast("double"))).alias("ang"), F.signum(F.col("embedding")[1].cast("double")).alias("pol"))
    return series.angle_summary(a, "ang", "pol")


@R.add("m01_rmsd")
def _(spark, d):
    return geometry.rmsd_series(dense(spark, d))


@R.add("m02_region_rmsd")
def _(spark, d):
    return geometry.region_rmsd(dense(spark, d), list(range(0, 9)), {"peptide": [9, 10, 11, 12], "tcr": list(range(13, 21))})


@R.add("m06_docking_angles")
def _(spark, d):
    return geometry.docking(dense(spark, d), list(range(0, 7)), list(range(13, 17)), list(range(17, 21)), [9, 10, 11, 12])


@R.add("m09_collective_modes")
def _(spark, d):
    return dynamics.collective_modes(dense(spark, d))


def modes(spark, d):
    return dynamics.essential_dynamics(dense(spark, d))


@R.add("m12_essential_dynamics")
def _(spark, d):
    return modes(spark, d).drop("modes")


@R.add("m13_subspace_overlap")
def _(spark, d):
    m = modes(spark, d).withColumn("complex_id", (F.col("traj_id").cast("int") % 3).cast("string"))
    return dynamics.subspace_overlap(m, "complex_id")


@R.add("m32_ensemble_medoid")
def _(spark, d):
    f = dense(spark, d).withColumn("complex_id", (F.col("traj_id").cast("int") % 3).cast("string"))
    return dynamics.ensemble_medoids(f, "complex_id")


@R.add("m29_frame_clusters")
def _(spark, d):
    e = F.col("embedding")
    f = ad.frames(spark, d).select("traj_id", "frame", F.slice(e, 1, 6).cast("array<double>").alias("geometry"), F.slice(e, 7, 6).cast("array<double>").alias("sidechain"), F.slice(e, 13, 6).cast("array<double>").alias("interaction"))
    return dynamics.frame_clusters(f)
