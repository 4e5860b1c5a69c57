"""Contacts, typed interactions, persistence and their summaries over the points of ``embeddings`` and the presence of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake import adapters as ad
from strandlake.operators import annotate, contacts, persistence, summaries
from strandlake.queries.base import Registry

R = Registry()

# least heavy-atom distance of each residue pair and frame
MIN_SQL = """SELECT p.traj_id, p.frame, p.chain_id chain_id_1, p.resid resid_1, q.chain_id chain_id_2, q.resid resid_2,
  min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))) d
  FROM placed p JOIN placed q USING (traj_id, frame)
  WHERE p.chain_id IN ('A','B','C') AND q.chain_id IN ('D','E') AND p.name NOT LIKE 'H%' AND q.name NOT LIKE 'H%' GROUP BY ALL"""
# pair table with segments, from events ev(traj_id, frame, 4 pair columns, d)
PAIRS_SQL = """, tot AS (SELECT traj_id, count(DISTINCT frame) total_frames FROM placed GROUP BY 1),
fr AS (SELECT DISTINCT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, frame FROM ev),
gp AS (SELECT *, frame - lag(frame) OVER (PARTITION BY traj_id, chain_id_1, resid_1, chain_id_2, resid_2 ORDER BY frame) gap FROM fr),
st AS (SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, coalesce(list_reduce(list(gap) FILTER (WHERE gap IS NOT NULL), lambda a, b: gcd(a, b)), 1) step FROM gp GROUP BY ALL),
isl AS (SELECT gp.*, st.step, sum(CASE WHEN gap IS NULL OR gap <> step THEN 1 ELSE 0 END) OVER (PARTITION BY gp.traj_id, gp.chain_id_1, gp.resid_1, gp.chain_id_2, gp.resid_2 ORDER BY frame) seg
  FROM gp JOIN st USING (traj_id, chain_id_1, resid_1, chain_id_2, resid_2)),
runs AS (SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, seg, count(*) len, min(frame) a, max(frame) b FROM isl GROUP BY ALL),
seg AS (SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, count(*) n_segments, max(len) max_consecutive_frames, CAST(min(a) AS BIGINT) first_frame, CAST(max(b) AS BIGINT) last_frame, CAST(sum(len) AS BIGINT) contact_frames FROM runs GROUP BY ALL),
md AS (SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, min(d) min_distance FROM ev GROUP BY ALL),
pairs AS (SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, contact_frames, total_frames, contact_frames/total_frames contact_frequency, min_distance, n_segments, max_consecutive_frames, first_frame, last_frame
  FROM seg JOIN md USING (traj_id, chain_id_1, resid_1, chain_id_2, resid_2) JOIN tot USING (traj_id))"""
CONTACT_SQL = f"WITH ev AS (SELECT * FROM ({MIN_SQL}) WHERE d < 4.5){PAIRS_SQL}"
# semantics and interaction classes of pairs
CLASS_SQL = """, sem AS (SELECT r.chain_id, r.resid, c.role component, CASE WHEN c.role LIKE 'TCR%' THEN 'tcr' ELSE 'phla' END side, CASE WHEN c.role LIKE 'TCR%' THEN replace(c.role,'TCR_','') END tcr_chain,
  CASE WHEN c.role LIKE 'TCR%' THEN coalesce(g.region,'non_cdr') END tcr_region,
  CASE WHEN c.role LIKE 'TCR%' THEN NULL WHEN c.role = 'HLA_alpha' THEN CASE WHEN r.resid BETWEEN 50 AND 86 OR r.resid BETWEEN 140 AND 176 THEN 'groove' ELSE 'non_groove' END ELSE c.role END mhc_region,
  CASE WHEN c.role LIKE 'TCR%' THEN NULL WHEN c.role = 'HLA_alpha' THEN CASE WHEN r.resid BETWEEN 50 AND 86 THEN 'alpha1_helix' WHEN r.resid BETWEEN 140 AND 176 THEN 'alpha2_helix' ELSE 'non_groove' END ELSE c.role END mhc_subregion
  FROM residues r JOIN chains c USING (chain_id) LEFT JOIN regions g ON r.chain_id = g.chain_id AND r.resid BETWEEN g.resid_start AND g.resid_end),
ann AS (SELECT p.*, CASE s1.component WHEN 'peptide' THEN 'peptide_tcr' WHEN 'HLA_alpha' THEN 'hla_tcr' WHEN 'beta2m' THEN 'beta2m_tcr' END interaction_class, s2.tcr_chain, s2.tcr_region, s1.mhc_region, s1.mhc_subregion, s1.component partner_component
  FROM pairs p JOIN sem s1 ON p.chain_id_1 = s1.chain_id AND p.resid_1 = s1.resid JOIN sem s2 ON p.chain_id_2 = s2.chain_id AND p.resid_2 = s2.resid),
occ AS (SELECT *, max_consecutive_frames/total_frames max_consecutive_fraction FROM ann),
lab AS (SELECT *, CASE WHEN contact_frequency >= 0.30 AND max_consecutive_fraction >= 0.10 THEN 'stable' WHEN contact_frequency < 0.10 AND max_consecutive_fraction < 0.03 AND n_segments >= 2 THEN 'transient' ELSE 'intermediate' END stability_label FROM occ)"""
SUMMARY = """count(*) n_pairs, avg(contact_frequency) mean_occupancy, quantile_cont(contact_frequency, 0.5) median_occupancy, avg(max_consecutive_fraction) mean_max_consecutive_fraction,
  avg(CASE WHEN stability_label='stable' THEN 1.0 ELSE 0.0 END) stable_pair_fraction, avg(CASE WHEN stability_label='transient' THEN 1.0 ELSE 0.0 END) transient_pair_fraction"""
SUMMARY_COLS = "mean_occupancy median_occupancy mean_max_consecutive_fraction stable_pair_fraction transient_pair_fraction"
ALL = "placed residues chains regions"


def phla():
    return F.col("chain_id").isin("A", "B", "C")


def tcr():
    return F.col("chain_id").isin("D", "E")


def contact_pairs(spark, d):
    return contacts.contact_frequencies(ad.placed_atoms(spark, d), phla(), tcr())


def semantics(spark):
    return annotate.residue_semantics(ad.residues(spark), ad.chains(spark), ad.regions(spark))


def annotated(spark, d):
    return annotate.annotate_pairs(contact_pairs(spark, d), semantics(spark))


def labelled(spark, d):
    return summaries.pair_occupancy(annotated(spark, d))


@R.add("j01_residue_semantics", "placed chains regions", """SELECT r.chain_id, r.resid, role component, CASE WHEN role LIKE 'TCR%' THEN 'tcr' ELSE 'phla' END complex_side, CASE WHEN role NOT LIKE 'TCR%' THEN role END phla_region,
  CASE WHEN role LIKE 'TCR%' THEN NULL WHEN role='HLA_alpha' THEN CASE WHEN resid BETWEEN 50 AND 86 OR resid BETWEEN 140 AND 176 THEN 'groove' ELSE 'non_groove' END ELSE role END mhc_region,
  CASE WHEN role LIKE 'TCR%' THEN NULL WHEN role='HLA_alpha' THEN CASE WHEN resid BETWEEN 50 AND 86 THEN 'alpha1_helix' WHEN resid BETWEEN 140 AND 176 THEN 'alpha2_helix' ELSE 'non_groove' END ELSE role END mhc_subregion,
  CASE WHEN role LIKE 'TCR%' THEN replace(role,'TCR_','') END tcr_chain, CASE WHEN role LIKE 'TCR%' THEN coalesce(region,'non_cdr') END tcr_region
  FROM (SELECT DISTINCT chain_id, resid FROM placed) r JOIN chains c ON r.chain_id = c.chain_id LEFT JOIN regions g ON r.chain_id = g.chain_id AND r.resid BETWEEN g.resid_start AND g.resid_end""")
def _(spark, d):
    res = ad.placed_atoms(spark, d).select("chain_id", "resid").distinct()
    return annotate.residue_semantics(res, ad.chains(spark), ad.regions(spark))


@R.add("j04_capped_distance_join", "placed", """WITH pa AS MATERIALIZED (SELECT traj_id, frame, atom_id, chain_id, x, y, z FROM placed),
b AS (SELECT traj_id, frame, list({'a': atom_id, 'x': x, 'y': y, 'z': z}) FILTER (WHERE chain_id IN ('D','E')) q, list({'a': atom_id, 'x': x, 'y': y, 'z': z}) FILTER (WHERE chain_id IN ('A','B','C')) p FROM pa GROUP BY ALL),
u AS (SELECT traj_id, frame, p, unnest(q) q FROM b), v AS (SELECT traj_id, frame, q, unnest(p) p FROM u)
SELECT traj_id, frame, p.a atom_id_1, q.a atom_id_2, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) distance FROM v WHERE (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z) <= 16.0""", "distance")
def _(spark, d):
    p = ad.placed_atoms(spark, d).select("traj_id", "frame", "chain_id", "atom_id", "x", "y", "z")
    return contacts.capped_pairs(p.where(phla()), p.where(tcr()), 4.0).select("traj_id", "frame", "atom_id_1", "atom_id_2", "distance")


@R.add("c01_residue_contact_frequency", "placed", CONTACT_SQL + " SELECT * FROM pairs", "contact_frequency min_distance")
def _(spark, d):
    return contact_pairs(spark, d).drop("frame_segments", "interaction_family")


@R.add("c03_salt_bridges", "placed", """WITH ab AS (SELECT *, resname IN ('ASP','GLU') AND element='O' acid, resname IN ('LYS','ARG','HIS') AND element='N' base FROM placed),
ev AS (SELECT traj_id, frame, chain_id_1, resid_1, chain_id_2, resid_2, min(d) d FROM (SELECT p.traj_id, p.frame, p.chain_id chain_id_1, p.resid resid_1, q.chain_id chain_id_2, q.resid resid_2, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) d
 FROM ab p JOIN ab q USING (traj_id, frame) WHERE p.chain_id IN ('A','B','C') AND q.chain_id IN ('D','E') AND (p.acid AND q.base OR p.base AND q.acid)) WHERE d <= 6.0 GROUP BY ALL)""" + PAIRS_SQL + " SELECT * FROM pairs", "contact_frequency min_distance")
def _(spark, d):
    return contacts.salt_bridges(ad.placed_atoms(spark, d), phla(), tcr(), 6.0).drop("frame_segments", "interaction_family")


@R.add("c04_hydrophobic_contacts", "placed", """WITH h AS (SELECT * FROM placed WHERE resname IN ('PHE','LEU','TYR') AND name NOT IN ('N','CA','C','O')),
ev AS (SELECT traj_id, frame, chain_id_1, resid_1, chain_id_2, resid_2, min(d) d FROM (SELECT p.traj_id, p.frame, p.chain_id chain_id_1, p.resid resid_1, q.chain_id chain_id_2, q.resid resid_2, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) d
 FROM h p JOIN h q USING (traj_id, frame) WHERE p.chain_id IN ('A','B','C') AND q.chain_id IN ('D','E')) WHERE d <= 4.5 GROUP BY ALL)""" + PAIRS_SQL + " SELECT * FROM pairs", "contact_frequency min_distance")
def _(spark, d):
    return contacts.hydrophobic_contacts(ad.placed_atoms(spark, d), phla(), tcr()).drop("frame_segments", "interaction_family")


@R.add("c02_hydrogen_bonds", "placed", """WITH s AS (SELECT *, CASE WHEN chain_id IN ('A','B','C') THEN 1 ELSE 2 END side FROM placed),
dh AS (SELECT d.*, h.x hx, h.y hy, h.z hz FROM s d JOIN s h ON d.traj_id=h.traj_id AND d.frame=h.frame AND d.chain_id=h.chain_id AND d.resid=h.resid WHERE d.element IN ('N','O') AND h.element='H' AND sqrt((d.x-h.x)*(d.x-h.x)+(d.y-h.y)*(d.y-h.y)+(d.z-h.z)*(d.z-h.z)) <= 6.0),
ev AS (SELECT dh.traj_id, dh.frame, dh.chain_id chain_id_1, dh.resid resid_1, a.chain_id chain_id_2, a.resid resid_2, sqrt((dh.x-a.x)*(dh.x-a.x)+(dh.y-a.y)*(dh.y-a.y)+(dh.z-a.z)*(dh.z-a.z)) distance,
 degrees(acos(greatest(-1.0, least(1.0, ((dh.x-hx)*(a.x-hx)+(dh.y-hy)*(a.y-hy)+(dh.z-hz)*(a.z-hz)) / sqrt(((dh.x-hx)*(dh.x-hx)+(dh.y-hy)*(dh.y-hy)+(dh.z-hz)*(dh.z-hz))*((a.x-hx)*(a.x-hx)+(a.y-hy)*(a.y-hy)+(a.z-hz)*(a.z-hz))))))) angle
 FROM dh JOIN s a ON dh.traj_id=a.traj_id AND dh.frame=a.frame AND dh.side<>a.side WHERE a.element IN ('N','O'))
SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, count(DISTINCT frame) contact_frames, count(*) n_events, min(distance) min_distance, avg(angle) mean_angle, any_value(total_frames) total_frames, count(DISTINCT frame)/any_value(total_frames) contact_frequency
FROM ev JOIN (SELECT traj_id, count(DISTINCT frame) total_frames FROM placed GROUP BY 1) USING (traj_id) WHERE distance <= 8.0 AND angle >= 90 GROUP BY ALL""", "min_distance mean_angle contact_frequency")
def _(spark, d):
    return contacts.hydrogen_bonds(ad.placed_atoms(spark, d), phla(), tcr(), 6.0, 8.0, 90.0)


RRCS_SQL = """WITH hv AS (SELECT * FROM placed WHERE element <> 'H'), fr AS (SELECT DISTINCT traj_id, frame FROM placed),
spec AS (SELECT a.chain_id chain_id_1, a.resid resid_1, b.chain_id chain_id_2, b.resid resid_2 FROM residues a, residues b WHERE a.chain_id='C' AND b.chain_id IN ('D','E')),
sc AS (SELECT p.traj_id, p.frame, p.chain_id chain_id_1, p.resid resid_1, q.chain_id chain_id_2, q.resid resid_2, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) d FROM hv p JOIN hv q USING (traj_id, frame) WHERE p.chain_id='C' AND q.chain_id IN ('D','E')),
ss AS (SELECT traj_id, frame, chain_id_1, resid_1, chain_id_2, resid_2, sum(CASE WHEN d <= 3.23 THEN 1.0 ELSE (4.63-d)/(4.63-3.23) END) score FROM sc WHERE d < 4.63 GROUP BY ALL),
rr AS (SELECT fr.traj_id, fr.frame, spec.*, coalesce(score, 0.0) score FROM fr CROSS JOIN spec LEFT JOIN ss USING (traj_id, frame, chain_id_1, resid_1, chain_id_2, resid_2))"""


def rrcs_pairs(spark):
    res = ad.residues(spark)
    one = res.where("chain_id = 'C'").select(F.col("chain_id").alias("chain_id_1"), F.col("resid").alias("resid_1"))
    two = res.where("chain_id IN ('D', 'E')").select(F.col("chain_id").alias("chain_id_2"), F.col("resid").alias("resid_2"))
    return one.withColumn("_all", F.lit(1)).join(two.withColumn("_all", F.lit(1)), "_all").drop("_all")


def rrcs_means(spark, d):
    p, pairs = ad.placed_atoms(spark, d), rrcs_pairs(spark)
    return contacts.rrcs_summary(contacts.rrcs(p, pairs), ad.frames(spark, d).groupBy("traj_id").agg(F.count("*").alias("total_frames")), pairs)


@R.add("c07_rrcs_per_frame", "placed residues", RRCS_SQL + " SELECT * FROM rr", "score")
def _(spark, d):
    pairs = rrcs_pairs(spark)
    return contacts.with_zeros(contacts.rrcs(ad.placed_atoms(spark, d), pairs), ad.frames(spark, d), pairs)


@R.add("c08_rrcs_summary", "placed residues", RRCS_SQL + """ SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, avg(score) mean_rrcs, quantile_cont(score, 0.5) median_rrcs, max(score) max_rrcs, count(*) FILTER (WHERE score > 0) nonzero_frames, avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) nonzero_fraction FROM rr GROUP BY ALL""", "mean_rrcs median_rrcs max_rrcs nonzero_fraction")
def _(spark, d):
    return rrcs_means(spark, d)


@R.add("c09_rrcs_regions", "placed residues chains regions", RRCS_SQL + """, m AS (SELECT chain_id_1, resid_1, chain_id_2, resid_2, traj_id, avg(score) s FROM rr GROUP BY ALL)
SELECT m.traj_id, m.chain_id_2 chain_id, g.region, count(*) n_pairs, sum(s) total_rrcs, max(s) max_rrcs FROM m LEFT JOIN regions g ON m.chain_id_2=g.chain_id AND m.resid_2 BETWEEN g.resid_start AND g.resid_end GROUP BY ALL""", "total_rrcs max_rrcs")
def _(spark, d):
    mean = rrcs_means(spark, d)
    g = ad.regions(spark).withColumnRenamed("chain_id", "_c")
    j = mean.join(F.broadcast(g), (F.col("chain_id_2") == F.col("_c")) & F.col("resid_2").between(F.col("resid_start"), F.col("resid_end")), "left")
    return j.groupBy("traj_id", F.col("chain_id_2").alias("chain_id"), "region").agg(F.count("*").alias("n_pairs"), F.sum("mean_rrcs").alias("total_rrcs"), F.max("mean_rrcs").alias("max_rrcs"))


MAP_SQL = """WITH am AS (SELECT p.traj_id, p.frame, p.atom_id atom_id_1, q.atom_id atom_id_2, p.chain_id chain_id_1, p.resid resid_1, q.chain_id chain_id_2, q.resid resid_2, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) distance
 FROM placed p JOIN placed q USING (traj_id, frame) WHERE p.frame = 0),
rm AS (SELECT traj_id, frame, chain_id_1, resid_1, chain_id_2, resid_2, min(distance) distance FROM am WHERE distance < 8.0 AND (chain_id_1, resid_1) < (chain_id_2, resid_2) GROUP BY ALL)"""


def first_frame(spark, d):
    return ad.placed_atoms(spark, d).where("frame = 0")


@R.add("c11_atom_contact_map", "placed", MAP_SQL + " SELECT * FROM am WHERE atom_id_1 < atom_id_2 AND distance < 8.0", "distance")
def _(spark, d):
    return contacts.atom_contact_map(first_frame(spark, d)).drop("x_1", "y_1", "z_1", "x_2", "y_2", "z_2")


@R.add("c12_residue_contact_map", "placed", MAP_SQL + " SELECT * FROM rm", "distance")
def _(spark, d):
    return contacts.residue_contact_map(first_frame(spark, d))


@R.add("c13_contact_counts", "placed residues", MAP_SQL + """, b AS (SELECT traj_id, frame, chain_id_1 chain_id, resid_1 resid FROM rm UNION ALL SELECT traj_id, frame, chain_id_2, resid_2 FROM rm),
n AS (SELECT traj_id, frame, chain_id, resid, count(*) c FROM b GROUP BY ALL), r AS (SELECT DISTINCT traj_id, frame, chain_id, resid FROM placed WHERE frame = 0)
SELECT traj_id, frame, chain_id, resid, coalesce(c, 0) n_contacts, coalesce(c, 0) / (count(*) OVER (PARTITION BY traj_id, frame) - 1) fraction FROM r LEFT JOIN n USING (traj_id, frame, chain_id, resid)""", "fraction")
def _(spark, d):
    p = first_frame(spark, d)
    return contacts.contact_counts(p.select("traj_id", "frame", "chain_id", "resid").distinct(), contacts.residue_contact_map(p))


@R.add("c14_long_range_contacts", "placed residues", MAP_SQL + """, ix AS (SELECT *, dense_rank() OVER (ORDER BY chain_id, resid) i FROM residues)
SELECT rm.*, CAST(a.i AS INTEGER) i_1, CAST(b.i AS INTEGER) i_2 FROM rm JOIN ix a ON rm.chain_id_1=a.chain_id AND rm.resid_1=a.resid JOIN ix b ON rm.chain_id_2=b.chain_id AND rm.resid_2=b.resid WHERE b.i - a.i >= 5""", "distance")
def _(spark, d):
    return contacts.long_range(contacts.residue_contact_map(first_frame(spark, d)), ad.residues(spark))


@R.add("c15_contact_number", "placed", """SELECT traj_id, frame, count(*) FILTER (WHERE sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) < 4.5) contact_number
 FROM placed p JOIN placed q USING (traj_id, frame) WHERE p.chain_id='C' AND q.chain_id IN ('D','E') GROUP BY ALL""")
def _(spark, d):
    return contacts.contact_number(ad.placed_atoms(spark, d), F.col("chain_id") == "C", tcr())


@R.add("c16_native_contacts", "placed", """WITH mn AS (SELECT p.traj_id, p.frame, p.chain_id c1, p.resid r1, q.chain_id c2, q.resid r2, min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))) d FROM placed p JOIN placed q USING (traj_id, frame) WHERE p.chain_id IN ('A','B','C') AND q.chain_id IN ('D','E') GROUP BY ALL),
nt AS (SELECT traj_id, c1, r1, c2, r2, d d0, count(*) OVER (PARTITION BY traj_id) n_native FROM mn WHERE frame = 0 AND d < 4.5)
SELECT traj_id, frame, n_native, avg(CASE WHEN d < 4.5 THEN 1.0 ELSE 0.0 END) fnat, avg(1/(1+exp(5.0*(d-1.8*d0)))) q FROM mn JOIN nt USING (traj_id, c1, r1, c2, r2) WHERE n_native >= 3 GROUP BY ALL""", "fnat q")
def _(spark, d):
    return contacts.native_contacts(ad.placed_atoms(spark, d), phla(), tcr())


@R.add("c17_peptide_hla_occupancy", "placed", "WITH mn AS (SELECT p.traj_id, p.frame, p.resid r1, q.resid r2, min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))) d FROM placed p JOIN placed q USING (traj_id, frame) WHERE p.chain_id='C' AND q.chain_id='A' AND p.name NOT LIKE 'H%' AND q.name NOT LIKE 'H%' GROUP BY ALL), t AS (SELECT traj_id, count(DISTINCT frame) n FROM placed GROUP BY 1), f AS (SELECT traj_id, r1, r2, count(*) / any_value(n) f FROM mn JOIN t USING (traj_id) WHERE d < 4.5 GROUP BY ALL) SELECT traj_id, r1 resid, max(f) occupancy FROM f GROUP BY ALL", "occupancy")
def _(spark, d):
    t = contacts.contact_frequencies(ad.placed_atoms(spark, d), F.col("chain_id") == "C", F.col("chain_id") == "A")
    return t.groupBy("traj_id", F.col("resid_1").alias("resid")).agg(F.max("contact_frequency").alias("occupancy"))


@R.add("w01_persistence_segments", "presence", """, gp AS (SELECT *, frame - lag(frame) OVER (PARTITION BY traj_id, pair_id ORDER BY frame) gap FROM presence),
st AS (SELECT traj_id, pair_id, coalesce(list_reduce(list(gap) FILTER (WHERE gap IS NOT NULL), lambda a, b: gcd(a, b)), 1) step FROM gp GROUP BY ALL),
isl AS (SELECT gp.*, sum(CASE WHEN gap IS NULL OR gap <> step THEN 1 ELSE 0 END) OVER (PARTITION BY gp.traj_id, gp.pair_id ORDER BY frame) seg FROM gp JOIN st USING (traj_id, pair_id)),
runs AS (SELECT traj_id, pair_id, seg, count(*) len, min(frame) a, max(frame) b FROM isl GROUP BY ALL)
SELECT traj_id, pair_id, CAST(sum(len) AS BIGINT) contact_frames, count(*) n_segments, max(len) max_consecutive_frames, CAST(min(a) AS BIGINT) first_frame, CAST(max(b) AS BIGINT) last_frame FROM runs GROUP BY ALL""".replace(", gp AS", "WITH gp AS", 1))
def _(spark, d):
    return persistence.pair_persistence(ad.presence(spark, d)).drop("frame_segments")


@R.add("w02_integer_ranges", "presence", "SELECT traj_id, pair_id, min(frame) range_start, max(frame) range_end FROM (SELECT *, frame - row_number() OVER (PARTITION BY traj_id, pair_id ORDER BY frame) g FROM presence) GROUP BY traj_id, pair_id, g")
def _(spark, d):
    return persistence.integer_ranges(ad.presence(spark, d), "frame", ("traj_id", "pair_id"))


@R.add("j02_pair_annotation", ALL, CONTACT_SQL + CLASS_SQL + " SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, contact_frequency, interaction_class, tcr_chain, tcr_region, partner_component phla_region, mhc_region, mhc_subregion, partner_component FROM ann", "contact_frequency")
def _(spark, d):
    return annotated(spark, d).select("traj_id", "chain_id_1", "resid_1", "chain_id_2", "resid_2", "contact_frequency", "interaction_class", "tcr_chain", "tcr_region", "phla_region", "mhc_region", "mhc_subregion", "partner_component")


@R.add("a01_pair_occupancy", ALL, CONTACT_SQL + CLASS_SQL + " SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, contact_frequency, max_consecutive_fraction, n_segments, stability_label FROM lab", "contact_frequency max_consecutive_fraction")
def _(spark, d):
    return labelled(spark, d).select("traj_id", "chain_id_1", "resid_1", "chain_id_2", "resid_2", "contact_frequency", "max_consecutive_fraction", "n_segments", "stability_label")


@R.add("a02_interaction_classes", ALL, CONTACT_SQL + CLASS_SQL + f" SELECT traj_id, interaction_class, {SUMMARY} FROM lab GROUP BY ALL", SUMMARY_COLS)
def classes(spark, d):
    return summaries.occupancy_summary(labelled(spark, d), "traj_id", "interaction_class")


@R.add("a03_peptide_vs_mhc", ALL, CONTACT_SQL + CLASS_SQL + f""" SELECT "group", {SUMMARY} FROM (SELECT *, CASE interaction_class WHEN 'peptide_tcr' THEN 'tcr_peptide' WHEN 'hla_tcr' THEN 'tcr_mhc' END "group" FROM lab) WHERE "group" IS NOT NULL GROUP BY "group" """, SUMMARY_COLS)
def _(spark, d):
    return summaries.peptide_vs_mhc(labelled(spark, d))


@R.add("a04_region_summary", ALL, CONTACT_SQL + CLASS_SQL + f""" SELECT * EXCLUDE (transient_pair_fraction) FROM (SELECT tcr_region || '_' || lower(tcr_chain) tcr_region_group, CASE WHEN interaction_class='peptide_tcr' THEN 'peptide' WHEN mhc_subregion IN ('alpha1_helix','alpha2_helix') THEN mhc_subregion END partner_region_group, {SUMMARY} FROM lab WHERE tcr_region IN ('CDR1','CDR2','CDR3') GROUP BY ALL) WHERE partner_region_group IS NOT NULL""", SUMMARY_COLS.replace(" transient_pair_fraction", ""))
def _(spark, d):
    return summaries.region_summary(labelled(spark, d))


@R.add("a05_stability_counts", ALL, CONTACT_SQL + CLASS_SQL + " SELECT traj_id, count(*) n_pairs, count(*) FILTER (WHERE stability_label='stable') n_stable, count(*) FILTER (WHERE stability_label='transient') n_transient FROM lab GROUP BY ALL")
def _(spark, d):
    return summaries.stability_counts(labelled(spark, d), "traj_id")


@R.add("a06_residue_rollup", "placed", CONTACT_SQL + " SELECT traj_id, chain_id_1 chain_id, resid_1 resid, sum(contact_frequency) total_frequency, max(contact_frequency) max_frequency, count(DISTINCT (chain_id_2, resid_2)) n_partners FROM pairs GROUP BY ALL", "total_frequency max_frequency")
def _(spark, d):
    return summaries.residue_rollup(contact_pairs(spark, d), 1)


@R.add("a07_occupancy_matrix", "placed", CONTACT_SQL + """ SELECT chain_id_2 || CAST(resid_2 AS VARCHAR) tcr_residue, """ + ", ".join(f"coalesce(max(contact_frequency) FILTER (WHERE chain_id_1 = 'C' AND resid_1 = {r}), 0.0) r{r}" for r in (54, 55, 56)) + " FROM pairs WHERE chain_id_1 = 'C' GROUP BY ALL", "r54 r55 r56")
def _(spark, d):
    t = contact_pairs(spark, d).where("chain_id_1 = 'C'").withColumn("tcr_residue", F.concat("chain_id_2", F.col("resid_2").cast("string")))
    t = t.withColumn("peptide_residue", F.concat(F.lit("r"), F.col("resid_1").cast("string")))
    return summaries.occupancy_matrix(t, "tcr_residue", "peptide_residue", ["r54", "r55", "r56"])


@R.add("a09_region_bundles", ALL, CONTACT_SQL + CLASS_SQL + " SELECT tcr_chain, tcr_region, count(*) n_total, count(*) FILTER (WHERE interaction_class='peptide_tcr') n_peptide, count(*) FILTER (WHERE interaction_class='hla_tcr') n_hla, count(*) FILTER (WHERE interaction_class='hla_tcr' AND mhc_region='groove') n_groove FROM lab GROUP BY ALL")
def _(spark, d):
    return summaries.region_bundles(labelled(spark, d))


@R.add("f04_filter_pairs", ALL, CONTACT_SQL + CLASS_SQL + " SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, contact_frequency FROM lab WHERE interaction_class = 'hla_tcr' AND tcr_region = 'CDR3'", "contact_frequency")
def _(spark, d):
    return annotate.filter_pairs(labelled(spark, d), interaction_class="hla_tcr", tcr_region="CDR3", mhc_region=None).select("traj_id", "chain_id_1", "resid_1", "chain_id_2", "resid_2", "contact_frequency")


@R.add("k01_persistent_ranking", ALL, CONTACT_SQL + CLASS_SQL + " SELECT traj_id, chain_id_1, resid_1, chain_id_2, resid_2, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY round(max_consecutive_fraction,9) DESC, round(contact_frequency,9) DESC, n_segments, chain_id_1, resid_1, chain_id_2, resid_2) AS INTEGER) AS \"rank\" FROM lab")
def _(spark, d):
    order = [F.round("max_consecutive_fraction", 9).desc(), F.round("contact_frequency", 9).desc(), F.col("n_segments"), "chain_id_1", "resid_1", "chain_id_2", "resid_2"]
    return summaries.top_k(labelled(spark, d), 2**31 - 1, order, "traj_id").select("traj_id", "chain_id_1", "resid_1", "chain_id_2", "resid_2", "rank")


@R.add("a12_contact_entropy", "placed", CONTACT_SQL + """, pp AS (SELECT traj_id, contact_frequency / sum(contact_frequency) OVER (PARTITION BY traj_id) p FROM pairs), rk AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY p DESC) k FROM pp)
SELECT traj_id, count(*) n_pairs, -sum(p*ln(p)) entropy_nats, max(p) top1_share, sum(p) FILTER (WHERE k <= 3) top3_share, -sum(p*ln(p))/ln(count(*)) entropy_normalized FROM rk GROUP BY ALL HAVING count(*) >= 2""", "entropy_nats top1_share top3_share entropy_normalized")
def _(spark, d):
    return summaries.contact_entropy(contact_pairs(spark, d))


RMSF_SQL = "rf AS (SELECT traj_id, chain_id, resid, avg(f) rmsf FROM (SELECT traj_id, chain_id, resid, atom_id, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) f FROM placed GROUP BY ALL) GROUP BY ALL)"


def residue_rmsf(spark, d):
    from strandlake.operators.geometry import rmsf

    return rmsf(ad.placed_atoms(spark, d)).join(F.broadcast(ad.atoms(spark)), "atom_id").groupBy("traj_id", "chain_id", "resid").agg(F.avg("rmsf").alias("rmsf"))


@R.add("a13_peptide_positions", "placed", CONTACT_SQL + ", " + RMSF_SQL + """, c AS (SELECT traj_id, resid_1 resid, max(contact_frequency) tcr_contact, max(contact_frequency) FILTER (WHERE chain_id_2='D' AND resid_2=57 OR chain_id_2='E' AND resid_2=59) cdr3_contact, count(DISTINCT (chain_id_2, resid_2)) n FROM pairs WHERE chain_id_1='C' GROUP BY ALL)
SELECT traj_id, resid, CAST(dense_rank() OVER (PARTITION BY traj_id ORDER BY resid) AS INTEGER) AS "position", coalesce(tcr_contact,0.0) tcr_contact, coalesce(cdr3_contact,0.0) cdr3_contact, coalesce(tcr_contact,0.0) hbond, coalesce(n,0) n_tcr_partners, rmsf
FROM c FULL JOIN (SELECT traj_id, resid, rmsf FROM rf WHERE chain_id='C') r USING (traj_id, resid)""", "tcr_contact cdr3_contact hbond rmsf")
def _(spark, d):
    c = contact_pairs(spark, d).where("chain_id_1 = 'C'")
    loops = ad.regions(spark).where("region = 'CDR3'").select("chain_id", F.explode(F.sequence("resid_start", "resid_end")).alias("resid"))
    hb = c.select("traj_id", F.col("resid_1").alias("resid"), "contact_frequency")
    return summaries.peptide_positions(c, residue_rmsf(spark, d).where("chain_id = 'C'").drop("chain_id"), hb, loops)


@R.add("a14_hotspots", "placed", CONTACT_SQL + ", " + RMSF_SQL + """, both2 AS (SELECT traj_id, chain_id_1 chain_id, resid_1 resid, chain_id_2 oc, resid_2 orr, contact_frequency FROM pairs UNION ALL SELECT traj_id, chain_id_2, resid_2, chain_id_1, resid_1, contact_frequency FROM pairs),
e AS (SELECT traj_id, chain_id, resid, max(contact_frequency) occupancy, count(DISTINCT (oc, orr)) n_partners FROM both2 GROUP BY ALL),
s AS (SELECT e.*, CAST(1 AS BIGINT) n_interaction_types, rmsf, 0.4*occupancy + 0.3*greatest(0.0, 1-rmsf/3.0) + 0.3*1/5.0 score FROM e LEFT JOIN rf USING (traj_id, chain_id, resid)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY round(score,9) DESC, chain_id, resid) AS INTEGER) AS "rank" FROM s WHERE score >= 0.3 AND occupancy >= 0.3) SELECT traj_id, chain_id, resid, occupancy, n_interaction_types, n_partners, rmsf, score FROM k WHERE "rank" <= 20""", "occupancy rmsf score")
def _(spark, d):
    return summaries.hotspots(contact_pairs(spark, d), residue_rmsf(spark, d), cutoff=0.3).drop("rank")


@R.add("k02_segment_timeline", "presence", """WITH g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY traj_id, pair_id ORDER BY frame) gap FROM presence), st AS (SELECT traj_id, pair_id, coalesce(list_reduce(list(gap) FILTER (WHERE gap IS NOT NULL), lambda a, b: gcd(a, b)), 1) step, count(*) n FROM g GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY n DESC, pair_id) k FROM st) WHERE k <= 2),
isl AS (SELECT g.traj_id, g.pair_id, frame, sum(CASE WHEN gap IS NULL OR gap <> step THEN 1 ELSE 0 END) OVER (PARTITION BY g.traj_id, g.pair_id ORDER BY frame) seg FROM g JOIN top USING (traj_id, pair_id))
SELECT traj_id, pair_id, min(frame) AS "start", max(frame) AS "end" FROM isl GROUP BY traj_id, pair_id, seg""")
def _(spark, d):
    p = persistence.pair_persistence(ad.presence(spark, d))
    return summaries.top_k(p, 2, [F.desc("contact_frames"), "pair_id"], "traj_id").select("traj_id", "pair_id", F.inline("frame_segments"))


@R.add("u01_pair_union", "placed", CONTACT_SQL + " SELECT traj_id, chain_id_1 chain_id, resid_1 resid FROM pairs UNION SELECT traj_id, chain_id_2, resid_2 FROM pairs")
def _(spark, d):
    p = contact_pairs(spark, d)
    one, two = (p.select("traj_id", F.col(f"chain_id_{t}").alias("chain_id"), F.col(f"resid_{t}").alias("resid")) for t in "12")
    return one.unionByName(two).distinct()


@R.add("j05_contact_residues", "placed residues", CONTACT_SQL + " SELECT chain_id, resid FROM residues r WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.chain_id_2 = r.chain_id AND p.resid_2 = r.resid AND contact_frequency >= 0.5)")
def _(spark, d):
    p = contact_pairs(spark, d).where("contact_frequency >= 0.5").select(F.col("chain_id_2").alias("chain_id"), F.col("resid_2").alias("resid"))
    return ad.residues(spark).join(p, ["chain_id", "resid"], "left_semi")


@R.add("j07_static_features", "placed regions", CONTACT_SQL + " SELECT p.traj_id, coalesce(g.region, 'none') feature, sum(contact_frequency) AS \"value\" FROM pairs p LEFT JOIN regions g ON p.chain_id_2=g.chain_id AND p.resid_2 BETWEEN g.resid_start AND g.resid_end GROUP BY ALL UNION ALL SELECT traj_id, 'hot_' || chain_id_1 || CAST(resid_1 AS VARCHAR) || '_' || chain_id_2 || CAST(resid_2 AS VARCHAR), contact_frequency FROM pairs WHERE contact_frequency >= 0.7", "value")
def _(spark, d):
    from strandlake.operators.joins import static_features

    return static_features(contact_pairs(spark, d), ad.regions(spark), 0.7)
