"""Small cases with known answers, invariants of the numeric kernels, and empty inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import labels
from strandlake.kernels import linear
from strandlake.operators import contacts, geometry, persistence, profiles, replicas, rules, series, summaries
from strandlake.sources import tables, text_formats


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q if np.linalg.det(q) > 0 else -q


def test_superposition_undoes_a_rigid_move():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 3))
    moved = np.stack([x @ rotation(rng) + rng.normal(size=3) for _ in range(6)])
    assert np.allclose(linear.superpose(moved, x), x)
    assert np.allclose(linear.fitted_rmsd(moved, x[None]), 0, atol=1e-6)
    noisy = moved + 0.1 * rng.normal(size=moved.shape)
    assert np.allclose(linear.fitted_rmsd(noisy, x[None])[:, 0], linear.rmsd(linear.superpose(noisy, x), x))


def test_docking_polarity():
    platform = np.array([[0, 0, 0], [4, 0, 0], [0, 1, 0], [4, 1, 0]], float)
    peptide = np.array([[0, 0.5, 1], [4, 0.5, 1]])
    tcr = np.array([[1, 0.5, 5], [3, 0.5, 5]], float)
    sets = [np.arange(4), np.array([6]), np.array([7]), np.array([4, 5])]
    x = np.stack([np.vstack([platform, peptide, tcr]), np.vstack([platform, peptide, tcr[::-1]]), np.vstack([platform, peptide, [[2, 0, 5], [2, 1, 5]]])])
    got = linear.docking_angles(x, *sets)
    assert got[:, 2].tolist() == [1, -1, 0]
    assert got[:2, 0] == pytest.approx([0, 0], abs=1e-6) and got[2, 0] == pytest.approx(90)


def test_spectrum_and_clusters():
    assert linear.spectrum(np.array([1.0, 1, 1, 1])) == (4, pytest.approx(4))
    assert linear.spectrum(np.array([1.0, 0, 0])) == (1, pytest.approx(1))
    x = np.array([[0.0], [0.1], [5], [5.1], [9]])
    d = np.abs(x - x.T)
    assert linear.average_linkage(d, 1.0).tolist() == [0, 0, 1, 1, 2]
    assert linear.average_linkage(d, 100).tolist() == [0] * 5
    v, u = linear.generalized_eigen(np.diag([2.0, 1]), np.diag([1.0, 4]))
    assert sorted(v) == pytest.approx([0.25, 2])
    gx = np.linspace(-6, 6, 60)
    rng = np.random.default_rng(1)
    sums = linear.gaussian_sums(rng.normal(size=300), rng.normal(size=300), gx, gx, (4.0, 0.0, 4.0))
    assert sums.sum() * (gx[1] - gx[0]) ** 2 == pytest.approx(300 * 2 * np.pi / 4, rel=0.02)


def test_segments_take_the_pairs_own_step(spark):
    rows = [("a", f) for f in (0, 20)] + [("b", f) for f in (0, 10, 20, 40, 50)] + [("c", 7)] + [("d", f) for f in (0, 3, 5)]
    p = spark.createDataFrame(rows, "pair_id string, frame int").withColumn("traj_id", F.lit("t"))
    got = {r["pair_id"]: (r["n_segments"], r["max_consecutive_frames"], [tuple(s) for s in r["frame_segments"]]) for r in persistence.pair_persistence(p).collect()}
    assert got == {"a": (1, 2, [(0, 20)]), "b": (2, 3, [(0, 20), (40, 50)]), "c": (1, 1, [(7, 7)]), "d": (3, 1, [(0, 0), (3, 3), (5, 5)])}


def test_integer_ranges(spark):
    p = spark.createDataFrame([("a", v) for v in (3, 1, 2, 5)] + [("b", v) for v in (10, 11, 11, 12)], "k string, v int")
    got = sorted(map(tuple, persistence.integer_ranges(p, "v", ("k",)).collect()))
    assert got == [("a", 1, 3), ("a", 5, 5), ("b", 10, 12)]


def test_capped_pairs_equal_brute_force_also_in_a_box(spark):
    rng = np.random.default_rng(4)
    xyz = rng.uniform(-3, 13, (60, 3))
    df = spark.createDataFrame([("t", 0, i, *map(float, p)) for i, p in enumerate(xyz)], "traj_id string, frame int, atom_id int, x double, y double, z double")
    for box in (None, (10.0, 10.0, 10.0), (7.0, 8.0, 9.0)):
        d = xyz[:, None] - xyz[None]
        if box:
            d = d - np.round(d / box) * box
        want = {(i, j) for i, j in np.argwhere(np.sqrt((d**2).sum(2)) <= 3.0)}
        got = [(r["atom_id_1"], r["atom_id_2"]) for r in contacts.capped_pairs(df, df, 3.0, box=box).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        once = [(r["atom_id_1"], r["atom_id_2"]) for r in contacts.pairs_once(df, 3.0, ("atom_id", "x", "y", "z"), box=box).collect()]
        assert sorted(once) == sorted((i, j) for i, j in want if i < j)
        even, low = F.col("atom_id") % 2 == 0, F.col("atom_id") < 30  # both at once: some points are on both sides
        two = contacts.pairs_between(df, even, low, 3.0, ("atom_id", "x", "y", "z"), box=box, also=(low, ~even)).collect()
        assert sorted((r["atom_id_1"], r["atom_id_2"]) for r in two) == sorted([(i, j) for i, j in want if i % 2 == 0 and j < 30] + [(i, j) for i, j in want if i < 30 and j % 2])
        least = contacts.pairs_between(df.withColumn("g", F.col("atom_id") % 5), even, low, 3.0, ("g", "x", "y", "z"), box=box, least_by=("g",)).collect()
        every = contacts.capped_pairs(df.where(even), df.where(low), 3.0, box=box).groupBy((F.col("atom_id_1") % 5).alias("a"), (F.col("atom_id_2") % 5).alias("b")).agg(F.min("distance").alias("d")).collect()
        assert sorted((r["g_1"], r["g_2"], r["distance"]) for r in least) == sorted(map(tuple, every))


def test_stored_frames_are_not_moved(spark):
    """Contacts of a table in buckets: no exchange by frame, and the same rows."""
    from strandlake.sources.tables import save_frames

    rng = np.random.default_rng(9)
    rows = [(t, f, "AB"[a % 2], a // 4, "CA", *map(float, rng.uniform(0, 9, 3))) for t in "pq" for f in range(6) for a in range(40)]
    points = spark.createDataFrame(rows, "traj_id string, frame int, chain_id string, resid int, name string, x double, y double, z double")
    spark.sql("DROP TABLE IF EXISTS stored_frames")
    stored = save_frames(points, "stored_frames", 3)
    tables = [contacts.contact_frequencies(p, F.col("chain_id") == "A", F.col("chain_id") == "B") for p in (points, stored)]
    plans = [t._jdf.queryExecution().toString() for t in tables]
    moved = [re.findall(r"Exchange hashpartitioning\(traj_id#\d+, frame#\d+", p) for p in plans]
    assert moved[0] and not moved[1]
    a, b = (sorted(map(str, t.collect())) for t in tables)
    assert a == b and a
    spark.sql("DROP TABLE stored_frames")


def test_quartiles_are_interpolated(spark):
    r = replicas.distribution(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double"), "v").first()
    assert (r["p25"], r["median"], r["p75"]) == (1.75, 2.5, 3.25)


def test_replica_spread(spark):
    df = spark.createDataFrame([(1, 44.0), (1, 46.0), (1, 52.0), (2, 45.0), (3, None)], "complex_id int, v double")
    got = {r["complex_id"]: tuple(r)[1:] for r in replicas.replica_spread(df, "v", 10.0).collect()}
    assert got[1] == (pytest.approx(47.3333, abs=1e-4), 3, 4.0, True) and got[2] == (45.0, 1, 0.0, None) and 3 not in got


def test_majority(spark):
    df = spark.createDataFrame([(1, "a"), (1, "g"), (1, "g"), (2, "x"), (2, "y"), (3, None), (3, "q")], "complex_id int, label string")
    primary = spark.createDataFrame([(1, "a"), (2, "y"), (3, "q")], "complex_id int, primary_label string")
    got = {r["complex_id"]: tuple(r)[1:] for r in replicas.majority_label(df, "label", primary).collect()}
    assert got == {1: ("g", False, 3), 2: ("y", False, 2), 3: ("q", None, 1)}
    hedged = {r["complex_id"]: r["label"] for r in replicas.majority_label(df, "label", primary, tie_break="m").collect()}
    assert hedged[2] == "m"
    b = spark.createDataFrame([(1, True, 0.9), (1, False, 0.8), (2, False, 0.1), (2, False, None)], "complex_id int, v boolean, w double")
    assert {r["complex_id"]: tuple(r)[1:] for r in replicas.majority_bool(b, "v", "w").collect()} == {1: (True, False, 2), 2: (False, True, 2)}
    q = spark.createDataFrame([(1, "ok"), (1, "ok"), (1, "outlier")], "complex_id int, eq string")
    r = replicas.worst_label(q, "eq", ["ok", "drifting", "outlier"]).first()
    assert (r["consensus"], r["n_ok"], r["n_outlier"], r["reproducible"]) == ("outlier", 2, 1, False)


@pytest.mark.parametrize("values,label", [([0.3] * 1000, "ok"), ([1.5] * 1000, "outlier"), ([0.2 + 4e-6 * 200 * i for i in range(1000)], "drifting")])
def test_equilibration(spark, values, label):
    s = spark.createDataFrame([("t", i, i * 200.0, v) for i, v in enumerate(values)], "traj_id string, frame int, time_s double, value double")
    assert series.equilibration(s).first()["equilibration"] == label


def test_contact_entropy(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 1.0), ("b", 0.001), ("b", 0.001), ("c", 1.0)], "traj_id string, contact_frequency double")
    got = {r["traj_id"]: r["entropy_normalized"] for r in summaries.contact_entropy(df).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] < 0.7 and "c" not in got


def test_antigen_rules(spark):
    rows = [("Homo sapiens", "Epstein Barr Virus peptide", None), (None, None, None), (None, None, "Mus musculus"), ("synthetic construct", "", None), ("Gallus", None, None), (None, "MART-1", None), ("Mycobacterium x", None, "Homo sapiens")]
    df = spark.createDataFrame(rows, "o string, n string, h string")
    got = [r[0] for r in df.select(rules.antigen_category(F.col("o"), F.col("n"), F.col("h"))).collect()]
    assert got == ["viral", None, "murine", "synthetic", "other", "tumor/self", "bacterial"]
    alleles = spark.createDataFrame([("HLA-A 0201",), ("HLA-B*27",), ("HLA-C",), ("class I",)], "t string")
    assert [r[0] for r in alleles.select(rules.normalize_allele(F.col("t"))).collect()] == ["HLA-A*02:01", "HLA-B*27", "HLA-C", None]


def test_reliability_order(spark):
    rows = [("d", None, "x", "alpha", 1.0)] * 3 + [("c", "cdr1", "mhc", "alpha", 1.0)] * 3 + [("ok", "cdr3", "peptide", c, 1.0) for c in ("alpha", "beta")]
    df = spark.createDataFrame([(a, b or "fr", p, c, o) for a, b, p, c, o in rows], "traj_id string, region string, partner string, chain string, occupancy double")
    got = {r["traj_id"]: r["unreliable_reason"] for r in summaries.reliability(summaries.decomposition(df)).collect()}
    assert got == {"d": "degenerate", "c": "single_chain_collapse", "ok": None}


def test_labels(spark):
    df = spark.createDataFrame([(0.3, 0.1, 1), (0.05, 0.02, 2), (0.05, 0.02, 1), (None, None, None)], "o double, l double, n int")
    assert [r[0] for r in df.select(labels.stability_label(F.col("o"), F.col("l"), F.col("n"))).collect()] == ["stable", "transient", "intermediate", "intermediate"]
    a = spark.createDataFrame([(60.0,), (300.0,), (180.0,), (-180.0,), (0.0,)], "a double")
    assert [r[0] for r in a.select(labels.rotamer_label(F.col("a"))).collect()] == ["g+", "g-", "t", "t", "g+"]


def test_dihedral_sign(spark):
    pts = [(0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 1.0), (3, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([("t", 0, *p) for p in pts], "traj_id string, frame int, atom_id int, x double, y double, z double")
    q = spark.createDataFrame([("q", 0, 1, 2, 3)], "name string, a int, b int, c int, d int")
    assert geometry.dihedrals(df, q).first()["degrees"] == pytest.approx(90)


def test_parsers(spark, tmp_path):
    (tmp_path / "a.xvg").write_text("# c\n@ t\n0 0.1\n 200\t0.2 9\nbad x\n1\n\n")
    got = sorted((r["time"], r["value"]) for r in text_formats.parse_xvg(text_formats.read_lines(spark, str(tmp_path / "a.xvg"))).collect())
    assert got == [(0.0, 0.1), (200.0, 0.2)]
    (tmp_path / "a.fasta").write_text(">x A*01:01 y\nAC\nGT\n>z\nMM\n")
    got = sorted(tuple(r) for r in text_formats.read_fasta(spark, str(tmp_path / "a.fasta")).collect())
    assert got == [("x A*01:01 y", "ACGT", "HLA-A*01:01", "HLA-A"), ("z", "MM", "HLA-A*unknown", "HLA-A")]
    (tmp_path / "t.csv").write_text("a,b\n1,2.5\nx,3\n")
    assert [tuple(r) for r in tables.read_stage_table(spark, str(tmp_path / "t.csv"), "a int, b double", ["a"]).collect()] == [(1, 2.5)]
    assert tables.read_stage_table(spark, str(tmp_path / "none.csv"), "a int", ["a"]).collect() == []


def test_empty_inputs_keep_their_schema(spark):
    s = spark.createDataFrame([], "traj_id string, frame int, time_s double, value double")
    for fn in (series.block_means, series.drift, series.equilibration, series.tail_variation, series.drift_table):
        out = fn(s)
        assert out.columns[0] == "traj_id" and out.count() == 0
    p = spark.createDataFrame([], "traj_id string, frame int, atom_id int, name string, chain_id string, resid int, x double, y double, z double")
    assert contacts.contact_frequencies(p, F.col("chain_id") == "A", F.col("chain_id") == "B").count() == 0


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(9)
    rows = [("t", f, i, "N", c, i, *map(float, rng.uniform(0, 8, 3))) for f in range(5) for i, c in enumerate("AAABBB")]
    p = spark.createDataFrame(rows, "traj_id string, frame int, atom_id int, name string, chain_id string, resid int, x double, y double, z double")
    runs = [sorted(map(str, contacts.contact_frequencies(p.repartition(k), F.col("chain_id") == "A", F.col("chain_id") == "B").collect())) for k in (1, 7)]
    assert runs[0] == runs[1] and runs[0]


def test_medoids_on_a_line(spark):
    """Against all pairs, with ties, a cluster alone, and no row per pair."""
    rng = np.random.default_rng(3)
    rows = [(t, f, int(rng.integers(0, 3)) if t != "alone" else 1, float(np.float32(x))) for t in ("p", "q", "alone") for f, x in enumerate(np.round(rng.normal(size=120), 1 if t == "q" else 6))]
    df = spark.createDataFrame(rows, "traj_id string, frame int, cluster int, x double").repartition(3)
    a, b = (df.select("traj_id", F.col("frame").alias(n), F.col("x").alias(f"x{n}")) for n in "ab")
    dist = a.join(b, "traj_id").select("traj_id", "a", "b", F.abs(F.col("xa") - F.col("xb")).alias("d"))
    show = lambda d: {(r["traj_id"], r["cluster"]): (r["n"], r["population"], r["medoid"], r["mean_to_others"] and round(r["mean_to_others"], 9)) for r in d.collect()}
    want = show(profiles.cluster_medoids(dist, df.drop("x")))
    assert show(profiles.cluster_medoids_on_line(df)) == want == show(profiles.cluster_medoids_on_line(df, per_chunk=7)) and len(want) == 7
    assert profiles.cluster_medoids_on_line(df.where("frame < 0")).count() == 0


def test_equal_scopes_are_parsed_once(spark):
    plan = profiles.parse_pair_scope(spark.createDataFrame([("A:1-2 $ D:5",)] * 3, "value string"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "regexp_extract" in line)
    last = max(i for i, line in enumerate(plan) if "Aggregate [value" in line)
    assert first <= last and not any("regexp_extract" in line for line in plan[last + 1 :])


def test_segments_are_found_once(spark):
    """The check of the parsed segments is not pushed into the expressions that find them."""
    from strandlake import registry

    plan = registry.ALL["x08_segments_json"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and "array_distinct" not in plan


def test_the_longest_run_alone_is_found_in_one_pass(spark):
    """With all other columns dropped, the ends of the segments are not looked for anew in each segment."""
    p = spark.range(20000).select(F.lit("t").alias("traj_id"), F.lit("a").alias("pair_id"), (F.col("id").cast("int") + F.floor(F.col("id") / 2).cast("int")).alias("frame"))
    runs = persistence.pair_persistence(p).select("max_consecutive_frames")
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(lambda" in plan and "filter(frames" not in plan
    assert runs.first()[0] == 2


def records_and_back(spark, path, **sizes):
    rows = [(f"traj_{i}", '{"id": %d, "name": "né"}' % i) for i in range(40)] + [("traj_a=b c", '{"id": 40, "name": "x"}')]
    tables.write_records(spark.createDataFrame(rows, "dir string, value string"), path, **sizes)
    found = tables.read_records(spark, path, "id bigint, name string", "dir=traj_([^/]+)/[^/]+$")
    return sorted((r["id"], r["name"], r["traj_id"]) for r in found.collect())


def test_record_files_are_written_and_listed_by_tasks(spark, tmp_path):
    """Every record in a file of its own, below a folder for each task; nothing is left beside them."""
    want = [(i, "né", str(i)) for i in range(40)]
    for k, root in enumerate((f"{tmp_path}/a", f"file://{tmp_path}/b")):
        got = records_and_back(spark, root, per_task=10)
        assert got[:40] == want and len(got) == 41 and got[40][:2] == (40, "x")
        made = list((tmp_path / "ab"[k]).rglob("*.json"))
        assert len(made) == 41 and len({p.parent.parent for p in made}) > 1
        assert len([p for p in (tmp_path / "ab"[k]).rglob("*") if p.is_file()]) == 41


def test_record_files_in_a_store_of_spark_s_own(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.records.link./data", f"file://{tmp_path}")
    got = records_and_back(spark, "viewfs://records/data/r", per_task=10)
    assert got[:40] == [(i, "né", str(i)) for i in range(40)] and len(got) == 41


def test_records_below_a_folder_at_any_depth(spark, tmp_path):
    for name in ("t1/meta.json", "t2/deep/t3/meta.json"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text('{\n "id": 1\n}')
    assert sorted(r["traj_id"] for r in tables.read_records(spark, str(tmp_path), "id bigint").collect()) == ["t1", "t3"]
