"""Formats over lines that Spark derives from the given tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake import adapters as ad
from strandlake.queries.base import Registry
from strandlake.sources import tables, text_formats

R = Registry()


@R.add("s01_xvg", "series", "SELECT traj_id, CAST(frame * 200 AS DOUBLE) AS \"time\", value FROM series", "value")
def _(spark, d):
    s = ad.series(spark, d)
    data = s.select("traj_id", F.concat_ws("   ", (F.col("frame") * 200).cast("string"), F.col("value").cast("string")).alias("value"))
    noise = s.where("frame = 0").select("traj_id", F.explode(F.array(*map(F.lit, ("# made", "@ title", "", "1.0", "a b")))).alias("value"))
    return text_formats.parse_xvg(data.unionByName(noise), "traj_id")


@R.add("s03_stage_table", "", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'", "o_totalprice")
def _(spark, d):
    o = ad.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    return tables.coerce(o, "o_orderkey bigint, o_totalprice double").dropna(subset=["o_totalprice"])


ATOM_LINE = "ATOM  %5d %-4s %3s %1s%4d    "


@R.add("s04_atom_lines", "placed", "WITH f AS (SELECT traj_id, chain_id, resid, min(atom_id) a FROM placed WHERE frame = 0 GROUP BY ALL) SELECT f.traj_id, f.chain_id, f.resid, CASE resname WHEN 'ASP' THEN 'D' WHEN 'LYS' THEN 'K' WHEN 'PHE' THEN 'F' WHEN 'LEU' THEN 'L' WHEN 'GLU' THEN 'E' WHEN 'ARG' THEN 'R' ELSE 'Y' END aa, CAST(row_number() OVER (PARTITION BY f.traj_id, f.chain_id ORDER BY a) AS INTEGER) AS \"position\" FROM f JOIN atoms ON atom_id = a")
def residues(spark, d):
    p = ad.placed_atoms(spark, d).where("frame = 0")
    lines = p.select("traj_id", F.col("atom_id").alias("line_no"), F.format_string(ATOM_LINE, "atom_id", "name", "resname", "chain_id", "resid").alias("value"))
    return text_formats.parse_atom_lines(lines, "traj_id")


@R.add("s04_chain_sequences", "placed", "WITH f AS (SELECT traj_id, chain_id, resid, min(atom_id) a FROM placed WHERE frame = 0 GROUP BY ALL) SELECT f.traj_id, f.chain_id, string_agg(CASE resname WHEN 'ASP' THEN 'D' WHEN 'LYS' THEN 'K' WHEN 'PHE' THEN 'F' WHEN 'LEU' THEN 'L' WHEN 'GLU' THEN 'E' WHEN 'ARG' THEN 'R' ELSE 'Y' END, '' ORDER BY a) AS \"sequence\" FROM f JOIN atoms ON atom_id = a GROUP BY ALL")
def _(spark, d):
    return text_formats.chain_sequences(residues(spark, d), "traj_id").drop("resids")


@R.add("s05_numbered_loops", "", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END || 'C' cdr1, 'G' cdr2, 'W' || CASE WHEN p_size % 3 = 0 THEN 'Y' ELSE '' END cdr3 FROM part")
def _(spark, d):
    s = F.col("p_size")
    p = ad.table(spark, d, "part").select("p_partkey", F.lit("Q").alias("26"), F.when(s % 2 == 0, "A").otherwise("-").alias("27"), F.lit("C").alias("38"), F.lit("G").alias("60"), F.lit("W").alias("111"), F.when(s % 3 == 0, "Y").otherwise(" ").alias("111A"), F.lit("F").alias("118"))
    return text_formats.numbered_loops(p, ["p_partkey"], ["26", "27", "38", "60", "111", "111A", "118"])


@R.add("s06_fasta", "", "SELECT 'id' || CAST(p_partkey AS VARCHAR) || ' A*' || CAST(p_size AS VARCHAR) || ' x' AS header, upper(replace(p_name, ' ', '')) AS \"sequence\", 'HLA-A*' || CAST(p_size AS VARCHAR) allele, 'HLA-A' locus FROM part")
def _(spark, d):
    head = F.concat(F.lit("id"), F.col("p_partkey").cast("string"), F.lit(" A*"), F.col("p_size").cast("string"), F.lit(" x\n"))
    return text_formats.parse_fasta(ad.table(spark, d, "part").select(F.concat(head, F.upper(F.replace("p_name", F.lit(" "), F.lit("\n"))), F.lit("\n")).alias("value")))


@R.add("s07_inventory", "", "WITH g AS (SELECT o_custkey dir, count(*) FILTER (WHERE o_orderstatus='F') n_structure, count(*) FILTER (WHERE o_orderstatus='O') n_trajectory FROM orders GROUP BY 1) SELECT *, CASE WHEN n_structure = 0 OR n_trajectory = 0 THEN 'invalid' WHEN n_structure > 1 OR n_trajectory > 1 THEN 'ambiguous' ELSE 'valid' END status FROM g")
def _(spark, d):
    o = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("dir"), F.when(F.col("o_orderstatus") == "F", "md.gro").when(F.col("o_orderstatus") == "O", "md.xtc").otherwise("log").alias("name"))
    return tables.inventory(o, {"structure": "\\.gro$", "trajectory": "\\.xtc$"}).drop("messages")


@R.add("s08_flat_export", "replicas", "SELECT complex_id, string_agg(label, ';' ORDER BY label) labels, count(*) n FROM replicas GROUP BY 1")
def _(spark, d):
    g = ad.replicas(spark, d).groupBy("complex_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("label")).alias("labels"))
    return tables.flat(g, ["complex_id", "labels"])
