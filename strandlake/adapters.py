"""Canonical tables as views of the driver's tables, in Spark; ``ADAPTER_SQL`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.session import ship

# 21 points per frame, their chains, roles and names.
N_ATOMS = 21
SCALE = 20.0
RESNAMES = ("ASP", "LYS", "PHE", "LEU", "GLU", "ARG", "TYR")
NAMES = ("N", "H", "O")
ROLES = {"A": "HLA_alpha", "B": "beta2m", "C": "peptide", "D": "TCR_alpha", "E": "TCR_beta"}
#: chain, label, first and last residue
REGIONS = (("D", "CDR1", 56, 56), ("D", "CDR3", 57, 57), ("E", "CDR2", 58, 58), ("E", "CDR3", 59, 59))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("traj_id"), (F.row_number().over(order) - 1).cast("int").alias("frame"), "embedding"
    )


def frame_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per frame and atom."""
    point = F.expr(f"transform(sequence(0, {N_ATOMS - 1}), k -> struct(k as atom_id, embedding[3*k] as x, embedding[3*k+1] as y, embedding[3*k+2] as z))")
    return frames(spark, sf_dir).select("traj_id", "frame", F.inline(point)).select(
        "traj_id",
        "frame",
        (F.col("frame") * 200.0).alias("time_ps"),
        F.col("atom_id").cast("int").alias("atom_id"),
        *((F.lit(SCALE) * F.col(c).cast("double")).alias(c) for c in "xyz"),
    )


def atoms(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return spark.range(N_ATOMS).select(
        k.cast("int").alias("atom_id"),
        F.when(k <= 6, "A").when(k <= 8, "B").when(k <= 12, "C").when(k <= 16, "D").otherwise("E").alias("chain_id"),
        (50 + F.floor(k / 2)).cast("int").alias("resid"),
        pick(RESNAMES).alias("resname"),
        pick(NAMES).alias("name"),
        pick(NAMES).alias("element"),
        (10.0 + k * 7 % 20).cast("double").alias("bfactor"),
        F.lit(1.0).alias("mass"),
    )


def placed_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame atoms with their topology, a broadcast of the 21 fixed rows."""
    return frame_atoms(spark, sf_dir).join(F.broadcast(atoms(spark)), "atom_id")


def residues(spark: SparkSession) -> DataFrame:
    return atoms(spark).select("chain_id", "resid").distinct()


def _fixed(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A table of literals: Spark knows its size before it plans a join."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(repr, rows))} AS t({columns})")


def chains(spark: SparkSession) -> DataFrame:
    return _fixed(spark, ROLES.items(), "chain_id, role")


def regions(spark: SparkSession) -> DataFrame:
    return _fixed(spark, REGIONS, "chain_id, region, resid_start, resid_end")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pair was seen in which frame (day)."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").cast("string").alias("traj_id"),
            F.col("event_type").alias("pair_id"),
            F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("int").alias("frame"),
        )
        .distinct()
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("traj_id"),
        (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int").alias("frame"),
        (F.unix_micros(ts) / 1e6).alias("time_s"),
        "value",
    )


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of each customer, as replicas of a complex, numbered in order of time."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    numbered = t["orders"].withColumn("run", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return (
        numbered.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_custkey").alias("complex_id"),
            F.col("run").cast("long").alias("run"),
            F.col("o_totalprice").alias("crossing"),
            F.col("o_orderpriority").alias("label"),
            (F.col("o_orderstatus") == "F").alias("reversed_polarity"),
            F.col("c_mktsegment").alias("grp"),
            F.col("n_name").alias("host"),
            F.col("r_name").alias("locus"),
        )
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("traj_id"),
        F.when(flag == "A", "cdr1").when(flag == "N", "cdr2").otherwise("cdr3").alias("region"),
        F.when(status == "O", "peptide").otherwise("mhc").alias("partner"),
        F.when(F.col("l_partkey") % 2 == 0, "alpha").otherwise("beta").alias("chain"),
        (F.col("l_discount") * 10).alias("occupancy"),
        F.col("l_partkey").alias("partner_id"),
    )


# The same views in SQL: WITH entries, each with the ones it needs.
ADAPTER_SQL = {
    "frames": (
        (),
        """SELECT CAST(label AS VARCHAR) traj_id,
        CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) frame, embedding FROM embeddings""",
    ),
    "frame_atoms": (
        ("frames",),
        """SELECT f.traj_id, f.frame, CAST(f.frame*200.0 AS DOUBLE) time_ps, CAST(a.k AS INTEGER) atom_id,
        20.0*CAST(f.embedding[3*a.k+1] AS DOUBLE) x, 20.0*CAST(f.embedding[3*a.k+2] AS DOUBLE) y, 20.0*CAST(f.embedding[3*a.k+3] AS DOUBLE) z
        FROM frames f CROSS JOIN (SELECT unnest(range(0,21)) k) a""",
    ),
    "atoms": (
        (),
        """SELECT CAST(k AS INTEGER) atom_id,
        CASE WHEN k<=6 THEN 'A' WHEN k<=8 THEN 'B' WHEN k<=12 THEN 'C' WHEN k<=16 THEN 'D' ELSE 'E' END chain_id,
        CAST(50 + k//2 AS INTEGER) resid, ['ASP','LYS','PHE','LEU','GLU','ARG','TYR'][CAST(k%7 AS INTEGER)+1] resname,
        ['N','H','O'][CAST(k%3 AS INTEGER)+1] AS "name", ['N','H','O'][CAST(k%3 AS INTEGER)+1] AS element,
        CAST(10.0 + k*7%20 AS DOUBLE) bfactor, CAST(1.0 AS DOUBLE) mass FROM (SELECT unnest(range(0,21)) k)""",
    ),
    "placed": (("frame_atoms", "atoms"), "SELECT p.*, a.chain_id, a.resid, a.resname, a.name, a.element, a.bfactor, a.mass FROM frame_atoms p JOIN atoms a USING (atom_id)"),
    "residues": (("atoms",), "SELECT DISTINCT chain_id, resid FROM atoms"),
    "chains": ((), "SELECT * FROM (VALUES ('A','HLA_alpha'),('B','beta2m'),('C','peptide'),('D','TCR_alpha'),('E','TCR_beta')) t(chain_id, role)"),
    "regions": ((), "SELECT * FROM (VALUES ('D','CDR1',56,56),('D','CDR3',57,57),('E','CDR2',58,58),('E','CDR3',59,59)) t(chain_id, region, resid_start, resid_end)"),
    "presence": (
        (),
        """SELECT DISTINCT CAST(user_id AS VARCHAR) traj_id, event_type pair_id,
        CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) frame FROM events""",
    ),
    "series": (
        (),
        """SELECT CAST(user_id AS VARCHAR) traj_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) frame, epoch_us(ts)/1e6 time_s, value FROM events""",
    ),
    "replicas": (
        (),
        """SELECT o.o_custkey complex_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) run,
        o.o_totalprice crossing, o.o_orderpriority label, (o.o_orderstatus='F') reversed_polarity, c.c_mktsegment grp, n.n_name host, r.r_name locus
        FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey""",
    ),
    "contacts": (
        (),
        """SELECT l_suppkey traj_id, CASE l_returnflag WHEN 'A' THEN 'cdr1' WHEN 'N' THEN 'cdr2' ELSE 'cdr3' END region,
        CASE l_linestatus WHEN 'O' THEN 'peptide' ELSE 'mhc' END partner,
        CASE WHEN l_partkey%2=0 THEN 'alpha' ELSE 'beta' END chain, l_discount*10 occupancy, l_partkey partner_id FROM lineitem""",
    ),
}


def with_views(names: str, body: str) -> str:
    """``body`` behind WITH entries for the named views and all they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, sql = ADAPTER_SQL[name]
            for n in needs:
                add(n)
            done[name] = sql

    for n in names.split():
        add(n)
    if not done:
        return body.strip()
    entries = ",\n".join(f"{n} AS ({s})" for n, s in done.items())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {entries},\n{body[5:]}"
    return f"WITH {entries}\n{body}"
