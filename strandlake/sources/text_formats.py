"""Line formats: xvg series, fixed-width atom lines, FASTA, numbered-sequence tables. Parsers take DataFrames of lines, readers make them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# One-letter codes of residue names.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K",
    "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "HSD": "H", "HSE": "H", "HSP": "H",
    "HID": "H", "HIE": "H", "HIP": "H", "CYX": "C", "CYM": "C", "ASH": "D", "GLH": "E", "LYN": "K", "SEC": "U", "PYL": "O",
}
#: Loops of the unique numbering, inclusive.
LOOPS = {"cdr1": (27, 38), "cdr2": (56, 65), "cdr3": (105, 117)}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value); line numbers grow within a file, with gaps."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def parse_xvg(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, time, value) of each data line; comments, directives and lines without two numbers are skipped."""
    part = F.split(F.trim("value"), "\\s+")
    data = lines.where(~F.trim("value").rlike("^[#@]")).select(key, F.get(part, F.lit(0)).try_cast("double").alias("time"), F.get(part, F.lit(1)).try_cast("double").alias("value"))
    return data.where("time IS NOT NULL AND value IS NOT NULL")


def parse_atom_lines(lines: DataFrame, key: str = "file", order: str = "line_no") -> DataFrame:
    """(key, chain_id, resid, aa, position) of the residues in ATOM and HETATM lines: the first line of a residue decides, unknown names are X."""
    v = F.col("value")
    codes = F.create_map(*(F.lit(x) for kv in ONE_LETTER.items() for x in kv))
    atoms = lines.where(v.startswith("ATOM") | v.startswith("HETATM")).select(
        key, order, F.substring(v, 22, 1).alias("chain_id"), F.trim(F.substring(v, 23, 4)).try_cast("int").alias("resid"), F.trim(F.substring(v, 18, 3)).alias("resname")
    )
    first = atoms.where("resid IS NOT NULL").groupBy(key, "chain_id", "resid").agg(F.min(order).alias("_at"), F.min_by("resname", order).alias("resname"))
    place = F.row_number().over(W.partitionBy(key, "chain_id").orderBy("_at"))
    return first.select(key, "chain_id", "resid", F.coalesce(codes[F.col("resname")], F.lit("X")).alias("aa"), place.alias("position"))


def chain_sequences(residues: DataFrame, key: str = "file") -> DataFrame:
    """(key, chain_id, sequence, resids) in order of position."""
    rows = F.array_sort(F.collect_list(F.struct("position", "resid", "aa")))
    return residues.groupBy(key, "chain_id").agg(rows.alias("r")).select(key, "chain_id", F.array_join("r.aa", "").alias("sequence"), F.col("r.resid").alias("resids"))


def parse_fasta(records: DataFrame, fallback_locus: str = "A") -> DataFrame:
    """(header, sequence, allele, locus) of records cut at '>' (column value, behind the sign)."""
    head = F.trim(F.split("value", "\n")[0])
    seq = F.when(F.col("value").contains("\n"), F.regexp_replace(F.regexp_replace("value", "^[^\n]*", ""), "\\s", "")).otherwise("")
    token = F.get(F.filter(F.split(head, "\\s+"), lambda x: x.contains("*")), F.lit(0))
    allele = F.coalesce(token, F.lit(f"{fallback_locus}*unknown"))
    hla = lambda c: F.when(c.startswith("HLA-"), c).otherwise(F.concat(F.lit("HLA-"), c))
    out = records.where(F.trim("value") != "").select(head.alias("header"), seq.alias("sequence"), allele.alias("_a"))
    return out.select("header", "sequence", hla(F.col("_a")).alias("allele"), hla(F.substring_index("_a", "*", 1)).alias("locus"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", ">").text(path))


def numbered_loops(table: DataFrame, id_cols: list[str], positions: list[str]) -> DataFrame:
    """Loop strings of a wide numbered table: columns named by position (with insertion letters), gaps left out, in column order."""
    long = table.unpivot(id_cols, positions, "position", "aa").where("aa NOT IN ('-', '', ' ')")
    order = F.create_map(*(F.lit(x) for i, p in enumerate(positions) for x in (p, i)))
    long = long.withColumns({"_o": order[F.col("position")], "_n": F.regexp_extract("position", "(\\d+)", 1).try_cast("int")})
    text = lambda lo, hi: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n").between(lo, hi), F.struct("_o", "aa")))), lambda s: s["aa"]), "")
    return table.select(*id_cols).join(long.groupBy(*id_cols).agg(*(text(*r).alias(n) for n, r in LOOPS.items())), id_cols, "left").na.fill("", list(LOOPS))
