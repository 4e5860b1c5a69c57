"""Text rules, manifest rows and role assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Keywords by category, looked for in lower-case text.
VIRAL = (
    "virus", "viral", "hiv", "influenza", "coronavirus", "sars-cov", "sars ", "herpesvirus", "epstein", "barr", "hepatitis", "cytomegalovirus", "retrovirus",
    "lentivirus", "arenavirus", "papillomavirus", "orthohepacivirus", "choriomeningitis", "lcmv", "htlv", "tax peptide", "tax(", "tax ", "hcv ", "ebv ",
    "ebv,", "ebv-", "ebna", "cmv ", "hcmv", "pp65", "gpul40", "ul40", "bzlf1", "nuclear antigen", "nucleocapsid", "trans-activator",
)
BACTERIAL = (
    "mycobacterium", "bacteri", "tuberculosis", "salmonella", "listeria", "escherichia", "streptococc", "staphylococc", "borrelia", "yersinia", "klebsiella",
    "pseudomonas", "clostrid",
)
TUMOR = ("ny-eso", "cancer/testis", "cancer testis", "mart-1", "mart1", "melan", "melanoma", "gp100", "mage", "wt1", "telomerase", "hud", "tumor", "tumour")
SYNTHETIC = ("mimotope", "synthetic", "construct")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def antigen_category(organism: Column, name: Column, host: Column) -> Column:
    """viral, bacterial, tumor/self, murine, synthetic, other or null: by the name's keywords, else the organism, else the host."""
    n, o, h = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (name, organism, host))
    by_host = F.when(h.contains("homo sapiens"), "tumor/self").when(h.contains("mus musculus") | h.contains("mouse"), "murine")
    by_organism = (
        F.when(_any(o, ("synthetic", "construct")), "synthetic")
        .when(_any(o, VIRAL), "viral")
        .when(_any(o, BACTERIAL), "bacterial")
        .when(o.contains("homo sapiens"), "tumor/self")
        .when(o.contains("mus musculus") | o.contains("mouse"), "murine")
        .otherwise("other")
    )
    return (
        F.when(_any(n, VIRAL), "viral")
        .when(_any(n, BACTERIAL), "bacterial")
        .when(_any(n, TUMOR), "tumor/self")
        .when(_any(n, SYNTHETIC), "synthetic")
        .when(n.contains("self"), "tumor/self")
        .when(o != "", by_organism)
        .otherwise(by_host)
    )


def antigen_name(name: Column, sequence: Column) -> Column:
    """A name that only repeats the sequence is none."""
    return F.when(F.upper(F.replace(name, F.lit(" "), F.lit(""))) == F.upper(sequence), F.lit(None)).otherwise(name)


def normalize_allele(text: Column) -> Column:
    """Free text to HLA-A*02:01 form: gene with two or four digits, else a bare gene of A to E or G; null without one."""
    full = "(?i)HLA[- ]?([A-Z]+)\\d?\\*?\\s*(\\d{2})(\\d{2})?"
    bare = "(?i)\\bHLA[- ]([A-EG])\\b\\*?\\s*(\\d{2})?(\\d{2})?"
    g = lambda p, i: F.regexp_extract(text, p, i)
    one = F.concat(F.lit("HLA-"), F.upper(g(full, 1)), F.lit("*"), g(full, 2), F.when(g(full, 3) != "", F.concat(F.lit(":"), g(full, 3))).otherwise(""))
    two = F.concat(
        F.lit("HLA-"), F.upper(g(bare, 1)), F.when(g(bare, 2) != "", F.concat(F.lit("*"), g(bare, 2), F.when(g(bare, 3) != "", F.concat(F.lit(":"), g(bare, 3))).otherwise(""))).otherwise("")
    )
    return F.when(text.rlike(full), one).when(text.rlike(bare), two)


def entity_role(description: Column, residues: Column) -> Column:
    d = F.lower(F.coalesce(description, F.lit("")))
    receptor = _any(d, ("t-cell", "t cell", "tcr", "receptor"))
    return (
        F.when(_any(d, ("beta-2", "b2m", "microglobulin")), "b2m")
        .when(_any(d, ("histocompatibility", "hla", "mhc", "h-2", "class i")), "mhc")
        .when(d.contains("alpha") & receptor, "tcr_alpha")
        .when(d.contains("beta") & receptor, "tcr_beta")
        .when(_any(d, ("t-cell receptor", "t cell receptor", "tcr")), "tcr")
        .when(d.contains("peptide") | (residues <= 30), "peptide")
        .otherwise("other")
    )


def host_species(entities: DataFrame, key: str, roles: tuple[str, ...] = ("b2m", "mhc", "tcr_alpha", "tcr_beta", "tcr")) -> DataFrame:
    """Organism of the first present role."""
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    return entities.where(F.col("role").isin(*roles) & F.col("organism").isNotNull()).groupBy(key).agg(F.min_by("organism", F.struct(rank, "organism")).alias("host"))


def resolve_allele(df: DataFrame, sources: list[str]) -> DataFrame:
    """The first source that has an allele, and its name."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    allele, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(sources):
        allele, name = F.when(has(c), F.col(c)).otherwise(allele), F.when(has(c), F.lit(c)).otherwise(name)
    return df.withColumns({"allele": allele, "allele_source": name})


def best_typed_allele(candidates: DataFrame, key: str, identity: float = 0.98, coverage: float = 0.8) -> DataFrame:
    """Of the candidates tied at the largest identity, the lowest by locus, group, protein; only confident ones above the gates."""
    ok = candidates.where((F.col("identity") >= identity) & (F.col("coverage") >= coverage) & (F.col("confidence") == "high"))
    top = ok.withColumn("_m", F.max("identity").over(W.partitionBy(key))).where("identity = _m")
    part = lambda i: F.regexp_extract("allele", "([A-Z]+)\\*(\\d+):(\\d+)", i)
    rank = F.struct(part(1).alias("l"), part(2).cast("int").alias("g"), part(3).cast("int").alias("p"))
    return top.groupBy(key).agg(F.min(rank).alias("r"), F.max("identity").alias("identity")).select(key, F.format_string("HLA-%s*%02d:%02d", "r.l", "r.g", "r.p").alias("allele"), "identity")


def chain_roles(chains: DataFrame, key: str) -> DataFrame:
    """Roles by annotation, else size: peptide the shortest of 4 to 25 residues, heavy chain the largest, the light chain one of 80 to 130 residues."""
    free = F.col("role").isNull()
    short = free & F.col("n_residues").between(4, 25)
    light = free & F.col("n_residues").between(80, 130)
    w = W.partitionBy(key)
    first = lambda cond, order: F.row_number().over(w.orderBy(F.when(cond, 0).otherwise(1), *order)) == 1
    r = chains.withColumns(
        {
            "_p": first(short, ["n_residues", "chain_id"]) & short,
            "_m": first(free, [F.desc("n_residues"), "chain_id"]) & free,
            "_b": first(light, ["chain_id"]) & light,
        }
    )
    return r.withColumn("role", F.coalesce("role", F.when(F.col("_p"), "peptide").when(F.col("_m"), "mhc").when(F.col("_b"), "b2m").otherwise("other"))).drop("_p", "_m", "_b")


def receptor_type(chains: DataFrame, key: str) -> DataFrame:
    """gd if any chain's locus is TRG, else ab; each slot's chain: the canonical locus (TRA, TRB) before others, then the first."""
    order = F.struct((~F.col("locus").isin("TRA", "TRB")).alias("o"), F.col("chain_id"))
    slots = chains.groupBy(key, "slot").agg(F.min(order).alias("m")).groupBy(key).pivot("slot", ["alpha", "beta"]).agg(F.first("m.chain_id"))
    kind = chains.groupBy(key).agg(F.when(F.bool_or(F.col("locus") == "TRG"), "gd").otherwise("ab").alias("receptor_type"))
    return kind.join(slots, key)


def feature_encoding(df: DataFrame, angle: str, share: str, a: str, b: str, total: str) -> DataFrame:
    """Sine and cosine of an angle, clipped logit of a share, log ratio, ratio per residue."""
    from strandlake.functions.labels import clipped_logit

    return df.withColumns(
        {
            "angle_sin": F.sin(F.radians(angle)),
            "angle_cos": F.cos(F.radians(angle)),
            "share_logit": clipped_logit(F.col(share)),
            "log_ratio": F.log(F.col(a) / F.nullif(F.col(b), F.lit(0.0))),
            "per_unit": F.try_divide(F.col(a), F.col(total)),
        }
    )


def segments_json(segments: Column) -> Column:
    return F.to_json(F.transform(segments, lambda s: F.array(s["start"], s["end"])))


def parse_segments(text: Column) -> Column:
    """Pairs of an encoded list; null and garbage give none."""
    return F.filter(F.coalesce(F.from_json(text, "array<array<int>>"), F.array().cast("array<array<int>>")), lambda s: F.size(s) == 2)
