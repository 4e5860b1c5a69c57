"""Distance joins between points, and the residue-pair tables built on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.kernels.neighbours import pairs_in_frames

KEYS = ("traj_id", "frame")


def _packed(points: DataFrame, keys: tuple[str, ...], *fields: Column) -> DataFrame:
    """A row per frame with the list ``p`` of its points. Nothing moves where the points are stored in buckets of ``keys`` (``sources.tables.save_frames``)."""
    return points.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("p"))


def _search(
    packed: DataFrame, keys: tuple[str, ...], sides: list[tuple[tuple[str, str], tuple[str, str]]], kinds: tuple[T.StructType, T.StructType], cutoff: float, strict: bool,
    box: tuple[float, float, float] | None, least_by: tuple[str, ...] = (), once_by: str | None = None,
) -> DataFrame:
    """Pairs within each row's points. ``sides``: for both, the flag that says who belongs to it and where in ``p`` its columns are; several are searched one after the other.

    ``least_by``: only the least distance per frame and these columns of both sides, found where the pairs are. ``once_by``: both sides are one, and each pair comes
    once, the lesser of this column first; pairs of equal ones are left out."""
    shown = [[f for f in kind if not least_by or f.name in least_by] for kind in kinds]
    fields = [T.StructField(f"{f.name}_{k + 1}", f.dataType) for k, fs in enumerate(shown) for f in fs]
    schema = T.StructType([*(packed.schema[k] for k in keys), *fields, T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def codes(s: pa.StructArray) -> np.ndarray:
        """Equal numbers for rows that are equal in ``least_by``."""
        out = np.zeros(len(s), np.int64)
        for c in least_by:
            code = pc.fill_null(s.field(c).dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.unique(out * (len(s) + 2) + code + 1, return_inverse=True)[1]
        return out

    def near(points: pa.StructArray, number: np.ndarray, pair: tuple[tuple[str, str], tuple[str, str]]) -> tuple:
        """(row of ``packed``, columns of the first, of the second, distance) of the pairs of two sides."""
        at, data, xyz = [], [], []
        for flag, place in pair if once_by is None else pair[:1]:
            rows = np.flatnonzero(points.field(flag).to_numpy(zero_copy_only=False))
            at.append(number[rows])
            data.append(points.field(place).take(pa.array(rows)))
            xyz.append(np.stack([data[-1].field(x).to_numpy(zero_copy_only=False) for x in "xyz"], 1))
        if once_by is None:
            i, j, d = pairs_in_frames(xyz[0], xyz[1], at[0], at[1], cutoff, strict, box)
        else:
            data.append(data[0])
            i, j, d = pairs_in_frames(xyz[0], None, at[0], None, cutoff, strict, box)
            value = data[0].field(once_by).to_numpy(zero_copy_only=False)
            i, j = np.where(value[i] <= value[j], i, j), np.where(value[i] <= value[j], j, i)
            differ = value[i] != value[j]
            i, j, d = i[differ], j[differ], d[differ]
        if least_by and len(i):
            one, two, frame = codes(data[0])[i], codes(data[1])[j], at[0][i]
            order = np.lexsort((d, two, one, frame))
            i, j, d, one, two, frame = (x[order] for x in (i, j, d, one, two, frame))
            first = np.append(True, (frame[1:] != frame[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
            i, j, d = i[first], j[first], d[first]
        return at[0][i], data[0].take(pa.array(i, pa.int64())), data[1].take(pa.array(j, pa.int64())), d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["p"]
            points, number = lists.flatten(), np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for pair in sides:
                row, *both, d = near(points, number, pair)
                columns = [b[k].take(pa.array(row)) for k in keys]
                columns += [s.field(f.name) for s, fs in zip(both, shown) for f in fs]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(d)], names=schema.names).cast(arrow)

    return packed.mapInArrow(run, schema)


def _own(df: DataFrame, keys: tuple[str, ...]) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in keys])


def capped_pairs(left: DataFrame, right: DataFrame, cutoff: float, strict: bool = False, keys: tuple[str, ...] = KEYS, box: tuple[float, float, float] | None = None) -> DataFrame:
    """Pairs of points of the same ``keys`` at a distance of at most ``cutoff`` (below it if ``strict``), with a periodic ``box`` by nearest image.

    A frame is the atoms of one structure: both tables move once, by their keys, no point is copied, and a task goes through its frames one after the other, large ones by cells.
    Columns become ``<name>_1`` and ``<name>_2`` beside the keys. Sides of one table are found by ``pairs_between`` in one pass."""
    kinds = [_own(df, keys) for df in (left, right)]
    tagged = [
        df.select(*keys, F.lit(k == 0).alias("one"), F.lit(k == 1).alias("two"), F.struct(*kinds[k].names).alias(f"r{k + 1}")) for k, df in enumerate((left, right))
    ]
    packed = _packed(tagged[0].unionByName(tagged[1], allowMissingColumns=True), keys, *(F.col(c) for c in ("one", "two", "r1", "r2")))
    return _search(packed, keys, [(("one", "r1"), ("two", "r2"))], tuple(kinds), cutoff, strict, box)


def pairs_between(
    points: DataFrame, side_1: Column, side_2: Column, cutoff: float, columns: tuple[str, ...], strict: bool = False, keys: tuple[str, ...] = KEYS,
    box: tuple[float, float, float] | None = None, least_by: tuple[str, ...] = (), also: tuple[Column, Column] | None = None,
) -> DataFrame:
    """``capped_pairs`` of two selections of one table, read and moved once; a point may be in both. ``columns``: those of the result, x, y and z included.

    ``least_by``: only the least distance per frame and these columns of both sides. ``also``: a second kind of pair, searched in the same pass; its first and second selection."""
    flags = [F.coalesce(c, F.lit(False)) for c in (side_1, side_2, *(also or ()))]
    names = ["one", "two", "three", "four"][: len(flags)]
    chosen = points.select(*keys, F.struct(*columns).alias("r"), *(f.alias(n) for f, n in zip(flags, names))).where(" OR ".join(names))
    kind = _own(points.select(*columns), ())
    packed = _packed(chosen, keys, *(F.col(c) for c in (*names, "r")))
    sides = [(("one", "r"), ("two", "r")), (("three", "r"), ("four", "r"))]
    return _search(packed, keys, sides[: len(names) // 2], (kind, kind), cutoff, strict, box, least_by)


def pairs_once(
    points: DataFrame, cutoff: float, columns: tuple[str, ...], once_by: str = "atom_id", strict: bool = False, keys: tuple[str, ...] = KEYS, box: tuple[float, float, float] | None = None, least_by: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs of different points of one table, each searched and returned once: the lesser ``once_by`` first, equal ones left out."""
    kind = _own(points.select(*columns), ())
    packed = _packed(points.select(*keys, F.struct(*columns).alias("r")), keys, F.lit(True).alias("one"), F.col("r"))
    return _search(packed, keys, [(("one", "r"), ("one", "r"))], (kind, kind), cutoff, strict, box, least_by, once_by)


POSITION = ("chain_id", "resid", "x", "y", "z")
RESIDUE = ("chain_id", "resid")
RESIDUE_PAIR = ("chain_id_1", "resid_1", "chain_id_2", "resid_2")


def residue_minima(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The least atom distance of each residue pair in each frame."""
    return pairs.groupBy(*keys, *RESIDUE_PAIR).agg(F.min("distance").alias("distance"))


def pair_table(events: DataFrame, n_frames: DataFrame, family: str, min_frequency: float = 0.0) -> DataFrame:
    """The residue-pair table of per-frame events (traj_id, frame, residue pair, distance).

    ``n_frames``: (traj_id, total_frames), the sampled frames of each trajectory; small, joined after the reduction."""
    from strandlake.operators.persistence import segments_of

    table = events.groupBy("traj_id", *RESIDUE_PAIR).agg(F.sort_array(F.collect_set("frame")).alias("frames"), F.min("distance").alias("min_distance"))
    table = table.withColumn("contact_frames", F.size("frames").cast("long")).join(n_frames, "traj_id")
    table = table.withColumns({"contact_frequency": F.col("contact_frames") / F.col("total_frames"), "interaction_family": F.lit(family)})
    return segments_of(table.where(F.col("contact_frequency") >= min_frequency), "frames").drop("frames")


def contact_frequencies(points: DataFrame, side_1: Column, side_2: Column, cutoff: float = 4.5, stride: int = 1, heavy_only: bool = True, min_frequency: float = 0.0) -> DataFrame:
    """Residue contacts between two selections: a contact is a least heavy-atom distance below ``cutoff``."""
    sampled = points.where(F.col("frame") % stride == 0)
    totals = sampled.groupBy("traj_id").agg(F.countDistinct("frame").alias("total_frames"))
    if heavy_only:
        sampled = sampled.where(~F.col("name").startswith("H"))
    return pair_table(pairs_between(sampled, side_1, side_2, cutoff, POSITION, strict=True, least_by=RESIDUE), totals, "contact", min_frequency)


def salt_bridges(points: DataFrame, side_1: Column, side_2: Column, cutoff: float = 4.0) -> DataFrame:
    """Acidic oxygens against basic nitrogens, in both directions."""
    acid = F.col("resname").isin("ASP", "GLU") & (F.col("element") == "O")
    base = F.col("resname").isin("LYS", "ARG", "HIS") & (F.col("element") == "N")
    return _two_way(points, side_1, side_2, acid, base, cutoff, "salt_bridge")


def _two_way(points: DataFrame, side_1: Column, side_2: Column, kind_a: Column, kind_b: Column, cutoff: float, family: str) -> DataFrame:
    totals = points.groupBy("traj_id").agg(F.countDistinct("frame").alias("total_frames"))
    events = pairs_between(points, side_1 & kind_a, side_2 & kind_b, cutoff, POSITION, least_by=RESIDUE, also=(side_1 & kind_b, side_2 & kind_a))
    return pair_table(residue_minima(events), totals, family)


HYDROPHOBIC = ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO", "TYR")


def hydrophobic_contacts(points: DataFrame, side_1: Column, side_2: Column, cutoff: float = 4.5, backbone: tuple[str, ...] = ("N", "CA", "C", "O")) -> DataFrame:
    """Side-chain heavy atoms of hydrophobic residues on both sides."""
    kind = F.col("resname").isin(*HYDROPHOBIC) & ~F.col("name").isin(*backbone)
    totals = points.groupBy("traj_id").agg(F.countDistinct("frame").alias("total_frames"))
    return pair_table(pairs_between(points, side_1 & kind, side_2 & kind, cutoff, POSITION, least_by=RESIDUE), totals, "hydrophobic")


def hydrogen_bonds(points: DataFrame, side_1: Column, side_2: Column, bond: float = 1.2, reach: float = 3.5, angle: float = 150.0) -> DataFrame:
    """Donor-hydrogen-acceptor triples between the sides: hydrogen within ``bond`` of a donor of its residue, donor within ``reach``
    of the acceptor, angle at the hydrogen of at least ``angle`` degrees. Per residue pair (donor's first): events, least distance, mean angle."""
    cols = ["traj_id", "frame", "chain_id", "resid", "atom_id", "x", "y", "z"]
    heavy, hydrogen = F.col("element").isin("N", "O"), F.col("element") == "H"
    sided = points.withColumn("side", F.when(side_1, 1).when(side_2, 2)).where("side IS NOT NULL")
    cols.append("side")
    donors = sided.where(heavy).select(cols)
    res = ["traj_id", "frame", "chain_id", "resid"]
    h = sided.where(hydrogen).select(*res, F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("z").alias("hz"), F.col("atom_id").alias("h_id"))
    sq = lambda a, b: sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b)), F.lit(0.0))
    bonded = donors.join(h, res).where(F.sqrt(sq(("x", "y", "z"), ("hx", "hy", "hz"))) <= bond)
    near = capped_pairs(bonded, sided.where(heavy).select(cols), reach).where("side_1 <> side_2")
    v1 = [F.col(f"{a}_1") - F.col(f"h{a}_1") for a in "xyz"]
    v2 = [F.col(f"{a}_2") - F.col(f"h{a}_1") for a in "xyz"]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    cos = dot(v1, v2) / F.sqrt(dot(v1, v1) * dot(v2, v2))
    events = near.withColumn("angle", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))).where(F.col("angle") >= angle)
    totals = points.groupBy("traj_id").agg(F.countDistinct("frame").alias("total_frames"))
    return (
        events.groupBy("traj_id", *RESIDUE_PAIR)
        .agg(F.countDistinct("frame").alias("contact_frames"), F.count("*").alias("n_events"), F.min("distance").alias("min_distance"), F.avg("angle").alias("mean_angle"))
        .join(totals, "traj_id")
        .withColumn("contact_frequency", F.col("contact_frames") / F.col("total_frames"))
    )


def rrcs(points: DataFrame, pairs: DataFrame, full: float = 3.23, none: float = 4.63, backbone: tuple[str, ...] = ("N", "CA", "C", "O")) -> DataFrame:
    """Residue-residue contact score of each specified pair in each frame where it is above zero: over heavy atom pairs, 1 up to ``full``, 0 from
    ``none``, linear between. Near in sequence (same chain, under 5 apart) backbone atoms don't count, where both sides keep an atom.
    ``pairs``: (chain_id_1, resid_1, chain_id_2, resid_2); only atoms of their residues are searched."""
    res = ["chain_id", "resid"]
    heavy = points.where(F.col("element") != "H")
    spec = pairs.distinct()
    of = lambda t: spec.select(F.col(f"chain_id_{t}").alias("chain_id"), F.col(f"resid_{t}").alias("resid")).distinct()
    has_side = heavy.where(~F.col("name").isin(*backbone)).select(*res).distinct().withColumn("has", F.lit(True))
    for t in ("1", "2"):
        spec = spec.join(has_side.select(F.col("chain_id").alias(f"chain_id_{t}"), F.col("resid").alias(f"resid_{t}"), F.col("has").alias(f"has_{t}")), [f"chain_id_{t}", f"resid_{t}"], "left")
    near = (F.col("chain_id_1") == F.col("chain_id_2")) & (F.abs(F.col("resid_1") - F.col("resid_2")) < 5)
    spec = spec.select(*RESIDUE_PAIR, F.coalesce(near & F.col("has_1") & F.col("has_2"), F.lit(False)).alias("side_only"))
    cols = ["traj_id", "frame", "chain_id", "resid", "name", "x", "y", "z"]
    one, two = (heavy.select(cols).join(of(t), res, "left_semi") for t in ("1", "2"))
    found = capped_pairs(one, two, none, strict=True).join(spec, list(RESIDUE_PAIR))
    bb = F.col("name_1").isin(*backbone) | F.col("name_2").isin(*backbone)
    score = F.when(F.col("distance") <= full, 1.0).otherwise((F.lit(none) - F.col("distance")) / (none - full))
    sums = found.where(~(F.col("side_only") & bb)).groupBy("traj_id", "frame", *RESIDUE_PAIR).agg(F.sum(score).alias("score"))
    return sums.where("score > 0")


def with_zeros(scores: DataFrame, frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every frame (traj_id, frame) with every specified pair, 0 where there is no score: the full table, for those who want it written out."""
    every = frames.select("traj_id", "frame", F.lit(1).alias("_all")).join(pairs.distinct().withColumn("_all", F.lit(1)), "_all").drop("_all")
    return every.join(scores, ["traj_id", "frame", *RESIDUE_PAIR], "left").na.fill(0.0, ["score"])


def rrcs_summary(scores: DataFrame, n_frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each trajectory and specified pair, from scores above zero alone: ``n_frames`` (traj_id, total_frames) says how many zeros there are."""
    g = scores.groupBy("traj_id", *RESIDUE_PAIR).agg(F.sum("score").alias("s"), F.sort_array(F.collect_list("score")).alias("v"), F.count("*").alias("nonzero_frames"))
    every = n_frames.withColumn("_all", F.lit(1)).join(pairs.distinct().withColumn("_all", F.lit(1)), "_all").drop("_all").join(g, ["traj_id", *RESIDUE_PAIR], "left")
    k, n = F.coalesce("nonzero_frames", F.lit(0)), F.col("total_frames")
    # the scores sorted behind n - k zeros: the two middle places
    place = lambda i: F.when(i < n - k, 0.0).otherwise(F.get("v", (i - (n - k)).cast("int")))
    median = (place(F.floor((n - 1) / 2)) + place(F.floor(n / 2))) / 2
    return every.select(
        "traj_id", *RESIDUE_PAIR, (F.coalesce("s", F.lit(0.0)) / n).alias("mean_rrcs"), median.alias("median_rrcs"), F.coalesce(F.element_at("v", -1), F.lit(0.0)).alias("max_rrcs"),
        k.cast("long").alias("nonzero_frames"), (k / n).alias("nonzero_fraction"),
    )


# Radii of the elements, in angstrom.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "H": 1.2}


def sphere_burial(points: DataFrame, probe: float = 1.4, other: float = 1.5) -> DataFrame:
    """Surface of all atoms' spheres, what overlapping pairs bury of it (the smaller sphere's surface times the overlap's share of both radii), and the rest, per frame."""
    radius = F.coalesce(F.create_map(*(F.lit(x) for kv in RADII.items() for x in kv))[F.col("element")], F.lit(other)) + probe
    p = points.select(*KEYS, "atom_id", "x", "y", "z", radius.alias("r"))
    total = p.groupBy(*KEYS).agg((4 * math.pi * F.sum(F.col("r") * F.col("r"))).alias("total_area"), F.count("*").alias("n_atoms"))
    reach = 2 * (max(*RADII.values(), other) + probe)
    both = F.col("r_1") + F.col("r_2")
    smaller = F.least("r_1", "r_2")
    pairs = pairs_once(p, reach, ("atom_id", "x", "y", "z", "r"), strict=True).where(F.col("distance") < both)
    buried = pairs.groupBy(*KEYS).agg(F.sum(4 * math.pi * smaller * smaller * (both - F.col("distance")) / both).alias("buried_area"))
    out = total.join(buried, list(KEYS), "left").withColumn("buried_area", F.coalesce("buried_area", F.lit(0.0)))
    return out.select(*KEYS, "n_atoms", "total_area", "buried_area", F.greatest(F.lit(0.0), F.col("total_area") - F.col("buried_area")).alias("accessible_area"), (F.col("buried_area") / F.col("total_area")).alias("burial_fraction"))


def atom_contact_map(points: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Atom pairs i < j of one structure per key, closer than ``cutoff``."""
    return pairs_once(points, cutoff, ("atom_id", *POSITION), strict=True)


def residue_contact_map(points: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Residue pairs, the first before the second in (chain, residue) order, by least atom distance below ``cutoff``."""
    order = F.dense_rank().over(W.partitionBy(*KEYS).orderBy("chain_id", "resid"))  # of a structure's residues
    return pairs_once(points.withColumn("_residue", order), cutoff, (*POSITION, "_residue"), "_residue", strict=True, least_by=RESIDUE)


def contact_counts(residues: DataFrame, contact_map: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Contacts of every residue, and their share of the other residues."""
    both = contact_map.select(*keys, F.explode(F.array(F.struct(F.col("chain_id_1").alias("chain_id"), F.col("resid_1").alias("resid")), F.struct(F.col("chain_id_2").alias("chain_id"), F.col("resid_2").alias("resid")))).alias("r"))
    n = both.groupBy(*keys, "r.chain_id", "r.resid").agg(F.count("*").alias("n_contacts"))
    total = residues.groupBy(*keys).agg(F.count("*").alias("n_residues"))
    return (
        residues.join(n, [*keys, "chain_id", "resid"], "left")
        .join(total, list(keys))
        .select(*keys, "chain_id", "resid", F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"), F.try_divide(F.coalesce("n_contacts", F.lit(0)).cast("double"), (F.col("n_residues") - 1).cast("double")).alias("fraction"))
    )


def long_range(contact_map: DataFrame, residues: DataFrame, separation: int = 5) -> DataFrame:
    """Residue contacts at least ``separation`` apart in the order of all residues."""
    # the residue table of one topology: a few hundred rows, ordered once
    index = residues.select("chain_id", "resid").distinct().withColumn("i", F.dense_rank().over(W.orderBy("chain_id", "resid")))
    out = contact_map
    for t in ("1", "2"):
        out = out.join(index.select(F.col("chain_id").alias(f"chain_id_{t}"), F.col("resid").alias(f"resid_{t}"), F.col("i").alias(f"i_{t}")), [f"chain_id_{t}", f"resid_{t}"])
    return out.where(F.col("i_2") - F.col("i_1") >= separation)


def contact_number(points: DataFrame, side_1: Column, side_2: Column, cutoff: float = 4.5) -> DataFrame:
    """Atom pairs between the sides below ``cutoff``, in every frame."""
    n = pairs_between(points, side_1, side_2, cutoff, ("x", "y", "z"), strict=True).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return points.select(*KEYS).distinct().join(n, list(KEYS), "left").select(*KEYS, F.coalesce("n", F.lit(0)).alias("contact_number"))


def native_contacts(points: DataFrame, side_1: Column, side_2: Column, cutoff: float = 4.5, beta: float = 5.0, lam: float = 1.8, least: int = 3) -> DataFrame:
    """Per frame: the share of frame 0's residue contacts kept (fnat), and the soft share q with steepness ``beta`` per angstrom.

    Trajectories with fewer than ``least`` native contacts give no rows. All distances of native pairs are taken, so the
    join is on the pairs of frame 0, not on space."""
    cols = ["traj_id", "frame", "chain_id", "resid", "x", "y", "z"]
    a, b = points.where(side_1).select(cols), points.where(side_2).select(cols)
    native = pairs_between(points.where("frame = 0"), side_1, side_2, cutoff, POSITION, strict=True, least_by=RESIDUE).select("traj_id", *RESIDUE_PAIR, F.col("distance").alias("d0"))
    enough = native.groupBy("traj_id").agg(F.count("*").alias("n_native")).where(F.col("n_native") >= least)
    native = native.join(enough, "traj_id")
    one = native.join(a.select("traj_id", "frame", F.col("chain_id").alias("chain_id_1"), F.col("resid").alias("resid_1"), *(F.col(c).alias(f"{c}1") for c in "xyz")), ["traj_id", "chain_id_1", "resid_1"])
    two = one.join(b.select("traj_id", "frame", F.col("chain_id").alias("chain_id_2"), F.col("resid").alias("resid_2"), *(F.col(c).alias(f"{c}2") for c in "xyz")), ["traj_id", "frame", "chain_id_2", "resid_2"])
    square = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    least_d = two.groupBy("traj_id", "frame", *RESIDUE_PAIR, "d0", "n_native").agg(F.min(F.sqrt(square)).alias("d"))
    return least_d.groupBy("traj_id", "frame", "n_native").agg(
        F.avg((F.col("d") < cutoff).cast("double")).alias("fnat"), F.avg(1.0 / (1.0 + F.exp(beta * (F.col("d") - lam * F.col("d0"))))).alias("q")
    )


def persistent_network(points: DataFrame, correlation: DataFrame, cutoff: float = 10.0, share: float = 0.75, floor: float = 1e-6) -> DataFrame:
    """Edges between atoms within ``cutoff`` in at least ``share`` of the frames, weighted by their absolute correlation (i, j, v), with
    length -ln of it."""
    frames = points.groupBy("traj_id").agg(F.countDistinct("frame").alias("n"))
    near = pairs_once(points, cutoff, ("atom_id", "x", "y", "z")).groupBy("traj_id", F.col("atom_id_1").alias("i"), F.col("atom_id_2").alias("j")).agg(F.count("*").alias("m"))
    kept = near.join(frames, "traj_id").where(F.col("m") / F.col("n") >= share)
    w = F.abs(F.col("v"))
    return kept.join(correlation, ["traj_id", "i", "j"]).where(w >= floor).select("traj_id", "i", "j", (F.col("m") / F.col("n")).alias("occupancy"), w.alias("weight"), (-F.log(w)).alias("length"))
