"""Label ladders and small arithmetic as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stability_label(occupancy: Column, longest: Column, segments: Column) -> Column:
    """stable, transient or intermediate, by occupancy, longest fraction and number of segments (nulls count 0)."""
    occ, run, n = (F.coalesce(c, F.lit(0)) for c in (occupancy, longest, segments))
    return F.when((occ >= 0.30) & (run >= 0.10), "stable").when((occ < 0.10) & (run < 0.03) & (n >= 2), "transient").otherwise("intermediate")


def rotamer_label(angle: Column) -> Column:
    """g+, g- or t by the 120-degree sector of an angle wrapped to [-180, 180)."""
    wrapped = F.pmod(angle + 180.0, F.lit(360.0)) - 180.0
    return F.when((wrapped >= 0) & (wrapped < 120), "g+").when((wrapped >= -120) & (wrapped < 0), "g-").otherwise("t")


def effect_size_word(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def burial_state(delta: Column, relative: Column, unbound: Column, core: float = 10.0, least: float = 10.0, rim: float = 0.3) -> Column:
    """unknown, core (little surface unbound), exposed (little lost), interface_core or interface_rim."""
    return (
        F.when(delta.isNull() | relative.isNull(), "unknown")
        .when(unbound < core, "core")
        .when(delta < least, "exposed")
        .when(relative < rim, "interface_core")
        .otherwise("interface_rim")
    )


def acute_degrees(cosine: Column) -> Column:
    """The acute angle between two axes whose unit vectors' dot product is ``cosine``."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(cosine))))


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dihedral_degrees(p: list[list[Column]]) -> Column:
    """Signed torsion of four points, in degrees."""
    sub = lambda a, b: [x - y for x, y in zip(a, b)]
    b1, b2, b3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b1, b2), cross(b2, b3)
    y = dot(cross(n1, n2), b2) / F.sqrt(dot(b2, b2))
    return F.degrees(F.atan2(y, dot(n1, n2)))


def coarse_allele(text: Column) -> Column:
    """The locus in front of the star."""
    return F.split(text, "\\*")[0]


def run_label(traj_id: Column) -> Column:
    """Behind the last underscore."""
    return F.element_at(F.split(traj_id, "_"), -1)


def clipped_logit(p: Column, low: float = 0.02, high: float = 0.98) -> Column:
    x = F.greatest(F.lit(low), F.least(F.lit(high), p))
    return F.log(x / (1 - x))


def list_text(values: Column) -> Column:
    """List columns leave as one text joined by semicolons."""
    return F.array_join(values, ";")
