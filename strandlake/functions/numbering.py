"""Numbering of variable domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regions of the unique numbering, inclusive.
REGIONS = (("FR1", 1, 26), ("CDR1", 27, 38), ("FR2", 39, 55), ("CDR2", 56, 65), ("FR3", 66, 104), ("CDR3", 105, 117), ("FR4", 118, 128))


def imgt_region(position: Column) -> Column:
    out = F.lit("unknown")
    for name, a, b in reversed(REGIONS):
        out = F.when(position.between(a, b), name).otherwise(out)
    return out


def conservation_class(score: Column, conserved: float = 0.8, intermediate: float = 0.5) -> Column:
    return F.when(score.isNull(), "uncovered").when(score >= conserved, "conserved").when(score >= intermediate, "intermediate").otherwise("variable")
