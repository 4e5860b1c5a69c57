"""Queries that measure every frame of the table."""

import os

import pytest

from strandlake import adapters, registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ["m35_peptide_bulge", "m36_surface_areas"])
def test_one_row_a_frame(spark, name):
    frames = sorted(map(tuple, adapters.frames(spark, DIR).select("traj_id", "frame").collect()))
    got = sorted(map(tuple, registry.queries()[name](spark, DIR).select("traj_id", "frame").collect()))
    assert got == frames, (len(got), len(frames))
