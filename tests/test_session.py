"""Where intermediate tables may lie."""

from types import SimpleNamespace

import pytest

from strandlake.session import shared_dir


def made(master):
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "k8s://host", "spark://host:7077", "local-cluster[3,2,1000]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(made(master))


def test_the_session_s_own_folder_is_used(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
