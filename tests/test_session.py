"""The folder that driver and executors share."""

from __future__ import annotations

import pytest

from barcraft.session import shared_folder


def test_the_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId=f"app-{master}"))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("local[2]")).startswith("file:///")
