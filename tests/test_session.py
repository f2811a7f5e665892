"""The scratch folder: the cluster's own setting, a temp folder only in local mode."""

import pytest

from pacewise import session
from pacewise.session import ensure_checkpoint_dir, scratch_path


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, **values):
        self.conf, self.sparkContext = _Conf({k.replace("_", "."): v for k, v in values.items()}), _Context()


@pytest.mark.parametrize("master", ["spark://head:7077", "yarn", "k8s://https://head", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        ensure_checkpoint_dir(_Session(spark_master=master))


def test_a_cluster_with_a_shared_folder_uses_it(monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])  # the folder of a session that is none must not be dropped later
    s = _Session(spark_master="yarn", spark_checkpoint_dir="hdfs://store/ckpt")
    assert ensure_checkpoint_dir(s) == "hdfs://store/ckpt"
    assert scratch_path(s, "x").startswith("hdfs://store/ckpt/x-")


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_local_sessions_get_a_temp_folder(master):
    assert "pacewise-ckpt-" in ensure_checkpoint_dir(_Session(spark_master=master))
