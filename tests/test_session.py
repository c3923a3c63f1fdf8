import pytest

from fieldspark.session import ensure_checkpoint_dir


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Conf(dict):
    def set(self, k, v):
        self[k] = v


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext, self.conf = _Context(master), _Conf(conf or {})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_cluster_without_checkpoint_folder_raises(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session(master))


def test_cluster_folder_is_used():
    assert ensure_checkpoint_dir(_Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"


def test_local_master_gets_a_folder():
    assert ensure_checkpoint_dir(_Session("local[4]"))
