"""Where tables between jobs lie."""

import pytest

from tributary.session import shared_dir


class _Session:
    def __init__(self, master, conf):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: conf.get(key, default))})


def test_shared_folder():
    warehouse = {"spark.sql.warehouse.dir": "file:/data/warehouse"}
    assert shared_dir(_Session("yarn", warehouse | {"spark.checkpoint.dir": "hdfs://n/shared"})) == "hdfs://n/shared"
    assert shared_dir(_Session("local[4]", warehouse)) == "file:/data/warehouse/_tributary"
    with pytest.raises(RuntimeError):  # a folder of one machine would lose rows
        shared_dir(_Session("spark://host:7077", warehouse))
