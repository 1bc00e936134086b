import pytest
from pyspark.sql import functions as F

from terralex.sources import scratch


def test_tables_are_measured_dropped_and_cleared(spark):
    shelf = scratch.Shelf(spark, "t")
    table, seen = shelf.measured(spark.range(10), "a", n=F.count(F.lit(1)), s=F.sum("id"))
    assert seen == {"n": 10, "s": 45} and table.count() == 10 and shelf.root in scratch.ROOTS
    exists = lambda: spark._jvm.org.apache.hadoop.fs.Path(shelf.root).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(shelf.root))
    others, scratch.ROOTS[:] = [r for r in scratch.ROOTS if r != shelf.root], [shelf.root]
    assert exists()
    scratch.clear(spark)
    assert not exists() and scratch.ROOTS == []
    scratch.ROOTS[:] = others


def test_without_a_shared_folder_only_a_local_master_has_one(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Nothing)})

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session)
