from pathlib import Path

from pyspark.sql import functions as F

from quire import session


def test_scratch_is_shared_and_released(spark):
    folder = session.scratch_dir(spark)
    assert folder.startswith("file:///")
    kept = session.settle(spark.range(5), "kept")
    path = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert kept.count() == 5 and path.exists()
    assert session.release(spark) >= 1 and not path.exists() and session.release(spark) == 0
    gone = session.settle(spark.range(0).withColumn("x", F.lit("a")), "none")
    assert gone.columns == ["id", "x"] and gone.count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    try:
        session.scratch_dir(Session)
    except RuntimeError as e:
        assert "share" in str(e)
    else:
        raise AssertionError
