import pytest

from tessera import session


def test_scratch_tables_and_dropping(spark, tmp_path):
    s = session.Scratch(spark, "t")
    df = s.write(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "x")
    assert sorted(df.collect()) == [(1, None), (2, "x")]
    assert s.write(spark.createDataFrame([], "a int"), "none").isEmpty()
    s.clear()
    with pytest.raises(Exception):
        spark.read.parquet(s.last).count()


class _Unset:
    """A session on a cluster that names no shared folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(_name, default=None):
            return default


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.scratch_root(_Unset)


def test_the_named_folder_is_used():
    class Named(_Unset):
        class conf:
            @staticmethod
            def get(_name, default=None):
                return "hdfs://shared/dir/"

    assert session.scratch_root(Named) == "hdfs://shared/dir"
