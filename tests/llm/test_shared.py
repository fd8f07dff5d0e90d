import pytest

from corpusward.llm.shared import left_join_spread, shared_folder


def test_spread_join_is_a_left_join(spark):
    rows = spark.createDataFrame([("hot" if i % 2 else None if i % 5 == 0 else f"k{i % 7}", i) for i in range(400)] + [("hot", 1)] * 50, "key string, i int")
    table = spark.createDataFrame([("hot", 1.0), ("k2", 2.0), ("other", 3.0)], "key string, v double")
    sizes = rows.groupBy("key").count().withColumnRenamed("count", "n")
    want = sorted(rows.join(table, "key", "left").select("key", "i", "v").collect(), key=str)
    got = left_join_spread(rows, table, "key", sizes, rows.count(), least=20)
    assert got.columns == ["key", "i", "v"] and sorted(got.collect(), key=str) == want
    assert left_join_spread(rows.limit(0), table, "key", sizes.limit(0), 0).collect() == []


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
