import threading

from lectern.llm import common


def rows(spark, n):
    return spark.range(n)


def test_runs_remove_their_own_tables_alone(spark):
    begun, other = threading.Event(), threading.Event()
    found = {}

    def second():
        begun.wait(60)
        with common.written_tables() as made:
            found["kept"] = common.materialise(rows(spark, 3), "second")
            found["made"] = list(made)
        other.set()

    thread = threading.Thread(target=second)
    thread.start()

    def make():
        found["gone"] = common.materialise(rows(spark, 5), "first")
        begun.set()
        other.wait(60)
        return found["gone"].where("id < 2")

    before = common.materialise(rows(spark, 4), "before")
    out = common.finished(make, "out")
    thread.join()
    assert out.count() == 2 and found["kept"].count() == 3 and before.count() == 4
    assert found["made"] == [common.written_path(found["kept"])]
    where = spark._jvm.org.apache.hadoop.fs.Path(common.written_path(found["gone"]))
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_a_run_inside_a_run(spark):
    with common.written_tables() as made:
        inner = common.finished(lambda: common.materialise(rows(spark, 5), "a").where("id > 1"), "b")
        assert inner.count() == 3
    assert common.written_path(inner) in made and len(made) == 2
