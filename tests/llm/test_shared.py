import threading

from spectrafleet.llm import _shared


def test_runs_at_once_delete_their_own_tables_only(spark):
    kept, inside, out = _shared.materialize(spark.range(3), "kept"), threading.Event(), {}
    done = threading.Event()

    def other():
        with _shared.own_tables(spark):
            out["other"] = _shared.materialize(spark.range(5), "other")
            inside.set()
            done.wait(60)
            out["rows"] = out["other"].count()

    thread = threading.Thread(target=other)
    thread.start()
    assert inside.wait(60)
    with _shared.own_tables(spark):
        outer = _shared.materialize(spark.range(7), "outer")
        with _shared.own_tables(spark):
            gone = _shared.materialize(spark.range(2), "gone")
        dropped = _shared.materialize(spark.range(4), "dropped")
        _shared.drop_written(dropped)
        assert outer.count() == 7
    done.set()
    thread.join()
    assert kept.count() == 3 and out["rows"] == 5
    make = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda df: make(df._written_to).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(make(df._written_to))
    assert exists(kept) and not any(exists(d) for d in (outer, gone, dropped, out["other"]))
