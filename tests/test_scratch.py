import threading

from tidewatch.scratch import kept, materialize, scope


def test_scopes_belong_to_their_thread(spark):
    """A table made while another thread is in a scope outlives it; what is kept goes with the scope outside."""
    inside, go_on, made = threading.Event(), threading.Event(), {}

    def other():
        with scope():
            made["gone"] = materialize(spark.range(3), "theirs")
            inside.set()
            go_on.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    mine = materialize(spark.range(5), "mine")
    with scope():
        with scope():
            held = kept(spark.range(7), "held")
        assert held.count() == 7
    go_on.set()
    thread.join()
    assert mine.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda df: path(df.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(df.inputFiles()[0]))
    assert exists(mine) and not exists(made["gone"]) and not exists(held)
