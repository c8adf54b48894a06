"""The fold of a stream goes on after a restart from its checkpoint."""

from velumra.operators import graph
from velumra.streaming.accumulate import EdgeFold, fold_stream

SCHEMA = "`from` string, `to` string, delta double, ts bigint, type int"


def rows(df):
    return sorted((r.src, r.dst, r.weight, r.last_modified, r.type) for r in df.collect())


def test_a_restarted_fold_has_all_edges(spark, tmp_path):
    source, log = tmp_path / "in", []
    for k in range(3):
        some = [("a", "b", 1.0 + k, k, 0), ("b", f"c{k}", 2.0, k, 1)]
        log += some
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        # Another driver each time: only the folders are the same.
        fold = EdgeFold(spark, str(tmp_path / "folded"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        fold_stream(stream, fold, str(tmp_path / "checkpoint")).awaitTermination()
        assert rows(fold.edges) == rows(graph.accumulate(spark.createDataFrame(log, SCHEMA)))
    assert len(list((tmp_path / "folded").glob("batch-*"))) == 1


def test_a_batch_that_comes_twice_counts_once(spark, tmp_path):
    batch = spark.createDataFrame([("a", "b", 1.0, 5, 0)], SCHEMA)
    folder = str(tmp_path / "folded")
    assert EdgeFold(spark, folder).edges is None
    EdgeFold(spark, folder)(batch, 0)
    again = EdgeFold(spark, folder)
    again(batch, 0)
    assert again.last == 0 and rows(again.edges) == rows(graph.accumulate(batch))
    # A table that was not written whole is none.
    (tmp_path / "folded" / "batch-1").mkdir()
    later = EdgeFold(spark, folder)
    later(batch, 1)
    assert later.last == 1 and [r[2] for r in rows(later.edges)] == [2.0, 2.0]
