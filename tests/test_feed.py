import uuid

from leverscope.operators.profile import ColumnProfile
from leverscope.operators.scorers import ExprScorer
from leverscope.session import checkpoint_dir
from leverscope.streaming.feed import score_feed, store_feed, type_feed


def test_batches_are_typed_scored_and_stored_once(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    columns = [ColumnProfile("a", "numeric", 0), ColumnProfile("c", "categorical", 0)]
    schema = "row_key string, a string, c string"
    scorer = ExprScorer("coalesce(a, 0.0) * 2")
    checkpoint_dir(spark)

    # A feed goes on from its checkpoint, so a new one needs a new name.
    name = f"feed-{uuid.uuid4().hex}"

    def run():
        raw = spark.readStream.schema(schema).json(str(source))
        typed = type_feed(raw, columns, keep=("row_key",))
        query = store_feed(score_feed(typed, scorer), str(sink), name)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination(60)

    (source / "one.json").write_text('{"row_key":"1","a":"1.5","c":"x"}\n{"row_key":"2","a":"n.a.","c":null}\n')
    run()
    (source / "two.json").write_text('{"row_key":"3","a":"true","c":"y"}\n')
    run()
    run()
    rows = sorted((r["row_key"], r["a"], r["score"]) for r in spark.read.parquet(str(sink)).collect())
    assert rows == [("1", 1.5, 3.0), ("2", None, 0.0), ("3", None, 0.0)]


def test_feed_reads_cells_as_a_batch_does(spark):
    from leverscope.operators.profile import load_table

    cells = [("1", "x", "True"), ("2.5", "NA", "False"), ("3", "y", "True"), ("4", "", None), ("5e0", "x", "True")]
    odd = [("True", "null", "2"), ("n/a", "z", "True"), (None, None, "x")]
    schema = "a string, c string, b string"
    from leverscope.functions.scalars import NA_TOKENS
    from pyspark.sql import functions as F

    batch = spark.createDataFrame(cells + odd[:0], schema)
    batch = batch.select(*[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) for c in batch.columns])
    typed, columns = load_table(batch)
    again = type_feed(spark.createDataFrame(cells, schema), columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, typed.collect()))
    found = type_feed(spark.createDataFrame(odd, schema), columns).collect()
    assert [tuple(r) for r in found] == [(None, None, None), (None, "z", 1.0), (None, None, None)]
