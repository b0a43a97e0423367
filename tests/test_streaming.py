"""The streaming mapping equals the batch one."""

from pyspark.sql import functions as F

from recordflow.operators import mapping as m
from recordflow.plans.base import LONG_RULES, long_source
from recordflow.plans.mapping import LONG_ARGS
from recordflow.streaming import long_records as stream


def records(df):
    return sorted(map(tuple, (r for r in df.select(sorted(df.columns)).collect())), key=repr)


def test_stream_equals_batch_over_many_batches_and_replays(spark, sf_dir, tmp_path):
    source = long_source(spark, sf_dir)
    # Later events arrive first, so first places must be corrected across batches.
    source.repartition(5, F.col("event_id") % 5).write.parquet(str(tmp_path / "in"))

    def run(folder):
        events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.start_long_records(events, *LONG_ARGS, LONG_RULES, str(tmp_path / "log"), str(tmp_path / folder))
        query.awaitTermination()
        return records(stream.long_records(spark, str(tmp_path / "log"), "user_id", LONG_RULES))

    expected = records(m.map_long_flat(source, *LONG_ARGS, LONG_RULES))
    assert run("one") == expected
    batches = len(list((tmp_path / "log" / "state").glob("batch=*")))
    assert batches > 2
    # The last batch comes again, after rows of its own were changed by a failed try.
    merge = stream.merge_batch(*LONG_ARGS, LONG_RULES, str(tmp_path / "log"))
    last = batches - 1
    merge(source.limit(0), last)
    assert records(stream.long_records(spark, str(tmp_path / "log"), "user_id", LONG_RULES)) != expected
    # A new checkpoint replays every batch under the same numbers.
    assert run("two") == expected
    state, _ = stream.read_log(spark, str(tmp_path / "log"), "user_id")
    assert len(state.inputFiles()) <= 2 * stream.BUCKETS


def test_only_touched_buckets_are_written(spark, tmp_path):
    rules, args, log = [m.Rule("a", "x")], ("id", "name", "value", "ord"), str(tmp_path / "log")
    merge = stream.merge_batch(*args, rules, log, buckets=8)

    def rows(ids, order):
        return spark.createDataFrame([(i, n, f"{order}", order) for i in ids for n in ("x", "other")], "id long, name string, value string, ord long")

    merge(rows(range(100), 5), 0)
    merge(rows([7], 3), 1)
    merge(rows([7], 3), 1)
    merge(rows([200], 9), 2)
    assert len(list((tmp_path / "log" / "state" / "batch=1").glob("bucket=*"))) == 1
    got = {r["id"]: r["a"] for r in stream.long_records(spark, log, "id", rules).collect()}
    assert got[7] == '["3","5"]' and got[8] == "5" and got[200] == "9" and len(got) == 101
    # A batch that comes again takes its first try back.
    merge(rows([300], 1), 2)
    got = {r["id"]: r["a"] for r in stream.long_records(spark, log, "id", rules).collect()}
    assert 200 not in got and got[300] == "1" and got[7] == '["3","5"]'
    # A history that starts anew forgets the old one; a batch whose past is gone is refused.
    merge(rows([1], 1), 0)
    assert {r["id"] for r in stream.long_records(spark, log, "id", rules).collect()} == {1}


def test_a_batch_of_one_file_is_dealt_over_the_tasks(spark, tmp_path, monkeypatch):
    plans, candidates = [], stream.long_candidates

    def seen(batch, *args):
        plans.append(batch._jdf.queryExecution().executedPlan().toString().lower())
        return candidates(batch, *args)

    monkeypatch.setattr(stream, "long_candidates", seen)
    batch = spark.createDataFrame([(1, "x", "a", 2), (1, "x", "b", 1), (None, "x", "c", 3), (2, None, "d", 4)], "id long, name string, value string, ord long")
    rules = [m.Rule("f", "x")]
    stream.merge_batch("id", "name", "value", "ord", rules, str(tmp_path / "log"))(batch.coalesce(1), 0)
    assert len(plans) == 1 and "rebalance" in plans[0]
    got = {r["id"]: r["f"] for r in stream.long_records(spark, str(tmp_path / "log"), "id", rules).collect()}
    assert got == {1: '["b","a"]', 2: None}
