"""Streams equal their batch form over many micro-batches, re-delivery and restart."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from riskboard.operators import review, tasks
from riskboard.plans import QUERIES
from riskboard.session import work_folder
from riskboard.sources import tables as tb
from riskboard.streaming import jobs, sinks, sources


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events in four files, out of time order, the first file delivered twice."""
    folder = tmp_path_factory.mktemp("feed")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for name, part in (("b", 2), ("a", 0), ("d", 3), ("c", 1), ("e", 0)):
        one = events.filter(F.col("event_id") % 4 == part).toPandas()
        one.to_parquet(folder / f"events-{name}.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.fixture(scope="module")
def table(spark):
    return tb.Tables(spark, SMALL)


def test_live_state(spark, feed, table, rows):
    out = work_folder(spark, "t-live")
    sinks.drain(jobs.live_state(sources.task_events(spark, feed, per_trigger=1)), out, mode="update")
    assert sinks.rows(spark, out).select("batch_id").distinct().count() >= 5
    want = tasks.latest_events(tb.task_event(table))
    assert rows(sinks.current(spark, out, ["company_id"])) == rows(want)


def test_phase_machine_counts_redelivery_once(spark, feed, table, rows):
    out = work_folder(spark, "t-phase")
    stream = jobs.phase_progress(sources.task_events(spark, feed, per_trigger=1), within="40 days")
    sinks.drain(stream, out, mode="update")
    state = tasks.task_state(tb.task_event(table)).select("company_id", "phase", "task_dir", "status", "attempts")
    got = jobs.phase_machine(spark, out)
    assert rows(got.drop("closed")) == rows(state)
    closed = tasks.company_task_stats(tasks.task_state(tb.task_event(table))).select("company_id", "closed")
    assert rows(got.select("company_id", "closed").distinct()) == rows(closed)


def test_reviews_survive_restart(spark, feed, table, rows):
    out = work_folder(spark, "t-review")
    for _ in range(2):  # the second start finds nothing new and changes nothing
        reviews = sources.once(sources.review_events(spark, feed, per_trigger=1), "event_id", "reviewed_at", "40 days")
        sinks.drain(reviews, out, split=jobs.review_outputs())
    want = review.latest_review(tb.review_event(table)).drop("reviewed_at")
    assert rows(jobs.current_reviews(spark, out).drop("reviewed_at")) == rows(want)
    audit = sinks.rows(spark, out, "audit")
    assert audit.count() == tb.review_event(table).count()  # the file delivered twice counts once


def test_new_files_update_the_view(spark, tmp_path, rows):
    folder, out = tmp_path / "in", work_folder(spark, "t-new")
    folder.mkdir()
    def put(name, data):
        spark.createDataFrame(data, "conv_id long, turn long, role string, text string").toPandas().to_parquet(
            folder / f"conversations-{name}.parquet")
    def run():
        sinks.drain(sources.posts(spark, str(folder)), out, split=jobs.post_outputs(["conv_id", "role"], ["turn"]))
        return rows(jobs.current_posts(spark, out, ["conv_id", "role"], ["turn"]), "conv_id", "role", "text")
    put("1", [(1, 0, "u", "old"), (1, 2, "u", "new"), (2, 0, "u", "x")])
    assert run() == [(1, "u", "new"), (2, "u", "x")]
    put("2", [(1, 1, "u", "late"), (2, 5, "u", "y")])
    assert run() == [(1, "u", "new"), (2, "u", "y")]


def test_compaction_keeps_the_view(spark, feed, table, rows):
    out = work_folder(spark, "t-compact")
    sinks.drain(jobs.live_state(sources.task_events(spark, feed, per_trigger=1)), out, mode="update")
    before = rows(sinks.current(spark, out, ["company_id"]))
    sinks.compact(spark, out, ["company_id"])
    assert rows(sinks.current(spark, out, ["company_id"])) == before
    assert spark.read.parquet(f"{out}/data-base").count() == len(before)


def test_compaction_leaves_unfinished_batches(spark, feed, table, rows):
    out = work_folder(spark, "t-part")
    sinks.drain(jobs.live_state(sources.task_events(spark, feed, per_trigger=1)), out, mode="update")
    last = sinks.committed(spark, out)
    sinks.rows(spark, out).filter(F.col("batch_id") == last).drop("batch_id").write.parquet(f"{out}/data/batch_id={last + 1}")
    sinks.compact(spark, out, ["company_id"])
    base = spark.read.parquet(f"{out}/data-base")
    assert base.agg(F.max("upto")).first()[0] == last
    assert sinks.current(spark, out, ["company_id"]).count() == tb.task_event(table).select("company_id").distinct().count()


def test_empty_review_feed_gives_empty_tables(spark, tmp_path):
    out = work_folder(spark, "t-none")
    sinks.drain(sources.review_events(spark, str(tmp_path)), out, split=jobs.review_outputs())
    assert jobs.current_reviews(spark, out).count() == 0
    assert sinks.rows(spark, out, "audit").count() == 0


def test_empty_stream_gives_an_empty_view(spark, tmp_path):
    out = work_folder(spark, "t-empty")
    sinks.drain(jobs.live_state(sources.task_events(spark, str(tmp_path))), out, mode="update")
    assert sinks.current(spark, out, ["company_id"]).count() == 0


@pytest.mark.parametrize("name", ["stream_post_upsert", "stream_log_lines", "stream_latest_state"])
def test_tables_of_part_files(spark, tmp_path, rows, name):
    """A table written as a folder of part files is read like one of a single file."""
    for table in ("conversations", "events"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    got, want = (QUERIES[name](spark, folder) for folder in (str(tmp_path), SMALL))
    assert rows(got) == rows(want) and want.count() > 0


def test_posts_of_one_delivery_all_stay(spark, tmp_path, rows):
    """Posts of one key that arrive together equal the SQL; a later delivery replaces them."""
    posts = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "u", "b"), (None, 0, "u", "c"), (None, 0, None, None), (2, 1, "u", "d")]
    def put(name, data):
        spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(
            str(tmp_path / f"conversations{name}.parquet"))
    put("", posts)
    assert rows(QUERIES["stream_post_upsert"](spark, str(tmp_path))) == sorted(posts, key=repr)
    keys, out = ["conv_id", "turn"], work_folder(spark, "t-posts")
    def run():
        sinks.drain(sources.posts(spark, str(tmp_path)), out, split=jobs.post_outputs(keys))
        return rows(jobs.current_posts(spark, out, keys))
    assert run() == sorted(posts, key=repr)
    put("-2", [(1, 0, "u", "new"), (None, 0, "u", "e")])
    want = sorted([(1, 0, "u", "new"), (None, 0, "u", "e"), (2, 1, "u", "d")], key=repr)
    assert run() == want
    sinks.compact(spark, out, keys, name="latest", every=True)
    assert rows(jobs.current_posts(spark, out, keys)) == want
