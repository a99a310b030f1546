"""The keyed task machine against a plain fold, over many files, late and repeated events."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskboard.session import work_folder
from riskboard.streaming import machine, sinks
from riskboard.streaming.sources import files

START = datetime(2024, 3, 1)
DDL = "company_id bigint, phase_idx int, task_dir string, ts timestamp_ntz, event_id bigint, status string"
WAIT = 6 * 3600


def plain(events, mark):
    """State of each task by the rules, one event after the other."""
    tasks = {}
    for company, phase, folder, ts, event_id, status in sorted(set(events), key=lambda e: (e[3], e[4])):
        s = tasks.setdefault((company, phase, folder), {"status": None, "attempts": 0, "refused": 0, "expired": 0, "since": None})
        if s["status"] == "RETRY_WAIT" and ts - s["since"] >= timedelta(seconds=WAIT):
            s.update(status="FAILED", since=s["since"] + timedelta(seconds=WAIT), expired=s["expired"] + 1)
        if s["status"] == status:
            continue
        if s["status"] is not None and status not in machine.ALLOWED[s["status"]]:
            s["refused"] += 1
            continue
        s.update(status=status, since=ts, attempts=s["attempts"] + (status in machine.TRIES))
    for s in tasks.values():
        if s["status"] == "RETRY_WAIT" and mark is not None and mark - s["since"] >= timedelta(seconds=WAIT):
            s.update(status="FAILED", since=s["since"] + timedelta(seconds=WAIT), expired=s["expired"] + 1)
    return sorted((*k, s["status"], s["since"], s["attempts"], s["refused"], s["expired"]) for k, s in tasks.items())


def feed(folder, parts):
    for k, part in enumerate(parts):
        frame = pd.DataFrame(part, columns=["company_id", "phase_idx", "task_dir", "ts", "event_id", "status"]).astype({"phase_idx": "int32"})
        frame.to_parquet(folder / f"part-{k:03d}.parquet", coerce_timestamps="us")


def run(spark, folder, within):
    own = machine.session(spark)
    stream = files(own, str(folder), "part-*.parquet", DDL, per_trigger=1)
    out = work_folder(spark, "t-machine")
    sinks.drain(machine.task_machine(stream, within, WAIT), out, mode="update")
    rows = machine.current_tasks(sinks.current(spark, out, machine.KEYS)).select(
        "company_id", "phase", "task_dir", "status", F.col("since").cast("timestamp_ntz").alias("since"), "attempts", "refused", "expired")
    return out, sorted(tuple(r) for r in rows.collect())


def events(n, seed, tasks=12):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 1, 1, 2]), 4, f"KEYWORD/task_{rnd.randrange(tasks)}", START + timedelta(minutes=37 * k, microseconds=rnd.randrange(10**6)), k,
             rnd.choice(list(machine.ALLOWED)[:5] if rnd.random() < 0.9 else ["TERMINAL"])) for k in range(n)]


def named(rows):
    return [(c, "KEYWORD", *rest) for c, _, *rest in rows]


@pytest.mark.parametrize("seed", [1])
def test_late_and_repeated_events_equal_the_fold(spark, tmp_path, seed):
    told = events(150, seed)
    shuffled = random.Random(seed).sample(told, len(told))
    feed(tmp_path, [shuffled[k::2] for k in range(2)] + [shuffled[:40]])  # out of order, one file twice
    _, got = run(spark, tmp_path, "30 days")
    assert got == named(plain(told, None))


def test_overdue_retries_fail_by_the_watermark(spark, tmp_path):
    told = events(200, 3)
    feed(tmp_path, [told[k:k + 70] for k in range(0, 200, 70)])
    _, got = run(spark, tmp_path, "2 hours")
    mark = max(e[3] for e in told)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000) - timedelta(hours=2)
    want = named(plain(told, mark))
    assert got == want and any(r[-1] for r in want)


def test_nothing_follows_an_end(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    told = [(7, 4, "KEYWORD/a", at(0), 1, "RUNNING"), (7, 4, "KEYWORD/a", at(1), 2, "TERMINAL"), (7, 4, "KEYWORD/a", at(2), 3, "RUNNING"),
            (7, 4, "KEYWORD/a", at(3), 4, "OK"), (7, 4, "KEYWORD/b", at(0), 5, "OK"), (7, 4, "KEYWORD/b", at(1), 6, "FAILED"),
            (7, 4, "KEYWORD/b", at(2), 7, "RUNNING")]
    feed(tmp_path, [told[2:4], told[4:], told[:2]])
    out, got = run(spark, tmp_path, "10 days")
    assert [(r[2], r[3], r[5], r[6]) for r in got] == [("KEYWORD/a", "TERMINAL", 0, 2), ("KEYWORD/b", "RUNNING", 0, 1)]
    # state is kept per task, so one company's tasks are spread
    assert set(machine.KEYS) == {"company_id", "phase_idx", "task_dir"}


def test_companies_in_a_row_share_a_state(spark, tmp_path):
    """One task of 64 companies over two files: they share keys, every company is told by itself."""
    rnd = random.Random(5)
    told = [(c, 4, "KEYWORD/a", START + timedelta(hours=9 * k + c % 5), 100 * k + c, rnd.choice(list(machine.ALLOWED)[:5]))
            for k in range(6) for c in range(64)]
    feed(tmp_path, [told[:200], told[200:]])
    own = machine.session(spark)
    out = work_folder(spark, "t-machine")
    state = machine.task_machine(files(own, str(tmp_path), "part-*.parquet", DDL, per_trigger=1), "1 hour", WAIT)
    assert "_bundle" in state._jdf.queryExecution().analyzed().toString()
    job = sinks.start(state, out, mode="update")
    job.awaitTermination()
    # a key holds one value, so it takes one call to read and one to write
    assert all(not p["stateOperators"][0]["customMetrics"].get("numListStateVars", 0) for p in job.recentProgress)
    rows = machine.current_tasks(sinks.current(spark, out, machine.KEYS)).select(
        "company_id", "phase", "task_dir", "status", F.col("since").cast("timestamp_ntz").alias("since"), "attempts", "refused", "expired")
    mark = max(e[3] for e in told) - timedelta(hours=1)
    want = named(plain(told, mark))
    assert sorted(tuple(r) for r in rows.collect()) == want and any(r[-1] for r in want)


def test_a_board_task_stays_ended(spark):
    from riskboard.operators.tasks import task_state
    ddl = "company_id bigint, phase_idx int, task_dir string, ts timestamp_ntz, event_id bigint, status string, error_code string"
    rows = [(1, 4, "a", START, 1, "RUNNING", None), (1, 4, "a", START + timedelta(hours=1), 2, "TERMINAL", None),
            (1, 4, "a", START + timedelta(hours=2), 3, "OK", None), (1, 4, "a", START + timedelta(hours=3), 4, "TERMINAL", None),
            (1, 4, "b", START, 5, "FAILED", "process_error"), (1, 4, "b", START, 6, "OK", None)]
    got = {r["task_dir"]: (r["status"], r["event_id"]) for r in task_state(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"a": ("TERMINAL", 2), "b": ("OK", 6)}
