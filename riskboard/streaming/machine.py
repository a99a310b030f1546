"""The task machine: transitions, retries and ends of every task, kept as keyed state.

A task is a company, a phase and a folder, so one company's events are spread over its
tasks. A task's events count in the order of their time, however they arrive: the machine
keeps its state as of the last watermark it saw and the few events after it, and works these
out anew when another one comes. An event delivered twice counts once; one behind the watermark is
dropped. Steps that ``ALLOWED`` does not name are refused and counted, so nothing leaves
TERMINAL and nothing jumps from OK to FAILED. A task that waits for its retry longer than
the given time has failed.

Every read and write of state is a call from Python to the store, which takes far longer than
a step. So the same task of ``BUNDLE`` companies with numbers in a row is kept under one key;
the tasks of one company stay spread over as many keys as it has tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..functions.text import nth

# state → states it may turn into; a task's first event may be any
ALLOWED = {
    "PENDING": ("RUNNING", "OK", "FAILED", "RETRY_WAIT", "TERMINAL"),
    "RUNNING": ("OK", "FAILED", "RETRY_WAIT", "TERMINAL"),
    "RETRY_WAIT": ("PENDING", "RUNNING", "FAILED", "TERMINAL"),
    "FAILED": ("PENDING", "RUNNING", "RETRY_WAIT", "TERMINAL"),
    "OK": ("PENDING", "RUNNING"),
    "TERMINAL": (),
}
# states that count as a failed try
TRIES = ("FAILED", "RETRY_WAIT")
KEYS = ["company_id", "phase_idx", "task_dir"]
# companies with numbers in a row whose tasks of one phase and folder share a state
BUNDLE = 32
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_BASE = ["company_id", "status", "since", "attempts", "refused", "expired", "micros", "event_id"]
_EVENT = ["company_id", "micros", "event_id", "status"]
# columns of all bases and of all events ahead of them, each an array: one value in the store
_TASKS = ", ".join(f"{part}_{c} array<{'string' if c == 'status' else 'bigint'}>"
                   for part, names in (("base", _BASE), ("ahead", _EVENT)) for c in names)
_OUT = ("company_id bigint, phase_idx int, task_dir string, status string, since bigint, attempts bigint, "
        "refused bigint, expired bigint")
_ROW = Row(*KEYS, "status", "since", "attempts", "refused", "expired")
_START = (None, 0, 0, 0, 0, -(1 << 62), -1)


def expire(state: tuple, wait: int, until: int) -> tuple:
    """The state at the time ``until`` if nothing happens: an overdue retry has failed."""
    status, since, attempts, refused, expired, *last = state
    if status == "RETRY_WAIT" and since + wait <= until:
        return ("FAILED", since + wait, attempts, refused, expired + 1, *last)
    return state


def step(state: tuple, event: tuple, wait: int) -> tuple:
    """The state after one more event, events in the order of time and id."""
    micros, event_id, new = event
    status, since, attempts, refused, expired, *_ = expire(state, wait, micros)
    if status is not None and new not in ALLOWED[status] and new != status:
        return status, since, attempts, refused + 1, expired, micros, event_id
    # a repeated state is a sign of life: it neither counts nor restarts the wait
    if new != status:
        since, attempts = micros, attempts + (new in TRIES)
    return new, since, attempts, refused, expired, micros, event_id


def fold(base: tuple, ahead: list[tuple], wait: int) -> tuple:
    """The state after the events ahead of the base."""
    for event in ahead:
        base = step(base, event, wait)
    return base


def settle(base: tuple, ahead: list[tuple], new: set[tuple], mark: int, wait: int) -> tuple[tuple, list[tuple]]:
    """Base and events ahead of it, after new events and with the watermark at ``mark``."""
    order = sorted(e for e in new.union(ahead) if e[:2] > base[5:7])
    base = fold(base, [e for e in order if e[0] <= mark], wait)
    return expire(base, wait, mark), [e for e in order if e[0] > mark]


def _columns(rows: list[tuple], n: int) -> list[list]:
    return [list(c) for c in zip(*rows)] if rows else [[]] * n


class TaskMachine(StatefulProcessor):
    """State of one bundle: of each company's task its base as of the watermark, and the
    events ahead of it."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getValueState("tasks", _TASKS)

    def _told(self, key: tuple, new: dict[int, set[tuple]], mark: int) -> Iterator[Row]:
        """Fold what lies behind the watermark, keep the rest, and tell the tasks that had
        events or whose wait is over."""
        held = self.tasks.get()
        columns = held or ([],) * (len(_BASE) + len(_EVENT))
        known = {company: tuple(base) for company, *base in zip(*columns[:len(_BASE)])}
        kept: dict[int, list[tuple]] = {}
        for company, *event in zip(*columns[len(_BASE):]):
            kept.setdefault(company, []).append(tuple(event))
        bases, aheads, due = [], [], None
        for company in {**known, **kept, **new}:
            old, before = known.get(company, _START), kept.get(company, [])
            base, ahead = settle(old, before, new.get(company, set()), mark, self.wait)
            if base != _START:
                bases.append((company, *base))
            aheads += [(company, *event) for event in ahead]
            state = fold(base, ahead, self.wait)
            if state[0] == "RETRY_WAIT":
                over = state[1] + self.wait
                due = over if due is None else min(due, over)
            if company in new or state[:5] != fold(old, before, self.wait)[:5]:
                yield _ROW(company, *key[1:], *state[:5])
        self.tasks.update((*_columns(bases, len(_BASE)), *_columns(aheads, len(_EVENT))))
        if held:
            for past in list(self.handle.listTimers()):
                self.handle.deleteTimer(past)
        if due is not None:  # wake up when the first wait is over
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, set[tuple]] = {}
        for r in rows:
            new.setdefault(r["company_id"], set()).add((r["micros"], r["event_id"], r["status"]))
        yield from self._told(tuple(key), new, max(-1, timerValues.getCurrentWatermarkInMs()) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._told(tuple(key), {}, timerValues.getCurrentWatermarkInMs() * 1000)


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as the
    machine needs; settings of the given session stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return own


def task_machine(stream: DataFrame, within: str, wait_seconds: int) -> DataFrame:
    """State of every task whose events (``company_id, phase_idx, task_dir, ts, event_id,
    status``) came in, told anew when it may have changed (update mode). ``since`` is in
    microseconds. ``within`` is how late an event may come, ``wait_seconds`` how long a retry
    may keep waiting."""
    timed = (stream.filter("ts is not null and status is not null")
             .withColumn("_event_time", F.col("ts").cast("timestamp")).withWatermark("_event_time", within)
             .select(F.expr(f"company_id div {BUNDLE}").alias("_bundle"), *KEYS, "_event_time", F.unix_micros("_event_time").alias("micros"), "event_id", "status"))
    return timed.groupBy("_bundle", *KEYS[1:]).transformWithState(
        TaskMachine(wait_seconds * 1_000_000), _OUT, "Update", "EventTime")


def current_tasks(state: DataFrame) -> DataFrame:
    """Rows of the machine with the name of their phase."""
    return state.select("company_id", nth(fixed.PHASES, F.col("phase_idx")).alias("phase"), "task_dir", "status", F.timestamp_micros("since").alias("since"),
                        "attempts", "refused", "expired")
