"""Durable state on Spark's stateful processors: typed value, list and map state in RocksDB, timers and time to live.

Each processor reads its key's state once a micro-batch, takes the batch's rows
in order, and writes back what changed.  `stream` declares the query, `drain`
runs it over everything there is, batch by batch, and ends; started again on
the same checkpoint it goes on where it stopped.

Spark calls Python once for each group and passes what it says as a batch of
its own, which costs far more than a row does.  So the groups are shards, each
of many keys, and the state of a shard's keys is read and written at once.
Where state expires or timers run, Spark has to know each key: there the groups
are the keys.
"""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Without this a query on processing time runs empty batches for ever, and never ends.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


KINDS = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}
#: Groups of a stream over shards. One shard's state and rows of a micro-batch are held at a time; a checkpoint is bound to this number.
SHARDS = 16384
SHARD = "_shard"
#: Keys of these types are equal in Python as they are in Spark.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType)


def struct(columns: str) -> T.StructType:
    """A schema from `name kind, …` without a session, as workers need it."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


class Log:
    """What a shard knows, by key; in list state, a chunk of arrays for each micro-batch that changed something.

    The last chunk that has a key counts.  Once more is out of date than not,
    the list is written anew, so writes stay in proportion to what changes.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, keys: T.StructType, values: T.StructType):
        self.width = len(keys)
        self.chunks = handle.getListState(name, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*keys, *values]]))

    def load(self) -> None:
        self.rows, self.changed, self.size = {}, {}, 0
        for chunk in self.chunks.get():
            self.size += len(chunk[0])
            self.rows.update(zip(zip(*chunk[: self.width]), zip(*chunk[self.width :])))

    def put(self, key: tuple, value: tuple) -> None:
        self.rows[key] = self.changed[key] = value

    def save(self) -> None:
        anew = self.size + len(self.changed) > 2 * len(self.rows)
        rows = self.rows if anew else self.changed
        chunk = tuple(map(list, zip(*((*k, *v) for k, v in rows.items()))))
        if self.changed:
            self.chunks.put([chunk]) if anew else self.chunks.appendValue(chunk)


class Entry:
    """The value of the key at hand in its shard's log."""

    def __init__(self, machine: Machine, log: Log):
        self.machine, self.log = machine, log

    def get(self) -> tuple | None:
        return self.log.rows.get(self.machine.key)

    def update(self, value: tuple) -> None:
        self.log.put(self.machine.key, value)


class Entries:
    """A map of the key at hand in its shard's log."""

    def __init__(self, machine: Machine, log: Log):
        self.machine, self.log = machine, log

    def get(self, key: tuple) -> tuple | None:
        return self.log.rows.get((*self.machine.key, *key))

    def put(self, key: tuple, value: tuple) -> None:
        self.log.put((*self.machine.key, *key), value)


class Numbered:
    """A list of the key at hand in its shard's log, by place."""

    def __init__(self, machine: Machine, log: Log):
        self.machine, self.log, self.of, self.lengths = machine, log, None, Counter()

    def count(self) -> int:
        if self.of is not self.log.rows:  # another shard's
            self.of, self.lengths = self.log.rows, Counter(k[:-1] for k in self.log.rows)
        return self.lengths[self.machine.key]

    def extend(self, values: list[tuple]) -> None:
        for k, value in enumerate(values, self.lengths[self.machine.key]):
            self.log.put((*self.machine.key, k), value)


class KeyEntries:
    """A map of the key at hand where the groups are the keys."""

    def __init__(self, values):
        self.values = values

    def get(self, key: tuple) -> tuple | None:
        return self.values.getValue(key)

    def put(self, key: tuple, value: tuple) -> None:
        self.values.updateValue(key, value)


class KeyNumbered:
    """A list of the key at hand where the groups are the keys."""

    def __init__(self, values):
        self.values = values

    def count(self) -> int:
        return sum(1 for _ in self.values.get())

    def extend(self, values: list[tuple]) -> None:
        self.values.appendList(values)


class Machine(StatefulProcessor):
    """A processor whose rows of a batch go in `order`; `columns` names what it adds to the key's columns and the last of `order`.

    Subclasses open their state in `open`, load it in `load`, step in `step` and
    write it back in `save`.  With `ttl_ms` state that nothing has touched for
    that long goes.
    """

    columns = ""

    def __init__(self, keys: list[str], order: list[str], ttl_ms: int | None = None):
        self.keys, self.order, self.ttl_ms = keys, order, ttl_ms
        self.lease_ms: int | None = None
        self.sharded, self.key_types = False, T.StructType()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.logs = handle, []
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...
    def load(self) -> None: ...
    def save(self) -> None: ...
    def step(self, row: Row) -> tuple: ...

    def named(self) -> Row:
        """A row of the result by position."""
        return Row(*self.keys, self.order[-1], *(c.split()[0] for c in self.columns.split(", ")))

    def log(self, name: str, value: str, more: str = "") -> Log:
        keys = T.StructType([*self.key_types, *(struct(more) if more else ())])
        self.logs.append(Log(self.handle, name, keys, struct(value)))
        return self.logs[-1]

    def value(self, name: str, schema: str):
        return Entry(self, self.log(name, schema)) if self.sharded else self.handle.getValueState(name, struct(schema), self.ttl_ms)

    def mapping(self, name: str, key: str, value: str) -> Entries | KeyEntries:
        if self.sharded:
            return Entries(self, self.log(name, value, key))
        return KeyEntries(self.handle.getMapState(name, struct(key), struct(value), self.ttl_ms))

    def listing(self, name: str, value: str) -> Numbered | KeyNumbered:
        if self.sharded:
            return Numbered(self, self.log(name, value, "_place long"))
        return KeyNumbered(self.handle.getListState(name, struct(value), self.ttl_ms))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 (the API's names)
        out, order = self.named(), itemgetter(*self.order)
        self.now = timerValues.getCurrentProcessingTimeInMs()
        held = {key: rows}
        if self.sharded:
            held = {}
            for row in rows:
                held.setdefault(tuple(row[k] for k in self.keys), []).append(row)
        for log in self.logs:
            log.load()
        for self.key, some in held.items():
            self.load()
            for row in sorted(some, key=order):
                yield out(*self.key, row[self.order[-1]], *self.step(row))
            self.save()
        for log in self.logs:
            log.save()

    def close(self) -> None: ...


class Watermark(Machine):
    """STM-01. Observed moves with every scan; processed only with an outcome, once a scan, and never back.

    Rows: scan_id, snapshot_id, outcome (NULL: the comparison failed), and base,
    the processed pointer that the scan was compared with (NULL: the current one).
    """

    columns = "previous long, observed long, processed long, advanced boolean"

    def open(self, handle):
        self.pointers = self.value("pointers", "observed long, processed long")
        self.done = self.mapping("done", "scan_id long", "snapshot_id long")

    def load(self):
        self.observed, self.processed = self.pointers.get() or (None, None)

    def step(self, row):
        before, self.observed, moved = self.processed, row.snapshot_id, False
        if row.outcome is not None and self.done.get((row.scan_id,)) is None:
            self.done.put((row.scan_id,), (row.snapshot_id,))
            if before is None or row.base is None or row.base == before or row.snapshot_id == before:
                self.processed, moved = row.snapshot_id, True
        return before, self.observed, self.processed, moved

    def save(self):
        self.pointers.update((self.observed, self.processed))


class Seen(Machine):
    """STM-02. First and last sight; new means first seen after the baseline. Rows: the last of `order`, baseline."""

    columns = "was_seen boolean, is_new boolean, first_seen long"

    def open(self, handle):
        self.sights = self.value("sights", "first long, last long")

    def load(self):
        self.first, self.last = self.sights.get() or (None, None)

    def step(self, row):
        was = self.first is not None
        self.last = row[self.order[-1]]
        self.first = self.first if was else self.last
        return was, not was and not row.baseline, self.first

    def save(self):
        self.sights.update((self.first, self.last))


class Lifecycle(Machine):
    """STM-03. pending to processed or ignored, with attempts counted; a terminal state stays. Rows: action."""

    columns = "state string, attempts long"

    def open(self, handle):
        self.held = self.value("held", "state string, attempts long")

    def load(self):
        self.state, self.attempts = self.held.get() or ("pending", 0)

    def step(self, row):
        if self.state == "pending":
            self.attempts += row.action != "register"
            self.state = row.action if row.action in ("processed", "ignored") else "pending"
        return self.state, self.attempts

    def save(self):
        self.held.update((self.state, self.attempts))


class Claims(Machine):
    """STM-04. not_started, running, completed or failed; `token` names the process that asks.

    claim and retry take a task that nobody has started; retry also takes one
    that has failed.  A running task of another process is interrupted by either:
    it has failed, and retry takes it at once.  complete and fail end the task of
    their own process.  With `lease_ms` a timer fails a task that runs longer.
    """

    columns = "state string, attempts long, accepted boolean"

    def __init__(self, keys, order, ttl_ms=None, lease_ms: int | None = None):
        super().__init__(keys, order, ttl_ms)
        self.lease_ms = lease_ms

    def open(self, handle):
        self.task = self.value("task", "state string, token string, attempts long")

    def load(self):
        self.state, self.token, self.attempts = self.task.get() or ("not_started", None, 0)

    def step(self, row):
        accepted = False
        if row.action in ("claim", "retry"):
            if self.state == "running" and self.token != row.token:
                self.state, self.token = "failed", None
            if self.state == "not_started" or self.state == "failed" and row.action == "retry":
                self.state, self.token, self.attempts, accepted = "running", row.token, self.attempts + 1, True
        elif self.state == "running" and self.token == row.token:
            self.state, self.token, accepted = "completed" if row.action == "complete" else "failed", None, True
        return self.state, self.attempts, accepted

    def save(self):
        self.task.update((self.state, self.token, self.attempts))
        if self.lease_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if self.state == "running":
                self.handle.registerTimer(self.now + self.lease_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.load()
        if self.state == "running":
            self.state, self.token = "failed", None
            self.task.update((self.state, self.token, self.attempts))
            yield self.named()(*key, None, self.state, self.attempts, False)


class FollowUps(Machine):
    """STM-05. Turns by request id: the same request again starts nothing and gives its turn's state. Rows: request_id, action."""

    columns = "state string, repeated boolean, n_turns long"

    def open(self, handle):
        self.turns = self.mapping("turns", "request_id long", "state string")
        self.asked = self.listing("asked", "request_id long")

    def load(self):
        self.count, self.new = self.asked.count(), []

    def step(self, row):
        id_ = (row.request_id,)
        now = (self.turns.get(id_) or (None,))[0]
        repeated = row.action == "ask" and now is not None
        after = "running" if now is None and row.action == "ask" else now
        if now == "running" and row.action in ("complete", "fail"):
            after = "completed" if row.action == "complete" else "failed"
        if after != now:
            self.turns.put(id_, (after,))
        if now is None and after:
            self.new.append(id_)
        return after or "unknown", repeated, self.count + len(self.new)

    def save(self):
        if self.new:
            self.asked.extend(self.new)


class Steps(Machine):
    """STM-06. A step of a run: a complete one is skipped, any other try counts; failures keep their category in order.

    Rows: outcome (complete, failed, or NULL while it runs), category.
    """

    columns = "status string, attempts long, skipped boolean, n_failures long"

    def open(self, handle):
        self.held = self.value("held", "status string, attempts long")
        self.failures = self.listing("failures", "category string")

    def load(self):
        self.status, self.attempts = self.held.get() or (None, 0)
        self.count, self.new = self.failures.count(), []

    def step(self, row):
        skipped = self.status == "complete"
        if not skipped:
            self.status, self.attempts = row.outcome or "running", self.attempts + 1
            if self.status == "failed":
                self.new.append((row.category or "unknown",))
        return self.status, self.attempts, skipped, self.count + len(self.new)

    def save(self):
        self.held.update((self.status, self.attempts))
        if self.new:
            self.failures.extend(self.new)


def stream(df: DataFrame, machine: Machine) -> DataFrame:
    """The machine over a stream: its keys, the last of its order, and its columns; a row for each input row."""
    machine.key_types = T.StructType([df.schema[c] for c in machine.keys])
    machine.sharded = not (machine.ttl_ms or machine.lease_ms) and all(isinstance(f.dataType, PLAIN) for f in machine.key_types)
    kinds = dict(df.dtypes)
    named = [*machine.keys, machine.order[-1]]
    schema = T.StructType.fromDDL(", ".join([*(f"{c} {kinds[c]}" for c in named), machine.columns]))
    timed = "ProcessingTime" if machine.ttl_ms or machine.lease_ms else "None"
    by = machine.keys
    if machine.sharded:
        df, by = df.withColumn(SHARD, F.pmod(F.xxhash64(*machine.keys), F.lit(SHARDS)).cast("int")), [SHARD]
    return df.groupBy(*by).transformWithState(machine, schema, "Append", timed)


@contextmanager
def settings(spark: SparkSession):
    """RocksDB for state, and no batches without data, while a query starts and runs."""
    wanted = {PROVIDER: ROCKSDB, NO_DATA: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(out: DataFrame, path: str, checkpoint: str, timeout: int = 3600) -> None:
    """Appends what the stream has by now to Parquet files, in as many batches as its source makes of it."""
    with settings(out.sparkSession):
        q = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
        try:
            if not q.awaitTermination(timeout):
                raise TimeoutError(f"the stream did not end within {timeout} s")
        finally:
            q.stop()


def staged(rows: DataFrame, at: str, path: str, batches: int) -> DataFrame:
    """A stream over `rows` in time order: consecutive ranges of `at`, one after the other, each a micro-batch."""
    bounds = rows.selectExpr(f"percentile_approx(unix_micros(cast({at} as timestamp)), array({', '.join(str(k / batches) for k in range(1, batches))}))").first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    epoch = datetime.datetime(1970, 1, 1)
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows
        part = part if low is None else part.where(f"{at} > timestamp_ntz'{epoch + datetime.timedelta(microseconds=low)}'")
        part = part if high is None else part.where(f"{at} <= timestamp_ntz'{epoch + datetime.timedelta(microseconds=high)}'")
        part.coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
