"""Rate limits on clients: a cooldown, so many requests a window, and a cap on tracked clients.

The rule (:class:`Limiter`) is one for the stream, the batch form and tests: clients of a bucket share a cap on
how many are tracked and a clean-up clock. It is sequential in a bucket's events by nature, so buckets
are what spreads it; its state is bounded by `tracked` clients of at most `most` times each, whatever comes in.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "event_id long, user_id long, bucket long, ts timestamp, in_window int, allowed boolean, retry_after double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State of this kind lies in RocksDB only: the session's store is set to it where it isn't set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name, "HDFSBacked"):
        spark.conf.set(name, ROCKS)


def admit(times: deque, now: float, most: int, seconds: float, cooldown: float) -> float:
    """Seconds that a client with these admitted `times` has to wait at `now`; 0 admits the request and adds its time."""
    if times and cooldown > 0 and (rest := cooldown - (now - times[-1])) > 0:
        return rest
    if len(times) >= most:
        return max(1.0, times[0] + seconds - now)
    times.append(now)
    return 0.0


def decide(times: deque, now: float, most: int, seconds: float, cooldown: float) -> float:
    """:func:`admit` for a client by itself, whose times are cleaned at each request."""
    while times and times[0] <= now - seconds:
        times.popleft()
    return admit(times, now, most, seconds, cooldown)


class Limiter:
    """Decides requests in the order of time.

    Every `interval` (a minute, or the window if that is shorter) times that have left the window go, and clients without
    any with them; between clean-ups they still count. A client that is not tracked waits an interval while `tracked`
    others are; else one within `cooldown` of its last admitted request waits for the rest of it, and one with `most` admitted
    requests until the first leaves the window, a second at least. Refused requests don't count.
    """

    def __init__(self, most: int, seconds: float, cooldown: float = 0.0, tracked: int = 10_000):
        self.most, self.seconds, self.cooldown, self.tracked = most, seconds, cooldown, tracked
        self.interval = min(60.0, seconds)
        self.clients: dict[object, deque] = {}
        self.cleaned = float("-inf")
        self.touched: set = set()  # clients whose times have changed since it was cleared
        self.gone: set = set()

    def wait(self, client: object, now: float) -> float:
        """Seconds that the client has to wait at `now`; 0 admits the request."""
        if now - self.cleaned >= self.interval:
            for key in list(self.clients):
                times = self.clients[key]
                if times[0] <= now - self.seconds:
                    self.touched.add(key)
                while times and times[0] <= now - self.seconds:
                    times.popleft()
                if not times:
                    del self.clients[key]
                    self.touched.discard(key)
                    self.gone.add(key)
            self.cleaned = now
        times = self.clients.get(client)
        if times is None and len(self.clients) >= self.tracked:
            return self.interval
        times = deque() if times is None else times
        if (rest := admit(times, now, self.most, self.seconds, self.cooldown)) > 0:
            return rest
        self.clients[client] = times
        self.touched.add(client)
        self.gone.discard(client)
        return 0.0

    def decided(self, clients: list, now: list[float]) -> tuple[list[float], list[int]]:
        """Each request's wait, and how many admitted ones of its client count after it."""
        waits, held = [], []
        for client, at in zip(clients, now, strict=True):
            waits.append(self.wait(client, at))
            held.append(len(self.clients.get(client, ())))
        return waits, held


class _Limits(StatefulProcessor):
    """One bucket's limiter: its clients are a map state, of which a batch writes only what it has changed."""

    def __init__(self, options: dict):
        self.options = options

    def init(self, handle) -> None:
        self.clients = handle.getMapState("clients", "client long", "times array<double>")
        self.cleaned = handle.getValueState("cleaned", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule = Limiter(**self.options)
        rule.clients = {k[0]: deque(v[0]) for k, v in self.clients.iterator()}
        if self.cleaned.exists():
            rule.cleaned = self.cleaned.get()[0]
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        now = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        waits, held = rule.decided(frame["user_id"].tolist(), now.tolist())
        for client in rule.gone - rule.clients.keys():
            if self.clients.containsKey((client,)):
                self.clients.removeKey((client,))
        for client in rule.touched:
            self.clients.updateValue((client,), (list(rule.clients[client]),))
        self.cleaned.update((rule.cleaned,))
        yield pd.DataFrame({"event_id": frame["event_id"], "user_id": frame["user_id"], "bucket": key[0], "ts": frame["ts"], "in_window": held, "allowed": [w == 0.0 for w in waits], "retry_after": waits})

    def close(self) -> None:
        pass


def _options(most: int, seconds: float, cooldown: float, tracked: int) -> dict:
    return {"most": most, "seconds": seconds, "cooldown": cooldown, "tracked": tracked}


def _bucketed(events: DataFrame, bucket: Column | None, buckets: int) -> DataFrame:
    own = F.pmod(F.xxhash64("user_id"), F.lit(buckets)) if bucket is None else bucket
    return events.select("event_id", "user_id", own.cast("long").alias("bucket"), F.col("ts").cast("timestamp").alias("ts"))


def limited(events: DataFrame, most: int = 5, seconds: float = 3600.0, cooldown: float = 0.0, *, tracked: int = 10_000, bucket: Column | None = None, buckets: int = 64) -> DataFrame:
    """Streaming `events` (event_id, user_id, ts) with bucket, in_window (admitted requests that count), allowed and retry_after, 0 where admitted.

    `tracked` is each bucket's cap. State lies in RocksDB (see :func:`keyed_state`); a client leaves it when its bucket is cleaned, so
    neither timers nor a clock are needed and a run with availableNow ends by itself. Events of one
    micro-batch are decided in the order of (ts, event_id), micro-batches in theirs; a row whose time is
    before what its bucket has seen is decided by the state it meets. Null times and clients are no requests and give no row.
    """
    keyed_state(events.sparkSession)
    rows = _bucketed(events, bucket, buckets).where("ts is not null and user_id is not null")
    return rows.groupBy("bucket").transformWithStateInPandas(_Limits(_options(most, seconds, cooldown, tracked)), OUT, "Append", "None")


def limits(events: DataFrame, most: int = 5, seconds: float = 3600.0, cooldown: float = 0.0, *, tracked: int = 10_000, bucket: Column | None = None, buckets: int = 64) -> DataFrame:
    """The batch twin of :func:`limited`: each bucket's events in the order of time, streamed through a task that holds only the rule's state."""
    options = _options(most, seconds, cooldown, tracked)
    rows = _bucketed(events, bucket, buckets).where("ts is not null and user_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, own = None, None
        for b in batches:
            waits, held = [], []
            now = (b.column(3).cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy() / 1e6).tolist()
            for client, key, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), now, strict=True):
                if rule is None or key != own:
                    rule, own = Limiter(**options), key
                one, some = rule.decided([client], [t])
                waits += one
                held += some
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held, pa.int32()), pa.array([w == 0.0 for w in waits]), pa.array(waits, pa.float64())], [*b.schema.names, "in_window", "allowed", "retry_after"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "ts", "event_id").mapInArrow(run, OUT)


def window_load(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Batch: how many events each client has had in the window that ends with each event.

    Events and the beginnings of their windows are put in one order, and the count up to a window's beginning is taken
    from the count at its end; see `scans` for how one client's rows are spread.
    """
    from rillstone.operators.scans import scanned

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.select("event_id", "user_id", at.alias("at"), F.lit(1).alias("one"), F.lit(1).alias("end"))
    begun = events.select("event_id", "user_id", (at - seconds * 1_000_000).alias("at"), F.lit(0).alias("one"), F.lit(0).alias("end"))
    # At one time beginnings stand first: an event at the very beginning of a window is in it.
    counted = scanned(own.unionByName(begun), ["user_id"], ["at", "end", "event_id"], {"n": ("sum", F.col("one"))})
    # Events at one time all count for each other.
    last = counted.where("end = 1").groupBy("user_id", "at").agg(F.max("n").alias("upto"))
    ends = counted.where("end = 1").select("event_id", "user_id", "at").join(last, ["user_id", "at"])
    starts = counted.where("end = 0").select("event_id", F.col("n").alias("before"))
    return ends.join(starts, "event_id").select("event_id", "user_id", (F.col("upto") - F.col("before")).alias("n"))
