"""Streams whose result depends on the order of events: rows wait until the watermark has passed them, then are folded in order.

Rows of a key, or of a shard of very many keys, are kept in a map state by bucket of event time, one entry a bucket. A timer at a bucket's end fires when the watermark
passes it; no row of that bucket can come any more, so its rows are sorted and folded into the key's carried value. Rows that
come later than the watermark are dropped, by Spark or by the key's horizon. Arrivals in any order, and any cut into
micro-batches, give the same rows as the fold over the sorted table. The state holds what the lateness spans, and one
carried value a key. Needs the RocksDB state store.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftlake.operators.merge import drawn

Row = tuple
#: Groups of the keys of a stream that has very many of them (addresses, posts).
SHARDS = 256
#: (key, carried value or None, rows in order, end of what is known in microseconds) ->
#: (carried value or None, rows to put out, time in microseconds at which to be called again or None)
Fold = Callable[[tuple, Row | None, list[Row], int], tuple[Row | None, list[Row], int | None]]


def in_order_of(row: Row) -> list:
    return [(x is not None, x) for x in row]


def by_time(rows: list[Row]) -> list[Row]:
    """Rows in order, nulls first."""
    try:
        return sorted(rows)
    except TypeError:  # nulls are compared
        return sorted(rows, key=in_order_of)


def packed(rows: list[Row]) -> bytes:
    return pickle.dumps(rows, pickle.HIGHEST_PROTOCOL)


def unpacked(parts: bytes) -> Iterator[Row]:
    """The rows of ``packed`` lists that stand one behind the other."""
    stream = io.BytesIO(parts)
    while stream.tell() < len(parts):
        yield from pickle.load(stream)


def whole(column: pd.Series) -> list:
    """Values of a column; pandas' floats for whole numbers beside nulls are put right."""
    if column.dtype.kind in "iub":
        return column.tolist()
    if not column.isna().any():
        return [int(x) if isinstance(x, float) and x == int(x) else x for x in column.tolist()]
    return [None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x for x in column.tolist()]


class InOrder(StatefulProcessor):
    """Holds rows by bucket until the watermark passes the bucket's end, then folds them, key by key.

    A group is a key (``keys`` is empty) or a shard, whose rows and carried values begin with the columns ``keys``. The state keeps
    lists of rows as bytes: one value for Spark to convert and store, however many rows; later rows of a bucket are put behind.
    """

    def __init__(self, fold: Fold, keys: list[str], columns: list[str], kept: list[str], out: list[str], bucket_ms: int) -> None:
        self.fold, self.columns, self.kept, self.out, self.bucket_ms = fold, columns, kept, out, bucket_ms
        self.n = len(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")
        self.carry = handle.getValueState("carry", "keys binary")
        self.known = handle.getValueState("known", "bucket long")  # all buckets before this one are folded
        self.folded: dict[tuple, int] = {}

    def _bucket(self, us: int) -> int:
        return us // 1000 // self.bucket_ms

    def _wake(self, buckets: set[int]) -> None:
        """Timers at the ends of buckets."""
        for bucket in buckets:
            self.handle.registerTimer((bucket + 1) * self.bucket_ms)

    def _carried(self) -> dict[Row, tuple[int | None, Row]]:
        """Of each key of the group with a carried value: the time at which it is to be called, and the value."""
        return dict(unpacked(bytes(self.carry.get()[0]))) if self.carry.exists() else {}

    def _keep(self, carried: dict[Row, tuple[int | None, Row]]) -> None:
        if carried:
            self.carry.update((packed(list(carried.items())),))
        else:
            self.carry.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  names fixed by Spark
        """Rows of carried values; the fold is asked when to be called, without rows."""
        carried = self._carried()
        for row in zip(*(whole(initialState[c]) for c in self.kept)):
            own = row[: self.n]
            carry, _, wake = self.fold(own or tuple(key), row[self.n :], [], -(1 << 62))
            carried[own] = wake, carry
        self._keep(carried)
        self._wake({self._bucket(wake) for wake, _ in carried.values() if wake is not None})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.known.get()[0] if self.known.exists() else None
        new: dict[int, list[Row]] = {}
        for pdf in rows:
            for row in zip(*(whole(pdf[c]) for c in self.columns)):
                if row[self.n] is None:  # without a time a row has no place
                    continue
                bucket = self._bucket(row[self.n])
                if known is None or bucket >= known:
                    new.setdefault(bucket, []).append(row)
        for bucket, more in new.items():
            old = bytes(self.waiting.getValue((bucket,))[0]) if self.waiting.containsKey((bucket,)) else b""
            self.waiting.updateValue((bucket,), (old + packed(more),))
        self._wake(set(new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        horizon = timerValues.getCurrentWatermarkInMs() // self.bucket_ms
        if self.folded.get(key) == horizon:  # the group's first timer of a batch does the work of all
            return
        self.folded[key] = horizon
        carried = self._carried()
        due: dict[Row, list[Row]] = {k: [] for k, (wake, _) in carried.items() if wake is not None and self._bucket(wake) < horizon}
        for bucket in sorted(b for (b,) in list(self.waiting.keys()) if b < horizon):
            for row in unpacked(bytes(self.waiting.getValue((bucket,))[0])):
                due.setdefault(row[: self.n], []).append(row[self.n :])
            self.waiting.removeKey((bucket,))
        made: list[Row] = []
        woken = set()
        for own, rows in due.items():
            _, carry = carried.pop(own, (None, None))
            carry, out, wake = self.fold(own or tuple(key), carry, by_time(rows), horizon * self.bucket_ms * 1000)
            made += out
            if carry is not None:
                carried[own] = wake, carry
            if wake is not None:
                woken.add(self._bucket(wake))
        if due:
            self._keep(carried)
        self.known.update((horizon,))
        self._wake(woken)
        if made:
            yield pd.DataFrame(made, columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def in_order(
    df: DataFrame, *, keys: list[str], at: str, payload: list[str], fold: Fold, carried: str, out: str, late: str, bucket_ms: int, history: DataFrame | None = None, shards: int | None = None
) -> DataFrame:
    """Each key's rows folded by time and then ``payload``. ``late``: how much later than others a row may come.

    ``carried`` and ``out`` are DDL; ``history`` has the keys and columns of carried values to begin with. Where keys are many and each
    has few rows, they are kept together in ``shards`` groups by a hash: a call of Python and an access to the state then serve a group's keys.
    """
    within = keys if shards else []
    held = [*within, "us", *payload]
    kept = [*within, *[c.split()[0] for c in carried.split(",")]]

    def grouped(rows: DataFrame):
        return rows.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards))).groupBy("_shard") if shards else rows.groupBy(*keys)

    rows = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(*keys, at, F.unix_micros(at).alias("us"), *payload)
    names = [c.split()[0] for c in out.split(",")]
    return grouped(rows).transformWithStateInPandas(
        statefulProcessor=InOrder(fold, within, held, kept, names, bucket_ms),
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime",
        initialState=grouped(history) if history is not None else None,
    )


def token_bucket(requests: DataFrame, *, key: str = "key", at: str = "at", tie: str, capacity: float = 60.0, refill: float = 1.0, late: str = "1 day", bucket_ms: int = 3_600_000) -> DataFrame:
    """``key``, ``us`` (of ``at``), ``tie``, ``admitted`` and ``wait_s`` of each request: what ``merge.token_bucket`` gives, on a stream."""

    def fold(name: Row, carry: Row | None, rows: list[Row], until: int):
        tokens, last = carry or (capacity, None)
        out = []
        for us, which in rows:
            tokens, last, admitted, wait = drawn(tokens, last, us / 1e6, capacity, refill)
            out.append((name[0], us, which, admitted, wait))
        return (float(tokens), last), out, None

    kinds = dict(requests.dtypes)
    out = f"{key} {kinds[key]}, us long, {tie} {kinds[tie]}, admitted boolean, wait_s double"
    return in_order(requests, keys=[key], at=at, payload=[tie], fold=fold, carried="tokens double, last double", out=out, late=late, bucket_ms=bucket_ms)


def spend_cap(
    calls: DataFrame, *, day: str, at: str, tie: str, micro: str, cap: int, late: str = "1 day", keep_us: int = 48 * 3_600_000_000, bucket_ms: int = 3_600_000
) -> DataFrame:
    """Each call of a day in order: ``spent_before`` it, ``admitted`` (below ``cap``; 0 admits all), ``breached_us``: when the day's spend first reached the cap.

    A day's state goes ``keep_us`` after its last call.
    """

    def fold(name: Row, carry: Row | None, rows: list[Row], until: int):
        spent, breached, last = carry or (0, None, 0)
        out = []
        for us, which, cost in rows:
            out.append((name[0], us, which, spent, not cap or spent < cap, breached))
            spent, last = spent + (cost or 0), us
            if cap and spent >= cap and breached is None:
                breached = us
        if last + keep_us <= until:
            return None, out, None
        return (spent, breached, last), out, last + keep_us

    kinds = dict(calls.dtypes)
    out = f"{day} {kinds[day]}, us long, {tie} {kinds[tie]}, spent_before long, admitted boolean, breached_us long"
    return in_order(calls, keys=[day], at=at, payload=[tie, micro], fold=fold, carried="spent long, breached long, last long", out=out, late=late, bucket_ms=bucket_ms)


def first_of_ttl(df: DataFrame, *, url: str, at: str, ttl_us: int, late: str = "1 day", history: DataFrame | None = None, bucket_ms: int = 3_600_000, shards: int = SHARDS) -> DataFrame:
    """``url`` and ``us``: each address's events that come at least ``ttl_us`` after the last one let through.

    The time counts from the event let through and is not renewed by those held back. ``history``: ``url`` and ``first_us``,
    what was let through before the stream. An address's state goes when its time is over.
    """

    def fold(name: Row, carry: Row | None, rows: list[Row], until: int):
        first = carry[0] if carry else None
        out = []
        for (us,) in rows:
            if first is None or us >= first + ttl_us:
                first = us
                out.append((name[0], us))
        if first is None or first + ttl_us <= until:
            return None, out, None
        return (first,), out, first + ttl_us

    out = f"{url} {dict(df.dtypes)[url]}, us long"
    return in_order(df, keys=[url], at=at, payload=[], fold=fold, carried="first_us long", out=out, late=late, bucket_ms=bucket_ms, history=history, shards=shards)


def queue_step(carry: Row | None, us: int, event: str, timeout_us: int, most: int) -> tuple[Row | None, list[tuple[int, str, int]]]:
    """One event of a post: what becomes of its state, and the actions due before it."""
    carry, actions = overdue(carry, us, timeout_us, most)
    status, tries, since = carry or ("", 0, 0)
    if event == "claimed":
        return ("claimed", tries, us), actions
    if event == "acked":  # the count of tries goes; a post given out again waits in the queue all the same
        return (("queued", 0, since) if status == "queued" else None), actions
    if event == "queued" and status in ("", "dead"):
        return ("queued", 0, us), actions
    return carry, actions


def overdue(carry: Row | None, us: int, timeout_us: int, most: int) -> tuple[Row | None, list[tuple[int, str, int]]]:
    """A claim whose time is over at ``us`` is given out again or, after ``most`` tries, is a dead letter. Waiting in the queue takes no time."""
    if carry is None or carry[0] != "claimed" or carry[2] + timeout_us > us:
        return carry, []
    _, tries, since = carry
    if tries >= most:
        return ("dead", 0, since + timeout_us), [(since + timeout_us, "dead_letter", tries)]
    return ("queued", tries + 1, since + timeout_us), [(since + timeout_us, "requeue", tries + 1)]


def queue_machine(
    log: DataFrame, *, post: str = "post_id", at: str = "at", event: str = "event", tie: str, timeout_us: int = 300_000_000, most: int = 3, late: str = "1 day", bucket_ms: int = 3_600_000, shards: int = SHARDS
) -> DataFrame:
    """Actions of a log of posts (queued, claimed, acked): ``post``, ``us``, ``action`` (requeue, dead_letter), ``tries``.

    Time runs from a claim to its acknowledgement: ``timeout_us`` after a claim without one (at that very moment too) the post goes back
    into the queue, where it waits without a limit for the next claim; the claim after ``most`` such tries makes it a dead letter. A dead
    letter begins anew when it is queued or claimed. Deadlines fall in event time, so a log gives the same actions whenever it is read.
    """

    def fold(name: Row, carry: Row | None, rows: list[Row], until: int):
        out: list[tuple[int, str, int]] = []
        for us, _, what in rows:
            carry, actions = queue_step(carry, us, what, timeout_us, most)
            out += actions
        carry, actions = overdue(carry, until - 1, timeout_us, most)
        claimed = carry is not None and carry[0] == "claimed"
        return carry, [(name[0], *a) for a in out + actions], carry[2] + timeout_us if claimed else None

    out = f"{post} {dict(log.dtypes)[post]}, us long, action string, tries int"
    return in_order(log, keys=[post], at=at, payload=[tie, event], fold=fold, carried="status string, tries int, since long", out=out, late=late, bucket_ms=bucket_ms, shards=shards)


def settings(partitions: int) -> dict[str, Any]:
    """Settings of a session that starts such a stream: the state store, and how many stores."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(partitions)}
