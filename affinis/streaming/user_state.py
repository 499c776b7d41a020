"""Running features and last liked items of users, kept in state alone: no job reads a user's history again.

A user's state is the merged count, mean and squared deviation of the ratings, the time last seen, and the newest
``HISTORY_ROWS`` + 1 rows in order of time, which is all that the last liked items of the newest row can depend on. Events may
come in any order: sums merge in any order, and an older event goes to its place among the newest rows or is too
old for them.

At scale: before the shuffle each task turns its rows of a batch, some hundred thousand together, into one row a user: sums and at
most ``HISTORY_ROWS`` + 1 newest rows, whatever the number of events. A user with a third of all events so costs a task one row, and the state of any
user is bounded. Only users of the batch are put out.

Defined results: an event without user is left out; one without time has no place in an order: it counts, but is no
latest row; a null rating is no positive and counts only as an event; equal times go by event id, a null one first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from affinis import session, settings
from affinis.streaming.revisions import RevisionTable

# Tasks get these functions by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT = settings.HISTORY_ROWS + 1
_STORE = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
LIKED = [f"user_rated_item_{i}" for i in range(1, settings.HISTORY_SHOWN + 1)]
FEATURES = "user_id long, " + "".join(f"{c} long, " for c in LIKED) + (
    "user_rating_count long, user_avg_rating double, user_rating_stddev double, last_ts timestamp")
_SUMS = "events long, rated long, mean double, squares double"
_ROWS = "times array<long>, ids array<long>, items array<long>, liked array<boolean>"
PARTIAL = f"user_id long, {_SUMS}, {_ROWS}"
_STATE = "sums binary, rows binary"


def merge(a: tuple[int, int, float, float], b: tuple[int, int, float, float]) -> tuple[int, int, float, float]:
    """Events, rated ones, mean and squared deviations of two parts together."""
    rated = a[1] + b[1]
    if not rated:
        return a[0] + b[0], 0, 0.0, 0.0
    apart = b[2] - a[2]
    mean = a[2] + apart * b[1] / rated
    return a[0] + b[0], rated, mean, a[3] + b[3] + apart * apart * a[1] * b[1] / rated


# A user's sums and rows as bytes: they pass the shuffle, the worker and the store without a copy for each number.
_SUM = np.dtype([("events", "<i8"), ("rated", "<i8"), ("mean", "<f8"), ("squares", "<f8")])
_ROW = np.dtype([("time", "<i8"), ("id", "<i8"), ("item", "<i8"), ("liked", "?"), ("no_id", "?"), ("no_item", "?")])


def newest(rows: np.ndarray, n: int = KEPT) -> np.ndarray:
    """The last ``n`` rows, oldest first."""
    return rows[np.lexsort((rows["id"], ~rows["no_id"], rows["time"]))[-n:]]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches together, about ``rows`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _partials(batches: Iterator[pa.RecordBatch], at_once: int = 250_000) -> Iterator[pa.RecordBatch]:
    """One row a user for so many rows of a task."""
    for rows in _gathered(batches, at_once):
        def filled(name: str, nothing) -> tuple[np.ndarray, np.ndarray]:
            column = rows.column(name)
            return column.fill_null(nothing).to_numpy(), column.is_valid().to_numpy()

        user = rows.column("user_id").to_numpy()
        (us, timed), (event, has_event), (item, has_item) = (filled(c, 0) for c in ("us", "event_id", "item_id"))
        (rating, is_rated), (liked, _) = filled("rating", 0.0), filled("liked", False)
        order = np.lexsort((event, has_event, us, timed, user))
        user, rating, is_rated, timed = user[order], rating[order], is_rated[order], timed[order]
        first = np.flatnonzero(np.diff(user, prepend=user[0] - 1))
        events = np.diff(np.append(first, len(user)))
        rated = np.add.reduceat(is_rated.astype(np.int64), first)
        mean = np.add.reduceat(rating, first) / np.maximum(rated, 1)
        apart = np.where(is_rated, rating - np.repeat(mean, events), 0.0)
        from_end = np.repeat(first + events, events) - np.arange(len(user))
        kept = timed & (from_end <= KEPT)
        ends = pa.array(np.append(0, np.cumsum(np.add.reduceat(kept.astype(np.int64), first))), pa.int32())
        at = order[kept]
        lists = [pa.array(us[at]), pa.array(event[at], mask=~has_event[at]), pa.array(item[at], mask=~has_item[at]), pa.array(liked[at])]
        columns = [pa.array(x) for x in (user[first], events, rated, mean, np.add.reduceat(apart * apart, first))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(ends, x) for x in lists)], [c.split()[0] for c in PARTIAL.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial rows of a task, sums and rows as bytes."""
    for part in _partials(batches):
        sums = np.empty(part.num_rows, _SUM)
        for name in _SUM.names:
            sums[name] = part.column(name).to_numpy()
        times, ids, items, liked = (part.column(c) for c in ("times", "ids", "items", "liked"))
        rows = np.empty(len(times.values), _ROW)
        rows["time"], rows["liked"] = times.values.to_numpy(), liked.values.to_numpy(zero_copy_only=False)
        for name, none, column in (("id", "no_id", ids), ("item", "no_item", items)):
            rows[name], rows[none] = column.values.fill_null(0).to_numpy(), column.values.is_null().to_numpy(zero_copy_only=False)
        ends = np.arange(part.num_rows + 1, dtype=np.int32) * _SUM.itemsize, times.offsets.to_numpy() * np.int32(_ROW.itemsize)
        packs = [pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(e), pa.py_buffer(x.tobytes())]) for e, x in zip(ends, (sums, rows))]
        yield pa.RecordBatch.from_arrays([part.column("user_id"), *packs], ["user_id", "sums", "rows"])


class UserState(StatefulProcessor):
    """Merges the parts of a batch into a user's state and puts out the features as of the newest row.

    The state is one value, read and written once for a user and batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("user", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get()
        parts = [*([before] if before else []), *((r.sums, r.rows) for r in rows)]
        sums = (0, 0, 0.0, 0.0)
        for part in np.frombuffer(b"".join(p[0] for p in parts), _SUM).tolist():
            sums = merge(sums, part)
        kept = newest(np.frombuffer(b"".join(p[1] for p in parts), _ROW))
        self.state.update((np.array([sums], _SUM).tobytes(), kept.tobytes()))
        older = kept[:-1][::-1]
        positive = [None if r["no_item"] else int(r["item"]) for r in older[older["liked"]][: len(LIKED)]]
        events, rated, mean, squares = sums
        yield Row(user_id=key[0], **dict(zip(LIKED, positive + [0] * (len(LIKED) - len(positive)))), user_rating_count=events,
                  user_avg_rating=mean if rated else None, user_rating_stddev=(squares / (rated - 1)) ** 0.5 if rated > 1 else 0.0,
                  last_ts=int(kept[-1]["time"]) if len(kept) else None)

    def close(self) -> None:
        pass


def state_features(interactions: DataFrame) -> DataFrame:
    """A stream of the features of every user that a batch touches; ``interactions`` hold each event once."""
    liked = (F.col("rating") >= settings.POSITIVE_RATING) | (F.col("rating") == settings.UNRATED)
    rows = interactions.where(F.col("user_id").isNotNull()).select(
        "user_id", "event_id", "item_id", F.col("rating").cast("double").alias("rating"),
        F.coalesce(liked, F.lit(False)).alias("liked"), F.unix_micros("ts").alias("us"))
    parts = rows.mapInArrow(_packed, f"user_id long, {_STATE}")
    return parts.groupBy("user_id").transformWithState(UserState(), FEATURES, "append", "none")


def keep_state_features(stream: DataFrame, table: RevisionTable, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Write the features of each batch's users as one revision; what has arrived is worked off, state stays in the checkpoint.

    Only the RocksDB store can hold the state of such a processor. Each batch opens one store and one worker for a partition of each
    operator, whatever its rows, so there is one ``partitions`` for each slot, and no more than the session's; the
    checkpoint keeps the first number. A query takes both from the session it starts in, so they are
    set for the start alone; other streams of the session keep theirs.
    """
    writer = (
        state_features(stream)
        .writeStream.outputMode("append")
        .foreachBatch(lambda rows, batch_id: table.write(rows, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    spark = stream.sparkSession
    most = int(spark.conf.get(_PARTITIONS))
    wanted = {_STORE: session.DEFAULTS[_STORE], _PARTITIONS: str(partitions or min(most, spark.sparkContext.defaultParallelism))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
