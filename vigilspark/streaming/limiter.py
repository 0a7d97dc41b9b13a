"""Stateful fixed-window limiter for streams (S3), with replay dedup.

``transformWithState`` keyed by client and lane.  A window belongs to one of ``LANES``
lanes by its start, so the windows of a busy client are counted by many tasks; windows
are independent of each other, so the lanes change no result.  State per key: the counts
of its open windows in one value and, with ``dedup_ms``, a map from window to the request
ids seen in it (a replay has its original's time, so it meets the same window).  A batch
reads and writes the ids of the windows that it touches and no others.  An
event-time timer clears what has ended once the watermark passes the key's last
window (plus ``dedup_ms``), so an idle client leaves nothing behind.  State lives
in RocksDB.

Rows of a micro-batch are taken in (event time, id) order, so on ordered input the
result equals the batch operator.  Rows are not held: a row that cannot be among
its window's first ``limit`` is passed on at once, the others wait for the
end of the key's rows.

A row whose window end is at or behind the watermark at the start of the batch
is *late*: it is reported with ``late = true`` and ``allowed = NULL`` instead of
being counted.  The operator takes the event time as a plain number, so Spark does
not drop late rows before they get here.  A replay that comes after its window's
ids were let go is reported again, as late: at least once, never lost.  A row
without a timestamp has no window and is late; its id is not remembered.
"""

from __future__ import annotations

from bisect import insort

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StructType

from ..functions import rules

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LANES = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class WindowLimiter(StatefulProcessor):
    """Input rows (client, window_start, _end_ms, _order, *out columns) of one client's lane."""

    def __init__(self, out_cols: list[str], id_col: str, limit: int, dedup_ms: int | None):
        self.out_cols, self.id_col, self.limit, self.dedup_ms = out_cols, id_col, limit, dedup_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", "ends array<long>, requests array<long>")
        self.ids = handle.getMapState("ids", "window_end long", "ids array<string>") if self.dedup_ms is not None else None

    def _open(self) -> dict:
        held = self.windows.get()
        return dict(zip(held[0], held[1])) if held else {}

    def _keep(self, counts: dict, watermark: int) -> None:
        """Writes the windows that have not ended (for ids: ended ``dedup_ms`` ago)."""
        alive = {e: n for e, n in counts.items() if e + (self.dedup_ms or 0) > watermark}
        if self.ids is not None:
            for e in counts.keys() - alive.keys():
                self.ids.removeKey((e,))
        if alive:
            self.windows.update((list(alive), list(alive.values())))
            self.handle.registerTimer(max(alive) + (self.dedup_ms or 0))
        elif counts:
            self.windows.clear()

    def _out(self, row, allowed, late):
        return Row(**{c: row[c] for c in self.out_cols}, allowed=allowed, late=late)

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        counts = self._open()
        before, first, seen, more = dict(counts), {}, {}, set()
        for i, row in enumerate(rows):
            end = row["_end_ms"]
            if end is None:
                yield self._out(row, None, True)
                continue
            if self.ids is not None:
                if end not in seen:
                    known = self.ids.getValue((end,)) if end in before else None
                    seen[end] = set(known[0]) if known else set()
                name = str(row[self.id_col])
                if name in seen[end]:
                    continue
                seen[end].add(name)
                more.add(end)
                counts.setdefault(end, 0)
            if end <= watermark:
                yield self._out(row, None, True)
                continue
            counts[end] = counts.get(end, 0) + 1
            room = self.limit - before.get(end, 0)
            if room <= 0:
                yield self._out(row, False, False)
                continue
            ahead = first.setdefault(end, [])
            insort(ahead, ((row["_order"], row[self.id_col]), i, row))
            if len(ahead) > room:
                yield self._out(ahead.pop()[2], False, False)
        for ahead in first.values():
            for _, _, row in ahead:
                yield self._out(row, True, False)
        for end in more:
            if end + self.dedup_ms > watermark:
                self.ids.updateValue((end,), (sorted(seen[end]),))
        self._keep(counts, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._keep(self._open(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def stream_rate_limit(df: DataFrame, client_col: str, ts_col: str, id_col: str,
                      limit: int = rules.MAX_REQUESTS_PER_MINUTE, unit: str = "minute",
                      delay: str | None = "5 minutes", passthrough: list[str] | None = None,
                      dedup_ms: int | None = None) -> DataFrame:
    """Input rows plus (window_start, allowed, late) for a streaming frame;
    ``dedup_ms`` drops replayed ids.  ``ts_col`` must be TIMESTAMP (cast ntz
    first); windows follow the session's wall clock.  ``delay=None`` when the
    caller already set the watermark.  The query's state store must be RocksDB
    (set here for the session)."""
    df.sparkSession.conf.set(PROVIDER, ROCKSDB)
    cols = [id_col, client_col, ts_col] + [c for c in (passthrough or []) if c not in (id_col, client_col, ts_col)]
    src = df.select(*cols)
    if delay:
        src = src.withWatermark(ts_col, delay)
    start = F.date_trunc(unit, F.col(ts_col))
    # the event time goes in as a number: a watermarked column would make Spark drop late rows
    keyed = src.withColumn("window_start", F.timestamp_micros(F.unix_micros(start))) \
        .withColumn("_end_ms", F.unix_millis(F.timestamp_add(unit.upper(), F.lit(1), F.col("window_start")))) \
        .withColumn("_order", F.unix_micros(ts_col)) \
        .withColumn(ts_col, F.timestamp_micros(F.unix_micros(ts_col))) \
        .withColumn("_lane", F.pmod(F.xxhash64("window_start"), F.lit(LANES)))
    out_cols = cols + ["window_start"]
    out = StructType([keyed.schema[c] for c in out_cols]).add("allowed", BooleanType()).add("late", BooleanType())
    out = StructType.fromJson({**out.jsonValue(), "fields": [{**f, "nullable": True, "metadata": {}} for f in out.jsonValue()["fields"]]})
    limiter = WindowLimiter(out_cols, id_col, limit, dedup_ms)
    return keyed.groupBy(client_col, "_lane").transformWithState(limiter, out, "append", "EventTime")
