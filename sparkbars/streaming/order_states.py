"""Order lifecycle: status, timeout decisions, and one final report per order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkbars.streaming.state import arrays_of, bucket_of, use_state_store

# Order statuses and time limits.
OPEN_STATUSES = ["NEW", "PARTIALLY_FILLED"]
TERMINAL_STATUSES = ["FILLED", "CANCELED", "EXPIRED", "REJECTED"]
ORDER_TIMEOUT_MS = 180_000
PRUNE_AGE_MS = 600_000
MAX_REPRICE_ATTEMPTS = 2

_OUT = (
    "client_order_id string, symbol string, side string, quantity double, price double, status string, "
    "filled_quantity double, reason string, action string, at_ms long"
)
_STATE = (
    "client_order_id string, symbol string, side string, quantity double, price double, status string, filled double, "
    "attempts int, created_ms long, reported boolean"
)
_COLUMNS = ["client_order_id", "ts_ms", "is_update", "status", "filled_quantity", "symbol", "side", "quantity", "price", "attempts"]
STATUS, FILLED, ATTEMPTS, CREATED, REPORTED = 5, 6, 7, 8, 9  # places in the state of an order


class OrderStates(StatefulProcessor):
    """The orders of a bucket: follows their statuses, reports the end of each once, decides when it times out.

    Updates of an order that was never registered are ignored. A timed-out order is
    cancelled and repriced until its attempts are used up, then only cancelled; what
    the exchange says about that order later is not reported again. A bucket holds one timer, the
    earliest of its orders; when it expires, all orders that are due by the watermark are settled.
    """

    def __init__(self, timeout_ms: int, prune_ms: int, max_attempts: int):
        self.timeout_ms, self.prune_ms, self.max_attempts = timeout_ms, prune_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("orders", arrays_of(_STATE) + ", timer_ms long")

    def _load(self) -> tuple[dict[str | None, list], int | None]:
        if not self.state.exists():
            return {}, None
        *arrays, timer = self.state.get()
        return {s[0]: list(s) for s in zip(*arrays, strict=True)}, timer

    def _store(self, orders: dict[str | None, list], known_timer: int | None, expired: bool = False) -> None:
        timer = min((self._next_due(s) for s in orders.values()), default=None)
        if timer != known_timer or expired:
            if known_timer is not None and not expired:
                self.handle.deleteTimer(known_timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        if orders:
            self.state.update((*map(list, zip(*orders.values(), strict=True)), timer))
        elif self.state.exists():
            self.state.clear()

    def _next_due(self, s) -> int:
        """When the order times out or, if its end is reported, may be forgotten."""
        return s[CREATED] + (self.prune_ms if s[REPORTED] else self.timeout_ms)

    @staticmethod
    def _row(s, reason, action, at):
        return (*s[: FILLED + 1], reason, action, int(at))

    @staticmethod
    def _table(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=[f.split()[0] for f in _OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        orders, timer = self._load()
        inputs = pd.concat([r[_COLUMNS] for r in rows], ignore_index=True)
        inputs = inputs.sort_values(["ts_ms", "is_update"], kind="stable")
        found = []
        for order, ts, is_update, status, filled, symbol, side, quantity, price, attempts in zip(*(inputs[c].tolist() for c in _COLUMNS)):
            s = orders.get(order)
            if not is_update:
                if s is None:
                    orders[order] = [order, symbol, side, float(quantity), float(price), "NEW", 0.0, int(attempts), int(ts), False]
                continue
            if s is None:
                continue
            if not s[REPORTED] and ts - s[CREATED] >= self.timeout_ms:
                # The deadline lies before this update, although both arrived together.
                found.append(self._time_out(s))
            if status in OPEN_STATUSES or status in TERMINAL_STATUSES:
                s[STATUS] = status
            s[FILLED] = float(filled)
            if status in TERMINAL_STATUSES and not s[REPORTED]:
                s[REPORTED] = True
                found.append(self._row(s, "exchange", "report", ts))
        self._store(orders, timer)
        if found:
            yield self._table(found)

    def _time_out(self, s):
        exhausted = s[ATTEMPTS] >= self.max_attempts
        s[STATUS], s[REPORTED] = "CANCELED", True
        return self._row(s, "timeout_exhausted" if exhausted else "timeout", "cancel" if exhausted else "cancel_reprice",
                         s[CREATED] + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        orders, timer = self._load()
        now = max(expiredTimerInfo.getExpiryTimeInMs() + 1, timerValues.getCurrentWatermarkInMs())
        found = []
        for order, s in list(orders.items()):
            if not s[REPORTED] and s[CREATED] + self.timeout_ms < now:
                found.append(self._time_out(s))
            if s[REPORTED] and s[CREATED] + self.prune_ms < now:
                del orders[order]
        self._store(orders, timer, expired=True)
        if found:
            yield self._table(found)

    def close(self) -> None:
        pass


def stream_orders(
    messages: DataFrame,
    event_time: str = "ts",
    delay: str = "0 seconds",
    timeout_ms: int = ORDER_TIMEOUT_MS,
    prune_ms: int = PRUNE_AGE_MS,
    max_attempts: int = MAX_REPRICE_ATTEMPTS,
) -> DataFrame:
    """Reports and timeout decisions of an order feed.

    ``messages``: client_order_id, event time, is_update, status, filled_quantity, symbol,
    side, quantity, price, attempts; a row that is no update registers the order.
    """
    use_state_store(messages.sparkSession)
    timed = messages.withColumn("ts_ms", F.unix_millis(F.col(event_time).cast("timestamp"))).withColumn(
        "_event_time", F.col(event_time).cast("timestamp")
    ).withWatermark("_event_time", delay)
    return timed.select(bucket_of("client_order_id").alias("bucket"), "_event_time", *_COLUMNS).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OrderStates(timeout_ms, prune_ms, max_attempts), outputStructType=_OUT,
        outputMode="Append", timeMode="EventTime",
    )
