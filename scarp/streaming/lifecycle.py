"""The life of alerts as a stream: decisions as assessments arrive, and expiry when time has passed, without a further row.

State is each site's last active alert. A timer stands at its expiry; when the watermark passes it, the alert is reported as
expired and the site's state goes, so silent sites hold none. High alerts don't expire and keep their state, which is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from ..operators.alerts import DECIDED, Site

FIELDS = [x.split() for x in DECIDED.split(", ")]
STATE = f"{DECIDED}, score double"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class AlertLife(StatefulProcessor):
    def __init__(self, automatic: tuple[str, ...]) -> None:
        self.automatic = automatic

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def held(self) -> dict | None:
        if not self.last.exists():
            return None
        return dict(zip([n for n, _ in FIELDS] + ["score"], self.last.get()))

    def told(self, alert: dict, **changed) -> Row:
        return Row(**({n: alert[n] for n, _ in FIELDS} | changed))

    def ended(self, alert: dict) -> Row:
        return self.told(alert, kind="expired", status="expired", available=alert["expires"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.held()
        own = Site(before)
        for row in sorted((r.asDict() for r in rows), key=lambda r: (r["at"], r["assessment_id"])):
            if own.prev and own.prev["level"] != "high" and own.prev["expires"] < row["at"]:
                yield self.ended(own.prev)
                own.prev = None
            if new := own.see(row, self.automatic):
                yield self.told(new)
        if own.prev is not None and own.prev is not before:
            self.last.update(tuple(own.prev[n] for n, _ in FIELDS) + (own.prev["score"],))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if own.prev["level"] != "high":
                self.handle.registerTimer(own.prev["expires"] // 1000 + 1)
        elif own.prev is None and before is not None:
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        alert = self.held()
        if alert is not None and alert["level"] != "high" and alert["expires"] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield self.ended(alert)

    def close(self) -> None:
        pass


def alert_life(assessments: DataFrame, automatic: tuple[str, ...] = ("high",)) -> DataFrame:
    """Rows of the alert fold, and one of kind and status ``expired`` for each alert that ends by itself, ``available`` at its
    expiry. ``assessments`` is a stream with a watermark; it needs a state store with timers (``ROCKS``)."""
    return assessments.groupBy("site_id").transformWithState(AlertLife(automatic), DECIDED, "Append", "EventTime")
