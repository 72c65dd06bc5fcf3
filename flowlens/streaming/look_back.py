"""What an alert's accounts did in the hours before it, kept as state of a stream.

A transfer goes to the state of each of its accounts.  Accounts are dealt to
parts, a state key each, so that a call serves many of them.  A part keeps its
accounts' moments (the sums of an account's transfers at one second) of the
look-back, so a hub has one a second at most in each batch, and open alerts.  An alert is answered
when the watermark has passed it: transfers that come late, but within the
watermark's delay, still count, and the answer depends neither on the batches
nor on restarts.  Timers answer alerts and evict what no later alert can meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that an alert looks back.
LOOK_BACK = 96 * 3600
#: Parts that accounts are dealt to; state that is kept over restarts needs the same number.
PARTS = 1024
_MOMENT = "t long, n long, amount double, hot long, most double"
_COLUMNS = ["account", "t", "n", "amount", "hot", "most"]


class LookBackProcessor(StatefulProcessor):
    """State of a part's accounts: their moments of the look-back and the alerts not yet answered.

    Rows without an account column belong to the account that is the key.
    """

    def __init__(self, threshold: float, look_back: int = LOOK_BACK, kind: str = "long"):
        self.threshold, self.look_back, self.kind = threshold, look_back, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getListState("moments", f"account {self.kind}, {_MOMENT}")
        self.open = handle.getListState("open", f"account {self.kind}, t long, tx_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        alerts: list[tuple] = []
        parts = []
        for part in rows:
            if "account" not in part:
                part = part.assign(account=key[0])
            hot = part["score"] >= self.threshold
            alerts += zip(*(part.loc[hot, c].tolist() for c in ("account", "t", "tx_id")), strict=True)
            parts.append(_summed(part.assign(n=1, hot=hot.astype("int64"), most=part["score"])))
        made = _summed(pd.concat(parts))
        self.moments.appendList(_rows(made))
        if alerts:
            self.open.appendList([(_known(a), t, tx_id) for a, t, tx_id in alerts])
        # One timer for the first alert: it answers all that are due and sets the next.
        for second in {*([min(t for _, t, _ in alerts) + 1] if alerts else []), int(made["t"].max()) + self.look_back + 2}:
            self.handle.registerTimer(second * 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Answers all alerts that the watermark has passed at the first of their timers; the others find none."""
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = [tuple(a) for a in self.open.get()] if self.open.exists() else []
        due, later = [a for a in waiting if a[1] < passed], [a for a in waiting if a[1] >= passed]
        evicts = expiredTimerInfo.getExpiryTimeInMs() // 1000 <= passed - self.look_back
        if not due and waiting and not evicts:
            return
        held = pd.DataFrame([tuple(m) for m in self.moments.get()] if self.moments.exists() else [], columns=_COLUMNS)
        held = _summed(held)
        if due:
            yield self._answers(due, held)
            self._keep(self.open, later)
            if later:
                self.handle.registerTimer((min(a[1] for a in later) + 1) * 1000)
        kept = held[held["t"] >= passed - 1 - self.look_back]
        if 2 * len(kept) <= len(held):  # rewritten only when half of it goes
            self._keep(self.moments, _rows(kept))

    def _answers(self, due: list, held: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(due, columns=["account", "t", "tx_id"])
        codes = pd.factorize(pd.concat([held["account"], out["account"]]), use_na_sentinel=False)[0].astype("int64")
        at = out["t"].to_numpy()
        # Accounts one after another on one axis, each with room for the whole time.
        start = min(held["t"].min(), at.min() - self.look_back)
        room = max(held["t"].max(), at.max()) - start + 1
        place = codes[: len(held)] * room + held["t"].to_numpy() - start
        order = np.argsort(place, kind="stable")
        place, held = place[order], held.iloc[order]
        own = codes[len(held) :] * room - start
        low, high = np.searchsorted(place, own + at - self.look_back), np.searchsorted(place, own + at)
        for c in ("n", "hot"):
            sums = np.concatenate([[0], np.cumsum(held[c].to_numpy())])
            out[c] = sums[high] - sums[low]
        amount, most = held["amount"].to_numpy(), held["most"].to_numpy()
        out["amount"] = [float(amount[a:b].sum()) for a, b in zip(low, high, strict=True)]
        out["most"] = [float(most[a:b].max()) if b > a else None for a, b in zip(low, high, strict=True)]
        return out.astype({"most": "float64"})[["tx_id", "account", "t", "n", "amount", "hot", "most"]]

    @staticmethod
    def _keep(state: object, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def _known(account: object) -> object:
    return None if pd.isna(account) else account


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row an account and second, in order of time."""
    return rows.groupby(["account", "t"], as_index=False, dropna=False, sort=False).agg({"n": "sum", "amount": "sum", "hot": "sum", "most": "max"})[_COLUMNS].sort_values("t", kind="stable")


def _rows(moments: pd.DataFrame) -> list[tuple]:
    accounts = map(_known, moments["account"].tolist())
    return list(zip(accounts, *(moments[c].tolist() for c in _COLUMNS[1:]), strict=True))


def alert_look_back(stream: DataFrame, threshold: float, look_back: int = LOOK_BACK, late: str = "1 hour", parts: int = PARTS) -> DataFrame:
    """For each alert and each of its accounts: n, amount, alerts (hot) and highest score (most) of the account's transfers in [t - look_back, t).

    ``stream`` has tx_id, src, dst, t, amount and score.  Rows without time,
    or later than the watermark allows, take no part; without amount or score
    they count with 0.  Alerts that the watermark has not passed stay open.
    Needs the RocksDB state store.
    """
    touched = stream.where("t is not null").select(
        "tx_id", "t", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.explode(F.array_distinct(F.array("src", "dst"))).alias("account"), F.timestamp_seconds("t").alias("ts"),
    )
    kind = dict(touched.dtypes)["account"]
    part = F.when(F.col("account").isNull(), -1).otherwise(F.pmod(F.xxhash64("account"), F.lit(parts)))
    return touched.withColumn("part", part).withWatermark("ts", late).groupBy("part").transformWithStateInPandas(
        LookBackProcessor(threshold, look_back, kind), f"tx_id long, account {kind}, t long, n long, amount double, hot long, most double", "Append", "EventTime"
    )
