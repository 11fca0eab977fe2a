"""Latest balance and position per account from a feed of account updates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkbars.functions.orders import MIN_POSITION
from sparkbars.streaming.state import arrays_of, bucket_of, use_state_store

_OUT = (
    "account string, seq long, ts_us long, balance double, position double, entry_price double, stop_price double, "
    "is_flat boolean, n_late long"
)
_FIELDS = ["balance", "position", "entry_price", "stop_price"]
_STATE = "account string, seq long, n_late long, ts_us long, " + ", ".join(f"{f} double" for f in _FIELDS)
_NEW = {"seq": 0, "n_late": 0, "ts_us": -(2**62), **dict.fromkeys(_FIELDS, 0.0)}


class AccountStates(StatefulProcessor):
    """The accounts of a bucket. Each update overwrites the fields it carries; a position too small to count clears entry and stop.

    An update older than the account's last one is not applied; ``n_late`` counts those so far.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("accounts", arrays_of(_STATE))

    def _known(self, accounts: pd.Series) -> tuple[np.ndarray, pd.DataFrame]:
        """Place of each update's account among the known ones, and these with the new ones after them."""
        names = [f.split()[0] for f in _STATE.split(", ")]
        known = dict(zip(names, self.state.get() if self.state.exists() else [[] for _ in names], strict=True))
        place, found = pd.factorize(pd.concat([pd.Series(known["account"], dtype="object"), accounts]), use_na_sentinel=False)
        n = len(known["account"])
        table = {"account": [None if pd.isna(a) else a for a in found]}
        for name, default in _NEW.items():
            table[name] = np.concatenate([np.asarray(known[name], type(default)), np.full(len(found) - n, default)])
        return place[n:], pd.DataFrame(table)

    def handleInputRows(self, key, rows, timerValues):
        updates = pd.concat(list(rows), ignore_index=True)
        updates["place"], known = self._known(updates["account"])
        updates = updates.sort_values(["place", "ts_us", "tie"], kind="stable")
        place = updates["place"].to_numpy()
        current = updates["ts_us"].to_numpy() >= known["ts_us"].to_numpy()[place]
        known["n_late"] += np.bincount(place[~current], minlength=len(known))
        updates = updates[current]
        if not updates.empty:
            yield self._applied(updates, known)
        self.state.update(tuple(known[f.split()[0]].tolist() for f in _STATE.split(", ")))

    def _applied(self, updates: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """A row per update; ``known`` moves on to the last ones."""
        place = np.unique(updates["place"].to_numpy())
        before = known.loc[place, ["ts_us", *_FIELDS]].assign(place=place, is_before=True)
        filled = pd.concat([before, updates[["ts_us", *_FIELDS, "place"]].assign(is_before=False)], ignore_index=True)
        filled[_FIELDS] = filled[_FIELDS].astype("float64")
        filled = filled.sort_values("place", kind="stable", ignore_index=True)
        # Missing fields keep their last value; an account's first row is what was known before and has them all.
        filled[["balance", "position"]] = filled[["balance", "position"]].ffill()
        filled["is_flat"] = filled["position"].abs() < MIN_POSITION
        filled.loc[filled["is_flat"], ["position", "entry_price", "stop_price"]] = 0.0
        filled[_FIELDS] = filled[_FIELDS].ffill()
        out = filled[~filled["is_before"]].reset_index(drop=True)
        at = out["place"].to_numpy()
        out["ts_us"] = out["ts_us"].astype("int64")
        out["seq"] = known["seq"].to_numpy()[at] + 1 + out.groupby("place").cumcount().to_numpy()
        out["n_late"] = known["n_late"].to_numpy()[at]
        out["account"] = known["account"].to_numpy()[at]
        last = out.drop_duplicates("place", keep="last")
        for name in ["seq", "ts_us", *_FIELDS]:
            known.loc[last["place"].to_numpy(), name] = last[name].to_numpy()
        return out[[f.split()[0] for f in _OUT.split(", ")]]

    def close(self) -> None:
        pass


def stream_accounts(updates: DataFrame) -> DataFrame:
    """Account state after every update. ``updates``: account, ts_us, tie and the four value columns, NULL if absent."""
    use_state_store(updates.sparkSession)
    rows = updates.select(bucket_of("account").alias("bucket"), "account", "ts_us", "tie", *_FIELDS)
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=AccountStates(), outputStructType=_OUT, outputMode="Append", timeMode="None"
    )
