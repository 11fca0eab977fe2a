"""Components by name: what a configuration may ask for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from sparkbars.functions import features as X
from sparkbars.functions.orders import drawdown_gate, open_gate, position_gate
from sparkbars.functions.signals import breakout_event
from sparkbars.functions.sizing import risk_size, scalar_risk_size, scalar_vol_target_size, vol_target_size
from sparkbars.operators.labels import fixed_horizon_labeler, triple_barrier_labeler

FEATURES = {
    "atr": X.atr_feature,
    "breakout_intensity": X.breakout_intensity,
    "volume_ratio": X.volume_ratio,
    "channel_position": X.channel_position,
    "channel_width": X.channel_width,
    "lagged_returns": X.lagged_returns,
    "taker_flow": X.taker_flow,
    "trend_filter": X.trend_filter,
    "hour_of_day": X.hour_of_day,
}
LABELERS = {"triple_barrier": triple_barrier_labeler, "fixed_horizon": fixed_horizon_labeler}
SIZERS = {"risk": scalar_risk_size, "volatility_target": scalar_vol_target_size}
SIZE_COLUMNS = {"risk": risk_size, "volatility_target": vol_target_size}
GATES = {"max_drawdown": drawdown_gate, "allow_all": open_gate, "position": position_gate}


# Parameters of a trigger that are periods of the indicator table it reads.
TRIGGER_PERIODS = ("entry_period", "exit_period", "atr_period")


def _breakout(intensity_threshold: float = 0.0, signed: bool = True):
    return breakout_event(intensity_threshold, signed)


def indicator_periods(indicators: Mapping[str, object], trigger: Mapping[str, object]) -> dict:
    """Indicator settings with the periods of the trigger, which must not contradict them."""
    out = dict(indicators)
    for name, value in trigger.get("params", {}).items():
        if name in TRIGGER_PERIODS:
            if out.setdefault(name, value) != value:
                raise ValueError(f"the trigger asks for {name} {value}, the indicators for {out[name]}")
    return out


def build_trigger(trigger: Mapping[str, object]):
    """The trigger of a configuration; its periods belong to the indicator table."""
    params = {k: v for k, v in trigger.get("params", {}).items() if k not in TRIGGER_PERIODS}
    return build(TRIGGERS, {**trigger, "params": params}, "trigger")


TRIGGERS = {"breakout": _breakout}


def build(kinds: Mapping[str, object], spec: Mapping[str, object], what: str):
    """The component a ``{type, params}`` entry asks for."""
    name = spec["type"]
    if name not in kinds:
        raise ValueError(f"unknown {what} {name!r}; known: {', '.join(sorted(kinds))}")
    return kinds[name](**spec.get("params", {}))


def build_features(specs: Sequence[Mapping[str, object]] | None) -> X.Feature:
    if not specs:
        return X.default_feature_set()
    unknown = [s["type"] for s in specs if s["type"] not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features {unknown}; known: {', '.join(sorted(FEATURES))}")
    return X.compose([FEATURES[s["type"]] for s in specs])
