"""Price levels from swing pivots, and the setup that a security is in.

Agglomeration depends on what came before it, so a task walks one security's sessions; nothing longer is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed values.
PRECEDENCE = ["breakout", "pullback", "trend_continuation", "base", "downtrend"]


@dataclass(frozen=True)
class Settings:
    pivot: int = 5
    tolerance_pct: float = 1.5
    volume_times: float = 1.5
    rsi_low: float = 50.0
    rsi_high: float = 70.0
    band_atr: float = 1.0
    base_bars: int = 40
    base_atr_pct: float = 3.0
    stop_atr: float = 2.0
    recent: int = 10


def pivots(high: np.ndarray, low: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Bar and price of each first highest high and first lowest low of the w bars on either side."""
    if len(high) < 2 * w + 1:
        return np.zeros(0, dtype=int), np.zeros(0)
    at = np.arange(w, len(high) - w)

    def firsts(values: np.ndarray) -> np.ndarray:
        spans = np.lib.stride_tricks.sliding_window_view(values, 2 * w + 1)
        return at[spans.argmax(axis=1) == w]

    tops, bottoms = firsts(high), firsts(-low)
    return np.concatenate([tops, bottoms]), np.concatenate([high[tops], low[bottoms]])


def cluster(prices: np.ndarray, tolerance_pct: float) -> list[tuple[float, int]]:
    """(mean, touches) upward: a price joins the cluster below if it is within tolerance of its mean."""
    out: list[tuple[float, int]] = []
    for price in np.sort(prices):
        if out:
            total, n = out[-1]
            gap = abs(price - total / n)
            if gap == 0 or (total and gap / abs(total / n) * 100 <= tolerance_pct):
                out[-1] = (total + price, n + 1)
                continue
        out.append((float(price), 1))
    return [(total / n, n) for total, n in out]


def levels(bars: DataFrame, most: int = 3, settings: Settings = Settings()) -> DataFrame:
    """security_id, side, place, price, touches: the ``most`` levels on each side of the last close, most touched first."""
    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        close = rows["close"].iloc[-1]
        _, prices = pivots(rows["high"].to_numpy(float), rows["low"].to_numpy(float), settings.pivot)
        found = [("support" if p <= close else "resistance", p, n) for p, n in cluster(prices, settings.tolerance_pct)]
        out = []
        for side in ("support", "resistance"):
            best = sorted((x for x in found if x[0] == side), key=lambda x: (-x[2], abs(x[1] - close), x[1]))[:most]
            out += [(rows["security_id"].iloc[0], side, k, p, n) for k, (_, p, n) in enumerate(best, 1)]
        return pd.DataFrame(out, columns=["security_id", "side", "place", "price", "touches"])

    return _walk(bars, rank, "side string, place int, price double, touches int")


def _walk(bars: DataFrame, function, more: str) -> DataFrame:
    kind = bars.schema["security_id"].dataType.simpleString()
    read = bars.where("close is not null").selectExpr("security_id", "date", "close", "coalesce(high, close) as high", "coalesce(low, close) as low", "volume")
    return read.groupBy("security_id").applyInPandas(function, f"security_id {kind}, {more}")


def _wilder(values: np.ndarray, n: int) -> float | None:
    if len(values) < n:
        return None
    out = values[:n].mean()
    for x in values[n:]:
        out = (out * (n - 1) + x) / n
    return out


def _ema(values: np.ndarray, n: int) -> float:
    out = values[:n].mean()
    for x in values[n:]:
        out += 2 / (n + 1) * (x - out)
    return out


def _broken(known: int, close: np.ndarray, volume: np.ndarray, at: np.ndarray, prices: np.ndarray, s: Settings) -> float | None:
    """The nearest level that the last of ``known`` bars closed above on volume; levels are those of the bars before it."""
    if known < 22:
        return None
    above = [p for p, _ in cluster(prices[at <= known - 2 - s.pivot], s.tolerance_pct) if p > close[known - 2]]
    usual = volume[known - 21 : known - 1].mean()
    strong = usual > 0 and volume[known - 1] >= s.volume_times * usual  # false for unknown volumes
    return min(above) if above and close[known - 1] > min(above) and strong else None


def classify(rows: pd.DataFrame, s: Settings = Settings()) -> dict:
    """Setup, entry zone, stop, invalidation, target and reward to risk of bars in order of date."""
    close, high, low, volume = (rows[c].to_numpy(float) for c in ("close", "high", "low", "volume"))
    n = len(close)
    none = dict.fromkeys(["setup", "entry_low", "entry_high", "stop", "invalidation", "basis", "target", "reward_risk"])
    if n < 200:
        return none | {"reason": f"need 200 bars, have {n}"}
    return _setup(close, high, low, volume, s, none)


def _setup(close: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray, s: Settings, none: dict) -> dict:
    n, last = len(close), close[-1]
    ranges = np.maximum(high[1:] - low[1:], np.maximum(abs(high[1:] - close[:-1]), abs(low[1:] - close[:-1])))
    atr, base_atr = _wilder(ranges, 14), _wilder(ranges, s.base_bars)
    moves = np.diff(close)
    up, down = _wilder(np.maximum(moves, 0), 14), _wilder(np.maximum(-moves, 0), 14)
    rsi = 100 * up / (up + down) if up + down > 0 else None
    sma50, sma200 = close[-50:].mean(), close[-200:].mean()
    earlier = close[-220:-20].mean() if n >= 220 else None
    at, prices = pivots(high, low, s.pivot)
    pool = [p for p, _ in cluster(prices, s.tolerance_pct)]
    zones: dict[str, tuple[float, float] | None] = {}
    broken = _broken(n, close, volume, at, prices, s)
    if broken is not None:
        zones["breakout"] = (broken, broken + atr)
    if last > sma50 > sma200 and earlier is not None and sma200 > earlier and rsi is not None:
        near = s.band_atr * atr
        if rsi < s.rsi_low and (abs(last - sma50) <= near or abs(last - _ema(close, 21)) <= near):
            zones["pullback"] = (sma50 - atr / 2, sma50 + atr / 2)
        if s.rsi_low <= rsi <= s.rsi_high and all(_broken(k, close, volume, at, prices, s) is None for k in range(n - s.recent, n)):
            zones["trend_continuation"] = (last - atr, last)
    top, bottom = high[-s.base_bars :].max(), low[-s.base_bars :].min()
    if base_atr is not None and last > 0 and base_atr / last * 100 < s.base_atr_pct and last >= sma200 and bottom <= last <= top:
        zones["base"] = (top, top + atr)
    if last < sma50 < sma200:
        zones["downtrend"] = None
    setup = next((name for name in PRECEDENCE if name in zones), "none")
    zone = zones.get(setup)
    if zone is None:
        return none | {"setup": setup, "reason": "no entry zone is defined"}
    entry_low, entry_high = zone
    stop, middle = entry_low - s.stop_atr * atr, (entry_low + entry_high) / 2
    below, above = [p for p in pool if p < entry_low], [p for p in pool if p > entry_high]
    target = min(above) if above else None
    gain = (target - middle) / (middle - stop) if target is not None and middle > stop else None
    return {
        "setup": setup, "entry_low": entry_low, "entry_high": entry_high, "stop": stop, "invalidation": max(below) if below else stop,
        "basis": "support" if below else "stop", "target": target, "reward_risk": gain, "reason": None if gain is not None else "no target above the entry zone",
    }


def setups(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The setup of each security at its last bar; null with a reason for fewer than 200 bars."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        return pd.DataFrame([{"security_id": rows["security_id"].iloc[0], "date": rows["date"].iloc[-1], **classify(rows, settings)}])

    return _walk(bars, one, "date date, setup string, entry_low double, entry_high double, stop double, invalidation double, basis string, target double, reward_risk double, reason string")
