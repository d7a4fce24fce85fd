"""Names and types of bar data."""

from __future__ import annotations

KEY = ["symbol"]
OHLC = ["open", "high", "low", "close"]
VOLREGIME = ["volregime_atr_pctl", "volregime_atr_ratio", "volregime_regime"]
PRICE_STRUCTURE = [
    "ps_dist_pdh_atr", "ps_dist_pdl_atr", "ps_dist_sess_h_atr", "ps_dist_sess_l_atr", "ps_dist_round_up_atr", "ps_dist_round_dn_atr", "ps_gap_atr", "ps_gap_fill_pct",
]
NEWS = [
    "news_min_to_next", "news_next_importance", "news_min_since_last", "news_last_importance", "news_last_surprise", "news_in_window", "news_count_next_24h",
]

#: Seconds of a bar by name of the timeframe.
TIMEFRAMES = {f"M{m}": 60 * m for m in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30)} | {f"H{h}": 3600 * h for h in (1, 2, 3, 4, 6, 8, 12)} | {"D1": 86_400, "W1": 604_800}


def timeframe_seconds(name: str) -> int:
    try:
        return TIMEFRAMES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown timeframe {name!r}") from None
