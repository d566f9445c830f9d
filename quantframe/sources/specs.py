"""Record shapes of the landed market-data payloads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class PayloadSpec:
    """``fields`` maps record fields to output columns. ``strict`` numbers fail the job when malformed,
    others become NULL. ``epoch`` is ``s`` for seconds or ``auto`` for seconds or milliseconds.
    ``derived`` are further columns as SQL over the value columns."""

    name: str
    api_version: str
    scope: str
    path: str
    time_field: str
    fields: Mapping[str, str] = field(default_factory=dict)
    strict: bool = False
    epoch: str = "auto"
    shape: str = "records"
    derived: Mapping[str, str] = field(default_factory=dict)


# Names, paths and fields of the landed records -------------------------------------

INTERVALS = ("4h", "6h", "12h", "1d")

_OHLC = {"open": "open", "high": "high", "low": "low", "close": "close"}


def _v3(name, path, time_field, fields, **derived):
    return PayloadSpec(name, "v3", "symbol_interval", path, time_field, fields, strict=True, epoch="s", derived=derived)


def _v4(name, path, fields):
    return PayloadSpec(name, "v4", "symbol_interval", path, "time", fields)


def _global(name, path, time_field, fields, shape="records"):
    return PayloadSpec(name, "v4", "global", path, time_field, fields, shape=shape)


def _snapshot(name, path):
    return PayloadSpec(name, "v4", "snapshot", path, "", shape="snapshot")


V3_SPECS = (
    _v3("oi", "/futures/openInterest/ohlc-aggregated-history", "t",
        {"o": "oi_open", "h": "oi_high", "l": "oi_low", "c": "oi_close"}),
    _v3("liq", "/futures/liquidation/aggregated-history", "t",
        {"longLiquidationUsd": "long_liq", "shortLiquidationUsd": "short_liq"},
        net_liq="long_liq - short_liq", total_liq="long_liq + short_liq"),
    _v3("global_ls", "/futures/globalLongShortAccountRatio/history", "time",
        {"longShortRatio": "global_ls_ratio", "longAccount": "global_long_pct"}),
    _v3("top_acct", "/futures/topLongShortAccountRatio/history", "time",
        {"longShortRatio": "top_acct_ls_ratio", "longAccount": "top_acct_long_pct"}),
    _v3("top_pos", "/futures/topLongShortPositionRatio/history", "time",
        {"longShortRatio": "top_pos_ls_ratio", "longAccount": "top_pos_long_pct"}),
    _v3("fr", "/futures/fundingRate/ohlc-history", "t", {"c": "fr_close"}),
)

V4_SPECS = (
    _v4("taker_pair", "futures/v2/taker-buy-sell-volume/history",
        {"taker_buy_volume_usd": "buy", "taker_sell_volume_usd": "sell"}),
    _v4("taker_agg", "futures/aggregated-taker-buy-sell-volume/history",
        {"aggregated_buy_volume_usd": "buy", "aggregated_sell_volume_usd": "sell"}),
    _v4("basis", "futures/basis/history",
        {c: c for c in ("open_basis", "close_basis", "open_change", "close_change")}),
    _v4("coinbase_premium", "coinbase-premium-index",
        {c: c for c in ("premium", "premium_rate", "coinbase_price")}),
    _v4("oi_stablecoin", "futures/open-interest/aggregated-stablecoin-history", _OHLC),
    _v4("oi_coin_margin", "futures/open-interest/aggregated-coin-margin-history", _OHLC),
    _v4("fr_oi_weight", "futures/funding-rate/oi-weight-history", _OHLC),
    _v4("fr_vol_weight", "futures/funding-rate/vol-weight-history", _OHLC),
    _v4("bitfinex_margin", "bitfinex-margin-long-short",
        {c: c for c in ("long_quantity", "short_quantity")}),
)

GLOBAL_SPECS = (
    _global("etf_btc", "etf/bitcoin/flow-history", "timestamp",
            {"flow_usd": "etf_btc_flow", "price_usd": "etf_btc_price"}),
    _global("etf_eth", "etf/ethereum/flow-history", "timestamp",
            {"flow_usd": "etf_eth_flow", "price_usd": "etf_eth_price"}),
    _global("fear_greed", "index/fear-greed-history", "time_list", {"data_list": "value"}, "parallel"),
    _global("cgdi", "futures/cgdi-index/history", "time", {"cgdi_index_value": "cgdi"}),
    _global("stablecoin_mcap", "index/stableCoin-marketCap-history", "time_list", {"data_list": "value"},
            "parallel"),
)

SNAPSHOT_SPECS = (
    _snapshot("oi_exchange", "futures/open-interest/exchange-list"),
    _snapshot("option_maxpain", "option/max-pain"),
)

# Symbols an endpoint is limited to; the others cover the whole universe.
SUPPORTED_SYMBOLS = {
    "coinbase_premium": ("BTC",),
    "bitfinex_margin": ("BTC", "ETH"),
    "option_maxpain": ("BTC", "ETH"),
}

KLINE_FIELDS = ("ts", "o", "h", "l", "c", "v", "close_time", "quote_volume", "trade_count",
                "taker_buy_volume", "taker_buy_quote_volume", "ignore")
BAR_FIELDS = ("o", "h", "l", "c", "v")

CORE_SYMBOLS = ("BTC", "ETH", "BNB", "SOL")
RESEARCH_SYMBOLS = ("BTC", "ETH", "BNB", "SOL", "XRP", "ADA", "DOGE", "LINK", "AVAX", "TRX", "LTC", "SUI")

# Endpoint names of the compatibility exports.
TAKER_EXPORT_NAMES = {"taker_pair": "pair", "taker_agg": "agg"}
DAILY_EXPORT_NAMES = {
    "basis": "basis", "coinbase_premium": "cb_premium", "oi_stablecoin": "oi_stable",
    "oi_coin_margin": "oi_coin", "bitfinex_margin": "bfx_margin", "fr_oi_weight": "fr_oiw",
    "fr_vol_weight": "fr_vw",
}
GLOBAL_EXPORT_NAMES = {
    "etf_btc": "global_etf_btc", "etf_eth": "global_etf_eth", "fear_greed": "global_fg",
    "cgdi": "global_cgdi", "stablecoin_mcap": "global_stable_mcap",
}
GLOBAL_VALUE_NAMES = {"fear_greed": "fear_greed", "stablecoin_mcap": "stable_mcap"}

# End of fixed values -----------------------------------------------------------------------------

SPECS = {(s.api_version, s.name): s for s in (*V3_SPECS, *V4_SPECS, *GLOBAL_SPECS, *SNAPSHOT_SPECS)}


def spec_for(name: str) -> PayloadSpec:
    """Spec by endpoint name; names are unique across API versions."""
    found = [s for s in SPECS.values() if s.name == name]
    if not found:
        raise ValueError(f"Unknown endpoint: {name!r}")
    return found[0]
