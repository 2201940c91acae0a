"""Columns derived from a wide frame of on-chain metrics, one row a date; each is made where its inputs exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import Series, guarded

#: Names of the derived columns with their inputs and periods, which must equal the reference's.
CHAINS = ("ethereum", "bsc", "arbitrum", "solana", "polygon", "base", "op-mainnet")
SCORES = {
    "mvrv_z_1y": ("CapMVRVCur", 365, 60), "mvrv_z_4y": ("CapMVRVCur", 1460, 180), "net_flow_z_30d": ("net_flow_usd", 30, 5),
    "active_addr_z_30d": ("AdrActCnt", 30, 5), "spot_vol_z_30d": ("volume_reported_spot_usd_1d", 30, 5),
}
CHANGES = {
    "ex_supply_ratio_chg_30d": ("ex_supply_ratio", 30), "holder_growth_30d": ("AdrBalCnt", 30), "tfr_cnt_chg_30d": ("TxTfrCnt", 30), "hashrate_chg_30d": ("HashRate", 30),
    **{f"tvl_{c}_chg_7d": (f"tvl_{c}", 7) for c in CHAINS}, "stablecoin_mcap_total_chg_7d": ("stablecoin_mcap_total", 7), **{f"stable_{c}_mcap_chg_7d": (f"stable_{c}_mcap", 7) for c in ("usdt", "usdc", "dai", "usde")},
    "stable_total_chg_7d": ("stable_total_supply", 7), "stable_total_chg_30d": ("stable_total_supply", 30), "stable_eth_chain_chg_7d": ("stable_eth_chain_supply", 7), "dex_vol_chg_30d": ("dex_vol_total_7d", 30),
}
DIFFERENCES = {"net_flow_usd": ("FlowInExUSD", "FlowOutExUSD"), "net_flow_ntv": ("FlowInExNtv", "FlowOutExNtv")}
RATIOS = {
    "ex_supply_ratio": ("SplyExNtv", "SplyCur"), "usdt_dominance": ("stable_usdt_supply", "stable_total_supply"),
    "usdt_eth_share": ("stable_usdt_eth_supply", "stable_usdt_supply"), "usdt_trx_share": ("stable_usdt_trx_supply", "stable_usdt_supply"),
}
#: Sums with the inputs that must be there and those that may be.
SUMS = {"stable_total_supply": (("stable_usdt_supply", "stable_usdc_supply"), ("stable_dai_supply",)), "stable_eth_chain_supply": (("stable_usdt_eth_supply", "stable_usdc_eth_supply"), ())}
MEAN_MULTIPLES = {"puell_multiple": ("IssTotUSD", 365, 60)}


def score(x: str, s: Series, n: int, least: int) -> Column:
    """Distance to the rolling mean in rolling deviations; NULL where these are nothing but rounding."""
    f, c = s.last(n), F.col(f"`{x}`")
    mean, sd = guarded(F.avg(c), c, f, least), guarded(F.stddev_samp(c), c, f, max(2, least))
    return F.when(sd > 1e-9 * F.greatest(F.abs(mean), F.lit(1e-300)), (c - mean) / sd)


def derive(wide: DataFrame, s: Series, prefix: str = "") -> DataFrame:
    """wide with all derived columns whose inputs it has. Rows are the union of all dates on which any metric has a value, so a change
    over 30 rows is one over 30 such dates; values must have been filled forward (an earlier value never replaces a later one)."""
    name = lambda c: f"{prefix}{c}"
    col = lambda c: F.col(f"`{name(c)}`")
    has = lambda *cs: all(name(c) in out.columns for c in cs)
    out = wide
    for c, (needed, more) in SUMS.items():
        if has(*needed):
            parts = [F.coalesce(col(x), F.lit(0.0)) for x in (*needed, *more) if has(x)]
            out = out.withColumn(name(c), sum(parts[1:], parts[0]))
    first = {c: col(a) - col(b) for c, (a, b) in DIFFERENCES.items() if has(a, b)}
    first |= {c: F.try_divide(col(a), F.nullif(col(b), F.lit(0.0))) for c, (a, b) in RATIOS.items() if has(a, b)}
    out = out.withColumns({name(c): x for c, x in first.items()}) if first else out
    second = {c: score(name(x), s, n, least) for c, (x, n, least) in SCORES.items() if has(x)}
    second |= {c: F.try_divide(col(x), F.nullif(F.lag(col(x), n).over(s.w), F.lit(0.0))) - 1 for c, (x, n) in CHANGES.items() if has(x)}
    second |= {c: F.try_divide(col(x), F.nullif(guarded(F.avg(col(x)), col(x), s.last(n), least), F.lit(0.0))) for c, (x, n, least) in MEAN_MULTIPLES.items() if has(x)}
    return out.withColumns({name(c): x for c, x in second.items()}) if second else out
