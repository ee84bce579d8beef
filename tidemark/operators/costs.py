"""Exact decimal costs of a round trip, and the reference that holds over every night."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import lag, positive

# The declared rates, in percent of the notional; a holder of a long position pays for a night, of a short
# one is paid. Conversion and commission are declared as 0.
SPREAD_HALF_PCT = Decimal("0.0021")
CARRY_LONG_PCT, CARRY_SHORT_PCT = Decimal("0.0182"), Decimal("-0.0018")
FX_PCT, COMMISSION_PCT = Decimal("0"), Decimal("0")
#: Digits of a percentage, and of an amount.
PCT, MONEY = "decimal(20,10)", "decimal(28,10)"


def rate(value: Decimal | str | None) -> Column:
    return F.lit(None if value is None else str(value)).cast(PCT)


def charged(
    trades: DataFrame,
    spread_half: Decimal = SPREAD_HALF_PCT,
    carry_long: Decimal = CARRY_LONG_PCT,
    carry_short: Decimal = CARRY_SHORT_PCT,
    fx: Decimal = FX_PCT,
    commission: Decimal = COMMISSION_PCT,
    slippage: Decimal | None = None,
) -> DataFrame:
    """Adds the costs of trades (notional decimal, side 1 or -1, nights int), in percent of the notional and in money.

    declared is spread twice, carry by side and night, conversion and commission. total adds the slippage and is null
    where that is not known: null is not 0. slippage_dominates tells whether the slippage exceeds the spread.
    """
    night = F.when(F.col("side") < 0, rate(carry_short)).otherwise(rate(carry_long))
    df = trades.withColumns({"spread_pct": rate(2 * spread_half), "carry_pct": (night * F.col("nights").cast("decimal(9,0)")).cast(PCT), "fx_pct": rate(fx), "commission_pct": rate(commission), "slippage_pct": rate(slippage)})
    df = df.withColumn("declared_pct", (F.col("spread_pct") + F.col("carry_pct") + F.col("fx_pct") + F.col("commission_pct")).cast(PCT))
    df = df.withColumn("total_pct", (F.col("declared_pct") + F.col("slippage_pct")).cast(PCT))
    money = lambda pct: (F.col("notional") * F.col(pct) / F.lit(100).cast("decimal(3,0)")).cast(MONEY)
    df = df.withColumns({c.replace("_pct", "_usd"): money(c) for c in ("spread_pct", "carry_pct", "declared_pct", "total_pct")})
    return df.withColumn("slippage_dominates", F.col("slippage_pct") > F.col("spread_pct"))


def close_to_close(bars: DataFrame, carry: Decimal = CARRY_LONG_PCT) -> DataFrame:
    """(series_id, session, nights, gross_pct, financing_pct, net_pct): long over every night, less its carry.

    A session without its own or the last close holds no night and has nulls.
    """
    before, now = positive(lag("close")), positive(F.col("close"))
    gross = 100 * (now / before - 1)
    return bars.select(
        "series_id", "session", gross.isNotNull().cast("int").alias("nights"), gross.alias("gross_pct"), F.when(gross.isNotNull(), F.lit(float(carry))).alias("financing_pct"), (gross - float(carry)).alias("net_pct")
    )
