"""The decision gate: ordered checks of a session's forecast, tier and size, as one projection over all sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of percentages and amounts.
PCT, MONEY = "decimal(20,10)", "decimal(28,2)"
#: A target has to be this many times the declared cost.
TARGET_MULTIPLE = 2

# The codes of what blocks, by rule; the order of rules is the order of the checks.
CODES = {
    "19": "mercado_cerrado", "13": "as_of_no_es_de_hoy", "14": "snapshot_no_valido", "20": "overlay_veto", "1": "max_una_operacion_por_sesion", "3": "perdida_diaria", "4": "perdida_semanal", "5": "perdida_mensual",
    "15": "modo_observacion", "17": "dia_de_fomc", "18": "media_sesion", "16": "bracket_sin_objetivo", "8": "objetivo_bajo_el_coste", "9": "ev_bajo_el_umbral", "10": "tier_no_autorizado",
}
NO_EV = "ev_neto_no_calculable"
RECOMMENDATION, STALE, QUALITY, UNDECIDED = "recommendation", "no_recommendation_stale_data", "no_recommendation_data_quality", "no_recommendation_undecided"
#: What a gate has to be given before it decides.
PARAMETERS = {
    "risk_per_trade_pct": "1", "ev_threshold_pct": "0", "tier_a_cost_multiple": "3", "tier_b_cost_multiple": "1.5", "tier_a_min_probability": "0.55", "max_daily_loss_pct": "2", "max_weekly_loss_pct": "5", "max_monthly_loss_pct": "10", "authorized_tiers": ("A",),
}


def evaluated(sessions: DataFrame, parameters: dict | None = None) -> DataFrame:
    """sessions with status, direction, tier, ev_declared, ev_net, ev_basis, blockers (rule, code) in order, notional and leverage.

    sessions holds: as_of_day, today (dates), is_session, is_half_day, is_meeting, snapshot_ok, veto (booleans), trades_today, observation_left
    (ints), p (the chance of a rise), move_pct, cost_pct, cost_total_pct (null if slippage is unknown), slippage_measured,
    stop_pct, target_pct, daily_pnl_pct, weekly_pnl_pct, monthly_pnl_pct (null passes) and capital.
    A closed market is answered first, then stale data, then bad data, then missing parameters, then the veto; after
    these all session rules are collected, and only without any the trading rules. Blocked sessions are recommendations
    to do nothing; those without a decision have no direction at all.
    """
    given = PARAMETERS if parameters is None else parameters
    undecided = [k for k in PARAMETERS if given.get(k) is None]
    n = lambda k: F.lit(str(given[k])).cast(PCT)
    rule = lambda k, code=None: F.struct(F.lit(k).alias("rule"), F.lit(code or CODES[k]).alias("code"))
    long = F.col("p") >= 0.5
    favourable = F.when(long, F.col("p")).otherwise(1 - F.col("p")).cast(PCT)
    dec = lambda c: F.col(c).cast(PCT)
    gain = (favourable * dec("move_pct")).cast(PCT)
    df = sessions.withColumns({"ev_declared": (gain - dec("cost_pct")).cast(PCT), "ev_net": (gain - dec("cost_total_pct")).cast(PCT)})
    df = df.withColumn("ev_basis", F.when(F.col("slippage_measured"), "net").when(F.col("cost_total_pct").isNotNull(), "declared"))
    ev = F.when(F.col("ev_basis") == "declared", F.col("ev_declared")).when(F.col("ev_basis") == "net", F.col("ev_net"))
    stopped = F.when(~F.col("is_session"), rule("19")).when(F.col("as_of_day") != F.col("today"), rule("13")).when(~F.col("snapshot_ok"), rule("14"))
    status = F.when(~F.col("is_session"), RECOMMENDATION).when(F.col("as_of_day") != F.col("today"), STALE).when(~F.col("snapshot_ok"), QUALITY)
    if undecided:
        empty = F.array().cast("array<struct<rule:string,code:string>>")
        return df.withColumns(
            {
                "status": status.otherwise(UNDECIDED), "direction": F.when(~F.col("is_session"), "NOTHING"), "tier": F.lit("C"), "blockers": F.when(stopped.isNotNull(), F.array(stopped)).otherwise(empty),
                "notional": F.lit(None).cast(MONEY), "leverage": F.lit(None).cast("decimal(20,4)"), "undecided": F.array(*map(F.lit, undecided)),
            }
        )
    enough = lambda c, k: F.coalesce(dec(c) <= -n(k), F.lit(False))
    session_rules = [
        F.when(F.col("trades_today") >= 1, rule("1")), F.when(enough("daily_pnl_pct", "max_daily_loss_pct"), rule("3")), F.when(enough("weekly_pnl_pct", "max_weekly_loss_pct"), rule("4")), F.when(enough("monthly_pnl_pct", "max_monthly_loss_pct"), rule("5")),
        F.when(F.col("observation_left") > 0, rule("15")), F.when(F.col("is_meeting"), rule("17")), F.when(F.col("is_half_day"), rule("18")),
    ]
    cost = dec("cost_pct")
    tier = F.when((ev > n("tier_a_cost_multiple") * cost) & (favourable > n("tier_a_min_probability")), "A").when(ev > n("tier_b_cost_multiple") * cost, "B").otherwise("C")
    df = df.withColumn("tier", tier)
    trading_rules = [
        F.when(F.col("target_pct").isNull(), rule("16")).when(dec("target_pct") < TARGET_MULTIPLE * cost, rule("8")),
        F.when(ev.isNull(), rule("9", NO_EV)).when(ev <= n("ev_threshold_pct"), rule("9")),
        F.when(~F.col("tier").isin(*given["authorized_tiers"]), rule("10")),
    ]
    some = lambda rules: F.filter(F.array(*rules), lambda r: r.isNotNull())
    df = df.withColumns({"_s": some(session_rules), "_t": some(trading_rules)})
    blockers = F.when(stopped.isNotNull(), F.array(stopped)).when(F.col("veto"), F.array(rule("20"))).when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("_t"))
    df = df.withColumns({"status": status.otherwise(RECOMMENDATION), "blockers": blockers}).drop("_s", "_t")
    free = F.size("blockers") == 0
    direction = F.when(free, F.when(long, "LONG").otherwise("SHORT")).when(F.col("status") == RECOMMENDATION, "NOTHING")
    # Rounded half up; the leverage follows from the size, never the other way round.
    notional = F.round((F.col("capital").cast("decimal(18,2)") * n("risk_per_trade_pct").cast("decimal(9,4)") / F.col("stop_pct").cast("decimal(9,4)")).cast("decimal(28,8)"), 2).cast(MONEY)
    df = df.withColumns({"direction": direction, "notional": F.when(free, notional), "undecided": F.array().cast("array<string>")})
    return df.withColumn("leverage", F.round((F.col("notional") / F.col("capital").cast("decimal(18,2)")).cast("decimal(28,8)"), 4).cast("decimal(20,4)"))


def premarket_advice(sessions: DataFrame, threshold_pct: float = 0.5) -> DataFrame:
    """sessions (direction, session, premarket_session, overnight_move_pct) with advised: the move before the open goes against
    the direction by the threshold or more. It never blocks; another session's or a missing move advises nothing."""
    against = F.when(F.col("direction") == "LONG", F.col("overnight_move_pct") <= -threshold_pct).when(F.col("direction") == "SHORT", F.col("overnight_move_pct") >= threshold_pct)
    same = F.col("premarket_session") == F.col("session")
    return sessions.withColumn("advised", F.coalesce(same & against, F.lit(False)))


def sweep(sessions: DataFrame, cells: list[dict]) -> DataFrame:
    """(cell, ...evaluated) for every set of parameters: the cells are few and each is a projection over the same rows."""
    out = None
    for k, cell in enumerate(cells):
        one = evaluated(sessions, PARAMETERS | cell).withColumn("cell", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


# Percentage points by magnitude, the bound of an adjustment, and the confidence at which a high magnitude vetoes.
WEIGHTS = {"low": 2.5, "medium": 5.0, "high": 10.0}
BOUND, VETO_CONFIDENCE = 10.0, 0.8
#: What a suspicious headline's event may reach.
SUSPECT_MAGNITUDE, SUSPECT_CONFIDENCE = "medium", 0.5


def weight(magnitude: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in WEIGHTS.items():
        out = F.when(magnitude == name, w).otherwise(out)
    return out


def suspicion_capped(events: DataFrame) -> DataFrame:
    """events (suspicious, magnitude, confidence) with both bounded where suspicious, and capped."""
    high = F.col("suspicious") & (F.col("magnitude") == "high")
    sure = F.col("suspicious") & (F.col("confidence") > SUSPECT_CONFIDENCE)
    return events.withColumns({"capped": high | sure, "magnitude": F.when(high, SUSPECT_MAGNITUDE).otherwise(F.col("magnitude")), "confidence": F.when(sure, SUSPECT_CONFIDENCE).otherwise(F.col("confidence"))})


def overlay(events: DataFrame, by: str = "session") -> DataFrame:
    """By batch of events (sentiment, magnitude, confidence, seq): the tilt and the decision.

    net_pct adds the weights, signed by sentiment; ratio and consensus are shares of all weight, neutral events included;
    dominant is the first event of the largest weight. An event of high magnitude and confidence vetoes, else net_pct,
    bounded, is the adjustment. Up to the weight of one low event the side is neutral.
    """
    w = weight(F.col("magnitude"))
    signed = F.when(F.col("sentiment") == "bullish", w).when(F.col("sentiment") == "bearish", -w).otherwise(0.0)
    of = lambda s: F.coalesce(F.sum(F.when(F.col("sentiment") == s, w)), F.lit(0.0))
    got = events.groupBy(by).agg(
        F.count("*").alias("n_events"), F.count_if(F.col("sentiment") == "neutral").alias("n_neutral"), F.sum(signed).alias("net_pct"), F.sum(w).alias("gross"), F.greatest(of("bullish"), of("bearish"), of("neutral")).alias("largest"),
        F.min_by("seq", F.struct(-w, F.col("seq"))).alias("dominant"), F.bool_or((F.col("magnitude") == "high") & (F.col("confidence") >= VETO_CONFIDENCE)).alias("veto"),
    )
    side = F.when(F.abs("net_pct") <= WEIGHTS["low"], "neutral").when(F.col("net_pct") > 0, "long").otherwise("short")
    got = got.withColumns({"ratio": F.try_divide(F.col("net_pct"), F.col("gross")), "consensus": F.try_divide(F.col("largest"), F.col("gross")), "side": side, "clamped": F.abs("net_pct") > BOUND})
    got = got.withColumns({"state": F.when(F.col("veto"), "veto").otherwise("applied"), "adjustment_pct": F.when(F.col("veto"), 0.0).otherwise(F.greatest(F.least(F.col("net_pct"), F.lit(BOUND)), F.lit(-BOUND)))})
    return got.drop("gross", "largest")


def with_overlay(p: Column, adjustment_pct: Column) -> Column:
    """The chance after the adjustment, between 0 and 1; without one as it was."""
    bounded = F.greatest(F.least(adjustment_pct, F.lit(BOUND)), F.lit(-BOUND))
    return F.when(adjustment_pct.isNull(), p).otherwise(F.greatest(F.least(p + bounded / 100, F.lit(1.0)), F.lit(0.0)))


def staleness(sessions: DataFrame, absence_days: int = 7, observation: int = 5) -> DataFrame:
    """sessions (day, is_session, previous_session, snapshot_session, last_execution, sessions_since) with guard and observation_left.

    guard: closed, missing, stale (the snapshot is older than the session before), ahead, or proceed. After an absence
    longer than absence_days `observation` sessions are watched before trading.
    """
    snap, before = F.col("snapshot_session"), F.col("previous_session")
    guard = F.when(~F.col("is_session"), "closed").when(snap.isNull(), "missing").when(snap < before, "stale").when(snap > before, "ahead").otherwise("proceed")
    away = F.datediff("day", "last_execution") > absence_days
    left = F.when(away, F.greatest(F.lit(0), F.lit(observation) - F.col("sessions_since") + 1)).otherwise(0)
    return sessions.withColumns({"guard": guard, "observation_left": F.coalesce(left, F.lit(0))})


def bracket(decisions: DataFrame) -> DataFrame:
    """decisions (direction, entry_px, stop_pct, target_pct) with stop_px and target_px on the right sides of the entry, to cents."""
    sign = F.when(F.col("direction") == "LONG", 1).when(F.col("direction") == "SHORT", -1)
    px = lambda pct: F.round((F.col("entry_px").cast("decimal(18,6)") * (1 + pct.cast("decimal(12,8)") / 100)).cast("decimal(28,10)"), 2)
    return decisions.withColumns({"stop_px": px(-sign * F.col("stop_pct")), "target_px": px(sign * F.col("target_pct"))})


def realised_pct(entry: Column, leave: Column, side: Column, cost_pct: Column) -> Column:
    """The result of a closed trade in percent of the notional: the move on its side less the cost."""
    return (leave / entry - 1) * 100 * side - cost_pct


def break_even(r_pct: Column, cost_pct: Column) -> Column:
    return (r_pct + cost_pct) / (2 * r_pct)


def required_trades(p: Column, p0: Column, z_alpha: float = 1.6448536269514722, z_beta: float = 0.8416212335729143) -> Column:
    """Trades needed to tell a hit rate p from p0."""
    return F.when(p != p0, (z_alpha + z_beta) ** 2 * p * (1 - p) / F.pow(p - p0, 2))


def wald(p: Column, n: Column, digits: int = 4, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Both ends of the interval of a share, cut toward zero at the given digits."""
    half = z * F.sqrt(p * (1 - p) / n)
    cut = lambda x: F.signum(x) * F.floor(F.abs(x) * 10**digits) / 10**digits
    return cut(p - half), cut(p + half)
