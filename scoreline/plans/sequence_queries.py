"""Registered queries for ordered state (W2, W3) over the ``events`` table:
each user is one sequence ordered by ``(ts, event_id)``, chunked by hour.  Every
101st event has no user: null keys form a sequence too."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreline.functions import phases
from scoreline.operators.sequence import phase_state, running_last
from scoreline.sources import tables

AS_OF = "2026-03-01"
# Which event kinds carry a date / an explicit phase text (test rules).
DATE_EVENT = "view"
NO_USER_EVERY = 101
PHASE_TEXT_BY_EVENT = {"signup": "League Phase", "purchase": "Round of 16", "error": "unknown"}
COMPETITION_BY_USER = ("UCL", "UEL", "UECL")   # user_id % 3


def _events(spark, sf):
    user = F.when(F.col("event_id") % NO_USER_EVERY != 0, F.col("user_id")).alias("user_id")
    return tables.table(spark, sf, "events").select("event_id", user, "ts", "event_type")


def q_carry_forward_date(spark, sf):
    e = _events(spark, sf).withColumn(
        "found_date", F.when(F.col("event_type") == DATE_EVENT, F.col("ts").cast("date")))
    s = running_last(e, ["user_id"], ["ts", "event_id"], "found_date", "carried", chunk=F.date_trunc("hour", "ts"))
    return s.select("event_id", "user_id",
                    F.coalesce(F.col("carried"), F.lit(AS_OF).cast("date")).alias("match_date"))


def q_carry_forward_phase(spark, sf):
    e = _events(spark, sf)
    text = None
    for k, v in PHASE_TEXT_BY_EVENT.items():
        text = (F.when(F.col("event_type") == k, F.lit(v)) if text is None
                else text.when(F.col("event_type") == k, F.lit(v)))
    comp = (F.when(F.col("user_id") % 3 == 0, F.lit(COMPETITION_BY_USER[0]))
             .when(F.col("user_id") % 3 == 1, F.lit(COMPETITION_BY_USER[1]))
             .otherwise(F.lit(COMPETITION_BY_USER[2])))
    d = F.col("ts").cast("date")
    e = e.select(
        "event_id", "user_id", "ts", comp.alias("competition"),
        F.when(text.isNotNull() & (text != ""), phases.normalize_phase(text)).alias("explicit"))
    e = phases.with_phase(e, "competition", d, phases.season_from_date(d), "inferred")
    s = phase_state(e, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "explicit", "inferred")
    return s.select("event_id", "user_id", "phase")


QUERIES = {
    "carry_forward_date": q_carry_forward_date,
    "carry_forward_phase": q_carry_forward_phase,
}

