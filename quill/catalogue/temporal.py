"""Joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as tm
from .base import query, table

#: Orders in the events' month: 2,405 days of orders become 30 days; customers are users by number.
ORDERS = "o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01') AS BIGINT) // 80) AS at FROM orders)"
HALF = "e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, ts, event_id, event_type, value FROM events), l AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM e GROUP BY user_id, ts)"


def orders(spark, sf_dir):
    days = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - F.unix_seconds(F.lit("1995-01-01").cast("timestamp"))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.floor(days / 80))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), at.alias("at"))


def events(spark, sf_dir):
    """One user has half of the events and more."""
    user = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).alias("user_id")
    return table(spark, sf_dir, "events").select(user, F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


@query(f"WITH {ORDERS}, {HALF} SELECT o_orderkey, o.user_id, l.event_id, l.event_type FROM o ASOF LEFT JOIN l ON o.user_id = l.user_id AND o.at >= l.ts")
def events_as_of_orders(spark, sf_dir):
    """The last event of its user before each order; the user with half of the events is cut into pieces by time."""
    e = events(spark, sf_dir)
    out = tm.as_of(orders(spark, sf_dir), e, ["user_id"], "at", "ts", most=max(1000, e.count() // 8))
    return out.select("o_orderkey", "user_id", "match.event_id", "match.event_type")


@query(
    f"WITH {ORDERS}, {HALF} SELECT o_orderkey, CASE WHEN o.at <= l.ts + INTERVAL '30 minutes' THEN l.event_id END AS event_id FROM o ASOF LEFT JOIN l ON o.user_id = l.user_id AND o.at >= l.ts"
)
def events_as_of_tolerance(spark, sf_dir):
    """As before, but an event over half an hour old is none."""
    out = tm.as_of(orders(spark, sf_dir), events(spark, sf_dir), ["user_id"], "at", "ts", tolerance=30 * 60 * 10**6)
    return out.select("o_orderkey", "match.event_id")


@query(
    f"WITH {ORDERS}, {HALF} SELECT o_orderkey, count(*) AS n, round(sum(value), 4) AS total FROM o JOIN e ON o.user_id = e.user_id AND e.ts BETWEEN o.at - INTERVAL '20 minutes' AND o.at + INTERVAL '10 minutes' GROUP BY o_orderkey"
)
def events_around_orders(spark, sf_dir):
    """Number and sum of the events from 20 minutes before to 10 minutes after each order."""
    met = tm.within(orders(spark, sf_dir), events(spark, sf_dir), ["user_id"], "at", "ts", 20 * 60 * 10**6, 10 * 60 * 10**6)
    return met.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("match.value"), 4).alias("total"))
