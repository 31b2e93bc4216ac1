"""Event streams, as batches over the same expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as st
from .base import query, table

BUCKET = "time_bucket(INTERVAL '{0}', ts, TIMESTAMP '1970-01-01')"


@query(
    f"SELECT {BUCKET.format('1 hour')} AS window_start, {BUCKET.format('1 hour')} + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3"
)
def events_tumbling(spark, sf_dir):
    return _plain(st.windowed(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4)))


@query(
    f"WITH x AS (SELECT *, unnest([0, 1, 2]) AS k FROM events), w AS (SELECT {BUCKET.format('20 minutes')} - k * INTERVAL '20 minutes' AS window_start, event_type, value FROM x) "
    "SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2, 3"
)
def events_sliding(spark, sf_dir):
    return _plain(st.windowed(table(spark, sf_dir, "events"), "1 hour", "20 minutes").withColumn("total", F.round("total", 4)))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '2 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, sid"
)
def events_session(spark, sf_dir):
    return _plain(st.sessions(table(spark, sf_dir, "events"), "2 hours"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def events_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, event_type IN ('click', 'purchase') AS helpful FROM events WHERE event_type <> 'error'")
def feedback_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return st.deduplicated(e, "event_id").select("event_id", "user_id", F.col("event_type").isin("click", "purchase").alias("helpful"))


def _plain(df):
    """Timestamps without zone, as the table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k.startswith("timestamp")})
