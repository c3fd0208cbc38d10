import random

import duckdb
import pytest

from veilscribe.queries import timing
from veilscribe.queries._tables import rounded


def test_rounded_is_that_of_duckdb(spark):
    draw = random.Random(5)
    xs = [2110855.4165, -2110855.4165, 2128673.4775, 2.5, -0.5, 1e300, 1e306, float("inf"), float("-inf"), 0.0, None, *(round(draw.uniform(0, 3e6), 4) for _ in range(20_000)), *(draw.randrange(10**10) / 2000 for _ in range(20_000))]
    con = duckdb.connect()
    for digits in (3, 4, 6):
        frame = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").coalesce(1)
        found = [r["x"] for r in rounded(frame, digits).orderBy("i").collect()]
        assert found == [r[0] for r in con.execute(f"SELECT round(x, {digits}) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [xs]).fetchall()]


@pytest.mark.parametrize("name", ["q_interval_merge", "q_interval_merge_rows"])
def test_intervals_with_halves_and_without_length(spark, tmp_path, name):
    con = duckdb.connect()
    # three events of a user, of which the one between has no length and would join the others; and ends that are nearly halves
    con.sql("""CREATE TABLE events AS SELECT 1::BIGINT AS event_id, 7::BIGINT AS user_id, 'a' AS event_type, TIMESTAMP '2024-01-01 00:00:00' AS ts, 1.0::DOUBLE AS value
      UNION ALL SELECT 2, 7, 'a', TIMESTAMP '2024-01-01 00:10:00', 0.0 UNION ALL SELECT 3, 7, 'a', TIMESTAMP '2024-01-01 00:15:00', 2.0
      UNION ALL SELECT 10 + i, 100 + i, 'a', TIMESTAMP '2024-01-25 10:20:55' + INTERVAL (i * 500) MICROSECOND, 0.5 FROM range(2000) t(i)""")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    found = sorted(tuple(r) for r in timing.QUERIES[name](spark, str(tmp_path)).select("user_id", "start_sec", "end_sec").collect())
    assert found == sorted(con.sql(timing.SQL[name]).project("user_id, start_sec, end_sec").fetchall()) and len(found) == 2002
