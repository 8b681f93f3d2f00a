"""Queries of the general data problems over the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.functions.timeofday import minutes_of_day
from rotaloom.operators.intervals import interval_coverage
from rotaloom.operators.snapshots import snapshot_changes
from rotaloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of each user's day."""
    times = F.struct(minutes_of_day(F.col("shift_start")).alias("s"), minutes_of_day(F.col("shift_end")).alias("e"))
    shifts = table(spark, sf_dir, "canonical_shift").where("schedule_date is not null")
    shifts = shifts.select("user_id", "schedule_date", F.inline(F.array(times)))  # a generator: no filter makes Spark parse again
    end = F.when(F.col("e") < F.col("s"), F.col("e") + 1440).otherwise(F.col("e"))
    cover = interval_coverage(shifts, {"user_id": F.col("user_id"), "day": F.col("schedule_date")}, F.col("s"), end)
    return cover.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("schedule_date"), "kind", F.col("start").cast("int").alias("start_min"), F.col("end").cast("int").alias("end_min"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between each day's consecutive snapshots."""
    return snapshot_changes(table(spark, sf_dir, "day_snapshot")).select("snapshot_id", "event_type", "location_fingerprint", "customer_fingerprint").distinct()


QUERIES = {"p1_found": p1_found, "p4_found": p4_found}
_TEXT = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_COLON = r"'^(?:kl\.? ?)?(\d{1,2}) ?[:. ] ?(\d{2})(?: ?[:.] ?\d{2})?$'"
_GLUED = r"'^(?:kl\.? ?)?(\d{1,2})(\d{2})$'"


def _minutes(column: str) -> str:
    text = _TEXT.format(column)
    value = lambda p: f"try_cast(regexp_extract({text}, {p}, 1) AS INT) * 60 + CASE WHEN try_cast(regexp_extract({text}, {p}, 2) AS INT) < 60 THEN try_cast(regexp_extract({text}, {p}, 2) AS INT) END"
    return f"coalesce({value(_COLON)}, {value(_GLUED)})"


_PLAIN = lambda v: f"coalesce({_TEXT.format(v)}, '')"
_CLOCK = lambda v: f"coalesce((CASE WHEN {_minutes(v)} <= 1440 THEN {_minutes(v)} END)::VARCHAR, {_PLAIN(v)})"
_ELEMENTS = lambda c: f"SELECT DISTINCT snapshot_id, {_PLAIN('x.location_fingerprint')} AS loc, {_PLAIN('x.customer_fingerprint')} AS cust, {_CLOCK('x.start')} AS s, {_CLOCK('x.end')} AS e, {_PLAIN('x.shift_type')} AS ty FROM (SELECT snapshot_id, unnest({c}) AS x FROM b WHERE prev IS NOT NULL) WHERE x IS NOT NULL".replace("x.start", 'x."start"').replace("x.end", 'x."end"')
_WITHOUT = lambda a, b, keys: f"SELECT * FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {' AND '.join(f'{a}.{k} = {b}.{k}' for k in keys.split())})"
_SPARE = lambda a, b: f"""SELECT snapshot_id, loc, cust, s, e, ty FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, loc, cust ORDER BY d DESC, s DESC, e DESC, ty DESC) AS r, count(*) OVER (PARTITION BY snapshot_id, loc, cust) AS n FROM (
    SELECT {a}.*, coalesce(min(abs(try_cast({a}.s AS INT) - try_cast({b}.s AS INT)) + abs(try_cast({a}.e AS INT) - try_cast({b}.e AS INT))), 1048576) AS d, count({b}.s) AS m FROM {a} LEFT JOIN {b} USING (snapshot_id, loc, cust) GROUP BY ALL)) WHERE m = 0 OR r <= n - m"""  # noqa: E731
_MATES = lambda a, keys: f"SELECT *, row_number() OVER (PARTITION BY snapshot_id, {keys} ORDER BY loc, cust, s, e, ty) AS r FROM {a}"
ORACLE: dict[str, str] = {
    "p4_found": f"""
        WITH a AS (SELECT DISTINCT ON (snapshot_id) * FROM day_snapshot WHERE snapshot_payload IS NOT NULL), b AS (SELECT snapshot_id, snapshot_payload AS p, lag(snapshot_payload) OVER w AS q, lag(snapshot_id) OVER w AS prev FROM a WINDOW w AS (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id)),
        n AS ({_ELEMENTS('p')}), o AS ({_ELEMENTS('q')}), nn AS (FROM n EXCEPT FROM o), oo AS (FROM o EXCEPT FROM n), k AS (SELECT snapshot_id, loc, cust FROM n INTERSECT SELECT snapshot_id, loc, cust FROM o),
        n1 AS (SELECT nn.* FROM nn JOIN k USING (snapshot_id, loc, cust)), o1 AS (SELECT oo.* FROM oo JOIN k USING (snapshot_id, loc, cust)), n2 AS ({_WITHOUT('n1', 'o1', 'snapshot_id loc cust s e')}), o2 AS ({_WITHOUT('o1', 'n1', 'snapshot_id loc cust s e')}),
        ln AS ({_WITHOUT('nn', 'k', 'snapshot_id loc cust')} UNION ALL {_SPARE('n2', 'o2')}), lo AS ({_WITHOUT('oo', 'k', 'snapshot_id loc cust')} UNION ALL {_SPARE('o2', 'n2')}),
        rn AS ({_MATES('ln', 'cust, s, e')}), ro AS ({_MATES('lo', 'cust, s, e')}), n3 AS ({_WITHOUT('rn', 'ro', 'snapshot_id cust s e r')}), o3 AS ({_WITHOUT('ro', 'rn', 'snapshot_id cust s e r')}),
        tn AS ({_MATES('(SELECT * EXCLUDE (r) FROM n3)', 'loc, s, e')}), t0 AS ({_MATES('(SELECT * EXCLUDE (r) FROM o3)', 'loc, s, e')}), n4 AS ({_WITHOUT('tn', 't0', 'snapshot_id loc s e r')}), o4 AS ({_WITHOUT('t0', 'tn', 'snapshot_id loc s e r')}),
        z AS (SELECT n2.snapshot_id, 'shift_time_changed' AS event_type, loc, cust FROM n2 JOIN o2 USING (snapshot_id, loc, cust) UNION ALL SELECT snapshot_id, 'shift_reclassified', loc, cust FROM n1 JOIN o1 USING (snapshot_id, loc, cust, s, e)
            UNION ALL SELECT snapshot_id, 'shift_relocated', rn.loc, cust FROM rn JOIN ro USING (snapshot_id, cust, s, e, r) UNION ALL SELECT snapshot_id, 'shift_retitled', loc, tn.cust FROM tn JOIN t0 USING (snapshot_id, loc, s, e, r)
            UNION ALL SELECT snapshot_id, 'shift_added', loc, cust FROM n4 UNION ALL SELECT snapshot_id, 'shift_removed', loc, cust FROM o4)
        SELECT DISTINCT snapshot_id, event_type, loc AS location_fingerprint, cust AS customer_fingerprint FROM z""",
    "p1_found": f"""
        WITH t AS (SELECT DISTINCT user_id, schedule_date, {_minutes('shift_start')} AS s, {_minutes('shift_end')} AS e FROM canonical_shift WHERE schedule_date IS NOT NULL),
        u AS (SELECT user_id, schedule_date, s, CASE WHEN e < s THEN e + 1440 ELSE e END AS e FROM t WHERE s <= 1440 AND e <= 1440 AND s <> e),
        v AS (SELECT *, max(e) OVER (PARTITION BY user_id, schedule_date ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM u),
        w AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, schedule_date ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM v),
        x AS (SELECT user_id, schedule_date, g, min(s) AS a, max(e) AS b FROM w GROUP BY ALL),
        y AS (SELECT *, lead(a) OVER (PARTITION BY user_id, schedule_date ORDER BY a) AS n FROM x)
        SELECT user_id, strftime(schedule_date, '%Y-%m-%d') AS schedule_date, 'period' AS kind, a::INT AS start_min, b::INT AS end_min FROM y
        UNION ALL SELECT user_id, strftime(schedule_date, '%Y-%m-%d'), 'gap', b::INT, n::INT FROM y WHERE n IS NOT NULL""",
}
