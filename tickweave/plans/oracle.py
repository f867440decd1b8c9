"""SQL twins of the catalog queries, for DuckDB on the same Parquet tables."""

from __future__ import annotations

TRADES = """
trades AS (
  SELECT l_suppkey AS isin, l_shipdate AS "tradeTime", l_shipdate AS "publishedTime",
         l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS size,
         l_orderkey || '-' || l_linenumber AS "TVTIC", l_linestatus AS mic,
         CASE l_returnflag WHEN 'R' THEN 'CANC;' WHEN 'A' THEN 'ALGO;;AMND;' ELSE 'ALGO;' END AS flags,
         l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS part,
         l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

TICKS = """
ticks AS (
  SELECT user_id AS isin, ts AS "tradeTime", ts AS "publishedTime", value AS price,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS size, event_id AS "TVTIC",
         event_type AS mic,
         CASE event_type WHEN 'error' THEN 'CANC;' WHEN 'purchase' THEN 'ALGO;;AMND;' ELSE 'ALGO;' END AS flags,
         CAST(timezone('Europe/Berlin', timezone('UTC', ts)) AS DATE) AS trade_day
  FROM events)"""

GROUPED_TICKS = TICKS.replace("user_id AS isin", "CAST(length(bin(user_id + 1)) AS BIGINT) AS isin")

SCORED = (
    TRADES
    + """,
scored AS (
  SELECT isin, "tradeTime", orderkey, linenumber, part,
         CAST(flags LIKE '%CANC%' AS INTEGER) AS target_label,
         round(discount + tax, 2) AS score, price AS buy_price,
         price * (1 + discount - tax) AS sell_price
  FROM trades)"""
)

# The calendar by an Easter rule other than the library's own (Meeus' form).
CALENDAR = """
span AS ({span}),
days AS (
  SELECT CAST(unnest(generate_series(CAST(low AS TIMESTAMP) - INTERVAL 14 DAY, CAST(high AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
  FROM span),
e1 AS (SELECT DISTINCT year(d) AS y FROM days),
e2 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM e1),
e3 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e2),
e4 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e3),
e5 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e4),
easter AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS sunday FROM e5),
named AS (
  SELECT d, isodow(d) >= 6 AS is_weekend,
    CASE WHEN strftime(d, '%m-%d') = '01-01' THEN 'Neujahr'
         WHEN strftime(d, '%m-%d') = '05-01' THEN 'Erster Mai'
         WHEN strftime(d, '%m-%d') = '10-03' THEN 'Tag der Deutschen Einheit'
         WHEN strftime(d, '%m-%d') = '12-25' THEN 'Erster Weihnachtstag'
         WHEN strftime(d, '%m-%d') = '12-26' THEN 'Zweiter Weihnachtstag'
         WHEN d = sunday - 2 THEN 'Karfreitag'
         WHEN d = sunday + 1 THEN 'Ostermontag'
         WHEN d = sunday + 39 THEN 'Christi Himmelfahrt'
         WHEN d = sunday + 50 THEN 'Pfingstmontag' END AS holiday
  FROM days JOIN easter ON y = year(d)),
calendar_all AS (
  SELECT *, NOT is_weekend AND holiday IS NULL AS is_trading,
    max(CASE WHEN NOT is_weekend AND holiday IS NULL THEN d END)
      OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_trading_day
  FROM named),
calendar AS (SELECT c.* FROM calendar_all c, span WHERE d >= CAST(low AS DATE))"""

JANUARY = CALENDAR.format(span="SELECT DATE '2024-01-01' AS low, DATE '2024-01-30' AS high")
WINTER = CALENDAR.format(span="SELECT DATE '2023-12-01' AS low, DATE '2024-03-01' AS high")
ORDER_SPAN = CALENDAR.format(
    span="SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders"
)

BUSY = (
    TICKS
    + """,
per_day AS (SELECT trade_day, count(*) AS n FROM ticks GROUP BY 1),
busy AS (SELECT trade_day, 'trades_' || strftime(trade_day, '%Y%m%d') AS source
         FROM per_day WHERE n >= (SELECT avg(n) FROM per_day)),
report AS (
  SELECT c.d, CASE WHEN c.is_trading THEN 'missing' ELSE 'no trading day' END AS kind,
         CASE WHEN c.is_trading THEN NULL WHEN c.is_weekend THEN 'Weekend'
              ELSE 'Holiday (' || c.holiday || ')' END AS reason, b.source
  FROM calendar c LEFT JOIN busy b ON b.trade_day = c.d
  WHERE c.is_trading = (b.source IS NULL))"""
)

FILES = """
held AS (
  SELECT *, CAST(ts + INTERVAL 2 HOUR AS DATE) AS held_day FROM events),
lines AS (
  SELECT CASE WHEN day(held_day) = 13 THEN 'trades_2024xx13'
              ELSE 'trades_' || strftime(held_day + INTERVAL 1 DAY, '%Y%m%d') END AS source,
         CASE WHEN day(held_day) <> 13 THEN CAST(held_day + INTERVAL 1 DAY AS DATE) END AS file_date,
         held_day, event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         event_type = 'signup' AND day(held_day) % 3 = 0 AS bad_time,
         CASE WHEN day(held_day) = 20 THEN NULL
              WHEN event_type = 'signup' AND day(held_day) % 3 = 0 THEN substr('?' || strftime(ts, '%Y-%m-%d'), 1, 10)
              ELSE strftime(ts, '%Y-%m-%d') END AS date_text,
         row_number() OVER (PARTITION BY held_day ORDER BY ts, event_id) - 1 AS row_num
  FROM held),
others AS (
  SELECT * FROM (VALUES
    ('trades_20240215', DATE '2024-02-15', 'file is empty'),
    ('trades_20240216', DATE '2024-02-16', 'time column not found'),
    ('trades_20240219', DATE '2024-02-19', 'failed to read'),
    ('trades_20240220', DATE '2024-02-20', 'failed to read')) AS t(source, file_date, issue)),
far AS (
  SELECT 'trades_20350101' AS source, DATE '2035-01-01' AS file_date, count(*) AS rows, '2024-01-02' AS date_text
  FROM nation),
listed AS (
  SELECT DISTINCT source, file_date FROM lines UNION ALL SELECT source, file_date FROM others
  UNION ALL SELECT source, file_date FROM far)"""

FILE_AUDIT = (
    FILES
    + """,
spans AS (
  SELECT source, file_date, count(*) AS rows, min(date_text) AS min_date, max(date_text) AS max_date
  FROM lines GROUP BY 1, 2
  UNION ALL SELECT source, file_date, rows, date_text, date_text FROM far),
firsts AS (
  SELECT s.source, min(l.row_num) AS max_date_first_row
  FROM spans s JOIN lines l ON l.source = s.source AND l.date_text = s.max_date GROUP BY 1
  UNION ALL SELECT source, 0 FROM far),
audit AS (
  SELECT n.source, n.file_date, c.prev_trading_day AS expected_date, s.rows, s.min_date, s.max_date,
         f.max_date_first_row,
         coalesce(try_cast(s.max_date AS DATE) = c.prev_trading_day, FALSE) AS matches,
         CASE WHEN n.file_date IS NULL THEN 'invalid date in file name'
              WHEN o.issue IS NOT NULL THEN o.issue
              WHEN s.max_date IS NULL THEN 'no dates'
              WHEN c.prev_trading_day IS NULL THEN 'day outside the calendar'
              WHEN NOT coalesce(try_cast(s.max_date AS DATE) = c.prev_trading_day, FALSE)
              THEN 'date does not match file name' END AS issue
  FROM listed n LEFT JOIN spans s ON s.source = n.source LEFT JOIN firsts f ON f.source = n.source
  LEFT JOIN others o ON o.source = n.source LEFT JOIN calendar c ON c.d = n.file_date)"""
)


def _majority(rows: str) -> str:
    return f"""
WITH {WINTER}, {FILES},
counts AS (
  SELECT source, date_text, count(*) AS n FROM lines WHERE {rows} GROUP BY 1, 2
  UNION ALL SELECT source, date_text, rows FROM far),
major AS (
  SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, coalesce(date_text, '')) = 1)
SELECT f.source, f.file_date, c.prev_trading_day AS expected_date, try_cast(m.date_text AS DATE) AS majority_date,
  coalesce(try_cast(m.date_text AS DATE) = c.prev_trading_day, FALSE) AS matches,
  CASE WHEN f.file_date IS NULL THEN 'invalid date in file name'
       WHEN f.source IN ('trades_20240215', 'trades_20240216', 'trades_20240219') THEN 'file too small'
       WHEN try_cast(m.date_text AS DATE) IS NULL THEN 'no dates' END AS issue
FROM listed f LEFT JOIN major m ON m.source = f.source LEFT JOIN calendar c ON c.d = f.file_date"""


FEATURES = (
    TRADES
    + """,
sized AS (SELECT isin, "tradeTime", orderkey, linenumber, part, price, size * price AS volume FROM trades),
features AS (
  SELECT isin, "tradeTime", orderkey, linenumber, part, price, volume,
    CAST(date_diff('microsecond', lag("tradeTime") OVER w, "tradeTime") // 1000 AS BIGINT) AS delta_t_ms,
    (lead(price) OVER w - price) / price AS target_return,
    CASE WHEN row_number() OVER w >= 10 THEN sum(volume) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS vol_sum_10tick,
    CASE WHEN row_number() OVER w >= 50 THEN sum(volume) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS vol_sum_50tick,
    CASE WHEN row_number() OVER w >= 20 THEN stddev_samp(price) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS price_std_20tick
  FROM sized
  WINDOW w AS (PARTITION BY isin ORDER BY "tradeTime", orderkey, linenumber, part))"""
)

LOT_FEATURES = FEATURES.replace(
    "price, size * price AS volume FROM trades)",
    "price, size * price AS volume FROM (SELECT * REPLACE (isin * 10 + size // 13 AS isin) FROM trades))",
)

COMPLETE = """
complete AS (
  SELECT *, count(*) OVER (PARTITION BY isin) AS n FROM features
  WHERE target_return IS NOT NULL AND delta_t_ms IS NOT NULL AND vol_sum_50tick IS NOT NULL
    AND price_std_20tick IS NOT NULL)"""


def _window(name: str, source: str, micros: int, columns: str) -> str:
    return f"""
{name} AS (
  SELECT *, {columns} FROM {source}
  WINDOW w AS (PARTITION BY isin ORDER BY "tradeTime"
               RANGE BETWEEN INTERVAL {micros - 1} MICROSECONDS PRECEDING AND CURRENT ROW))"""


HOUR = 3_600_000_000
PAST = """arg_max(price, "tradeTime") OVER w AS current_price, max(price) OVER w AS {max},
  sum(size * price) OVER w AS {sum}, CAST(count(*) OVER w AS BIGINT) AS {count}"""
FUTURE = """max(price) OVER w AS future_max_price, arg_max(price, "tradeTime") OVER w AS sell_price"""

FUTURE_JOINED = (
    _window("windows", "ticks", 60 * HOUR, FUTURE)
    + """,
ends AS (SELECT isin, "tradeTime" - INTERVAL 72 HOUR AS at, future_max_price, sell_price FROM windows),
buys AS (SELECT isin, "tradeTime" - INTERVAL 30 MINUTE AS at, price AS buy_price FROM ticks)"""
)

BENCH = """
bench AS (SELECT "tradeTime" AS bench_time, price, trade_day FROM ticks WHERE isin = 1),
closes AS (SELECT trade_day, arg_max(price, bench_time) AS bench_close FROM bench GROUP BY 1),
daily AS (SELECT trade_day, lag(bench_close) OVER (ORDER BY trade_day) AS prev FROM closes),
delta AS (
  SELECT t.isin, t."tradeTime", t."TVTIC", (b.price - d.prev) / d.prev AS bench_delta
  FROM ticks t ASOF LEFT JOIN bench b ON t."tradeTime" >= b.bench_time
  LEFT JOIN daily d ON d.trade_day = t.trade_day)"""

CURVE = """
groups AS (SELECT isin, score AS threshold, CAST(sum(target_label) AS BIGINT) AS pos, count(*) AS n FROM {scored} GROUP BY 1, 2),
curve AS (
  SELECT isin, threshold, pos, n,
    CAST(sum(pos) OVER w AS BIGINT) AS hits, CAST(sum(n) OVER w AS BIGINT) AS picks,
    CAST(sum(pos) OVER p AS BIGINT) AS positives, CAST(sum(n) OVER p AS BIGINT) AS rows
  FROM groups
  WINDOW w AS (PARTITION BY isin ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING),
         p AS (PARTITION BY isin)),
points AS (
  SELECT *, hits / picks AS precision, CASE WHEN positives > 0 THEN hits / positives END AS recall FROM curve),
judged AS (
  SELECT *, coalesce(CASE WHEN hits > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) END, 0) AS f FROM points),
best AS (
  SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY isin ORDER BY f DESC, threshold) = 1),
areas AS (
  SELECT isin, max(rows) AS rows, max(positives) AS positives,
         sum((n - pos) * ((hits - pos) + pos / 2.0)) AS area FROM curve GROUP BY 1),
metrics AS (
  SELECT a.isin, a.rows, a.positives,
    CASE WHEN a.positives BETWEEN 1 AND a.rows - 1 THEN CAST(area AS DOUBLE) / (a.positives * (a.rows - a.positives)) ELSE 0 END AS auc,
    CASE WHEN a.positives BETWEEN 1 AND a.rows - 1 THEN b.threshold ELSE 0.5 END AS threshold,
    CASE WHEN a.positives BETWEEN 1 AND a.rows - 1 THEN b.precision ELSE 0 END AS precision,
    CASE WHEN a.positives BETWEEN 1 AND a.rows - 1 THEN b.recall ELSE 0 END AS recall
  FROM areas a JOIN best b ON a.isin = b.isin)"""

SPLIT = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY isin ORDER BY "tradeTime", orderkey, linenumber, part) AS place,
         count(*) OVER (PARTITION BY isin) AS total_rows
  FROM {source}),
parts AS (SELECT *, place <= floor(total_rows * 0.8) AS is_train FROM placed WHERE total_rows >= 100)"""

TESTED = (
    SCORED + "," + SPLIT.format(source="scored")
    + ", tested AS (SELECT * FROM parts WHERE NOT is_train)," + CURVE.format(scored="tested")
)

RETURNS = """
signals AS (SELECT t.* FROM tested t JOIN metrics m ON m.isin = t.isin WHERE t.score >= m.threshold),
gains AS (
  SELECT isin, avg((sell_price - buy_price) / buy_price * 100) AS avg_pnl,
         string_agg(DISTINCT strftime("tradeTime", '%Y-%m-%d'), ' | ' ORDER BY strftime("tradeTime", '%Y-%m-%d')) AS signal_dates
  FROM signals GROUP BY 1)"""

REPORTED = """,
totals AS (SELECT isin, max(total_rows) AS total_rows FROM tested GROUP BY 1),
report AS (
  SELECT m.isin AS "ISIN", t.total_rows AS "Total_Ticks", m.rows AS "Test_Set_Ticks",
    m.positives AS "Actual_Breakouts_In_Test",
    printf('%.2f%%', m.positives / m.rows * 100) AS "Base_Breakout_Frequency",
    printf('%.4f', m.threshold) AS "Optimal_Threshold",
    printf('%.2f%%', m.precision * 100) AS "Model_Precision (F0.5)",
    printf('%.2f%%', m.recall * 100) AS "Model_Recall",
    round_even(m.auc, 4) AS "ROC_AUC_Score",
    round_even(coalesce(g.avg_pnl, 0), 2) AS "Test_Set_Avg_PnL_Percent",
    coalesce(g.signal_dates, 'None') AS "Signal_Dates"
  FROM metrics m LEFT JOIN gains g ON g.isin = m.isin LEFT JOIN totals t ON t.isin = m.isin)"""

REPORT = TESTED + "," + RETURNS + REPORTED

# Thresholds of the validation rows, everything else of the test rows; AUC by ranks.
REPORT_UNSEEN = (
    SCORED + "," + SPLIT.format(source="scored")
    + """,
checked AS (SELECT * FROM parts WHERE is_train AND place > floor(floor(total_rows * 0.8) * 0.8)),
tested AS (SELECT * FROM parts WHERE NOT is_train),"""
    + CURVE.format(scored="checked")
    + """,
ranked AS (
  SELECT t.*, coalesce(m.threshold, 0.5) AS threshold, rank() OVER (PARTITION BY t.isin ORDER BY score) AS low,
         count(*) OVER (PARTITION BY t.isin, score) AS same
  FROM tested t LEFT JOIN metrics m ON m.isin = t.isin),
summed AS (
  SELECT isin, max(threshold) AS threshold, count(*) AS rows, CAST(sum(target_label) AS BIGINT) AS positives,
         sum(target_label) FILTER (score >= threshold) AS hits, count(*) FILTER (score >= threshold) AS picks,
         sum(low + (same - 1) / 2) FILTER (target_label = 1) AS ranks
  FROM ranked GROUP BY 1),
final AS (
  SELECT isin, threshold, rows, positives,
    coalesce(hits / nullif(picks, 0), 0) AS precision, coalesce(hits / nullif(positives, 0), 0) AS recall,
    CASE WHEN positives BETWEEN 1 AND rows - 1
      THEN (ranks - positives * (positives + 1) / 2) / (positives * (rows - positives)) ELSE 0 END AS auc
  FROM summed),"""
    + (RETURNS + REPORTED).replace("metrics m", "final m")
)

LATEST = """ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC) = 1"""

SIGNED = "CASE WHEN flags LIKE '%CANC%' THEN -size ELSE size END"

ORACLE = {
    "dedupe_keep_last": f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber {LATEST}""",
    "dedupe_per_source": f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_linestatus, l_orderkey, l_linenumber {LATEST}""",
    "latest_name": """
SELECT o_custkey, o_orderpriority FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "union_drift": """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
    "duplicate_profile": f"""
WITH {TRADES},
local AS (SELECT mic, "TVTIC" AS id, count(*) AS n FROM trades GROUP BY 1, 2),
ids AS (SELECT id, sum(n) AS n, max(n) AS most, count(*) AS sources FROM local GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS ids,
  CAST(count(*) FILTER (most > 1) AS BIGINT) AS ids_repeated_in_source,
  CAST(count(*) FILTER (sources > 1) AS BIGINT) AS ids_in_several_sources,
  CAST(max(n) AS BIGINT) AS most_copies FROM ids""",
    "flag_profile": f"""
WITH {TRADES}, single AS (SELECT unnest(string_split(flags, ';')) AS flag FROM trades)
SELECT flag, count(*) AS rows FROM single WHERE flag <> '' GROUP BY 1""",
    "cancelled_pairs": f"""
WITH {TRADES},
lots AS (SELECT isin, "tradeTime", size // 10 AS lot, flags, orderkey, linenumber, part, flags LIKE '%CANC%' AS c FROM trades),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY isin, "tradeTime", lot, c ORDER BY orderkey, linenumber, part) AS place,
    count(*) FILTER (c) OVER (PARTITION BY isin, "tradeTime", lot) AS nc,
    count(*) FILTER (NOT c) OVER (PARTITION BY isin, "tradeTime", lot) AS no
  FROM lots)
SELECT isin, "tradeTime", lot, flags, orderkey, linenumber, part FROM counted WHERE place > least(nc, no)""",
    "split_executions": f"""
WITH {TRADES}
SELECT isin, "tradeTime", mic, count(*) AS parts, CAST(sum(size) AS BIGINT) AS total_size
FROM trades GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "consolidate_signed": f"""
WITH {TICKS}
SELECT isin, CAST(floor(price / 10) AS BIGINT) AS band, CAST(sum({SIGNED}) AS BIGINT) AS size,
  min("tradeTime") AS "tradeTime", arg_min("TVTIC", "tradeTime") AS "TVTIC", arg_min(mic, "tradeTime") AS mic,
  'ALGO;' AS flags
FROM ticks GROUP BY isin, band, trade_day HAVING sum({SIGNED}) > 0""",
    "consolidated_small": f"""
WITH {TRADES},
coarse AS (
  SELECT * REPLACE (CAST(date_trunc('month', "tradeTime") AS TIMESTAMP) AS "tradeTime", floor(price / 20000) * 20000.0::DOUBLE + 1.0::DOUBLE AS price) FROM trades),
latest AS (SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY "TVTIC" ORDER BY "publishedTime" DESC, isin DESC, part DESC) = 1),
netted AS (
  SELECT *, row_number() OVER (PARTITION BY isin, price, date_trunc('second', "tradeTime") ORDER BY "tradeTime", "publishedTime", "TVTIC", part) AS place,
    sum({SIGNED}) OVER (PARTITION BY isin, price, date_trunc('second', "tradeTime")) AS total
  FROM latest),
merged AS (SELECT isin, price, CAST(total AS BIGINT) AS total_size, "tradeTime", "TVTIC", flags, mic, part FROM netted WHERE place = 1 AND total > 0),
lively AS (SELECT isin FROM merged GROUP BY isin, CAST("tradeTime" AS DATE) HAVING count(*) >= 2 AND sum(total_size * price) >= 60000)
SELECT * FROM merged WHERE isin IN (SELECT isin FROM lively)""",
    "consolidated_large": f"""
WITH {TICKS}, {JANUARY},
coarse AS (
  SELECT * REPLACE (CAST(date_trunc('day', "tradeTime") AS TIMESTAMP) AS "tradeTime", CAST("tradeTime" AS DATE) AS trade_day, floor(price / 50) * 50.0::DOUBLE + 1.0::DOUBLE AS price) FROM ticks),
latest AS (SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY mic, "TVTIC" ORDER BY "publishedTime" DESC) = 1),
netted AS (
  SELECT *, row_number() OVER (PARTITION BY isin, price, date_trunc('second', "tradeTime") ORDER BY "tradeTime", "TVTIC") AS place,
    sum({SIGNED}) OVER (PARTITION BY isin, price, date_trunc('second', "tradeTime")) AS total
  FROM latest WHERE trade_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'),
merged AS (SELECT isin, price, CAST(total AS BIGINT) AS size, "tradeTime", "TVTIC", mic, trade_day FROM netted WHERE place = 1 AND total > 0),
active AS (SELECT isin, trade_day FROM merged GROUP BY 1, 2 HAVING sum(size * price) >= 2000),
often AS (SELECT isin FROM active GROUP BY 1 HAVING count(*) >= greatest(0,
  (SELECT count(*) FROM calendar WHERE is_trading AND d BETWEEN DATE '2024-01-03' AND DATE '2024-01-26') - 8))
SELECT isin, price, size, "tradeTime", "TVTIC", mic, 'ALGO;' AS flags FROM merged WHERE isin IN (SELECT isin FROM often)""",
    "time_bound": f"""
WITH {TICKS}
SELECT isin, "tradeTime", "publishedTime", price, size, "TVTIC", mic, flags FROM ticks
WHERE trade_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'""",
    "daily_activity": f"""
WITH {TICKS}
SELECT isin, trade_day, count(*) AS tx_count, round(sum(size * price), 2) AS daily_volume FROM ticks GROUP BY 1, 2""",
    "universe_any_day": f"""
WITH {TICKS}
SELECT isin, "tradeTime", "publishedTime", price, size, "TVTIC", mic, flags FROM ticks WHERE isin IN (
  SELECT isin FROM ticks GROUP BY isin, trade_day HAVING count(*) >= 6 AND sum(size * price) >= 10000)""",
    "universe_enough_days": f"""
WITH {TICKS}, {JANUARY},
active AS (SELECT isin, trade_day FROM ticks GROUP BY 1, 2 HAVING sum(size * price) >= 2000),
often AS (SELECT isin FROM active GROUP BY 1 HAVING count(*) >= greatest(0, (SELECT count(*) FROM calendar WHERE is_trading) - 2))
SELECT isin, "tradeTime", "publishedTime", price, size, "TVTIC", mic, flags FROM ticks WHERE isin IN (SELECT isin FROM often)""",
    "prev_trading_day": f"""
WITH {ORDER_SPAN}
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day, prev_trading_day
FROM orders JOIN calendar ON d = CAST(o_orderdate AS DATE)""",
    "trading_days_by_month": f"""
WITH {ORDER_SPAN},
sold AS (SELECT CAST(o_orderdate AS DATE) AS order_day, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(d, '%Y-%m') AS month, CAST(count(*) FILTER (is_trading) AS BIGINT) AS trading_days,
  count(holiday) AS holidays, CAST(coalesce(sum(n) FILTER (is_trading), 0) AS BIGINT) AS orders
FROM calendar LEFT JOIN sold ON order_day = d GROUP BY 1""",
    "coverage_report": f"WITH {JANUARY}, {BUSY} SELECT * FROM report",
    "missing_by_month": f"""
WITH {JANUARY}, {BUSY}
SELECT strftime(d, '%Y-%m') AS month, string_agg(strftime(d, '%d'), ', ' ORDER BY d) AS days
FROM report WHERE kind = 'missing' GROUP BY 1""",
    "last_day_position": f"""
WITH {TICKS},
numbered AS (
  SELECT mic, trade_day, row_number() OVER (PARTITION BY mic ORDER BY "TVTIC") - 1 AS row_num,
    max(trade_day) OVER (PARTITION BY mic) AS last FROM ticks)
SELECT mic, count(*) AS rows, min(trade_day) AS min_date, max(trade_day) AS max_date,
  min(row_num) FILTER (trade_day = last) AS max_date_first_row FROM numbered GROUP BY 1""",
    "files_chosen": f"""
WITH {WINTER}, {FILES}
SELECT source, file_date, file_date IS NULL OR file_date BETWEEN DATE '2024-01-07' AND DATE '2024-01-24' AS near,
  coalesce(prev_trading_day BETWEEN DATE '2024-01-12' AND DATE '2024-01-19', FALSE) AS exact
FROM listed LEFT JOIN calendar ON d = file_date""",
    "sources_with_names": f"""
WITH {FILES} SELECT DISTINCT source FROM lines WHERE day(held_day) % 2 = 1
UNION ALL SELECT source FROM others WHERE issue = 'file is empty'""",
    "unreadable_files": f"WITH {FILES} SELECT source FROM others WHERE issue = 'failed to read'",
    "first_file_rows": f"""
WITH {FILES} SELECT source, CAST(event_id AS VARCHAR) AS "TVTIC" FROM lines WHERE row_num < 100""",
    "file_date_audit": f"""
WITH {WINTER}, {FILE_AUDIT}
SELECT * REPLACE (CAST(rows AS DOUBLE) AS rows, CAST(max_date_first_row AS DOUBLE) AS max_date_first_row) FROM audit""",
    "file_audit_summary": f"""
WITH {WINTER}, {FILE_AUDIT}
SELECT count(*) AS checked, CAST(count(*) FILTER (issue IS NULL) AS BIGINT) AS perfect,
  CAST(count(*) FILTER (issue IS NOT NULL) AS BIGINT) AS with_issues FROM audit""",
    "file_majority_date": _majority("TRUE"),
    "file_majority_of_head": _majority("row_num < 100"),
    "coverage_counts": f"""
WITH {JANUARY}, {BUSY}
SELECT count(*) FILTER (c.is_trading AND b.source IS NOT NULL) AS valid_days,
  count(*) FILTER (c.is_trading AND b.source IS NULL) AS missing_days,
  count(*) FILTER (NOT c.is_trading AND b.source IS NOT NULL) AS extra_days
FROM calendar c LEFT JOIN busy b ON b.trade_day = c.d""",
    "ingest_quoted": f"""
WITH {FILES}
SELECT source, 'U' || user_id AS isin, ts AS "tradeTime", ts AS "publishedTime", value AS price, k AS size,
  'MONE' AS quotation, 'EUR' AS currency, CAST(event_id AS VARCHAR) AS "TVTIC", event_type AS mic,
  CASE event_type WHEN 'error' THEN 'CANC;' ELSE 'ALGO;;AMND;' END AS flags
FROM lines WHERE NOT bad_time AND day(held_day) <> 20 AND k >= 5""",
    "ingest_unquoted": f"""
WITH {FILES}
SELECT source, 'U' || user_id AS isin, ts AS "tradeTime",
  CASE WHEN day(held_day) % 2 = 0 THEN ts END AS "publishedTime", value AS price, k AS size,
  'MONE' AS quotation, ' EUR ' AS currency, CAST(event_id AS VARCHAR) AS "TVTIC", event_type AS mic,
  CASE event_type WHEN 'error' THEN 'CANC' ELSE 'ALGO' END AS flags
FROM lines WHERE NOT bad_time AND day(held_day) <> 20 AND k >= 5""",
    "ingest_security_names": f"""
WITH {FILES}
SELECT 'U' || user_id AS isin,
  arg_max('The "U" ' || user_id || ' ' || CAST(day(held_day) // 10 AS VARCHAR), coalesce(file_date, DATE '1900-01-01')) AS "displayName"
FROM lines WHERE day(held_day) % 2 = 1 GROUP BY user_id""",
    "stored_by_day": f"""
WITH {TICKS} SELECT * FROM ticks WHERE trade_day BETWEEN DATE '2024-01-09' AND DATE '2024-01-18'""",
    "report_file": f"""
WITH {REPORT} SELECT "ISIN", "Optimal_Threshold", "ROC_AUC_Score", "Signal_Dates" FROM report""",
    "tick_window_features": f"""
WITH {FEATURES}
SELECT isin, "tradeTime", orderkey, linenumber, part, delta_t_ms, round(volume, 2) AS volume,
  round(target_return, 6) AS target_return, round(vol_sum_10tick, 2) AS vol_sum_10tick,
  round(vol_sum_50tick, 2) AS vol_sum_50tick, round(price_std_20tick, 4) AS price_std_20tick
FROM features WHERE target_return IS NOT NULL AND delta_t_ms IS NOT NULL AND vol_sum_50tick IS NOT NULL
  AND price_std_20tick IS NOT NULL""",
    "return_training_rows": f"""
WITH {LOT_FEATURES}, {COMPLETE}
SELECT isin, "tradeTime", orderkey, linenumber, part, delta_t_ms FROM complete WHERE n >= 100""",
    "chosen_return_models": f"""
WITH {LOT_FEATURES}, {COMPLETE}
SELECT isin, count(*) AS rows, CASE WHEN count(*) >= 100 THEN 100 ELSE 0 END AS rounds,
  CASE WHEN count(*) >= 100 THEN 'saved' ELSE 'skipped' END AS status,
  CASE WHEN count(*) >= 100 THEN count(*) ELSE 0 END AS scored,
  CASE WHEN count(*) >= 100 THEN round(avg(target_return), 6) END AS mean_score
FROM complete GROUP BY isin""",
    "return_model": f"""
WITH {FEATURES}, {COMPLETE}
SELECT isin, count(*) AS rows, round(stddev_pop(target_return), 6) AS rmse_of_mean,
  round(sum(sum(target_return)) OVER () / sum(count(*)) OVER (), 6) AS mean_score
FROM complete WHERE n >= 100 GROUP BY isin""",
    "time_window_past": f"""
WITH {TICKS}, {_window("rolled", "ticks", 48 * HOUR, PAST.format(max="max_price", sum="volume", count="tick_count"))}
SELECT isin, "tradeTime", "TVTIC", current_price, max_price, round(volume, 2) AS volume, tick_count FROM rolled""",
    "time_window_split": f"""
WITH {TICKS}, {_window("rolled", "ticks", 60 * HOUR, PAST.format(max="max_price", sum="volume", count="tick_count"))}
SELECT isin, "tradeTime", "TVTIC", current_price, max_price, round(volume, 2) AS volume, tick_count FROM rolled""",
    "open_slice_features": f"""
WITH {TICKS}, {_window("rolled", "ticks", 6 * HOUR, PAST.format(max="past_max_price", sum="past_volume", count="past_tick_count"))},
opened AS (SELECT *, min("tradeTime") OVER (PARTITION BY isin, trade_day) AS open_time FROM rolled)
SELECT isin, "tradeTime", "TVTIC", current_price, past_max_price, round(past_volume, 2) AS past_volume,
  past_tick_count, open_time
FROM opened WHERE "tradeTime" BETWEEN open_time + INTERVAL 6 HOUR AND open_time + INTERVAL 16 HOUR""",
    "asof_backward_nokey": f"""
WITH {TICKS}, bench AS (SELECT "tradeTime" AS at, price FROM ticks WHERE isin = 1)
SELECT t.isin, t."tradeTime", t."TVTIC", b.price AS bench_current_price
FROM ticks t ASOF LEFT JOIN bench b ON t."tradeTime" >= b.at""",
    "asof_forward_key": f"""
WITH {TICKS}, buys AS (SELECT isin, "tradeTime" - INTERVAL 30 MINUTE AS at, price AS buy_price FROM ticks)
SELECT t.isin, t."tradeTime", t."TVTIC", b.buy_price
FROM ticks t ASOF LEFT JOIN buys b ON t.isin = b.isin AND t."tradeTime" <= b.at""",
    "asof_forward_within": f"""
WITH {TICKS}, buys AS (SELECT isin, "tradeTime" - INTERVAL 30 MINUTE AS at, price AS buy_price FROM ticks)
SELECT t.isin, t."tradeTime", t."TVTIC",
  CASE WHEN b.at - t."tradeTime" <= INTERVAL 12 HOUR THEN b.buy_price END AS buy_price
FROM ticks t ASOF LEFT JOIN buys b ON t.isin = b.isin AND t."tradeTime" <= b.at""",
    "asof_backward_key": f"""
WITH {TICKS}, cancels AS (SELECT isin, "tradeTime" AS at, price AS cancel_price FROM ticks WHERE flags = 'CANC;')
SELECT t.isin, t."tradeTime", t."TVTIC", c.cancel_price
FROM ticks t ASOF LEFT JOIN cancels c ON t.isin = c.isin AND t."tradeTime" >= c.at""",
    "benchmark_delta": f"""
WITH {TICKS}, {BENCH} SELECT isin, "tradeTime", "TVTIC", round(bench_delta, 6) AS bench_delta FROM delta""",
    "future_target": f"""
WITH {TICKS}, {FUTURE_JOINED}
SELECT t.isin, t."tradeTime", t."TVTIC", e.future_max_price, e.sell_price, b.buy_price
FROM ticks t ASOF LEFT JOIN ends e ON t.isin = e.isin AND t."tradeTime" <= e.at
ASOF LEFT JOIN buys b ON t.isin = b.isin AND t."tradeTime" <= b.at""",
    "breakout_label": f"""
WITH {TICKS}, {BENCH}, {FUTURE_JOINED},
{_window("rolled", "ticks", 48 * HOUR, PAST.format(max="past_max_price", sum="past_volume", count="past_tick_count"))},
opened AS (SELECT *, min("tradeTime") OVER (PARTITION BY isin, trade_day) AS open_time FROM rolled),
sliced AS (SELECT * FROM opened WHERE "tradeTime" <= open_time + INTERVAL 24 HOUR),
joined AS (
  SELECT s.*, d.bench_delta, e.future_max_price, e.sell_price, b.buy_price
  FROM sliced s JOIN delta d ON d."TVTIC" = s."TVTIC"
  ASOF LEFT JOIN ends e ON s.isin = e.isin AND s."tradeTime" <= e.at
  ASOF LEFT JOIN buys b ON s.isin = b.isin AND s."tradeTime" <= b.at)
SELECT isin, "tradeTime", "TVTIC", current_price, past_max_price, round(past_volume, 2) AS past_volume,
  past_tick_count, round(bench_delta, 6) AS bench_delta, open_time, future_max_price, sell_price, buy_price,
  CAST(future_max_price >= past_max_price * 1.005::DOUBLE AS INTEGER) AS target_label
FROM joined WHERE bench_delta IS NOT NULL AND future_max_price IS NOT NULL AND buy_price IS NOT NULL""",
    "breakout_by_key": f"""
WITH {GROUPED_TICKS}, {BENCH}, {FUTURE_JOINED},
{_window("rolled", "ticks", 48 * HOUR, PAST.format(max="past_max_price", sum="past_volume", count="past_tick_count"))},
opened AS (SELECT *, min("tradeTime") OVER (PARTITION BY isin, trade_day) AS open_time FROM rolled),
sliced AS (SELECT * FROM opened WHERE "tradeTime" <= open_time + INTERVAL 24 HOUR),
joined AS (
  SELECT s.*, d.bench_delta, e.future_max_price, e.sell_price, b.buy_price
  FROM sliced s JOIN delta d ON d."TVTIC" = s."TVTIC"
  ASOF LEFT JOIN ends e ON s.isin = e.isin AND s."tradeTime" <= e.at
  ASOF LEFT JOIN buys b ON s.isin = b.isin AND s."tradeTime" <= b.at),
labelled AS (
  SELECT isin, "tradeTime", "TVTIC", CAST(future_max_price >= past_max_price * 1.005::DOUBLE AS INTEGER) AS target_label
  FROM joined WHERE bench_delta IS NOT NULL AND future_max_price IS NOT NULL AND buy_price IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY isin ORDER BY "tradeTime", "TVTIC") AS place,
         count(*) OVER (PARTITION BY isin) AS rows FROM labelled)
SELECT isin, any_value(rows) AS rows, any_value(rows) >= 100 AS is_fitted,
  count(*) FILTER (rows >= 100 AND place > floor(rows * 0.8)) AS test_rows,
  CAST(coalesce(sum(target_label) FILTER (rows >= 100 AND place > floor(rows * 0.8)), 0) AS BIGINT) AS test_breakouts
FROM placed GROUP BY isin""",
    "chronological_split": f"""
WITH {TRADES}, lots AS (SELECT * REPLACE (isin * 10 + size // 10 AS isin) FROM trades), {SPLIT.format(source="lots")}
SELECT isin, "tradeTime", orderkey, linenumber, part, total_rows, is_train FROM parts""",
    "pr_curve": f"""
WITH {SCORED}, {CURVE.format(scored="scored")}
SELECT isin, threshold, hits, picks, round(precision, 6) AS precision, round(recall, 6) AS recall FROM points""",
    "auc_by_key": f"""
WITH {SCORED}, {CURVE.format(scored="scored")} SELECT isin, round(auc, 6) AS auc FROM metrics""",
    "best_fbeta": f"""
WITH {SCORED}, {CURVE.format(scored="scored")}
SELECT isin, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM metrics""",
    "signal_returns": f"""
WITH {TESTED}, {RETURNS} SELECT isin, round(avg_pnl, 4) AS avg_pnl, signal_dates FROM gains""",
    "strategy_report": f"WITH {REPORT} SELECT * FROM report",
    "strategy_report_unseen": f"WITH {REPORT_UNSEEN} SELECT * FROM report",
    "most_predictable": f"""
WITH {REPORT} SELECT "ISIN", "ROC_AUC_Score" FROM report ORDER BY "ROC_AUC_Score" DESC, "ISIN" LIMIT 5""",
}
