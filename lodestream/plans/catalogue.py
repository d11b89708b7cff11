"""The queries of the library's own operators: each takes (spark, sf_dir) and reads whole tables.

SQL holds the counterpart of each query for DuckDB, under the same name and with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import adaptive, bars, drift, hourly, learners, prequential, ranking, significance, survey, trees
from ..session import keyed
from ..sources import arff
from ..sources.tables import table
from ..streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TYPES = ["click", "error", "purchase", "signup", "view"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show, and times as text."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c, digits)
        elif kind.startswith(("timestamp", "date")):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- hourly demand

HOURLY = """hourly AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n_events, avg(value) AS avg_value, sum(value) AS sum_value
  FROM events WHERE value BETWEEN 0.5 AND 400 GROUP BY ALL)"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.demand(table(spark, sf_dir, "events"), "event_type", 0.5, 400.0)


@query(f"WITH {HOURLY} SELECT event_type, hour::VARCHAR AS hour, n_events, round(avg_value, 6) AS avg_value, round(sum_value, 6) AS sum_value FROM hourly")
def hourly_demand(spark, sf_dir):
    return rounded(_hourly(spark, sf_dir))


LAGS = """lagged AS (SELECT event_type, hour, sum_value, row_number() OVER w - 1 AS row_num, lag(sum_value, 1) OVER w AS lag_1, lag(sum_value, 2) OVER w AS lag_2,
  CASE WHEN count(sum_value) OVER p4 >= 4 THEN avg(sum_value) OVER p4 END AS mean_4, CASE WHEN count(sum_value) OVER p12 >= 12 THEN avg(sum_value) OVER p12 END AS mean_12,
  CASE WHEN count(sum_value) OVER p24 >= 24 THEN avg(sum_value) OVER p24 END AS mean_24, CASE WHEN count(sum_value) OVER p24 >= 24 THEN stddev_samp(sum_value) OVER p24 END AS std_24
  FROM hourly WINDOW w AS (PARTITION BY event_type ORDER BY hour), p4 AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
  p12 AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), p24 AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"""


@query(
    f"""WITH {HOURLY}, {LAGS} SELECT event_type, hour::VARCHAR AS hour, row_num, round(lag_1, 6) AS lag_1, round(lag_2, 6) AS lag_2, round(lag_1 - lag_2, 6) AS delta,
    round(mean_4, 6) AS mean_4, round(mean_12, 6) AS mean_12, round(mean_24, 6) AS mean_24, round(std_24, 6) AS std_24 FROM lagged WHERE row_num >= 24"""
)
def hourly_features(spark, sf_dir):
    df = hourly.lag_features(_hourly(spark, sf_dir), "event_type", "sum_value")
    return rounded(df.select("event_type", "hour", "row_num", "lag_1", "lag_2", "delta", "mean_4", "mean_12", "mean_24", "std_24"), 6)


@query(
    f"""WITH {HOURLY}, m AS (SELECT *, quantile_cont(sum_value, 0.5) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_median FROM hourly)
    SELECT event_type, hour::VARCHAR AS hour, round(past_median, 4) AS past_median, CASE WHEN sum_value > past_median THEN 'HIGH' ELSE 'LOW' END AS label FROM m"""
)
def past_median_label(spark, sf_dir):
    return rounded(hourly.past_median_label(_hourly(spark, sf_dir), "event_type", "sum_value").select("event_type", "hour", "past_median", "label"), 4)


@query(
    """SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos, round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0.0 AS day_sin,
    round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0.0 AS day_cos, (isodow(ts) >= 6)::INT AS weekend, ((month(ts) * 100 + day(ts)) IN (101, 115, 219, 527, 619, 704, 902, 1111, 1128, 1225))::INT AS holiday FROM events"""
)
def cyclic_time(spark, sf_dir):
    df = rounded(hourly.cyclic_time(table(spark, sf_dir, "events").select("event_id", "ts"), "ts")).drop("ts")
    return df.withColumns({c: F.col(c) + 0.0 for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")})  # no negative zero


@query(
    """WITH v AS (SELECT c_nationkey AS nation, o_orderdate::DATE AS day, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    e AS (SELECT a.n_nationkey AS nation, b.n_nationkey AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
    m AS (SELECT e.nation, v.day, avg(v.total) AS neighbour_avg FROM v JOIN e ON v.nation = e.neighbour GROUP BY ALL)
    SELECT v.day::VARCHAR AS day, v.nation, round(v.total, 6) AS total, round(m.neighbour_avg, 6) AS neighbour_avg FROM v LEFT JOIN m ON v.nation = m.nation AND v.day = m.day"""
)
def neighbour_mean(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    totals = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    a, b = nation.select(F.col("n_nationkey").alias("nation"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("neighbour"), "n_regionkey")
    edges = a.join(b, "n_regionkey").where("nation <> neighbour").select("nation", "neighbour")
    return rounded(hourly.neighbour_mean(totals, edges, "day", "nation", "total").select("day", "nation", "total", "neighbour_avg"), 6)


@query(f"SELECT ts::DATE::VARCHAR AS day, {', '.join(f'''round(sum(value) FILTER (event_type = '{t}'), 4) AS "{t}"''' for t in TYPES)} FROM events GROUP BY ALL")
def pivot_daily(spark, sf_dir):
    return rounded(hourly.pivoted(table(spark, sf_dir, "events"), "event_type", TYPES), 4)


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY ALL"""
)
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    df = table(spark, sf_dir, "events").withColumn("fresh", F.when(gap <= 3_600_000_000, 0).otherwise(1))
    df = df.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rounded(df.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")), 4)


@query("SELECT event_type, count(*) AS n, round(avg((props->>'$.k')::DOUBLE), 6) AS mean_k FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(k).alias("mean_k")))


# ---------------------------------------------------------------- bars and indicators

BARS = """bars AS (SELECT event_type AS symbol, ts::DATE AS day, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL)"""


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily(table(spark, sf_dir, "events"), "event_type")


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(expr: str, column: str, n: int) -> str:
    return f"CASE WHEN count({column}) OVER {_frame(n)} >= {n} THEN {expr}({column}) OVER {_frame(n)} END"


@query(f"WITH {BARS} SELECT symbol, day::VARCHAR AS day, open, high, low, close, volume FROM bars")
def daily_bars(spark, sf_dir):
    return rounded(_bars(spark, sf_dir))


@query(
    f"""WITH {BARS}, a AS (SELECT *, {_full("avg", "close", 5)} AS sma_5, {_full("avg", "close", 20)} AS sma_20, {_full("stddev_samp", "close", 20)} AS s, {_full("min", "low", 14)} AS l14, {_full("max", "high", 14)} AS h14 FROM bars),
    k AS (SELECT *, 4 * s / sma_20 AS bollinger_width, 100 * (close - l14) / nullif(h14 - l14, 0) AS stoch_k FROM a)
    SELECT symbol, day::VARCHAR AS day, round(sma_5, 6) AS sma_5, round(sma_20, 6) AS sma_20, round(bollinger_width, 6) AS bollinger_width, round(stoch_k, 6) AS stoch_k, round({_full("avg", "stoch_k", 3)}, 6) AS stoch_d FROM k"""
)
def moving_indicators(spark, sf_dir):
    return rounded(bars.moving(_bars(spark, sf_dir)).select("symbol", "day", "sma_5", "sma_20", "bollinger_width", "stoch_k", "stoch_d"))


LAGGED = ", ".join(f"round(lag(change, {k}) OVER w, 6) AS change_lag_{k}, round(lag(volume_z, {k}) OVER w, 6) AS volume_z_lag_{k}" for k in range(1, 6))


@query(
    f"""WITH {BARS}, r AS (SELECT *, close - lag(close, 10) OVER w AS momentum_10, close / lag(close) OVER w - 1 AS change, ln(close / lag(close) OVER w) AS log_return FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    z AS (SELECT *, (volume - {_full("avg", "volume", 20)}) / ({_full("stddev_samp", "volume", 20)} + 1e-9) AS volume_z, {_full("stddev_samp", "change", 20)} AS volatility_20 FROM r)
    SELECT symbol, day::VARCHAR AS day, round(momentum_10, 6) AS momentum_10, round(change, 6) AS change, round(log_return, 6) AS log_return, round(volume_z, 6) AS volume_z, round(volatility_20, 6) AS volatility_20, {LAGGED}
    FROM z WINDOW w AS (PARTITION BY symbol ORDER BY day)"""
)
def return_features(spark, sf_dir):
    return rounded(bars.returns(_bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume"))


@query(
    f"""WITH {BARS}, s AS (SELECT *, CASE WHEN close < lag(close) OVER (PARTITION BY symbol ORDER BY day) THEN -volume ELSE volume END AS v FROM bars)
    SELECT symbol, day::VARCHAR AS day, (sum(v) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS obv FROM s"""
)
def on_balance_volume(spark, sf_dir):
    return rounded(bars.on_balance_volume(_bars(spark, sf_dir)).select("symbol", "day", "obv"))


def _recursive(columns: dict[str, tuple[str, str]], first: int = 1) -> str:
    """SQL: numbered(..., i) folded row by row; columns: name -> (first value, step from e.name)."""
    start = ", ".join(f"({a})::DOUBLE AS {n}" for n, (a, _) in columns.items())
    step = ", ".join(f"({b})::DOUBLE" for _, b in columns.values())
    return f"fold AS (SELECT n.symbol, n.day, n.i, {start} FROM numbered n WHERE n.i = {first} UNION ALL SELECT n.symbol, n.day, n.i, {step} FROM fold e JOIN numbered n ON n.symbol = e.symbol AND n.i = e.i + 1)"


@query(
    f"""WITH RECURSIVE {BARS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM bars),
    {_recursive({"a": ("n.close", "n.close * 2 / 13 + e.a * 11 / 13"), "b": ("n.close", "n.close * 2 / 27 + e.b * 25 / 27")})}
    SELECT symbol, day::VARCHAR AS day, round(CASE WHEN i >= 12 THEN a END, 6) AS ema_12, round(CASE WHEN i >= 26 THEN b END, 6) AS ema_26, round(CASE WHEN i >= 26 THEN a - b END, 6) AS macd FROM fold"""
)
def macd(spark, sf_dir):
    return rounded(bars.macd(_bars(spark, sf_dir)).select("symbol", "day", "ema_12", "ema_26", "macd"))


@query(
    f"""WITH RECURSIVE {BARS}, d AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) AS c FROM bars), numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM d),
    {_recursive({"u": ("greatest(n.c, 0)", "greatest(n.c, 0) / 14 + e.u * 13 / 14"), "w": ("greatest(-n.c, 0)", "greatest(-n.c, 0) / 14 + e.w * 13 / 14")})}
    SELECT symbol, day::VARCHAR AS day, round(CASE WHEN i < 14 THEN NULL WHEN w = 0 THEN 100 ELSE 100 - 100 / (1 + u / w) END, 6) AS rsi FROM fold"""
)
def relative_strength(spark, sf_dir):
    return rounded(bars.relative_strength(_bars(spark, sf_dir)).select("symbol", "day", "rsi"))


@query(
    f"""WITH RECURSIVE {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, avg(tr) OVER {_frame(14)} AS m FROM t), {_recursive({"atr": ("n.m", "(13 * e.atr + n.tr) / 14")}, 14)}
    SELECT n.symbol, n.day::VARCHAR AS day, round(coalesce(f.atr, 0), 6) AS atr FROM numbered n LEFT JOIN fold f ON n.symbol = f.symbol AND n.i = f.i"""
)
def true_range_mean(spark, sf_dir):
    return rounded(bars.true_range_mean(_bars(spark, sf_dir)).select("symbol", "day", "atr"))


@query(
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER w AS i, lead(close) OVER w / close - 1 AS next_return FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day))
    SELECT symbol, day::VARCHAR AS day, round(next_return, 6) AS next_return, CASE WHEN next_return > 0.005 THEN 'UP' WHEN next_return < -0.005 THEN 'DOWN' ELSE 'NEUTRAL' END AS label FROM n WHERE i > 26 AND next_return IS NOT NULL"""
)
def next_day_label(spark, sf_dir):
    return rounded(bars.next_day_label(_bars(spark, sf_dir)).select("symbol", "day", "next_return", "label"))


# ---------------------------------------------------------------- survey tables


@query(
    """SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, count(*) FILTER (c_custkey IS NULL) AS n_unmatched
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'N') GROUP BY ALL"""
)
def survey_join(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(5, 40) & F.col("l_returnflag").isin("A", "N")).select(F.col("l_orderkey").alias("order_id"), "l_quantity")
    persons = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"), "o_orderpriority")
    households = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_id"), "c_mktsegment", F.lit(1).alias("known"))
    df = survey.with_dimensions(facts, persons, households, ["order_id"], ["cust_id"])
    return rounded(df.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity"), F.count_if(F.col("known").isNull()).alias("n_unmatched")))


@query(
    """SELECT o_orderkey, 'finished' AS edition, o_totalprice, NULL AS o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL BY NAME
    SELECT o_orderkey, 'open' AS edition, NULL AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'"""
)
def union_editions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    done = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("finished").alias("edition"), "o_totalprice")
    rest = orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.lit("open").alias("edition"), "o_orderpriority")
    return survey.all_editions([done, rest])


@query(
    """SELECT p_partkey, CASE WHEN p_size IN (1, 7, 8, 9) THEN NULL ELSE p_size END AS size, CASE WHEN p_size > 0 AND p_size <= 17 THEN 'small' WHEN p_size > 17 AND p_size <= 34 THEN 'medium' WHEN p_size > 34 AND p_size <= 54 THEN 'large' END AS size_bucket,
    round(least(greatest(p_retailprice, 950.0), 1500.0), 4) AS price, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END AS brand_code, (p_size = 10)::INT AS is_ten, round(CASE WHEN p_size > 20 THEN p_retailprice / p_size ELSE 0 END, 6) AS price_per_size FROM part"""
)
def code_buckets(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    df = table(spark, sf_dir, "part").select(
        "p_partkey",
        clean.unmasked(size, (1, 7, 8, 9)).alias("size"),
        clean.bucket(size, (17, 34, 54), ("small", "medium", "large"), 0).alias("size_bucket"),
        F.round(clean.clipped(price, 950.0, 1500.0), 4).alias("price"),
        clean.mapped(F.col("p_brand"), {"Brand#11": 1, "Brand#12": 2}, F.lit(0)).alias("brand_code"),
        clean.flag(size, 10).alias("is_ten"),
        F.when(size > 20, clean.ratio(price, size)).otherwise(0.0).alias("price_per_size"),
    )
    return rounded(df)


@query(
    """WITH j AS (SELECT d.doc_id, d.n_chars, l.quality, CASE WHEN d.n_chars % 3 = 0 THEN NULL ELSE d.n_chars END AS length FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    m AS (SELECT median(length) AS length FROM j), q AS (SELECT quality FROM j WHERE quality IS NOT NULL GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)
    SELECT j.doc_id, coalesce(j.quality, q.quality) AS quality, coalesce(j.length, m.length::BIGINT)::BIGINT AS length FROM j, m, q"""
)
def impute(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id", "left").select("doc_id", "quality", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars").cast("double")).alias("length"))
    out = survey.imputed(df, ["length"], ["quality"])
    return out.withColumn("length", F.rint("length").cast("long"))


@query(
    """WITH o AS (SELECT o_orderkey, year(o_orderdate) AS edition, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS n, min(year(o_orderdate)) OVER () AS first FROM orders)
    SELECT o_orderkey, edition::INT AS edition, (n = 1 AND edition > first)::INT AS starts_edition FROM o"""
)
def edition_starts(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("edition"))
    return survey.edition_starts(df, "edition", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "edition", "starts_edition")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS deviation FROM lineitem"
        for c in FEATURES
    )
)
def profile(spark, sf_dir):
    return rounded(survey.profile(table(spark, sf_dir, "lineitem"), FEATURES), 9)


@query("SELECT l_returnflag AS class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY l_returnflag")
def class_distribution(spark, sf_dir):
    return rounded(arff.profile(table(spark, sf_dir, "lineitem"), "l_returnflag"))


# ---------------------------------------------------------------- discretisation and ranking

LONG = "long AS (SELECT l_returnflag AS cls, l_shipdate, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax])::DOUBLE AS value FROM lineitem)"
RANGES = "r0 AS (SELECT feature, min(value) AS a, max(value) AS b FROM long GROUP BY ALL), r AS (SELECT feature, CASE WHEN a = b THEN a ELSE a - 0.05 * (b - a) END AS low, CASE WHEN a = b THEN a + 1 ELSE b + 0.05 * (b - a) END AS high FROM r0)"
#: Ranges of a stream's first rows, and of its first year.
FIRST_ROWS, FIRST_YEAR = (RANGES.replace("FROM long", f"FROM long WHERE {w}") for w in ("i <= 200", "year(l_shipdate) = (SELECT min(year(l_shipdate)) FROM lineitem)"))
COUNTS = "c AS (SELECT feature, greatest(least(floor((value - low) / ((high - low) / 20))::INT, 19), 0) AS bin, cls, count(*) AS n FROM long JOIN r USING (feature) GROUP BY ALL)"
CELLS = "x AS (SELECT feature, n::DOUBLE AS o, (sum(n) OVER (PARTITION BY feature, bin))::DOUBLE * (sum(n) OVER (PARTITION BY feature, cls))::DOUBLE / (sum(n) OVER (PARTITION BY feature))::DOUBLE AS e, (sum(n) OVER (PARTITION BY feature))::DOUBLE AS t FROM c)"
SCORES = "s AS (SELECT feature, greatest(sum(o * ln(o / e)) / max(t), 0) AS mutual_info, greatest(sum(o * o / e) - max(t), 0) AS chi2 FROM x GROUP BY feature)"


def _long(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return ranking.long_form(table(spark, sf_dir, "lineitem"), FEATURES, "l_returnflag", *keep)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = _long(spark, sf_dir)
    return ranking.histogram(instances, ranking.ranges(instances), 20)


@query(f"WITH {LONG}, {RANGES}, {COUNTS} SELECT feature, bin, cls, n FROM c")
def layer1_histogram(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {LONG}, {RANGES}, {COUNTS} SELECT feature, least(bin * 6 // 20, 5)::INT AS bin, cls, sum(n)::BIGINT AS n FROM c GROUP BY ALL")
def uniform_layer2(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return counts.groupBy("feature", ranking.uniform_groups(F.col("bin"), 20, 6).alias("bin"), "cls").agg(F.sum("n").alias("n"))


MERGE_COST = f"""round(0.5 * ({" + ".join(f"abs((v[{c}] + 1) / (list_sum(v) + 3) - (nv[{c}] + 1) / (list_sum(nv) + 3))" for c in (1, 2, 3))}) * (least(list_sum(v), list_sum(nv)) + 1), 9)"""


@query(
    f"""WITH RECURSIVE {LONG}, {RANGES}, {COUNTS}, z AS (SELECT f.feature, b.bin, [{", ".join(f"coalesce(sum(c.n) FILTER (c.cls = '{x}'), 0)::DOUBLE" for x in "ANR")}] AS v
      FROM (SELECT DISTINCT feature FROM c) f CROSS JOIN range(20) b(bin) LEFT JOIN c ON c.feature = f.feature AND c.bin = b.bin GROUP BY f.feature, b.bin),
    g AS (SELECT feature, 0 AS step, bin, v FROM z UNION ALL
      SELECT feature, step + 1, bin, CASE WHEN r = 1 THEN [v[1] + nv[1], v[2] + nv[2], v[3] + nv[3]] ELSE v END FROM (SELECT *, lag(r) OVER (PARTITION BY feature ORDER BY bin) AS pr FROM (
        SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cost NULLS LAST, bin) AS r FROM (SELECT *, {MERGE_COST} AS cost FROM (SELECT *, lead(v) OVER (PARTITION BY feature ORDER BY bin) AS nv FROM g WHERE step < 14)))) WHERE coalesce(pr, 0) <> 1),
    o AS (SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY bin) - 1)::INT AS bin, v FROM g WHERE step = 14), u AS (SELECT feature, bin, unnest(['A', 'N', 'R']) AS cls, unnest(v)::BIGINT AS n FROM o)
    SELECT feature, bin, cls, n FROM u WHERE n > 0"""
)
def merged_layer2(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return ranking.regrouped(counts, ranking.merged_bins(counts, 20, 6))


@query(f"WITH {LONG}, {RANGES}, {COUNTS}, {CELLS}, {SCORES} SELECT feature, round(mutual_info / ln(2), 9) AS info_gain, round(mutual_info, 9) AS mutual_info, round(chi2, 4) AS chi2 FROM s")
def feature_scores(spark, sf_dir):
    return rounded(ranking.scores(_counts(spark, sf_dir)), 9).withColumn("chi2", F.round("chi2", 4))


@query(f"WITH {LONG}, {RANGES}, {COUNTS}, {CELLS}, {SCORES}, k AS (SELECT feature, row_number() OVER (ORDER BY round(chi2, 9) DESC, feature) AS rank FROM s) SELECT feature, rank::INT AS rank FROM k WHERE rank <= 2")
def top_features(spark, sf_dir):
    return ranking.top(ranking.scores(_counts(spark, sf_dir)), "chi2", ranking.default_k(len(FEATURES))).select("feature", "rank")


PERIODS = """c AS (SELECT year(l_shipdate)::INT AS period, feature, greatest(least(floor((value - low) / ((high - low) / 20))::INT, 19), 0) AS bin, cls, count(*) AS n FROM long JOIN r USING (feature) GROUP BY ALL),
x AS (SELECT period, feature, n::DOUBLE AS o, (sum(n) OVER (PARTITION BY period, feature, bin))::DOUBLE * (sum(n) OVER (PARTITION BY period, feature, cls))::DOUBLE / (sum(n) OVER (PARTITION BY period, feature))::DOUBLE AS e, (sum(n) OVER (PARTITION BY period, feature))::DOUBLE AS t FROM c),
s AS (SELECT period, feature, greatest(sum(o * o / e) - max(t), 0) AS chi2 FROM x GROUP BY ALL), k AS (SELECT period, feature, row_number() OVER (PARTITION BY period ORDER BY round(chi2, 9) DESC, feature) AS rank FROM s),
g AS (SELECT period, list_sort(list(feature)) AS selected FROM k WHERE rank <= 2 GROUP BY period), h AS (SELECT *, lag(selected) OVER (ORDER BY period) AS before FROM g)"""


def _yearly(instances: DataFrame) -> DataFrame:
    """Counts by year, binned over the first."""
    instances = instances.withColumn("period", F.year("l_shipdate"))
    first = instances.agg(F.min("period").alias("_first"))  # one row
    warm_up = instances.join(F.broadcast(first)).where(F.col("period") == F.col("_first"))
    return ranking.histogram(instances, ranking.ranges(warm_up), 20, "period")


@query(f"WITH {LONG}, {FIRST_YEAR}, {PERIODS} SELECT period, array_to_string(selected, ',') AS selected, len(list_intersect(before, selected)) / len(before) AS stability FROM h")
def periodic_selection(spark, sf_dir):
    instances = _long(spark, sf_dir, "l_shipdate")
    counts = _yearly(instances)
    chosen = ranking.top(ranking.scores(counts, "period"), "chi2", 2, "period")
    return ranking.selections(chosen, "period").withColumn("selected", F.array_join("selected", ","))


KS = """h AS (SELECT min(l_shipdate) + (max(l_shipdate) - min(l_shipdate)) / 2 AS cut FROM lineitem), p AS (SELECT feature, value, count(*) FILTER (l_shipdate < cut) AS a, count(*) FILTER (l_shipdate >= cut) AS b FROM long, h GROUP BY ALL),
st AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS n0, sum(b) OVER (PARTITION BY feature) AS n1 FROM p WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT feature, max(n0)::BIGINT AS n0, max(n1)::BIGINT AS n1, max(abs(ca / n0 - cb / n1)) AS ks FROM st GROUP BY feature)"""


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = _long(spark, sf_dir, "l_shipdate")
    ends = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    cut = ends.select((F.col("a") + (F.col("b") - F.col("a")) / 2).alias("cut"))
    return instances.crossJoin(F.broadcast(cut)).select("feature", "value", (F.col("l_shipdate") >= F.col("cut")).cast("int").alias("side"))  # one row


@query(f"WITH {LONG}, {KS} SELECT feature, n0, n1, round(ks, 9) AS ks FROM ks")
def feature_drift(spark, sf_dir):
    return rounded(drift.long_distance(_halves(spark, sf_dir), "feature"), 9)


@query(
    f"""WITH {LONG}, {RANGES}, {COUNTS}, {CELLS}, {SCORES}, {KS}, i AS (SELECT s.feature, mutual_info, 1 / (ks + 1e-6) AS stable FROM s JOIN ks USING (feature)),
    w AS (SELECT feature, 0.7 * mutual_info / max(mutual_info) OVER () + 0.3 * stable / max(stable) OVER () AS raw FROM i) SELECT feature, round(raw / sum(raw) OVER (), 6) AS importance FROM w"""
)
def feature_importance(spark, sf_dir):
    return rounded(ranking.importance(ranking.scores(_counts(spark, sf_dir)), drift.long_distance(_halves(spark, sf_dir), "feature").select("feature", "ks")))


@query("SELECT p_partkey FROM (SELECT p_partkey, ln(((p_partkey * 7919 + 104729) % 1000003 + 1) / 1000004.0) / p_size AS k FROM part WHERE p_size > 0 ORDER BY k DESC, p_partkey LIMIT 100)")
def weighted_sample(spark, sf_dir):
    u = ((F.col("p_partkey") * 7919 + 104729) % 1000003 + 1) / 1000004.0
    return ranking.weighted_sample(table(spark, sf_dir, "part"), "p_size", u, 100, "p_partkey").select("p_partkey")


# ---------------------------------------------------------------- prequential metrics and drift

STREAM = f"labels_ AS (SELECT user_id AS run, event_id AS seq, list_position({TYPES}, event_type) - 1 AS y FROM events)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), y.cast("int").alias("y"))


@query(f"WITH {STREAM} SELECT run, seq, y::INT AS y, coalesce(lag(y) OVER (PARTITION BY run ORDER BY seq), 0)::INT AS p FROM labels_")
def no_change_predictions(spark, sf_dir):
    return prequential.no_change(_labels(spark, sf_dir))


def _majority_sql() -> str:
    seen = ", ".join(f"count(*) FILTER (y = {c}) OVER w AS c{c}" for c in range(5))
    top = "greatest(c0, c1, c2, c3, c4)"
    return f"WITH {STREAM}, m AS (SELECT *, {seen} FROM labels_ WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT run, seq, y::INT AS y, (CASE {' '.join(f'WHEN c{c} = {top} THEN {c}' for c in range(5))} END)::INT AS p FROM m"


@query(_majority_sql())
def majority_predictions(spark, sf_dir):
    return prequential.majority(_labels(spark, sf_dir), 5)


def _metrics_sql() -> str:
    def counts(w: str) -> str:
        each = ", ".join(f"count(*) FILTER (y = {c}) OVER {w} AS {w}y{c}, count(*) FILTER (p = {c}) OVER {w} AS {w}p{c}" for c in range(5))
        return f"count(*) OVER {w} AS {w}n, sum((y = p)::INT) OVER {w} AS {w}h, sum((coalesce(b, y) = y)::INT) OVER {w} AS {w}s, sum(coalesce((b = y)::INT, 0)) OVER {w} AS {w}l, {each}"

    def chance(w: str) -> str:
        return "(" + " + ".join(f"{w}y{c} * {w}p{c}" for c in range(5)) + f")::DOUBLE / ({w}n * {w}n)"

    def kappa(agree: str, pe: str) -> str:
        return f"round(CASE WHEN abs(1 - {pe}) < 1e-12 THEN 0 ELSE ({agree} - {pe}) / (1 - {pe}) END, 6)"

    t, r = "(an::DOUBLE)", "(rn::DOUBLE)"
    return f"""WITH {STREAM}, q AS (SELECT *, lag(y) OVER (PARTITION BY run ORDER BY seq) AS b, coalesce(lag(y) OVER (PARTITION BY run ORDER BY seq), 0) AS p FROM labels_),
    m AS (SELECT run, seq, {counts("a")}, {counts("r")} FROM q WINDOW a AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY run ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT run, seq, round(ah / {t}, 6) AS accuracy, {kappa(f"(ah / {t})", f"({chance('a')})")} AS kappa, {kappa(f"(ah / {t})", f"(CASE WHEN an > 1 THEN al / ({t} - 1) ELSE 0 END)")} AS kappa_temporal,
    round(rh / {r}, 6) AS accuracy_recent, {kappa(f"(rh / {r})", f"({chance('r')})")} AS kappa_recent, {kappa(f"(rh / {r})", f"(rs / {r})")} AS kappa_temporal_recent FROM m"""


@query(_metrics_sql())
def prequential_metrics(spark, sf_dir):
    df = prequential.metrics(prequential.no_change(_labels(spark, sf_dir)), 5, 50)
    return rounded(df).withColumns({c: F.col(c) + 0.0 for c in ("kappa", "kappa_temporal", "kappa_recent", "kappa_temporal_recent")})


@query(
    f"""WITH {STREAM}, q AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY run ORDER BY seq), 0) AS p, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM labels_),
    a AS (SELECT *, avg((y = p)::INT) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m, sum((seq % 40 = 0)::INT) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM q),
    f AS (SELECT *, first(m) OVER w AS m0, first(i) OVER w AS i0, first(seq) OVER w AS seq0 FROM a WHERE session > 0 WINDOW w AS (PARTITION BY run, session ORDER BY seq))
    SELECT run, seq0 AS alarm_seq, (min(CASE WHEN i > i0 AND m >= m0 - 0.01 THEN i - i0 END))::INT AS recovered_after FROM f GROUP BY run, seq0"""
)
def recovery_times(spark, sf_dir):
    rows = prequential.metrics(prequential.no_change(_labels(spark, sf_dir)), 5, 50)
    return prequential.recovery(rows, F.col("seq") % 40 == 0)


@query(
    """WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    w AS (SELECT user_id, value, i > 25 AS side FROM n WHERE n >= 50 AND (i <= 25 OR i > n - 25)), p AS (SELECT user_id, value, count(*) FILTER (NOT side) AS a, count(*) FILTER (side) AS b FROM w GROUP BY ALL),
    st AS (SELECT user_id, sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER (PARTITION BY user_id) AS n0, sum(b) OVER (PARTITION BY user_id) AS n1 FROM p WINDOW u AS (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT user_id, max(n0)::DOUBLE AS n0, max(n1)::DOUBLE AS n1, max(abs(ca / n0 - cb / n1)) AS ks FROM st GROUP BY user_id),
    t AS (SELECT user_id, ks, CASE WHEN ks = 0 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * ks * ks * (n0 * n1 / (n0 + n1))))), 0.0), 1.0) END AS p FROM d),
    o AS (SELECT *, row_number() OVER (ORDER BY p, user_id) AS r, count(*) OVER () AS m FROM t) SELECT user_id, round(ks, 6) AS ks, round(p, 6) AS p, r <= coalesce(max(CASE WHEN p <= r * 0.2 / m THEN r END) OVER (), 0) AS drift FROM o"""
)
def window_drift(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    d = drift.distance(drift.windows(events, "user_id", "event_id", "value", 25), "user_id")
    tests = d.select("user_id", "ks", drift.p_value(F.col("ks"), F.col("n0").cast("double"), F.col("n1").cast("double")).alias("p"))
    return rounded(drift.discoveries(tests, "p", 0.2))


CLASSES = {"A": 0, "N": 1, "R": 2}


def _bayes_sql(restart: int = 0) -> str:
    """A run is learned afresh at every `restart`-th row, if any."""
    state, scores = [], []
    for c in range(3):
        state.append(f"count(*) FILTER (y = {c}) OVER w AS n{c}")
        score = f"ln(n{c} + 1.0)"
        for f in ("quantity", "discount"):
            state.append(f"sum({f}) FILTER (y = {c}) OVER w AS s{c}{f}, sum({f} * {f}) FILTER (y = {c}) OVER w AS q{c}{f}")
            mean = f"(CASE WHEN n{c} > 0 THEN s{c}{f} / n{c} ELSE 0 END)"
            variance = f"(CASE WHEN n{c} > 0 THEN greatest(q{c}{f} / n{c} - {mean} * {mean}, 0) + 0.001 ELSE 1 END)"
            score += f" - 0.5 * ln({variance}) - ({f} - {mean}) * ({f} - {mean}) / (2 * {variance})"
        scores.append(f"round({score}, 9) AS l{c}")
    session = f"row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag) // {restart}" if restart else "0"
    return f"""WITH t AS (SELECT l_suppkey AS run, {session} AS session, l_orderkey * 10 + l_linenumber AS seq, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS y, l_quantity AS quantity, l_discount AS discount FROM lineitem),
    st AS (SELECT *, {", ".join(state)} FROM t WINDOW w AS (PARTITION BY run, session ORDER BY seq, quantity, discount, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), sc AS (SELECT *, {", ".join(scores)} FROM st)
    SELECT run, count(*) AS n, sum((y = CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END)::INT)::BIGINT AS hits FROM sc GROUP BY run"""


@query(_bayes_sql())
def naive_bayes_hits(spark, sf_dir):
    y = clean.mapped(F.col("l_returnflag"), CLASSES).cast("int")
    stream = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"), y.alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    stream = stream.withColumn("seq", F.struct("number", "quantity", "discount", "y"))  # a total order
    p = learners.naive_bayes(stream, ["quantity", "discount"], 3)
    return p.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("y")).alias("hits"))


ALARMED = """num AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i, l_returnflag AS cls, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
long AS (SELECT run, i, cls, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax])::DOUBLE AS value FROM num),
al AS (SELECT run, i AS "at" FROM num WHERE i % 200 = 0),
near AS (SELECT l.*, a."at", (l.i >= a."at")::INT AS side FROM long l JOIN al a ON l.run = a.run AND l.i >= a."at" - 80 AND l.i < a."at" + 80)"""


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = keyed(table(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("l_suppkey").alias("run"), F.row_number().over(w).alias("i"), F.col("l_returnflag").alias("cls"), *FEATURES)
    return rows, rows.where("i % 200 = 0").select("run", F.col("i").alias("at"))


@query(
    f"""WITH {ALARMED}, p AS (SELECT run, "at", feature, value, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM near GROUP BY ALL),
    st AS (SELECT run, "at", feature, sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER (PARTITION BY run, "at", feature) AS n0, sum(b) OVER (PARTITION BY run, "at", feature) AS n1 FROM p WINDOW u AS (PARTITION BY run, "at", feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT run, "at", feature, max(abs(ca / n0 - cb / n1)) AS ks FROM st GROUP BY ALL) SELECT run, "at"::INT AS "at", feature, round(ks, 9) AS ks FROM d"""
)
def alarm_drift(spark, sf_dir):
    return rounded(adaptive.drifting_features(*_numbered(spark, sf_dir), 80, features=FEATURES).select("run", "at", "feature", "ks"), 9)


@query(
    f"""WITH {ALARMED}, {FIRST_ROWS}, c AS (SELECT run, "at", feature, greatest(least(floor((value - low) / ((high - low) / 20))::INT, 19), 0) AS bin, cls, count(*) AS n FROM near JOIN r USING (feature) WHERE side = 1 GROUP BY ALL),
    x AS (SELECT run, "at", feature, n::DOUBLE AS o, (sum(n) OVER (PARTITION BY run, "at", feature, bin))::DOUBLE * (sum(n) OVER (PARTITION BY run, "at", feature, cls))::DOUBLE / (sum(n) OVER (PARTITION BY run, "at", feature))::DOUBLE AS e, (sum(n) OVER (PARTITION BY run, "at", feature))::DOUBLE AS t FROM c),
    s AS (SELECT run, "at", feature, greatest(sum(o * o / e) - max(t), 0) AS chi2 FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run, "at" ORDER BY round(chi2, 9) DESC, feature) AS rank FROM s)
    SELECT run, "at"::INT AS "at", feature, rank::INT AS rank FROM k WHERE rank <= 2"""
)
def alarm_selection(spark, sf_dir):
    return adaptive.selection_after_alarms(*_numbered(spark, sf_dir), 80, 2, features=FEATURES)


@query(
    f"""WITH {STREAM}, q AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY run ORDER BY seq), 0) AS p FROM labels_) SELECT run, count(*)::INT AS n, round(avg((y = p)::INT), 6) AS accuracy FROM q GROUP BY run"""
)
def run_snapshot(spark, sf_dir):
    return rounded(prequential.snapshot(prequential.no_change(_labels(spark, sf_dir)), 5).select("run", "n", "accuracy"))


SPLITS = """c AS (SELECT feature, greatest(least(floor((value - low) / ((high - low) / 20))::INT, 19), 0) AS bin, count(*) FILTER (cls = 'A')::DOUBLE AS a, count(*) FILTER (cls = 'N')::DOUBLE AS n, count(*) FILTER (cls = 'R')::DOUBLE AS r FROM long JOIN r USING (feature) GROUP BY ALL),
    u AS (SELECT feature, bin, sum(a) OVER w AS a, sum(n) OVER w AS n, sum(r) OVER w AS r, sum(a) OVER p AS ta, sum(n) OVER p AS tn, sum(r) OVER p AS tr FROM c WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature))"""


def _spread_sql(*cells: str) -> str:
    logs = [f"(CASE WHEN {x} > 0 THEN ({x}) * log2({x}) ELSE 0 END)" for x in (" + ".join(cells), *cells)]
    return f"({logs[0]} - {' - '.join(logs[1:])})"


@query(
    f"""WITH {LONG}, {RANGES}, {SPLITS}, g AS (SELECT feature, bin, round(greatest(({_spread_sql("ta", "tn", "tr")} - {_spread_sql("a", "n", "r")} - {_spread_sql("(ta - a)", "(tn - n)", "(tr - r)")}) / (ta + tn + tr), 0), 9) AS gain FROM u),
    k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, bin) AS i FROM g) SELECT feature, bin::INT AS cut, gain FROM k WHERE i = 1"""
)
def best_splits(spark, sf_dir):
    counts = _counts(spark, sf_dir).groupBy("feature", "bin").agg(*[F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"c{i}") for c, i in CLASSES.items()])
    return trees.split_gains(counts, 3).select("feature", "cut", "gain")


@query(
    f"""WITH RECURSIVE {LONG}, {FIRST_YEAR}, {PERIODS}, sc AS MATERIALIZED (SELECT period, feature, round(chi2, 9) AS v, dense_rank() OVER (ORDER BY period) AS t FROM s),
    ev AS (SELECT 1::BIGINT AS t, list(feature) AS sel, 0::BIGINT AS n FROM (SELECT feature FROM sc WHERE t = 1 ORDER BY v DESC, feature LIMIT 2) UNION ALL
      SELECT t, CASE WHEN -best.v > worst.v THEN list_append(list_filter(sel, lambda f: f <> worst.f), best.f) ELSE sel END, CASE WHEN -best.v > worst.v THEN 1 ELSE 0 END FROM (
        SELECT ev.t + 1 AS t, ev.sel, min({{'v': sc.v, 'f': sc.feature}}) FILTER (list_contains(ev.sel, sc.feature)) AS worst, min({{'v': -sc.v, 'f': sc.feature}}) FILTER (NOT list_contains(ev.sel, sc.feature)) AS best
        FROM ev JOIN sc ON sc.t = ev.t + 1 GROUP BY ev.t, ev.sel))
    SELECT 0 AS run, period, array_to_string(list_sort(sel), ',') AS selected, n AS n_swapped FROM ev JOIN (SELECT DISTINCT t, period FROM sc) USING (t)"""
)
def evolving_selection(spark, sf_dir):
    """Two of four features by year, with limited swaps."""
    instances = _long(spark, sf_dir, "l_shipdate")
    counts = _yearly(instances)
    scored = ranking.scores(counts, "period").withColumn("run", F.lit(0)).withColumn("chi2", F.round("chi2", 9))
    return adaptive.evolving_selection(scored, 2).withColumn("selected", F.array_join("selected", ","))


@query(
    """SELECT event_type, date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS n_events, round(sum(value), 4) AS total FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL"""
)
def live_hourly(spark, sf_dir):
    return rounded(live.finished(live.hourly(live.table(spark, sf_dir, "events"), "event_type"), "append"), 4)


# ---------------------------------------------------------------- significance

SCORED = "sc AS (SELECT user_id AS dataset, event_type AS method, (sum(round(value * 100)::BIGINT) // count(*))::BIGINT / 100.0 AS score FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5) GROUP BY ALL)"
RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2 AS rank FROM sc)"
MEANS = "mr AS (SELECT method, avg(rank) AS mean_rank, count(*)::DOUBLE AS n, (count(*) OVER ())::DOUBLE AS k FROM rk GROUP BY method)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    full = events.groupBy("user_id").agg(F.count_distinct("event_type").alias("k")).where("k = 5").select("user_id")
    return events.join(full, "user_id", "left_semi").groupBy(F.col("user_id").alias("dataset"), F.col("event_type").alias("method")).agg((F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count(F.lit(1))) / 100.0).alias("score"))


@query(f"WITH {SCORED}, {RANKED} SELECT dataset, method, score, rank FROM rk")
def method_ranks(spark, sf_dir):
    return significance.ranked(_scored(spark, sf_dir))


@query(f"WITH {SCORED}, {RANKED}, {MEANS}, f AS (SELECT max(n) AS n, max(k) AS k, 12 * max(n) / (max(k) * (max(k) + 1)) * sum(mean_rank * mean_rank) - 3 * max(n) * (max(k) + 1) AS chi2 FROM mr) SELECT n, k, round(chi2, 6) AS chi2, round((n - 1) * chi2 / (n * (k - 1) - chi2), 6) AS f_stat FROM f")
def friedman_test(spark, sf_dir):
    return rounded(significance.friedman(significance.ranked(_scored(spark, sf_dir))))


@query(f"WITH {SCORED}, {RANKED}, {MEANS} SELECT a.method AS a, b.method AS b, round(abs(a.mean_rank - b.mean_rank), 6) AS difference, round(2.728 * sqrt(5 * 6 / (6 * a.n)), 6) AS cd, abs(a.mean_rank - b.mean_rank) > 2.728 * sqrt(5 * 6 / (6 * a.n)) AS significant FROM mr a JOIN mr b ON a.method < b.method")
def nemenyi_pairs(spark, sf_dir):
    return rounded(significance.nemenyi(significance.ranked(_scored(spark, sf_dir))))


SIGNED = """pr AS (SELECT dataset, max(score) FILTER (method = 'click') - max(score) FILTER (method = 'view') AS d FROM sc GROUP BY dataset), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM pr),
    s AS (SELECT count(*) AS n, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r)"""
SIGNED_Z = "(greatest(w_plus, w_minus) - n * (n + 1) / 4 - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24)"


@query(f"WITH {SCORED}, {SIGNED} SELECT *, round({SIGNED_Z}, 6) AS z FROM s")
def wilcoxon_pair(spark, sf_dir):
    return rounded(significance.wilcoxon(_scored(spark, sf_dir), "click", "view"))


@query(
    f"""WITH {SCORED}, {RANKED}, {MEANS}, f AS (SELECT max(n) AS n, max(k) AS k, 12 * max(n) / (max(k) * (max(k) + 1)) * sum(mean_rank * mean_rank) - 3 * max(n) * (max(k) + 1) AS chi2 FROM mr),
    g AS (SELECT *, (n - 1) * chi2 / (n * (k - 1) - chi2) AS f_stat, 4 * (n - 1) AS d2 FROM f), p AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2) AS p_chi2, pow(d2 / (d2 + 4 * f_stat), d2 / 2) * (1 + d2 / 2 * (1 - d2 / (d2 + 4 * f_stat))) AS p_f FROM g)
    SELECT n, k, round(chi2, 6) AS chi2, round(f_stat, 6) AS f_stat, round(p_chi2, 6) AS p_chi2, round(p_f, 6) AS p_f, round(p_f, 6) AS p, p_f < 0.05 AS reject FROM p"""  # the tails' finite sums for five methods
)
def friedman_significance(spark, sf_dir):
    return rounded(significance.friedman_p(significance.friedman(significance.ranked(_scored(spark, sf_dir)))))


@query(
    f"""WITH RECURSIVE {SCORED}, {SIGNED}, sz AS (SELECT *, {SIGNED_Z} AS z FROM s),
    ways AS (SELECT 0 AS rank, [1]::DOUBLE[] AS c UNION ALL SELECT rank + 1, list_transform(range(0, len(c) + rank + 1), lambda j: coalesce(c[j + 1], 0) + CASE WHEN j > rank THEN coalesce(c[j - rank], 0) ELSE 0 END) FROM ways WHERE rank < 30),
    p AS (SELECT sz.*, CASE WHEN n <= 30 THEN least(2 * coalesce(list_sum(c[ceil(greatest(w_plus, w_minus))::INT + 1:]), 0) / pow(2, n), 1) WHEN z > 6 THEN 0
      ELSE least(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda j: (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * pow(z / sqrt(2), 2 * j + 1) / (exp(lgamma(j + 1)) * (2 * j + 1)))), 1) END AS p FROM sz LEFT JOIN ways ON rank = n)
    SELECT * REPLACE (round(z, 6) AS z, round(p, 6) AS p), p < 0.05 AS reject FROM p"""
)
def wilcoxon_significance(spark, sf_dir):
    return rounded(significance.wilcoxon_p(significance.wilcoxon(_scored(spark, sf_dir), "click", "view")))


from . import detections, experiments, growth, workflows  # noqa: E402, F401  register their queries; they need the names above
