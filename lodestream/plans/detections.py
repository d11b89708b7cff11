"""Queries of detectors and restarted learning over whole tables; their SQL folds each run's rows by recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import adaptive, drift, learners
from ..sources.tables import table
from ..session import keyed, shared_folder, tasks_of
from ..streaming import live, measured
from .catalogue import CLASSES, FEATURES, FIRST_ROWS, TYPES, _bayes_sql, _numbered, query, rounded
from .workflows import DRIFTS, SIZE, _surgery, _surgery_sql

ALPHA = 0.2
NUMBERED = "num AS MATERIALIZED (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i, l_returnflag AS cls, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
ERRORS = f"{NUMBERED}, er AS MATERIALIZED (SELECT run, i, CASE WHEN lag(cls) OVER (PARTITION BY run ORDER BY i) = cls THEN 0 ELSE 1 END::DOUBLE AS x FROM num)"
HOEFFDING = f"""{ERRORS}, st AS (
    SELECT DISTINCT run, 0::BIGINT AS i, 0 AS n, 0::DOUBLE AS s, 0 AS nm, 0::DOUBLE AS sm, false AS alarm FROM er
    UNION ALL
    SELECT run, i, CASE WHEN alarm THEN 0 ELSE n END, CASE WHEN alarm THEN 0 ELSE s END, CASE WHEN alarm THEN 0 ELSE nm END, CASE WHEN alarm THEN 0 ELSE sm END, alarm FROM (
      SELECT *, n > nm AND s / n - sm / nm >= sqrt((n - nm) / (n * nm)::DOUBLE / 2 * ln(2 / {ALPHA})) AS alarm FROM (
        SELECT run, i, n, s, CASE WHEN better THEN n ELSE nm END AS nm, CASE WHEN better THEN s ELSE sm END AS sm FROM (
          SELECT *, nm = 0 OR s / n + sqrt(ln(1 / {ALPHA}) / (2 * n)) <= sm / nm + sqrt(ln(1 / {ALPHA}) / (2 * nm)) AS better FROM (
            SELECT er.run, er.i, st.n + 1 AS n, st.s + er.x AS s, st.nm, st.sm FROM st JOIN er ON er.run = st.run AND er.i = st.i + 1)))))"""


def _errors(spark, sf_dir):
    """Errors of predicting each supplier's return flag by the one before; the first row counts as one."""
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    wrong = F.coalesce((F.lag("l_returnflag").over(by) != F.col("l_returnflag")).cast("double"), F.lit(1.0))
    return keyed(table(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("l_suppkey").alias("run"), F.row_number().over(by).alias("i"), wrong.alias("error"))


def _alarms(spark, sf_dir):
    return drift.alarms(_errors(spark, sf_dir), "run", "i", "error", lambda: drift.HoeffdingMean(ALPHA))


@query(f"WITH RECURSIVE {HOEFFDING} SELECT run, i FROM st WHERE alarm")
def hoeffding_alarms(spark, sf_dir):
    return _alarms(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {HOEFFDING}, long AS (SELECT run, i, cls, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax])::DOUBLE AS value FROM num),
    near AS (SELECT l.*, a.i AS "at" FROM long l JOIN st a ON a.alarm AND l.run = a.run AND l.i >= a.i AND l.i < a.i + 80),
    last AS (SELECT * FROM near WHERE "at" = (SELECT max(a.i) FROM st a WHERE a.alarm AND a.run = near.run AND a.i <= near.i)), {FIRST_ROWS},
    c AS (SELECT run, "at", feature, greatest(least(floor((value - low) / ((high - low) / 20))::INT, 19), 0) AS bin, cls, count(*) AS n FROM last JOIN r USING (feature) GROUP BY ALL),
    x AS (SELECT run, "at", feature, n::DOUBLE AS o, (sum(n) OVER (PARTITION BY run, "at", feature, bin))::DOUBLE * (sum(n) OVER (PARTITION BY run, "at", feature, cls))::DOUBLE / (sum(n) OVER (PARTITION BY run, "at", feature))::DOUBLE AS e, (sum(n) OVER (PARTITION BY run, "at", feature))::DOUBLE AS t FROM c),
    s AS (SELECT run, "at", feature, greatest(sum(o * o / e) - max(t), 0) AS chi2 FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run, "at" ORDER BY round(chi2, 9) DESC, feature) AS rank FROM s)
    SELECT run, "at"::INT AS "at", feature, rank::INT AS rank FROM k WHERE rank <= 2"""
)
def detected_selection(spark, sf_dir):
    """The two best features on the 80 rows from each alarm of the error detector on; a later alarm ends an earlier one's rows."""
    found = _alarms(spark, sf_dir).withColumnRenamed("i", "at")
    return adaptive.selection_after_alarms(_numbered(spark, sf_dir)[0], found, 80, 2, features=FEATURES, tasks=tasks_of(table(spark, sf_dir, "lineitem")))


@query(
    f"""WITH RECURSIVE {HOEFFDING}, fires AS (SELECT DISTINCT run, (i - 1) // {SIZE} AS block FROM st WHERE alarm), {DRIFTS.replace("st AS", "steps AS").replace("FROM st ", "FROM steps ")},
    {_surgery_sql("(run, block) IN (FROM fires)")} SELECT run, block, learner, round(overlap, 6) AS overlap, action, array_to_string(own, ',') AS features FROM ev WHERE action <> 'KEEP'"""
)
def alarmed_surgery(spark, sf_dir):
    """What becomes of the learners where drift counts only in blocks in which the error detector fires; rows that change nothing are left out."""
    fired = _alarms(spark, sf_dir).select("run", F.floor((F.col("i") - 1) / SIZE).alias("block"))
    found = _surgery(spark, sf_dir, fired).where("action <> 'KEEP'")
    return rounded(found.select("run", "block", "learner", "overlap", "action", F.array_join("features", ",").alias("features")))


def _limit(mean: str, weight: str) -> str:
    return f"{mean} + sqrt({weight} * ln(1 / {ALPHA}) / 2)"


@query(
    f"""WITH RECURSIVE {ERRORS}, st AS (
    SELECT DISTINCT run, 0::BIGINT AS i, NULL::DOUBLE AS wm, NULL::DOUBLE AS ww, NULL::DOUBLE AS bm, NULL::DOUBLE AS bw, NULL::DOUBLE AS am, NULL::DOUBLE AS aw, false AS alarm FROM er
    UNION ALL
    SELECT run, i, {", ".join(f"CASE WHEN alarm THEN NULL ELSE {c} END" for c in ("wm", "ww", "bm", "bw", "am", "aw"))}, alarm FROM (
      SELECT *, coalesce(am - bm > sqrt((bw + aw) * ln(1 / {ALPHA}) / 2), false) AS alarm FROM (
        SELECT run, i, wm, ww, CASE WHEN better THEN wm ELSE bm END AS bm, CASE WHEN better THEN ww ELSE bw END AS bw, CASE WHEN NOT better THEN am END AS am, CASE WHEN NOT better THEN aw END AS aw FROM (
          SELECT *, bm IS NULL OR {_limit("wm", "ww")} < {_limit("bm", "bw")} AS better FROM (
            SELECT er.run, er.i, {", ".join(f"coalesce(st.{c}m + 0.05::DOUBLE * (er.x - st.{c}m), er.x) AS {c}m, coalesce(0.0025::DOUBLE + 0.9025::DOUBLE * st.{c}w, 1) AS {c}w" for c in "wa")}, st.bm, st.bw FROM st JOIN er ON er.run = st.run AND er.i = st.i + 1)))))
    SELECT run, i FROM st WHERE alarm"""
)
def weighted_alarms(spark, sf_dir):
    return drift.alarms(_errors(spark, sf_dir), "run", "i", "error", lambda: drift.WeightedMean(ALPHA, 0.3))


SAMPLE, EVERY = 20, 5


SAMPLED = f"""st AS (
    SELECT DISTINCT run, 0::BIGINT AS i, 0::BIGINT AS seq, []::DOUBLE[] AS ref, []::DOUBLE[] AS cur, 0 AS seen, false AS alarm FROM ev
    UNION ALL
    SELECT run, i, seq, CASE WHEN alarm THEN cur ELSE ref END, CASE WHEN alarm THEN []::DOUBLE[] ELSE cur END, seen, alarm FROM (
      SELECT *, tested AND ks > 0 AND list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-1.0 * k * k * ks * ks * {SAMPLE}))) < {ALPHA} AS alarm FROM (
        SELECT *, CASE WHEN tested THEN list_max(list_transform(list_concat(ref, cur), lambda v: abs(len(list_filter(ref, lambda a: a <= v)) - len(list_filter(cur, lambda b: b <= v))))) / {SAMPLE}::DOUBLE ELSE 0 END AS ks FROM (
          SELECT *, taken AND seen % {EVERY} = 0 AND len(cur) = {SAMPLE} AS tested FROM (
            SELECT ev.run, ev.i, ev.seq, len(st.ref) = {SAMPLE} AS taken, CASE WHEN len(st.ref) = {SAMPLE} THEN st.ref ELSE list_append(st.ref, ev.x) END AS ref,
              CASE WHEN len(st.ref) < {SAMPLE} THEN st.cur WHEN len(st.cur) = {SAMPLE} THEN list_append(st.cur[2:], ev.x) ELSE list_append(st.cur, ev.x) END AS cur,
              CASE WHEN len(st.ref) = {SAMPLE} THEN st.seen + 1 ELSE st.seen END AS seen FROM st JOIN ev ON ev.run = st.run AND ev.i = st.i + 1)))))"""


@query(f"WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id AS run, event_id AS seq, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL), {SAMPLED} SELECT run, seq FROM st WHERE alarm")
def sample_window_alarms(spark, sf_dir):
    """Changes of the distribution of each user's event values."""
    stream = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "value")
    return drift.alarms(stream, "run", "seq", "value", lambda: drift.SampleWindow(SAMPLE, ALPHA, EVERY))


@query(_bayes_sql(100))
def naive_bayes_restarted(spark, sf_dir):
    """Rows of each supplier predicted rightly by naive Bayes that starts afresh at every hundredth row."""
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order))
    y = F.expr(f"CASE l_returnflag {' '.join(f"WHEN '{c}' THEN {n}" for c, n in CLASSES.items())} END")
    stream = keyed(table(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("l_suppkey").alias("run"), i.alias("seq"), y.alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    p = learners.naive_bayes(stream, ["quantity", "discount"], 3, F.col("seq") % 100 == 0)
    return p.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("y")).alias("hits"))


def _events(spark, sf_dir):
    """run, seq, y and p: every event of a user against a rule that takes each for a view."""
    rows = live.table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").cast("int").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("y"), F.lit("view").alias("p"), F.col("value").cast("double").alias("value"), F.hour("ts").cast("double").alias("hour"))


@query(
    "WITH RECURSIVE "
    + HOEFFDING.replace(ERRORS, "er AS MATERIALIZED (SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_type <> 'view')::DOUBLE AS x FROM events)")
    + " SELECT st.run::INT AS run, er.seq FROM st JOIN er ON er.run = st.run AND er.i = st.i WHERE alarm"
)
def live_alarms(spark, sf_dir):
    """Changes in the error of a fixed rule on a stream of all events."""
    return live.finished(live.alarms(_events(spark, sf_dir).select("run", "seq", "y", "p"), ALPHA), "append")


@query()
def live_two_level(spark, sf_dir):
    """Alarms of the rule's error on the stream of events, with the features that drifted."""
    found = live.finished(live.two_level_alarms(_events(spark, sf_dir), ["value", "hour"], 20, 0.3, ALPHA), "append")
    return found.withColumn("drifting", F.array_join("drifting", ","))


@query(
    f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id AS run, event_id AS seq, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events
      WHERE value IS NOT NULL AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events WHERE value IS NOT NULL) - 600000), {SAMPLED} SELECT run::BIGINT AS run, seq FROM st WHERE alarm"""
)
def live_sample_windows(spark, sf_dir):
    """Changes of each user's event values, live: three slices of time, a restart after each; all that the watermark has passed."""

    def run(stream):
        rows = stream.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "ts", "value")
        return live.sample_windows(rows, "10 minutes", SAMPLE, ALPHA, EVERY)

    return live.slices(spark, table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "ts", 3, run)


@query(
    """WITH b AS (SELECT min(epoch_us(ts)) AS a, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 + 1 AS w FROM events), s AS (SELECT (epoch_us(ts) - a) // w AS batch, event_type FROM events, b),
    c AS (SELECT batch, count(*) AS n, count(*) FILTER (event_type = 'view') AS hits FROM s GROUP BY ALL)
    SELECT (sum(n) OVER u)::BIGINT AS instance_num, round((sum(hits) OVER u)::DOUBLE / (sum(n) OVER u), 6) AS accuracy, 0::DOUBLE AS kappa, true AS measured FROM c WINDOW u AS (ORDER BY batch)"""
)
def measured_run(spark, sf_dir):
    """The result table of a fixed rule on all events, live in three slices of time, each with its time and memory."""
    folder = shared_folder(spark)
    y = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    events = table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"), y.cast("int").alias("y"), F.lit(TYPES.index("view")).alias("p"))
    ends = events.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    width = ((ends.b or 0) - (ends.a or 0)) // 3 + 1
    events.where("us IS NOT NULL").withColumn("slice", F.floor((F.col("us") - (ends.a or 0)) / width)).write.partitionBy("slice").parquet(f"{folder}/landed")
    tables_ = []
    for k in range(3):
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/landed/slice={k}")
        tables_.append(measured.run(stream, f"slice_{k}", len(TYPES), f"{folder}/run_{k}").withColumn("_k", F.lit(k)))
    each = tables_[0].unionByName(tables_[1]).unionByName(tables_[2])
    upto = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)  # a row a batch
    n, hits = F.sum("instance_num").over(upto), F.sum(F.round(F.col("accuracy") * F.col("instance_num"))).over(upto)
    fine = (F.col("seconds") > 0) & (F.col("micros_per_instance") > 0) & (F.col("ram_hours") >= 0)
    return rounded(each.select(n.alias("instance_num"), (hits / n).alias("accuracy"), F.col("kappa"), fine.alias("measured"))).withColumn("kappa", F.col("kappa") + 0.0)


@query()
def adaptive_window_alarms(spark, sf_dir):
    """Changes of each supplier's error, found by the window that drops its oldest part."""
    return drift.alarms(_errors(spark, sf_dir), "run", "i", "error", lambda: drift.AdaptiveWindow(0.8, every=4))
