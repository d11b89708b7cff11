"""Queries that join several operators: round trips through files, selection by rows, and the drift-aware ensemble."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean, clock, codes
from ..operators import discretiser, ensembles, learners, prequential, ranking, significance
from ..session import keyed, shared_folder, stored, tasks_of
from ..sources import arff, tables
from ..sources.tables import table
from .catalogue import FEATURES, LONG, MEANS, MERGE_COST, RANKED, SCORED, _scored, query, rounded

BLOCK = 200
ORDERED = "n AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, * FROM lineitem)"


def _stream(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    y = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
    return keyed(table(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("l_suppkey").alias("run"), (F.row_number().over(order) - 1).alias("seq"), y.alias("y"), F.col("l_returnflag").alias("cls"), *FEATURES)


@query("SELECT n_nationkey::VARCHAR AS key, upper(n_name) AS name, n_regionkey::VARCHAR AS region FROM nation")
def csv_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/nation_csv"
    tables.write_csv(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("KEY"), F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Region")), path)
    return tables.csv(spark, path).withColumn("name", F.upper("name"))


@query("SELECT c_acctbal::DOUBLE AS balance, c_nationkey::DOUBLE AS nation, c_mktsegment AS segment FROM customer")
def arff_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/customer_arff"
    df = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("segment"))
    arff.write(df, path, "customers", "segment")
    return arff.read(spark, path)


@query("SELECT c_custkey::DOUBLE AS key, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_nations, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS n_segments FROM customer WHERE c_acctbal > 9000")
def reduced_round_trip(spark, sf_dir):
    """Some features of some customers, written and read under a header that declares what all customers have."""
    path = f"{shared_folder(spark)}/reduced_arff"
    customers = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").cast("double").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    own = arff.reduced(arff.described(customers, "segment", ["nation"]).where("balance > 9000"), ["nation", "key"])
    arff.write(own, path, "customers_reduced", "segment")
    back = arff.read(spark, path)
    sizes = {f"n_{c}s": F.lit(len(back.schema[c].metadata[arff.DOMAIN])).cast("long") for c in ("nation", "segment")}
    return back.withColumns(sizes)


@query("SELECT event_type, count(*) AS n_events, round(sum(value), 6) AS sum_value FROM events WHERE event_id % 50 <> 0 GROUP BY event_type")
def monthly_scan(spark, sf_dir):
    """Events landed by month, every 50th a month late, and scanned by pattern; rows of other months than their file's are left out."""
    path = f"{shared_folder(spark)}/events"
    month = F.when(F.col("event_id") % 50 == 0, F.add_months("ts", 1)).otherwise(F.col("ts"))
    table(spark, sf_dir, "events").withColumn("month", F.date_format(month, "yyyy-MM")).write.partitionBy("month").parquet(path)
    found = tables.monthly(spark, f"{path}/month=*", "ts", ["ts", "event_type", "value"])
    return rounded(found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value")))


def _own_ranges(period: str) -> str:
    """r: the ranges of each run's features over its first period."""
    return f"r0 AS (SELECT run, feature, min(value) AS a, max(value) AS b FROM long WHERE {period} = 0 GROUP BY ALL), r AS (SELECT run, feature, CASE WHEN a = b THEN a ELSE a - 0.05 * (b - a) END AS low, CASE WHEN a = b THEN a + 1 ELSE b + 0.05 * (b - a) END AS high FROM r0)"


SELECTED = f"""{ORDERED}, {LONG.replace("FROM lineitem", "FROM n").replace("l_returnflag AS cls, l_shipdate,", "l_returnflag AS cls, run, seq // 200 AS period,")}, {_own_ranges("period")},
    c AS (SELECT run, period, feature, greatest(least(floor((value - low) / ((high - low) / 10))::INT, 9), 0) AS bin, cls, count(*) AS n FROM long JOIN r USING (run, feature) GROUP BY ALL),
    e AS (SELECT run, period, feature, n, sum(n) OVER (PARTITION BY run, period, feature, bin)::DOUBLE * sum(n) OVER (PARTITION BY run, period, feature, cls) / sum(n) OVER (PARTITION BY run, period, feature) AS e, sum(n) OVER (PARTITION BY run, period, feature) AS t FROM c),
    s AS (SELECT run, period, feature, greatest(sum(n::DOUBLE * n / e) - max(t), 0) AS chi2 FROM e GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY run, period ORDER BY round(chi2, 9) DESC, feature) AS rank FROM s),
    p AS (SELECT run, period, list_sort(list(feature)) AS selected FROM k WHERE rank <= 2 GROUP BY ALL)"""


def _selected(spark, sf_dir):
    """run, period, selected: the two best features of every 200 rows of each supplier, by chi-squared, binned over the first of them."""
    stream = _stream(spark, sf_dir).withColumn("period", F.floor(F.col("seq") / BLOCK))
    counts = ranking.own_histogram(stream, FEATURES, "cls", F.col("period") == 0, 10, "period")
    best = ranking.top(ranking.scores(counts, "run", "period"), "chi2", 2, "run", "period")
    return best.groupBy("run", "period").agg(F.sort_array(F.collect_set("feature")).alias("selected"))


@query(
    f"""WITH {SELECTED} SELECT run, period, array_to_string(selected, ',') AS selected, CASE WHEN lag(selected) OVER w IS NOT NULL THEN len(list_intersect(selected, lag(selected) OVER w)) / 2.0::DOUBLE END AS stability FROM p WINDOW w AS (PARTITION BY run ORDER BY period)"""
)
def selection_by_rows(spark, sf_dir):
    """The two best features of every 200 rows of each supplier, and the share that stays."""
    sets = _selected(spark, sf_dir)
    before = F.lag("selected").over(Window.partitionBy("run").orderBy("period"))
    sets = sets.withColumn("_before", before)
    return sets.select("run", "period", F.array_join("selected", ",").alias("selected"), F.when(F.col("_before").isNotNull(), F.size(F.array_intersect("_before", "selected")) / 2.0).alias("stability"))


def _synced_sql(remap: bool) -> str:
    """Naive Bayes on the features selected by the period before, all of them in the first."""
    state, scores, comes, versions = [], [], [], []
    for f in FEATURES:
        comes.append(f"(list_contains(sel, '{f}') AND NOT coalesce(list_contains(lag(sel) OVER o, '{f}'), false))::INT AS come_{f}")
        versions.append(f"sum(come_{f}) OVER u AS v_{f}")
    w = lambda *more: f"(PARTITION BY {', '.join(('run', 'session', *more))} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    for c in range(3):
        state.append(f"count(*) FILTER (y = {c}) OVER {w()} AS n{c}")
        score = f"ln(n{c} + 1.0)"
        for f in FEATURES:
            own, over = f"FILTER (y = {c} AND list_contains(sel, '{f}'))", w(f"v_{f}") if remap else w()
            state.append(f"count(*) {own} OVER {over} AS n{c}{f}, sum({f}::DOUBLE) {own} OVER {over} AS s{c}{f}, sum({f}::DOUBLE * {f}::DOUBLE) {own} OVER {over} AS q{c}{f}")
            mean = f"(CASE WHEN n{c}{f} > 0 THEN s{c}{f} / n{c}{f} ELSE 0 END)"
            variance = f"(CASE WHEN n{c}{f} > 0 THEN greatest(q{c}{f} / n{c}{f} - {mean} * {mean}, 0) + 0.001 ELSE 1 END)"
            score += f" + CASE WHEN list_contains(sel, '{f}') THEN -0.5 * ln({variance}) - ({f} - {mean}) * ({f} - {mean}) / (2 * {variance}) ELSE 0 END"
        scores.append(f"round({score}, 9) AS l{c}")
    changed = "0" if remap else "sum(coalesce((sel <> before)::INT, 0)) OVER u"
    return f"""WITH {SELECTED}, t AS (SELECT n.* REPLACE (floor(l_extendedprice / 1000) AS l_extendedprice), seq // 200 AS period, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS y, coalesce(p.selected, {sorted(FEATURES)}) AS sel FROM n LEFT JOIN p ON p.run = n.run AND p.period = seq // 200 - 1),
    ch AS (SELECT *, lag(sel) OVER o AS before, {", ".join(comes)} FROM t WINDOW o AS (PARTITION BY run ORDER BY seq)), ve AS (SELECT *, {changed} AS session, {", ".join(versions)} FROM ch WINDOW u AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    st AS (SELECT *, {", ".join(state)} FROM ve), sc AS (SELECT *, {", ".join(scores)} FROM st)
    SELECT run, period, array_to_string(sel, ',') AS selected, count(*) AS n, sum((y = CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END)::INT)::BIGINT AS hits FROM sc GROUP BY ALL"""


def _synced(spark, sf_dir, remap):
    stream = _stream(spark, sf_dir).withColumn("period", F.floor(F.col("seq") / BLOCK))
    chosen = _selected(spark, sf_dir).withColumn("period", F.col("period") + 1)
    stream = stream.join(chosen, ["run", "period"], "left").withColumn("selected", F.coalesce("selected", F.array(*map(F.lit, sorted(FEATURES)))))
    stream = stream.withColumn("l_extendedprice", F.floor(F.col("l_extendedprice") / 1000))  # whole thousands: sums of squares stay exact
    p = learners.naive_bayes(stream, FEATURES, 3, selected=F.col("selected"), remap=remap)
    return p.groupBy("run", "period", F.array_join("selected", ",").alias("selected")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("y")).alias("hits"))


@query(_synced_sql(False))
def synced_bayes(spark, sf_dir):
    """Rows predicted rightly by naive Bayes on the features that the 200 rows before selected; each new selection is learned afresh."""
    return _synced(spark, sf_dir, False)


@query(_synced_sql(True))
def remapped_bayes(spark, sf_dir):
    """The same, where features that stay selected keep what they have learned."""
    return _synced(spark, sf_dir, True)


#: What the ensemble's learners start with, on rows of blocks of 100.
WIDE, SIZE = [*FEATURES, "l_linenumber", "l_partkey"], 100
SPACES = {0: ["l_extendedprice", "l_linenumber", "l_quantity"], 1: ["l_discount", "l_partkey", "l_tax"], 2: ["l_discount", "l_partkey", "l_quantity", "l_tax"], 3: ["l_extendedprice", "l_linenumber"]}
WIDE_LONG = f"long AS (SELECT l_returnflag AS cls, run, seq // {SIZE} AS block, unnest({WIDE}) AS feature, unnest([{', '.join(WIDE)}])::DOUBLE AS value FROM n)"
DRIFTS = f"""{ORDERED}, {WIDE_LONG},
    sides AS (SELECT run, block + 1 - side AS block, feature, value, side FROM long, (VALUES (0), (1)) v(side)),
    pt AS (SELECT run, block, feature, value, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM sides GROUP BY ALL),
    st AS (SELECT run, block, feature, sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER g AS n0, sum(b) OVER g AS n1 FROM pt WINDOW u AS (PARTITION BY run, block, feature ORDER BY value ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY run, block, feature)),
    d AS (SELECT run, block, feature, max(n0)::DOUBLE AS n0, max(n1)::DOUBLE AS n1, max(abs(ca / n0 - cb / n1)) AS ks FROM st WHERE n0 > 0 AND n1 > 0 GROUP BY ALL),
    t AS (SELECT run, block, feature, round(CASE WHEN ks = 0 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * ks * ks * (n0 * n1 / (n0 + n1))))), 0.0), 1.0) END, 9) AS p FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY run, block ORDER BY p, feature) AS r, count(*) OVER (PARTITION BY run, block) AS m FROM t),
    f AS (SELECT run, block, feature, r <= coalesce(max(CASE WHEN p <= r * 0.3 / m THEN r END) OVER (PARTITION BY run, block), 0) AS drift FROM o)"""


def _surgery_sql(fired: str = "true") -> str:
    """ev: run, block, learner, overlap, action, own, a row for each learner and block; `fired` tells whether drift counts in a block."""
    start = ", ".join(f"({i}, {own})" for i, own in SPACES.items())
    u = "(('0x' || substr(md5('1:' || k.run || ':' || k.block || ':' || k.learner || ':' || x), 1, 8))::BIGINT + 0.5) / 4294967296"
    return f"""{_own_ranges("block")},
    c AS (SELECT run, block, feature, greatest(least(floor((value - low) / ((high - low) / 10))::INT, 9), 0) AS bin, cls, count(*) AS n FROM long JOIN r USING (run, feature) GROUP BY ALL),
    e AS (SELECT run, block, feature, n, sum(n) OVER (PARTITION BY run, block, feature, bin)::DOUBLE * sum(n) OVER (PARTITION BY run, block, feature, cls) / sum(n) OVER (PARTITION BY run, block, feature) AS e, sum(n) OVER (PARTITION BY run, block, feature) AS t FROM c),
    s AS (SELECT run, block, feature, round(greatest(sum(n::DOUBLE * n / e) - max(t), 0), 9)::DOUBLE AS score FROM e GROUP BY ALL),
    fb AS MATERIALIZED (SELECT run, block, list(feature ORDER BY score DESC, feature) AS ranked, map_from_entries(list((feature, score))) AS sc, coalesce(list(feature) FILTER (drift AND {fired}), []) AS dr FROM s LEFT JOIN f USING (run, block, feature) GROUP BY ALL),
    ev AS (SELECT run, 0::BIGINT AS block, learner, 0::DOUBLE AS overlap, 'KEEP' AS action, own, own AS fresh FROM (SELECT DISTINCT run FROM n), (VALUES {start}) v(learner, own) UNION ALL
      SELECT run, block, learner, overlap, CASE WHEN action = 'SURGICAL' AND swapped = own THEN 'NO_REPLACEMENT' ELSE action END, CASE action WHEN 'KEEP' THEN own WHEN 'SURGICAL' THEN swapped ELSE fresh END,
        CASE action WHEN 'KEEP' THEN [] WHEN 'SURGICAL' THEN list_filter(swapped, lambda x: NOT list_contains(own, x)) ELSE fresh END FROM (
        SELECT k.*, list_transform(own, lambda x, i: CASE WHEN list_contains(dr, x) AND coalesce(sc[others[len(list_filter(own[:i], lambda y: list_contains(dr, y)))]], -1) > sc[x] THEN others[len(list_filter(own[:i], lambda y: list_contains(dr, y)))] ELSE x END) AS swapped,
          list_sort(list_transform(list_sort(list_transform(ranked, lambda x: {{'avoid': list_contains(dr, x), 'none': NOT sc[x] > 0, 'key': CASE WHEN sc[x] > 0 THEN -ln({u}) / sc[x] ELSE -({u}) END, 'f': x}}))[:len(own)], lambda z: z.f)) AS fresh FROM (
          SELECT *, CASE WHEN overlap = 0 THEN 'KEEP' WHEN overlap < 0.5 THEN 'SURGICAL' ELSE 'FULL' END AS action, list_filter(ranked, lambda x: NOT list_contains(own, x) AND NOT list_contains(dr, x)) AS others FROM (
            SELECT fb.*, learner, own, len(list_filter(own, lambda x: list_contains(dr, x))) / len(own)::DOUBLE AS overlap FROM ev JOIN fb ON fb.run = ev.run AND fb.block = ev.block + 1)) k))"""


def _wide(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    y = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
    return keyed(table(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("l_suppkey").alias("run"), (F.row_number().over(order) - 1).alias("seq"), y.alias("y"), *WIDE)


def _surgery(spark, sf_dir, alarms=None):
    start = spark.createDataFrame([(i, f) for i, own in SPACES.items() for f in own], "learner int, feature string")
    return ensembles.surgery(ensembles.blocks(_wide(spark, sf_dir), SIZE), WIDE, start, 0.3, alarms=alarms)


@query(f"WITH RECURSIVE {DRIFTS}, {_surgery_sql()} SELECT run, block, learner, round(overlap, 6) AS overlap, action, array_to_string(own, ',') AS features FROM ev")
def ensemble_actions(spark, sf_dir):
    """What the drift of every block of 100 rows does to each learner of each supplier's ensemble, and the subspaces afterwards."""
    return rounded(_surgery(spark, sf_dir).select("run", "block", "learner", "overlap", "action", F.array_join("features", ",").alias("features")))


@query(f"WITH RECURSIVE {DRIFTS}, {_surgery_sql()} SELECT action, count(*) AS n_learners, sum(len(fresh))::BIGINT AS n_features FROM ev GROUP BY ALL")
def action_summary(spark, sf_dir):
    summary = ensembles.action_summary(_surgery(spark, sf_dir))
    return summary.groupBy("action").agg(F.sum("n_learners").alias("n_learners"), F.sum("n_features").alias("n_features"))


@query()
def ensemble_run(spark, sf_dir):
    """From stream to metrics: the drift-aware ensemble on every supplier's line items, tested then trained; a row a supplier."""
    spaces = stored(_surgery(spark, sf_dir), "subspaces")
    predicted = ensembles.drift_aware(_wide(spark, sf_dir), WIDE, 3, SIZE, spaces, tasks=tasks_of(table(spark, sf_dir, "lineitem")))
    return rounded(prequential.snapshot(predicted.select("run", "seq", "y", "p"), 3))


GATHERED = f"""{DRIFTS}, se0 AS (SELECT run, block, feature, coalesce(sum(drift::INT) OVER (PARTITION BY run, feature ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session FROM (SELECT DISTINCT run, block, feature FROM long) LEFT JOIN f USING (run, block, feature)),
    se AS (SELECT *, block - min(block) OVER (PARTITION BY run, feature, session) AS age FROM se0), ro AS (SELECT long.*, session, age FROM long JOIN se USING (run, block, feature)),
    r0 AS (SELECT run, session, feature, min(value) AS a, max(value) AS b FROM ro WHERE age < 1 GROUP BY ALL), r AS (SELECT run, session, feature, CASE WHEN a = b THEN a ELSE a - 0.05 * (b - a) END AS low, CASE WHEN a = b THEN a + 1 ELSE b + 0.05 * (b - a) END AS high FROM r0),
    c AS (SELECT run, session, block, feature, greatest(least(floor((value - low) / ((high - low) / 12))::INT, 11), 0) AS bin, cls, count(*) AS n FROM ro JOIN r USING (run, session, feature) GROUP BY ALL),
    ga AS (SELECT se.run, se.session, se.block, se.feature, c.bin, c.cls, sum(c.n)::BIGINT AS n FROM se JOIN c ON c.run = se.run AND c.session = se.session AND c.feature = se.feature AND c.block <= se.block GROUP BY ALL)"""


def _gathered(spark, sf_dir):
    """The histograms of each supplier's features after every 100 rows; drift of a feature begins its histogram afresh."""
    stream = _wide(spark, sf_dir)
    blocked = ensembles.blocks(stream, SIZE)
    resets = ensembles.block_drift(blocked, WIDE, 0.3).where("drift").withColumnRenamed("block", "update")
    named = blocked.withColumn("cls", F.element_at(F.array(*map(F.lit, "ANR")), (F.col("y") + 1).cast("int")))
    long = ranking.long_form(named.withColumnRenamed("block", "update"), WIDE, "cls", "run", "update")
    return stored(discretiser.gathered(long, 12, 1, resets, tasks=tasks_of(table(spark, sf_dir, "lineitem"))), "gathered")


@query(f"WITH {GATHERED} SELECT run, block AS update, feature, session, count(*) AS n_cells, sum(n)::BIGINT AS n_rows, sum(n * bin)::BIGINT AS weighted FROM ga GROUP BY ALL")
def gathered_histograms(spark, sf_dir):
    """Sizes of the gathered histograms, by supplier, update and feature."""
    return _gathered(spark, sf_dir).groupBy("run", "update", "feature", "session").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("bin")).alias("weighted"))


@query(
    f"""WITH RECURSIVE {GATHERED}, z AS (SELECT k.run, k.block, k.feature, b.bin, [{", ".join(f"coalesce(sum(ga.n) FILTER (ga.cls = '{x}'), 0)::DOUBLE" for x in "ANR")}] AS v, b.bin AS last
      FROM (SELECT DISTINCT run, block, feature FROM ga) k CROSS JOIN range(12) b(bin) LEFT JOIN ga ON ga.run = k.run AND ga.block = k.block AND ga.feature = k.feature AND ga.bin = b.bin GROUP BY ALL),
    g AS (SELECT run, block, feature, 0 AS step, bin, v, last FROM z UNION ALL
      SELECT run, block, feature, step + 1, bin, CASE WHEN r = 1 THEN [v[1] + nv[1], v[2] + nv[2], v[3] + nv[3]] ELSE v END, CASE WHEN r = 1 THEN nl ELSE last END FROM (SELECT *, lag(r) OVER (PARTITION BY run, block, feature ORDER BY bin) AS pr FROM (
        SELECT *, row_number() OVER (PARTITION BY run, block, feature ORDER BY cost NULLS LAST, bin) AS r FROM (SELECT *, {MERGE_COST} AS cost FROM (SELECT *, lead(v) OVER w AS nv, lead(last) OVER w AS nl FROM g WHERE step < 8 WINDOW w AS (PARTITION BY run, block, feature ORDER BY bin))))) WHERE coalesce(pr, 0) <> 1),
    fin AS (SELECT run, block, feature, (row_number() OVER (PARTITION BY run, block, feature ORDER BY bin) - 1)::INT AS bin, v, last FROM g WHERE step = 8)
    SELECT fin.run, fin.block AS update, fin.feature, fin.bin, round(low + (last + 1) * ((high - low) / 12), 6) AS upto, list_sum(v)::BIGINT AS n FROM fin JOIN se ON se.run = fin.run AND se.block = fin.block AND se.feature = fin.feature JOIN r ON r.run = fin.run AND r.session = se.session AND r.feature = fin.feature WHERE list_sum(v) > 0"""
)
def discretiser_cuts(spark, sf_dir):
    """The cut points of the second layer's four bins after each update, merged anew from what has been gathered."""
    cells = discretiser.merged(_gathered(spark, sf_dir), 12, 4, 3)
    return rounded(cells.groupBy("run", "update", "feature", "bin", "upto").agg(F.sum("n").alias("n")))


@query(
    "SELECT event_id, CASE WHEN value IS NOT NULL THEN value * (event_id % 7) END AS crossed, try_cast(props AS TIMESTAMP) IS NULL AS bad_time, 1 - greatest(least(value / 100, 1), 0) AS left_over FROM events WHERE value IS NOT NULL"
)
def cleaned_events(spark, sf_dir):
    """Rows without NULLs, an interaction of two columns, unreadable times as NULL, and the complement of a clamped share."""
    df = clean.complete(table(spark, sf_dir, "events").select("event_id", "value", "props"))
    return df.select("event_id", clean.interaction(F.col("value"), F.col("event_id") % 7).alias("crossed"), clean.moment(F.col("props")).isNull().alias("bad_time"), clean.complement(F.col("value") / 100).alias("left_over"))


@query(f"WITH {SCORED}, {RANKED}, {MEANS} SELECT count(*) AS n_pairs, count(*) FILTER (abs(a.mean_rank - b.mean_rank) > 2.728 * sqrt(5 * 6 / (6 * a.n))) AS n_rejected FROM mr a JOIN mr b ON a.method < b.method")
def rejected_pairs(spark, sf_dir):
    return significance.rejected(significance.nemenyi(significance.ranked(_scored(spark, sf_dir))))


@query(
    f"""WITH {SCORED}, {RANKED}, {MEANS}, fr AS (SELECT max(n) AS n, max(k) AS k, 12 * max(n) / (max(k) * (max(k) + 1)) * sum(mean_rank * mean_rank) - 3 * max(n) * (max(k) + 1) AS chi2 FROM mr),
    fs AS (SELECT *, (n - 1) * chi2 / (n * (k - 1) - chi2) AS f, 4 * (n - 1) AS d2 FROM fr), fp AS (SELECT *, pow(d2 / (d2 + 4 * f), d2 / 2) * (1 + d2 / 2 * (1 - d2 / (d2 + 4 * f))) AS p FROM fs)
    SELECT method || ': mean rank ' || printf('%.3f', mean_rank) || ' over ' || n::BIGINT || ' datasets' AS line FROM mr
    UNION ALL SELECT printf('Friedman: chi2 %.3f, F %.3f, p %.4f: ', chi2, f, p) || CASE WHEN p < 0.05 THEN 'methods differ' ELSE 'no difference shown' END FROM fp
    UNION ALL SELECT a.method || ' and ' || b.method || printf(': mean ranks differ by %.3f, critical difference %.3f: ', abs(a.mean_rank - b.mean_rank), 2.728 * sqrt(5 * 6 / (6 * a.n))) || CASE WHEN abs(a.mean_rank - b.mean_rank) > 2.728 * sqrt(5 * 6 / (6 * a.n)) THEN 'significant' ELSE 'not significant' END FROM mr a JOIN mr b ON a.method < b.method"""
)
def rank_report(spark, sf_dir):
    """Mean ranks, the test of all methods, and each two methods, as text."""
    return significance.report(significance.ranked(_scored(spark, sf_dir)))


@query(f"WITH {SELECTED}, q AS (SELECT run, selected = lag(selected) OVER (PARTITION BY run ORDER BY period) AS same FROM p) SELECT run, round(coalesce(avg(same::INT), 1), 6) AS stability FROM q GROUP BY run")
def strict_stability(spark, sf_dir):
    """The share of each supplier's selections that equal the one before."""
    return rounded(prequential.strict_stability(_selected(spark, sf_dir).select("run", F.col("period").alias("seq"), F.col("selected").alias("selection"))))


@query(
    "WITH s AS (SELECT user_id AS run, epoch_us(ts) / 1000000.0::DOUBLE AS sec, value AS mb, event_id FROM events WHERE value IS NOT NULL), d AS (SELECT run, (sec - lag(sec) OVER w) / 3600 AS h, mb, (mb + lag(mb) OVER w) / 2 AS m FROM s WINDOW w AS (PARTITION BY run ORDER BY sec, event_id)) "
    "SELECT run, round(coalesce(sum(h * m), 0), 4) AS mb_hours, round(coalesce(sum(h * mb / 1024), 0), 4) AS gb_hours FROM d GROUP BY run"
)
def memory_hours(spark, sf_dir):
    """Each user's values taken for samples of memory, integrated over time."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    samples = events.select(F.col("user_id").alias("run"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), F.col("value").alias("mb"), "event_id")
    return rounded(prequential.ram_hours(samples, "event_id"), 4)


@query(
    f"""WITH c AS (SELECT p_partkey, p_size, p_brand, CASE WHEN p_size % 3 = 0 THEN p_size END AS reason, (['HBW', 'hbshop', 'NHB', '3', '12', 'x', '4.0'])[p_partkey % 7 + 1] AS name FROM part)
    SELECT p_partkey, coalesce(CASE reason {" ".join(f"WHEN {k} THEN {v}" for k, v in codes.REASONS.items())} END, CASE upper(name) {" ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.PURPOSES.items())} END, CASE WHEN try_cast(name AS DOUBLE) BETWEEN 1 AND 10 THEN try_cast(name AS DOUBLE)::INT END)::INT AS purpose,
      CASE {" ".join(f"WHEN p_size BETWEEN {low} AND {high} THEN '{n}'" for n, (low, high) in codes.MODES.items())} END AS mode, (p_partkey % 2400 // 100)::INT AS hour, try_cast(substr(p_brand, 7) AS DOUBLE) AS brand, try_cast(p_brand AS DOUBLE) AS no_number FROM c"""
)
def trip_codes(spark, sf_dir):
    """Purpose and mode codes, hours of HHMM numbers, and text as numbers, over all parts."""
    size, key = F.col("p_size"), F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("HBW", "hbshop", "NHB", "3", "12", "x", "4.0"))), (key % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", codes.purpose(F.when(size % 3 == 0, size), name).alias("purpose"), codes.transport_mode(size).alias("mode"), clock.hour_of_hhmm(key % 2400).alias("hour"),
        clean.number(F.substring("p_brand", 7, 99)).alias("brand"), clean.number(F.col("p_brand")).alias("no_number"),
    )


@query("SELECT l_linestatus, count(*) AS n, round(avg(datediff('second', o_orderdate, l_shipdate) / 60.0), 4) AS mean_minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def shipping_minutes(spark, sf_dir):
    """Minutes from order to shipment, by status."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(joined.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg(clock.minutes_between(F.col("o_orderdate"), F.col("l_shipdate"))).alias("mean_minutes")), 4)


@query(
    "WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i, event_type = lag(event_type) OVER w AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "c AS (SELECT user_id, i, count(*) FILTER (hit) OVER (PARTITION BY user_id ORDER BY event_id) AS hits FROM n) SELECT user_id AS run, i AS n, round(hits / i::DOUBLE, 6) AS accuracy FROM c WHERE i % 10 = 0"
)
def progress(spark, sf_dir):
    """A line every ten rows of each user's no-change run."""
    labels = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("y"))
    by = Window.partitionBy("run").orderBy("seq")
    predicted = labels.withColumn("p", F.lag("y").over(by))
    return rounded(prequential.progress(predicted, 10))
