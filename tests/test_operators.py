"""Exact small cases and brute-force comparisons."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestream.functions import clean, codes
from lodestream.operators import adaptive, bars, drift, hourly, learners, prequential, ranking, significance, trees
from lodestream.sources import arff, generators, tables
from lodestream.streaming import live


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("value, wanted", [(0.0, 0), (0.999, 0), (1.0, 1), (9.999, 9), (5.0, 5), (-100.0, 0), (1e9, 9), (None, 0)])
def test_layer1_bin(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "v double").select(ranking.layer1_bin(F.col("v"), F.lit(0.0), F.lit(10.0), 10).alias("b"))
    assert one(df).b == wanted


@pytest.mark.parametrize("n, k", [(1, 1), (4, 2), (10, 4), (100, 10)])
def test_default_k(n, k):
    assert ranking.default_k(n) == k


def test_merged_bins_keep_counts_and_order(spark):
    rng = random.Random(1)
    counts = spark.createDataFrame([("f", b, c, rng.randint(1, 9)) for b in range(20) for c in "xy"], "feature string, bin int, cls string, n long")
    to = ranking.merged_bins(counts, 20, 5).orderBy("bin").collect()
    assert [r["bin"] for r in to] == list(range(20))
    groups = [r["to"] for r in to]
    assert groups == sorted(groups) and set(groups) == set(range(5))
    merged = ranking.regrouped(counts, ranking.merged_bins(counts, 20, 5))
    assert one(merged.agg(F.sum("n").alias("n"))).n == one(counts.agg(F.sum("n").alias("n"))).n


def test_informative_feature_scores_above_noise(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        c = rng.randint(0, 1)
        rows += [("good", 2 * c + rng.randint(0, 1), c), ("noise", rng.randint(0, 3), c)]
    counts = spark.createDataFrame(rows, "feature string, bin int, cls int").groupBy("feature", "bin", "cls").agg(F.count(F.lit(1)).alias("n"))
    scored = {r["feature"]: r for r in ranking.scores(counts).collect()}
    for score in ("info_gain", "mutual_info", "chi2"):
        assert scored["good"][score] > 5 * scored["noise"][score] >= 0


def test_exponential_mean_over_blocks(spark):
    rng = random.Random(3)
    xs = [rng.random() for _ in range(2000)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "symbol string, day int, x double")
    got = [r.e for r in bars.exponential_mean(df, "x", 2 / 13, "e").orderBy("day").collect()]
    e = xs[0]
    for i, x in enumerate(xs):
        e = x if i == 0 else e * 11 / 13 + x * 2 / 13
        assert abs(got[i] - e) < 1e-12


def test_neighbour_mean_skips_nulls(spark):
    values = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "c", None)], "t int, zone string, v double")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "zone string, neighbour string")
    got = {r["zone"]: r["neighbour_avg"] for r in hourly.neighbour_mean(values, edges, "t", "zone", "v").collect()}
    assert got == {"a": 3.0, "b": None, "c": None}


def test_metrics_of_perfect_alternation(spark):
    rows = spark.createDataFrame([(0, i, i % 2, i % 2) for i in range(200)], "run int, seq int, y int, p int")
    last = one(prequential.metrics(rows, 2, 100).orderBy(F.desc("seq")))
    assert last.accuracy == last.kappa == last.kappa_recent == 1.0 and last.kappa_temporal > 0.9
    assert prequential.sampled(prequential.metrics(rows.where("seq < 73"), 2), 50).count() == 2


def test_metrics_window_and_range(spark):
    rows = spark.createDataFrame([(0, i, 0, 1 if i < 5 else 0) for i in range(10)] + [(0, 10, -1, 0), (0, 11, 0, 99)], "run int, seq int, y int, p int")
    last = one(prequential.metrics(rows, 2, 5).orderBy(F.desc("seq")))
    assert (last.seq, last.accuracy, last.accuracy_recent) == (9, 0.5, 1.0)


def test_ks_against_brute_force(spark):
    rng = random.Random(4)
    a, b = [rng.randint(0, 20) for _ in range(60)], [rng.randint(3, 25) for _ in range(80)]
    df = spark.createDataFrame([("k", 0, float(x)) for x in a] + [("k", 1, float(x)) for x in b], "k string, side int, value double")
    want = max(abs(sum(x <= v for x in a) / 60 - sum(x <= v for x in b) / 80) for v in a + b)
    assert abs(one(drift.distance(df, "k")).ks - want) < 1e-12


@pytest.mark.parametrize("few", [0, 200_000])
@pytest.mark.parametrize("by", [["k"], ["k", "j"], []])
def test_totals_by_ranges(spark, monkeypatch, by, few):
    """Running totals agree with a plain loop, over tasks and groups of any size, NULL keys included, by ranges and by one window."""
    monkeypatch.setattr(drift, "FEW", few)
    rng = random.Random(12)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(2), i, rng.choice([None, 1, 2, 5])) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, j int, i int, n int").repartition(5)
    totals, running = {}, {}
    for k, j, i, n in sorted(rows, key=lambda r: r[2]):
        group = tuple({"k": k, "j": j}[c] for c in by)
        totals[group] = totals.get(group, 0) + (n or 0)
        running[i] = totals[group]
    for r in drift.ranged_sums(df.fillna(0, ["n"]), by, ["i"], ["n"]).collect():
        assert (r.upto_n, r.all_n) == (running[r.i], totals[tuple(r[c] for c in by)])
        running.pop(r.i)
    assert not running


def test_long_distance_is_the_distance(spark):
    rng = random.Random(13)
    rows = [(k, rng.randrange(2), rng.choice([None, round(rng.gauss(0, 1), 1)])) for k in ["a", "b", None] for _ in range(200)] + [("one side", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, side int, value double")
    assert sorted(map(str, drift.long_distance(df, "k").collect())) == sorted(map(str, drift.distance(df, "k").collect()))
    assert drift.long_distance(df.limit(0), "k").count() == 0


def test_past_median(spark):
    rng = random.Random(14)
    rows = [(k, h, rng.choice([None, 0.0, float(rng.randrange(9)), rng.random()])) for k in ["a", "b", None] for h in range(70)]
    df = hourly.past_median_label(spark.createDataFrame(rows, "k string, hour int, v double").repartition(3), "k", "v")
    values = {(k, h): v for k, h, v in rows}
    out = df.collect()
    assert len(out) == len(rows) and df.columns == ["k", "hour", "v", "past_median", "label"]
    for r in out:
        past = [values[r.k, h] for h in range(r.hour) if values[r.k, h] is not None]
        want = statistics.median(past) if past else None
        assert r.past_median == want or abs(r.past_median - want) < 1e-12
        assert r.label == ("HIGH" if None not in (r.v, want) and r.v > want else "LOW")


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.6]
    got = {r["p"]: r["drift"] for r in drift.discoveries(spark.createDataFrame([(x,) for x in p], "p double"), "p", 0.05).collect()}
    assert [got[x] for x in p] == [True, True, False, False, False]


@pytest.mark.parametrize("detector", [drift.AdaptiveWindow, drift.HoeffdingMean, drift.WeightedMean])
def test_detectors_find_a_shift_and_stay_calm(detector):
    rng = random.Random(5)
    state = detector()
    assert sum(state.add(float(rng.random() < 0.1)) for _ in range(5000)) <= 2
    assert any(state.add(float(rng.random() < 0.6)) for _ in range(2000))


def test_detector_arguments():
    with pytest.raises(ValueError):
        drift.AdaptiveWindow(delta=2)
    with pytest.raises(ValueError):
        drift.HoeffdingMean(alpha=0)


def test_friedman_ties_share_ranks(spark):
    scores = spark.createDataFrame([(d, m, s) for d in range(3) for m, s in (("a", 1.0), ("b", 1.0), ("c", 0.5))], "dataset int, method string, score double")
    ranks = {r["method"]: r["mean_rank"] for r in significance.mean_ranks(significance.ranked(scores)).collect()}
    assert ranks == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_wilcoxon_counts(spark):
    pairs = zip((1, 2, 3, 4, 5), (0, 2, 5, 4, 1))
    scores = spark.createDataFrame([(i, m, float(s)) for i, (x, y) in enumerate(pairs) for m, s in (("a", x), ("b", y))], "dataset int, method string, score double")
    r = one(significance.wilcoxon(scores, "a", "b"))
    assert (r.n, r.wins, r.losses, r.ties) == (5, 2, 1, 2)


def test_arff_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "it's", True, "x"), (None, "a,b", False, "y"), (2.0, None, None, "x")], "v double, t string, b boolean, c string")
    arff.write(df, f"file://{tmp_path}/r", "rel", "c")
    got = sorted((tuple(r) for r in arff.read(spark, f"file://{tmp_path}/r").collect()), key=str)
    assert got == sorted([(1.5, "it's", "1", "x"), (None, "a,b", "0", "y"), (2.0, None, None, "x")], key=str)
    assert "@ATTRIBUTE c {x,y}" in arff.header(df, "rel", "c")


def test_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Name,id\n1,x,2\n")
    assert [tuple(r) for r in tables.csv(spark, f"file://{tmp_path}/a.csv").collect()] == [("1", "x")]
    with pytest.raises(tables.MissingInput):
        tables.required(lambda: spark.read.parquet(f"file://{tmp_path}/none"), "run the download first")
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), ["other"])


def test_clean_functions(spark):
    df = spark.createDataFrame([("1.5", 5.0, -7), ("x", None, 3), ("NaN", 500.0, None)], "t string, v double, c int")
    got = df.select(clean.number(F.col("t")).alias("n"), clean.clipped(F.col("v"), 0, 100).alias("k"), clean.unmasked(F.col("c")).alias("u"), clean.flag(F.col("c"), 3).alias("f")).collect()
    assert [tuple(r) for r in got] == [(1.5, 5.0, None, 0), (None, None, 3, 1), (None, 100.0, None, None)]


def test_generators_are_alike_each_time_and_drift(spark):
    a = generators.sea(spark, 2, 2000)
    assert a.exceptAll(generators.sea(spark, 2, 2000)).count() == 0
    error = lambda df: one(df.agg(F.avg(((F.col("x0") + F.col("x1") <= 8).cast("int") != F.col("y")).cast("int")).alias("e"))).e
    assert error(a.where("seq < 500")) < 0.14 < error(a.where("seq >= 1500"))
    assert generators.stagger(spark, 1, 100).count() == generators.hyperplane(spark, 1, 100).count() == 100
    both = generators.spliced(a, a.withColumn("y", F.lit(9)), 1000, 10)
    assert both.count() == 4000 and one(both.agg(F.avg((F.col("y") == 9).cast("int")).alias("e"))).e == pytest.approx(0.5, abs=0.02)


def test_naive_bayes_learns_and_restarts(spark):
    stream = generators.sea(spark, 1, 3000)
    p = learners.naive_bayes(stream, ["x0", "x1", "x2"], 2)
    assert p.columns == [*stream.columns, "p"]
    late = one(p.where("seq between 300 and 749").agg(F.avg((F.col("p") == F.col("y")).cast("int")).alias("a"))).a
    assert late > 0.75
    first = learners.naive_bayes(stream, ["x0"], 2, F.col("seq") == 1000).where("seq in (0, 1000)").collect()
    assert [r.p for r in first] == [0, 0]


def test_swaps_stop_at_the_first_pair_without_gain(spark):
    scored = spark.createDataFrame([("a", 0.1, True), ("b", 0.5, True), ("c", 0.9, True), ("d", 0.8, False), ("e", 0.4, False), ("f", 0.95, False)], "feature string, score double, sel boolean")
    got = {(r["out"], r["in"]) for r in learners.swaps(scored, F.col("sel"), "score").collect()}
    assert got == {("a", "f"), ("b", "d")}
    assert learners.swaps(scored, F.col("sel"), "score", 1).count() == 1


def test_actions_by_overlap(spark):
    subspaces = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "e"), (3, "f")], "learner int, feature string")
    drifting = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    got = {r.learner: r.action for r in adaptive.actions(subspaces, drifting).collect()}
    assert got == {1: "FULL", 2: "SURGICAL", 3: "KEEP"}


def test_weighted_vote_and_weights(spark):
    votes = spark.createDataFrame([(0, 1, 1, 0, 1.0), (0, 1, 2, 1, 1.0), (0, 2, 1, 1, 0.5), (0, 2, 2, 0, 0.5)], "run int, seq int, learner int, cls int, vote double")
    even, heavy = (spark.createDataFrame([(1, 0.0), (2, w)], "learner int, weight double") for w in (0.0, 0.9))
    assert {r.seq: r.p for r in adaptive.voted(votes, heavy).collect()} == {1: 1, 2: 0}
    assert {r.seq: r.p for r in adaptive.voted(votes, even).collect()} == {1: 0, 2: 0}
    importance = spark.createDataFrame([("a", 0.6), ("b", 0.2)], "feature string, importance double")
    subspaces = spark.createDataFrame([(1, "a"), (2, "b")], "learner int, feature string")
    assert {r.learner: round(r.weight, 6) for r in adaptive.learner_weights(subspaces, importance).collect()} == {1: 0.75, 2: 0.25}


def test_stability_and_memory(spark):
    chosen = spark.createDataFrame([(0, i, x) for i, x in enumerate([[1, 2], [1, 2], [1, 3]])] + [(1, 0, [1])], "run int, seq int, selection array<int>")
    assert {r.run: r.stability for r in prequential.strict_stability(chosen).collect()} == {0: 0.5, 1: 1.0}
    memory = spark.createDataFrame([(0, 0.0, 100.0), (0, 3600.0, 300.0)], "run int, seconds double, mb double")
    r = one(prequential.ram_hours(memory))
    assert r.mb_hours == 200.0 and abs(r.gb_hours - 300 / 1024) < 1e-12


def test_survey_codes(spark):
    df = spark.createDataFrame([(3, "HBO", 4), (50, "hbw", 12), (None, "7", 18), (None, "11", 9), (None, None, None)], "reason int, name string, mode int")
    got = df.select(codes.purpose(F.col("reason"), F.col("name")), codes.transport_mode(F.col("mode"))).collect()
    assert [tuple(r) for r in got] == [(2, "PRIVATE_VEHICLE"), (2, "PUBLIC_TRANSIT"), (7, "ACTIVE"), (None, None), (None, None)]


def test_tails_against_known_values():
    assert significance.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert significance.chi2_tail(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert significance.chi2_tail(11.070498, 5) == pytest.approx(0.05, abs=1e-6)
    assert significance.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert significance.f_tail(2.866081, 4, 20) == pytest.approx(0.05, abs=1e-6)
    assert significance.f_tail(0.5, 4, 20) > 0.5 and significance.f_tail(1.0, 50, 50) == pytest.approx(0.5)
    assert significance.f_tail(4.0, 2, 1e6) == pytest.approx(math.exp(-4.0), rel=1e-4)


def test_signed_rank_tail_against_all_subsets():
    for n, w in ((5, 15.0), (6, 18.5), (8, 26.0), (0, 0.0)):
        sums = [sum(r for r in range(1, n + 1) if s >> (r - 1) & 1) for s in range(2**n)]
        want = 1.0 if n == 0 else min(2 * sum(x >= w for x in sums) / 2**n, 1.0)
        assert significance.signed_rank_tail(n, w) == want
    assert significance.signed_rank_tail(100, 100 * 101 / 4) == 1.0 and significance.signed_rank_tail(100, 5050.0) < 1e-15


def test_friedman_p_of_a_clear_winner_and_of_ties(spark):
    clear = spark.createDataFrame([(d, m, s + d % 3 / 1000) for d in range(20) for m, s in (("a", 0.9), ("b", 0.7), ("c", 0.5))], "dataset int, method string, score double")
    r = one(significance.friedman_p(significance.friedman(significance.ranked(clear))))
    assert r.p_f is None and r.p == r.p_chi2 < 1e-6 and r.reject
    even = spark.createDataFrame([(d, m, float((d + i) % 3)) for d in range(12) for i, m in enumerate("abc")], "dataset int, method string, score double")
    r = one(significance.friedman_p(significance.friedman(significance.ranked(even))))
    assert r.p == pytest.approx(1.0) and not r.reject


def test_sample_window_finds_a_shift_and_can_be_set():
    rng = random.Random(6)
    d = drift.SampleWindow(100, 0.001)
    assert sum(d.add(rng.gauss(0, 1)) for _ in range(1100)) <= 5
    assert any(d.add(rng.gauss(3, 1)) for _ in range(100))
    with pytest.raises(ValueError):
        d.set_reference([1.0])
    d.reset()
    with pytest.raises(ValueError):
        d.promote()
    for x in range(200):
        d.add(float(x % 100))
    assert d.p_value() == 1.0
    with pytest.raises(ValueError):
        drift.WeightedMean(0.01, 0.001)


def test_weighted_mean_warns_before_it_alarms():
    d, seen = drift.WeightedMean(1e-6, 0.05), []
    for i in range(400):
        changed = d.add(float(i % 10 == 0) if i < 300 else 1.0)
        seen.append("C" if changed else "W" if d.warning else "-")
    late = "".join(seen[300:])
    assert "C" in late and "W" in late[: late.index("C")]


def test_evolving_selection(spark):
    def period(n, **score):
        return [(0, n, f, s, f == "b" and n == 4) for f, s in score.items()]

    rows = period(1, a=0.9, b=0.8, c=0.1, d=0.2) + period(2, a=0.1, b=0.2, c=0.9, d=0.8) + period(3, a=0.1, b=0.3, c=0.9, d=0.2) + period(4, a=0.5, b=0.3, c=0.9, d=0.4)
    scored = spark.createDataFrame(rows, "run int, period int, feature string, chi2 double, drift boolean")
    got = {r.period: (r.selected, r.n_swapped) for r in adaptive.evolving_selection(scored, 2).collect()}
    assert got == {1: (["a", "b"], 0), 2: (["b", "c"], 1), 3: (["b", "c"], 0), 4: (["a", "c"], 1)}
    held = {r.period: r.selected for r in adaptive.evolving_selection(scored.drop("drift"), 2, tenure=9).collect()}
    assert set(map(tuple, held.values())) == {("a", "b")}
    assert adaptive.evolving_selection(scored.where("false"), 2).count() == 0


def test_split_gains_against_brute_force(spark):
    rng = random.Random(7)
    data = [(rng.randint(0, 5), rng.randint(0, 1)) for _ in range(80)]
    cells = [("f", b, *(sum(d == (b, c) for d in data) for c in (0, 1))) for b in range(6)]

    def entropy(part):
        return -sum(q * math.log2(q) for c in (0, 1) if part and (q := sum(y == c for _, y in part) / len(part)))

    def gain(cut):
        left, right = [d for d in data if d[0] <= cut], [d for d in data if d[0] > cut]
        return entropy(data) - sum(len(s) / len(data) * entropy(s) for s in (left, right))

    r = one(trees.split_gains(spark.createDataFrame(cells, "feature string, bin int, c0 long, c1 long"), 2))
    assert r.gain == pytest.approx(max(map(gain, range(6))), abs=1e-8) and gain(r.cut) == pytest.approx(r.gain, abs=1e-8)


@pytest.mark.parametrize("growth", [trees.Growth(), trees.forest(3, 5), trees.patches(3, 5)])
def test_trees_learn(spark, growth):
    stream = generators.sea(spark, 1, 8000).where("seq < 2000")
    model = trees.fit(stream.where("seq < 1500"), ["x0", "x1", "x2"], 2, growth)
    tested = trees.predict(model, stream.where("seq >= 1500"))
    assert one(tested.agg(F.count_if(F.col("p") == F.col("y")).alias("n"))).n >= 375


def test_trees_of_nothing_and_weights(spark):
    rows = spark.createDataFrame([(0, i, i % 2, float(i % 2), None) for i in range(600)], "run int, seq long, y int, a double, b double")
    empty = trees.fit(rows.where("false"), ["a", "b"], 2)
    assert {r.p for r in trees.predict(empty, rows).collect()} == {0}
    two = trees.fit(rows, ["a", "b"], 2, trees.Growth(learners=2, subspace=1, seed=next(s for s in range(1, 99) if trees.subspaces(2, trees.Growth(learners=2, subspace=1, seed=s)) == [[0], [1]])))
    right = lambda w: one(trees.predict(two, rows, w).agg(F.avg((F.col("p") == F.col("y")).cast("int")).alias("a"))).a
    assert right([1.0, 0.0]) == 1.0 and right([0.0, 1.0]) == 0.5
    with pytest.raises(ValueError):
        trees.Growth(delta=0)


def test_poisson_quantiles(spark):
    got = one(spark.range(20_000).agg(F.avg(trees.poisson(6.0, generators.uniform(3, F.col("id")))).alias("m")))
    assert got.m == pytest.approx(6.0, abs=0.1)


def test_radial_centres_drift(spark):
    still, moving = (generators.radial(spark, 1, 400, 3, 4, n, 0.01) for n in (0, 4))
    assert still.columns == ["run", "seq", "x0", "x1", "x2", "y"] and still.count() == 400
    assert still.exceptAll(generators.radial(spark, 1, 400, 3, 4, 0, 0.01)).count() == 0
    assert still.where("seq > 0").exceptAll(moving).count() == 399


def test_recovery_limit(spark):
    rows = spark.createDataFrame([(0, i, m) for i, m in enumerate([0.9] + [0.4] * 50 + [0.9])], "run int, seq int, accuracy double")
    assert one(prequential.recovery(rows, F.col("seq") == 0)).recovered_after == 51
    assert one(prequential.recovery(rows, F.col("seq") == 0, limit=50)).recovered_after is None


def test_write_ranks(spark, tmp_path):
    df = spark.createDataFrame([('b"q', 2.0), ("a,c", 1.0)], "method string, rank double")
    tables.write_ranks(df, f"file://{tmp_path}/r", ["lower is better"], ["rank"])
    head = [r.value for r in spark.read.text(f"file://{tmp_path}/r/header").collect()]
    body = sorted(r.value for r in spark.read.text(f"file://{tmp_path}/r/data").collect())
    assert head == ["# lower is better", "method,rank"] and body == ['"a,c",1.0', '"b""q",2.0']


def test_two_level_tells_which_features_drift(spark, tmp_path):
    rng = random.Random(8)
    rows = [(0, i, int(rng.random() < (0.1 if i < 600 else 0.8)), 0, rng.gauss(0, 1), rng.gauss(4 if i >= 600 else 0, 1), rng.gauss(0, 1)) for i in range(900)]
    whole, want = drift.TwoLevel(3, 50), []
    for _, seq, y, p, *xs in rows:
        found = whole.add(float(y != p), xs)
        if found is not None:
            want.append((seq, ["abc"[i] for i in found]))
    assert want and "b" in want[0][1] and want[0][0] >= 600
    schema = "run int, seq long, y int, p int, a double, b double, c double"
    for part in range(3):  # one file a micro-batch: the state carries over
        spark.createDataFrame(rows[part * 300 : part * 300 + 300], schema).coalesce(1).write.parquet(f"file://{tmp_path}/s/part={part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/s/part=*")
    got = sorted((r.seq, list(r.drifting)) for r in live.finished(live.two_level_alarms(stream, ["a", "b", "c"], 50), "append").collect())
    assert got == want
