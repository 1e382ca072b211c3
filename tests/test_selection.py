from pyspark.sql import functions as F

from tunemill.functions import ranks
from tunemill.functions.prefix import prefix_sums
from tunemill.functions.ranks import global_rank, nth_values
from tunemill.operators import scoring, selection

INF = float("inf")


def test_prefix_sums_equal_a_plain_window(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), (F.col("id") * 7919 % 4096).alias("slot"), "id", (F.col("id") % 13).alias("v"))
    for groups in (1, 40, 4000):
        got = prefix_sums(rows, ["k"], "slot", 12, groups, ["id"], "v", "before").collect()
        seen = {}
        for r in sorted(got, key=lambda r: (r.k, r.slot, r.id)):
            assert r.before == seen.get(r.k, 0)
            seen[r.k] = seen.get(r.k, 0) + r.v


def test_global_rank_and_nth(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 101).alias("x"), "id")
    got = global_rank(rows, [F.desc("x"), F.asc("id")]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.x, r.id))] == list(range(1000))
    eight = spark.createDataFrame([(float(i),) for i in range(8)], "v double")
    assert tuple(nth_values(eight, "v", a=0.25, b=0.5).first()) == (2.0, 4.0)


def test_filter_choices(spark):
    df = spark.createDataFrame([(1, 7321.0, 6.5, 90), (2, 31.0, 2750.0, 77), (3, float("nan"), float("nan"), 64), (4, 1.0, 1.0, 4)], "sample long, ppl double, response_ppl double, length long")
    kept = lambda **k: sorted(r.sample for r in selection.filter_samples(df, **k).filter("reason is null").collect())
    assert kept() == [1, 3] and kept(use="full") == [2, 3] and kept(max_ppl=0) == [1, 2, 3]
    assert {r.sample: r.reason for r in selection.filter_samples(df).collect()}[4] == "too_easy"


def test_mix_by_budget():
    for b in (500, 5000, 40000):
        assert abs(sum(selection.optimal_mix(b)) - 1) < 1e-9
    assert selection.optimal_mix(500)[3] == 0 and selection.optimal_mix(40000) == (0.20, 0.50, 0.25, 0.05)


def test_back_fill(spark):
    rows = [(i, float(i), "easy" if i <= 5 else "medium" if i <= 300 else "hard") for i in range(1, 401)]
    df = spark.createDataFrame(rows, "sample long, response_ppl double, bucket string")
    out = selection.select_by_budget(df, 200).collect()
    assert len(out) == len({r.sample for r in out}) == 200 and all(0 <= r.flow_weight <= 1 for r in out)
    assert selection.select_by_budget(df, 400).columns == df.columns


def test_strategies(spark):
    rows = [(i, float(i % 50), ("easy", "medium", "hard")[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "sample long, response_ppl double, bucket string")
    for s in ("balanced", "medium_focus", "curriculum", "hard_focus", "flow", "random"):
        out = selection.select_by_budget(df, 20, s).collect()
        assert len({r.sample for r in out}) == 20
    ranked = selection.select_by_budget(df, 20, "curriculum").orderBy("score_rank").collect()
    assert [r.response_ppl for r in ranked] == sorted(r.response_ppl for r in ranked)


def test_budgets_beyond_a_task_choose_the_same_rows(spark, monkeypatch):
    rows = [(i, float(i * 37 % 50), ("easy", "medium", "hard")[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "sample long, response_ppl double, bucket string")
    chosen = lambda: {s: sorted(map(tuple, selection.select_by_budget(df, 90, s).collect())) for s in ("medium_focus", "hard_focus", "flow", "random")}
    want = chosen()
    monkeypatch.setattr(ranks, "WINDOW_ROWS", 20)
    assert chosen() == want
    plan = selection.select_by_budget(df, 90, "hard_focus")._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "SinglePartition" not in plan.split("Window [")[0]


def test_holdout(spark):
    df = spark.range(20).withColumnRenamed("id", "sample")
    count = lambda n: selection.holdout(df, n).filter("held_out").count()
    assert (count(5), count(0), count(50)) == (5, 0, 0)
    assert selection.holdout(df, 5).orderBy("sample").collect() == selection.holdout(df, 5).orderBy("sample").collect()


def test_unscoreable_and_hes(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.sample: (r.length, r.ppl) for r in scoring.score(docs).collect()}
    assert got[1][0] == 4 and got[2] == got[3] == got[4] == (0, INF)
    values = [0.1 * (i % 5) for i in range(100)] + [3.5, 4.2, 3.8, 4.0, 3.3]
    one = spark.createDataFrame([(values, [2.0] * 100, [1.0] * 4)], "a array<double>, b array<double>, c array<double>")
    top = one.select(scoring.top_entropy_sum(F.col("a"), 0.5), scoring.top_entropy_sum(F.col("a"), 5.0), scoring.top_entropy_sum(F.col("b"), 5.0), scoring.top_entropy_sum(F.col("c"), 5.0)).first()
    assert [round(x, 6) for x in top] == [4.2, 18.8, 10.0, 0.0]


def test_manifest_has_the_median_of_positive_hes(spark):
    rows = [("a", 3.0, "easy", h) for h in (0.0, 1.0, 4.0, 2.0, 3.0)] + [("b", 30.0, "hard", 0.0), ("c", 9.0, "medium", None)]
    df = spark.createDataFrame(rows, "source string, response_ppl double, bucket string, hes double")
    got = {r.source: (r.median_hes, r.overfit_risk, r.num_samples) for r in selection.source_manifest(df).collect()}
    assert got == {"a": (3.0, "high", 5), "b": (0.0, "low", 1), "c": (0.0, "medium", 1)}
    assert "median_hes" not in selection.source_manifest(df.drop("hes")).columns
