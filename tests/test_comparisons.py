import math
import random

import pytest
from pyspark.sql import functions as F

from tickweave.contract import constant
from tickweave.functions.stats import sign_test_p
from tickweave.operators import campaign, outcomes


def scores(spark, given):
    """{model: {budget: [score or None]}} as rows."""
    rows = [(m, r, b, s) for m, budgets in given.items() for b, values in budgets.items() for r, s in enumerate(values)]
    return spark.createDataFrame(rows, "model string, replicate bigint, budget bigint, score double")


def comparison(spark):
    return constant(spark, [("c", "A", "B")], "comparison string, candidate string, comparator string")


def test_pair_truth_table(spark):
    a, b = [1.0, 2.0, 1.0, None, 1.0, None], [2.0, 1.0, 1.0, 1.0, None, None]
    got = {r["replicate"]: (r["kind"], r["winner"], r["difference"]) for r in outcomes.pairs(scores(spark, {"A": {2: a}, "B": {2: b}}), comparison(spark)).collect()}
    assert got == {
        0: ("both completed", "candidate", 1.0), 1: ("both completed", "comparator", -1.0), 2: ("both completed", None, 0.0),
        3: ("only the comparator completed", "comparator", None), 4: ("only the candidate completed", "candidate", None), 5: ("both failed", None, None),
    }


def test_sign_test_values():
    assert sign_test_p(0, 0) == 1.0 and sign_test_p(10, 10) == 2.0**-10 and sign_test_p(9, 10) == 11 / 1024 and sign_test_p(0, 5) == 1.0


def labels_by_loops(summary, order, alpha, delta, minimum):
    """The fixed-sequence rule worked out by loops, for random patterns."""
    tested, rejected = dict.fromkeys(order, False), {b: {} for b in order}
    for d in ("candidate", "comparator"):
        for b in order:
            tested[b] = True
            if summary[b][f"p_{d}"] > alpha / 2:
                break
            rejected[b][d] = True
    labels = []
    for b in order:
        s, d = summary[b], next(iter(rejected[b]), None)
        if not tested[b]:
            labels.append("not tested")
        elif d is None:
            labels.append("no decision")
        else:
            m = s["median_difference"]
            size = ("magnitude not computable" if s["n_both"] == 0 else "magnitude not established" if s["n_both"] < minimum
                    else "relevant" if (m if d == "candidate" else -m) >= delta else "below the relevance margin")
            labels.append(f"{d} better, {size}")
    return labels


def test_ordered_family_on_random_patterns(spark):
    rng, order = random.Random(11), [20, 10, 5, 2]
    draw = lambda shift: [None if rng.random() < 0.1 else rng.gauss(shift, 1) for _ in range(10)]
    given, names = {}, []
    for i in range(25):
        given[f"A{i}"], given[f"B{i}"] = {b: draw(-1.2) for b in order}, {b: draw(0.4 if i % 2 else -2.5) for b in order}
        names.append((f"c{i}", f"A{i}", f"B{i}"))
    paired = outcomes.pairs(scores(spark, given), constant(spark, names, "comparison string, candidate string, comparator string"))
    summary = outcomes.budget_summary(paired)
    decisions = outcomes.ordered_decisions(summary, order, 0.1, 0.5, 6).orderBy("comparison", "position").collect()
    verdicts = {r["comparison"]: r for r in outcomes.ordered_verdicts(outcomes.ordered_decisions(summary, order, 0.1, 0.5, 6)).collect()}
    by = {}
    for r in summary.collect():
        by.setdefault(r["comparison"], {})[r["budget"]] = r
    for c, *_ in names:
        rows = [r for r in decisions if r["comparison"] == c]
        assert [r["label"] for r in rows] == labels_by_loops(by[c], order, 0.1, 0.5, 6)
        gate = rows[0]["counts_for"]
        expected = "supported" if gate == "candidate" else "contradicted" if gate == "comparator" else "difference below the relevance margin" if rows[0]["direction"] else "no confirmatory decision"
        assert verdicts[c]["verdict"] == expected
    assert len({v["verdict"] for v in verdicts.values()}) >= 2


def test_levels_and_margins_outside_their_domain(spark):
    summary = outcomes.budget_summary(outcomes.pairs(scores(spark, {"A": {2: [1.0]}, "B": {2: [2.0]}}), comparison(spark)))
    for alpha in (0.0, 1.0, -0.1, math.nan, True, "0.05"):
        with pytest.raises(ValueError):
            outcomes.ordered_decisions(summary, [2], alpha, 0.0, 1)
    for delta in (-1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            outcomes.unordered_decisions(summary, [2], 0.05, delta, 1)
    with pytest.raises(ValueError):
        outcomes.ordered_decisions(summary, [2, 2], 0.05, 0.0, 1)


def test_mean_ranks_put_failures_last_and_share_ties(spark):
    got = {r["model"]: r["mean_rank"] for r in outcomes.mean_ranks(scores(spark, {"A": {2: [1.0, None]}, "B": {2: [1.0, 3.0]}, "C": {2: [None, None]}})).collect()}
    assert got == {"A": (1.5 + 2.5) / 2, "B": (1.5 + 1.0) / 2, "C": (3.0 + 2.5) / 2}


def test_rank_agreement(spark):
    rank = lambda values: spark.createDataFrame([("g", m, float(v)) for m, v in zip("abcd", values)], "g string, model string, rank double")
    tau = lambda x, y: outcomes.rank_agreement(rank(x), rank(y), ["g"]).collect()[0]
    assert tau([1, 2, 3, 4], [1, 2, 3, 4])["tau_b"] == 1.0 and tau([1, 2, 3, 4], [4, 3, 2, 1])["tau_b"] == -1.0
    assert tau([1, 2.5, 2.5, 4], [1, 2, 3, 4])["tau_b"] == pytest.approx(5 / math.sqrt(5 * 6))
    assert tau([2, 2, 2, 2], [1, 2, 3, 4])["tau_b"] is None


def test_outcomes_keep_failures(spark):
    attempts = spark.createDataFrame([("m", 0, 2, None), ("m", 1, 2, None), ("m", 2, 2, "diverged")], "model string, replicate bigint, budget bigint, training_failure string")
    results = spark.createDataFrame([("m", 0, 2, 3.0, None, 0), ("m", 0, 2, 4.0, None, 2), ("m", 1, 2, 1.0, None, 0), ("m", 1, 2, None, "work limit", 0)],
                                    "model string, replicate bigint, budget bigint, j double, failure string, violations bigint")
    found = outcomes.replicate_outcomes(attempts, results)
    got = {r["replicate"]: (r["score"], r["conditional_score"], r["failed_windows"]) for r in found.collect()}
    assert got == {0: (pytest.approx(math.sqrt(12.5)), pytest.approx(math.sqrt(12.5)), 0), 1: (None, 1.0, 1), 2: (None, None, 0)}
    (row,) = outcomes.failure_table(found).collect()
    assert (row["replicates"], row["scored"], row["training_failures"], row["with_integration_failures"], row["with_violations"]) == (3, 1, 1, 1, 1)
    assert outcomes.inconsistent_outcomes(found).collect() == []


def test_campaign_of_one_replicate(spark):
    replicates = spark.createDataFrame([("A10", 0, "r0"), ("A5", 0, "s0")], "condition string, replicate bigint, run_id string")
    tasks = campaign.declared_tasks(replicates, {"A10": (2, 10), "A5": (2,)}, {"primary": ("MR_F", "MR", "BL"), "held": ("MR_F", "MR")}, {"HK": 2, "BN": 1}, "A10", (10,), ("HK",))
    keys = {r["key"] for r in tasks.collect()}
    assert len(keys) == 6 + 6 + 4 + 6 and {"A10/r00/b10/held/HK/1", "A10/r00/b10/held/MR_F", "A5/r00/b02/primary/BN/0"} <= keys
    records = tasks.where("key <> 'A5/r00/b02/primary/BN/0'").select("condition", "key")
    got = {r["condition"]: (r["missing"], r["complete"]) for r in campaign.coverage(tasks, records.unionByName(records.where("key LIKE '%BL'"))).collect()}
    assert got == {"A10": (0, False), "A5": (1, False)}


def test_selection_takes_the_first_declared_on_a_tie(spark):
    rows = [("f", "training", 0, "f/0", 2.0, None, 1.0), ("f", "training", 1, "f/1", 1.0, None, 1.0), ("f", "training", 2, "f/2", 1.0, None, 1.0), ("f", "training", 3, "f/3", 0.5, "failed", 1.0),
            ("g", "training", 0, "g/0", 1.0, "failed", 2.0)]
    records = spark.createDataFrame(rows, "family_key string, kind string, index int, key string, criterion double, failure string, seconds double")
    got = {r["family_key"]: (r["selected"], r["n_failed"], r["seconds"], r["failure"]) for r in campaign.selections(records).collect()}
    assert got == {"f": ("f/1", 1, 4.0, None), "g": (None, 1, 2.0, "every configuration failed")}


def test_a_family_that_lacks_something_is_refused(spark):
    given = {"A": {2: [1.0, 2.0], 5: [1.0, 1.0]}, "B": {2: [3.0], 5: [2.0, 2.0]}}
    paired = outcomes.pairs(scores(spark, given), comparison(spark))
    assert sorted((r["budget"], r["replicate"], r["kind"]) for r in paired.where("kind = 'a model lacks a replicate'").collect()) == [(2, 1, "a model lacks a replicate")]
    summary = outcomes.budget_summary(paired)
    for budgets, why in (([2, 5], "a model lacks a replicate"), ([2, 5, 10], "a declared budget without results"), ([5], "a budget that is not declared")):
        for decided, verdicts in ((outcomes.ordered_decisions(summary, budgets, 0.1, 0.0, 1), outcomes.ordered_verdicts), (outcomes.unordered_decisions(summary, budgets, 0.1, 0.0, 1), outcomes.unordered_verdicts)):
            assert {r["label"] for r in decided.collect()} == {f"refused: {why}"}
            assert [r["verdict"] for r in verdicts(decided).collect()] == ["refused"]


FACTORS = ({"A10": (2, 10)}, {"primary": ("MR_F",), "held": ("MR_F",)}, {"HK": 2}, "A10", (10,), ("HK",))


def test_starts_of_exploded_tasks_are_not_broadcast(spark):
    replicates = spark.createDataFrame([("A10", 0, "r0")], "condition string, replicate bigint, run_id string")
    tasks = campaign.declared_tasks(replicates, *FACTORS)
    states = campaign.blocked_tasks(tasks, tasks.where("key LIKE '%b02%'").select("key", F.lit("no start").alias("failure")))
    assert "BroadcastHashJoin" not in states._jdf.queryExecution().executedPlan().toString()
    assert {(r["key"], r["state"]) for r in states.collect()} == {
        (f"A10/r00/{head}/HK/{i}", state) for head, state in (("b02/primary", "blocked"), ("b10/primary", "waiting"), ("b10/held", "waiting")) for i in (0, 1)
    }


def test_replicates_are_spread_before_they_are_expanded(spark, monkeypatch):
    monkeypatch.setattr(campaign, "SPREAD", 10)
    replicates = spark.range(35).coalesce(1).selectExpr("'A10' AS condition", "id AS replicate", "concat('r', id) AS run_id")
    tasks = campaign.declared_tasks(replicates, *FACTORS)
    assert tasks.rdd.getNumPartitions() == 4 and tasks.count() == 35 * 9
