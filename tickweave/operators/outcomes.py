"""Outcomes of replicates and paired comparisons. A failure is a null score that stays in
every count: it loses to a score, ties with a failure, ranks last, and is never imputed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import not_finite
from tickweave.functions.stats import root_mean_square, sign_test
from tickweave.plans.medians import grouped_median

CANDIDATE, COMPARATOR = "candidate", "comparator"
# The words of the labels.
BOTH, ONLY_CANDIDATE, ONLY_COMPARATOR, NEITHER = (
    "both completed", "only the candidate completed", "only the comparator completed", "both failed",
)
ABSENT = "a model lacks a replicate"
UNDECLARED, WITHOUT_RESULTS, REFUSED = "a budget that is not declared", "a declared budget without results", "refused"
RELEVANT, BELOW_MARGIN = "relevant", "below the relevance margin"
NOT_ESTABLISHED, NOT_COMPUTABLE = "magnitude not established", "magnitude not computable"
SUPPORTED, CONTRADICTED, BUDGET_DEPENDENT = "supported", "contradicted", "budget-dependent"
BELOW, NO_DECISION = "difference below the relevance margin", "no confirmatory decision"
REPLICATE = ["model", "replicate", "budget"]


def replicate_outcomes(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """One row per attempt. ``attempts``: (model, replicate, budget, training_failure);
    ``results``: one row per window, (.., j, failure, violations). The primary score exists
    only if the model was trained and every window completed; the score over the windows
    that completed is kept apart. All windows have one layout, so J pools as a root mean
    square of the windows."""
    done = F.col("failure").isNull()
    per = results.groupBy(*REPLICATE).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(~done).alias("failed_windows"),
        root_mean_square(F.when(done, F.col("j"))).alias("_j"), F.sum(F.when(done, F.col("violations")).otherwise(0)).alias("violations"),
    )
    joined = attempts.join(per, REPLICATE, "left")
    trained = F.col("training_failure").isNull()
    completed = trained & (F.col("failed_windows") == 0) & (F.col("windows") > 0)
    return joined.select(
        *REPLICATE, "training_failure", F.coalesce("windows", F.lit(0)).alias("windows"),
        F.coalesce("failed_windows", F.lit(0)).alias("failed_windows"), F.coalesce("violations", F.lit(0)).alias("violations"),
        F.when(completed, F.col("_j")).alias("score"), F.when(trained, F.col("_j")).alias("conditional_score"),
    )


def inconsistent_outcomes(outcomes: DataFrame) -> DataFrame:
    """(.., problem): outcomes that contradict themselves."""
    trained = F.col("training_failure").isNull()
    problems = F.array_compact(
        F.array(
            F.when(F.col("score").isNotNull() != (trained & (F.col("failed_windows") == 0)), "primary score"),
            F.when(~trained & ((F.col("failed_windows") > 0) | (F.col("violations") > 0)), "rollouts without a model"),
            F.when(F.col("failed_windows") > F.col("windows"), "more failed windows than windows"),
        )
    )
    return outcomes.select(*REPLICATE, F.explode(problems).alias("problem"))


def failure_table(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("model", "budget").agg(
        F.count(F.lit(1)).alias("replicates"), F.count("score").alias("scored"), F.count("training_failure").alias("training_failures"),
        F.count_if(F.col("failed_windows") > 0).alias("with_integration_failures"), F.sum("failed_windows").alias("failed_windows"),
        F.count_if(F.col("violations") > 0).alias("with_violations"),
    )


def paired_outcome(first: Column, second: Column) -> Column:
    """``first``, ``second`` or ``tie``; null is a failure."""
    return (
        F.when(first.isNull() & second.isNull(), "tie").when(first.isNull(), "second").when(second.isNull(), "first")
        .when(first < second, "first").when(second < first, "second").otherwise("tie")
    )


def pairs(scores: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per comparison, budget and replicate. ``comparisons``: (comparison, candidate,
    comparator), declared. The two models of a comparison meet on (comparison, budget,
    replicate); models are never paired beyond what is declared. A replicate that one of them
    lacks keeps its row, of the kind ``ABSENT``; no decision is made on its comparison."""
    a = scores.join(comparisons, scores["model"] == comparisons["candidate"]).select("comparison", "budget", "replicate", F.col("score").alias("a"), F.lit(True).alias("has_a"))
    b = scores.join(comparisons, scores["model"] == comparisons["comparator"]).select("comparison", "budget", "replicate", F.col("score").alias("b"), F.lit(True).alias("has_b"))
    order = paired_outcome(F.col("a"), F.col("b"))
    met = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    kind = (
        F.when(~met, ABSENT).when(F.col("a").isNull() & F.col("b").isNull(), NEITHER).when(F.col("b").isNull(), ONLY_CANDIDATE)
        .when(F.col("a").isNull(), ONLY_COMPARATOR).otherwise(BOTH)
    )
    return a.join(b, ["comparison", "budget", "replicate"], "full").select(
        "comparison", "budget", "replicate", kind.alias("kind"),
        F.when(met & (order == "first"), CANDIDATE).when(met & (order == "second"), COMPARATOR).alias("winner"), (F.col("b") - F.col("a")).alias("difference"),
    )


def paired_counts(paired: DataFrame) -> DataFrame:
    return paired.groupBy("comparison").agg(
        F.count_if(F.col("winner") == CANDIDATE).alias("first_wins"), F.count_if(F.col("winner") == COMPARATOR).alias("second_wins"),
        F.count_if(F.col("winner").isNull() & (F.col("kind") != ABSENT)).alias("ties"), F.count_if(F.col("kind") == NEITHER).alias("both_failed"),
    )


def budget_summary(paired: DataFrame) -> DataFrame:
    """Wins, losses, ties, the exact median of the differences and both sign-test p-values."""
    keys = ["comparison", "budget"]
    counts = paired.groupBy(*keys).agg(
        F.count_if(F.col("winner") == CANDIDATE).alias("wins"), F.count_if(F.col("winner") == COMPARATOR).alias("losses"),
        F.count_if(F.col("winner").isNull() & (F.col("kind") != ABSENT)).alias("ties"), F.count("difference").alias("n_both"), F.count(F.lit(1)).alias("replicates"),
        F.count_if(F.col("kind") == ABSENT).alias("absent"),
    )
    trials = F.col("wins") + F.col("losses")
    middle = grouped_median(paired, keys, "difference", "median_difference")
    return counts.join(middle, keys, "left").select(
        "*", sign_test(F.col("wins"), trials).alias("p_candidate"), sign_test(F.col("losses"), trials).alias("p_comparator")
    )


def _level(alpha: float) -> float:
    if isinstance(alpha, bool) or not isinstance(alpha, int | float) or not math.isfinite(alpha) or not 0.0 < alpha < 1.0:
        raise ValueError(f"a family level lies strictly between 0 and 1, got {alpha!r}")
    return float(alpha)


def _margin(delta: float) -> float:
    if isinstance(delta, bool) or not isinstance(delta, int | float) or not math.isfinite(delta) or delta < 0.0:
        raise ValueError(f"a margin is a finite number, zero or more, got {delta!r}")
    return float(delta)


def _refusal(summary: DataFrame, budgets: list[int]) -> DataFrame:
    """``position`` of each budget among the declared ones, 0 for others, and ``refused``: why no
    decision is made on its comparison. The budgets of a comparison are few, so a window over
    them is small."""
    position = F.array_position(F.array(*[F.lit(int(b)).cast("long") for b in budgets]), F.col("budget").cast("long"))
    own = Window.partitionBy("comparison")
    rows = summary.withColumn("position", position)
    problem = (
        F.when(F.max(F.col("position") == 0).over(own), UNDECLARED)
        .when(F.count_if(F.col("position") > 0).over(own) < len(budgets), WITHOUT_RESULTS)
        .when(F.max(F.col("absent") > 0).over(own), ABSENT)
    )
    return rows.withColumn("refused", problem)


def _decided(tested: DataFrame, delta: float, minimum: int) -> DataFrame:
    """Direction, magnitude, what the budget counts for, and its label. Nothing is decided
    where the comparison is refused."""
    for name in ("rejects_candidate", "rejects_comparator", "tested"):
        tested = tested.withColumn(name, F.col("refused").isNull() & F.col(name))
    direction = F.when(F.col("rejects_candidate"), CANDIDATE).when(F.col("rejects_comparator"), COMPARATOR)
    oriented = F.when(F.col("direction") == CANDIDATE, F.col("median_difference")).otherwise(-F.col("median_difference"))
    magnitude = F.when(
        F.col("direction").isNotNull(),
        F.when(F.col("n_both") == 0, NOT_COMPUTABLE).when(F.col("n_both") < minimum, NOT_ESTABLISHED)
        .when(oriented >= delta, RELEVANT).otherwise(BELOW_MARGIN),
    )
    label = (
        F.when(F.col("refused").isNotNull(), F.concat(F.lit("refused: "), "refused")).when(~F.col("tested"), "not tested").when(F.col("direction").isNull(), "no decision")
        .otherwise(F.concat(F.col("direction"), F.lit(" better, "), F.col("magnitude")))
    )
    decided = tested.withColumn("direction", direction).withColumn("magnitude", magnitude)
    return decided.withColumn("counts_for", F.when(F.col("magnitude") != BELOW_MARGIN, F.col("direction"))).withColumn("label", label)


def ordered_decisions(summary: DataFrame, order: dict[int, int] | list[int], alpha_family: float, delta: float, minimum_complete: int) -> DataFrame:
    """Fixed-sequence test per direction at half the level: a budget is tested in a direction
    only if every budget before it was rejected. A comparison whose budgets are not exactly
    those of the order, or that lacks a replicate, is refused as a whole."""
    level, margin = _level(alpha_family) / 2, _margin(delta)
    order = list(order)
    if not order or len(set(order)) != len(order) or minimum_complete < 1:
        raise ValueError(f"budgets must be distinct and given, and the minimum at least 1: {order!r}, {minimum_complete!r}")
    rows = _refusal(summary, order)
    w = Window.partitionBy("comparison").orderBy("position")
    earlier, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for d in (CANDIDATE, COMPARATOR):
        rows = rows.withColumn(f"_r_{d}", F.col(f"p_{d}") <= level)
    tested = rows.select(
        *rows.columns, *[F.min(f"_r_{d}").over(upto).alias(f"rejects_{d}") for d in (CANDIDATE, COMPARATOR)],
        (F.coalesce(F.min(f"_r_{CANDIDATE}").over(earlier), F.lit(True)) | F.coalesce(F.min(f"_r_{COMPARATOR}").over(earlier), F.lit(True))).alias("tested"),
    )
    return _decided(tested, margin, minimum_complete).drop(f"_r_{CANDIDATE}", f"_r_{COMPARATOR}")


def ordered_verdicts(decisions: DataFrame) -> DataFrame:
    """Supported or contradicted at the first budget or not at all; the supported range runs
    from it while the budgets count for the candidate."""
    w = Window.partitionBy("comparison").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.min(F.coalesce(F.col("counts_for") == CANDIDATE, F.lit(False))).over(w)
    rows = decisions.withColumn("_run", run)
    first = F.col("position") == 1

    def listed(condition: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.when(condition, F.struct("position", "budget"))))
        return F.array_join(F.transform(entries, lambda e: e["budget"].cast("string")), ",")

    grouped = rows.groupBy("comparison").agg(
        F.max(F.when(first, F.col("counts_for"))).alias("_counts"), F.max(F.when(first, F.col("direction"))).alias("_direction"),
        listed(F.col("_run")).alias("_supported"), listed(first).alias("_gate"), F.max("refused").alias("_refused"),
    )
    verdict = (
        F.when(F.col("_refused").isNotNull(), REFUSED).when(F.col("_counts") == CANDIDATE, SUPPORTED).when(F.col("_counts") == COMPARATOR, CONTRADICTED)
        .when(F.col("_direction").isNotNull(), BELOW).otherwise(NO_DECISION)
    )
    budgets = F.when(verdict == SUPPORTED, F.col("_supported")).when(verdict.isin(NO_DECISION, REFUSED), "").otherwise(F.col("_gate"))
    return grouped.select("comparison", verdict.alias("verdict"), budgets.alias("budgets"))


def unordered_decisions(summary: DataFrame, budgets: list[int], alpha_family: float, delta: float, minimum_complete: int) -> DataFrame:
    """Every declared budget in both directions, by Bonferroni; refused like an ordered family."""
    budgets = list(budgets)
    if not budgets or len(set(budgets)) != len(budgets):
        raise ValueError(f"budgets must be distinct and given: {budgets!r}")
    level, margin = _level(alpha_family) / (2 * len(budgets)), _margin(delta)
    tested = _refusal(summary, budgets).select(
        "*", (F.col("p_candidate") <= level).alias("rejects_candidate"), (F.col("p_comparator") <= level).alias("rejects_comparator"), F.lit(True).alias("tested")
    )
    return _decided(tested, margin, minimum_complete)


def unordered_verdicts(decisions: DataFrame) -> DataFrame:
    def listed(condition: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.when(condition, F.col("budget"))))
        return F.array_join(F.transform(entries, lambda b: b.cast("string")), ",")

    grouped = decisions.groupBy("comparison").agg(
        listed(F.col("counts_for") == CANDIDATE).alias("_for"), listed(F.col("counts_for") == COMPARATOR).alias("_against"),
        listed(F.col("direction").isNotNull()).alias("_detected"),
        F.max("refused").alias("_refused"),
    )
    some, against, detected = F.col("_for") != "", F.col("_against") != "", F.col("_detected") != ""
    verdict = (
        F.when(F.col("_refused").isNotNull(), REFUSED).when(some & against, BUDGET_DEPENDENT).when(some, SUPPORTED).when(against, CONTRADICTED).when(detected, BELOW).otherwise(NO_DECISION)
    )
    budgets = (
        F.when(some & against, F.concat_ws(",", "_for", "_against")).when(some, F.col("_for")).when(against, F.col("_against")).otherwise(F.col("_detected"))
    )
    return grouped.select("comparison", verdict.alias("verdict"), budgets.alias("budgets"))


def family_problems(scores: DataFrame, comparisons: DataFrame, budgets: list[int]) -> DataFrame:
    """(comparison, budget, problem): a budget absent, a replicate that one model lacks, a
    replicate given twice, a score that is not finite, unequal replicates between budgets."""
    sides = comparisons.select("comparison", F.explode(F.array("candidate", "comparator")).alias("model"))
    declared = comparisons.select("comparison", F.explode(F.array(*[F.lit(int(b)).cast("long") for b in budgets])).alias("budget"))
    rows = scores.join(sides, "model")
    per = rows.groupBy("comparison", "budget", "replicate").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("models"), F.max(not_finite("score")).alias("infinite")
    )
    per_budget = per.groupBy("comparison", "budget").agg(
        F.count(F.lit(1)).alias("replicates"), F.max(F.col("models") < 2).alias("lacks"), F.max(F.col("n") > F.col("models")).alias("twice"), F.max("infinite").alias("infinite"),
    )
    sizes = per_budget.groupBy("comparison").agg((F.min("replicates") != F.max("replicates")).alias("unequal"))
    both = declared.join(per_budget, ["comparison", "budget"], "left").join(sizes, "comparison", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("replicates").isNull(), "budget without results"), F.when(F.col("lacks"), "a model lacks a replicate"),
            F.when(F.col("twice"), "a replicate is given twice"), F.when(F.col("infinite"), "a score is not finite"),
            F.when(F.col("unequal"), "budgets hold different replicates"),
        )
    )
    return both.select("comparison", "budget", F.explode(problems).alias("problem"))


def ranks(scores: DataFrame) -> DataFrame:
    """Rank of each model in each replicate and budget, 1 the best; ties take the mean of the
    ranks they span, failures rank last together. A partition holds the declared models."""
    group = ["budget", "replicate"]
    failed = F.col("score").isNull()
    w = Window.partitionBy(*group).orderBy(failed, "score")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, "score"))
    return scores.select("model", *group, (F.rank().over(w) + (ties - 1) / F.lit(2.0)).alias("rank"))


def mean_ranks(scores: DataFrame) -> DataFrame:
    return ranks(scores).groupBy("budget", "model").agg(F.avg("rank").alias("mean_rank"))


def rank_agreement(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Kendall's tau-b of two orders of the same declared models, per ``keys``; null with a
    reason when all models tie in one order. Both: (*keys, model, rank)."""
    joined = first.select(*keys, "model", F.col("rank").alias("x")).join(second.select(*keys, "model", F.col("rank").alias("y")), [*keys, "model"])
    lists = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))

    def total(term) -> Column:
        inner = lambda a: F.aggregate("p", F.lit(0), lambda s, b: s + term(a, b))
        return F.aggregate("p", F.lit(0), lambda s, a: s + inner(a)) / F.lit(2.0)

    sign = lambda v: F.when(v > 0, 1).when(v < 0, -1).otherwise(0)
    counted = lists.select(
        *keys, total(lambda a, b: sign(a["x"] - b["x"]) * sign(a["y"] - b["y"])).alias("_s"),
        total(lambda a, b: F.abs(sign(a["x"] - b["x"]))).alias("_nx"), total(lambda a, b: F.abs(sign(a["y"] - b["y"]))).alias("_ny"),
    )
    usable = (F.col("_nx") > 0) & (F.col("_ny") > 0)
    return counted.select(
        *keys, F.when(usable, F.col("_s") / F.sqrt(F.col("_nx") * F.col("_ny"))).alias("tau_b"),
        F.when(usable, "computed").otherwise("not computable: every model ties in one of the two orders").alias("reason"),
    )


def replicate_differences(estimates: DataFrame, declared_pairs: DataFrame) -> DataFrame:
    """Difference of the estimates of declared pairs of replicates in combined standard
    errors. ``estimates``: (replicate, estimate, standard_error)."""
    a = estimates.select(F.col("replicate").alias("first"), F.col("estimate").alias("ea"), F.col("standard_error").alias("sa"))
    b = estimates.select(F.col("replicate").alias("second"), F.col("estimate").alias("eb"), F.col("standard_error").alias("sb"))
    both = declared_pairs.join(a, "first").join(b, "second")
    combined = F.hypot("sa", "sb")
    return both.select(
        "first", "second", (F.col("ea") - F.col("eb")).alias("difference"), combined.alias("combined_standard_error"),
        F.when(combined > 0, (F.col("ea") - F.col("eb")) / combined).alias("in_combined_standard_errors"),
    )


def estimate_range(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest and largest value of an estimate over the converged starts."""
    return estimates.where("converged").groupBy(*keys).agg(
        F.min("estimate").alias("smallest"), F.max("estimate").alias("largest"), (F.max("estimate") - F.min("estimate")).alias("spread")
    )
