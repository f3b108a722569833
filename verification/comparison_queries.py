"""Outcomes, paired comparisons and campaign accounting."""

from functools import reduce

from pyspark.sql import functions as F

from tickweave.contract import constant
from tickweave.operators import campaign, outcomes
from tickweave.sources.eventlog import table
from verification.series_queries import aligned_rounded as rounded

ORDER = [10, 2, 5, 20, 40]
PAIRS = [("A over N", "A", "N"), ("N over R", "N", "R"), ("R over A", "R", "A")]


def scores(spark, sf):
    """Model = return flag, replicate = supplier group, budget by line number; no score where
    the number of lines is divisible by seven."""
    budget = F.element_at(F.array(*[F.lit(b).cast("long") for b in (2, 5, 10, 20, 40)]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    grouped = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 10).alias("replicate"), budget.alias("budget")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("total"))
    return grouped.select("model", "replicate", "budget", F.when(F.col("n") % 7 != 0, F.col("total") / F.col("n")).alias("score"))


def paired(spark, sf):
    return outcomes.pairs(scores(spark, sf), constant(spark, PAIRS, "comparison string, candidate string, comparator string"))


def summary(spark, sf):
    return outcomes.budget_summary(paired(spark, sf))


def ordered(spark, sf):
    return outcomes.ordered_decisions(summary(spark, sf), ORDER, 0.6, 0.02, 5)


def unordered(spark, sf):
    return outcomes.unordered_decisions(summary(spark, sf), sorted(ORDER), 0.9, 0.02, 5)


def _refused(spark, sf):
    """Three families that cannot be decided: a replicate lost, a budget of the order without
    results, and a result for a budget that nobody declared."""
    declared = constant(spark, PAIRS, "comparison string, candidate string, comparator string")
    lost = outcomes.budget_summary(outcomes.pairs(scores(spark, sf).where("NOT (model = 'N' AND replicate = 4 AND budget = 5)"), declared))
    cases = [("lost", lost, ORDER), ("longer order", summary(spark, sf), [80, *ORDER]), ("shorter order", summary(spark, sf), ORDER[:3])]
    parts = []
    for name, found, order in cases:
        for kind, made in (("ordered", outcomes.ordered_decisions(found, order, 0.6, 0.02, 5)), ("unordered", outcomes.unordered_decisions(found, order, 0.9, 0.02, 5))):
            verdicts = outcomes.ordered_verdicts(made) if kind == "ordered" else outcomes.unordered_verdicts(made)
            rows = made.where(F.col("refused").isNotNull()).join(verdicts, "comparison")
            parts.append(rows.select(F.lit(name).alias("case"), F.lit(kind).alias("kind"), "comparison", "budget", "tested", "label", "verdict"))
    return reduce(lambda a, b: a.unionByName(b), parts)


DECISION = ["comparison", "budget", "tested", "direction", "magnitude", "counts_for", "label"]


def attempts_and_results(spark, sf):
    o = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 10).alias("replicate"), (2 + o % 5).alias("budget"),
        (F.col("o_totalprice") / 100000.0).alias("j"), F.when(o % 97 == 0, "integrator").alias("failure"), F.when(o % 50 == 0, 1).otherwise(0).alias("violations"),
    )
    failed = (F.col("replicate") == 3) & (F.col("budget") == 2)
    attempts = rows.select("model", "replicate", "budget").distinct().withColumn("training_failure", F.when(failed, "no convergence"))
    return attempts, rows.where(~failed)


def replicate_outcomes(spark, sf):
    return outcomes.replicate_outcomes(*attempts_and_results(spark, sf))


def _inconsistent(spark, sf):
    found = replicate_outcomes(spark, sf)
    return outcomes.inconsistent_outcomes(
        found.withColumn("score", F.when(F.col("replicate") == 5, 1.0).otherwise(F.col("score")))
        .withColumn("violations", F.when(F.col("training_failure").isNotNull(), F.lit(2)).otherwise(F.col("violations")))
        .withColumn("windows", F.when(F.col("replicate") == 7, F.lit(0)).otherwise(F.col("windows")))
    )


def _agreement(spark, sf):
    found = outcomes.mean_ranks(scores(spark, sf)).select("budget", "model", F.col("mean_rank").alias("rank"))
    first = found.where("budget = 2").drop("budget").select(F.explode(F.array(*[F.lit(b).cast("long") for b in (5, 10, 20, 40)])).alias("budget"), "model", "rank")
    return rounded(outcomes.rank_agreement(first, found, ["budget"]))


def _estimates(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("replicate")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count(F.lit(1))).alias("estimate"), F.count(F.lit(1)).cast("double").alias("standard_error"))


def _differences(spark, sf):
    e = _estimates(spark, sf)
    declared = e.where("replicate % 2 = 0").select(F.col("replicate").alias("first"), (F.col("replicate") + 1).alias("second"))
    return rounded(outcomes.replicate_differences(e, declared))


def _ranges(spark, sf):
    starts = table(spark, sf, "orders").select(F.col("o_custkey").alias("fit"), F.col("o_totalprice").alias("estimate"), (F.col("o_orderstatus") != "F").alias("converged"))
    return rounded(outcomes.estimate_range(starts, ["fit"]))


SPEC = dict(
    budgets={"A10": (2, 5, 10), "A5": (2, 5)}, fits={"primary": ("MR_F", "MR", "BL"), "held": ("MR_F", "MR")},
    grid={"HK": 2, "HU": 3, "BN": 1}, held_condition="A10", held_budgets=(10,), held_families=("HK",),
)


def tasks(spark, sf):
    c = F.col("c_custkey")
    replicates = table(spark, sf, "customer").select(
        F.when(c % 2 == 0, "A10").otherwise("A5").alias("condition"), c.alias("replicate"), F.concat(F.lit("target.p3.e"), c.cast("string"), F.lit(".x4.n0")).alias("run_id"))
    return campaign.declared_tasks(replicates, **SPEC)


def records(spark, sf):
    """Records of the tasks: one in 29 replicates lost, one in 31 written twice, one in 37
    under a key nobody declared."""
    r = F.col("replicate")
    stamp = r * 7 + F.col("budget") * 3 + F.coalesce("index", F.lit(5))
    kept = tasks(spark, sf).where(r % 29 != 0)
    copies = kept.withColumn("_copy", F.explode(F.when(r % 31 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return copies.select(
        "condition", "replicate", "budget", "kind", "family", "index", "family_key",
        F.when(r % 37 == 0, F.concat("key", F.lit("/again"))).otherwise(F.col("key")).alias("key"), F.col("key").alias("filed_as"),
        F.when(stamp % 5 == 0, "did not converge").alias("failure"), ((stamp * 13) % 7 / F.lit(4.0)).alias("criterion"), (stamp % 11 / F.lit(2.0)).alias("seconds"),
    )


def _provenances(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("run"), c.cast("string")).alias("run_id"), F.when(c % 2 == 0, "A10").otherwise("A5").alias("condition"),
        F.when(c % 101 == 0, "abc").otherwise(F.sha1(F.lit("commit").cast("binary"))).alias("commit"), F.lit("spec").alias("specification"),
        F.when(c % 103 == 0, None).otherwise(F.concat(F.lit("env"), (c % 3).cast("string"))).alias("environment"), F.when(c % 2 == 0, "data-a").otherwise(F.concat(F.lit("data-b"), (c % 4).cast("string"))).alias("data"))


def _identities(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("source.p3.e"), F.when(F.col("o_orderkey") % 500 == 7, F.lit(7)).otherwise(F.col("o_orderkey")).cast("string"), F.lit(".x4.n0")).alias("run_id"))


def _relative(spark, sf):
    first = records(spark, sf).where("kind = 'training'").groupBy("filed_as").agg(F.max("criterion").alias("criterion"), F.max("seconds").alias("seconds"))
    second = first.select("filed_as", (F.col("criterion") * 1.25).alias("criterion"), (F.col("seconds") + 0.5).alias("seconds"))
    return rounded(campaign.relative_differences(first, second, "filed_as", ["criterion", "seconds"]))


QUERIES = {
    "compare_score_table": scores,
    "compare_pairs": paired,
    "compare_paired_counts": lambda spark, sf: outcomes.paired_counts(paired(spark, sf)),
    "compare_budget_summary": lambda spark, sf: rounded(summary(spark, sf), 9),
    "compare_ordered_decisions": lambda spark, sf: ordered(spark, sf).select(DECISION),
    "compare_ordered_verdicts": lambda spark, sf: outcomes.ordered_verdicts(ordered(spark, sf)),
    "compare_refused_families": _refused,
    "compare_unordered_decisions": lambda spark, sf: unordered(spark, sf).select(DECISION),
    "compare_unordered_verdicts": lambda spark, sf: outcomes.unordered_verdicts(unordered(spark, sf)),
    "compare_family_problems": lambda spark, sf: outcomes.family_problems(
        scores(spark, sf).where("NOT (model = 'N' AND replicate = 4 AND budget = 5)").withColumn("score", F.when(F.col("replicate") == 8, F.lit(float("inf"))).otherwise(F.col("score"))),
        constant(spark, PAIRS, "comparison string, candidate string, comparator string"), [*ORDER, 80]),
    "compare_ranks": lambda spark, sf: outcomes.ranks(scores(spark, sf)),
    "compare_mean_ranks": lambda spark, sf: rounded(outcomes.mean_ranks(scores(spark, sf))),
    "compare_rank_agreement": _agreement,
    "compare_replicate_differences": _differences,
    "compare_estimate_ranges": _ranges,
    "outcome_replicates": lambda spark, sf: rounded(replicate_outcomes(spark, sf)),
    "outcome_failure_table": lambda spark, sf: outcomes.failure_table(replicate_outcomes(spark, sf)),
    "outcome_inconsistent": _inconsistent,
    "campaign_tasks": lambda spark, sf: tasks(spark, sf).select("key", "kind", "start_key", "family_key", "run_id"),
    "campaign_family_sizes": lambda spark, sf: campaign.family_sizes(tasks(spark, sf)),
    "campaign_coverage": lambda spark, sf: campaign.coverage(tasks(spark, sf), records(spark, sf)),
    "campaign_combine_problems": lambda spark, sf: campaign.combine_problems(tasks(spark, sf), records(spark, sf)),
    "campaign_compatibility": lambda spark, sf: campaign.compatibility(_provenances(spark, sf)),
    "campaign_provenance_problems": lambda spark, sf: campaign.provenance_problems(_provenances(spark, sf)),
    "campaign_selections": lambda spark, sf: rounded(campaign.selections(records(spark, sf))),
    "campaign_blocked_tasks": lambda spark, sf: campaign.blocked_tasks(tasks(spark, sf), records(spark, sf)),
    "campaign_run_summary": lambda spark, sf: rounded(campaign.run_summary(records(spark, sf))),
    "campaign_identity_collisions": lambda spark, sf: campaign.identity_collisions(_identities(spark, sf)),
    "campaign_relative_differences": _relative,
}

_SCORES = """
scores AS (
  SELECT l_returnflag AS model, l_suppkey % 10 AS replicate, [2, 5, 10, 20, 40][l_linenumber % 5 + 1]::BIGINT AS budget,
         CASE WHEN count(*) % 7 <> 0 THEN sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) END AS score FROM lineitem GROUP BY ALL),
declared AS (SELECT * FROM (VALUES ('A over N', 'A', 'N'), ('N over R', 'N', 'R'), ('R over A', 'R', 'A')) v(comparison, candidate, comparator)),
paired AS (
  SELECT comparison, a.budget, a.replicate,
         CASE (a.score IS NULL)::INT * 2 + (b.score IS NULL)::INT WHEN 3 THEN 'both failed' WHEN 2 THEN 'only the comparator completed'
              WHEN 1 THEN 'only the candidate completed' ELSE 'both completed' END AS kind,
         CASE WHEN coalesce(a.score, 1e300) < coalesce(b.score, 1e300) THEN 'candidate' WHEN coalesce(b.score, 1e300) < coalesce(a.score, 1e300) THEN 'comparator' END AS winner,
         b.score - a.score AS difference
  FROM declared JOIN scores a ON a.model = candidate JOIN scores b ON b.model = comparator AND b.budget = a.budget AND b.replicate = a.replicate),
counted AS (SELECT comparison, budget, count(*) FILTER (winner = 'candidate') AS wins, count(*) FILTER (winner = 'comparator') AS losses, count(*) FILTER (winner IS NULL) AS ties,
  count(difference) AS n_both, count(*) AS replicates, median(difference) AS median_difference FROM paired GROUP BY ALL),
summary AS (SELECT *,
  CASE WHEN wins + losses = 0 THEN 1.0 ELSE list_sum(list_transform(range(wins, wins + losses + 1), lambda i: factorial((wins + losses)::INT) / factorial(i::INT) / factorial((wins + losses - i)::INT))) / pow(2, wins + losses) END::DOUBLE AS p_candidate,
  CASE WHEN wins + losses = 0 THEN 1.0 ELSE list_sum(list_transform(range(losses, wins + losses + 1), lambda i: factorial((wins + losses)::INT) / factorial(i::INT) / factorial((wins + losses - i)::INT))) / pow(2, wins + losses) END::DOUBLE AS p_comparator
  FROM counted)"""


def _decide(tested: str) -> str:
    return f"""
, tested AS ({tested}),
directed AS (SELECT *, CASE WHEN rc THEN 'candidate' WHEN rk THEN 'comparator' END AS direction FROM tested),
sized AS (SELECT *, CASE WHEN direction IS NULL THEN NULL WHEN n_both = 0 THEN 'magnitude not computable' WHEN n_both < 5 THEN 'magnitude not established'
   WHEN (CASE direction WHEN 'candidate' THEN 1 ELSE -1 END) * median_difference >= 0.02::DOUBLE THEN 'relevant' ELSE 'below the relevance margin' END AS magnitude FROM directed),
decisions AS (SELECT *, CASE WHEN magnitude <> 'below the relevance margin' THEN direction END AS counts_for,
   CASE WHEN NOT tested THEN 'not tested' WHEN direction IS NULL THEN 'no decision' ELSE direction || ' better, ' || magnitude END AS label FROM sized)"""


_ORDERED = _decide("""
  SELECT *, bool_and(c) OVER upto AS rc, bool_and(k) OVER upto AS rk,
         coalesce(bool_and(c) OVER earlier, true) OR coalesce(bool_and(k) OVER earlier, true) AS tested
  FROM (SELECT *, list_position([10, 2, 5, 20, 40], budget) AS position, p_candidate <= 0.3::DOUBLE AS c, p_comparator <= 0.3::DOUBLE AS k FROM summary)
  WINDOW upto AS (PARTITION BY comparison ORDER BY position), earlier AS (PARTITION BY comparison ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_UNORDERED = _decide("SELECT *, p_candidate <= 0.09::DOUBLE AS rc, p_comparator <= 0.09::DOUBLE AS rk, true AS tested FROM summary")
_COLUMNS = "comparison, budget, tested, direction, magnitude, counts_for, label"
_RANKED = """
, ranked AS (SELECT a.model, a.budget, a.replicate, 1 + count(*) FILTER (coalesce(b.score, 1e300) < coalesce(a.score, 1e300)) + (count(*) FILTER (a.score IS NOT DISTINCT FROM b.score) - 1) / 2.0::DOUBLE AS rank
  FROM scores a JOIN scores b USING (budget, replicate) GROUP BY ALL),
means AS (SELECT budget, model, avg(rank) AS mean_rank FROM ranked GROUP BY ALL)"""
_OUTCOMES = """
rows AS (SELECT o_orderpriority AS model, o_custkey % 10 AS replicate, 2 + o_orderkey % 5 AS budget, o_totalprice / 100000 AS j, o_orderkey % 97 = 0 AS failed, (o_orderkey % 50 = 0)::INT AS v FROM orders),
outcomes AS (
  SELECT model, replicate, budget, CASE WHEN replicate = 3 AND budget = 2 THEN 'no convergence' END AS training_failure, training_failure IS NULL AS ok,
         if(ok, count(*), 0) AS windows, if(ok, count(*) FILTER (failed), 0) AS failed_windows, if(ok, coalesce(sum(v) FILTER (NOT failed), 0), 0)::BIGINT AS violations,
         CASE WHEN ok AND count(*) FILTER (failed) = 0 THEN sqrt(avg(j * j)) END AS score, CASE WHEN ok THEN sqrt(avg(j * j) FILTER (NOT failed)) END AS conditional_score
  FROM rows GROUP BY model, replicate, budget)"""
_TASKS = """
base AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN 'A10' ELSE 'A5' END AS condition, c_custkey AS replicate, 'target.p3.e' || c_custkey || '.x4.n0' AS run_id, b AS budget, an AS analysis
  FROM customer, (VALUES (2), (5), (10)) v(b), (VALUES ('primary'), ('held')) w(an)
  WHERE (b < 10 OR c_custkey % 2 = 0) AND (an = 'primary' OR (b = 10 AND c_custkey % 2 = 0))),
tasks AS (
  SELECT base.*, kind, family, idx, format('{}/r{:02d}/b{:02d}/{}', condition, replicate, budget, analysis) AS head,
         CASE WHEN kind = 'training' THEN head || '/' || family || '/' || idx ELSE head || '/' || kind END AS key,
         CASE WHEN kind = 'training' THEN head || '/MR_F' END AS start_key, CASE WHEN kind = 'training' THEN head || '/' || family END AS family_key
  FROM base, (VALUES ('MR_F', NULL, NULL), ('MR', NULL, NULL), ('BL', NULL, NULL), ('training', 'HK', 0), ('training', 'HK', 1), ('training', 'HU', 0), ('training', 'HU', 1),
                     ('training', 'HU', 2), ('training', 'BN', 0)) k(kind, family, idx)
  WHERE analysis = 'primary' OR kind IN ('MR_F', 'MR') OR family = 'HK'),
stamped AS (SELECT *, replicate * 7 + budget * 3 + coalesce(idx, 5) AS stamp FROM tasks WHERE replicate % 29 <> 0),
records AS (
  SELECT condition, replicate, budget, kind, family, idx, family_key, CASE WHEN replicate % 37 = 0 THEN key || '/again' ELSE key END AS key, key AS filed_as,
         CASE WHEN stamp % 5 = 0 THEN 'did not converge' END AS failure, (stamp * 13) % 7 / 4.0::DOUBLE AS criterion, stamp % 11 / 2.0::DOUBLE AS seconds
  FROM stamped, (VALUES (1), (2)) c(copy) WHERE copy = 1 OR replicate % 31 = 0)"""
_EST = "e AS (SELECT o_custkey AS replicate, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) AS est, count(*)::DOUBLE AS se FROM orders GROUP BY ALL)"


def _q(prelude, body):
    return f"WITH {prelude.strip()}\n{body}"


SQL = {
    "compare_score_table": _q(_SCORES, "SELECT * FROM scores"),
    "compare_pairs": _q(_SCORES, "SELECT * FROM paired"),
    "compare_paired_counts": _q(_SCORES, """SELECT comparison, sum(wins)::BIGINT AS first_wins, sum(losses)::BIGINT AS second_wins, sum(ties)::BIGINT AS ties,
        any_value(f) AS both_failed FROM summary JOIN (SELECT comparison, count(*) FILTER (kind = 'both failed') AS f FROM paired GROUP BY ALL) USING (comparison) GROUP BY comparison"""),
    "compare_budget_summary": _q(_SCORES, "SELECT comparison, budget, wins, losses, ties, n_both, replicates, 0::BIGINT AS absent, round(median_difference, 9) AS median_difference, round(p_candidate, 9) AS p_candidate, round(p_comparator, 9) AS p_comparator FROM summary"),
    "compare_ordered_decisions": _q(_SCORES + _ORDERED, f"SELECT {_COLUMNS} FROM decisions"),
    "compare_ordered_verdicts": _q(_SCORES + _ORDERED, """
        SELECT comparison, CASE gc WHEN 'candidate' THEN 'supported' WHEN 'comparator' THEN 'contradicted' ELSE CASE WHEN gd IS NULL THEN 'no confirmatory decision' ELSE 'difference below the relevance margin' END END AS verdict,
               CASE WHEN gc = 'candidate' THEN prefix WHEN gd IS NULL THEN '' ELSE '10' END AS budgets
        FROM (SELECT comparison, max(counts_for) FILTER (position = 1) AS gc, max(direction) FILTER (position = 1) AS gd, coalesce(string_agg(budget::VARCHAR, ',' ORDER BY position) FILTER (good), '') AS prefix
              FROM (SELECT *, bool_and(coalesce(counts_for = 'candidate', false)) OVER (PARTITION BY comparison ORDER BY position) AS good FROM decisions) GROUP BY comparison)"""),
    "compare_refused_families": _q(_SCORES, """
        SELECT "case", kind, comparison, budget, false AS tested, 'refused: ' || why AS label, 'refused' AS verdict
        FROM (SELECT DISTINCT comparison, budget FROM paired), (VALUES ('ordered'), ('unordered')) k(kind),
             (VALUES ('lost', 'a model lacks a replicate'), ('longer order', 'a declared budget without results'), ('shorter order', 'a budget that is not declared')) v("case", why)
        WHERE "case" <> 'lost' OR contains(comparison, 'N')"""),
    "compare_unordered_decisions": _q(_SCORES + _UNORDERED, f"SELECT {_COLUMNS} FROM decisions"),
    "compare_unordered_verdicts": _q(_SCORES + _UNORDERED, """
        SELECT comparison, CASE WHEN f <> '' AND a <> '' THEN 'budget-dependent' WHEN f <> '' THEN 'supported' WHEN a <> '' THEN 'contradicted' WHEN d <> '' THEN 'difference below the relevance margin' ELSE 'no confirmatory decision' END AS verdict,
               CASE WHEN f <> '' AND a <> '' THEN f || ',' || a WHEN f <> '' THEN f WHEN a <> '' THEN a ELSE d END AS budgets
        FROM (SELECT comparison, coalesce(string_agg(budget::VARCHAR, ',' ORDER BY budget) FILTER (counts_for = 'candidate'), '') AS f,
              coalesce(string_agg(budget::VARCHAR, ',' ORDER BY budget) FILTER (counts_for = 'comparator'), '') AS a, coalesce(string_agg(budget::VARCHAR, ',' ORDER BY budget) FILTER (direction IS NOT NULL), '') AS d
              FROM decisions GROUP BY comparison)"""),
    "compare_family_problems": _q(_SCORES, """
        SELECT comparison, 80::BIGINT AS budget, 'budget without results' AS problem FROM declared UNION ALL
        SELECT comparison, 5, 'a model lacks a replicate' FROM declared WHERE contains(comparison, 'N') UNION ALL
        SELECT comparison, b, 'a score is not finite' FROM declared, (VALUES (2), (5), (10), (20), (40)) v(b)"""),
    "compare_ranks": _q(_SCORES + _RANKED, "SELECT * FROM ranked"),
    "compare_mean_ranks": _q(_SCORES + _RANKED, "SELECT budget, model, round(mean_rank, 6) AS mean_rank FROM means"),
    "compare_rank_agreement": _q(_SCORES + _RANKED, """
        SELECT budget, CASE WHEN nx > 0 AND ny > 0 THEN round(s / sqrt(nx * ny), 6) END AS tau_b, CASE WHEN nx > 0 AND ny > 0 THEN 'computed' ELSE 'not computable: every model ties in one of the two orders' END AS reason
        FROM (SELECT y.budget, sum(sign(x.mean_rank - x2.mean_rank) * sign(y.mean_rank - y2.mean_rank)) AS s, sum(abs(sign(x.mean_rank - x2.mean_rank))) AS nx, sum(abs(sign(y.mean_rank - y2.mean_rank))) AS ny
              FROM means x JOIN means x2 ON x.budget = 2 AND x2.budget = 2 AND x.model < x2.model JOIN means y ON y.model = x.model AND y.budget <> 2 JOIN means y2 ON y2.model = x2.model AND y2.budget = y.budget GROUP BY y.budget)"""),
    "compare_replicate_differences": _q(_EST, """SELECT a.replicate AS first, b.replicate AS second, round(a.est - b.est, 6) AS difference, round(sqrt(a.se * a.se + b.se * b.se), 6) AS combined_standard_error,
        round((a.est - b.est) / sqrt(a.se * a.se + b.se * b.se), 6) AS in_combined_standard_errors FROM e a JOIN e b ON b.replicate = a.replicate + 1 WHERE a.replicate % 2 = 0"""),
    "compare_estimate_ranges": """SELECT o_custkey AS fit, round(min(o_totalprice), 6) AS smallest, round(max(o_totalprice), 6) AS largest, round(max(o_totalprice) - min(o_totalprice), 6) AS spread
        FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""",
    "outcome_replicates": _q(_OUTCOMES, "SELECT model, replicate, budget, training_failure, windows, failed_windows, violations, round(score, 6) AS score, round(conditional_score, 6) AS conditional_score FROM outcomes"),
    "outcome_failure_table": _q(_OUTCOMES, """SELECT model, budget, count(*) AS replicates, count(score) AS scored, count(training_failure) AS training_failures, count(*) FILTER (failed_windows > 0) AS with_integration_failures,
        sum(failed_windows)::BIGINT AS failed_windows, count(*) FILTER (violations > 0) AS with_violations FROM outcomes GROUP BY ALL"""),
    "outcome_inconsistent": _q(_OUTCOMES, """
        SELECT model, replicate, budget, 'primary score' AS problem FROM outcomes WHERE replicate = 5 AND score IS NULL
        UNION ALL SELECT model, replicate, budget, 'rollouts without a model' FROM outcomes WHERE training_failure IS NOT NULL
        UNION ALL SELECT model, replicate, budget, 'more failed windows than windows' FROM outcomes WHERE replicate = 7 AND failed_windows > 0"""),
    "campaign_tasks": _q(_TASKS, "SELECT key, kind, start_key, family_key, run_id FROM tasks"),
    "campaign_family_sizes": _q(_TASKS, "SELECT family_key, count(*) AS n_configurations FROM tasks WHERE kind = 'training' GROUP BY ALL"),
    "campaign_coverage": _q(_TASKS, """
        SELECT condition, count(DISTINCT t.key) AS expected, count(DISTINCT r.key) AS recorded, count(DISTINCT t.key) FILTER (r.key IS NULL) AS missing,
               count(DISTINCT r.key) FILTER (t.key IS NULL) AS unexpected, count(DISTINCT r.key) FILTER (n > 1) AS duplicate, false AS complete
        FROM tasks t FULL JOIN (SELECT condition, key, count(*) AS n FROM records GROUP BY ALL) r USING (condition, key) GROUP BY condition"""),
    "campaign_combine_problems": _q(_TASKS, """
        SELECT key, 'no record' AS problem FROM tasks WHERE key NOT IN (SELECT key FROM records) UNION ALL
        SELECT DISTINCT key, 'not a task of the runs' FROM records WHERE key NOT IN (SELECT key FROM tasks) UNION ALL
        SELECT key, 'recorded twice' FROM records GROUP BY key HAVING count(*) > 1 UNION ALL SELECT DISTINCT key, 'filed under another key' FROM records WHERE key <> filed_as"""),
    "campaign_compatibility": """
        WITH p AS (SELECT c_custkey % 101 = 0 AS odd, CASE WHEN c_custkey % 103 <> 0 THEN c_custkey % 3 END AS env, CASE WHEN c_custkey % 2 = 0 THEN 'A10' ELSE 'A5' END AS condition, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE c_custkey % 4 END AS data FROM customer)
        SELECT * FROM (SELECT 'all' AS scope, 'commit' AS attribute, count(DISTINCT odd) AS n_values FROM p UNION ALL SELECT 'all', 'environment', count(DISTINCT env) FROM p
        UNION ALL SELECT condition, 'data', count(DISTINCT data) FROM p GROUP BY condition) WHERE n_values > 1""",
    "campaign_provenance_problems": """SELECT 'run' || c_custkey AS run_id, 'commit is not a full object name' AS problem FROM customer WHERE c_custkey % 101 = 0
        UNION ALL SELECT 'run' || c_custkey, 'no environment' FROM customer WHERE c_custkey % 103 = 0""",
    "campaign_selections": _q(_TASKS, """
        SELECT family_key, count(*) AS n_tried, count(failure) AS n_failed, arg_min(key, criterion * 100 + idx) FILTER (failure IS NULL) AS selected, min(criterion) FILTER (failure IS NULL) AS criterion,
               sum(seconds) AS seconds, CASE WHEN count(*) = count(failure) THEN 'every configuration failed' END AS failure
        FROM (SELECT DISTINCT * FROM records WHERE kind = 'training') r GROUP BY family_key"""),
    "campaign_blocked_tasks": _q(_TASKS, """
        SELECT t.key, t.start_key, CASE WHEN r.key IS NULL THEN 'waiting' WHEN f IS NULL THEN 'ready' ELSE 'blocked' END AS state, 'not trained, since its start failed: ' || f AS failure
        FROM tasks t LEFT JOIN (SELECT key, max(failure) AS f FROM records GROUP BY key) r ON r.key = t.start_key WHERE kind = 'training'"""),
    "campaign_run_summary": _q(_TASKS, """SELECT condition, kind, count(*) AS n_records, count(failure) AS n_failures, sum(seconds) AS seconds, max(seconds) AS longest, count(DISTINCT family_key) AS n_families
        FROM records GROUP BY ALL"""),
    "campaign_identity_collisions": """SELECT 'source.p3.e7.x4.n0' AS item, 'defined twice' AS problem, count(*) AS n FROM orders WHERE o_orderkey % 500 = 7 HAVING count(*) > 1""",
    "campaign_relative_differences": _q(_TASKS, """, a AS (SELECT filed_as, max(criterion) AS c, max(seconds) AS s FROM records WHERE kind = 'training' GROUP BY ALL)
        SELECT 'criterion' AS field, count(*) AS n_compared, 0::BIGINT AS n_one_side, round(max(CASE WHEN c = 0 THEN 0 ELSE 0.2::DOUBLE END), 6) AS largest FROM a
        UNION ALL SELECT 'seconds', count(*), 0, round(max(0.5::DOUBLE / (s + 0.5)), 6) FROM a"""),
}
