"""Scoring retrieval against labelled cases, and calibrating thresholds by one sort instead of thresholds times rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold_letters
from ..shared import running

EPS = 1e-6


def case_metrics(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id and the metrics of one case.

    hits: query_id, rank, path (paths may repeat). cases: query_id, expected, forbidden (arrays of
    paths), expect_abstention. nDCG is binary over distinct paths at their best rank; precision counts
    repeats. Without hits precision and nDCG are null, recall and reciprocal rank 0.
    """
    listed = hits.join(cases.select("query_id", "expected"), "query_id").withColumn("good", F.array_contains("expected", F.col("path")))
    per_path = listed.groupBy("query_id", "path", "good").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "path"))
    per = per_path.withColumn("place", place).groupBy("query_id").agg(
        F.count_if("good").alias("matched"),
        F.min(F.when(F.col("good"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good_rows"),
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("good"), 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count("*").alias("paths"),
        F.collect_set("path").alias("found"),
    )
    n = F.size("expected")
    ideal = F.aggregate(
        F.when(F.least(n, F.col("paths")) > 0, F.sequence(F.lit(1), F.least(n, F.col("paths")).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda s, i: s + 1 / F.log2(i + 1.0),
    )
    joined = cases.join(per, "query_id", "left")
    leaks = F.size(F.array_intersect(F.coalesce("found", F.array().cast("array<string>")), "forbidden"))
    recall = F.coalesce(F.try_divide(F.col("matched"), n), F.lit(0.0))
    return joined.select(
        "query_id",
        "expect_abstention",
        recall.alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.try_divide(F.col("good_rows"), F.col("rows")).alias("precision"),
        F.when(F.col("paths").isNotNull(), F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0))).alias("ndcg"),
        leaks.alias("leaks"),
        F.col("rows").isNotNull().alias("answered"),
        F.when(F.col("expect_abstention"), F.col("rows").isNull()).otherwise((recall == 1.0) & (leaks == 0)).alias("passed"),
    )


def term_coverage(answer: Column, groups: Column) -> Column:
    """Share of term groups of which any folded term is in the answer; null without groups."""
    text = fold_letters(answer)
    hit = F.filter(groups, lambda g: F.exists(g, lambda t: F.contains(text, fold_letters(t))))
    return F.try_divide(F.size(hit), F.size(groups))


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, overlap: share of the first k chunks of a that b has among its first k."""
    top = lambda df: df.filter(F.col("rank") <= k).select("query_id", "chunk_id")
    both = top(a).join(top(b).withColumn("in_b", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.avg(F.coalesce("in_b", F.lit(0))).alias("overlap"))


def summarize(results: DataFrame) -> DataFrame:
    """Means and abstention scores by strategy, and by strategy and query_type (grouping sets; null query_type: all)."""
    abstained = ~F.col("answered")
    should = F.col("expect_abstention")
    tp, fp, fn = F.count_if(abstained & should), F.count_if(abstained & ~should), F.count_if(~abstained & should)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return (
        results.groupingSets([["strategy"], ["strategy", "query_type"]], "strategy", "query_type")
        .agg(
            F.grouping("query_type").alias("overall"),
            F.count("*").alias("cases"),
            F.avg(F.when(~should, F.col("recall"))).alias("recall"),
            F.avg(F.when(~should, F.col("reciprocal_rank"))).alias("mrr"),
            F.avg("precision").alias("precision"),
            F.avg("ndcg").alias("ndcg"),
            F.avg(F.col("passed").cast("int")).alias("pass_rate"),
            precision.alias("abstention_precision"),
            recall.alias("abstention_recall"),
            F.try_divide(2 * tp, 2 * tp + fp + fn).alias("abstention_f1"),
            F.try_divide(F.count_if(~abstained), F.count("*")).alias("coverage"),
            F.try_divide(F.count_if(~abstained & F.col("passed")), F.count_if(~abstained)).alias("accuracy_if_answered"),
            F.avg("latency").alias("latency"),
        )
    )


def confusion(results: DataFrame) -> DataFrame:
    """expected, predicted, n and the accuracy over all labelled rows."""
    labelled = results.filter(F.col("expected").isNotNull())
    accuracy = labelled.agg(F.avg((F.col("expected") == F.col("predicted")).cast("int")).alias("accuracy"))
    return labelled.groupBy("expected", "predicted").agg(F.count("*").alias("n")).join(F.broadcast(accuracy))  # one row


def _sweep(values: DataFrame, cost_fp: float, cost_fn: float) -> DataFrame:
    """threshold, tp, fn, tn, fp and what follows from them.

    values: v and the counts a (answerable) and u (unanswerable) of each distinct score.
    """
    both = running(values, "v", ("a", "u")).withColumn("last", F.col("next").isNull())
    low = F.when(F.col("prev").isNull(), F.col("v") - EPS).otherwise((F.col("prev") + F.col("v")) / 2)
    here = F.struct(low.alias("threshold"), F.col("a_before").alias("fn"), F.col("u_before").alias("tn"))
    end = F.struct((F.col("v") + EPS).alias("threshold"), F.col("a_all").alias("fn"), F.col("u_all").alias("tn"))
    rows = both.select("a_all", "u_all", F.explode(F.when(F.col("last"), F.array(here, end)).otherwise(F.array(here))).alias("t"))
    out = rows.filter("a_all > 0 AND u_all > 0").select(
        "t.threshold", (F.col("a_all") - F.col("t.fn")).alias("tp"), "t.fn", "t.tn", (F.col("u_all") - F.col("t.tn")).alias("fp")
    )
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return out.select(
        "*",
        (fp * cost_fp + fn * cost_fn).alias("cost"),
        ((tp / (tp + fn) + tn / (tn + fp)) / 2).alias("balanced"),
        F.try_divide(tn, tn + fn).alias("abstention_precision"),
        (tn / (tn + fp)).alias("abstention_recall"),
        ((tp + fp) / (tp + fn + tn + fp)).alias("coverage"),
        F.try_divide(tp, tp + fp).alias("accuracy_if_answered"),
    )


def calibrate(scores: DataFrame, cost_fp: float = 1.0, cost_fn: float = 1.0) -> DataFrame:
    """All candidate thresholds for (score, answerable) with their counts; a class that is missing gives no rows.

    A question is answered if its score is at least the threshold. Candidates lie below the least score,
    between neighbours, and above the largest.
    """
    distinct = scores.groupBy(F.col("score").alias("v")).agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u"))
    return _sweep(distinct, cost_fp, cost_fn)


def recommend(sweep: DataFrame, scores: DataFrame) -> DataFrame:
    """The best threshold (least cost, then largest balanced accuracy, then least threshold), the margin between classes, and a verdict."""
    best = sweep.agg(F.min_by(F.struct("threshold", "cost", "balanced"), F.struct("cost", -F.col("balanced"), "threshold")).alias("b"))
    edges = scores.agg(
        (F.min(F.when(F.col("answerable"), F.col("score"))) - F.max(F.when(~F.col("answerable"), F.col("score")))).alias("margin")
    )
    verdict = F.when(F.col("margin") >= 0.08, "separable").when(F.col("margin") > 0, "narrow").otherwise("overlapping")
    return best.filter("b IS NOT NULL").select("b.*").join(F.broadcast(edges)).withColumn("verdict", verdict)  # one row


def calibrate_posterior(
    obs: DataFrame, min_mrr: float = 0.938, min_recall: float = 1.0, min_per_class: int = 10, cost_fp: float = 1.0, cost_fn: float = 1.0
) -> DataFrame:
    """threshold, counts, recall, mrr, cost, balanced, passes over the candidates for the posterior threshold.

    obs: score (null: always answers), fixed (always abstains), answerable, recall, rr. An answerable
    case that abstains counts as 0 in recall and mrr. The best of a sweep: passes, then least cost,
    largest balanced accuracy, largest threshold.
    """
    scored = ~F.col("fixed") & F.col("score").isNotNull()
    base = obs.agg(
        F.count_if("answerable").alias("n_a"),
        F.count_if(~F.col("answerable")).alias("n_u"),
        F.count_if(F.col("fixed") & F.col("answerable")).alias("fix_a"),
        F.count_if(F.col("fixed") & ~F.col("answerable")).alias("fix_u"),
        F.coalesce(F.sum(F.when(F.col("answerable") & ~F.col("fixed"), F.coalesce("recall", F.lit(0.0)))), F.lit(0.0)).alias("recall_all"),
        F.coalesce(F.sum(F.when(F.col("answerable") & ~F.col("fixed"), F.coalesce("rr", F.lit(0.0)))), F.lit(0.0)).alias("rr_all"),
    )
    values = obs.filter(scored).groupBy(F.col("score").alias("v")).agg(
        F.count_if("answerable").alias("a"),
        F.count_if(~F.col("answerable")).alias("u"),
        F.coalesce(F.sum(F.when(F.col("answerable"), F.coalesce("recall", F.lit(0.0)))), F.lit(0.0)).alias("rec"),
        F.coalesce(F.sum(F.when(F.col("answerable"), F.coalesce("rr", F.lit(0.0)))), F.lit(0.0)).alias("rr"),
    )
    names = ("a", "u", "rec", "rr")
    sums = running(values, "v", names).select("v", "next", *[(F.col(f"{c}_before") + F.col(c)).alias(c) for c in names])
    step = sums.select(
        F.when(F.col("next").isNull(), F.least(F.lit(1.0), F.col("v") + EPS)).otherwise((F.col("v") + F.col("next")) / 2).alias("threshold"), "a", "u", "rec", "rr"
    )
    zero = base.select(F.lit(0.0).alias("threshold"), *[F.lit(0).cast(t).alias(c) for c, t in (("a", "long"), ("u", "long"), ("rec", "double"), ("rr", "double"))])
    joined = step.unionByName(zero).join(F.broadcast(base))  # base: one row
    fn, tn = F.col("a") + F.col("fix_a"), F.col("u") + F.col("fix_u")
    out = joined.select(
        "threshold",
        (F.col("n_a") - fn).alias("tp"), fn.alias("fn"), tn.alias("tn"), (F.col("n_u") - tn).alias("fp"),
        F.try_divide(F.col("recall_all") - F.col("rec"), F.col("n_a")).alias("recall"),
        F.try_divide(F.col("rr_all") - F.col("rr"), F.col("n_a")).alias("mrr"), "n_a", "n_u",
    )
    gate = (F.col("fn") == 0) & (F.col("recall") >= min_recall) & (F.col("mrr") >= min_mrr) & (F.least("n_a", "n_u") >= min_per_class)
    return out.select(
        "*",
        (F.col("fp") * cost_fp + F.col("fn") * cost_fn).alias("cost"),
        ((F.try_divide("tp", "n_a") + F.try_divide("tn", "n_u")) / 2).alias("balanced"),
        F.coalesce(gate, F.lit(False)).alias("passes"),
    ).drop("n_a", "n_u")


def best_posterior(sweep: DataFrame) -> DataFrame:
    return sweep.agg(
        F.min_by(F.struct(*sweep.columns), F.struct(~F.col("passes"), "cost", -F.col("balanced"), -F.col("threshold"))).alias("b")
    ).filter("b IS NOT NULL").select("b.*")
