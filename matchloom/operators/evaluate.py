"""Scores of matches: the macro F-measure over entities, sweeps of thresholds, and reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.functions.numbers import f_half


def measure(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one entity: 1 where nothing is to be found and nothing was, 0 without a hit."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise(f_half(tp / n_pred, tp / n_true))


def true_counts(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, country, n_true) of every entity."""
    held = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    ids = entities.select(F.col("entity_id").alias("s1_id"), "country")
    return ids.join(held, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))


def correct(best: DataFrame, truth: DataFrame) -> DataFrame:
    """``best`` with ``correct``: whether the pair is in ``truth``."""
    hit = truth.select("s1_id", "query_id", F.lit(True).alias("_hit"))
    return best.join(hit, ["s1_id", "query_id"], "left").withColumn("correct", F.coalesce("_hit", F.lit(False))).drop("_hit")


def entity_scores(matches: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity: s1_id, country, n_true, n_pred, tp, f05."""
    hits = correct(matches.select("s1_id", "query_id"), truth).groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.count_if("correct").alias("tp"))
    d = true_counts(entities, truth).join(hits, "s1_id", "left").fillna(0, ["n_pred", "tp"])
    return d.withColumn("f05", measure(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def report(scores: DataFrame) -> DataFrame:
    """Of all entities, and by country: mean score, precision, recall, shares, and the score lost by cause."""
    single, wrong = F.col("n_true") == 0, (F.col("n_true") > 0) & (F.col("n_pred") > F.col("tp"))
    missing, lost = (F.col("n_true") > 0) & ~wrong, 1 - F.col("f05")
    share = lambda what, of: F.coalesce(F.avg(F.when(of, F.when(what, 1.0).otherwise(0.0))), F.lit(0.0))
    d = scores.withColumn("_groups", F.explode(F.array(F.lit("all"), F.concat(F.lit("country "), "country"))))
    return d.groupBy(F.col("_groups").alias("part")).agg(
        F.count("*").alias("entities"), F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.round(F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1)), 6).alias("precision"), F.round(F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1)), 6).alias("recall"),
        F.round(share(single, F.lit(True)), 6).alias("singletons"), F.round(share(F.col("n_pred") == 0, single), 6).alias("singletons_empty"),
        F.round(share(F.col("n_pred") == 0, ~single), 6).alias("without_prediction"), F.round(share(wrong, ~single), 6).alias("with_wrong"), F.round(share(F.col("f05") == 1, ~single), 6).alias("exact"),
        F.round(F.avg(F.when(single, lost).otherwise(0.0)), 6).alias("lost_singletons"), F.round(F.avg(F.when(wrong, lost).otherwise(0.0)), 6).alias("lost_wrong"), F.round(F.avg(F.when(missing, lost).otherwise(0.0)), 6).alias("lost_missing"),
    )


def grid(first: float, last: float, step: float) -> list[float]:
    return [round(first + i * step, 3) for i in range(round((last - first) / step) + 1)]


def sweep(best: DataFrame, truth: DataFrame, entities: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """The macro score at each threshold, in one pass: (by, threshold, macro_f05).

    A row counts at every threshold up to its score, so running counts over an entity's rows, best first, hold
    for all thresholds between two scores; entities without rows at a threshold add what an empty answer scores."""
    by = by or []
    counts = true_counts(entities, truth)
    alone = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    whole = counts.groupBy(*by).agg(F.count("*").alias("n"), F.sum(alone).alias("empty"))
    order = W.partitionBy("s1_id").orderBy(F.col("prob").desc(), "query_id")
    ran = order.rowsBetween(W.unboundedPreceding, 0)
    rows = correct(best, truth).select("s1_id", "prob", F.count("*").over(ran).alias("n_pred"), F.sum(F.col("correct").cast("int")).over(ran).alias("tp"), F.coalesce(F.lead("prob").over(order), F.lit(-1.0)).alias("after"))
    rows = rows.where("prob > after").join(counts, "s1_id")
    held = F.filter(F.lit(thresholds), lambda t: (t <= F.col("prob")) & (t > F.col("after")))
    gain = rows.select(*by, (measure(F.col("tp"), F.col("n_pred"), F.col("n_true")) - alone).alias("gain"), F.explode(held).alias("threshold"))
    gain = gain.groupBy(*by, "threshold").agg(F.sum("gain").alias("gain"))
    points = whole.withColumn("threshold", F.explode(F.lit(thresholds)))
    return points.join(gain, [*by, "threshold"], "left").select(*by, "threshold", F.round((F.col("empty") + F.coalesce("gain", F.lit(0.0))) / F.col("n"), 9).alias("macro_f05"))


def best_point(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold with the best score, of equals the lowest."""
    by = by or []
    order = W.partitionBy(*by).orderBy(F.col("macro_f05").desc(), "threshold")
    return points.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def tune(best: DataFrame, truth: DataFrame, entities: DataFrame) -> float:
    """The threshold of the best macro score: a coarse grid, then a fine one around its best point.

    ``best`` is kept meanwhile: what made it runs once, not once a grid."""
    held = best.storageLevel != StorageLevel.NONE
    best = best if held else best.persist(StorageLevel.MEMORY_AND_DISK)
    found = best_point(sweep(best, truth, entities, grid(0.30, 0.98, 0.02))).first()
    fine = [t for t in grid(round(max(0.01, found["threshold"] - 0.02), 3), round(min(0.995, found["threshold"] + 0.02), 3), 0.005)]
    finer = best_point(sweep(best, truth, entities, fine)).first()
    if not held:
        best.unpersist()
    return float(finer["threshold"] if finer["macro_f05"] > found["macro_f05"] else found["threshold"])


def rule_sweep(best: DataFrame, truth: DataFrame, entities: DataFrame, threshold: float, supports: list[float] | None = None, lones: list[float] | None = None, support: float | None = None) -> DataFrame:
    """(point, macro_f05): the macro score with each of ``supports``, or with ``support`` and each of ``lones``, in one pass.

    Rows are repeated for each point, of which there are few; then every point is decided and scored on its own."""
    points = supports if supports is not None else lones
    of_entity = W.partitionBy("point", "s1_id")
    weaker = F.col("point") if supports is not None else F.lit(support)
    rows = correct(best, truth).withColumn("point", F.explode(F.lit(points))).withColumn("_sure", F.col("prob") >= threshold)
    rows = rows.where(F.col("_sure") | (F.coalesce(F.col("prob") >= weaker, F.lit(False)) if supports is not None or support is not None else F.lit(False)))
    rows = rows.withColumn("_any", F.max("_sure").over(of_entity)).where("_any")
    if lones is not None:
        rows = rows.withColumn("_n", F.count("*").over(of_entity)).where((F.col("_n") > 1) | (F.col("prob") >= F.col("point")))
    hits = rows.groupBy("point", "s1_id").agg(F.count("*").alias("n_pred"), F.count_if("correct").alias("tp"))
    every = true_counts(entities, truth).withColumn("point", F.explode(F.lit(points))).join(hits, ["point", "s1_id"], "left").fillna(0, ["n_pred", "tp"])
    return every.groupBy("point").agg(F.round(F.avg(measure(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("macro_f05"))


def tune_rules(best: DataFrame, truth: DataFrame, entities: DataFrame, threshold: float) -> tuple[float | None, float | None]:
    """The support threshold that helps most, if any does, and after it the lone one."""
    plain = rule_sweep(best, truth, entities, threshold, lones=[0.0]).first()["macro_f05"]
    support, score = None, plain
    lower = [t for t in grid(0.30, 0.95, 0.05) if t < threshold]
    if lower:
        top = max(rule_sweep(best, truth, entities, threshold, supports=lower).collect(), key=lambda r: (r["macro_f05"], -r["point"]))
        support, score = (top["point"], top["macro_f05"]) if top["macro_f05"] > score else (None, score)
    upper = [t for t in grid(round(threshold + 0.01, 3), 0.994, 0.02) if t > threshold]
    if upper:
        top = max(rule_sweep(best, truth, entities, threshold, lones=upper, support=support).collect(), key=lambda r: (r["macro_f05"], -r["point"]))
        return support, top["point"] if top["macro_f05"] > score else None
    return support, None


def recall_report(labelled: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), channels: tuple[str, ...] = ("name", "addr", "char")) -> DataFrame:
    """The share of true pairs found among the first k candidates: (channel, k, recall), UNION for any channel."""
    n = truth.select(F.count("*").alias("n"))
    best = {**{c: F.col(f"{c}_rank") for c in channels}, "UNION": F.least(*[F.col(f"{c}_rank") for c in channels])}
    hits = [F.struct(F.lit(c).alias("channel"), F.lit(k).alias("k"), F.count_if(rank <= k).alias("found")) for c, rank in best.items() for k in ks]
    one = labelled.where("is_match = 1").select(F.array(*hits).alias("hits"))
    return one.select(F.explode("hits").alias("h")).join(n).select("h.channel", "h.k", F.round(F.col("h.found") / F.greatest("n", F.lit(1)), 6).alias("recall"))


def ceiling(labelled: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Per country, what a perfect model could reach on these candidates, and their recall."""
    found = labelled.where("is_match = 1").groupBy("s1_id").agg(F.count("*").alias("found"))
    d = true_counts(entities, truth).join(found, "s1_id", "left").fillna(0, ["found"])
    score = F.when(F.col("n_true") == 0, 1.0).when(F.col("found") == 0, 0.0).otherwise(f_half(F.lit(1.0), F.col("found") / F.col("n_true")))
    return d.groupBy("country").agg(F.round(F.avg(score), 6).alias("ceiling_f05"), F.round(F.sum("found") / F.greatest(F.sum("n_true"), F.lit(1)), 6).alias("recall"))


def missed_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(candidates.select("s1_id", "query_id"), ["s1_id", "query_id"], "left_anti")
