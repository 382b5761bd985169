"""The G estimate of grounding effectiveness over evaluation rows (y, p, env), for any number of groups at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THIRDS = (1 / 3, 1 / 3, 1 / 3)
#: Ranges of p that predictions are ordered in.
SLOTS = 4096
#: The columns of an evaluation row, in order.
COLUMNS = ("run_id", "subject_id", "condition", "phase", "item_id", "claim_id", "env", "y", "p", "answer", "response", "source_anchor", "recognized_at", "contradiction_available_at", "recognition_lag", "fair_play_rating")


def valid_rows(rows: DataFrame) -> DataFrame:
    """rows with y as int and p as double; a y that is not the integer 0 or 1, a p outside 0 to 1 or an empty env raises when read."""
    y, p = F.trim(F.col("y").cast("string")).try_cast("int"), F.trim(F.col("p").cast("string")).try_cast("double")
    bad = y.isNull() | ~y.isin(0, 1) | p.isNull() | ~p.between(0, 1) | (F.coalesce(F.col("env"), F.lit("")) == "")
    return rows.withColumns({"y": F.when(bad, F.raise_error(F.lit("invalid evaluation row")).cast("int")).otherwise(y), "p": p})


def rejected_rows(rows: DataFrame) -> DataFrame:
    y, p = F.col("y").cast("string").try_cast("int"), F.col("p").cast("string").try_cast("double")
    return rows.where(y.isNull() | ~y.isin(0, 1) | p.isNull() | ~p.between(0, 1) | (F.coalesce(F.col("env"), F.lit("")) == ""))


def auc(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, positives, brier, auc): AUC from average ranks of tied predictions, 0.5 where a class is missing.

    Rows are first counted per distinct p. Predictions are numbered by SLOTS ranges of p: each range by itself, with the number of rows
    of lower ranges added, so no task orders all predictions of a group.
    """
    per_p = rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("y").cast("long")).alias("pos"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"))
    per_p = per_p.withColumn("slot", F.floor(F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) * (SLOTS - 1)).cast("int"))
    earlier = Window.unboundedPreceding
    slots = per_p.groupBy(*keys, "slot").agg(F.sum("m").alias("of_slot"))  # SLOTS rows a group at most
    slots = slots.withColumn("before", F.coalesce(F.sum("of_slot").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(earlier, -1)), F.lit(0))).drop("of_slot")
    inside = F.coalesce(F.sum("m").over(Window.partitionBy(*keys, "slot").orderBy("p").rowsBetween(earlier, -1)), F.lit(0))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.slot").eqNullSafe(F.col("b.slot"))]
    joined = per_p.withColumn("inside", inside).alias("a").join(slots.alias("b"), reduce(and_, same)).select("a.*", "b.before")
    ranked = joined.withColumn("rank", F.col("before") + F.col("inside") + (F.col("m") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum("pos").alias("positives"), (F.sum("sq") / F.sum("m")).alias("brier"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    return out.withColumn("auc", F.when((pos == 0) | (neg == 0), 0.5).otherwise(F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, (pos * neg).cast("double")))).drop("ranks")


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def g_estimate(rows: DataFrame, keys: Sequence[str] = (), target_env: str = "K", clean_env: str = "C", weights: Sequence[float] = THIRDS) -> DataFrame:
    """A row per group: G, S_T, S_D, S_R, their parts, and counts; G is 0 and warning set where an environment has no rows."""
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    w = [x / sum(weights) for x in weights]
    keys = list(keys)
    rows = rows.withColumn("__all", F.lit(1)) if not keys else rows
    by = keys or ["__all"]
    groups = rows.select(*by).distinct() if keys else rows.sparkSession.range(1).select(F.lit(1).alias("__all"))
    per_env = auc(rows.where(F.col("env").isin(target_env, clean_env)), [*by, "env"])
    pick = lambda env, c: F.max(F.when(F.col("env") == env, F.col(c)))
    wide = per_env.groupBy(*by).agg(
        pick(target_env, "n").alias("n_target"), pick(clean_env, "n").alias("n_clean"), pick(target_env, "brier").alias("brier_target"), pick(target_env, "auc").alias("auc_target"),
        pick(clean_env, "auc").alias("auc_clean"), pick(target_env, "positives").alias("positives"),
    )
    out = groups.join(wide, by, "left").fillna(0, ["n_target", "n_clean"])
    prevalence = F.try_divide("positives", "n_target")
    s_t = _clip(1 - F.col("brier_target") / F.greatest(prevalence * (1 - prevalence), F.lit(1e-12)))
    s_d = _clip((F.col("auc_target") - 0.5) / 0.5)
    s_r = _clip(1 - (F.col("auc_clean") - F.col("auc_target")) / F.greatest(F.col("auc_clean") - 0.5, F.lit(1e-12)))
    both = (F.col("n_target") > 0) & (F.col("n_clean") > 0)
    out = out.withColumns({"S_T": F.when(both, s_t), "S_D": F.when(both, s_d), "S_R": F.when(both, s_r), "prevalence": F.when(both, prevalence)})
    g = F.coalesce(w[0] * F.col("S_T") + w[1] * F.col("S_D") + w[2] * F.col("S_R"), F.lit(0.0))
    warning = F.when(~both, "both clean and target environments are required")
    return out.select(*keys, g.alias("G"), "S_T", "S_D", "S_R", "brier_target", "prevalence", "auc_target", "auc_clean", "n_clean", "n_target", warning.alias("warning"))


def experiment_summary(rows: DataFrame, group_by: str = "condition", **how) -> DataFrame:
    """g_estimate for all rows (label null) and for each label of group_by, blank ones as 'unlabeled'."""
    label = F.when(F.coalesce(F.col(group_by).cast("string"), F.lit("")) == "", "unlabeled").otherwise(F.col(group_by).cast("string"))
    groups = g_estimate(rows.withColumn("label", label), ["label"], **how)
    return g_estimate(rows, **how).withColumn("label", F.lit(None).cast("string")).unionByName(groups)


def manifest_warnings(rows: DataFrame, manifest: dict) -> list[str]:
    """Where a manifest's row_count, conditions or phases disagree with the rows."""
    listed = [F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c) for c in ("condition", "phase") if c in rows.columns]
    seen = {"condition": [], "phase": []} | rows.agg(F.count(F.lit(1)).alias("n"), *listed).first().asDict()
    out = []
    if manifest.get("row_count") is not None and int(manifest["row_count"]) != seen["n"]:
        out.append("manifest row_count does not match actual row count")
    for key, c in (("conditions", "condition"), ("phases", "phase")):
        declared = sorted(map(str, manifest.get(key) or []))
        if declared and declared != list(seen[c]):
            out.append(f"manifest {key} do not match row {key}")
    return out


def compare(summaries: DataFrame, baseline: str | None = None) -> DataFrame:
    """summaries: (experiment_id, G, input_pos). Adds rank (G descending, then input order) and delta_from_baseline.

    The baseline is the named experiment, or the lowest of the order. A row per experiment: one window over all of them.
    """
    order = Window.orderBy(F.desc("G"), "input_pos")
    ranked = summaries.withColumn("rank", F.row_number().over(order))
    picked = F.max(F.struct("rank", "G")) if baseline is None else F.min(F.when(F.col("experiment_id") == baseline, F.struct("rank", "G")))
    base = ranked.agg(picked.alias("b")).select(F.coalesce("b.G", F.lit(0.0)).alias("base"))
    return ranked.crossJoin(F.broadcast(base)).withColumn("delta_from_baseline", F.col("G") - F.col("base")).drop("base")  # one row


def delta_g(rows: DataFrame, phase: Column, **how) -> DataFrame:
    """One row: G of rows where phase is 'before' and 'after', their difference, and that over what was left to gain."""
    per = g_estimate(rows.withColumn("__phase", phase), ["__phase"], **how)
    pick = lambda p: F.coalesce(F.max(F.when(F.col("__phase") == p, F.col("G"))), F.lit(0.0))
    out = per.agg(pick("before").alias("G_before"), pick("after").alias("G_after")).withColumn("delta_G", F.col("G_after") - F.col("G_before"))
    return out.withColumn("normalized_delta_G", F.col("delta_G") / F.greatest(1 - F.col("G_before"), F.lit(1e-12)))


def level_sensitivity(rows: DataFrame, level: str, baseline: str, **how) -> DataFrame:
    """(level, G, delta_from_baseline): G under each assumed reliability level."""
    per = g_estimate(rows, [level], **how).select(level, "G")
    base = per.agg(F.coalesce(F.max(F.when(F.col(level) == baseline, F.col("G"))), F.lit(0.0)).alias("base"))
    return per.crossJoin(F.broadcast(base)).select(level, "G", (F.col("G") - F.col("base")).alias("delta_from_baseline"))  # one row


def comparison_warnings(summaries: DataFrame) -> DataFrame:
    """(code): why summaries should be compared with care. summaries: a row each with evaluation_target, corpus, n_clean, n_target and warnings (array)."""
    distinct = lambda c: F.count_distinct(F.nullif(c, F.lit("")))
    one = summaries.agg(
        (distinct("evaluation_target") > 1).alias("mixed_evaluation_targets"), (distinct("corpus") > 1).alias("mixed_corpora"), (F.count_if(F.coalesce("n_clean", F.lit(0)) == 0) > 0).alias("no_clean_rows"),
        (F.count_if(F.coalesce("n_target", F.lit(0)) == 0) > 0).alias("no_target_rows"), (F.count_if(F.size("warnings") > 0) > 0).alias("inconsistent_manifests"),
    )
    return one.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c), c) for c in one.columns]))).alias("code"))
