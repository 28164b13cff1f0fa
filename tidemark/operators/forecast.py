"""Monthly retention cohorts, their curves, and a forest that predicts them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timefn import month_index
from tidemark.operators.ordered import exact_percentiles
from tidemark.operators.orders import done
from tidemark.session import checkpointed

DIMS = ["acquired", "latest", "chronic", "discounted", "hub", "courier", "source"]
MILESTONES = (7, 14, 21, 28)
TARGETS = ["retention_7", "retention_14", "retention_21", "retention_28", "retention"]
# fixed values: trees per target, least customers of a cohort that is fitted or scored
FOREST = {"retention_7": 150, "retention_14": 150, "retention_21": 100, "retention_28": 150, "retention": 150}
LEAST = 75
SOURCES = ["Affiliates", "Facebook", "Google", "Organic", "Others"]
AGES = ["M1", "M2", "M3", "M4", "M5", "M6", "M6+"]


def _age(at: Column, month: Column) -> Column:
    """M1 to M6 by calendar months, M6+ for anything else."""
    n = month_index(month) - month_index(at)
    return F.when(n.between(1, 6), F.concat(F.lit("M"), n.cast("string"))).otherwise("M6+")


def cohort_customers(orders: DataFrame, profile: DataFrame, months: Sequence[str]) -> DataFrame:
    """One row per customer and month: the cohort of the latest fulfilled order before the month,
    and the day of the first order in it. All months come from one scan and one shuffle.
    """
    placed = F.col("placed_at")
    day = F.to_date(placed)
    aggs = [F.min(F.when(done(), placed)).alias("first_at")]
    for i, m in enumerate(months):
        start = F.lit(m).cast("date")
        before = done() & (day < start)
        inside = (day >= start) & (day < F.add_months(start, 1))
        aggs += [F.max_by(F.struct("placed_at", "chronic", "discounted", "hub", "courier"),
                          F.when(before, F.col("order_id"))).alias(f"last{i}"),
                 F.min(F.when(inside, day)).alias(f"next{i}")]
    per = orders.groupBy("customer_id").agg(*aggs)
    stacked = per.select("customer_id", "first_at", F.inline(F.array(*[
        F.struct(F.lit(m).cast("date").alias("month"), F.col(f"last{i}").alias("last"),
                 F.dayofmonth(f"next{i}").alias("next_day")) for i, m in enumerate(months)])))
    rows = stacked.filter("last is not null").join(profile, "customer_id")
    return rows.select(
        "customer_id", "month", "next_day", _age(F.col("first_at"), F.col("month")).alias("acquired"),
        _age(F.col("last.placed_at"), F.col("month")).alias("latest"),
        F.col("last.chronic").alias("chronic"), F.col("last.discounted").alias("discounted"),
        F.col("last.hub").alias("hub"), F.col("last.courier").alias("courier"), "source")


def cohort_size(customers: DataFrame) -> DataFrame:
    return customers.groupBy("month", *DIMS).agg(F.count(F.lit(1)).alias("customers"))


def cohort_curve_daily(customers: DataFrame) -> DataFrame:
    """Returning customers per cohort and day with their running total (at most 31 days each)."""
    daily = (customers.filter("next_day is not null").groupBy("month", *DIMS, "next_day")
             .agg(F.count(F.lit(1)).alias("customers")))
    w = Window.partitionBy("month", *DIMS).orderBy("next_day").rowsBetween(
        Window.unboundedPreceding, 0)
    return daily.withColumn("running", F.sum("customers").over(w))


def cohort_curve(daily: DataFrame, milestones: Sequence[int] = MILESTONES) -> DataFrame:
    """The running total at each milestone day and at the end of the month."""
    return daily.groupBy("month", *DIMS).agg(
        *[F.coalesce(F.max(F.when(F.col("next_day") <= m, F.col("running"))), F.lit(0))
          .alias(f"retained_{m}") for m in milestones], F.max("running").alias("retained"))


def retention_pct(curve: DataFrame, size: DataFrame,
                  milestones: Sequence[int] = MILESTONES) -> DataFrame:
    """Retention in percent per milestone for cohorts with any return."""
    both = curve.join(size, ["month", *DIMS])
    pct = lambda c: F.coalesce(F.try_divide(F.col(c) * 100, F.col("customers")), F.lit(0.0))
    return both.select("month", *DIMS, "customers",
                       *[pct(f"retained_{m}").alias(f"retention_{m}") for m in milestones],
                       pct("retained").alias("retention"))


def training_set(orders: DataFrame, profile: DataFrame, months: Sequence[str]) -> DataFrame:
    """Retention percentages of several months under each other."""
    people = cohort_customers(orders, profile, months)
    return retention_pct(cohort_curve(cohort_curve_daily(people)), cohort_size(people))


def iqr_outliers(df: DataFrame, target: str, dims: Sequence[str] = ("source", "chronic", "discounted"),
                 k: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences of any one dimension."""
    parts = []
    for d in dims:
        q = exact_percentiles(df, [d], target, {"q1": .25, "q3": .75})
        spread = F.col("q3") - F.col("q1")
        parts.append(df.join(q, d).filter((F.col(target) < F.col("q1") - k * spread)
                                          | (F.col(target) > F.col("q3") + k * spread)).select(df.columns))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def drop_outliers(df: DataFrame, target: str, per_month: bool = False, **options) -> DataFrame:
    """Removes every cohort that is an outlier in any month (or only that month's row)."""
    key = [*(["month"] if per_month else []), *DIMS]
    bad = iqr_outliers(df, target, **options).select(*key).distinct()
    return df.join(bad, key, "left_anti")


def one_hot(df: DataFrame, hubs: Sequence[str], sources: Sequence[str] = SOURCES) -> DataFrame:
    """0/1 columns over fixed vocabularies; the labels stay beside them."""
    vocab = {"acquired": ("am", AGES), "latest": ("lom", AGES), "hub": ("sc", hubs),
             "source": ("is", sources)}
    return df.withColumns({
        feature_name(p, v): F.when(F.col(c) == v, 1).otherwise(0)
        for c, (p, values) in vocab.items() for v in values})


def feature_name(prefix: str, value: str) -> str:
    return f"{prefix}_{value.lower().replace(' ', '_').replace('+', '_plus')}"


def feature_columns(hubs: Sequence[str], sources: Sequence[str] = SOURCES) -> list[str]:
    groups = (("am", AGES), ("lom", AGES), ("sc", hubs), ("is", sources))
    return ["chronic", "discounted", "courier",
            *[feature_name(p, v) for p, values in groups for v in values], "customers"]


def min_cohort(df: DataFrame, least: int = LEAST) -> DataFrame:
    return df.filter(F.col("customers") >= least)


def unhot(df: DataFrame, hubs: Sequence[str], sources: Sequence[str] = SOURCES) -> DataFrame:
    """Labels back from the 0/1 columns."""
    groups = {"acquired": ("am", AGES), "latest": ("lom", AGES), "hub": ("sc", hubs),
              "source": ("is", sources)}
    labels = {f"{c}_label": F.coalesce(*[F.when(F.col(feature_name(p, v)) == 1, v) for v in values])
              for c, (p, values) in groups.items()}
    return df.withColumns(labels)


def forest(target: str, features: Sequence[str], seed: int = 42) -> Pipeline:
    """A forest with the target's number of trees, leaves of two cohorts at least, as deep as MLlib grows trees."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestRegressor(labelCol=target, predictionCol=target + "_predicted", numTrees=FOREST[target],
                              minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=30, seed=seed)])


def split_rule() -> Column:
    """True for the about 70 % of cohorts to fit on: by the first digits of the MD5 of the cohort's key as text,
    so a rerun on other executors, or another engine, splits the same way."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("month", *DIMS)])
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % 100 < 70


def fit_retention_model(df: DataFrame, target: str, features: Sequence[str],
                        least: int = LEAST) -> tuple[PipelineModel, DataFrame]:
    """A forest fitted on about 70 percent of the cohorts of `least` customers, and its predictions on the rest."""
    rows = min_cohort(df, least)
    model = forest(target, features).fit(rows.filter(split_rule()))
    return model, model.transform(rows.filter(~split_rule()))


def quality_gate(predicted: DataFrame, target: str, k: int, least: float = 0.85) -> dict:
    """R squared, adjusted for the number of features, against the acceptance threshold."""
    n = predicted.count()
    r2 = RegressionEvaluator(labelCol=target, predictionCol=target + "_predicted",
                             metricName="r2").evaluate(predicted)
    adjusted = 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else float("nan")
    return {"target": target, "n": n, "k": k, "r2": r2, "adjusted_r2": adjusted, "accepted": adjusted >= least}


def fit_target(df: DataFrame, target: str, features: Sequence[str], folder: str, least: int = LEAST) -> tuple[str, dict]:
    """Fits one target, refits it on all cohorts of `least` customers if it is accepted, and saves the model."""
    # read by every pass of the fit, the evaluation and the refit
    clean = checkpointed(drop_outliers(df, target))
    model, predicted = fit_retention_model(clean, target, features, least)
    gate = quality_gate(predicted, target, len(features))
    if gate["accepted"]:
        model = forest(target, features).fit(min_cohort(clean, least))
    path = f"{folder}/{target}"
    model.write().overwrite().save(path)
    return path, gate


def fit_all(df: DataFrame, features: Sequence[str], folder: str, targets: Sequence[str] = TARGETS,
            least: int = LEAST) -> tuple[dict[str, str], list[dict]]:
    """Fits all targets side by side, each in a thread and a scheduler pool of its own.

    A cohort table is small against a cluster, so one forest's jobs leave most cores idle; under the FAIR
    scheduler (spark.scheduler.mode) the pools share them. Returns the saved paths and the gate of each target, in
    the order of `targets`; targets under the threshold are the gates with accepted false.
    """
    context = df.sparkSession.sparkContext
    done: dict[str, tuple[str, dict]] = {}
    failed: list[BaseException] = []

    def work(target: str) -> None:
        try:
            context.setLocalProperty("spark.scheduler.pool", f"fit-{target}")
            done[target] = fit_target(df, target, features, folder, least)
        except BaseException as e:  # noqa: BLE001 - raised below, in the thread that called
            failed.append(e)

    threads = [InheritableThread(target=work, args=(t,), session=df.sparkSession) for t in targets]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failed:
        raise failed[0]
    return {t: done[t][0] for t in targets}, [done[t][1] for t in targets]


def predict_next_month(df: DataFrame, paths: Mapping[str, str], month: str, least: int = LEAST) -> DataFrame:
    """One prediction column per target for cohorts of `least` customers, and the month they are made for."""
    out = min_cohort(df, least)
    for path in paths.values():
        out = PipelineModel.load(path).transform(out).drop("features")
    return out.withColumn("prediction_month", F.lit(month))
