"""Models as rows of a table: many are fitted, cross-validated and applied in one pass.

A model row is (study, model, class, feature, slope, center, spread) and adds to the score
of its class ``slope * x``, and where ``spread`` is set the logarithm of a normal density
with that mean and variance. A row without a feature adds its slope as a constant. So a
Gaussian naive Bayes and a softmax regression are both such tables. The models of a study are
a bag: their probabilities are averaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import in_ranges, running

MODEL = ("study", "model", "class", "feature", "slope", "center", "spread")


def _term(x: Column) -> Column:
    apart = x - F.col("center")
    normal = -0.5 * (F.log("spread") + apart * apart / F.col("spread"))
    return F.col("slope") * x + F.when(F.col("spread") > 0, normal).otherwise(0.0)


def bayes_models(rows: DataFrame, smoothing: Column | float = 1e-10) -> DataFrame:
    """A Gaussian naive Bayes for each (study, model) of training ``rows`` (study, model,
    sample, label, feature, value). Every sample needs a row for every feature of its study.
    ``smoothing``, a number or a column of (study, model), is added to the variances."""
    keys = ["study", "model"]
    extra = smoothing if isinstance(smoothing, Column) else F.lit(smoothing)
    of = rows.groupBy(*keys, F.col("label").alias("class"), "feature").agg(
        F.avg("value").alias("center"), (F.var_pop("value") + F.max(extra)).alias("spread"), F.count("*").alias("n")
    )
    sizes = of.groupBy(*keys, "class").agg(F.max("n").alias("n"))
    whole = sizes.groupBy(*keys).agg(F.sum("n").alias("total"))
    none = F.lit(None).cast("double")
    prior = sizes.join(whole, keys).select(
        *keys, "class", F.lit(None).cast(rows.schema["feature"].dataType).alias("feature"),
        F.log(F.col("n") / F.col("total")).alias("slope"), none.alias("center"), none.alias("spread"),
    )
    return of.select(*keys, "class", "feature", F.lit(0.0).alias("slope"), "center", "spread").unionByName(prior)


def model_scores(models: DataFrame, values: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, study, model, class, score) of every sample under every model.

    ``values`` (sample, feature, value) leave out zeros: a model's score of an empty sample
    is summed up once, and only values that are there change it. So the join is on features
    and as large as the values that models ask for.
    """
    keys = ["study", "model", "class"]
    base = models.groupBy(*keys).agg(F.sum(F.when(F.col("feature").isNull(), F.col("slope")).otherwise(_term(F.lit(0.0)))).alias("base"))
    change = values.where("value <> 0").join(models, "feature").groupBy("sample", *keys).agg(
        F.sum(_term(F.col("value")) - _term(F.lit(0.0))).alias("change")
    )
    every = samples.select("sample").distinct().crossJoin(base)  # the result's own size
    return every.join(change, ["sample", *keys], "left").select("sample", *keys, (F.col("base") + F.coalesce("change", F.lit(0.0))).alias("score"))


def probabilities(scores: DataFrame) -> DataFrame:
    """(sample, study, model, class, probability): the softmax of a model's scores. Where it
    isn't finite the class of the greatest score, the last among equals, has it all."""
    own = Window.partitionBy("sample", "study", "model")  # a row a class
    top = scores.withColumn("_top", F.max("score").over(own)).withColumn("_last", F.max(F.struct("score", "class")).over(own)["class"])
    weight = F.exp(F.col("score") - F.col("_top"))
    share = top.withColumn("p", weight / F.sum(weight).over(own))
    finite = F.min(F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") < float("inf"))).over(own)
    one = F.when(F.col("class") == F.col("_last"), 1.0).otherwise(0.0)
    return share.select("sample", "study", "model", "class", F.when(finite, F.col("p")).otherwise(one).alias("probability"))


def predictions(models: DataFrame, values: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, study, class, probability, predicted): each study's models averaged, and its
    class, the last one of the greatest probability. For one sample against every model,
    pass that sample alone."""
    mean = probabilities(model_scores(models, values, samples)).groupBy("sample", "study", "class").agg(F.avg("probability").alias("probability"))
    own = Window.partitionBy("sample", "study")
    # Probabilities that differ in the last digits only are equal.
    best = F.max(F.struct(F.round("probability", 12), "class")).over(own)["class"]
    return mean.withColumn("predicted", F.col("class") == best)


def cross_validated(rows: DataFrame, smoothings: dict[str, float]) -> DataFrame:
    """(study, fold, sample, label, class, probability, predicted) of each sample by the model
    that its fold was left out of, for each named smoothing as a study.

    ``rows`` (sample, fold, label, feature, value); the models of all folds and studies are
    fitted at once and come back as one table.
    """
    named = F.create_map(*[c for k, v in smoothings.items() for c in (F.lit(k), F.lit(v))])
    folds = rows.select(F.col("fold").alias("model")).distinct()
    training = rows.join(folds, F.col("fold") != F.col("model")).withColumn("study", F.explode(F.array(*map(F.lit, smoothings))))
    models = bayes_models(training, named[F.col("study")])
    held = rows.select("sample", F.col("fold").alias("model"), "label").distinct()
    change = rows.where("value <> 0").select("sample", F.col("fold").alias("model"), "feature", "value").join(models, ["model", "feature"])
    keys = ["study", "model", "class"]
    change = change.groupBy("sample", *keys).agg(F.sum(_term(F.col("value")) - _term(F.lit(0.0))).alias("change"))
    base = models.groupBy(*keys).agg(F.sum(F.when(F.col("feature").isNull(), F.col("slope")).otherwise(_term(F.lit(0.0)))).alias("base"))
    scores = held.join(base, "model").join(change, ["sample", *keys], "left").select("sample", *keys, (F.col("base") + F.coalesce("change", F.lit(0.0))).alias("score"))
    found = probabilities(scores).join(held, ["sample", "model"])
    own = Window.partitionBy("sample", "study")
    best = F.max(F.struct(F.round("probability", 12), "class")).over(own)["class"]
    return found.select("study", F.col("model").alias("fold"), "sample", "label", "class", "probability", (F.col("class") == best).alias("predicted"))


def grid_search(predicted: DataFrame) -> DataFrame:
    """(study, accuracy, best): the mean over folds of balanced accuracies, and the study of
    the greatest, the first by name among equals."""
    own = predicted.where("predicted")
    recall = own.groupBy("study", "fold", "label").agg(F.avg((F.col("class") == F.col("label")).cast("double")).alias("recall"))
    folds = recall.groupBy("study", "fold").agg(F.avg("recall").alias("accuracy"))
    mean = folds.groupBy("study").agg(F.avg("accuracy").alias("accuracy"))
    order = Window.orderBy(F.desc(F.round("accuracy", 12)), "study")  # a row a study
    return mean.withColumn("best", F.row_number().over(order) == 1)


def roc_points(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, tpr, fpr): the rates of rows (by, label 0 or 1, score) whose score is at
    least that. Equal scores are one point; running sums go by ranges, so that a group of
    any size is no task's."""
    each = scored.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    order = [F.desc("score")]
    ranges = in_ranges(each, by, order)
    up = running(running(ranges, by, order, "pos", F.sum, "tp"), by, order, "neg", F.sum, "fp")
    whole = each.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    joined = up.join(whole, by)
    return joined.select(*by, "score", "pos", "neg", "tp", "fp", F.try_divide("tp", "P").alias("tpr"), F.try_divide("fp", "N").alias("fpr"), "P", "N")


def roc_area(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, area): the chance that a row of label 1 has the higher score of two, ties half;
    null where a group lacks a label."""
    points = roc_points(scored, by)
    won = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    return points.groupBy(*by).agg((F.sum(won) / F.nullif(F.max("P") * F.max("N"), F.lit(0))).alias("area"))
