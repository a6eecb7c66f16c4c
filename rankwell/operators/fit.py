"""Fitting the baseline models with Spark ML, and the studies built on them."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
)
from pyspark.ml.feature import (
    Bucketizer,
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell.functions.ordinal import class_at, rank_of
from rankwell.operators import judge, uncertain
from rankwell.operators.curate import in_languages, known_classes_only, with_label
from rankwell.session import discard, discard_folder, scratch_path, shared_folder, written, written_counted

#: Words of two and more characters, Unicode letters included.
TOKEN = r"(?U)\b\w\w+\b"
#: N-grams of a text model at most, by document frequency, and the documents each needs.
#: The bound keeps the coefficients on the driver at a fixed size.
VOCABULARY = 1 << 16
DOCUMENTS = 1
#: Rows of a tree fit in one partition, about, and fits of a study at a time.
FIT_ROWS = 10_000
PARALLEL_FITS = 4
#: Bins of a feature's values in a tree fit, and the quantiles per class that place them.
TREE_BINS = 32
QUANTILES = 1_000
#: N-grams of one document frequency that are ranked in one task, about.
TIED_ROWS = 250_000


def class_weights(frame: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): weights with which every class counts the same.

    One row per class of a short fixed list.
    """
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    whole = totals.select(F.col("rows") / F.col("k")).scalar()
    return counts.select(label, "n", (whole / F.col("n")).alias("weight"))


def balanced(frame: DataFrame, classes: Sequence[str], label: str) -> DataFrame:
    """Add ``label_index`` and the class's weight."""
    weights = class_weights(frame, label).drop("n")
    return frame.join(F.broadcast(weights), label).withColumn(
        "label_index", rank_of(F.col(label), classes).cast("double")
    )


# --------------------------------------------------------------------- text model
@dataclass(frozen=True)
class TextModel:
    """1-3 grams, smooth TF-IDF, unit length, balanced logistic regression."""

    stages: tuple
    classes: tuple[str, ...]

    def score(self, frame: DataFrame) -> DataFrame:
        """Add raw ``scores``, the ``answer`` and its ``confidence``."""
        scored = _featured(frame, self.stages[:-1])
        scored = self.stages[-1].transform(scored)
        raw = vector_to_array("rawPrediction")
        return (
            scored.withColumn("scores", raw)
            .withColumn("answer", class_at(F.col("prediction"), self.classes))
            .withColumn("confidence", F.array_max(vector_to_array("probability")))
            .drop("features", "rawPrediction", "probability", "prediction")
        )


def _grams(frame: DataFrame, column: str, stages: Sequence) -> DataFrame:
    tokenizer, two, three = stages
    words = tokenizer.transform(frame)
    words = three.transform(two.transform(words))
    return words.withColumn("_grams", F.concat("_w1", "_w2", "_w3")).drop("_w1", "_w2", "_w3")


def _featured(frame: DataFrame, stages: Sequence) -> DataFrame:
    grams = _grams(frame, "", stages[:3])
    counter, scaler, normalizer = stages[3:]
    vectors = normalizer.transform(scaler.transform(counter.transform(grams)))
    return vectors.drop("_grams", "_counts", "_scaled")


def gram_stages(text: str) -> list:
    """Words in lower case, and their pairs and triples."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_w1", pattern=TOKEN, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_w1", outputCol="_w2"),
        NGram(n=3, inputCol="_w1", outputCol="_w3"),
    ]


def vocabulary(
    frame: DataFrame, text: str, most: int = VOCABULARY, documents: int = DOCUMENTS
) -> DataFrame:
    """(gram, df): the n-grams with the highest document frequencies, ties by the n-gram.

    At most ``most``, each in ``documents`` documents or more.  An exact count over all
    documents: one grouping, combined on the map side.  N-grams of one document, most of
    all, are stored only where the others are too few.
    """
    grams = _grams(frame.select(text), text, gram_stages(text))
    counted = grams.select(F.explode(F.array_distinct("_grams")).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("df")
    )
    least = max(documents, 2)
    stored, n = written_counted(counted.filter(F.col("df") >= least), "grams")
    if n < most and documents < least:
        discard(stored)
        stored = written(counted.filter(F.col("df") >= documents), "grams")
    return most_frequent(stored, most).orderBy(F.desc("df"), "gram")


def most_frequent(stored: DataFrame, most: int, step: int = TIED_ROWS) -> DataFrame:
    """The ``most`` rows (gram, df) of a stored table with the highest df, ties by the n-gram.

    Rows above the df of the cut are taken as they are.  Those of that df are dealt by
    ranges of about ``step`` rows, and the rows of one range are ranked, so no task reads
    the candidates of all others.
    """
    upto = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per distinct frequency
    counts = stored.groupBy("df").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto))
    cut = counts.filter((F.col("upto") >= most) & (F.col("upto") - F.col("c") < most)).first()
    if cut is None:
        return stored
    above = stored.filter(F.col("df") > cut.df)
    need = most - (cut.upto - cut.c)
    ties = stored.filter(F.col("df") == cut.df)
    if need == cut.c:
        return above.unionByName(ties)
    dealt = ties.repartitionByRange(-(-cut.c // step), "gram").withColumn("part", F.spark_partition_id())
    ranged = written(dealt, "ties")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select(
        "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before")
    ).filter(F.col("before") < need)
    place = F.row_number().over(Window.partitionBy("part").orderBy("gram")) + F.col("before")
    lowest = ranged.join(F.broadcast(offsets), "part").withColumn("place", place).filter(F.col("place") <= need)
    return above.unionByName(lowest.select("gram", "df"))


def smooth_idf(df: Column, n: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((n + 1) / (df + 1)) + 1


def _plain(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model without its training summary, by saving and loading it.

    The summary holds the session, which cannot be sent to tasks once it has observed rows.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "model")
    model.write().save(path)
    try:
        return LogisticRegressionModel.load(path)
    finally:
        discard_folder(spark, path)


def fit_text(
    train: DataFrame,
    text: str,
    label: str,
    classes: Sequence[str],
    most: int = VOCABULARY,
    documents: int = DOCUMENTS,
    max_iter: int = 2000,
    tol: float = 1e-4,
) -> TextModel:
    """Fit on labelled rows, over the exact vocabulary of at most ``most`` n-grams.

    IDF is ln((1+n)/(1+df)) + 1.  The penalty is 1/n, the same objective as an inverse
    strength of 1 over summed losses.
    """
    rows = balanced(with_label(train, label), classes, label)
    stages = gram_stages(text)
    grams = vocabulary(rows, text, most, documents)
    known = grams.collect() or [("", 0)]
    discard(grams)
    counter = CountVectorizerModel.from_vocabulary(
        [gram for gram, _ in known], inputCol="_grams", outputCol="_counts"
    )
    # every iteration reads the vectors alone: texts and n-grams are not kept beside them
    vectors = counter.transform(_grams(rows, text, stages)).select("label_index", "weight", "_counts")
    counted, n = written_counted(vectors, "counts")
    try:
        scale = DenseVector([math.log((n + 1) / (df + 1)) + 1 for _, df in known])
        scaler = ElementwiseProduct(scalingVec=scale, inputCol="_counts", outputCol="_scaled")
        normalizer = Normalizer(p=2.0, inputCol="_scaled", outputCol="features")
        learner = LogisticRegression(
            featuresCol="features", labelCol="label_index", weightCol="weight",
            family="auto", maxIter=max_iter, tol=tol, regParam=1.0 / max(1, n),
            elasticNetParam=0.0, standardization=False,
        )
        model = _plain(learner.fit(normalizer.transform(scaler.transform(counted))))
    finally:
        discard(counted)
    # a class never seen in training has no coefficient beyond the last one seen
    return TextModel((*stages, counter, scaler, normalizer, model), tuple(classes))


# --------------------------------------------------------------------- tree model
def assembled(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature matrix as one vector column."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(frame)


@dataclass(frozen=True)
class TreeModel:
    """Balanced boosted trees over numeric features, one against the rest."""

    model: object
    features: tuple[str, ...]
    classes: tuple[str, ...]
    bins: Bucketizer

    def score(self, frame: DataFrame) -> DataFrame:
        scored = self.model.transform(assembled(self.bins.transform(frame), self.bins.getOutputCols()))
        raw = vector_to_array("rawPrediction")
        return (
            scored.withColumn("scores", raw)
            .withColumn("answer", class_at(F.col("prediction"), self.classes))
            .drop("features", "rawPrediction", "probability", "prediction", *self.bins.getOutputCols())
        )

    def importance(self, spark) -> DataFrame:
        """(feature, importance): the number of splits on it in all trees."""
        splits = [0.0] * len(self.features)
        for part in getattr(self.model, "models", [self.model]):
            # every split is printed once, with the side that goes left
            for number in re.findall(r"If \(feature (\d+) ", part.toDebugString):
                splits[int(number)] += 1.0
        return spark.createDataFrame(
            list(zip(self.features, splits, strict=True)), "feature string, importance double"
        )


def bin_ends(points: Sequence[float], bins: int = TREE_BINS) -> list[float]:
    """The first values of all bins but the lowest, so that bins hold equal shares of ``points``.

    Values that fill several shares leave ends over, so the shares are made as fine as
    ``bins`` allows.
    """
    ordered = sorted(points)
    best: list[float] = []
    for shares in range(2, len(ordered) + 1):
        at = [ordered[k * len(ordered) // shares] for k in range(1, shares)]
        ends = sorted(set(at) - {ordered[0]})
        if len(ends) >= bins:
            break
        best = max(best, ends, key=len)
    return best


def tree_bins(rows: DataFrame, label: str, features: Sequence[str]) -> Bucketizer:
    """The bin of each feature's value, from quantiles of each class over all its rows.

    Classes count the same, as in the fit.  The driver gets ``QUANTILES`` numbers per class
    and feature.
    """
    shares = [(k + 0.5) / QUANTILES for k in range(QUANTILES)]
    points = rows.groupBy(label).agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).collect()
    splits = []
    for f in features:
        pooled = [p for row in points for p in row[f] or ()]
        ends = bin_ends(pooled) or [0.0]
        splits.append([-math.inf, *ends, math.inf])
    return Bucketizer(
        splitsArray=splits, inputCols=list(features), outputCols=[f"_bin_{f}" for f in features]
    )


def fit_trees(
    train: DataFrame,
    label: str,
    classes: Sequence[str],
    features: Sequence[str],
    rounds: int = 300,
    depth: int = 5,
) -> TreeModel:
    """Boosted trees on a feature subset; a depth of 5 allows 32 leaves.

    Trees see a value only by its bin, so rows of one class with equal bins are one row of
    their summed weight in every round: the sums of every split are those over all rows.
    """
    rows = balanced(with_label(train, label), classes, label)
    booster = GBTClassifier(
        featuresCol="features", labelCol="label_index", weightCol="weight",
        maxIter=rounds, maxDepth=depth, maxBins=TREE_BINS, seed=7,
    )
    shared_folder(train.sparkSession)  # every tenth round is checkpointed there
    narrow = written(rows.select(*features, "label_index", "weight"), "training")
    bins = tree_bins(narrow, "label_index", features)
    cells, n = written_counted(
        bins.transform(narrow).groupBy("label_index", *bins.getOutputCols()).agg(F.sum("weight").alias("weight")),
        "cells",
    )
    # every round is a few jobs over all rows: small tables in few tasks
    parts = max(1, -(-n // FIT_ROWS))
    vectors = assembled(cells, bins.getOutputCols()).select("features", "label_index", "weight")
    kept = vectors.repartition(parts).persist()
    try:
        if len(classes) == 2:
            model = booster.fit(kept)
        else:
            model = OneVsRest(
                classifier=booster, featuresCol="features", labelCol="label_index",
                weightCol="weight",
            ).fit(kept)
    finally:
        kept.unpersist()
        discard(narrow)
        discard(cells)
    return TreeModel(model, tuple(features), tuple(classes), bins)


def split_histogram(
    rows: DataFrame, label_index: str, weight: str, features: Sequence[str], bins: int = 255
) -> DataFrame:
    """(feature, upto, total, positive): weighted sums per feature and bin of its values.

    Bins end at quantiles, so a feature has ``bins`` of them at most; one grouping sums all
    features at once.
    """
    shares = [k / bins for k in range(1, bins + 1)]
    ends = rows.agg(*[F.array_distinct(F.percentile_approx(f, shares, 100_000)).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    table = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"ends of {f}"))])
    joined = rows.select(cells.alias("cells"), label_index, weight).crossJoin(
        F.broadcast(ends.select(*[F.col(f).alias(f"ends of {f}") for f in features]))  # one row
    )
    valued = joined.select(F.inline("cells"), table.alias("ends"), label_index, weight)
    upto = F.array_min(F.filter(F.element_at("ends", F.col("feature")), lambda end: end >= F.col("value")))
    return valued.select("feature", upto.alias("upto"), label_index, weight).groupBy("feature", "upto").agg(
        F.sum(weight).alias("total"), F.sum(F.col(weight) * F.col(label_index)).alias("positive")
    )


def best_splits(histogram: DataFrame) -> DataFrame:
    """(feature, upto, gain): per feature the split of highest gain, ties to the lower end.

    The gain is the fall of the weighted variance of a 0/1 label.  Features without a
    split are left out.  The histogram has a bounded number of rows per feature.
    """
    before = Window.partitionBy("feature").orderBy("upto")
    whole = Window.partitionBy("feature")
    summed = histogram.select(
        "feature", "upto", F.sum("total").over(before).alias("l"), F.sum("positive").over(before).alias("lp"),
        F.sum("total").over(whole).alias("n"), F.sum("positive").over(whole).alias("p"),
        F.max("upto").over(whole).alias("last"),
    ).filter(F.col("upto") < F.col("last"))
    square = lambda total, n: total * total / n
    gain = (
        square(F.col("lp"), F.col("l")) + square(F.col("p") - F.col("lp"), F.col("n") - F.col("l"))
        - square(F.col("p"), F.col("n"))
    )
    best = F.max_by(F.struct("upto", "gain"), F.struct(F.round("gain", 9), -F.col("upto")))
    return summed.withColumn("gain", gain).groupBy("feature").agg(best.alias("b")).select("feature", "b.*")


def top_importances(importance: DataFrame, most: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(most)


# ------------------------------------------------------------------------ studies
def check_partition(families: Mapping[str, Sequence[str]], features: Sequence[str]) -> None:
    """Every feature belongs to exactly one family."""
    named = sorted(f for members in families.values() for f in members)
    if named != sorted(features):
        raise ValueError("the families must partition the feature list exactly")


def family_ablation(
    train: DataFrame,
    test: DataFrame,
    label: str,
    classes: Sequence[str],
    families: Mapping[str, Sequence[str]],
    rounds: int = 300,
) -> DataFrame:
    """Metrics of the full tree model and of one model without each family."""
    features = [f for members in families.values() for f in members]
    check_partition(families, features)
    variants = {"full": features} | {
        f"without_{name}": [f for f in features if f not in members]
        for name, members in families.items()
    }
    # the fits do not depend on one another, so their jobs fill the cluster together
    train, test = (written(frame.select(label, *features), "ablation") for frame in (train, test))
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fits = {
            name: pool.submit(inheritable_thread_target(train.sparkSession)(fit_trees), train, label, classes, chosen, rounds)
            for name, chosen in variants.items()
        }
        models = {name: done.result() for name, done in fits.items()}
    results = None
    for name, model in models.items():
        scored = judge.metrics(model.score(with_label(test, label)), classes, label=label)
        named = scored.select(F.lit(name).alias("name"), "*")
        results = named if results is None else results.unionByName(named)
    return results


def text_ablation(
    train: DataFrame,
    test: DataFrame,
    label: str,
    classes: Sequence[str],
    inputs: Mapping[str, str],
    max_iter: int = 2000,
) -> DataFrame:
    """The same text model on several inputs: name -> column."""
    results = None
    for name, column in inputs.items():
        model = fit_text(train, column, label, classes, max_iter=max_iter)
        scored = judge.metrics(model.score(with_label(test, label)), classes, label=label)
        named = scored.select(F.lit(name).alias("name"), "*")
        results = named if results is None else results.unionByName(named)
    return results


def transfer(
    train: DataFrame,
    test: DataFrame,
    text: str,
    label: str,
    classes: Sequence[str],
    languages: Sequence[str],
    max_iter: int = 2000,
) -> DataFrame:
    """Train on some languages, score every language apart."""
    model = fit_text(
        in_languages(train, languages), text, label, classes, max_iter=max_iter
    )
    scored = model.score(with_label(test, label))
    return judge.metrics(scored, classes, ["language"], label=label)


def calibrated_scores(
    scored: DataFrame, val: DataFrame, classes: Sequence[str], label: str
) -> tuple[DataFrame, float]:
    """Fit a temperature on ``val`` and apply it to ``scored``."""
    ranked = val.withColumn("true_rank", rank_of(F.col(label), classes))
    temperature, _ = uncertain.fit_temperature(ranked)
    proba = uncertain.with_probabilities(scored, temperature)
    return uncertain.with_prediction(proba, classes), temperature


def ladder(
    splits: Mapping[str, DataFrame],
    label: str,
    classes: Sequence[str],
    rule: Column,
    text: str,
    features: Sequence[str],
    rounds: int = 300,
    max_iter: int = 2000,
) -> DataFrame:
    """Rule, text model and tree model on one test split, the fitted ones calibrated.

    Validation rows whose class was never trained on are left out of calibration.
    """
    train, val, test = (with_label(splits[s], label) for s in ("train", "val", "test"))
    val = known_classes_only(val, train, label)
    ruled = judge.metrics(test.withColumn("answer", rule), classes, label=label)
    results = ruled.select(
        F.lit("rung0_rule").alias("name"), "*",
        F.lit(None).cast("double").alias("ece"), F.lit(None).cast("double").alias("temperature"),
    )
    models = {
        "rung1_text": fit_text(train, text, label, classes, max_iter=max_iter),
        "rung2_trees": fit_trees(train, label, classes, features, rounds),
    }
    for name, model in models.items():
        scored, temperature = calibrated_scores(
            model.score(test), model.score(val), classes, label
        )
        judged = judge.metrics(scored, classes, label=label)
        ece = uncertain.expected_calibration_error(
            scored.withColumn("correct", F.col("answer") == F.col(label))
        )
        results = results.unionByName(
            judged.select(
                F.lit(name).alias("name"), "*",
                ece.select("ece").scalar().alias("ece"),
                F.lit(temperature).alias("temperature"),
            )
        )
    return results
