"""Out-of-time prediction and its metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.operators.text import unigrams_and_bigrams
from poolscope.plans.spec import SPEC

def predict(train: DataFrame, hold: DataFrame, columns: list[str], y: str, flag: str, ridge: float = 1e-6) -> DataFrame:
    """hold with pred (of y) and prob (of flag), by deterministic solvers on the training rows. Rows with a null feature are left out."""
    parts = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip")
    train, hold = parts.transform(train), parts.transform(hold)
    line = LinearRegression(featuresCol="_features", labelCol=y, predictionCol="pred", regParam=ridge, solver="normal").fit(train)
    logit = LogisticRegression(featuresCol="_features", labelCol=flag, predictionCol="_class", probabilityCol="_prob", rawPredictionCol="_raw", regParam=ridge).fit(train)
    out = logit.transform(line.transform(hold))
    return out.withColumn("prob", vector_to_array("_prob")[1]).drop("_features", "_prob", "_raw", "_class")


def text_vectors(texts: DataFrame, train: DataFrame, buckets: int = SPEC.hash_buckets, key: str = "text_id", tokens: str = "tokens") -> DataFrame:
    """(key, vector): each text's words and pairs of words as a sparse vector of length 1 over hashed buckets, weighed by tf * ln((1 + N) / (1 + df)).

    Document frequencies are of the rows of train (key), so a text that several share counts for each. What every training row has weighs nothing; a text
    of such terms alone, without words, or null, is a vector of zeros. The number of buckets bounds what is summed and broadcast, whatever the vocabulary.
    """
    terms = unigrams_and_bigrams(F.coalesce(tokens, F.array().cast("array<string>")))
    counts = HashingTF(numFeatures=buckets, inputCol="_terms", outputCol="_tf").transform(texts.select(key, terms.alias("_terms"))).select(key, "_tf")
    weighed = IDF(inputCol="_tf", outputCol="_weighed").fit(train.select(key).join(counts, key)).transform(counts)
    return Normalizer(inputCol="_weighed", outputCol="vector").transform(weighed).select(key, "vector")


def predict_sparse(train: DataFrame, hold: DataFrame, columns: list[str], vector: str, y: str, flag: str, ridge: float = 1e-4, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """predict() with a sparse vector beside the columns. Rows with a null feature are left out.

    Columns are centred and scaled by the training rows; the vector is taken as it is, and both are penalised alike. Each round is one pass over the sparse
    training rows, whose gradients are summed in a tree, so the driver holds a few vectors of the features' fixed number and never a matrix of them.
    """
    dense = VectorAssembler(inputCols=columns, outputCol="_dense", handleInvalid="skip")
    both = VectorAssembler(inputCols=["_scaled", vector], outputCol="_features", handleInvalid="skip")
    train, hold = dense.transform(train), dense.transform(hold)
    scaler = StandardScaler(withMean=True, inputCol="_dense", outputCol="_scaled").fit(train)
    train = both.transform(scaler.transform(train)).select("_features", F.col(y).cast("double").alias(y), F.col(flag).cast("double").alias(flag)).persist()
    shared = {"featuresCol": "_features", "regParam": ridge, "maxIter": rounds, "tol": tol, "standardization": False}
    line = LinearRegression(labelCol=y, predictionCol="pred", solver="l-bfgs", **shared).fit(train)
    logit = LogisticRegression(labelCol=flag, predictionCol="_class", probabilityCol="_prob", rawPredictionCol="_raw", family="binomial", **shared).fit(train)
    train.unpersist()
    out = logit.transform(line.transform(both.transform(scaler.transform(hold))))
    return out.withColumn("prob", vector_to_array("_prob")[1]).drop("_dense", "_scaled", "_features", "_prob", "_raw", "_class")


#: Ranges of probability that are ranked apart.
RANGES = 4096


def auc(df: DataFrame, flag: str, prob: str) -> DataFrame:
    """One row, auc: the chance that a positive row has the higher probability, ties counting half.

    Rows are counted per probability first. Negatives below a probability are those of lower ranges, from a window over RANGES totals, and those before
    it in its own range, from a window in each.
    """
    p = F.col(prob).cast("double")
    counts = df.groupBy(F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * RANGES).alias("r"), p.alias("p")).agg(F.sum(F.col(flag).cast("double")).alias("pos"), F.sum(1 - F.col(flag).cast("double")).alias("neg"))
    totals = counts.groupBy("r").agg(F.sum("neg").alias("t"))
    totals = totals.select("r", F.coalesce(F.sum("t").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("lower"))
    own = F.coalesce(F.sum("neg").over(W.partitionBy("r").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranked = counts.withColumn("own", own).join(totals, "r").withColumn("below", F.col("lower") + F.col("own"))
    return ranked.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def metrics(df: DataFrame, y: str, pred: str, flag: str, prob: str, hours_if: Column | None = None, flag_if: Column | None = None) -> DataFrame:
    """metric, value: R2, MAE and RMSE of log hours, MAE of hours, and Brier score, log-loss and AUC of the flag; each over the rows that a condition, if given,
    holds for, such as those that were followed long enough."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    label, error = F.col(flag).cast("double"), F.col(y) - F.col(pred)
    timed, flagged = (df if c is None else df.filter(c) for c in (hours_if, flag_if))
    mean = timed.agg(F.avg(y).alias("mean_y"))
    one = timed.crossJoin(F.broadcast(mean)).agg(
        (1 - F.sum(error * error) / F.nullif(F.sum((F.col(y) - F.col("mean_y")) * (F.col(y) - F.col("mean_y"))), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(error)).alias("mae_log"),
        F.sqrt(F.avg(error * error)).alias("rmse_log"),
        F.avg(F.abs(F.expm1(y) - F.expm1(pred))).alias("mae_hours"),
    )
    two = flagged.agg(F.avg((F.col(prob) - label) * (F.col(prob) - label)).alias("brier"), F.avg(-(label * F.log(p) + (1 - label) * F.log(1 - p))).alias("log_loss"))
    one = one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(auc(flagged, flag, prob)))
    return one.unpivot([], one.columns, "metric", "value")


def calibration(df: DataFrame, groups: list[str], flag: str, prob: str) -> DataFrame:
    """dimension, grp, n, gap: mean probability less the share of positive rows, by each value of each group's column."""
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("grp")) for g in groups))).alias("x")
    rows = df.select(each, F.col(prob).alias("_p"), F.col(flag).cast("double").alias("_f")).select("x.*", "_p", "_f")
    return rows.groupBy("dimension", "grp").agg(F.count("*").alias("n"), (F.avg("_p") - F.avg("_f")).alias("gap"))
