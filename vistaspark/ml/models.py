"""Model fitting with Spark MLlib.

Every estimator sits in an ``ml.Pipeline`` fitted on the training split only (scaler and
label threshold included), so nothing leaks from test rows. Splits are hash buckets of a
key, stable under repartitioning and executor loss (unlike ``randomSplit``). Iterative fits
(k-means sweeps, grids) persist their scaled input once and release it afterwards.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import StorageLevel

from ..operators.quantiles import exact_quantiles
from ..sources.sinks import scratch_path
from .gram import LinearFit, gram, lasso, principal_shares, ridge, standardised_ridge
from .metrics import elbow, regression_metrics

BLOCK_ROWS, LEAST_BLOCKS = 10_000, 4  # rows of one side in a kNN block, blocks of a small table
MIN_ROWS = 10  # fits need at least this many rows (a fixed value of the study)


def written(df: DataFrame) -> DataFrame:
    """Input of a fit, written to the shared folder once and read back.

    A fit reads its input many times (scaler, every iteration, the evaluation): the plan behind it
    runs once, a lost executor costs a re-read, and Spark's file packing sizes the partitions."""
    path = scratch_path(df.sparkSession, "fit")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- M16 split
BUCKETS = {"xxhash": 1 << 30, "knuth": 1_000_003}  # numbers that a key's hash can be
CELLS = 1024


def split_number(key, seed: int = 42, method: str = "xxhash") -> Column:
    """A stable pseudo-random number below BUCKETS[method] from a key.

    ``xxhash``: Spark's 64-bit xxhash of (key, seed). ``knuth``: multiplicative hashing in
    integer arithmetic, which other SQL engines can reproduce (used for oracle checks).
    """
    k = F.col(key) if isinstance(key, str) else key
    hashed = k.cast("long") * F.lit(2654435761) + F.lit(seed) if method == "knuth" else F.xxhash64(k, F.lit(seed))
    return F.pmod(hashed, F.lit(BUCKETS[method]).cast("long"))


def split_bucket(key, seed: int = 42, method: str = "xxhash") -> Column:
    """``split_number`` as a number in [0, 1)."""
    return split_number(key, seed, method).cast("double") / float(BUCKETS[method])


def split(df: DataFrame, key: str, frac: float = 0.8, seed: int = 42, method: str = "xxhash",
          strata: str | None = None, exact_strata: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash bucket < frac.

    The bucket is independent of the stratum, so every stratum is split in proportion
    ``frac`` in expectation with no shuffle at all (the scalable default). With
    ``exact_strata=True`` each stratum gets exactly round(frac * n) training rows (:func:`exact_split`)."""
    if strata is not None and exact_strata:
        tagged = exact_split(df, key, strata, frac, seed, method)
        return tagged.filter("_train").drop("_train"), tagged.filter("NOT _train").drop("_train")
    u = split_bucket(key, seed, method)
    tagged = df.withColumn("_u", u)
    return tagged.filter(F.col("_u") < frac).drop("_u"), tagged.filter(F.col("_u") >= frac).drop("_u")


def exact_split(df: DataFrame, key: str, strata: str, frac: float, seed: int = 42, method: str = "xxhash") -> DataFrame:
    """``df`` with ``_train``: true for the round(frac * n) rows of each stratum that come first by
    (hash number, key). Null strata are a stratum.

    The number at which a stratum is cut is found by counting rows by ranges of numbers (at most CELLS
    counts for each stratum), then by ranges of the range that holds the cut, down to one number;
    only the rows of that number, one in BUCKETS, are ordered by key. So a stratum that holds half the
    rows is no single task's. The counts run when this is called; a small table, one row for each stratum, is
    written for each of the two or three steps."""
    rows = df.withColumns({"_s": F.to_json(F.struct(F.col(strata).alias("v"))), "_v": split_number(key, seed, method)})
    cut = written(rows.groupBy("_s").agg(F.round(F.count(F.lit(1)) * F.lit(frac)).cast("long").alias("_need"), F.lit(0).cast("long").alias("_lo")))
    width = BUCKETS[method]
    while width > 1:
        step = -(-width // CELLS)
        cell = F.floor((F.col("_v") - F.col("_lo")) / F.lit(step)).cast("long")
        counts = (rows.select("_s", "_v").join(cut, "_s").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") < F.col("_lo") + width))
                  .groupBy("_s", "_lo", "_need", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")))
        upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cut = written(counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
                      .select("_s", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), (F.col("_lo") + F.col("_cell") * step).alias("_lo")))
        width = step
    placed = rows.join(cut, "_s", "left")  # no cut: a stratum without training rows
    at = F.coalesce(F.col("_v") == F.col("_lo"), F.lit(False))
    columns = [F.col(c) for c in df.columns]
    others = placed.where(~at).select(*columns, F.coalesce(F.col("_v") < F.col("_lo"), F.lit(False)).alias("_train"))
    order = Window.partitionBy("_s").orderBy(key)
    return others.unionByName(placed.where(at).select(*columns, (F.row_number().over(order) <= F.col("_need")).alias("_train")))


def _features(cols: Sequence[str], scale: bool = True, with_mean: bool = False) -> list:
    """Assembler (+ standard scaler: std only, or mean and std)."""
    stages = [VectorAssembler(inputCols=list(cols), outputCol="raw", handleInvalid="skip")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=with_mean, withStd=True))
    else:
        stages[0].setOutputCol("features")
    return stages


def _require_rows(df: DataFrame) -> None:
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed to fit")


# ---------------------------------------------------------------- M1/M2/M5/M9/M15 regression
TREE_BINS, CUT_ROWS = 32, 10_000  # MLlib's maxBins, and the rows from which its trees take their candidate thresholds


def cut_points(values: Sequence[float], expected: float, bins: int) -> list[float]:
    """Candidate thresholds of a column as MLlib's trees choose them: midpoints between neighbouring values,
    all of them if they are fewer than ``bins``, else those next to the quantiles. Values that are missing
    from the ``expected`` number count as 0."""
    counts = Counter(v for v in values if v != 0.0)
    zeros = expected - sum(counts.values())
    if zeros > sys.float_info.epsilon * sum(counts.values()) * 100:
        counts[0.0] = zeros
    known = sorted(counts.items())
    if len(known) <= bins:
        return [(a + b) / 2 for (a, _), (b, _) in zip(known, known[1:])]
    stride = expected / bins
    found, upto, target = [], known[0][1], stride
    for (a, _), (b, n) in zip(known, known[1:]):
        if abs(upto - target) < abs(upto + n - target):
            found.append((a + b) / 2)
            target += stride
        upto += n
    return found


def tree_cuts(train: DataFrame, features: Sequence[str], seed: int) -> list[list[float]]:
    """Thresholds of each column from the same CUT_ROWS rows that an MLlib tree of this seed would draw."""
    n, bins = train.count(), TREE_BINS
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in features])
    fraction = min(1.0, CUT_ROWS / n)
    if fraction < 1:
        spark = train.sparkSession
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.javaRDD().sample(False, fraction, draw), rows._jdf.schema()), spark)
    drawn = rows.collect()  # about CUT_ROWS at most
    return [cut_points([r[i] for r in drawn], fraction * n, min(bins, n)) for i in range(len(features))]


def fit_boosted(train: DataFrame, features: Sequence[str], iters: int, depth: int, seed: int) -> PipelineModel:
    """M1's boosted trees, fitted on one weighted row for each combination of the features' bins.

    A tree sees a row's features only by their bins, so rows of one combination get the same prediction in
    every round, and a split's gain depends on their number and mean label alone. All rows are read once for
    these; the rounds, five or six jobs each, work on at most TREE_BINS ** features rows."""
    binned = [f"{c}_bin" for c in features]
    # a tree sends a value equal to its threshold left, a bucket holds its lower bound
    bounds = [[-math.inf, *(math.nextafter(x, math.inf) for x in cuts or [0.99 * sys.float_info.max]), math.inf] for cuts in tree_cuts(train, features, seed)]
    bucketizer = Bucketizer(inputCols=list(features), outputCols=binned, splitsArray=bounds, handleInvalid="skip")
    cells = written(bucketizer.transform(train).groupBy(*binned).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("peso")))
    # the scaler also drops the buckets' mark of being categories: bins are ordered
    stages = [*_features(binned), GBTRegressor(maxIter=iters, maxDepth=depth, seed=seed, labelCol="label", weightCol="peso", maxBins=TREE_BINS)]
    return PipelineModel([bucketizer, *Pipeline(stages=stages).fit(cells).stages])


def fit_regressors(df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = 42,
                   trees: int = 50, depth: int = 5, iters: int = 50, lr_reg: float = 0.1) -> tuple[DataFrame, dict]:
    """M1/M2: linear (reg 0.1), random forest and GBT on an 80/20 split; test metrics per model.

    Returns (metrics table [modelo, r2, mae, mse, rmse, n], fitted pipeline models)."""
    _require_rows(df)
    data = written(df.select(*features, F.col(label).cast("double").alias("label"), key).na.drop())
    train, test = split(data, key, 0.8, seed)
    fit = lambda est: Pipeline(stages=_features(features) + [est]).fit(train)
    models = {
        "lineal": fit(LinearRegression(regParam=lr_reg, labelCol="label")),
        "random_forest": fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label")),
        "gbt": fit_boosted(train, features, iters, depth, seed),
    }
    out = None
    for name, model in models.items():
        m = regression_metrics(model.transform(test)).withColumn("modelo", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out, models


def importances(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """M5: feature importances (tree models) or |coefficients| (linear), ordered."""
    last = model.stages[-1]
    vals = (last.featureImportances.toArray().tolist() if hasattr(last, "featureImportances")
            else [abs(c) for c in last.coefficients.toArray().tolist()])
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, "variable string, importancia double").orderBy(F.desc("importancia"), "variable")


def fit_penalised(df: DataFrame, features: Sequence[str], label: str, ridge_alpha: float = 1.0,
                  lasso_alpha: float = 0.1) -> DataFrame:
    """M9: ordinary, ridge and lasso least squares; coefficients per model.

    Ridge's penalty is not divided by n, so it is ``alpha / n`` beside the mean squared error; lasso's
    is ``alpha``; neither standardises. One aggregate over the table, solved on its covariances."""
    g = gram(df.withColumn("_label", F.col(label).cast("double")), [*features, "_label"])
    fits = {"ordinario": ridge(g, features, "_label"), "ridge": ridge(g, features, "_label", ridge_alpha / max(g.n, 1)),
            "lasso": lasso(g, features, "_label", lasso_alpha)}
    rows = [(name, *r) for name, fit in fits.items() for r in fit.rows()]
    return df.sparkSession.createDataFrame(rows, "modelo string, variable string, coeficiente double")


def multi_fit(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Multiple regression (normal equations) with named coefficients and R2."""
    fit = ridge(gram(df.withColumn("_label", F.col(label).cast("double")), [*features, "_label"]), features, "_label")
    out = df.sparkSession.createDataFrame(fit.rows(), "variable string, coeficiente double")
    return out.withColumn("r2", F.lit(fit.r2))


def fit_linear(df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = 42, reg: float = 0.1,
               method: str = "xxhash") -> tuple[DataFrame, LinearFit]:
    """M1's linear model (reg 0.1) from one aggregate over the training rows: (test metrics, fit)."""
    data = df.select(*features, F.col(label).cast("double").alias("label"), key).na.drop()
    train, test = split(data, key, 0.8, seed, method)
    fit = standardised_ridge(gram(train, [*features, "label"]), features, "label", reg)
    return regression_metrics(test.withColumn("prediction", fit.prediction())), fit


# ---------------------------------------------------------------- M6/M10/M11 classification
def fit_logistic(df: DataFrame, features: Sequence[str], target: str, key: str, seed: int = 42) -> DataFrame:
    """M6: logistic regression (20 iterations, reg 0.1) on label = target >= median, the median
    taken from the *training* rows; returns test predictions (label, prediction, probability)."""
    data = written(df.select(*features, F.col(target).cast("double").alias("_t"), key).na.drop())
    train, test = split(data, key, 0.8, seed)
    med = F.lit((exact_quantiles(train, {"_t": [0.5]}).first()["_t"] or [None])[0]).cast("double")
    lab = lambda d: d.withColumn("label", F.when(F.col("_t") >= med, 1.0).otherwise(0.0))
    model = Pipeline(stages=_features(features) + [LogisticRegression(maxIter=20, regParam=0.1)]).fit(lab(train))
    pred = model.transform(lab(test))
    return pred.select(key, "label", "prediction", F.get(vector_to_array("probability"), 1).alias("probabilidad"))


def fit_tree(df: DataFrame, features: Sequence[str], label: str, depth: int = 3, seed: int = 42) -> tuple[DataFrame, str]:
    """Decision tree classifier of the given depth; (in-sample predictions, printable rules)."""
    data = written(df.select(*features, F.col(label).cast("double").alias("label")).na.drop())
    m = Pipeline(stages=_features(features, scale=False) + [DecisionTreeClassifier(maxDepth=depth, seed=seed)]).fit(data)
    return m.transform(data).select("label", "prediction"), m.stages[-1].toDebugString


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """Random-forest classifier; in-sample predictions."""
    data = written(df.select(*features, F.col(label).cast("double").alias("label")).na.drop())
    m = Pipeline(stages=_features(features, scale=False) + [RandomForestClassifier(numTrees=trees, seed=seed)]).fit(data)
    return m.transform(data).select("label", "prediction")


# ---------------------------------------------------------------- M12 k nearest neighbours
def knn_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of one side: ``block_rows`` rows on average, at least LEAST_BLOCKS so that small tables use several tasks."""
    return max(LEAST_BLOCKS, -(-rows.count() // block_rows))


def knn_classify(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 3,
                 blocks_test: int | None = None, blocks_train: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k-nearest-neighbour majority vote (k = min(k, n_train)); ties in distance by
    train key, ties in votes by the smallest label.

    Blocked nested loop: test and train rows are hashed into blocks; every (test block, train
    block) pair meets in one cogroup where numpy computes the block's distances and emits only
    the k best candidates per test row. Candidates per test row are then bounded by
    k * blocks_train and reduced to the final k. No pair is ever materialised as a row and no
    group holds more than one block of each side, ``block_rows`` rows on average; without given
    counts there are as many blocks as the row counts need.
    """
    bt, br = blocks_test or knn_blocks(test, block_rows), blocks_train or knn_blocks(train, block_rows)
    te = test.select(F.col(key).alias("qid"), F.col(vec).alias("qv"),
                     F.pmod(F.xxhash64(F.col(key)), F.lit(bt)).cast("int").alias("tb"))
    tr = train.select(F.col(key).alias("rid"), F.col(vec).alias("rv"), F.col(label).alias("rl"),
                      F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(br)).cast("int").alias("rb"))
    te_rep = te.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(br - 1))))
    tr_rep = tr.withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(bt - 1))))
    kk = k

    def block_topk(q, r):
        import numpy as np
        import pandas as pd

        if len(q) == 0 or len(r) == 0:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "rid": pd.Series([], dtype="int64"),
                                 "rl": pd.Series([], dtype="int64"), "d2": pd.Series([], dtype="float64")})
        Q = np.stack(q["qv"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        R = np.stack(r["rv"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        rid, rl, qid = r["rid"].to_numpy(), r["rl"].to_numpy(), q["qid"].to_numpy()
        m = min(kk, len(r))
        # exact squared distances, a chunk of queries at a time (bounded memory per task)
        step = max(1, int(2_000_000 // max(1, R.shape[0] * R.shape[1])))
        parts = []
        for s0 in range(0, len(Q), step):
            diff = Q[s0:s0 + step, None, :] - R[None, :, :]
            d2 = np.einsum("ijk,ijk->ij", diff, diff)
            order = np.lexsort((np.broadcast_to(rid, d2.shape), d2), axis=1)[:, :m]  # by distance, then id
            rows = np.arange(d2.shape[0])[:, None]
            parts.append(pd.DataFrame({"qid": np.repeat(qid[s0:s0 + step], m), "rid": rid[order].ravel(),
                                       "rl": rl[order].ravel(), "d2": d2[rows, order].ravel()}))
        return pd.concat(parts, ignore_index=True)

    cands = te_rep.groupBy("tb", "rb").cogroup(tr_rep.groupBy("tb", "rb")).applyInPandas(
        block_topk, "qid long, rid long, rl long, d2 double")
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy("d2", "rid")
    best = cands.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    votes = best.groupBy("qid", "rl").agg(F.count(F.lit(1)).alias("votos"))
    pred = votes.groupBy("qid").agg(F.max_by("rl", F.struct(F.col("votos"), -F.col("rl"))).alias("prediccion"))
    return pred.select(F.col("qid").alias(key), "prediccion")


# ---------------------------------------------------------------- M18/M19/M21/M22/M24 unsupervised
def _scaled(df: DataFrame, cols: Sequence[str], with_mean: bool = True) -> DataFrame:
    data = written(df.select(*df.columns).na.drop(subset=list(cols)))
    model = Pipeline(stages=_features(cols, scale=True, with_mean=with_mean)).fit(data)
    return model.transform(data)


def kmeans_segments(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42, iters: int = 20) -> DataFrame:
    """K-means on standardised columns; input rows with their ``cluster``."""
    scaled = _scaled(df, cols)
    model = KMeans(k=k, seed=seed, maxIter=iters, featuresCol="features", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).drop("raw", "features")


def cluster_means(assigned: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Size and per-column means of each cluster."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                           *[F.round(F.avg(c), 6).alias(f"{c}_promedio") for c in cols])


def pca_summary(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """PCA on standardised columns: explained and cumulative variance per component."""
    rows, acc = [], 0.0
    for i, v in enumerate(principal_shares(gram(df, cols))[:min(k, len(cols))].tolist(), 1):
        acc += v
        rows.append((i, v, acc))
    return df.sparkSession.createDataFrame(rows, "componente int, varianza double, acumulada double")


def _in_parallel(fn, items, parallelism: int):
    """Run independent fits concurrently (as Spark ML's tuning classes do with ``parallelism``):
    each fit is a series of small Spark jobs, so several of them keep the executors busy."""
    from concurrent.futures import ThreadPoolExecutor

    if parallelism <= 1:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fn, items))


def kmeans_sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int] | None = None, seed: int = 42,
                 iters: int = 20, parallelism: int = 8) -> DataFrame:
    """Inertia (training cost) and silhouette for each k in 2..min(10, n-1)."""
    return kmeans_study(df, cols, ks, seed, iters, parallelism)[0]


def best_ks(sweep: DataFrame) -> DataFrame:
    """(criterio, k, inercia, silueta): the k at the elbow of the inertia and the k of the highest
    silhouette (to 4 decimals; the smallest of equal ones). The sweep is one row per k."""
    silhouette = sweep.agg(F.max_by("k", F.struct(F.round("silueta", 4), -F.col("k"))).alias("k"))
    best = (elbow(sweep).select(F.lit("codo").alias("criterio"), F.col("k_codo").alias("k"))
            .unionByName(silhouette.select(F.lit("silueta").alias("criterio"), "k")))
    return best.join(F.broadcast(sweep), "k").select("criterio", "k", "inercia", "silueta")


def kmeans_study(df: DataFrame, cols: Sequence[str], ks: Sequence[int] | None = None, seed: int = 42, iters: int = 20,
                 parallelism: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the sweep, the best k by each criterion, size and column means of each cluster of the elbow's model).

    The scaled input is persisted once; the fits for different k are independent and run
    ``parallelism`` at a time. Each fit is seeded, so results do not depend on the order."""
    scaled = _scaled(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = scaled.count()
        ks = list(ks) if ks else list(range(2, min(10, n - 1) + 1))
        ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")

        def fit(k):
            model = KMeans(k=k, seed=seed, maxIter=iters, featuresCol="features", predictionCol="cluster").fit(scaled)
            return model, (k, float(model.summary.trainingCost), float(ev.evaluate(model.transform(scaled))))

        fitted = _in_parallel(fit, ks, parallelism)
    finally:
        scaled.unpersist()
    sweep = df.sparkSession.createDataFrame([row for _, row in fitted], "k int, inercia double, silueta double")
    best = best_ks(sweep)
    chosen = elbow(sweep).first()["k_codo"] if fitted else None
    model = next((m for m, row in fitted if row[0] == chosen), None)
    clustered = model.transform(scaled) if model else scaled.withColumn("cluster", F.lit(0)).limit(0)
    return sweep, best, cluster_means(clustered, cols)


def trial_grid(df: DataFrame, cols: Sequence[str], comps: Sequence[int], ks: Sequence[int], seed: int = 42,
               top: int = 5, parallelism: int = 8) -> DataFrame:
    """M24 (re-aimed): really fit every (PCA components, k) pair and rank by silhouette."""
    scaled = _scaled(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        ev = ClusteringEvaluator(featuresCol="pca", predictionCol="cluster")
        for c in comps:
            pca = PCA(k=min(c, len(cols)), inputCol="features", outputCol="pca").fit(scaled)
            proj = pca.transform(scaled).persist(StorageLevel.MEMORY_AND_DISK)
            var = float(sum(pca.explainedVariance.toArray()))

            def fit(k, proj=proj, c=c, var=var):
                km = KMeans(k=k, seed=seed, maxIter=20, featuresCol="pca", predictionCol="cluster").fit(proj)
                return (int(c), int(k), float(ev.evaluate(km.transform(proj))), var)

            rows += _in_parallel(fit, list(ks), parallelism)
            proj.unpersist()
    finally:
        scaled.unpersist()
    out = df.sparkSession.createDataFrame(rows, "componentes int, k int, silueta double, varianza double")
    return out.orderBy(F.desc("silueta"), "componentes", "k").limit(top)

