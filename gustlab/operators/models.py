"""Modelling as Spark jobs.

Models are ``pyspark.ml`` estimators. The reference's kernel SVM and Keras networks are single-machine; here
they are re-aimed as linear models over random feature maps (random Fourier features for an RBF kernel,
Rahimi & Recht 2007; a fixed random ReLU layer, Huang et al. 2006). The map is a small matrix product, run in
NumPy on Arrow batches inside the tasks; fitting is one pass that sums ``Z'Z, Z'y`` blocks, then a units² solve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import all_present, qcol
from gustlab.operators import levels
from gustlab.operators.evaluate import regression_metrics
from gustlab.operators.stats import exact_quantiles
from gustlab.operators.timeseries import ROWS_PER_BUCKET, sequence_index
from gustlab.session import cut_lineage


# --------------------------------------------------------------------------------------------- H1
def stratified_split(df: DataFrame, y: str, p: float = 0.7, groups: int = 5, seed: int = 123,
                     keys: Sequence[str] = (), shuffle_key: Column | None = None, label: str = "split",
                     bucket_col: str = "stratum", tiebreak: Sequence[str] | None = None,
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Sample ``ceil(p · n)`` rows inside each quantile group of ``y`` as training rows (H1).

    Groups are cut at the quantiles ``seq(0, 1, length = groups)`` (right-closed, lowest included), as the
    reference's partition helper does for numeric targets. Inside a group rows are ordered by a reproducible
    hash of the key (``xxhash64(keys, seed)`` unless ``shuffle_key`` is given). Up to ``rows_per_bucket`` rows are numbered
    by a window; of more only the last training row of each group is looked up (:func:`_last_rows`), and rows are compared
    with it where they are, so no row moves for the split.
    """
    probs = [i / (groups - 1) for i in range(1, groups - 1)] if groups > 2 else []
    br = [r["q"] for r in exact_quantiles(df, y, probs).orderBy("p").collect()] if probs else []
    br = sorted(set(br))
    b = F.lit(1)
    for v in br:
        b = b + F.when(F.col(y) > F.lit(v), 1).otherwise(0)
    sk = shuffle_key if shuffle_key is not None else F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    ties = list(tiebreak if tiebreak is not None else keys)
    d = df.filter(F.col(y).isNotNull()).withColumn(bucket_col, b.cast("int")).withColumn("__sk", sk)
    n = d.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("__n"), F.min("__sk").alias("__lo"), F.max("__sk").alias("__hi"))
    strata = n.collect()  # one row per stratum
    sizes = {r[bucket_col]: r["__n"] for r in strata}
    whole = dict(d.dtypes)["__sk"] in ("int", "bigint")
    if sum(sizes.values()) > rows_per_bucket and whole:
        ends = [int(r[c]) for r in strata for c in ("__lo", "__hi") if r[c] is not None]
        out = _split_by_last_row(d, bucket_col, {g: (k, math.ceil(k * p)) for g, k in sizes.items()}, ends, ties, label)
        return out.select(*df.columns, bucket_col, label)
    ix = sequence_index(d, "__sk", [bucket_col], tiebreak=ties, n_rows=sum(sizes.values()))
    size = F.create_map(*[x for kv in sizes.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) if sizes else None
    out = ix.withColumn("__n", size[F.col(bucket_col)] if size is not None else F.lit(0))
    out = out.withColumn(label, F.when(F.col("_pos") < F.ceil(F.col("__n") * p), "train").otherwise("test"))
    return out.drop("_pos", "__n", "__sk")


SPLIT_CELLS = 4096


def _last_rows(d: DataFrame, by: str, take: dict[int, int], ends: Sequence[int], ties: Sequence[str]) -> DataFrame:
    """Per group of ``take`` the row at position ``take - 1`` in the order of ``__sk`` (an integer, NULL first) and ``ties`` as a
    struct ``__last``, with the training places ``__quota`` among the rows equal to it and whether more than these are
    (``__more``).

    Rows are counted per cell of ``__sk`` (its leading bits, ``SPLIT_CELLS`` cells at most); only the cells that hold
    the wanted rows are ordered.
    """
    lo, hi = (min(ends), max(ends)) if ends else (0, 0)
    shift = 0
    while (hi >> shift) - (lo >> shift) >= SPLIT_CELLS:
        shift += 1
    cell = F.shiftright(F.col("__sk").cast("long"), shift)
    counts = d.groupBy(by, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n")).collect()  # a line a cell
    found = {}
    for g, k in take.items():
        below = 0
        for c, n in sorted(((r["__cell"], r["__n"]) for r in counts if r[by] == g), key=lambda x: (x[0] is not None, x[0] or 0)):
            if below + n >= k:
                found[g] = (c, k - below, n)
                break
            below += n
    held = F.lit(False)
    at = F.lit(None).cast("long")
    for g, (c, place, _) in found.items():
        held = held | ((F.col(by) == g) & cell.eqNullSafe(F.lit(c).cast("long")))
        at = F.when(F.col(by) == g, F.lit(place).cast("long")).otherwise(at)
    row = F.struct(F.col("__sk"), *[F.col(t) for t in ties])
    some = d.filter(held).select(by, "__sk", *ties)
    ix = cut_lineage(sequence_index(some, "__sk", [by], tiebreak=list(ties), n_rows=sum(n for _, _, n in found.values())).select(
        by, row.alias("__row"), "_pos", at.alias("__at")))
    last = ix.filter(F.col("_pos") == F.col("__at") - 1).select(F.col(by).alias("__g"), F.col("__row").alias("__last"))
    same = ix.join(F.broadcast(last), (F.col(by) == F.col("__g")) & (F.col("__row") == F.col("__last")))
    return cut_lineage(same.groupBy(F.col("__g")).agg(
        F.first("__last").alias("__last"), (F.first("__at") - F.min("_pos")).alias("__quota"),
        (F.max("_pos") >= F.first("__at")).alias("__more"), F.count(F.lit(1)).alias("__copies")))


def _split_by_last_row(d: DataFrame, by: str, sizes: dict[int, tuple[int, int]], ends: Sequence[int], ties: Sequence[str],
                       label: str) -> DataFrame:
    """``label`` for every row of ``d``: train up to the group's last training row. Copies of that row of which only some are
    training rows are numbered."""
    last = _last_rows(d, by, {g: k for g, (n, k) in sizes.items() if 0 < k < n}, ends, ties)
    every = [g for g, (n, k) in sizes.items() if k >= n]
    row = F.struct(F.col("__sk"), *[F.col(t) for t in ties])
    train = F.col(by).isin(every) | F.coalesce(row <= F.col("__last"), F.lit(False))
    side = F.when(train, "train").otherwise("test")
    j = d.join(F.broadcast(last), F.col(by) == F.col("__g"), "left")
    copies = last.filter("__more").agg(F.sum("__copies")).first()[0]
    if not copies:
        return j.withColumn(label, side)
    split = F.coalesce(F.col("__more") & (row == F.col("__last")), F.lit(False))
    rest = [c for c in d.columns if c not in (by, "__sk", *ties)]
    numbered = sequence_index(j.filter(split), "__sk", [by], tiebreak=[*ties, *rest], n_rows=copies)
    numbered = numbered.withColumn(label, F.when(F.col("_pos") < F.col("__quota"), "train").otherwise("test"))
    keep = [*d.columns, label]
    return j.filter(~split).withColumn(label, side).select(*keep).unionByName(numbered.select(*keep))


def kfold(df: DataFrame, keys: Sequence[str], folds: int = 10, seed: int = 123, col: str = "fold") -> DataFrame:
    """Reproducible fold number per row from a hash of its key."""
    return df.withColumn(col, F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(folds)).cast("int"))


# --------------------------------------------------------------------------------------------- H6, H7
MAP_ROWS = 256
_PI_HIGH = math.floor(math.pi * 2.0 ** 38) / 2.0 ** 38  # times a few thousand this is exact
_PI_LOW = math.pi - _PI_HIGH
_PI_REST = 1.2246467991473532e-16  # what pi in double precision lacks
_COS = [(-1.0) ** k / math.factorial(2 * k) for k in range(10, -1, -1)]


def _cos(z: np.ndarray) -> np.ndarray:
    """``np.cos`` to about 1e-15 for arguments below 10,000, as a few array operations instead of a library call a value; blocks
    with larger or non-finite ones take ``np.cos``."""
    if not (len(z) and np.abs(z).max() < 1e4):
        return np.cos(z)
    halves = np.rint(z * (1.0 / math.pi))
    r = z - halves * _PI_HIGH
    r -= halves * _PI_LOW
    r -= halves * _PI_REST
    r *= r
    c = r * _COS[0]
    for a in _COS[1:-1]:
        c += a
        c *= r
    c += _COS[-1]
    halves *= 0.5
    halves -= np.floor(halves)  # 0.5 at odd numbers of half turns
    c -= 4.0 * halves * c
    return c


@dataclass
class RandomFeatureMap:
    """Fixed random projection of the inputs (weights drawn once on the driver from a seed)."""

    inputs: list[str]
    weights: np.ndarray  # (units, inputs)
    bias: np.ndarray  # (units,)
    kind: str  # "rff" (cos, RBF kernel) or "relu"
    prefix: str = "rf"

    @classmethod
    def rbf(cls, inputs: Sequence[str], units: int = 200, sigma: float = 0.2, seed: int = 123) -> RandomFeatureMap:
        """Random Fourier features for ``exp(-sigma · |x - y|²)``: ``w ~ N(0, 2 sigma)``, ``b ~ U(0, 2π)``."""
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, math.sqrt(2.0 * sigma), size=(units, len(inputs)))
        b = rng.uniform(0.0, 2 * math.pi, size=units)
        return cls(list(inputs), w, b, "rff")

    @classmethod
    def relu(cls, inputs: Sequence[str], units: int = 64, seed: int = 123) -> RandomFeatureMap:
        """A fixed random ReLU layer (He-scaled normal weights)."""
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, math.sqrt(2.0 / max(1, len(inputs))), size=(units, len(inputs)))
        b = rng.normal(0.0, 0.1, size=units)
        return cls(list(inputs), w, b, "relu")

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The map on a NumPy batch (rows x inputs) -> rows x units; runs inside tasks on Arrow batches."""
        out = np.empty((len(x), len(self.bias)))
        for i in range(0, len(x), MAP_ROWS):  # blocks that stay in the cache
            z = x[i:i + MAP_ROWS] @ self.weights.T
            z += self.bias
            if self.kind == "rff":
                np.multiply(_cos(z), math.sqrt(2.0 / len(self.bias)), out=out[i:i + MAP_ROWS])
            else:
                np.maximum(z, 0.0, out=out[i:i + MAP_ROWS])
        return out

    def design(self, pdf: pd.DataFrame) -> np.ndarray:
        """``[1, map(x)]`` for a pandas batch holding the input columns."""
        x = pdf[self.inputs].to_numpy(float)
        return np.column_stack([np.ones(len(x)), self.apply(x)])


# --------------------------------------------------------------------------------------------- models
@dataclass
class FittedModel:
    name: str
    model: PipelineModel | None
    feature_map: RandomFeatureMap | None
    inputs: list[str]
    coef: np.ndarray | None = None
    forest: levels.LevelForest | None = None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Score rows (H12); every input column is kept.

        Map models and forests of many rows score in a vectorised pandas UDF (an Arrow batch at a time); other trees use MLlib.
        """
        if self.forest is not None:
            forest = self.forest

            @F.pandas_udf("double")
            def mean(*cols: pd.Series) -> pd.Series:
                return pd.Series(forest.score(np.column_stack([c.to_numpy(float) for c in cols])))

            return df.withColumn(out, F.when(all_present(self.inputs), mean(*[qcol(c).cast("double") for c in forest.inputs])))
        if self.feature_map is not None:
            fm, beta = self.feature_map, self.coef

            @F.pandas_udf("double")
            def score(*cols: pd.Series) -> pd.Series:
                x = np.column_stack([c.to_numpy(float) for c in cols])
                ok = ~np.isnan(x).any(axis=1)
                outv = np.full(len(x), np.nan)
                if ok.any():
                    outv[ok] = fm.apply(x[ok]) @ beta[1:] + beta[0]
                return pd.Series(outv)

            return df.withColumn(out, score(*[F.col(c).cast("double") for c in fm.inputs]))
        scored = self.model.transform(df).drop("__features")
        whole = all_present(self.inputs)  # rows with a NULL input stay, without a prediction
        return scored.withColumn("prediction", F.when(whole, F.col("prediction"))).withColumnRenamed("prediction", out)

    def importances(self) -> list[tuple[str, float]]:
        """Tree models: impurity importance per input."""
        if self.forest is not None:
            return list(zip(self.inputs, map(float, self.forest.importances())))
        stage = self.model.stages[-1]
        if not hasattr(stage, "featureImportances"):
            raise TypeError(f"{self.name} has no built-in importances; use permutation_importance")
        imp = stage.featureImportances.toArray()
        return list(zip(self.inputs, map(float, imp)))


def _assemble(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="__features", handleInvalid="keep")


def _whole(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The rows a model can learn from: no NULL input, no NULL label."""
    return train.filter(all_present([*features, label]))


MLLIB_ROWS = 500_000


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str, num_trees: int = 500,
                      mtry: int | str = 4, max_depth: int = 8, seed: int = 123) -> FittedModel:
    """Random forest regression, ``mtry`` features tried per split (H5): :func:`fit_random_forests` with one forest."""
    return fit_random_forests(train, label, [dict(features=list(features), num_trees=num_trees, mtry=mtry, max_depth=max_depth, seed=seed)])[0]


def _tried(mtry: int | str, n: int) -> int:
    """Inputs a node tries under MLlib's ``featureSubsetStrategy``."""
    m = str(mtry)
    if m.isdigit():
        return max(1, min(int(m), n))
    if m in ("auto", "onethird"):
        return max(1, math.ceil(n / 3))
    if m in ("sqrt", "log2"):
        return max(1, math.ceil(math.sqrt(n) if m == "sqrt" else math.log2(n)))
    return n if m == "all" else max(1, min(n, math.ceil(float(m) * n)))


def fit_random_forests(train: DataFrame, label: str, wanted: Sequence[dict], fold: str | None = None, parallelism: int = 4) -> list[FittedModel]:
    """Several forests from one table (H5): per entry of ``wanted`` its ``features``, maybe ``num_trees``, ``mtry``, ``max_depth``, ``seed``
    and ``without``, the number in the column ``fold`` (0 to 255) of the rows left out.

    Up to ``MLLIB_ROWS`` complete rows MLlib fits one forest after the other. More rows are packed once, and all trees of all
    forests grow in the same passes (:mod:`gustlab.operators.levels`): the same trees in kind (Poisson bootstrap of all rows,
    at most 32 bins an input, variance splits, ``mtry`` inputs a node), with draws of their own and bin edges from all rows.
    """
    wanted = [{"num_trees": 500, "mtry": 4, "max_depth": 8, "seed": 123, **w} for w in wanted]
    every = list(dict.fromkeys(c for w in wanted for c in w["features"]))
    if not wanted:
        return []
    if _whole(train, every, label).count() > MLLIB_ROWS:
        return fit_packed_forests(levels.pack(train, every, label, fold), wanted)

    def one(w):
        def task():
            feats = w["features"]
            m = str(min(int(w["mtry"]), len(feats))) if str(w["mtry"]).isdigit() else w["mtry"]
            rf = RandomForestRegressor(featuresCol="__features", labelCol=label, numTrees=w["num_trees"],
                                       featureSubsetStrategy=m, maxDepth=w["max_depth"], seed=w["seed"])
            rows = train if w.get("without") is None else train.filter(F.col(fold) != w["without"])
            return FittedModel("rf", Pipeline(stages=[_assemble(feats), rf]).fit(_whole(rows, feats, label)), None, feats)
        return task

    return _run_parallel([one(w) for w in wanted], parallelism)


def fit_packed_forests(rows: levels.Packed, wanted: Sequence[dict]) -> list[FittedModel]:
    """The forests of :func:`fit_random_forests` from packed rows."""
    asked = [{**w, "mtry": _tried(w["mtry"], len(w["features"])), "without": -1 if w.get("without") is None else w["without"]} for w in wanted]
    return [FittedModel("rf", None, None, w["features"], forest=f) for w, f in zip(wanted, levels.fit_level_forests(rows, asked))]


def _gram_batches(fm: RandomFeatureMap, label: str, fold_cols: list[str]):
    """Per partition: ``Z'Z``, ``Z'y`` and n for every (repeat, fold) group, from Arrow batches with NumPy."""
    k = len(fm.bias) + 1

    def run(batches):
        acc: dict[tuple[int, int], list] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            z = fm.design(pdf)
            y = pdf[label].to_numpy(float)
            groups = [(r, pdf.groupby(fc).indices) for r, fc in enumerate(fold_cols)] or [(0, {0: np.arange(len(pdf))})]
            for r, idx_by_f in groups:
                for f, idx in idx_by_f.items():
                    g = acc.setdefault((r, int(f)), [np.zeros((k, k)), np.zeros(k), 0])
                    zi, yi = (z, y) if len(idx) == len(z) else (z[idx], y[idx])
                    g[0] += zi.T @ zi
                    g[1] += zi.T @ yi
                    g[2] += len(idx)
        if acc:
            yield pd.DataFrame([{"repeat": r, "fold": f, "zz": g[0].ravel().tolist(), "zy": g[1].tolist(), "n": g[2]}
                                for (r, f), g in acc.items()])
    return run


def _sum_arrays(pdf: pd.DataFrame) -> pd.DataFrame:
    zz = np.sum(np.stack(pdf["zz"].to_numpy()), axis=0)
    zy = np.sum(np.stack(pdf["zy"].to_numpy()), axis=0)
    return pd.DataFrame([{"repeat": int(pdf["repeat"].iloc[0]), "fold": int(pdf["fold"].iloc[0]),
                          "zz": zz.tolist(), "zy": zy.tolist(), "n": int(pdf["n"].sum())}])


_GRAM_SCHEMA = "repeat int, fold int, zz array<double>, zy array<double>, n long"


def gram_blocks(df: DataFrame, fm: RandomFeatureMap, label: str, fold_cols: Sequence[str] = ()) -> dict:
    """``{(repeat, fold): (Z'Z, Z'y)}``: one pass; partial blocks are summed per group on the executors."""
    cols = [F.col(c).cast("double").alias(c) for c in fm.inputs] + [F.col(label).cast("double").alias(label)]
    cols += [F.col(c) for c in fold_cols]
    base = df.select(*cols).na.drop(subset=[*fm.inputs, label])
    parts = base.mapInPandas(_gram_batches(fm, label, list(fold_cols)), _GRAM_SCHEMA)
    # summed in two steps, so no task gets more than about the square root of the partial blocks
    buckets = max(1, math.isqrt(max(1, base.rdd.getNumPartitions())))
    some = parts.withColumn("__b", F.spark_partition_id() % F.lit(buckets)).groupBy("repeat", "fold", "__b").applyInPandas(
        lambda p: _sum_arrays(p), _GRAM_SCHEMA)
    rows = some.groupBy("repeat", "fold").applyInPandas(lambda p: _sum_arrays(p), _GRAM_SCHEMA).collect()
    k = len(fm.bias) + 1
    return {(r["repeat"], r["fold"]): (np.array(r["zz"]).reshape(k, k), np.array(r["zy"])) for r in rows}


def ridge_solve(a: np.ndarray, b: np.ndarray, reg: float) -> np.ndarray:
    """Ridge with Spark's convention: penalty on standardized coefficients = ``n·λ·var(z_j)``, intercept free."""
    n = max(a[0, 0], 1.0)
    var = np.maximum(np.diag(a) / n - (a[0] / n) ** 2, 0.0)
    var[0] = 0.0
    return np.linalg.lstsq(a + np.diag(reg * n * var), b, rcond=None)[0]


def fit_map_ridge(train: DataFrame, fm: RandomFeatureMap, label: str, reg: float, name: str) -> FittedModel:
    blocks = gram_blocks(train, fm, label)
    a = sum(v[0] for v in blocks.values())
    b = sum(v[1] for v in blocks.values())
    return FittedModel(name, None, fm, list(fm.inputs), ridge_solve(a, b, reg))


def fit_rbf_regression(train: DataFrame, features: Sequence[str], label: str, sigma: float = 0.2, c: float = 10.0,
                       units: int = 200, seed: int = 123) -> FittedModel:
    """Kernel regression re-aimed (H6): kernel ridge on RBF random features, ``λ = 1/(2C)``.

    Squared loss replaces the SVM's epsilon-insensitive loss, so the fit is one Gram pass over the rows.
    """
    return fit_map_ridge(train, RandomFeatureMap.rbf(features, units, sigma, seed), label, 1.0 / (2.0 * c), "rbf")


def fit_random_layer(train: DataFrame, features: Sequence[str], label: str, units: int = 64, seed: int = 123,
                     reg: float = 1e-3) -> FittedModel:
    """Neural regressor re-aimed (H7): fixed random ReLU hidden layer, ridge least-squares output layer."""
    return fit_map_ridge(train, RandomFeatureMap.relu(features, units, seed), label, reg, "random_layer")


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, max_iter: int = 50, validation: str | None = None,
            seed: int = 123) -> FittedModel:
    """Gradient-boosted trees; with ``validation`` (a boolean column) it stops early on that set (H8)."""
    kw = {"validationIndicatorCol": validation} if validation else {}
    gbt = GBTRegressor(featuresCol="__features", labelCol=label, maxIter=max_iter, maxDepth=4, seed=seed, **kw)
    return FittedModel("gbt", Pipeline(stages=[_assemble(features), gbt]).fit(_whole(train, features, label)), None, list(features))


FITTERS = {"rf": fit_random_forest, "rbf": fit_rbf_regression, "random_layer": fit_random_layer, "gbt": fit_gbt}


# --------------------------------------------------------------------------------------------- H4
def _run_parallel(tasks, parallelism: int):
    """Run independent Spark jobs from a thread pool (as ``CrossValidator(parallelism=...)`` does)."""
    from concurrent.futures import ThreadPoolExecutor

    if parallelism <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return list(ex.map(lambda t: t(), tasks))


def repeated_cv(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], model: str = "rf",
                folds: int = 10, repeats: int = 3, seed: int = 123, parallelism: int = 4, **params) -> DataFrame:
    """Per-fold metrics of ``model`` under ``repeats`` x ``folds`` cross-validation (H4).

    Folds come from a hash of the key per repeat; the fold fits are independent Spark jobs submitted
    ``parallelism`` at a time, forests of many rows grow together (:func:`fit_random_forests`). Output: one row per (repeat, fold).
    """
    fit = FITTERS[model]
    d = df.select(*keys, *features, label)
    for r in range(repeats):
        d = d.withColumn(f"__fold{r}", F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed + r)),
                                              F.lit(folds)).cast("int"))
    d = d.cache()

    forests = {}
    if model == "rf" and folds <= 256 and _whole(d, features, label).count() * (folds - 1) > MLLIB_ROWS * folds:
        for r in range(repeats):
            wanted = [dict(features=list(features), without=k, **params) for k in range(folds)]
            forests.update({(r, k): m for k, m in enumerate(fit_random_forests(d, label, wanted, f"__fold{r}"))})

    def one(r, k):
        def task():
            fc = F.col(f"__fold{r}")
            fm = forests.get((r, k)) or fit(d.filter(fc != k), features, label, **params)
            return regression_metrics(fm.predict(d.filter(fc == k)), label, "prediction").select(
                F.lit(model).alias("model"), F.lit(r).alias("repeat"), F.lit(k).alias("fold"), "*").collect()
        return task

    rows = _run_parallel([one(r, k) for r in range(repeats) for k in range(folds)], parallelism)
    d.unpersist()
    flat = [row for rs in rows for row in rs]
    return df.sparkSession.createDataFrame(flat, schema=_METRIC_SCHEMA)


_METRIC_SCHEMA = ("model string, repeat int, fold int, n long, mae double, rmse double, mape double, "
                  "n_zero long, r2 double, r2_corr double, mean_error_pct double")


def _score_batches(fm: RandomFeatureMap, label: str, fold_cols: list[str], bcoef):
    """Per partition: the sums behind every metric of each (repeat, fold, penalty), scoring rows with their fold's models."""
    def run(batches):
        coef = bcoef.value
        acc: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            z = fm.design(pdf)
            y = pdf[label].to_numpy(float)
            for r, fc in enumerate(fold_cols):
                for f, idx in pdf.groupby(fc).indices.items():
                    betas = coef.get((r, int(f)))
                    if betas is None:
                        continue
                    yy, pp = y[idx][:, None], z[idx] @ betas
                    e = pp - yy
                    nz = y[idx] != 0
                    one = np.ones(pp.shape[1])
                    v = np.stack([len(idx) * one, np.abs(e).sum(0), (e * e).sum(0), yy.sum() * one, (yy * yy).sum() * one, pp.sum(0),
                                  (pp * pp).sum(0), (yy * pp).sum(0), np.abs(e[nz] / yy[nz]).sum(0), (~nz).sum() * one], axis=1)
                    acc[(r, int(f))] = acc.get((r, int(f)), 0) + v
        if acc:
            yield pd.DataFrame([{"repeat": r, "fold": f, "setting": g, **{f"s{i}": float(x) for i, x in enumerate(v[g])}}
                                for (r, f), v in acc.items() for g in range(len(v))])
    return run


def linear_cv(df: DataFrame, fmap: RandomFeatureMap, label: str, keys: Sequence[str], folds: int = 10,
              repeats: int = 3, seed: int = 123, reg: float = 1e-3, model: str = "random_layer") -> DataFrame:
    """Repeated k-fold CV of a ridge model on a random feature map (H4): :func:`ridge_grid_cv` with one penalty."""
    return ridge_grid_cv(df, fmap, label, keys, [reg], folds, repeats, seed, model).drop("reg")


def ridge_grid_cv(df: DataFrame, fmap: RandomFeatureMap, label: str, keys: Sequence[str], regs: Sequence[float],
                  folds: int = 10, repeats: int = 3, seed: int = 123, model: str = "random_layer") -> DataFrame:
    """Repeated k-fold CV of ridge models on a random feature map, every penalty of ``regs`` in the same two passes (H4).

    Pass 1: per partition, NumPy Gram blocks ``Z'Z, Z'y`` per (repeat, fold), ``Z = [1, map(x)]``, summed per
    fold on the executors. Each fold's models solve totals minus that fold (a units² system a penalty on the driver).
    Pass 2: every row is scored by its own fold's models inside the task; only metric sums leave it.
    """
    import pyspark.sql.types as T

    regs = [float(x) for x in regs]
    fold_cols = [f"__fold{r}" for r in range(repeats)]
    base = df.filter(F.col(label).isNotNull()).select(
        *[F.col(c).cast("double").alias(c) for c in fmap.inputs], F.col(label).cast("double").alias(label),
        *[F.pmod(F.xxhash64(*[F.col(c) for c in keys], F.lit(seed + r)), F.lit(folds)).cast("int").alias(fold_cols[r])
          for r in range(repeats)]).na.drop(subset=fmap.inputs)
    blocks = gram_blocks(base, fmap, label, fold_cols)
    coef = {}
    for rep in range(repeats):
        ta = sum(v[0] for (rr, _), v in blocks.items() if rr == rep)
        tb = sum(v[1] for (rr, _), v in blocks.items() if rr == rep)
        for (rr, f), (a, b) in blocks.items():
            if rr == rep:
                coef[(rr, f)] = np.column_stack([ridge_solve(ta - a, tb - b, reg) for reg in regs])
    bcoef = df.sparkSession.sparkContext.broadcast(coef)
    sums_schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("repeat", "fold", "setting")] +
                               [T.StructField(f"s{i}", T.DoubleType()) for i in range(10)])
    s = base.mapInPandas(_score_batches(fmap, label, fold_cols, bcoef), sums_schema)
    s = s.groupBy("repeat", "fold", "setting").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(10)])
    n, sae, sse, sy, syy, sp, spp, syp, sape, nz = [F.col(f"s{i}") for i in range(10)]
    sst = syy - sy * sy / n
    cov = syp - sy * sp / n
    r = F.try_divide(cov, F.sqrt(F.greatest((syy - sy * sy / n) * (spp - sp * sp / n), F.lit(0.0))))
    return s.select(
        F.lit(model).alias("model"), F.element_at(F.array(*[F.lit(x) for x in regs]), F.col("setting") + 1).alias("reg"),
        "repeat", "fold", n.cast("long").alias("n"), (sae / n).alias("mae"),
        F.sqrt(sse / n).alias("rmse"), (F.try_divide(sape, n - nz) * 100).alias("mape"), nz.cast("long").alias("n_zero"),
        (1 - sse / (sst + F.lit(1e-7))).alias("r2"), (r * r).alias("r2_corr"),
        (F.try_divide(F.sqrt(sse / n), sy / n) * 100).alias("mean_error_pct"))


SVM_SIGMAS, SVM_COSTS = (0.0001, 0.001, 0.01, 0.2), (0.1, 1.0, 10.0, 100.0, 1000.0)  # fixed values: the tuning grid


def rbf_tuning(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], sigmas: Sequence[float] = SVM_SIGMAS,
               costs: Sequence[float] = SVM_COSTS, folds: int = 10, repeats: int = 3, units: int = 200, seed: int = 123) -> DataFrame:
    """Mean CV errors of the kernel regression over a sigma x C grid, the best setting flagged (H6 tuned as in H4): one
    :func:`ridge_grid_cv` per sigma serves all costs, ``λ = 1/(2C)``. Output ``(sigma, c, rmse, mae, r2_corr, best)``."""
    parts = []
    for sigma in sigmas:
        cv = ridge_grid_cv(df, RandomFeatureMap.rbf(features, units, sigma, seed), label, keys, [1.0 / (2.0 * c) for c in costs],
                           folds, repeats, seed, "rbf")
        c = F.round(1.0 / (2.0 * F.col("reg")), 9)
        parts.append(cv.groupBy(F.lit(float(sigma)).alias("sigma"), c.alias("c")).agg(
            F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2_corr").alias("r2_corr")))
    grid = parts[0]
    for p in parts[1:]:
        grid = grid.unionByName(p)
    rows = grid.collect()  # a line a setting
    best = min(rows, key=lambda r: (r["rmse"], r["sigma"], r["c"])) if rows else None
    return df.sparkSession.createDataFrame([(*r, r == best) for r in rows], "sigma double, c double, rmse double, mae double, "
                                           "r2_corr double, best boolean")


# --------------------------------------------------------------------------------------------- H10, H11
def permutation_importance(fm: FittedModel, df: DataFrame, label: str, keys: Sequence[str], seed: int = 7) -> DataFrame:
    """Increase in RMSE when one input is replaced by its value in a hash-permuted row order.

    Rows meet their permuted inputs in one join; the base and every input's variant are scored in the same pass.
    """
    df = df.select(*dict.fromkeys([*keys, *fm.inputs, label]))
    # numbered once each
    ix = cut_lineage(sequence_index(df, keys[0], [], tiebreak=list(keys[1:]), idx="__i"))
    perm = cut_lineage(sequence_index(df.withColumn("__h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))), "__h", [],
                                      tiebreak=list(keys), idx="__i").select("__i", *[F.col(c).alias(f"__other_{c}") for c in fm.inputs]))
    scored = fm.predict(ix.join(perm, on="__i"), "__base")
    for c in fm.inputs:
        own = scored.withColumns({"__own": F.col(c), c: F.col(f"__other_{c}")})
        scored = fm.predict(own, f"__p_{c}").withColumn(c, F.col("__own")).drop("__own")
    err = lambda p: F.col(p) - F.col(label)
    base, *rest = scored.agg(*[F.sqrt(F.avg(err(p) * err(p))).alias(p) for p in ["__base", *[f"__p_{c}" for c in fm.inputs]]]).first()
    rows = [(c, float(r - base)) for c, r in zip(fm.inputs, rest)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def rfe(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], folds: int = 10,
        sizes: Sequence[int] | None = None, seed: int = 123, parallelism: int = 4, **rf_params) -> DataFrame:
    """Recursive feature elimination by forest importance (H10): at each size, CV RMSE of a forest on the
    current set, then drop the least important input. Output ``(n_features, features, rmse)``."""
    cur = list(features)
    sizes = set(sizes or range(1, len(cur) + 1))
    d = kfold(df, keys, folds, seed).cache()
    rows = []
    whole = _whole(d, cur, label).count()
    packed = levels.pack(d, cur, label, "fold") if folds <= 256 and whole * (folds - 1) > MLLIB_ROWS * folds else None
    while cur:
        wanted = [dict(features=list(cur), without=k, **rf_params) for k in range(folds)] if len(cur) in sizes else []
        if len(cur) > 1:
            wanted.append(dict(features=list(cur), **rf_params))
        if packed is not None:
            fits = fit_packed_forests(packed, [{"num_trees": 500, "mtry": 4, "max_depth": 8, "seed": 123, **w} for w in wanted])
        else:
            fits = None
        if len(cur) in sizes:
            def one(k, feats=tuple(cur), fits=fits):
                def task():
                    fm = fits[k] if fits else fit_random_forest(d.filter(F.col("fold") != k), list(feats), label, **rf_params)
                    return regression_metrics(fm.predict(d.filter(F.col("fold") == k)), label, "prediction").first()
                return task
            ms = _run_parallel([one(k) for k in range(folds)], parallelism)
            sq = sum((m["rmse"] or 0.0) ** 2 * m["n"] for m in ms)
            n = sum(m["n"] for m in ms)
            rows.append((len(cur), ",".join(cur), math.sqrt(sq / n) if n else None))
        if len(cur) == 1:
            break
        imp = (fits[-1] if fits else fit_random_forest(d, cur, label, **rf_params)).importances()
        cur.remove(min(imp, key=lambda t: t[1])[0])
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "n_features int, features string, rmse double")
