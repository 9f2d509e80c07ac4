"""Learning from samples: forests, clusters, components, folds, tuning.  Models come from pyspark.ml; what they can't do is expressed as aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide


def as_vectors(rows: DataFrame, features: list[str] | str) -> DataFrame:
    """`features` as a column of vectors: some columns, or one of arrays."""
    if isinstance(features, str):
        return rows.withColumn("features", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def random_forest(training: DataFrame, features, label: str, trees: int = 100, seed: int = 1, max_depth: int = 12):
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed, maxDepth=max_depth, cacheNodeIds=False).fit(as_vectors(training, features))


def predicted(model, rows: DataFrame, features) -> DataFrame:
    """`rows` with prediction and the probability of it."""
    out = model.transform(as_vectors(rows, features))
    return out.withColumn("p", F.array_max(vector_to_array("probability"))).drop("features", "rawPrediction", "probability")


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, (float(x) for x in model.featureImportances), strict=True), key=lambda x: (-x[1], x[0]))


def logistic(training: DataFrame, features, label: str, l2: float = 1e-3):
    """Multinomial logistic regression with classes weighted to count alike."""
    n = training.groupBy(label).agg(F.count("*").alias("n_class"))
    weights = n.withColumn("weight", F.sum("n_class").over(Window.partitionBy()) / (F.col("n_class") * F.count("*").over(Window.partitionBy())))
    rows = training.join(F.broadcast(weights.select(label, "weight")), label)  # a row for each class
    return LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", regParam=l2).fit(as_vectors(rows, features))


def cross_predicted(rows: DataFrame, features, label: str, fold: str, folds: int, fit) -> DataFrame:
    """Each row's prediction by a model that was fitted without its fold (spatial blocks, places)."""
    out = None
    for k in range(folds):
        model = fit(rows.where(F.col(fold) != k))
        part = predicted(model, rows.where(F.col(fold) == k), features)
        out = part if out is None else out.unionByName(part)
    return out


def kmeans(rows: DataFrame, features, k: int, seed: int = 1) -> DataFrame:
    """`rows` with cluster: clusters are numbered by the mean of their centres, so that numbers mean the same in every run."""
    vectors = as_vectors(rows, features)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="found").fit(vectors)
    centres = [float(np.mean(c)) for c in model.clusterCenters()]
    rank = {old: new for new, old in enumerate(sorted(range(len(centres)), key=lambda i: centres[i]))}
    named = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    return model.transform(vectors).withColumn("cluster", named[F.col("found")]).drop("features", "found")


def principal_components(rows: DataFrame, features, k: int) -> DataFrame:
    """`rows` with pc (array): scores on the first k components of the covariance; the greatest loading of each is positive."""
    vectors = as_vectors(rows, features)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors)
    axes = model.pc.toArray()
    sign = F.lit([1.0 if c[np.argmax(np.abs(c))] > 0 else -1.0 for c in axes.T])
    return model.transform(vectors).withColumn("pc", F.zip_with(vector_to_array("pc"), sign, lambda x, s: x * s)).drop("features")


def self_organised(rows: DataFrame, features: list[str], width: int, height: int, passes: int = 10, sample: int = 5_000, seed: int = 1) -> DataFrame:
    """`rows` with the node of a self-organising map, learned from at most `sample` rows (those of least hash) on the driver."""
    order = F.xxhash64(F.lit(seed), *features)
    x = np.array([[r[f] for f in features] for r in rows.dropna(subset=features).orderBy(order, *features).limit(sample).collect()], dtype=float)
    rng = np.random.default_rng(seed)
    mean, std = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z = (x - mean) / std
    nodes = z[rng.integers(0, len(z), width * height)].copy()
    place = np.array([(i % width, i // width) for i in range(width * height)], float)
    steps = passes * len(z)
    for step in range(steps):
        v = z[rng.integers(0, len(z))]
        best = int(np.argmin(((nodes - v) ** 2).sum(axis=1)))
        radius = max(width, height) / 2 * math.exp(-3 * step / steps)
        pull = 0.5 * (1 - step / steps) * np.exp(-((place - place[best]) ** 2).sum(axis=1) / (2 * radius * radius))
        nodes += pull[:, None] * (v - nodes)
    far = [F.struct(sum(((F.col(f) - float(m)) / float(s) - F.lit(float(c))) ** 2 for f, m, s, c in zip(features, mean, std, node, strict=True)).alias("d"), F.lit(k).alias("node")) for k, node in enumerate(nodes)]
    return rows.withColumn("node", F.array_min(F.array(*far))["node"])


def covariance(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, covariance and number of rows without NULL: one aggregate, a number for each pair of features to the driver."""
    n = len(features)
    a = rows.dropna(subset=features).agg(F.count("*"), *[F.avg(f) for f in features], *[F.covar_pop(features[i], features[j]) for i in range(n) for j in range(i, n)]).first()
    cov, k = np.zeros((n, n)), 1 + n
    for i in range(n):
        for j in range(i, n):
            cov[i, j] = cov[j, i] = a[k] if a[k] is not None else 0.0
            k += 1
    return np.array([x if x is not None else 0.0 for x in a[1 : 1 + n]]), cov, a[0]


def project(rows: DataFrame, features: list[str], mean: np.ndarray, axes: np.ndarray, names: list[str]) -> DataFrame:
    """Columns of (features - mean) times each axis."""
    out = []
    for k, name in enumerate(names):
        c: Column = F.lit(0.0)
        for f, m, w in zip(features, mean, axes[:, k], strict=True):
            c = c + (F.col(f) - float(m)) * float(w)
        out.append(c.alias(name))
    return rows.select("*", *out)


def signed(axes: np.ndarray) -> np.ndarray:
    """Axes turned so that each one's largest weight is positive."""
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])


def empirical_functions(wide: DataFrame, dates: list[str], modes: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """EOF of a key-by-date table: keys' patterns, the dates' weights, shares of variance, and North's errors of these.

    The Gram matrix of dates is one aggregate; only it, dates by dates, comes to the driver.
    """
    mean, cov, n = covariance(wide, dates)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:modes]
    share = values[order] / max(values.sum(), 1e-300)
    axes = signed(axes[:, order])
    return project(wide, dates, mean, axes, [f"eof{k + 1}" for k in range(len(order))]), axes, share, share * math.sqrt(2 / max(n, 1))


def noise_fractions(cells: DataFrame, bands: list[str], k: int) -> tuple[DataFrame, np.ndarray]:
    """Minimum noise fraction of cells (x, y, bands): noise from differences of neighbours; components in order of signal to noise."""
    right = cells.select((F.col("x") - 1).alias("x"), "y", *[F.col(b).alias(f"n_{b}") for b in bands])
    steps = cells.join(right, ["x", "y"]).select(*[(F.col(b) - F.col(f"n_{b}")).alias(b) for b in bands])
    mean, cov, _ = covariance(cells, bands)
    _, noise, _ = covariance(steps, bands)
    vals, vecs = np.linalg.eigh(noise / 2 + np.eye(len(bands)) * 1e-12)
    white = vecs / np.sqrt(np.maximum(vals, 1e-12))
    snr, rot = np.linalg.eigh(white.T @ cov @ white)
    order = np.argsort(-snr)[:k]
    return project(cells, bands, mean, signed(white @ rot[:, order]), [f"mnf{i + 1}" for i in range(len(order))]), snr[order]


def chi2_survival(chi: Column, df: int) -> Column:
    """The probability of a greater chi square with `df` degrees of freedom, to 1e-7 of itself; 1 where it isn't positive."""
    x = F.greatest(chi, F.lit(0.0)) / 2
    if df % 2 == 0:
        total, term = F.lit(0.0), F.lit(1.0)
        for j in range(df // 2):
            term = term * x / j if j else term
            total = total + term
        return F.exp(-x) * total
    # the complementary error function by Chebyshev's fit (Press and others), then the finite sum
    z = F.sqrt(x)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    total = t * F.exp(-x + poly)
    for j in range(1, df // 2 + 1):
        total = total + F.exp(-x) * F.pow(x, F.lit(j - 0.5)) / math.gamma(j + 0.5)
    return F.least(total, F.lit(1.0))


def altered_by_reweighting(before: DataFrame, after: DataFrame, bands: list[str], key: str = "px", rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """IR-MAD: canonical variates of two images, reweighted by the probability of no change; chi square and that probability for each key.

    Each round is one weighted aggregate; matrices of bands by bands come to the driver.
    """
    n = len(bands)
    names = [f"b_{b}" for b in bands] + [f"a_{b}" for b in bands]
    both = before.select(key, *[F.col(b).alias(f"b_{b}") for b in bands]).join(after.select(key, *[F.col(b).alias(f"a_{b}") for b in bands]), key).dropna()
    probability = lambda chi: chi2_survival(chi, n)
    rows, w, last = both, F.lit(1.0), None
    chi: Column = F.lit(0.0)
    for _ in range(rounds):
        r = rows.withColumn("w", w)
        a = r.agg(F.sum("w"), *[F.sum(F.col("w") * F.col(c)) for c in names], *[F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])) for i in range(2 * n) for j in range(i, 2 * n)]).first()
        total = a[0]
        mean = np.array(a[1 : 1 + 2 * n]) / total
        cov, k = np.zeros((2 * n, 2 * n)), 1 + 2 * n
        for i in range(2 * n):
            for j in range(i, 2 * n):
                cov[i, j] = cov[j, i] = a[k] / total - mean[i] * mean[j]
                k += 1
        sxx, syy, sxy = cov[:n, :n], cov[n:, n:], cov[:n, n:]
        half = lambda s: (lambda v, u: u / np.sqrt(np.maximum(v, 1e-12)))(*np.linalg.eigh(s))
        hx, hy = half(sxx), half(syy)
        u, rho, vt = np.linalg.svd(hx.T @ sxy @ hy)
        ax, ay = hx @ u, hy @ vt.T
        rho = np.clip(rho, 0, 1 - 1e-9)
        chi = F.lit(0.0)
        for k in range(n):
            d: Column = F.lit(0.0)
            for i in range(n):
                d = d + (F.col(names[i]) - float(mean[i])) * float(ax[i, k]) - (F.col(names[n + i]) - float(mean[n + i])) * float(ay[i, k])
            chi = chi + d * d / float(2 * (1 - rho[k]))
        w = probability(chi)
        if last is not None and float(np.abs(rho - last).max()) < tolerance:
            break
        last = rho
    return both.select(key, chi.alias("chi2")).withColumn("p_unchanged", probability(F.col("chi2")))


def texture(cells: DataFrame, levels: int, lo: float, hi: float, distance: int, window: int) -> DataFrame:
    """Grey-level co-occurrence in windows of cells: contrast, dissimilarity, homogeneity, energy, entropy, correlation, mean; pairs to the right and below, both ways."""
    q = F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor((F.col("value") - lo) / ((hi - lo) / levels)))).cast("int")
    own = cells.where("value is not null").select("x", "y", q.alias("a"))
    pairs = None
    for dx, dy in ((distance, 0), (0, distance)):
        other = own.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("a").alias("b"))
        part = own.join(other, ["x", "y"])
        part = part.unionByName(part.select("x", "y", F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = part if pairs is None else pairs.unionByName(part)
    block = [F.floor(F.col(c) / window).alias(f"block_{c}") for c in ("x", "y")]
    n = pairs.groupBy(*block, "a", "b").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("block_x", "block_y")))
    d = F.abs(F.col("a") - F.col("b"))
    s = p.groupBy("block_x", "block_y").agg(
        F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * d).alias("dissimilarity"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("asm"),
        F.sum(-F.col("p") * F.ln("p")).alias("entropy"), F.sum(F.col("p") * F.col("a")).alias("mean"), F.sum(F.col("p") * F.col("a") * F.col("a")).alias("m2"), F.sum(F.col("p") * F.col("a") * F.col("b")).alias("ab"),
    )
    var = F.col("m2") - F.col("mean") * F.col("mean")
    return s.select("block_x", "block_y", "contrast", "dissimilarity", "homogeneity", F.sqrt("asm").alias("energy"), "entropy", "mean", divide(F.col("ab") - F.col("mean") * F.col("mean"), F.when(var > 1e-12, var)).alias("correlation"))


def latin_hypercube(ranges: dict[str, tuple[float, float]], n: int, seed: int) -> list[dict[str, float]]:
    """n settings in which each parameter's range is met once in each of n parts."""
    rng = np.random.default_rng(seed)
    columns = {k: lo + (rng.permutation(n) + rng.random(n)) / n * (hi - lo) for k, (lo, hi) in ranges.items()}
    return [{k: float(v[i]) for k, v in columns.items()} for i in range(n)]


def scored_settings(detected: DataFrame, reference: DataFrame, tolerance: int) -> DataFrame:
    """F1 of each setting's detections (setting, sample, year) against reference years (sample, year or none), with and without the date."""
    settings = detected.select("setting").distinct()
    every = reference.select("sample", F.col("year").alias("truth")).join(F.broadcast(settings))  # settings are a stated, small set
    both = every.join(detected.select("setting", "sample", "year"), ["setting", "sample"], "left")
    hit, said, true = F.col("truth").isNotNull() & F.col("year").isNotNull(), F.col("year").isNotNull(), F.col("truth").isNotNull()
    n = both.groupBy("setting").agg(F.count_if(hit).alias("tp"), F.count_if(said).alias("said"), F.count_if(true).alias("true"), F.count_if(hit & (F.abs(F.col("truth") - F.col("year")) <= tolerance)).alias("dated"))
    return n.select("setting", divide(2 * F.col("tp"), F.col("said") + F.col("true")).alias("f1"), divide(2 * F.col("dated"), F.col("said") + F.col("true")).alias("dated_f1"), divide(F.col("tp"), F.col("said")).alias("precision"), divide(F.col("tp"), F.col("true")).alias("recall"))
