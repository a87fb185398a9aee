"""Quality-control aggregates: coverage, fractions, correlation, principal components, difference surfaces.

Each returns the numbers that a plot would show. Sample-by-sample matrices are sums over loci that
tasks add up in numpy; only the matrices, whose size is the number of samples squared, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.schema import require

PROBABILITIES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.995, 0.999, 1.0]


def fraction(df: DataFrame) -> Column:
    """Percent modified: of mh, or else of m."""
    for name in ("mh_frac", "m_frac"):
        if name in df.columns:
            return 100 * F.col(name)
    raise ValueError("the table has neither mh_frac nor m_frac")


def summary(df: DataFrame, value: Column) -> DataFrame:
    """One row: minimum, quartiles, mean, maximum, and the number of nulls."""
    v = value.cast("double")
    q = lambda p: F.percentile(v, p)
    return df.agg(F.min(v).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), F.avg(v).alias("mean"), q(0.75).alias("q3"), F.max(v).alias("max"), F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("long").alias("n_null"))


def quantiles(df: DataFrame, value: Column, probabilities: list[float] = PROBABILITIES) -> DataFrame:
    """(probability, value) with linear interpolation."""
    p = F.array(*map(F.lit, probabilities))
    found = df.agg(F.percentile(value.cast("double"), p).alias("q"))
    return found.select(F.explode(F.arrays_zip(p.alias("probability"), F.col("q").alias("value"))).alias("z")).select(F.col("z.probability").alias("probability"), F.col("z.value").alias("value"))


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    """(center, n): bins around the multiples of width, closed to the right."""
    center = F.ceil(value.cast("double") / width - 0.5) * F.lit(width)
    return df.where(value.isNotNull()).groupBy(center.cast("double").alias("center")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame) -> dict[str, DataFrame]:
    require(df, "num_calls")
    df = df.dropna()
    calls = F.col("num_calls")
    return {"summary": summary(df, calls), "quantiles": quantiles(df, calls), "histogram": histogram(df.where("num_calls > 0"), F.log10(calls), 0.25)}


def modfrac(df: DataFrame) -> dict[str, DataFrame]:
    value = fraction(df)
    return {"summary": summary(df, value), "quantiles": quantiles(df, value), "histogram": histogram(df, value, 10)}


def _features(df: DataFrame, call_type: str) -> list[str]:
    return ["region_name"] if call_type == "regions" else ["chrom", "start", "end"]


def wide(df: DataFrame, call_type: str, value: str = "m_frac", agg_fun: Callable[[Column], Column] = F.avg) -> tuple[DataFrame, list[str]]:
    """Loci by samples, and the sample names in order."""
    require(df, "sample_name", value, *_features(df, call_type))
    names = sorted(r[0] for r in df.select("sample_name").distinct().collect() if r[0] is not None)
    table = df.groupBy(*_features(df, call_type)).pivot("sample_name", names).agg(agg_fun(F.col(value)).cast("double"))
    return table, names


def _moments(table: DataFrame, names: list[str], complete: bool) -> np.ndarray:
    """Sums over loci where both samples have a value: [n, x, xx, xy] by sample and sample."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) if b.num_rows else np.zeros((0, k))
            if complete:
                x = x[~np.isnan(x).any(axis=1)]
            has = ~np.isnan(x)
            v, has = np.where(has, x, 0.0), has.astype(float)
            total += [has.T @ has, v.T @ has, (v * v).T @ has, v.T @ v]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    parts = table.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, "m array<double>")
    sums = parts.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    out = np.zeros(4 * k * k)
    for r in sums:
        out[r.pos] = r.v
    return out.reshape(4, k, k)


def correlation_matrix(df: DataFrame, call_type: str = "positions", value: str = "m_frac", agg_fun: Callable[[Column], Column] = F.avg) -> tuple[np.ndarray, list[str]]:
    """Pearson by pairs of samples over the loci that both have; in windows, missing values are 0."""
    table, names = wide(df, call_type, value, agg_fun)
    if call_type == "windows":
        table = table.fillna(0.0, subset=names)
    n, x, xx, xy = _moments(table, names, False)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (n * xx - x * x) * (n * xx.T - x.T * x.T)
        r = np.where(spread > 1e-18, (n * xy - x * x.T) / np.sqrt(spread), np.nan)
    return r, names


def sample_correlation(df: DataFrame, call_type: str = "positions", value: str = "m_frac", agg_fun: Callable[[Column], Column] = F.avg, order: list[str] | None = None) -> DataFrame:
    """(sample_1, sample_2, correlation) for all pairs; null where a sample doesn't vary."""
    r, names = correlation_matrix(df, call_type, value, agg_fun)
    at = [names.index(n) for n in order] if order else range(len(names))
    rows = [(names[i], names[j], None if math.isnan(r[i, j]) else float(r[i, j])) for i in at for j in at]
    return df.sparkSession.createDataFrame(rows, "sample_1 string, sample_2 string, correlation double")


def pca(df: DataFrame, call_type: str = "positions", value: str = "m_frac") -> tuple[DataFrame, dict]:
    """Scores (sample_name, PC1, ...) and the components' deviations and shares of variance.

    Loci that lack a sample are left out, samples are standardised, loci centred. Scores follow from the
    samples' correlation matrix alone; a component's sign makes its largest score positive.
    """
    table, names = wide(df.dropna(), call_type, value)
    if len(names) < 2:
        raise ValueError("principal components need two samples or more")
    n, x, xx, xy = _moments(table, names, True)
    count = n[0, 0]
    if count < 2:
        raise ValueError("too few complete loci")
    cov = (xy - x * x.T / count) / (count - 1)
    sd = np.sqrt(np.diag(cov))
    if (sd == 0).any():
        raise ValueError("a sample has no variance")
    z = cov / np.outer(sd, sd) * (count - 1)
    centre = np.eye(len(names)) - 1 / len(names)
    values, vectors = np.linalg.eigh(centre @ z @ centre)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    scores = vectors * np.sqrt(values)
    scores = scores * np.sign(scores[np.abs(scores).argmax(axis=0), np.arange(len(names))])
    meta = {"sdev": np.sqrt(values / (len(names) - 1)).tolist(), "share": (values / values.sum()).tolist(), "features": int(count)}
    rows = [(name, *map(float, row)) for name, row in zip(names, scores, strict=True)]
    schema = "sample_name string, " + ", ".join(f"PC{i + 1} double" for i in range(len(names)))
    return df.sparkSession.createDataFrame(rows, schema), meta


def volcano(diff: DataFrame, bins: int = 100) -> DataFrame:
    """(x_bin, y_bin, x, y, n): loci by difference and -log10 p, in a grid over their ranges."""
    require(diff, "meth_diff", "p_val")
    ok = F.col("meth_diff").isNotNull() & ~F.isnan("meth_diff") & F.col("p_val").isNotNull() & ~F.isnan("p_val") & (F.col("p_val") > 0)
    points = diff.where(ok).select(F.col("meth_diff").alias("x"), (-F.log10("p_val")).alias("y"))
    edges = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    both = points.join(F.broadcast(edges))
    cell = lambda v, a, b: F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(v) - F.col(a), F.nullif(F.col(b) - F.col(a), F.lit(0.0))) * bins), F.lit(0))).cast("int")
    low = lambda v, a, b: F.col(a) + F.col(v) * (F.col(b) - F.col(a)) / bins
    counted = both.groupBy(cell("x", "x0", "x1").alias("x_bin"), cell("y", "y0", "y1").alias("y_bin"), "x0", "x1", "y0", "y1").agg(F.count("*").alias("n"))
    return counted.select("x_bin", "y_bin", low("x_bin", "x0", "x1").alias("x"), low("y_bin", "y0", "y1").alias("y"), "n")


def diff_density(diff: DataFrame, thresh: tuple[float, ...] = (0.2, 0.3), n_kde: int = 250, measure: str = "mh") -> tuple[DataFrame, dict]:
    """(x, y, z): Gaussian density of case against control fractions on the unit square; thresh is returned as it is."""
    case, control = f"{measure}_frac_case", f"{measure}_frac_control"
    require(diff, case, control)
    kept = diff.select(F.col(case).alias("x"), F.col(control).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    stats = kept.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("sd", F.stddev_samp), ("q", lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))))]).first()
    if stats.n < 20:
        raise ValueError("too few points for a density: 20 or more are needed")

    def width(c: str) -> float:
        q = stats[f"q_{c}"]
        h = 1.06 * min(stats[f"sd_{c}"], (q[1] - q[0]) / 1.34) * stats.n ** (-0.2)
        if h <= 0:
            raise ValueError("no bandwidth: the values hardly vary")
        return h

    hx, hy, n, size = width("x"), width("y"), stats.n, n_kde
    grid = np.linspace(0, 1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        kernel = lambda v, h: np.exp(-0.5 * ((grid[:, None] - v[None, :]) / h) ** 2) / math.sqrt(2 * math.pi)
        for b in batches:
            x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for k in range(0, len(x), 4096):
                total += kernel(x[k : k + 4096], hx) @ kernel(y[k : k + 4096], hy).T
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    cells = kept.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    at = lambda c: F.col(c) / F.lit(size - 1)
    return cells.select(at("i").alias("x"), at("j").alias("y"), (F.col("v") / (n * hx * hy)).alias("z")), {"thresh": tuple(thresh), "bandwidth": (hx, hy), "n": n}
