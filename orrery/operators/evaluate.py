"""Retrieval metrics, text overlap, percentiles, service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(hits: DataFrame, relevant: DataFrame, k: int, denominator: str = "relevant") -> DataFrame:
    """(qid, recall) for each query of relevant (qid, id): unique hits among the first k, over the number of relevant ids, or over k."""
    rel = relevant.select("qid", "id").distinct()
    found = hits.filter(F.col("rank") <= k).select("qid", "id").distinct().join(rel, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hit"))
    n = rel.groupBy("qid").agg(F.count("*").alias("n")).join(found, "qid", "left")
    by = F.col("n") if denominator == "relevant" else F.lit(k)
    return n.select("qid", F.round(F.coalesce("hit", F.lit(0)) / by, 6).alias("recall"))


def ndcg(hits: DataFrame, grades: DataFrame, k: int, graded: bool = False) -> DataFrame:
    """(qid, ndcg): gains of 1 / log2(rank + 1), or (2 ^ grade - 1) of that. Without any gain to be had: 0, or 1 if graded.
    grades: (qid, id, grade)."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1 if graded else F.when(F.col("grade") > 0, 1.0).otherwise(0.0)
    place = lambda r: F.log2(F.col(r) + 1)
    got = hits.filter(F.col("rank") <= k).join(grades, ["qid", "id"]).groupBy("qid").agg(F.sum(gain / place("rank")).alias("dcg"))
    best = grades.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "id"))).filter(F.col("r") <= k).groupBy("qid").agg(F.sum(gain / place("r")).alias("ideal"))
    value = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(1.0 if graded else 0.0)
    return best.join(got, "qid", "left").select("qid", F.round(value, 6).alias("ndcg"))


def reciprocal_rank(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(qid, rr, hit) of the first relevant hit."""
    first = hits.join(relevant.select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("r"))
    return relevant.select("qid").distinct().join(first, "qid", "left").select("qid", F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 6).alias("rr"), F.col("r").isNotNull().alias("hit"))


def token_f1(pairs: DataFrame) -> DataFrame:
    """(id, f1, exact) of (id, answer, reference): overlap of lower-cased word multisets. Both empty: 1."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    own = pairs.select("id", words("answer").alias("a"), words("reference").alias("r"))
    count = lambda c, n: own.select("id", F.explode(c).alias("w")).groupBy("id", "w").agg(F.count("*").alias(n))
    common = count("a", "x").join(count("r", "y"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("x", "y")).alias("common"))
    both = F.size("a") + F.size("r")
    f1 = F.when(both == 0, 1.0).otherwise(2 * F.coalesce("common", F.lit(0)) / both)
    return own.join(common, "id", "left").select("id", F.round(f1, 6).alias("f1"), (F.array_join("a", " ") == F.array_join("r", " ")).alias("exact"))


def nearest_rank(values: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles as the value at place ceil(p n): an aggregate, no window."""
    return values.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(n) for n, p in ps.items()])


def rounded_rank(values: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """The other definition: the value at index round((n - 1) p), half up. Groups are small: one row's worth of samples."""
    own = values.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("__v"))
    return own.select(*by, *[F.get("__v", F.floor((F.size("__v") - 1) * p + 0.5).cast("int")).alias(n) for n, p in ps.items()])


def latency(values: DataFrame, by: list[str], value: str) -> DataFrame:
    exact = [F.expr(f"percentile_disc({p}) within group (order by {value})").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.round(F.avg(value), 6).alias("avg"), *exact, F.max(value).alias("max"))


def slo(samples: DataFrame, by: str, order: str, value: str, last: int, target: float, load: float = 1.0) -> DataFrame:
    """(by, n, within, p95, loaded_p95, timeout): of the last samples, the share within the target and the p95, scaled by load; the
    timeout is one and a half times that."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    recent = samples.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= last)
    own = recent.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col(value) <= target).cast("int")), 6).alias("within"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"))
    return own.select(by, "n", "within", "p95", F.round(F.col("p95") * load, 6).alias("loaded_p95"), F.round(F.col("p95") * load * 1.5, 6).alias("timeout"))


def moving(samples: DataFrame, by: str, order: str, value: str, n: int) -> DataFrame:
    """Adds the mean of the last n samples up to each."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-n + 1, 0)
    return samples.withColumn("moving_avg", F.round(F.avg(value).over(w), 6))


def bootstrap_ci(pairs: DataFrame, a: str, b: str, resamples: int = 1000, seed: int = 13, level: float = 0.95) -> DataFrame:
    """(mean_diff, low, high) of b - a by paired bootstrap. Each resample weighs a row by a Poisson count drawn from a hash of row and
    resample, so it is one pass with partial sums, whatever the number of rows. pairs has an id."""
    from pyspark.sql.functions import xxhash64

    rounds = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("round")
    own = pairs.select("id", (F.col(b) - F.col(a)).alias("d"))
    u = F.pmod(xxhash64(F.lit(seed), "id", "round"), F.lit(1 << 30)) / float(1 << 30)
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)
    weight = sum((u >= c).cast("int") for c in cuts)
    means = own.select("id", "d", rounds).withColumn("w", weight).groupBy("round").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    ci = means.agg(F.expr(f"percentile_disc({tail}) within group (order by m)").alias("low"), F.expr(f"percentile_disc({1 - tail}) within group (order by m)").alias("high"))
    return own.agg(F.round(F.avg("d"), 6).alias("mean_diff")).crossJoin(ci)


def rate(name: str, test: Column) -> Column:
    return F.round(F.avg(test.cast("int")), 6).alias(name)
