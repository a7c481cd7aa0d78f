"""Quality classifier: a document's evidence combined with beta-binomial posteriors of its host and path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import SPACES, lookup, stored
from orrery.llm.url_filter import strength

#: Labelled documents that the fit takes at most, by hash of the id.
SAMPLE = 20_000
#: Probability of good quality from which a document is kept.
KEEP = 0.5
RIDGE, STEPS = 1e-3, 40
FEATURES = ("symbols", "upper", "marks", "digits", "distinct", "log_words", "distinct_log_words", "mean_word")


def evidence(text: Column) -> Column:
    """struct of FEATURES of a whole text. Null text: empty. JVM expressions, no shuffle."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    share = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    words = F.split(F.btrim(t, F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    count = F.size(words).cast("double")
    distinct = F.size(F.array_distinct(words)) / count
    made = {
        "symbols": share("#*$%&|<>"),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ"),
        "marks": share("!?"),
        "digits": share("0123456789"),
        "distinct": distinct,
        "log_words": F.log1p(count),
        "distinct_log_words": distinct * F.log1p(count),
        "mean_word": F.least(n / count, F.lit(100.0)),
    }
    return F.struct(*[c.cast("double").alias(k) for k, c in made.items()])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: means, scales and weights (bias first) of the standardized features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + len(x) * RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (p - y) + len(x) * RIDGE * w)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return mean, scale, w


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", carry: list[str] | None = None
) -> DataFrame:
    """A row a document: the columns of `carry` (default doc_id), then doc_score, host_mean, path_mean, score, kept.

    doc_score is the classifier's probability of good quality from the text. host_mean is the posterior share of good labels of
    the host, shrunk to that of all; path_mean that of the host's path, shrunk to the host's. How strongly is estimated at each level by
    moments: the less sites differ beyond chance, the more. A labelled document's own label counts in its sites. score joins the document's evidence
    (its log odds less those of all labels) to the path's log odds. Label counts are aggregated by path first, so a host with
    most documents is no group of rows anywhere.

    Null text: empty. Null host or path: a site of its own, named by the empty text. Sites without labels: the level above. No
    labels, or of one kind only: doc_score is the share of good labels (one half without any). Null doc_id: judged, not learnt from.
    Repeated labels of an id: the best. Repeated rows: judged apart. Empty table: no rows. Clashing columns are safe.
    """
    carry = [doc_id] if carry is None else carry
    site = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).filter("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    seen = docs.select(F.col(f"`{doc_id}`").alias("id"), site(host).alias("host"), site(path).alias("path"), F.col(f"`{text}`").alias("text"))
    sites = stored(seen.select("id", "host", "path").join(known, "id").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good")), "quality-sites")
    total = sites.agg(F.sum("n"), F.sum("good")).first()
    n, good = float(total[0] or 0), float(total[1] or 0)
    share = (good + 1) / (n + 2)

    few = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # at most SAMPLE rows
    rows = seen.join(few, "id").select("id", F.xxhash64("text").alias("h"), evidence(F.col("text")).alias("x"), "y")
    # a row an id, that of the smallest hash of its texts
    rows = rows.groupBy("id").agg(F.min(F.struct("h", "x", "y")).alias("r")).select("id", "r.x.*", "r.y").toPandas().sort_values("id")
    x, y = rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float)
    mean, scale, w = fit(x, y) if 0 < y.sum() < len(y) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.log(share / (1 - share)), np.zeros(len(FEATURES))))

    hosts = sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hg"))
    host_weight = strength(hosts.select(F.col("hn").alias("n"), F.col("hg").alias("bad"))).first()["k"]
    path_weight = strength(sites.select("n", F.col("good").alias("bad"))).first()["k"]
    host_mean = (F.col("hg") + host_weight * share) / (F.col("hn") + host_weight)
    path_mean = (F.col("good") + path_weight * F.col("host_mean")) / (F.col("n") + path_weight)
    hosts = stored(hosts.select(F.col("host").alias("__host"), host_mean.alias("host_mean")), "quality-hosts")
    paths = sites.join(hosts, F.col("host") == F.col("__host")).select(F.col("host").alias("__host"), F.col("path").alias("__path"), path_mean.alias("path_mean"))
    paths = stored(paths, "quality-paths")

    logit = F.lit(float(w[0]))
    for i, name in enumerate(FEATURES):
        z = (F.col(f"x.{name}") - float(mean[i])) / float(scale[i])
        logit = logit + float(w[i + 1]) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__own"), site(host).alias("__host"), site(path).alias("__path"), evidence(F.col(f"`{text}`")).alias("x"))
    own = own.select("__own", "__host", "__path", (1 / (1 + F.exp(-logit))).alias("doc_score"))
    own = lookup(lookup(own, hosts, ["__host"]), paths, ["__host", "__path"])
    top = F.coalesce("host_mean", F.lit(share))
    low = F.coalesce("path_mean", top)
    odds = lambda p: F.log(p / (1 - p))
    safe = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("doc_score")))
    joint = odds(safe) - float(np.log(share / (1 - share))) + odds(low)
    own = own.select("__own", "doc_score", top.alias("host_mean"), low.alias("path_mean"), (1 / (1 + F.exp(-joint))).alias("score"))
    return own.select("__own.*", "doc_score", "host_mean", "path_mean", "score", (F.col("score") >= KEEP).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """The rows that the classifier keeps, with their columns as they were."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in dict.fromkeys((doc_id, text, host, path))])
    return classify(wrapped, labels, doc_id, text, host, path, label, carry=["row"]).filter("kept").select("row.*")
