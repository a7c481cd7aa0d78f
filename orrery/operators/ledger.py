"""Bitemporal ledgers: append-only versions read as of a system sequence and a valid time; deterministic compilers over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.stage import stored


def valid_at(instant: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half open: from <= instant < to; a null bound is open."""
    return (F.col(start).isNull() | (F.col(start) <= instant)) & (F.col(end).isNull() | (instant < F.col(end)))


def modes(mode: str, now: int, head: int, valid: int | None = None, sequence: int | None = None) -> tuple[int, int]:
    """(valid instant, system sequence) of current, valid_at, known_at and bitemporal reads."""
    return {"current": (now, head), "valid_at": (valid, head), "known_at": (now, sequence), "bitemporal": (valid, sequence)}[mode]


def as_of(versions: DataFrame, lifecycle: DataFrame, instant: int, sequence: int, limit: int | None = None) -> DataFrame:
    """Versions committed by the sequence, valid at the instant, whose last state by then is active; by sequence, then id, then cut.
    versions: (version_id, committed_sequence, valid_from, valid_to, ...); lifecycle: (version_id, sequence, state)."""
    state = lifecycle.filter(F.col("sequence") <= sequence).groupBy("version_id").agg(F.max_by("state", "sequence").alias("state"))
    seen = versions.filter((F.col("committed_sequence") <= sequence) & valid_at(F.lit(instant))).join(state, "version_id").filter("state = 'active'")
    return seen if limit is None else seen.orderBy("committed_sequence", "version_id").limit(limit)


def heads(versions: DataFrame, head_table: DataFrame, limit: int) -> DataFrame:
    """Versions that the head table (assertion_id, version_ids) names; the limit goes before the sort, over heads by assertion."""
    first = head_table.orderBy("assertion_id").limit(limit).select("assertion_id", F.explode("version_ids").alias("version_id"))
    return first.join(versions, ["assertion_id", "version_id"])


def history(versions: DataFrame, lifecycle: DataFrame, start: int, end: int) -> DataFrame:
    """(sequence, kind, version_id, detail) of commits and transitions within [start, end]."""
    commits = versions.select(F.col("committed_sequence").alias("sequence"), F.lit("commit").alias("kind"), "version_id", F.lit("active").alias("detail"))
    moves = lifecycle.select("sequence", F.lit("transition").alias("kind"), "version_id", F.col("state").alias("detail"))
    return commits.unionByName(moves).filter(F.col("sequence").between(start, end))


def recall(scored: DataFrame, pool: DataFrame, current: int, has_query: bool = True, structured: bool = False) -> DataFrame:
    """(qid, id, score, rank, codes): ledger BM25 scores (qid, id, score) over the pool (qid, id, sequence), plus 1 for structured filters and
    a thousandth by recency; candidates without a match or signal are kept without rank."""
    own = pool.join(scored.withColumnRenamed("score", "lex"), ["qid", "id"], "left")
    match = F.coalesce(F.col("lex") > 0, F.lit(False)) if has_query else F.lit(structured)
    score = F.coalesce("lex", F.lit(0.0)) + (1.0 if structured else 0.0) + (F.col("sequence") / current * 0.001 if current > 0 else F.lit(0.0))
    own = own.withColumns({"ok": match, "score": F.when(match, F.round(score, 6)).otherwise(0.0)})
    w = Window.partitionBy("qid").orderBy(F.desc("ok"), F.desc("score"), F.col("id").cast("string"))
    rank = F.when(F.col("ok"), F.row_number().over(w))
    out = "EXCLUDED_NO_LEXICAL_MATCH" if has_query else "EXCLUDED_NO_RANKING_SIGNAL"
    codes = F.array_compact(
        F.array(
            F.lit("ADMITTED_TO_BOUNDED_POOL"), F.when(~F.col("ok"), out), F.when(F.col("ok") & F.lit(has_query), "LEXICAL_MATCH"),
            F.when(F.col("ok") & F.lit(structured), "STRUCTURED_FILTER_MATCH"), F.when(F.col("ok"), "RANKED_CANDIDATE"),
        )
    )
    return own.select("qid", "id", "score", rank.alias("rank"), codes.alias("codes"))


def consolidate(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicates and conflicts by (scope, predicate, kind): versions of equal content keep the earliest with the union of evidence;
    distinct contents conflict in pairs of their earliest versions. versions: (version_id, scope, predicate, kind, content, evidence array,
    committed_sequence)."""
    key = ["scope", "predicate", "kind"]
    groups = versions.groupBy(*key, "content").agg(
        F.min_by("version_id", F.struct("committed_sequence", "version_id")).alias("retained"),
        F.min("committed_sequence").alias("first"),
        F.count("*").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )
    groups = stored(groups, "ledger-groups")
    left, right = (groups.select(*key, F.col("retained").alias(n)) for n in ("one", "other"))
    return groups.filter("n > 1"), left.join(right, key).filter("one < other")


def trajectories(events: DataFrame) -> DataFrame:
    """(scope, contiguous, n_steps, steps, recoveries) of events (scope, ordinal, action, outcome, recovery): the succeeded actions in order;
    ordinals must go from 1 without gaps."""
    own = F.sort_array(F.collect_list(F.struct("ordinal", "action", "outcome", "recovery")))
    rows = events.groupBy("scope").agg(own.alias("e"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d"), F.count("*").alias("n"))
    steps = F.transform(F.filter("e", lambda x: x["outcome"] == "succeeded"), lambda x: x["action"])
    back = F.transform(F.filter("e", lambda x: x["recovery"].isNotNull()), lambda x: x["recovery"])
    return rows.select("scope", ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("contiguous"), F.size(steps).alias("n_steps"), steps.alias("steps"), back.alias("recoveries"))


def deletion_closure(derived: DataFrame, roots: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, depth): roots (id) and all that derives from them by derived (source, target), to the fixpoint. Each round joins only what was
    new, written to the shared folder; raises if it isn't done after `rounds`."""
    seen = stored(roots.select("id").distinct().withColumn("depth", F.lit(0)), "closure")
    front = seen
    for depth in range(1, rounds + 1):
        fresh = derived.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = stored(fresh.withColumn("depth", F.lit(depth)), "closure")
        if not front.head(1):
            return seen
        seen = stored(seen.unionByName(front), "closure-all")
    raise RuntimeError(f"derivations are deeper than {rounds}")


def observations(obs: DataFrame, head_table: DataFrame) -> DataFrame:
    """Each observation (ordinal, key, content) with the heads expected for its key, and how it relates to them."""
    own = obs.join(head_table, "key", "left").groupBy("ordinal", "key", "content").agg(F.array_sort(F.collect_list("head_id")).alias("expected"), F.coalesce(F.bool_or(F.col("head_content") == F.col("content")), F.lit(False)).alias("same"))
    return own.select("ordinal", "key", "content", "expected", F.when(F.size("expected") == 0, "new").when(F.col("same"), "duplicate").otherwise("contradiction").alias("relation"))


def visibility(checkpoints: DataFrame) -> DataFrame:
    """Per stream, the sequence that all projections have applied: (stream, visible, lag)."""
    return checkpoints.groupBy("stream").agg(F.min("applied").alias("visible"), (F.max("applied") - F.min("applied")).alias("lag"))
