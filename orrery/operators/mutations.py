"""Writes as sets: upserts, batch checks, change detection, lifecycle, ordered replay, write-ahead logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: str, op: str = "op") -> DataFrame:
    """Last write of each key, deletions gone: one aggregation with partial maxima, no window."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")
    return last.filter(F.col(op) != "delete")


def reused(inserts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Inserts of ids that were deleted before: never allowed."""
    return inserts.join(tombstones.select("id").distinct(), "id", "left_semi")


def batch_check(batch: DataFrame, dim: int) -> DataFrame:
    """(id, status): a batch with a repeated id is rejected whole; else rows with an empty or too long id, or a vector of another dimension or not finite, fail."""
    n = batch.groupBy("id").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most"))
    bad_id = F.col("id").isNull() | (F.col("id") == "") | (F.octet_length("id") > 1024)
    bad = F.coalesce(F.size("vec") != dim, F.lit(True)) | F.coalesce(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return batch.crossJoin(F.broadcast(n)).select("id", F.when(F.col("most") > 1, "rejected_duplicate").when(bad_id | bad, "failed").otherwise("ok").alias("status"))


def delete_status(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, status) for ids asked to go, against rows (id, deleted)."""
    return wanted.join(rows, "id", "left").select("id", F.when(F.col("deleted").isNull(), "not_found").when(F.col("deleted"), "already_deleted").otherwise("deleted").alias("status"))


def update_status(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    return wanted.join(rows.select("id", F.lit(True).alias("there")), "id", "left").select("id", F.when(F.col("there"), "updated").otherwise("created").alias("status"))


def replace_document(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """Live chunks: those of each document's last revision. heads: (document_id, revision, request_hash); repeats of a request are one."""
    last = heads.dropDuplicates(["document_id", "request_hash"]).groupBy("document_id").agg(F.max("revision").alias("revision"))
    return chunks.join(last, ["document_id", "revision"])


def diff(listing: DataFrame, manifest: DataFrame, threshold: int = 3) -> DataFrame:
    """(key, change) by full outer join of listing (key, etag) and manifest (key, etag, missing_count): new, updated, missing (seen missing
    less than threshold times with this), confirmed_delete; unchanged keys are left out."""
    both = listing.select("key", F.col("etag").alias("now")).join(manifest.select("key", F.col("etag").alias("then"), "missing_count"), "key", "full_outer")
    change = (
        F.when(F.col("then").isNull(), "new")
        .when(F.col("now").isNull(), F.when(F.col("missing_count") + 1 >= threshold, "confirmed_delete").otherwise("missing"))
        .when(F.col("now") != F.col("then"), "updated")
    )
    return both.select("key", change.alias("change")).filter("change is not null")


def lifecycle(manifest: DataFrame, now: int, threshold: int = 3, hard_after: int = 7 * 86_400_000) -> DataFrame:
    """(key, state): the next state of each object from (key, state, seen, missing_count, since): seen ones are active again; missing
    ones are marked, confirmed at the threshold, and scheduled for removal after hard_after milliseconds."""
    missing = F.col("missing_count") + 1
    state = (
        F.when(F.col("seen"), "active")
        .when(F.col("state") == "hard_delete_scheduled", "hard_delete_scheduled")
        .when((F.col("state") == "confirmed_missing") & (F.lit(now) - F.col("since") >= hard_after), "hard_delete_scheduled")
        .when(F.col("state") == "confirmed_missing", "confirmed_missing")
        .when(missing >= threshold, "confirmed_missing")
        .otherwise("marked_for_deletion")
    )
    return manifest.select("key", state.alias("state"))


def route_failures(events: DataFrame, kind: str = "error", attempt: str = "attempt") -> DataFrame:
    """Adds route: parse and JSON errors go to the dead letters at once, others from the third attempt; else they are retried."""
    return events.withColumn("route", F.when(F.col(kind).isNull(), "ok").when(F.col(kind).isin("parse", "json") | (F.col(attempt) >= 3), "dead_letter").otherwise("retry"))


def content_dedup(rows: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of each content, by sha-256; ties by order."""
    rest = F.struct(*rows.columns)
    return rows.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min_by(rest, F.col(order)).alias("x"), F.count("*").alias("copies")).select("sha256", "copies", "x.*")


def replay(mutations: DataFrame, applied: int, target: int) -> DataFrame:
    """Checks an ordered replay, a row a mutation (sequence, mutation_id, hash, arrival): beyond (the target), gap (after the first
    sequence that is missing from applied + 1 on: each must follow the one applied before, so all after a hole are held back),
    duplicate (same id and hash again), conflict (same sequence, other content), already_applied or apply. A sequence's first row
    is the reference. The hole is found by a join of the sequences on the number before and one aggregate."""
    by_seq = mutations.groupBy("sequence").agg(F.min(F.struct("arrival", "mutation_id", "hash")).alias("f"))
    firsts = by_seq.select("sequence", F.col("f.mutation_id").alias("first_id"), F.col("f.hash").alias("first_hash"), F.col("f.arrival").alias("first_arrival"))
    after = firsts.filter(F.col("sequence") > applied).select((F.col("sequence") + 1).alias("sequence"))
    after = after.unionByName(mutations.sparkSession.range(1).select(F.lit(applied + 1).cast("long").alias("sequence")))
    hole = after.join(firsts.select("sequence"), "sequence", "left_anti").agg(F.min("sequence").alias("hole"))
    own = mutations.join(firsts, "sequence").crossJoin(F.broadcast(hole))  # one row
    status = (
        F.when(F.col("sequence") > target, "beyond")
        .when(F.col("sequence") > F.col("hole"), "gap")
        .when((F.col("arrival") != F.col("first_arrival")) & (F.col("mutation_id") == F.col("first_id")) & (F.col("hash") == F.col("first_hash")), "duplicate")
        .when(F.col("arrival") != F.col("first_arrival"), "conflict")
        .when(F.col("sequence") <= applied, "already_applied")
        .otherwise("apply")
    )
    return own.select("sequence", "mutation_id", status.alias("status"))


def materialize(records: DataFrame, edges: DataFrame, mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and edges after mutations (sequence, chunk_id, op, payload): the last per chunk counts; edges whose evidence names a changed
    chunk, or that touch it, go."""
    last = mutations.groupBy("chunk_id").agg(F.max_by(F.struct("op", "payload"), "sequence").alias("x")).select("chunk_id", "x.*")
    kept = records.join(last.select("chunk_id"), "chunk_id", "left_anti")
    out = kept.unionByName(last.filter("op = 'upsert'").select("chunk_id", "payload"))
    cited = edges.select("edge_id", F.explode(F.array_distinct(F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.array("from_id", "to_id")))).alias("chunk_id"))
    hit = cited.join(last.select("chunk_id"), "chunk_id", "left_semi").select("edge_id").distinct()
    return out, edges.join(hit, "edge_id", "left_anti")


def bundle_order(lines: DataFrame) -> DataFrame:
    """Violations of a bundle's order (ordinal, section, id): header first, sections record, node, edge, ids strictly increasing in each.
    Neighbours come from a join on ordinal + 1, not from a window over all lines."""
    level = F.element_at(F.create_map(*[x for i, s in enumerate(("header", "record", "node", "edge")) for x in (F.lit(s), F.lit(i))]), F.col("section"))
    own = lines.select("ordinal", "section", "id", level.alias("level"))
    before = own.select((F.col("ordinal") + 1).alias("ordinal"), F.col("section").alias("section0"), F.col("id").alias("id0"), F.col("level").alias("level0"))
    both = own.join(before, "ordinal", "left")
    bad = (
        F.when((F.col("ordinal") == 0) & (F.col("section") != "header"), "header_missing")
        .when((F.col("ordinal") > 0) & (F.col("section") == "header"), "header_repeated")
        .when(F.col("level") < F.col("level0"), "section_order")
        .when((F.col("section") == F.col("section0")) & (F.col("id") <= F.col("id0")), "id_order")
    )
    return both.select("ordinal", bad.alias("violation")).filter("violation is not null")


#: state -> action -> state of a generation
TRANSITIONS = {
    ("none", "stage"): "staged", ("staged", "catch_up"): "catching_up", ("catching_up", "ready"): "ready", ("staged", "fail"): "failed",
    ("catching_up", "fail"): "failed", ("ready", "activate"): "active", ("active", "rollback"): "ready", ("ready", "fail"): "failed",
}


def generation_step(state: Column, action: Column) -> Column:
    """The next state, the same if the action was already taken, else `invalid`."""
    out = F.lit("invalid")
    for (s, a), to in TRANSITIONS.items():
        out = F.when(((state == s) & (action == a)) | ((state == to) & (action == a)), to).otherwise(out)
    return out


def reindex_plan(docs: DataFrame, category: str) -> DataFrame:
    """Active documents of a category with the version they get: the category's largest and one."""
    own = docs.filter((F.col("category") == category) & (F.col("state") == "active"))
    return own.join(F.broadcast(own.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("new_version")))).select("id", "version", "new_version")


def first_gap(sequences: DataFrame, order: str, by: str) -> DataFrame:
    """(by, gaps) by lag within each group."""
    w = Window.partitionBy(by).orderBy(order)
    return sequences.withColumn("d", F.col(order) - F.lag(order).over(w)).groupBy(by).agg(F.count_if(F.col("d") > 1).alias("gaps"))
