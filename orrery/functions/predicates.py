"""Metadata predicates: filter trees over JSON, tag-index conditions, access scopes. All are plain boolean Columns (never null), so that
Catalyst can push what a source can take. The three dialects differ on purpose: tree() reads JSON values, tag_index() a table of
exploded tags, metadata_query() JSON paths as a relational index does."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.stage import let

OPERATORS = ("eq", "gt", "lt", "gte", "lte", "contains", "exists")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _literal(path: str) -> str:
    return '$["' + path.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def resolve(meta: Column, key: str) -> Column:
    """The variant at a key: the literal key if it is present, even as null, else the dotted path. An empty segment finds nothing."""
    parts = key.split(".")
    own = F.try_variant_get(meta, _literal(key), "variant")
    if len(parts) == 1 or "" in parts:
        return own
    path = "$" + "".join(_literal(p)[1:] for p in parts)
    return F.coalesce(own, F.try_variant_get(meta, path, "variant"))  # a JSON null is no SQL null


def _kind(v: Column) -> Column:
    """object, array, string, number, boolean, null or missing."""
    return let(F.schema_of_variant(v), lambda s: _kind_of(s, v))


def _kind_of(s: Column, v: Column) -> Column:
    return (
        F.when(v.isNull(), "missing")
        .when(F.is_variant_null(v), "null")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def _strings(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<string>")


def condition(meta: Column, key: str, op: str, value: Any = None) -> Column:
    """One condition on a variant of metadata. A value is text, number, boolean or a list of texts."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    return let(resolve(meta, key), lambda v: let(_kind(v), lambda kind: _test(v, kind, op, value)))


def _test(v: Column, kind: Column, op: str, value: Any) -> Column:
    if op == "exists":
        return _sure(~kind.isin("missing", "null"))
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    if op == "eq":
        if isinstance(value, list):
            if not value:
                return F.lit(False)
            same = F.array_sort(F.array_distinct(_strings(v))) == F.array(*[F.lit(x) for x in sorted(set(value), key=lambda s: s.encode())])
            return _sure((kind == "array") & _all_strings(v) & same)
        if isinstance(value, bool):
            return _sure((kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == value))
        return _sure((kind == "number") & (number == float(value))) if isinstance(value, (int, float)) else _sure((kind == "string") & (text == value))
    if op == "contains":
        items = _strings(v)
        if isinstance(value, list):
            inside = reduce(lambda a, b: a | b, [text.contains(x) for x in value], F.lit(False))
            among = F.arrays_overlap(items, F.array(*[F.lit(x) for x in value])) if value else F.lit(False)
            return _sure(((kind == "string") & inside) | ((kind == "array") & among))
        if isinstance(value, str):
            return _sure(((kind == "string") & text.contains(value)) | ((kind == "array") & F.array_contains(items, value)))
        wanted = json.dumps(value) if isinstance(value, bool) else None
        return _sure((kind == "array") & (F.array_contains(items, wanted) if wanted else F.array_contains(F.try_variant_get(v, "$", "array<double>"), float(value))))
    if isinstance(value, (bool, list)):
        return F.lit(False)
    side = (number, kind == "number", float(value)) if isinstance(value, (int, float)) else (text, kind == "string", value)
    compared = {"gt": side[0] > side[2], "lt": side[0] < side[2], "gte": side[0] >= side[2], "lte": side[0] <= side[2]}[op]
    return _sure(side[1] & compared)


def _all_strings(v: Column) -> Column:
    return F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>")


def tree(meta: Column, node: dict | None) -> Column:
    """{"and": [...]}, {"or": [...]}, {"not": node} or {"key", "op", "value"}. No filter and an empty and are true, an empty or is
    false; not of a missing key is true, since conditions are never null."""
    if node is None:
        return F.lit(True)
    return let(meta, lambda m: _tree(m, node))


def _tree(meta: Column, node: dict) -> Column:
    if "and" in node:
        return reduce(lambda a, b: a & b, [_tree(meta, n) for n in node["and"]], F.lit(True))
    if "or" in node:
        return reduce(lambda a, b: a | b, [_tree(meta, n) for n in node["or"]], F.lit(False))
    if "not" in node:
        return ~_tree(meta, node["not"])
    return condition(meta, node["key"], node["op"], node.get("value"))


def subset(meta: Column, wanted: dict) -> Column:
    """Every key present and equal; objects inside match as subsets; all else is strict JSON equality (arrays whole, 1 is not 1.0)."""

    def walk(m: Column, path: str, value: Any) -> Column:
        v = F.try_variant_get(m, path, "variant")
        if isinstance(value, dict):
            inner = [walk(m, path + _literal(k)[1:], x) for k, x in value.items()]
            return reduce(lambda a, b: a & b, inner, _sure(_kind(v) == "object"))
        return _sure(F.to_json(v) == json.dumps(value, separators=(",", ":"), ensure_ascii=False))

    return let(meta, lambda m: reduce(lambda a, b: a & b, [walk(m, _literal(k), x) for k, x in wanted.items()], F.lit(True)))


def in_workspace(meta: Column, workspace: str) -> Column:
    """Missing or null workspace is `default`; one that isn't text is rejected."""
    test = lambda v, kind: F.when(kind.isin("missing", "null"), F.lit(workspace == "default")).when(kind == "string", F.try_variant_get(v, "$", "string") == workspace)
    return _sure(let(F.try_variant_get(meta, "$.workspace_id", "variant"), lambda v: let(_kind(v), lambda kind: test(v, kind))))


def stamp(rows: DataFrame, workspace: str, column: str = "workspace_id", enforce: bool = True) -> DataFrame:
    """Adds the workspace where it is missing; with enforce, another workspace raises when the row is read."""
    own = F.col(column)
    clash = own.isNotNull() & (own != workspace)
    value = F.coalesce(own, F.lit(workspace))
    return rows.withColumn(column, F.when(clash, F.raise_error(F.lit("workspace differs")).cast("string")).otherwise(value) if enforce else value)


# tag index: rows (id, key, kind, text, number, flag), a list exploded to kind `item`


def tag_index(tags: DataFrame, key: str, op: str, value: Any = None) -> DataFrame:
    """Distinct ids by one condition: eq of a list is any of its items, contains is equality with a list item, ranges are numeric only,
    exists is any type."""
    t = tags.filter(F.col("key") == key)
    if op == "exists":
        hit = F.lit(True)
    elif op == "contains":
        hit = (F.col("kind") == "item") & (F.col("text") == value)
    elif op == "eq" and isinstance(value, list):
        hit = (F.col("kind") == "item") & F.col("text").isin(value)
    elif op == "eq":
        column, kind = ("flag", "boolean") if isinstance(value, bool) else ("number", "number") if isinstance(value, (int, float)) else ("text", "text")
        hit = (F.col("kind") == kind) & (F.col(column) == value)
    elif op in ("gt", "lt", "gte", "lte"):
        n = F.col("number")
        hit = (F.col("kind") == "number") & {"gt": n > value, "lt": n < value, "gte": n >= value, "lte": n <= value}[op]
    else:
        raise ValueError(f"unknown operator {op!r}")
    return t.filter(hit).select("id").distinct()


def tag_query(tags: DataFrame, universe: DataFrame, node: dict) -> DataFrame:
    """Set algebra over tag_index: and is intersect (empty: the universe), or is union, not is the universe without."""
    if "and" in node:
        sets = [tag_query(tags, universe, n) for n in node["and"]]
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), sets) if sets else universe.select("id").distinct()
    if "or" in node:
        sets = [tag_query(tags, universe, n) for n in node["or"]]
        return reduce(lambda a, b: a.unionByName(b), sets).distinct() if sets else universe.select("id").limit(0)
    if "not" in node:
        return universe.select("id").distinct().join(tag_query(tags, universe, node["not"]), "id", "left_anti")
    return tag_index(tags, node["key"], node["op"], node.get("value"))


_SEGMENTS = re.compile(r"[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\Z")


def metadata_query(rows: DataFrame, conditions: list[dict], limit: int, meta: str = "meta", updated: str = "updated_at", row_id: str = "id") -> DataFrame:
    """AND of eq and exists on dotted JSON paths, the latest first, then by id, cut to limit. exists holds for a JSON null; eq takes
    scalars only, and null equals a JSON null."""
    test = F.lit(True)
    for c in conditions:
        if not _SEGMENTS.match(c["path"]):
            raise ValueError(f"invalid path {c['path']!r}")
        v = F.try_variant_get(F.col(meta), "$." + c["path"], "variant")
        if c["op"] == "exists":
            test = test & v.isNotNull()
        elif c["op"] == "eq" and not isinstance(c.get("value"), (list, dict)):
            x = c.get("value")
            test = test & (_sure(F.is_variant_null(v)) if x is None else condition(F.col(meta), c["path"], "eq", x))
        else:
            raise ValueError(f"unsupported condition {c!r}")
    return rows.filter(test).orderBy(F.desc(updated), F.col(row_id)).limit(limit)


def pushable(node: dict) -> bool:
    """Whether a metadata index can decide a leaf alone: a scalar eq on a key without dots. All else stays a residual filter."""
    return node.get("op") == "eq" and not isinstance(node.get("value"), (list, dict)) and "." not in node.get("key", ".")


def in_scope(scope: Column, grant: Column) -> Column:
    """Memory access: the purpose is allowed, the owner is the agent, each dimension is equal or granted by `**`, and the sensitivity is
    in the grant."""
    wild = lambda name: (grant[name] == "**") | (grant[name] == scope[name])
    return _sure(F.array_contains(scope["purposes"], grant["purpose"]) & (scope["owner"] == grant["agent"]) & wild("namespace") & wild("entity") & F.array_contains(grant["sensitivities"], scope["sensitivity"]))


# What stored text may not try, after removing all but letters and digits.
AUTHORITY = "ignoreprevious disregardprevious overridesystem overridepolicy bypasspolicy grantpermission elevateprivilege actassystem youarenowthesystem replacesystemprompt".split()
SECRETS = "revealsecret exfiltratesecret printapikey showapikey dumpcredentials sendcredentials revealpassword readenvironmentsecrets".split()
TOOLS = "authorizetool enabletoolwithoutapproval calltoolwithoutapproval executewithoutapproval disableguardrail".split()
SENSITIVE = ("secret", "password", "credential", "api key", "access token")
IMPERATIVE = ("reveal", "print", "send", "upload", "execute", "run")
# end of fixed values


def firewall(text: Column, restricted: Column | None = None, generated: Column | None = None) -> Column:
    """Sorted reason codes for which a text is not admitted to a context. Compatibility forms are not folded (no such built-in)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    compact = F.regexp_replace(low, r"[^\p{L}\p{N}]", "")
    among = lambda where, words: reduce(lambda a, b: a | b, [where.contains(w) for w in words])
    found = {
        "authority_escalation_instruction": among(compact, AUTHORITY),
        "credential_disclosure_instruction": among(compact, SECRETS),
        "destructive_command_payload": (low.contains("curl ") & low.contains("| sh")) | low.contains("rm -rf /"),
        "restricted_sensitive_instruction": F.coalesce(restricted, F.lit(False)) & among(low, SENSITIVE) & among(low, IMPERATIVE) if restricted is not None else F.lit(False),
        "tool_authorization_instruction": among(compact, TOOLS),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))
    if generated is None:
        return reasons
    return F.when(F.coalesce(generated, F.lit(False)) & (F.size(reasons) > 0), F.array_append(reasons, "untrusted_generated_instruction")).otherwise(reasons)


SHA256 = r"^[0-9a-f]{64}$"


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold; a null check doesn't hold."""
    return F.array_compact(F.array(*[F.when(~_sure(c), F.lit(n)) for n, c in checks.items()]))
