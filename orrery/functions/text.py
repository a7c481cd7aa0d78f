"""Text functions as Spark expressions: identifier-aware tokens, token estimates, context headers, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_+#:-]+"
#: Case and digit boundaries, marked by a space one after another. No lookaround, so that RE2 reads them as well.
BOUNDARIES = (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{N})([^\p{N} ])", r"([^\p{N} ])(\p{N})")


def subterms(raw: Column) -> Column:
    """Lower-cased parts of an identifier, without the whole token itself."""
    spaced = raw
    for b in BOUNDARIES:
        spaced = F.regexp_replace(spaced, b, "$1 $2")
    parts = F.transform(F.split(F.regexp_replace(spaced, "[_+#: -]+", " "), " "), F.lower)
    return F.filter(parts, lambda p: (p != "") & (p != F.lower(raw)))


def tokens(text: Column) -> Column:
    """Tokens of a text in order, each followed by its subterms. Null text: no tokens. Words of letters with at most a capital first
    have no subterms and skip the splitting."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit(":")))
    kept = F.filter(raw, lambda t: t.rlike(r"[\p{L}\p{N}]"))
    plain = lambda t: t.rlike(r"^\p{L}\p{Ll}*$")
    return F.flatten(F.transform(kept, lambda t: F.when(plain(t), F.array(F.lower(t))).otherwise(F.concat(F.array(F.lower(t)), subterms(t)))))


def plain_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, at most 256 bytes each: the ledger's tokenizer."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(F.filter(found, lambda t: F.octet_length(t) <= 256), F.lower)


def estimate_tokens(text: Column) -> Column:
    """Conservative token count: a run of ASCII non-space characters costs a quarter of its length, rounded up; a character beyond
    ASCII costs two and ends the run. Null: 0."""
    t = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(t, F.lit(r"[\x00-\x08\x0B\x0E-\x1F\x21-\x7F]+"), F.lit(0))
    inside = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.ceil(F.length(r) / 4))
    return inside + 2 * F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))


def contextualize(chunk: Column, title: Column, headings: Column) -> Column:
    """`title > heading > ...:` LF chunk, blank parts skipped; the chunk alone if all are blank."""
    parts = F.filter(F.transform(F.concat(F.array(title), F.coalesce(headings, F.array().cast("array<string>"))), lambda p: F.btrim(p)), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when(F.size(parts) == 0, chunk).otherwise(F.concat(F.array_join(parts, " > "), F.lit(":\n"), chunk))


def render(text: Column, uri: Column, version: Column, start: Column, end: Column, style: str = "compact") -> Column:
    """A packed text with its citation: none (compact), a marker before (inline), or a source line after (full)."""
    if style == "compact":
        return text
    place = F.concat(uri, F.when(version.isNotNull(), F.concat(F.lit("@"), version)).otherwise(""), F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("#"), start.cast("string"), F.lit(":"), end.cast("string"))).otherwise(""))
    if style == "inline":
        return F.concat(F.lit("["), place, F.lit("] "), text)
    if style == "full":
        return F.concat(text, F.lit("\n— source: "), place)
    raise ValueError(f"unknown style {style!r}")


# The same in DuckDB, for oracles.


def sql_subterms(raw: str) -> str:
    s = raw
    for b in BOUNDARIES:
        s = rf"regexp_replace({s}, '{b}', '\1 \2', 'g')"
    return f"list_filter(list_transform(string_split(regexp_replace({s}, '[_+#: -]+', ' ', 'g'), ' '), lambda p: lower(p)), lambda p: p <> '' AND p <> lower({raw}))"


def sql_tokens(text: str) -> str:
    kept = rf"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '{TOKEN}'), lambda t: trim(t, ':')), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))"
    return f"flatten(list_transform({kept}, lambda t: list_concat([lower(t)], {sql_subterms('t')})))"


def sql_estimate(text: str) -> str:
    runs = rf"regexp_extract_all(coalesce({text}, ''), '[\x00-\x08\x0B\x0E-\x1F\x21-\x7F]+')"
    return f"(coalesce(list_sum(list_transform({runs}, lambda r: (length(r) + 3) // 4)), 0)::BIGINT + 2 * length(regexp_replace(coalesce({text}, ''), '[\\x00-\\x7F]', '', 'g')))"
