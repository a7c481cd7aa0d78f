"""Quality rules as a bitmask ledger: each rule is evaluated once; policies and ablations work on the bits. Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import SPACES

SYMBOLS = "#*$%&|<>"
_GAP = r"[\x20\x09-\x0D]+"

#: name -> failure, over the measurements. A rule's bit is its place here: append only, so that stored ledgers stay readable.
RULES: dict[str, Callable[[], Column]] = {
    "too_few_words": lambda: F.col("n_words") < 50,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbol_heavy": lambda: 10 * F.col("n_symbols") > F.col("word_chars"),
    # a share of lines says little about a text of a few
    "repeated_lines": lambda: (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) & (F.col("n_lines") >= 10),
    "shouting": lambda: 2 * F.col("n_upper") > F.col("word_chars"),
    "exclaiming": lambda: 10 * F.col("n_exclaim") > F.col("word_chars"),
    "long_words": lambda: F.col("word_chars") > 40 * F.col("n_words"),
}
BIT = {name: i for i, name in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


def mask(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


#: Versioned policies: the bits that reject.
POLICIES = {
    "base": mask("too_few_words", "repeated_windows"),
    "v1": mask("too_few_words", "repeated_windows", "symbol_heavy", "exclaiming"),
    "v2": mask(*RULES),
}
CURRENT = "v2"


def _measured(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    pressed = F.btrim(F.col("__text"), F.lit(SPACES))
    words = F.when(pressed == "", F.array().cast("array<string>")).otherwise(F.split(pressed, _GAP))
    without = lambda chars: (F.length("__text") - F.length(F.translate("__text", chars, ""))).cast("long")
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumn("__text", t).withColumns({"__words": words, "__lines": lines})
    w = F.col("__words")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    s = F.col("__sorted")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        twice,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate("__text", SPACES, "")).cast("long"),
            "n_symbols": without(SYMBOLS),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered,
            "n_lines": F.size("__lines").cast("long"),
            "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ"),
            "n_exclaim": without("!"),
        }
    ).drop("__text", "__words", "__lines", "__sorted")


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Row by row, no shuffle: the columns of `carry` (default doc_id), a struct `measures` and the long `fail_bits`.

    Null text: none, all counts 0. Any row gets a result; repeated rows are judged alike and apart. Counts are over whole texts.
    Windows of a text are compared by 64-bit hashes of their three words. Columns that clash with the measurements are safe: only
    `carry` is passed on, as given.
    """
    carry = ["doc_id"] if carry is None else carry
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__carry"), F.col(text).alias("__in"))
    got = _measured(own, "__in")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(rule(), F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()])
    got = got.select("__carry", F.struct(F.struct(*MEASURES).alias("measures"), bits.alias("fail_bits")).alias("told"))
    # Through explode, so that a filter on the ledger isn't pushed below it, where it would compute the measurements anew for each use.
    return got.select("__carry", F.explode(F.array("told")).alias("told")).select("__carry.*", "told.measures", "told.fail_bits")


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledgers: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row a rule of the policy: documents it fails, documents that only it rejects, documents kept. The ledger is first
    counted by its bits (at most 2 ** rules rows, with partial aggregation), so nothing larger is moved."""
    chosen = POLICIES[policy]
    counts = ledgers.groupBy(F.col("fail_bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(name, 1 << b) for name, b in BIT.items() if chosen >> b & 1]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules]))
    return (
        counts.withColumn("r", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
            F.bit_or("bits").alias("seen_bits"),
        )
    )


def keep(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows that pass the policy, with their columns as they were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return ledger(whole, "text", ["row"]).filter(passes(policy)).select("row.*")
