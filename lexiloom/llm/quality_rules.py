"""Operator 4: a rule bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger holds the measurements and one bit for each rule that failed;
a policy is a named, versioned mask of rules, and any policy is applied, or ablated, on the bits alone.
A null or empty text has no words and fails min_words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rule name to bit; bits are never given to another rule.
RULES = {"min_words": 0, "repeat_words": 1, "word_length": 2, "symbols": 3, "dup_lines": 4, "shouting": 5, "max_words": 6}

#: Policies by version; base is part of each.
POLICIES = {"base": ("min_words", "repeat_words"), "v1": ("min_words", "repeat_words", "word_length", "symbols", "dup_lines"), "v2": ("min_words", "repeat_words", "word_length", "symbols", "dup_lines", "shouting")}


def mask(policy: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[policy])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _fence(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with new columns, each evaluated once: filters above aren't pushed below, which would copy the expressions."""
    names = list(new)
    return df.drop(*names).select("*", F.inline(F.array(F.struct(*[new[c].alias(c) for c in names]))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of the contract."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _fence(docs, {"__w": _words(F.col(text))})
    five = "transform(sequence(0, size(__w) - 5), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2], __w[i + 3], __w[i + 4]))"
    df = _fence(df, {"__h": F.expr(f"if(size(__w) < 6, cast(array() as array<bigint>), {five})"), "__l": lines})
    df = df.withColumn("__twice", F.expr("size(__h) > size(array_distinct(__h))"))
    # positions of windows that occur twice, by sorting (hash, position); then each covers the words up to the next
    pairs = "sort_array(transform(__h, (x, i) -> struct(x as h, i as i)))"
    df = _fence(df, {"__s": F.expr(f"if(__twice, {pairs}, cast(array() as array<struct<h:bigint,i:int>>))")})
    df = _fence(df, {"__p": F.expr("sort_array(transform(filter(__s, (x, j) -> (j > 0 and __s[greatest(j - 1, 0)].h = x.h) or (j < size(__s) - 1 and __s[least(j + 1, size(__s) - 1)].h = x.h)), x -> x.i))")})
    covered = "coalesce(aggregate(transform(__p, (x, j) -> if(j = size(__p) - 1, 5, least(5, __p[least(j + 1, size(__p) - 1)] - x))), 0L, (a, x) -> a + x), 0L)"
    return _fence(
        df,
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.expr(covered),
            "n_lines": F.size("__l").cast("long"),
            "n_upper": F.length(F.regexp_replace(body, r"[^A-Z]+", "")).cast("long"),
        },
    ).drop("__w", "__h", "__l", "__twice", "__s", "__p")


def ledger(docs: DataFrame, text: str = "text", max_words: int = 1_000_000) -> DataFrame:
    """docs with measurements and fail_bits, a bit of RULES for each rule that failed."""
    fails = {
        "min_words": F.col("n_words") < 10,
        "repeat_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "word_length": (F.col("n_words") > 0) & ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "shouting": 2 * F.col("n_upper") > F.col("word_chars"),
        "max_words": F.col("n_words") > max_words,
    }
    bits = sum((F.when(c, 1 << RULES[r]).otherwise(0) for r, c in fails.items()), F.lit(0))
    return measure(docs, text).withColumn("fail_bits", bits.cast("int"))


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with base_failed, kept and policy."""
    return book.withColumns(
        {"base_failed": F.col("fail_bits").bitwiseAND(mask("base")) != 0, "kept": F.col("fail_bits").bitwiseAND(mask(policy) | mask("base")) == 0, "policy": F.lit(policy)}
    )


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: n_failed, n_only (failed by that rule alone) and bits_seen (or of such documents' bits)."""
    book = book.select((F.col("fail_bits").bitwiseAND(mask(policy))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).alias("m")) for r in POLICIES[policy]]))
    return (
        book.select("b", "n", rules.alias("x"))
        .where(F.col("b").bitwiseAND(F.col("x.m")) != 0)
        .groupBy(F.col("x.rule").alias("rule"))
        .agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("b") == F.col("x.m"), F.col("n")).otherwise(0)).alias("n_only"), F.bit_or("b").cast("long").alias("bits_seen"))
    )
