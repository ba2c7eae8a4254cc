"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule rejects documents whose measure is above a cutoff. Labelled good documents that pass the base rule are the
holdout: a cutoff of a fixed grid is certified for a stratum (a language) when the exact binomial tail shows, at a level
that Bonferroni's correction divides over all tested strata, rules and cutoffs, that at most its share of good documents is
rejected. The lowest certified cutoff is used; where none is certified the rule rejects nothing. No stratum borrows the
cutoffs of another: one with too few good labelled documents to be tested certifies nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, checkpointed, discard, table

#: Largest share of good documents of a stratum that all rules together may reject, and the chance that this fails.
RISK, DELTA = 0.05, 0.05
#: Strata with fewer good labelled documents are not tested: hardly a cutoff could be certified, and each test costs the others.
LEAST_IN_STRATUM = 500
#: rule: (measure, grid of cutoffs, ascending)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5, 3.0]),
    "shouting": ("n_exclaims / n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]),
    "capitals": ("n_capitals / word_chars", [0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9]),
    "repeats": ("n_repeat_words / n_words", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]),
    "same lines": ("n_dup_lines / n_lines", [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "long words": ("word_chars / n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 16.0, 24.0]),
}
#: Terms of a binomial tail that are added one by one; what lies beyond is bounded by a geometric series.
TAIL_TERMS = 20_000


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides.

    Only docs' text is read, and a null text is empty. Columns of docs must have other names than those added: callers keep
    whole rows in a struct.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__w", F.array_remove(F.split(text, SPACES), ""))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    windows = F.slice(F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2))), 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))
    # Unequal hashes prove that no window comes twice; only other texts are sorted.
    twice = (F.col("n_words") > 3) & (F.size(F.array_distinct(windows)) < F.col("n_words") - 2)
    spelled = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.struct(F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("s"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(twice, F.sort_array(spelled)))
    same = lambda t, j: F.coalesce(t["s"] == F.get("__sorted", j)["s"], F.lit(False))
    at = F.transform(F.filter("__sorted", lambda t, j: same(t, j - 1) | same(t, j + 1)), lambda t: t["i"])
    df = df.withColumn("__at", F.sort_array(at))
    covered = F.aggregate(F.transform("__at", lambda p, j: F.coalesce(F.least(F.lit(3), F.get("__at", j + 1) - p), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_exclaims": F.regexp_count(text, F.lit("!")).cast("long"),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("__w", "__lines", "__sorted", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(rule: str) -> Column:
    above, below = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below).cast("double")), F.lit(0.0))


def log_factorial(x: Column) -> Column:
    """ln x!: a sum of logarithms below 32, Stirling's series from there (error below 1e-12)."""
    x = x.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(32), x.cast("int")))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    y = F.greatest(x, F.lit(32.0))
    series = y * F.ln(y) - y + 0.5 * F.ln(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(x < 32, small).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(at most k of n) where each has the chance p; 1 where k is above n * p, which no level certifies."""
    at_k = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc, j):
        i = (k - j).cast("double")
        t = acc["t"] * i / (n.cast("double") - i + 1) * odds
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    added = F.aggregate(F.sequence(F.lit(0), F.least(k, F.lit(TAIL_TERMS)).cast("int") - 1), start, step)
    i = (k - TAIL_TERMS).cast("double")
    ratio = F.greatest(F.lit(0.0), i / (n.cast("double") - i + 1) * odds)
    rest = F.when(i > 0, added["t"] * ratio / (1 - ratio)).otherwise(0.0)
    tail = F.exp(at_k) * F.when(k == 0, F.lit(1.0)).otherwise(added["s"] + rest)
    return F.when(k <= n * p, F.least(tail, F.lit(1.0))).otherwise(1.0)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff of each rule or null) of every stratum with a certified cutoff.

    measured has features, doc_id and lang; labels doc_id and quality. All labelled rows count; a document is good when no
    label of it says otherwise. Every language with LEAST_IN_STRATUM good documents is tested, and so are the documents
    without a language together, whose stratum is null.
    """
    good = labels.where("doc_id is not null").groupBy(labels["doc_id"].cast("long").alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1")
    held = measured.where(~base_failed()).join(good, measured["doc_id"] == good["__id"], "left_semi")
    tests = [(rule, c) for rule, (_, grid) in RULES.items() for c in grid]
    hits = (F.sum(F.when(measure(rule) > c, 1).otherwise(0)).alias(f"k{i}") for i, (rule, c) in enumerate(tests))
    counted = checkpointed(held.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"), *hits).where(F.col("n") >= LEAST_IN_STRATUM))
    level = delta / (max(1, counted.count()) * len(tests))
    rows = counted.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (rule, c) in enumerate(tests)))).alias("x")).select("stratum", "n", "x.*")
    certified = rows.where(binomial_tail(F.col("n"), F.col("k"), risk / len(RULES)) <= level)
    found = checkpointed(certified.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"__c{i}") for i, rule in enumerate(RULES))))
    discard(counted)
    return found


def with_cutoffs(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with the cutoffs of its lang, null where it has none."""
    return df.join(found.withColumnRenamed("stratum", "__stratum"), df["lang"].eqNullSafe(F.col("__stratum")), "left")


def rejected() -> Column:
    """Whether some rule's certified cutoff for the document's stratum is exceeded."""
    out = F.lit(False)
    for i, rule in enumerate(RULES):
        out = out | F.coalesce(measure(rule) > F.col(f"__c{i}"), F.lit(False))
    return out


def input_columns(docs: DataFrame) -> DataFrame:
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), lang.alias("lang"), docs["text"].cast("string").alias("text"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, the features, base_failed and kept for every row of docs.

    Null texts are empty and fail the base; rows with a null lang are a stratum of their own; rows with a null doc_id are
    judged but never labelled; repeated rows are judged alike; without labels no rule is certified and the base decides.
    """
    measured = checkpointed(features(input_columns(docs)).drop("text"))
    got = with_cutoffs(measured, cutoffs(measured, labels)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected())
    return got.select(*measured.columns, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that judge() keeps."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = docs.select(F.struct("*").alias("__row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), lang.alias("lang"))
    # Rows are kept with their features, which cost more than to write a row. Texts lie in the row alone.
    measured = checkpointed(features(whole).drop("text"))
    return with_cutoffs(measured, cutoffs(measured, labels)).where(~base_failed() & ~rejected()).select("__row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
