"""Operator 2: quality rules as weak supervision.  DataFrame functions only, no shuffle of texts.

Each rule looks at figures of one document and votes good (1), bad (-1) or abstains (0).  Votes are counted by
pattern, of which there are at most 3**rules however large the corpus is; expectation-maximisation over the
pattern counts, from a soft majority vote on, estimates how each rule, when it votes, does on good and on bad documents
(its accuracy) and how common good ones are; a document is kept if its posterior probability of being good is a half or
more.  Nothing but the counts decides how far a rule is trusted: one that often votes bad on good documents loses its say.

Defined results: null and empty texts have no words and fail the base rule; very long texts are counted whole;
repeated rows get equal results; an empty table gives an empty table; other columns are not looked at, and
filter_quality keeps all of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, materialize

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
ROUNDS = 100
SMOOTHING = 1.0
#: Words at which a text's share of different words is asked to be less by the root of two.
LONG = 5000
SYMBOLS = r"[#*$%&|<>]"
#: Frequent short words of English, French, German and Spanish, as they stand in running text.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "was", "for", "on", "with", "as", "it", "are", "an",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "dans", "pour", "qui", "au", "ou",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "ein", "eine", "nicht", "auf", "für",
    "el", "los", "y", "del", "se", "las", "por", "con", "una", "su", "al", "es", "para", "lo", "como",
)
PLAIN_WORD = r"^\p{L}+[.,;:!?]?$"


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with a struct column `q` of figures of each text.  Its own working columns begin with
    two underscores; filter_quality() wraps rows, so that no column of theirs can clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = df.withColumn("__w", F.array_remove(F.split(text, SPACE + "+"), ""))
    # hashes of the windows; the sorted copy tells at once whether any window is repeated
    windows = F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(WINDOW))))
    staged = staged.withColumn("__h", F.when(F.size("__w") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    staged = staged.withColumn("__d", F.size("__h") != F.size(F.array_distinct("__h")))
    # only then: places by hash, those beside an equal hash, in order; each covers up to the next or a window's width
    placed = F.when(F.col("__d"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    staged = staged.withColumn("__s", placed)
    twice = F.filter("__s", lambda x, k: (x["h"] == F.get("__s", k - 1)["h"]) | (x["h"] == F.get("__s", k + 1)["h"]))
    staged = staged.withColumn("__p", F.when(F.col("__d"), F.sort_array(F.transform(twice, lambda x: x["i"]))).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = staged.withColumn("__l", lines)
    letters = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    figures = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length(text) - letters(SYMBOLS + "+")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__d"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        (F.length(text) - letters(r"[A-Z\x{C0}-\x{DE}]+")).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        (F.length(text) - letters(r"\p{L}+")).cast("long").alias("n_letters"),
        F.size(F.filter("__w", lambda w: w.rlike(PLAIN_WORD))).cast("long").alias("n_plain"),
        F.size(F.filter("__w", lambda w: w.isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
    )
    return staged.withColumn("q", figures).drop("__w", "__h", "__d", "__s", "__p", "__l")


def base_failed() -> Column:
    return (F.col("q.n_words") < LEAST_WORDS) | (100 * F.col("q.n_repeat_words") > MOST_REPEATED * F.col("q.n_words"))


def votes() -> dict[str, Column]:
    """The rules.  Each gives 1, -1 or 0 and reads only the figures."""
    q = lambda c: F.col(f"q.{c}")
    share = lambda a, b: q(a) / F.greatest(q(b), F.lit(1))
    rule = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    mean = share("word_chars", "n_words")
    variety = share("n_distinct", "n_words") * F.sqrt(1 + q("n_words") / LONG)
    return {
        "length": rule(q("n_words") >= 40, q("n_words") < LEAST_WORDS),
        "word_length": rule((mean >= 3.5) & (mean <= 9), (mean < 2.2) | (mean > 14)),
        "symbols": rule(share("n_symbols", "n_words") < 0.02, share("n_symbols", "n_words") > 0.25),
        "letters": rule(share("n_letters", "word_chars") > 0.93, share("n_letters", "word_chars") < 0.88),
        "plain_words": rule(share("n_plain", "n_words") > 0.9, share("n_plain", "n_words") < 0.75),
        "function_words": rule(share("n_function", "n_words") > 0.08, (share("n_function", "n_words") < 0.03) & (q("n_words") >= 40)),
        "lines": rule((share("n_dup_lines", "n_lines") == 0) & (q("n_lines") >= 3), share("n_dup_lines", "n_lines") > 0.3),
        "variety": rule((variety > 0.4) & (q("n_words") >= 20), variety < 0.15),
        "capitals": rule(share("n_upper", "word_chars") < 0.08, share("n_upper", "word_chars") > 0.4),
        "shouts": rule(share("n_shouts", "n_words") < 0.01, share("n_shouts", "n_words") > 0.5),
    }


def estimate(patterns: DataFrame, rules: list[str]) -> dict:
    """Expectation-maximisation over (vote columns, n).  The driver sees only sums: 2 + 4 * rules numbers a round.

    Whether a rule votes at all says nothing; what it votes when it does has a rate in each class (one vote of each
    kind is added, so no rate is 0).  The first round's posterior is the share of good votes, so the class that most votes
    call good is the good one.
    """
    count = lambda v: reduce(lambda a, r: a + F.when(F.col(r) == v, 1).otherwise(0), rules, F.lit(1))
    p, model = count(1) / (count(1) + count(-1)), {"prior": 0.5, "rates": {r: {1: (0.5, 0.5), -1: (0.5, 0.5)} for r in rules}}
    smooth = lambda a, b: (a + SMOOTHING) / (a + b + 2 * SMOOTHING)
    for _ in range(ROUNDS):
        good, all_n = F.sum(p * F.col("n")), F.sum("n")
        each = [F.sum(F.when(F.col(r) == v, p * F.col("n")).otherwise(0.0)).alias(f"{r}{v}") for r in rules for v in (1, -1)]
        whole = [F.sum(F.when(F.col(r) == v, F.col("n")).otherwise(0)).alias(f"{r}{v}n") for r in rules for v in (1, -1)]
        s = patterns.agg(good.alias("good"), all_n.alias("n"), *each, *whole).head().asDict()
        if not s["n"]:
            break
        s = {k: float(v) for k, v in s.items()}
        prior, rates = min(1 - 1e-6, max(1e-6, s["good"] / s["n"])), {}
        for r in rules:
            good = {v: s[f"{r}{v}"] for v in (1, -1)}
            bad = {v: s[f"{r}{v}n"] - good[v] for v in (1, -1)}
            rates[r] = {v: (smooth(good[v], good[-v]), smooth(bad[v], bad[-v])) for v in (1, -1)}
        settled = abs(model["prior"] - prior) < 1e-6
        model = {"prior": prior, "rates": rates}
        if settled:
            break
        p = posterior(rules, model)
    return model


def posterior(rules: list[str], model: dict) -> Column:
    """Probability of being good, from the vote columns."""
    logit = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r in rules:
        gain = {v: math.log(good / bad) for v, (good, bad) in model["rates"][r].items()}
        logit = logit + F.when(F.col(r) == 1, gain[1]).when(F.col(r) == -1, gain[-1]).otherwise(0.0)
    return F.round(1 / (1 + F.exp(-logit)), 12)


def supervise(figures: DataFrame) -> tuple[DataFrame, dict]:
    """figures (with q) plus vote columns, base_failed, quality and kept; and the fitted model.  figures is written
    first, since a filter on what comes out would otherwise work out each figure many times over."""
    figures = materialize(figures, "quality")
    named = {f"vote_{k}": v for k, v in votes().items()}
    rules = list(named)
    voted = figures.withColumns(named)
    patterns = materialize(voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model = estimate(patterns, rules)
    out = voted.withColumn("base_failed", base_failed()).withColumn("quality", posterior(rules, model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)), model


def filter_quality(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, all columns as they were; columns of clashing names ride in a struct."""
    wrapped = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc"), F.col(text_col).alias("text"))
    kept, _ = supervise(measured(wrapped).drop("text"))
    return kept.filter("kept").select("doc.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: figures and verdict of every document."""
    narrow = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = supervise(measured(narrow).drop("text"))
    rules = [F.col(f"vote_{k}").alias(f"vote_{k}") for k in votes()]
    return out.select("doc_id", *(F.col(f"q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "quality", *rules)


def accuracies(model: dict) -> dict[str, float]:
    """Estimated share of a rule's votes that are right."""
    g, out = model["prior"], {}
    for r, by in model["rates"].items():
        right = g * by[1][0] + (1 - g) * by[-1][1]
        out[r] = right / reduce(lambda a, v: a + g * by[v][0] + (1 - g) * by[v][1], (1, -1), 0.0)
    return out
