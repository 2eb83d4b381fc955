"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0). How often a
rule votes each way on good and on bad texts is estimated without labels, from the counts of vote
patterns over all documents (Dawid and Skene's model; at most 3**rules patterns reach the driver,
however many documents there are). A document stays if the posterior probability that it is good is
at least ``threshold`` and it passes the base rules.

Only DataFrame functions: no Python runs on the executors.

Defined results: NULL and empty texts have no words, fail the base rules and are dropped; repeated
rows are judged each; an empty table gives an empty table (the rules keep their starting accuracies).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.session import materialize

#: Votes: measure, votes good within, votes bad outside; between the two ranges the rule abstains.
RULES = {
    "symbols": ((0, 0.01), (0, 0.05)),  # of characters in words
    "capitals": ((0, 0.15), (0, 0.35)),  # of characters in words
    "word_length": ((3.5, 8.5), (2.5, 12)),  # mean
    "bare_words": ((0, 0.1), (0, 0.25)),  # words without a letter
    "repeated_lines": ((0, 0.2), (0, 0.5)),  # of lines with a word
    "repeated_words": ((0, 0.25), (0, 0.5)),  # of words
    "exclamations": ((0, 0.05), (0, 0.3)),  # ends of sentences that shout, by words
}
MIN_WORDS = 50
PRIOR_GOOD = 0.85
SPACE = r"[\\x20\\x09-\\x0D]"


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every text, without the text."""
    # A window of three words is its 64-bit hash and start; sorted, repeats are neighbours. The words that
    # they cover follow from the starts in order: each covers up to three words, or up to the next start.
    windows = """if(n_words < 3, array(), transform(sequence(1L, n_words - 2L), i -> struct(
        xxhash64(words[int(i) - 1], words[int(i)], words[int(i) + 1]) AS h, i AS i)))"""
    repeats = "filter(sorted, (x, k) -> (k > 0 AND sorted[k - 1].h = x.h) OR (k + 1 < size(sorted) AND sorted[k + 1].h = x.h))"
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", "text", F.expr(f"filter(split(text, '{SPACE}+'), w -> w <> '')").alias("words"))
        .selectExpr(
            "doc_id",
            "words",
            "size(words)::long AS n_words",
            f"length(regexp_replace(text, '{SPACE}+', ''))::long AS word_chars",
            "length(regexp_replace(text, '[^#*$%&|<>]+', ''))::long AS n_symbols",
            "length(regexp_replace(text, '[^A-Z]+', ''))::long AS n_capitals",
            "length(regexp_replace(text, '[^!]+', ''))::long AS n_exclamations",
            f"filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines",
        )
        .selectExpr(
            "*",
            "size(filter(words, w -> NOT w rlike '\\\\p{L}'))::long AS n_bare",
            "size(lines)::long AS n_lines",
            "(size(lines) - size(array_distinct(lines)))::long AS n_dup_lines",
            f"sort_array({windows}) AS sorted",
        )
        .drop("words", "lines")
        .withColumn("starts", F.expr(f"sort_array(transform({repeats}, x -> x.i))"))
        .drop("sorted")
        .selectExpr("* EXCEPT (starts)", "aggregate(transform(starts, (s, k) -> if(k + 1 < size(starts), least(3L, starts[k + 1] - s), 3L)), 0L, (a, x) -> a + x) AS n_repeat_words")
    )


def ratios() -> dict[str, Column]:
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols": F.col("n_symbols") / chars,
        "capitals": F.col("n_capitals") / chars,
        "word_length": F.col("word_chars") / words,
        "bare_words": F.col("n_bare") / words,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "exclamations": F.col("n_exclamations") / words,
    }


def votes(rules: dict = RULES) -> dict[str, Column]:
    out = {}
    for name, value in ratios().items():
        if name in rules:
            good, bad = rules[name]
            out[name] = F.when(F.col("n_words") == 0, 0).when(value.between(*good), 1).when(~value.between(*bad), -1).otherwise(0)
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Share of good texts, and each rule's accuracies: how often, when it does not abstain, it votes
    good on good texts and bad on bad ones.

    ``patterns`` are votes with their counts. Some imagined votes keep accuracies off 0 and 1; since a
    rule may not be worse than ``least`` on good texts, the two classes cannot swap.
    """
    least, (right, wrong) = 0.99, (0.998, 0.002)
    prior, rates = PRIOR_GOOD, [(right, 0.25)] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [posterior(p, prior, rates) for p, _ in patterns]
        before = prior
        prior = min(0.999, max(0.5, (sum(g * n for g, (_, n) in zip(good, patterns, strict=True)) + PRIOR_GOOD * 10) / (total + 10)))
        for j in range(n_rules):
            voted = [(g, p[j], n) for g, (p, n) in zip(good, patterns, strict=True) if p[j]]
            on_good = [sum(g * n for g, v, n in voted if v == x) for x in (1, -1)]
            on_bad = [sum((1 - g) * n for g, v, n in voted if v == x) for x in (1, -1)]
            a = (on_good[0] + 100 * right) / (sum(on_good) + 100 * (right + wrong))
            b = (on_bad[1] + 4) / (sum(on_bad) + 10)
            rates[j] = (min(0.9999, max(least, a)), min(0.999, max(2 * (1 - a), b)))
        if abs(before - prior) < 1e-9:
            break
    return prior, rates


def log_odds(vote: int, rate: tuple[float, float]) -> float:
    good, bad = rate
    return math.log(good / (1 - bad)) if vote == 1 else math.log((1 - good) / bad) if vote == -1 else 0.0


def posterior(pattern: tuple[int, ...], prior: float, rates: list) -> float:
    z = math.log(prior / (1 - prior)) + sum(log_odds(v, r) for v, r in zip(pattern, rates, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def judge(docs: DataFrame, threshold: float = 0.5, rules: dict = RULES) -> DataFrame:
    """One row for each document: base counts, votes, posterior and verdict."""
    ballot = votes(rules)
    voted = materialize(measures(docs).select("*", *(v.alias(f"vote_{k}") for k, v in ballot.items())))
    names = [f"vote_{k}" for k in ballot]
    counted = voted.where("n_words > 0").groupBy(*names).count().collect()  # at most 3**len(rules) rows
    prior, rates = fit([(tuple(r[:-1]), r[-1]) for r in sorted(counted)], len(names))
    z = F.lit(math.log(prior / (1 - prior)))
    for name, r in zip(names, rates, strict=True):
        z = z + F.when(F.col(name) == 1, log_odds(1, r)).when(F.col(name) == -1, log_odds(-1, r)).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("p_good", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good", *names,
    )
