"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a document whose ratio is beyond a cutoff. Cutoffs come from a
grid fixed beforehand. On a labelled holdout, per stratum, each (rule, cutoff)
is tested with the exact binomial distribution: it is certified if a true false
rejection rate above the limit would give so few false rejections with a
probability of at most the level, Bonferroni-corrected for all strata, rules and
cutoffs. Of the certified cutoffs of a rule, the one with the largest surplus of
labelled bad documents over good ones is used; ties go to the more lenient, and
a rule without a surplus is not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import bind, cut, small, words

SYMBOLS = "#*$%&|<>"
#: Most good documents that the rules together may reject, as a share, in any stratum.
RISK = 0.05
#: Probability that the guarantee fails anywhere.
LEVEL = 0.05
#: Cutoffs of each ratio, lenient to strict; a document beyond a cutoff is rejected.
GRID: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.5, 0.2, 0.1),
    "dup_line_share": (0.9, 0.7, 0.5, 0.3, 0.2),
    "repeat_share": (0.18, 0.15, 0.12, 0.1, 0.08),
    "marks_per_word": (2.0, 1.0, 0.5, 0.3, 0.2),
    "upper_share": (0.9, 0.7, 0.5, 0.4, 0.3),
    "long_words": (40.0, 25.0, 18.0, 15.0, 12.0),
    "short_words": (-1.2, -1.6, -2.0, -2.4, -2.8),
}


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeated(w: Column) -> Column:
    """Words of w in windows of five found twice or more, first ones included."""

    def covered(p: Column) -> Column:
        gap = lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))
        return F.aggregate(F.transform(p, gap), F.lit(0), lambda s, x: s + x)

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return bind(F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])), covered)

    def windows(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed, twice))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    return F.when(F.size(w) < 6, F.lit(0)).otherwise(bind(hashes, windows))


def features(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the columns kept, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, text_hash, base_failed.

    Null and empty texts have zeros everywhere and fail the base rule.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, " \t\x0b\x0c\r")) > 0)
    line_sizes = bind(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own")))
    less = lambda characters: (F.octet_length(text) - F.octet_length(_without(text, characters))).cast("long")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long")
    df = docs.select("doc_id", *kept, bind(words(text), measured).alias("w"), line_sizes.alias("l"), less(SYMBOLS).alias("n_symbols"), less("!").alias("n_marks"), upper.alias("n_upper"), F.xxhash64("text").alias("text_hash"))
    df = df.select("doc_id", *kept, "w.*", "n_symbols", (F.col("l.all") - F.col("l.own")).cast("long").alias("n_dup_lines"), F.col("l.all").cast("long").alias("n_lines"), "n_upper", "n_marks", "text_hash")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ratios() -> dict[str, Column]:
    """What the rules look at, for documents that pass the base rule."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "marks_per_word": F.col("n_marks") / n,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "long_words": F.col("word_chars") / n,
        "short_words": -F.col("word_chars") / n,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly term by term in logs; 1 where k >= n p."""
    step = math.log(p / (1 - p))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(step)
        high = F.greatest(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(s["sum"] - high) + F.exp(term - high))).alias("sum"))

    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    tail = F.exp(F.aggregate(terms, start, add, lambda s: s["sum"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(tail)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_false, n_caught, p_value: the certified choice of each rule.

    measured: features() with a column stratum. labels: doc_id, quality (1 good,
    0 bad); nulls are left out, and so are documents labelled both ways. Copies
    of a text in one stratum are one trial, a bad one if any copy is labelled so:
    the binomial bounds are for independent trials.
    """
    agreed = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    agreed = agreed.filter("low = high").select("doc_id", F.col("low").alias("label"))
    held = measured.filter(~F.col("base_failed")).join(agreed, "doc_id")
    looked = F.first(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"))
    held = held.groupBy(stratum, "text_hash").agg(F.min("label").alias("label"), looked.alias("m")).select(stratum, "label", "m.*")
    looks = ratios()
    rules = [(r, j, c) for r, cs in GRID.items() for j, c in enumerate(cs)]
    hit = lambda r, c, label: F.sum(((looks[r] > c) & (F.col("label") == label)).cast("long"))
    sums = [F.struct(F.lit(r).alias("rule"), F.lit(j).alias("rank"), F.lit(c).alias("cutoff"), hit(r, c, 1).alias("n_false"), hit(r, c, 0).alias("n_caught")) for r, j, c in rules]
    counted = held.groupBy(F.col(stratum).alias("stratum")).agg(F.sum(F.col("label").cast("long")).alias("n_good"), *[s.alias(f"t{i}") for i, s in enumerate(sums)])
    counted = cut(counted, "quality-counts")
    tests = counted.count() * len(rules)
    flat = counted.select("stratum", "n_good", F.inline(F.array(*[F.col(f"t{i}") for i in range(len(sums))])))
    flat = flat.withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), risk / len(GRID)))
    sure = flat.filter((F.col("p_value") <= F.lit(level / max(tests, 1))) & (F.col("n_caught") > F.col("n_false")))
    best = sure.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n_good", "n_false", "n_caught", "p_value"), F.struct(F.col("n_caught") - F.col("n_false"), -F.col("rank"))).alias("b"))
    return best.select("stratum", "rule", "b.*")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: features, base_failed, kept, and failed_rules (names, null if none).

    The stratum is a column of docs; null is a stratum of its own. A stratum
    with too few labelled good documents for any guarantee gets no cutoff: the
    base rule alone decides there. Repeated rows are judged alike, each. kept:
    more columns of docs to return.
    """
    # Only labels decide cutoffs; all documents are measured once, in a narrow table.
    measured = cut(features(docs, stratum, *kept), "quality-features")
    chosen = cutoffs(measured, labels, stratum, risk, level)
    wide = cut(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in GRID]), "quality-cutoffs")
    joined = measured.join(small(wide, 200), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    looks = ratios()
    failed = F.filter(F.array(*[F.when(looks[r] > F.col(f"_{r}"), F.lit(r)) for r in GRID]), lambda x: x.isNotNull())
    joined = joined.withColumn("failed_rules", F.nullif(F.array_join(failed, ","), F.lit("")))
    passed = ~F.col("base_failed") & F.col("failed_rules").isNull()
    return joined.withColumn("kept", passed).drop("stratum", *[f"_{r}" for r in GRID])
