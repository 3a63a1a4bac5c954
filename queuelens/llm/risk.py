"""Quality rules whose cutoffs come with a proven limit on false rejections.

Every rule compares one figure of a text with a cutoff. For each stratum and rule the cutoffs of a fixed list are
tried from lenient to strict against the labelled good documents: a cutoff is certified while the exact binomial
chance of so few rejections, were the true rate as high as the rule's share of the allowed risk, stays below the
error level divided by rules times strata (Bonferroni); the first cutoff that fails ends its list (fixed-sequence
testing needs no further correction). With probability ``1 - error`` every certified cutoff of every stratum keeps
its promise, so no stratum loses more than ``risk`` of its good documents to the rules.

All work is in DataFrame functions. One pass reads the texts; what is learnt is one row of counts per stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import SPACES, label_of, word_array
from queuelens.session import cut_lineage

SYMBOLS = "#*$%&|<>"
#: Figure of a rule and its cutoffs, lenient first; a text whose figure is above the cutoff in force is rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "long_words": (40.0, 30.0, 20.0, 16.0, 13.0, 11.0, 10.0, 9.0),
    "short_words": (0.9, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}
#: Strata up to this number are sent to every task; more are joined by key.
BROADCAST_STRATA = 10_000


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the whole-number counts of each text; null texts count as empty.

    Repeated three-word windows are found by sorting (hash, place) pairs inside the row, so a text of any
    length costs n log n and no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    no_space = F.translate(body, SPACES, "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    first = docs.select(
        *keep, word_array(text).alias("_w"), lines.alias("_lines"),
        F.length(no_space).cast("long").alias("word_chars"),
        (F.length(no_space) - F.length(F.translate(no_space, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(no_space, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    places = F.when(F.size("_w") >= 3, F.sequence(F.lit(1), F.size("_w") - 2)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1)).alias("h"), i.alias("i")))
    figures = ["word_chars", "n_symbols", "n_upper"]
    second = first.select(
        *keep, *figures, F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_sorted"))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_sorted", j)["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    figures += ["n_words", "n_lines", "n_dup_lines"]
    third = second.select(*keep, *figures, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_starts"))
    reach = F.transform("_starts", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_starts", j + 1) - x, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return third.select(*keep, *figures, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def figures() -> dict[str, Column]:
    """The figure of each rule, 0 for texts without words."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "long_words": share("word_chars", "n_words"),
        "short_words": share("n_words", "word_chars"), "upper_share": share("n_upper", "word_chars"),
    }


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, brought back by the product of eight factors."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), or 1 where k >= n * rate (such counts certify nothing).

    Below the mean the terms fall at least geometrically from k downwards, so the sum needs about
    sqrt(n * rate) terms; it stops 40 standard deviations down, where they no longer change a double.
    """
    k, n = k.cast("double"), n.cast("double")
    top = (log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    last = F.greatest(k - F.ceil(40 * F.sqrt(n * rate) + 40), F.lit(0.0))
    steps = F.when(k > last, F.sequence(F.lit(0).cast("long"), (k - last - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    odds = (1 - rate) / rate

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * (k - i) / (n - k + i + 1) * odds
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add, lambda s: s["sum"])
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.exp(top) * total, F.lit(1.0)))


def certified_cutoffs(good: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """One row per stratum with ``cut_<rule>``: the strictest certified cutoff, null where none is."""
    values, rate = figures(), risk / len(RULES)
    tried = [(rule, j, cut) for rule, cuts in RULES.items() for j, cut in enumerate(cuts)]
    counts = good.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum((values[rule] > cut).cast("long")).alias(f"_{rule}_{j}") for rule, j, cut in tried])
    strata = counts.agg(F.count(F.lit(1)).alias("_strata"))
    rows = counts.crossJoin(F.broadcast(strata)).select(stratum, "_n", "_strata", F.explode(F.array(*[  # strata is one row
        F.struct(F.lit(rule).alias("rule"), F.lit(j).alias("j"), F.lit(cut).alias("cut"), F.col(f"_{rule}_{j}").alias("k"))
        for rule, j, cut in tried])).alias("_try")).select(stratum, "_n", "_strata", "_try.*")
    level = F.lit(error / len(RULES)) / F.col("_strata")
    failed = F.when(binomial_tail(F.col("k"), F.col("_n"), rate) > level, F.col("j"))
    tested = rows.select(stratum, "rule", "j", "cut", failed.alias("_failed"))
    ends = tested.groupBy(stratum, "rule").agg(F.min("_failed").alias("_end"), F.collect_list(F.struct("j", "cut")).alias("_cuts"))  # one list of RULES
    before = F.filter("_cuts", lambda x: F.col("_end").isNull() | (x["j"] < F.col("_end")))
    return ends.groupBy(stratum).pivot("rule", list(RULES)).agg(F.first(F.array_max(before)["cut"])).select(
        stratum, *[F.col(rule).alias(f"cut_{rule}") for rule in RULES])


def quality_rules(docs: DataFrame, marks: DataFrame, stratum: str = "lang", risk: float = 0.06, error: float = 0.05,
                  text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of every text, whether it fails the base rules, and the verdict of the certified rules.

    Columns: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_upper.
    ``marks`` holds ``quality`` labels; rows of label 1 form the holdout. Strata are the values of ``stratum``, null
    being one of its own. A stratum with too few good documents for any proof rejects by the base rules only. Rows
    with a null key are counted like others but have no label. An empty table gives an empty result. Other columns
    of the input are not read.
    """
    rows = docs.select(F.col(key), F.col(stratum).alias("_stratum"), F.col(text).alias("_text"))
    counts = cut_lineage(text_counts(rows, [key, "_stratum"], "_text"))
    good = counts.join(label_of(marks, "quality", key).filter("_label = 1"), key, "left_semi").filter(~base_failed())
    cuts = cut_lineage(certified_cutoffs(good, "_stratum", risk, error).withColumnRenamed("_stratum", "_of"))
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    values = figures()
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(values[rule] > F.col(f"cut_{rule}"), F.lit(False))
    joined = counts.join(side, F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    return joined.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "n_lines", "n_upper")
