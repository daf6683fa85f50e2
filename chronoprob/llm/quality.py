"""Quality rules with risk-controlled cutoffs.

Every document gets a few ratios (symbols, capitals, repeated windows and so on). A rule rejects the
documents whose ratio is at least its cutoff. Labelled documents choose the cutoffs: half of them
propose, the other half certify. In each stratum (language) the first half proposes at most one cutoff for
each rule and puts the rules in order of worth. The second half tests the rules as they add up: the exact
binomial test asks whether the first rule, then the first two together, and so on, reject at most ``risk``
of the good holdout documents, at level ``alpha`` shared by Bonferroni among the strata. Testing stops at the
first union that fails (fixed-sequence testing), and the rules before it are used. So with probability
1 - alpha, in every stratum the verdict of all rules together rejects at most ``risk`` of the good documents
that pass the base rule.

All work is DataFrame operations; the tables of counts have a row for each stratum, rule and candidate.

Defined cases: a null text has no words and fails the base rule; documents of a stratum without enough
labels are judged by the base rule alone; labels with a null document or value are left out, and of
contradicting labels for one document the good one counts; repeated rows are judged alike; an empty
table gives an empty result. Windows of words are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, free_name, words

WINDOW = 8
#: Rules: the ratio that each of them bounds.
RULES = ("symbol_ratio", "capital_ratio", "shout_ratio", "stutter_ratio", "repeat_ratio", "line_ratio")
#: Candidate cutoffs, strictest first.
CANDIDATES = tuple(round(1 - 0.02 * i, 2) for i in range(50))


@dataclass(frozen=True)
class Risk:
    risk: float = 0.05
    alpha: float = 0.05
    #: A cutoff is proposed only where so large a share of what it rejects is labelled bad.
    purity: float = 0.9
    #: Of such cutoffs the one with the largest (bad - price * good) rejected is proposed, the strictest of equals.
    price: float = 4.0
    stratum: str = "lang"


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of the base rules and the ratios of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*[F.col(c) for c in keep], text.alias("_text"))
    df = df.withColumn("_words", words(F.col("_text")))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(rf"[^{SPACE_CLASS}]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.element_at(F.col("_h"), i + k) for k in range(WINDOW)])
    df = df.withColumn("_win", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), window)).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size("_win") > F.size(F.array_distinct("_win"))
    pairs = F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_pairs", F.when(repeated, pairs))
    last = F.size("_pairs") - 1
    twice = F.filter("_pairs", lambda x, i: ((i > 0) & (x["h"] == F.get("_pairs", i - 1)["h"])) | ((i < last) & (x["h"] == F.get("_pairs", i + 1)["h"])))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("_n_lines", F.size("_lines")).withColumn("_caps", F.regexp_count("_text", F.lit(r"\p{Lu}{2,}"))).withColumn("_shouts", F.regexp_count("_text", F.lit("!")))
    df = df.withColumn("_stutters", F.size(F.filter("_h", lambda x, i: (i > 0) & (x == F.get("_h", i - 1)))))
    of_words = lambda c: F.least(F.lit(1.0), F.col(c) / F.greatest("n_words", F.lit(1)))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        of_words("n_symbols").alias("symbol_ratio"), of_words("_caps").alias("capital_ratio"), of_words("_shouts").alias("shout_ratio"), of_words("_stutters").alias("stutter_ratio"), of_words("n_repeat_words").alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("line_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    """log n!, as a sum up to 20 and by Stirling's series, there exact to the last digits, beyond."""
    x = F.greatest(n, F.lit(21)).cast("double")
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.array(*[F.lit(math.log(math.factorial(i))) for i in range(21)])
    return F.when(n <= 20, F.get(small, F.least(n, F.lit(20)).cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) for success probability ``p``.

    From the term of ``k`` downward each is a smaller part of the one before it. More than a few standard
    deviations further down terms no longer count, so their number grows with the square root of n p. A
    ``k`` of n p or more, where the tail is a half or more, gets 1."""
    last = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p))
    n_terms = F.least(k, F.ceil(F.sqrt(n * p) * 12) + 40).cast("long")

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * ((k - i + 1) * (1 - p)) / ((n - k + i) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    terms = F.when(n_terms > 0, F.sequence(F.lit(1).cast("long"), n_terms)).otherwise(F.array().cast("array<bigint>"))
    summed = F.aggregate(terms, F.struct(last.alias("term"), last.alias("sum")), step, lambda acc: acc["sum"])
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), summed))


def proposed_cutoffs(known: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff, place): for each rule the best cutoff of those pure enough, in order of worth.

    ``known`` has stratum, good and the ratios."""
    ratios = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("ratio")) for r in RULES]))
    long = known.select("stratum", "good", ratios.alias("r")).select("stratum", "good", "r.*")
    # a ratio counts for every candidate at or below it: counts by the first such candidate, then a running sum
    step = F.ceil((1.0 - F.col("ratio")) / 0.02 - 1e-9).cast("int")
    counts = long.groupBy("stratum", "rule", step.alias("step")).agg(F.count(F.when(F.col("good") == 1, 1)).alias("good"), F.count(F.when(F.col("good") == 0, 1)).alias("bad"))
    lists = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("step", "good", "bad")).alias("c"))  # 51 steps at most
    total = lambda upto, f: F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when(x["step"] <= upto, x[f]).otherwise(0))
    grid = lists.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(CANDIDATES) - 1))))
    grid = grid.select("stratum", "rule", "step", total(F.col("step"), "good").alias("good"), total(F.col("step"), "bad").alias("bad"))
    pure = grid.where((F.col("bad") > 0) & (F.col("bad") >= F.lit(risk.purity) * (F.col("bad") + F.col("good"))))
    worth = F.col("bad") - F.lit(risk.price) * F.col("good")
    best = pure.groupBy("stratum", "rule").agg(F.max(F.struct(worth.alias("worth"), (-F.col("step")).alias("first"))).alias("b"))
    cutoffs = best.select("stratum", "rule", (1.0 + 0.02 * F.col("b.first")).alias("cutoff"), F.col("b.worth").alias("worth"))
    order = Window.partitionBy("stratum").orderBy(F.col("worth").desc(), "rule")  # a row for each rule
    return cutoffs.withColumn("place", F.row_number().over(order)).drop("worth")


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff, place, n_good, n_rejected, p_value) of the cutoffs in use; the last three are
    of the union of all rules up to ``place``.

    ``measured`` has doc_id, the stratum column and the ratios.
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("good"))
    passed = measured.where(~base_failed()).select("doc_id", F.col(risk.stratum).alias("stratum"), *RULES)
    known = passed.join(named, F.col("doc_id") == F.col("_id")).withColumn("half", F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(2)))
    proposed = cut(proposed_cutoffs(known.where("half = 0"), risk), "quality-proposed")
    packed = proposed.groupBy(F.col("stratum").alias("_stratum")).agg(F.collect_list(F.struct("rule", "cutoff", "place")).alias("cutoffs"))  # six rules at most
    ratio = lambda c: F.coalesce(*[F.when(c["rule"] == r, F.col(r)) for r in RULES])
    first = F.array_min(F.transform(F.filter("cutoffs", lambda c: ratio(c) >= c["cutoff"] - 1e-9), lambda c: c["place"]))
    tested = known.where("half = 1 and good = 1").join(packed, F.col("stratum").eqNullSafe(F.col("_stratum")))
    counts = tested.groupBy("_stratum", first.alias("first")).agg(F.count("*").alias("n"))
    per = counts.groupBy("_stratum").agg(F.collect_list(F.struct("first", "n")).alias("c"))  # seven at most
    upto = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"] <= F.col("place"), x["n"]).otherwise(0))
    every = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = proposed.join(per, F.col("stratum").eqNullSafe(F.col("_stratum"))).withColumns({"n_good": every, "n_rejected": upto})
    rows = rows.withColumn("p_value", binomial_tail(F.col("n_rejected"), F.col("n_good"), risk.risk))
    strata = proposed.agg(F.greatest(F.lit(1), F.count_distinct("stratum") + F.max(F.col("stratum").isNull().cast("int"))).alias("strata"))
    rows = rows.join(F.broadcast(strata)).withColumn("failed", F.col("p_value") > F.lit(risk.alpha) / F.col("strata"))  # one row
    before = Window.partitionBy("stratum").orderBy("place")
    return rows.withColumn("stopped", F.max("failed").over(before)).where(~F.col("stopped")).select("stratum", "rule", "cutoff", "place", "n_good", "n_rejected", "p_value")


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the counts of the base rules, base_failed, kept and the rules that reject."""
    measured = cut(measures(docs, [*keys, risk.stratum]), "quality-measures")
    return _judged(measured, labels, risk)


def _judged(measured: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    cutoffs = certified_cutoffs(measured, labels, risk)
    per = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    judged = measured.join(per, F.col(risk.stratum).eqNullSafe(F.col("_stratum")), "left")
    against = F.array_compact(F.array(*[F.when(F.col(r) >= F.try_element_at("_cutoffs", F.lit(r)) - 1e-9, F.lit(r)) for r in RULES]))
    judged = judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", against)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", "_cutoffs")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged.

    Documents with equal id, stratum and text are judged alike, so the join goes by these.
    """
    mark, d, s, m = (free_name(docs, f"quality_{x}") for x in ("mark", "id", "stratum", "text"))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    measured = cut(measures(marked, ["doc_id", risk.stratum, mark]), "quality-measures")
    bad = _judged(measured, labels, risk).where(~F.col("kept")).select(F.col("doc_id").alias(d), F.col(risk.stratum).alias(s), F.col(mark).alias(m)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col(risk.stratum).eqNullSafe(F.col(s)) & (F.col(mark) == F.col(m))
    return marked.join(bad, same, "left_anti").select(*docs.columns)
