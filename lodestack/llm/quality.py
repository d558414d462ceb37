"""Quality rules with risk-controlled thresholds.

A document is rejected if one of five features lies beyond its cutoff. Cutoffs are certified together: a fixed
path of steps goes from loose to strict, each step tightening one rule by one notch, and a step's risk is the
share of good documents that its whole set of cutoffs rejects. The labelled documents of good quality of a
stratum are the holdout: with k of n rejected, a step passes if P(Binomial(n, epsilon) <= k) <= delta / strata,
the exact one-sided test with Bonferroni's correction over strata. Within a stratum steps are tested in order
and the first one that does not pass ends the path, which needs no further correction. So with probability
1 - delta no stratum's verdict rejects more than epsilon of its good documents, all rules together, whichever
certified step is then chosen. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, materialize

WINDOW = 8
EPSILON, DELTA = 0.03, 0.05
# Each rule's feature, its direction (+1: fails above the cutoff, -1: below) and its grid, loose to strict.
RULES = {
    "symbols": (lambda: F.try_divide("n_symbols", "n_words"), 1, [1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02]),
    "long_words": (lambda: F.try_divide("word_chars", "n_words"), 1, [10.0, 9.0, 8.0, 7.5, 7.0, 6.5, 6.0]),
    "short_words": (lambda: F.try_divide("word_chars", "n_words"), -1, [2.0, 2.5, 3.0, 3.5, 4.0]),
    "dup_lines": (lambda: F.try_divide("n_dup_lines", "n_words"), 1, [0.05, 0.02, 0.01, 0.005]),
    "repeats": (lambda: F.try_divide("n_repeat_words", "n_words"), 1, [0.25, 0.2, 0.15, 0.1, 0.05]),
}
#: The path: (step, rule, cutoff), a notch of each rule in turn.
PATH = [(i + 1, r, c) for i, (r, c) in enumerate((r, cs[n]) for n in range(max(len(cs) for _, _, cs in RULES.values())) for r, (_, _, cs) in RULES.items() if n < len(cs))]


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have no words and fail the base rules. Own columns of these names are replaced.
    """
    names = FEATURES
    kept = [c for c in docs.columns if c not in (*names, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*kept, text.alias("_body"))
    lines = F.filter(F.split("_body", "\n", -1), lambda x: x.rlike(NOT_SPACE))
    d = d.select(
        *kept,
        F.transform(F.regexp_extract_all("_body", F.lit(f"{NOT_SPACE}+"), 0), lambda w: F.xxhash64(w)).alias("_words"),
        F.char_length(F.regexp_replace("_body", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    # Hashes of all windows of eight words. Each array is used twice or more below, so that it is computed once per row.
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    d = d.select(*kept, n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    # Only texts with a repeated window go on: windows sorted by hash and place; equal neighbours repeat.
    ordered = F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_s", ordered)
    twin = lambda s, j, k: F.coalesce(F.get("_s", j + k)["h"] == s["h"], F.lit(False))
    d = d.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda s, j: twin(s, j, -1) | twin(s, j, 1)), lambda s: s["i"])))
    # Sorted places p1 < p2 < ... cover min(8, p2 - p1) words each, and the last one 8.
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).select(*kept, *names)


def fails(rule: str, cutoff: Column) -> Column:
    feature, side, _ = RULES[rule]
    return F.coalesce(feature() > cutoff if side > 0 else feature() < cutoff, F.lit(False))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), term by term in logarithms; 1 where k is at or above the mean and the exact value cannot certify."""
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p))))).alias("s"))
    first = n * F.log(F.lit(1 - p))
    upto = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("t"), F.exp(first).alias("s")), step, lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(upto)


def first_failed_step() -> Column:
    """The first step of the path that rejects a document, or null; all later steps do too."""
    hits = {r: F.coalesce(*(F.when(fails(r, F.lit(float(c))), F.lit(i)) for i, own, c in PATH if own == r)) for r in RULES}
    return F.least(*hits.values())


def certify(measured: DataFrame, labels: DataFrame, stratum: str, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """(stratum, step, rule, cutoff, n_good, k_good, n_bad, k_bad, risk_p, certified) of the whole path, from features and (doc_id, quality).

    A doc_id counts once, rejected if one of its rows is; ids that are labelled both good and bad, and null
    ids, do not count.
    """
    lab = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"), F.max("quality").alias("_other"))
    lab = lab.filter("_quality = _other").select("_id", "_quality")
    x = measured.filter("NOT base_failed").select(F.col("doc_id").alias("_id"), F.col(stratum).alias("stratum"), first_failed_step().alias("_step")).join(lab, "_id")
    x = x.groupBy("stratum", "_id", "_quality").agg(F.min("_step").alias("_step"))
    good = F.col("_quality") == 1
    per = x.groupBy("stratum").agg(
        F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"),
        *(F.count_if(q & (F.col("_step") <= i)).alias(f"{k}{i}") for i, _, _ in PATH for k, q in (("g", good), ("b", ~good))),
    )
    per = materialize(per, "strata")
    level = delta / max(1, per.filter("n_good > 0").count())
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"g{i}").alias("k_good"), F.col(f"b{i}").alias("k_bad")) for i, r, c in PATH))
    per = per.select("stratum", "n_good", "n_bad", F.explode(steps).alias("x")).select("stratum", "x.step", "x.rule", "x.cutoff", "n_good", "x.k_good", "n_bad", "x.k_bad")
    risk = F.when(F.col("n_good") > 0, binomial_cdf(F.col("k_good"), F.col("n_good"), epsilon)).otherwise(F.lit(1.0))
    # A stratum's path ends at the first step whose risk is not certified.
    upto = Window.partitionBy("stratum").orderBy("step")
    return per.withColumn("risk_p", risk).withColumn("certified", F.min(F.col("risk_p") <= level).over(upto))


def cutoffs(certified: DataFrame) -> DataFrame:
    """One row per stratum with a column cut_<rule>: the cutoffs of the certified step that rejects most more of the bad than of the good
    (ties to the looser one), or null for rules that it does not use and strata without such a step."""
    gain = F.coalesce(F.try_divide("k_bad", "n_bad"), F.lit(0.0)) - F.coalesce(F.try_divide("k_good", "n_good"), F.lit(0.0))
    ok = F.col("certified") & (gain > 0)
    best = certified.groupBy("stratum").agg(F.max_by(F.when(ok, F.col("step")), F.when(ok, F.struct(gain.alias("g"), (-F.col("step")).alias("i")))).alias("upto"))
    cut_at = lambda r: F.coalesce(*(F.when(F.col("upto") >= i, F.lit(float(c))) for i, own, c in reversed(PATH) if own == r))
    return best.select("stratum", *(cut_at(r).alias(f"cut_{r}") for r in RULES))


def verdicts(measured: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """measured with failed_rules array<string> and kept, which replace own columns of these names; strata without labels have the base rules only."""
    names = [c for c in measured.columns if c not in ("failed_rules", "kept")]
    own = cuts.select(F.col("stratum").alias("_cut_stratum"), *(F.col(f"cut_{r}").alias(f"_cut_{r}") for r in RULES))
    x = measured.select(*names).join(own, F.col(stratum).eqNullSafe(F.col("_cut_stratum")), "left")
    failed = F.array_compact(F.array(*(F.when(fails(r, F.col(f"_cut_{r}")), F.lit(r)) for r in RULES)))
    return x.select(*names, failed.alias("failed_rules"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text", epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """docs without the text, with features, failed_rules and kept, which replace own columns of these names. Repeated rows are judged alike; null strata are a stratum; without labels the base rules decide alone; an empty table gives no rows."""
    own = F.struct(*(F.col(c) for c in docs.columns if c not in (text_col, *FEATURES, "failed_rules", "kept")))
    part = docs.select(own.alias("_row"), "doc_id", F.col(text_col).alias("_text"), F.col(stratum).alias("_stratum"))
    measured = materialize(features(part, "_text"), "features")
    cuts = materialize(cutoffs(certify(measured, labels, "_stratum", epsilon, delta)), "cutoffs")
    return verdicts(measured, cuts, "_stratum").select("_row.*", *FEATURES, "failed_rules", "kept")


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text", epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names. Features are computed again rather than joined: texts
    stay where they are. Null and empty texts go, since they fail the base rules; an empty table gives no rows."""
    part = docs.select("doc_id", F.col(text_col).alias("_text"), F.col(stratum).alias("_stratum"))
    cuts = materialize(cutoffs(certify(materialize(features(part, "_text"), "features"), labels, "_stratum", epsilon, delta)), "cutoffs")
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    measured = features(docs.select(own, F.col(text_col).alias("_text"), F.col(stratum).alias("_stratum")), "_text")
    # A filter does not pass a column that is not deterministic; below the features it would compute them again and again.
    judged = verdicts(measured.withColumn("_at", F.monotonically_increasing_id()), cuts, "_stratum")
    return judged.filter("kept AND _at >= 0").select("_row.*")
