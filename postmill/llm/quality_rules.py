"""Rule features of whole texts, and risk-controlled cutoffs for them.

Features are built from the words (`[^\\x20\\x09-\\x0D]+`) of a text by built-in array functions inside one row;
nothing is shuffled for them. Cutoffs are found in two steps, per stratum (language):

1. A path of ever harder cutoffs, from the labelled rows outside the holdout: at level j each rule's cutoff is the lowest
   value that at most LEVELS[j] of the good documents there reach. Cutoffs of a rule only fall along the path.
2. A test of the path on the labelled holdout, which step 1 has not seen: level by level, from the mildest on, the good
   documents that the level's cutoffs reject by any rule are counted, and the level is certified if the exact binomial
   tail P(Bin(n, alpha) <= rejected) is at most delta / (number of strata). The first level that fails ends the
   sequence, so the levels of a stratum need no further correction (fixed-sequence testing); the strata are corrected by
   Bonferroni. With probability 1 - delta no certified level of any stratum rejects more than `alpha` of the good documents.

Of the certified levels the one with the best gain of bad over good rejections is used. A stratum of fewer than
log(delta / strata) / log(1 - alpha) good holdout documents can certify nothing (228 at the defaults): there every
document that passes the base rule is kept.

Nulls and edges: a null or empty text has no words (all counts 0, base_failed); a very long text is one array of its words;
an id without label counts for no cutoff; several labels of an id count as good if any says good; repeated rows are all
returned; rules that tie reject alike; an empty table gives no rows; `judge` leaves other columns out and `keep` returns
them as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, remainder, steps, words_of

#: Strata with cutoffs of their own; every other language shares one more.
STRATA = ("en", "de", "fr", "es")
#: A feature's value is binned by floor(value * scale), at most BINS; a cutoff rejects bins from it upwards.
RULES = {"symbols": 256, "dup_lines": 64, "repeats": 64, "word_length": 8}
BINS = 256
#: Shares of the good documents outside the holdout that a rule may reject, level by level of the path.
LEVELS = (0.0, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05)


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur at least twice in the array.

    A window's hash and place share one long, so one primitive sort brings equal windows together; equal
    neighbours are confirmed on the words themselves. Where two different windows meet in one hash, the windows of
    that text are sorted by their words instead.
    """

    def body(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        shifted = lambda name, x: F.call_function(name, x, bits)
        mask = shifted("shiftleft", F.lit(1).cast("long")) - 1
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.transform(starts, lambda i: shifted("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).bitwiseOR(i.cast("long")))

        def place(x: Column) -> Column:
            return x.bitwiseAND(mask).cast("int")

        def against(x: Column, other: Column) -> Column:
            """0: another hash, 1: the same window, 2: the same hash of another window."""
            words_equal = (F.get(w, place(x)) == F.get(w, place(other))) & (F.get(w, place(x) + 1) == F.get(w, place(other) + 1)) & (F.get(w, place(x) + 2) == F.get(w, place(other) + 2))
            return F.when(shifted("shiftrightunsigned", x) == shifted("shiftrightunsigned", other), F.when(words_equal, 1).otherwise(2)).otherwise(0)

        def repeated(sorted_windows: Column, codes: Column, at) -> Column:
            found = F.filter(sorted_windows, lambda x, i: (F.get(codes, i) == 1) | (F.coalesce(F.get(codes, i + 1), F.lit(0)) == 1))
            return F.transform(found, at)

        def by_words(_: Column) -> Column:
            full = F.sort_array(F.transform(starts, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))

            def codes(x: Column) -> Column:
                same = lambda y, z: (y["a"] == z["a"]) & (y["b"] == z["b"]) & (y["c"] == z["c"])
                return F.transform(x, lambda y, i: F.when(F.coalesce(same(y, F.get(x, i - 1)), F.lit(False)), 1).otherwise(0))

            return let(full, lambda x: let(codes(x), lambda c: repeated(x, c, lambda y: y["i"])))

        def by_hash(keys: Column) -> Column:
            codes = F.transform(keys, lambda x, i: F.coalesce(against(x, F.get(keys, i - 1)), F.lit(0)))
            return let(codes, lambda c: F.when(F.array_contains(c, 2), by_words(keys)).otherwise(repeated(keys, c, place)))

        places = F.sort_array(let(F.sort_array(windows), by_hash))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total")))
        return F.when(F.size(w) < 3, 0).otherwise(covered["total"])

    return let(words, body)


def rule_features(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """Columns doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines; one row per document.

    keep_row adds the whole input row as the struct `row`."""
    row = [F.struct(*docs.columns).alias("row")] if keep_row else []
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    found = docs.select(
        "doc_id",
        F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other").alias("stratum"),
        let(words_of(text), counts).alias("w"),
        let(lines, line_counts).alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        *row,
    )
    return found.select("doc_id", "stratum", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", *(["row"] if keep_row else []))


def base_failed(words: str = "n_words", repeats: str = "n_repeat_words") -> Column:
    return (F.col(words) < 50) | (100 * F.col(repeats) > 50 * F.col(words))


def rule_bins() -> dict[str, Column]:
    """Bin of each rule's value; higher is worse."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"), "word_length": ratio("word_chars", "n_words")}
    return {k: F.least(F.lit(BINS), F.floor(v * RULES[k])).cast("int") for k, v in values.items()}


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + float(i))
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from k downwards; 1 where k is at least n * p (never certified).

    Below the mean the terms shrink faster than exp(-m^2 / (2 n p (1 - p))) at distance m, so after twelve standard
    deviations the rest is below rounding; its geometric bound is added all the same.
    """
    k, n = k.cast("double"), n.cast("double")
    log_pmf = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda j: j / (n - j + 1) * ((1 - p) / p)
    terms = F.least(k, F.ceil(12 * F.sqrt(n * (p * (1 - p)))) + 100)
    steps = F.when(k < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), terms.cast("int")))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * ratio(k - i + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    done = F.aggregate(steps, start, add)
    rest = F.when(k > terms, done["term"] * ratio(k - terms) / (1 - ratio(k - terms))).otherwise(0.0)
    return F.when(k >= n * p, 1.0).otherwise(F.exp(log_pmf) * (done["total"] + rest))


def cutoff_path(training: DataFrame) -> DataFrame:
    """stratum and cutoffs (map of rule to its cutoff at each level) from stratum, quality and the rules' bins.

    The counts by stratum, rule and bin are at most (strata) x (rules) x (bins + 1) rows, whatever the input."""
    tall = training.where("quality = 1").select("stratum", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("bin")) for k in RULES])).alias("r")).select("stratum", "r.*")
    by_bin = tall.groupBy("stratum", "rule", "bin").agg(F.count("*").alias("good"))
    group = Window.partitionBy("stratum", "rule")
    reach = by_bin.select("stratum", "rule", "bin", (F.sum("good").over(group.orderBy(F.desc("bin"))) / F.sum("good").over(group)).alias("share"))
    # The lowest cutoff that few enough reach lies just above the highest bin that too many reach.
    cutoffs = [(F.max(F.when(F.col("share") > q, F.col("bin"))) + 1).alias(f"c{j}") for j, q in enumerate(LEVELS)]
    by_rule = reach.groupBy("stratum", "rule").agg(*cutoffs)
    entry = F.struct("rule", F.array(*[f"c{j}" for j in range(len(LEVELS))]).alias("cutoffs"))
    return by_rule.groupBy("stratum").agg(F.map_from_entries(F.collect_list(entry)).alias("cutoffs"))


def level_of(cutoffs: Column) -> Column:
    """The mildest level whose cutoffs reject a row (its bins are columns), or the number of levels."""
    def first(rule: str) -> Column:
        return F.array_position(F.transform(cutoffs[rule], lambda c: F.col(rule) >= c), True)

    hit = [first(k) for k in RULES]
    return F.least(*[F.when(h > 0, h - 1).otherwise(len(LEVELS)) for h in hit]).cast("int")


def certified_levels(holdout: DataFrame, path: DataFrame, alpha: float, delta: float, strata: int) -> DataFrame:
    """stratum, level, rejected_good, good and tail: the chosen level of each stratum that has a certified one."""
    # One row a stratum: at most `strata` rows are broadcast.
    found = holdout.join(F.broadcast(path), "stratum").select("stratum", "quality", level_of(F.col("cutoffs")).alias("level"))
    counts = found.groupBy("stratum").agg(
        F.count_if(F.col("quality") == 1).alias("good"),
        F.array(*[F.struct(F.lit(j).alias("level"), F.count_if((F.col("quality") == 1) & (F.col("level") <= j)).alias("rejected_good"), F.count_if((F.col("quality") != 1) & (F.col("level") <= j)).alias("rejected_bad")) for j in range(len(LEVELS))]).alias("levels"),
    )
    rows = counts.select("stratum", "good", F.explode("levels").alias("l")).select("stratum", "good", "l.*")
    tested = rows.withColumn("tail", binomial_tail(F.col("rejected_good"), F.col("good"), alpha))
    so_far = Window.partitionBy("stratum").orderBy("level")
    certified = tested.withColumn("worst", F.max("tail").over(so_far)).where(F.col("worst") <= delta / strata)
    gain = F.col("rejected_bad") - 10 * F.col("rejected_good")
    best = certified.where(gain > 0).withColumn("rn", F.row_number().over(Window.partitionBy("stratum").orderBy(gain.desc(), "level")))
    return best.where("rn = 1").select("stratum", "level", "rejected_good", "good", "tail")


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum, level, rejected_good, good, tail and cutoffs (map of rule to cutoff) of each stratum with a certified level.

    The holdout is the labelled rows whose crc32(doc_id as text) mod 3 is 1, which the quality classifier never learns
    from either; the path comes from the other labelled rows."""
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    bins = features.select("doc_id", "stratum", *[v.alias(k) for k, v in rule_bins().items()])
    with steps(features.sparkSession, "cutoffs") as own:
        marked = own(bins.join(truth, "doc_id"), "marked")
        path = cutoff_path(marked.where(remainder("doc_id", 3) != 1))
        levels = certified_levels(marked.where(remainder("doc_id", 3) == 1), path, alpha, delta, len(STRATA) + 1)
        found = levels.join(path, "stratum").withColumn("cutoffs", F.transform_values("cutoffs", lambda k, c: F.get(c, F.col("level"))))
        return cut(found, "chosen-cutoffs")


def apply_cutoffs(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """features with base_failed and kept. The cutoffs are one row per stratum at most, so they are broadcast."""
    rejected = F.lit(False)
    for k, v in rule_bins().items():
        rejected = rejected | F.coalesce(v >= F.try_element_at(F.col("cutoffs"), F.lit(k)), F.lit(False))
    joined = features.join(F.broadcast(cutoffs.select("stratum", "cutoffs")), "stratum", "left").withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("cutoffs")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document with its features, base_failed and kept.

    Features are computed once and kept in the shared folder for the two uses."""
    features = cut(rule_features(docs), "rule-features")
    return apply_cutoffs(features, certified_cutoffs(features, labels, alpha, delta))


def keep(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept. Rows and their features are written once, side by side, so nothing is joined back
    to the texts."""
    features = cut(rule_features(docs, keep_row=True), "rows-with-features")
    return apply_cutoffs(features, certified_cutoffs(features, labels, alpha, delta)).where("kept").select("row.*")
