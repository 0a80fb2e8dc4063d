"""Quality rules: a decision list learned by sequential covering, in DataFrame functions only.

Statistics of each labelled text are put into bins, cut at quantiles of all rows and of the rows of low
quality, finer at both ends, so that a rare kind has cuts of its own. A rule is a conjunction of
thresholds on them. It is grown on two thirds of the labelled rows, one condition at a time, by the gain
in information about low quality; then its last conditions are pruned while that helps on the remaining
third. Rows it covers leave, and the next rule is learned from the rest. If a rule is not precise enough,
its first statistic and side are set aside and another beginning is tried, until none is left. Each step is one small aggregation: counts by statistic, bin and label. The list is one ordered
CASE expression, so applying it is a projection of the scan.

The rows to learn from are those of a sample (about ``SAMPLE``, by a hash of the id) or, if none is asked for, all
that have a label; all statistics of all documents are computed, on whole texts.

Windows of three words are compared by 64-bit hashes within one text.

Rules: null is a text without words. A document without label, or with a null one, is not learned from;
if a document has several labels each counts. Without both kinds of labels the list is empty and the
base rule alone decides. Repeated rows are rows like any other. Columns of other names pass through; an
input column with the name of a statistic is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetry.llm.batches import chosen, unused
from volumetry.session import cut_lineage

SAMPLE = 20_000
BINS = 32
TAILS = (6, 12)  # further bins at either end, of a share of 2^-6 to 2^-12 of the rows
PRECISION = 0.9  # of a rule, on the rows kept apart for pruning
SUPPORT = 5  # rows of low quality that a rule covers at least when grown
CONDITIONS = 4
RULES = 16
# statistics that rules may use; shares are of words, lines or characters
FEATURES = ("n_words", "symbol_share", "dup_line_share", "repeat_share", "mean_word", "digit_share", "distinct_share")


# Names that the steps of ``_with_statistics`` take.
STEPS = ("_words", "_lines", "_digits", "_hashes", "_two", "_three", "_windows", "_twice", "_n_lines", "_distinct")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and the shares
    that rules use, in place of input columns of these names; all others stay as they are."""
    aside = {c: f"{c}_given" for c in df.columns if c.lower() in STEPS}
    for c, name in aside.items():
        aside[c] = unused(df, name)
    out = _with_statistics(df.withColumnsRenamed(aside), aside.get(text, text))
    return out.withColumnsRenamed({name: c for c, name in aside.items()})


def _with_statistics(df: DataFrame, text: str) -> DataFrame:
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]
    keep = [c for c in df.columns if c not in made]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(characters: str, pattern: str) -> Column:
        """Most texts have none, which a search tells for less than a count."""
        return F.when(body.rlike(pattern), F.char_length(body) - F.char_length(F.translate(body, characters, ""))).otherwise(0)

    out = df.select(*keep, F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "").alias("_words"), lines.alias("_lines"),
                    counted("#*$%&|<>", r"[#*$%&|<>]").alias("n_symbols"), counted("0123456789", r"[0-9]").alias("_digits"))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rest = lambda c, k: F.greatest(F.size(c) - k, F.lit(0))
    shifted = lambda a, b, k, n: F.zip_with(F.slice(a, 1, n), F.slice(b, k + 1, n), lambda x, y: F.xxhash64(x, y))
    out = out.withColumn("_two", shifted("_hashes", "_hashes", 1, rest("_hashes", 1)))
    out = out.withColumn("_three", shifted("_two", "_hashes", 2, rest("_hashes", 2)))
    # only texts with equal windows are looked at further; sorted, equal windows are neighbours
    again = F.size("_three") > F.size(F.array_distinct("_three"))
    out = out.withColumn("_windows", F.when(again, F.array_sort(F.transform("_three", lambda h, i: F.struct(h.alias("w"), i.alias("at"))))))
    pairs = F.zip_with(F.slice("_windows", 1, F.size("_windows") - 1), F.slice("_windows", 2, F.size("_windows")),
                       lambda a, b: F.when(a["w"] == b["w"], F.array(a["at"], b["at"])))
    twice = F.when(F.col("_windows").isNotNull(), F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    out = out.withColumn("_twice", F.array_sort(F.array_distinct(F.coalesce(twice, F.array().cast("array<int>")))))
    # a window covers three words, less those that the next one covers too
    steps = F.zip_with("_twice", F.slice("_twice", 2, F.greatest(F.size("_twice"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    out = out.select(
        *keep, F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        "_digits", F.size("_lines").alias("_n_lines"), F.size(F.array_distinct("_hashes")).alias("_distinct"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    shares = {"symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "_n_lines"),
              "repeat_share": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words"),
              "digit_share": share("_digits", "word_chars"), "distinct_share": share("_distinct", "n_words")}
    out = out.withColumns(shares)
    # one struct, made into columns by a generator of one row: a filter on them stays above it, so it is
    # never pushed into the lambdas that the counts are made of
    new = dict.fromkeys(made)
    return out.select(*keep, F.inline_outer(F.array(F.struct(*new))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return (F.col(self.feature) > self.cut) if self.above else (F.col(self.feature) <= self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets, from 1 on; 0 if it meets none."""
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(covers(rule), number).otherwise(out)
    return out


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int | None = SAMPLE) -> DataFrame:
    """Statistics of at most about ``sample`` labelled documents: those with a small hash of their id; of all of them
    without a sample."""
    good = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").alias("_good"))
    if sample is None:  # labels may be too many to be sent to the texts; what moves are statistics
        made = with_statistics(docs.select("doc_id", F.col(text).alias("text"))).select("doc_id", *FEATURES)
        return made.join(good, "doc_id").select("doc_id", "_good", *FEATURES)
    small = chosen(F.xxhash64("doc_id"), sample, good.count())
    some = docs.select("doc_id", F.col(text).alias("text")).where(small).join(good.where(small), "doc_id")
    return with_statistics(some).select("doc_id", "_good", *FEATURES)


def fit(rows: DataFrame) -> list[Rule]:
    """Learns the list from ``labelled`` rows."""
    rows = cut_lineage(rows.where(~(F.col("n_words") < 50)), "labelled")
    tails = [2.0**-k for k in range(TAILS[0], TAILS[1] + 1)]
    points = sorted([*(i / BINS for i in range(1, BINS)), *tails, *(1 - t for t in tails)])
    bad = lambda f: F.when(F.col("_good") == 0, F.col(f))
    found = rows.agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES],
                     *[F.percentile_approx(bad(f), points, 10_000).alias(f"bad_{f}") for f in FEATURES]).first()
    cuts = {f: sorted({*(found[f] or []), *(found[f"bad_{f}"] or [])}) for f in FEATURES}
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    bins = [F.aggregate(F.array(*[F.lit(float(c)) for c in cuts[f]]), F.lit(0), (lambda f: lambda n, c: n + (F.col(f) > c).cast("int"))(f)).alias(f)
            if cuts[f] else F.lit(0).alias(f) for f in FEATURES]
    # as many rows as there are different sets of bins, at most the sample
    grid = cut_lineage(rows.select((part < 2).alias("grow"), (F.col("_good") == 0).alias("bad"), *bins)
                       .groupBy("grow", "bad", *FEATURES).agg(F.count(F.lit(1)).alias("n")), "grid")

    def in_bins(rule: list[tuple[str, bool, int]]) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(f) > k) if up else (F.col(f) <= k) for f, up, k in rule), F.lit(True))

    def counts(rest: DataFrame, rule: list) -> dict[str, list[list[int]]]:
        """Good and bad rows by statistic and bin, among rows to grow on that the rule covers."""
        covered = rest.where("grow").where(in_bins(rule))
        long = covered.select("bad", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in FEATURES])).alias("x"))
        out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
        for r in long.groupBy("x.f", "x.k", "bad").agg(F.sum("n").alias("n")).collect():  # statistics x bins x 2
            out[r["f"]][r["k"]][int(r["bad"])] = r["n"]
        return out

    def gain(good: int, bad: int, was: tuple[int, int]) -> float:
        return bad * (log2(bad / (good + bad)) - log2(was[1] / sum(was))) if bad else -1.0

    def grow(rest: DataFrame, aside: set[tuple[str, bool]]) -> list[tuple[str, bool, int]]:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < CONDITIONS:
            seen = counts(rest, rule)
            was = tuple(map(sum, zip(*seen[FEATURES[0]])))
            if was[1] < SUPPORT or not was[0]:
                break
            best = (0.0, None)
            for f in FEATURES:
                below = [0, 0]
                for k, (good, bad) in enumerate(seen[f][:-1]):
                    below = [below[0] + good, below[1] + bad]
                    for up, (g, b) in ((False, below), (True, (was[0] - below[0], was[1] - below[1]))):
                        if not rule and (f, up) in aside:
                            continue
                        if b >= SUPPORT and (score := gain(g, b, was)) > best[0] + 1e-9:
                            best = (score, (f, up, k))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def pruned(rest: DataFrame, rule: list) -> tuple[list, float]:
        """The shortest start of the rule that is most precise on the rows kept apart."""
        starts = [rule[:n] for n in range(1, len(rule) + 1)]
        kept = rest.where("not grow")
        row = kept.agg(*[F.sum(F.when(in_bins(s) & (F.col("bad") == b), F.col("n")).otherwise(0)).alias(f"{i}_{b}")
                         for i, s in enumerate(starts) for b in (True, False)]).first()
        worth = []
        for i, s in enumerate(starts):
            bad, good = row[f"{i}_True"] or 0, row[f"{i}_False"] or 0
            worth.append(((bad - good) / (bad + good) if bad + good else -1.0, -i, bad / (bad + good) if bad + good else 0.0))
        best = max(worth)
        return starts[-best[1]], best[2]

    rules, rest, aside = [], grid, set()
    while len(rules) < RULES:
        rule = grow(rest, aside)
        if not rule:
            break
        rule, precise = pruned(rest, rule)
        if precise < PRECISION:  # no rule begins this way until another one has taken rows away
            aside.add(rule[0][:2])
            continue
        aside = set()
        rules.append(tuple(Condition(f, up, float(cuts[f][k])) for f, up, k in rule))
        rest = rest.where(~in_bins(rule))
    return rules


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All columns of ``docs``, the statistics, ``base_failed``, ``rule`` (first rule met, 0: none) and
    ``kept``."""
    out = with_statistics(docs, text).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
