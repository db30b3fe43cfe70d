"""Quality rules as a learned decision list, in DataFrame expressions alone.

Statistics of each whole text are computed in one row-local expression: no shuffle, no Python. From at most LABELLED
labelled rows (the first by a hash of doc_id) they are cut at quantiles into cells, and a table of (cell, good, bad)
counts goes to the driver. Sequential covering works on those counts: a rule grows by the condition of highest
information gain on two thirds of the rows, loses trailing conditions while that raises its
precision (by Laplace's estimate) on the other third, and is kept if
it is precise there; what it covers is set aside and the next rule is grown. The list becomes one CASE expression.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled rows that a fit looks at, cells for each statistic, conditions in a rule, rules in a list.
LABELLED, CUTS, CONDITIONS, RULES = 20_000, 24, 4, 12
#: A rule must hold so often on rows it wasn't grown on, and cover so many bad rows.
PRECISION, COVER = 0.9, 4
SPACE = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash comes twice or more; hashes: of the window at each word."""

    def repeated(rows: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(rows, j)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["p"]))

    def union(starts: Column) -> Column:
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(union(_bind(ordered, repeated)))


def _repeats(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(_bind(hashes, _covered))


def statistics(text: Column) -> Column:
    """A struct of BASE and further counts of a text; a null text has no words. Windows are compared by a 64-bit hash
    of their words."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeats(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
            F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
        )

    return _bind(F.filter(F.split(text, SPACE), lambda w: w != ""), of)


def features(s: Column) -> dict[str, Column]:
    """What conditions are made of, as doubles."""
    share = lambda a, b: a.cast("double") / F.greatest(b, F.lit(1)).cast("double")
    return {
        "words": s["n_words"].cast("double"),
        "word_length": share(s["word_chars"], s["n_words"]),
        "symbols_per_word": share(s["n_symbols"], s["n_words"]),
        "dup_line_share": share(s["lines"]["dup"], s["lines"]["all"]),
        "repeat_share": share(s["n_repeat_words"], s["n_words"]),
        "words_per_distinct": share(s["n_words"], s["n_distinct"]),
        "marks_per_word": share(s["n_marks"], s["n_words"]),
        "upper_share": share(s["n_upper"], s["word_chars"]),
    }


NAMES = ["words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_distinct", "marks_per_word", "upper_share"]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.value:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a text that one of them covers is bad, all others are good."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self, s: Column) -> Column:
        """The first rule that covers a text, from 1, or null: one ordered conditional expression."""
        of = features(s)
        out = None
        for i, conditions in enumerate(self.rules, 1):
            holds = reduce(lambda a, b: a & b, [of[c.name] >= c.value if c.above else of[c.name] < c.value for c in conditions])
            out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        return "\n".join(f"{i}: bad if " + " and ".join(map(str, r)) for i, r in enumerate(self.rules, 1)) or "no rule"


def _count(cells: list[tuple], rule: list[tuple]) -> tuple[int, int]:
    good = bad = 0
    for at, g, b in cells:
        if all((at[f] >= cut) == above for f, above, cut in rule):
            good, bad = good + g, bad + b
    return good, bad


def _grow(cells: list[tuple], sizes: list[int]) -> list[tuple]:
    """Conditions (statistic, above, cut number) added while they gain."""
    rule: list[tuple] = []
    good, bad = _count(cells, [])
    while good and bad and len(rule) < CONDITIONS:
        best, gain = None, 0.0
        for f, size in enumerate(sizes):
            by = [[0, 0] for _ in range(size + 1)]
            for at, g, b in cells:
                by[at[f]][0] += g
                by[at[f]][1] += b
            g_low = b_low = 0
            for cut in range(1, size + 1):
                g_low, b_low = g_low + by[cut - 1][0], b_low + by[cut - 1][1]
                for above, g, b in ((True, good - g_low, bad - b_low), (False, g_low, b_low)):
                    won = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good))) if b else 0.0
                    if won > gain + 1e-9:
                        best, gain = (f, above, cut), won
        if best is None:
            break
        rule.append(best)
        cells = [c for c in cells if (c[0][best[0]] >= best[2]) == best[1]]
        good, bad = _count(cells, [])
    return rule


def cover(grow: list[tuple], prune: list[tuple], sizes: list[int]) -> list[list[tuple]]:
    """Sequential covering over (cell, good, bad) counts."""
    rules: list[list[tuple]] = []
    while len(rules) < RULES:
        rule = _grow(grow, sizes)
        if not rule:
            break

        def worth(length: int, rule: list[tuple] = rule) -> tuple[float, int]:
            good, bad = _count(prune, rule[:length])
            return (bad + 1) / (bad + good + 2), -length

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        good, bad = (a + b for a, b in zip(_count(prune, rule), _count(grow, rule), strict=True))
        held_good, held_bad = _count(prune, rule)
        if bad < COVER or bad < PRECISION * (good + bad) or held_bad < PRECISION * (held_good + held_bad):
            break
        rules.append(rule)
        left = lambda c, rule=rule: not all((c[0][f] >= cut) == above for f, above, cut in rule)
        grow, prune = [c for c in grow if left(c)], [c for c in prune if left(c)]
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> DecisionList:
    """Learns the list from labels.quality (0 bad, 1 good; other rows are left out, and of a doc_id labelled twice the
    lower label counts). Rows that the base rules reject anyway take no part. Without bad or good rows the list is
    empty and keeps all."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_quality"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = rows.select("_id", "_quality", statistics(F.col("_text")).alias("s"))
    # the filter comes after the table is written: before it, it would be pushed below the join and read all texts
    rows = stored(rows.select("_id", "_quality", base_failed(F.col("s")).alias("_failed"), *[c.alias(k) for k, c in features(F.col("s")).items()]), "labelled").where("not _failed")
    share = [i / CUTS for i in range(1, CUTS)] + [0.97, 0.98, 0.99, 0.995]
    found = rows.agg(*[F.percentile_approx(k, share, 10_000).alias(k) for k in NAMES]).first()
    # cuts at values and half way to the next ones, so that a value which many rows share is parted from greater ones
    # by a margin
    cuts = []
    for k in NAMES:
        seen = sorted(set(found[k] or []))
        cuts.append(sorted({*seen, *((x + y) / 2 for x, y in zip(seen, seen[1:]))}))
    below = lambda k: lambda x: x <= F.col(k)
    cell = [F.size(F.filter(F.lit(c), below(k))) if c else F.lit(0) for k, c in zip(NAMES, cuts, strict=True)]
    third = (F.pmod(F.xxhash64("_id", F.lit("prune")), F.lit(3)) == 0).alias("prune")
    counts = rows.groupBy(third, *[c.alias(k) for k, c in zip(NAMES, cell, strict=True)]).agg(F.count_if(F.col("_quality") == 1).alias("good"), F.count_if(F.col("_quality") == 0).alias("bad"))
    parts: dict[bool, list[tuple]] = defaultdict(list)
    for r in counts.orderBy("prune", *NAMES).collect():
        parts[r["prune"]].append((tuple(r[k] for k in NAMES), r["good"], r["bad"]))
    rules = cover(parts[False], parts[True], [len(c) for c in cuts])
    return DecisionList([[Condition(NAMES[f], above, cuts[f][cut - 1]) for f, above, cut in rule] for rule in rules])


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, BASE, base_failed, kept and rule (the covering rule's number or null) of every row. Each row is judged by its
    own text, repeated rows alike; a null text has no words and fails the base; of several rules that cover a text the
    first counts; other columns are not looked at; an empty table gives no rows. A text of any length is one row's work, and
    its words are held in memory."""
    s = F.col("s")
    rows = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s", base_failed(s).alias("base_failed"), rules.rule(s).alias("rule"))
    counts = [s["lines"]["dup"].alias(k) if k == "n_dup_lines" else s[k].alias(k) for k in BASE]
    return rows.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows that judge() keeps, with all their columns, whatever their names; repeated rows stay repeated."""
    s = statistics(F.col("text"))
    return docs.where(_bind(s, lambda x: ~base_failed(x) & rules.rule(x).isNull()))
