r"""Quality rules as learned decision lists, in DataFrame functions only.

`text_statistics` computes per-text statistics inside each row; `learn_rules` runs sequential covering over labelled
statistics: a rule grows by the threshold condition of the best information gain on two thirds of the labelled rows,
loses conditions that do not help on the other third, and is kept while it is precise there. Each step is one
aggregation over a table of small integers (statistic bins), so the driver only ever sees counts per bin and label,
whatever the input size. The result is an ordered list of conjunctions that becomes one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import drop_materialized, materialize

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules test: ratios that do not depend on the text's length, and the length itself.
FEATURES = {
    "words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "lines_per_100_words": "100 * n_lines / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the long columns of STATISTICS and four more counts added (columns of those names are replaced).

    Words are runs of anything but ASCII white space; null has none. n_repeat_words counts the words inside windows of
    eight words that occur at least twice in the text: equal window hashes are found by sorting (hash, position), and
    the covered words are added up from the gaps between the positions, all inside the row.
    """
    names = ["__t", "__words", "__windows", "__lines", "__pairs", "__at"]
    t = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    t = t.withColumn("__words", F.filter(F.split("__t", SPACE), lambda w: w != ""))
    t = t.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("__hashes") - F.lit(REPEAT_WINDOW - 1), F.lit(0))
    t = t.withColumn("__windows", F.transform(
        F.slice("__hashes", 1, n), lambda x, i: F.xxhash64(x, *(F.get("__hashes", i + F.lit(k)) for k in range(1, REPEAT_WINDOW)))
    ))
    t = t.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(NOT_SPACE)))
    # Only texts with an equal pair of windows pay for sorting them with their positions.
    t = t.withColumn("__pairs", F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    same = lambda x, i: (F.get("__pairs", i - 1)["h"] == x["h"]) | (F.get("__pairs", i + 1)["h"] == x["h"])
    t = t.withColumn("__at", F.array_sort(F.transform(
        F.filter("__pairs", lambda x, i: F.coalesce(same(x, i), (F.get("__pairs", i + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"]
    )))
    gaps = F.transform("__at", lambda p, i: F.least(F.coalesce(F.get("__at", i + 1) - p, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)))
    solid = F.regexp_replace("__t", SPACE, "")
    count = lambda c: c.cast("long")
    t = t.withColumn("__solid", solid).withColumns({
        "n_words": count(F.size("__words")),
        "word_chars": count(F.length("__solid")),
        "n_symbols": count(F.length("__solid") - F.length(F.translate("__solid", SYMBOLS, ""))),
        "n_dup_lines": count(F.size("__lines") - F.size(F.array_distinct("__lines"))),
        "n_repeat_words": count(F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))),
        "n_upper": count(F.length("__solid") - F.length(F.translate("__solid", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))),
        "n_digits": count(F.length("__solid") - F.length(F.translate("__solid", "0123456789", ""))),
        "n_lines": count(F.size("__lines")),
        "n_distinct_words": count(F.size(F.array_distinct("__hashes"))),
    })
    return t.drop(*names, "__hashes", "__solid")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES.get(self.feature, self.feature)}) {'>' if self.above else '<='} {self.threshold!r}D"

    def holds(self, bin_: Column, cut: int) -> Column:
        return bin_ > cut if self.above else bin_ <= cut


@dataclass(frozen=True)
class RuleList:
    """Ordered rules, each (conditions, share of bad rows when pruned); the first that holds rejects a text."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def expression(self) -> str:
        """A SQL expression over STATISTICS columns: the number of the first rule that holds, from 1; 0 for none."""
        cases = "".join(f" WHEN {' AND '.join(c.sql() for c in conds)} THEN {k}" for k, (conds, _) in enumerate(self.rules, 1))
        return f"CASE{cases} ELSE 0 END" if cases else "0"

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in conds) + f" -> reject ({p:.3f})" for conds, p in self.rules]


def learn_rules(stats: DataFrame, label: str, row_key: str, bins: int = 24, max_rules: int = 6, max_conditions: int = 3, min_cover: int = 20, min_precision: float = 0.9) -> RuleList:
    """Rules that find rows of label 0 (bad) among `stats` (text_statistics columns, an integer `label`, a `row_key`).

    Rows with a null label are left out. Thresholds are the quantiles of each feature, approximated to 1/1000 of the
    rows. Growing uses the rows whose crc32(row_key) mod 3 is not 0, pruning the others. Without rows of both labels
    the list is empty. Repeated rows count as often as they occur; a null key falls to the growing side.
    """
    names = list(FEATURES)
    rows = stats.where(F.col(label).isin(0, 1)).select(
        (F.col(label) == 0).cast("int").alias("bad"),
        F.coalesce(F.pmod(F.crc32(F.col(row_key).cast("string")), F.lit(3)) == 0, F.lit(False)).alias("prune"),
        *(F.expr(x).cast("double").alias(k) for k, x in FEATURES.items()),
    )
    rows = materialize(rows, "rule-rows")
    # Cuts come from the bad rows as well as from all rows: a rare kind of bad text lies in one quantile of all.
    at = [i / bins for i in range(1, bins)]
    accuracy = F.lit(1000)
    quantiles = rows.agg(*(F.percentile_approx(F.col(k), at, accuracy).alias(k) for k in names), *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(k)), at, accuracy).alias(f"{k}_bad") for k in names)).first()
    cuts = {k: sorted({*(quantiles[k] or []), *(quantiles[f"{k}_bad"] or [])}) for k in names}
    binned = rows.select("bad", "prune", *(
        sum(((F.col(k) > float(c)).cast("int") for c in cuts[k]), F.lit(0)).cast("short").alias(k) for k in names
    ))
    # Equal rows of bins meet in one counted row: from here on every job reads this.
    cells = materialize(binned.groupBy("bad", "prune", *names).agg(F.count("*").alias("n")), "rule-cells")

    def totals(where: Column) -> dict[tuple[bool, int], int]:
        return {(r[0], r[1]): r[2] for r in cells.where(where).groupBy("prune", "bad").agg(F.sum("n")).collect()}

    def by_bin(where: Column) -> dict[tuple[str, int], list[int]]:
        long = cells.where(where & ~F.col("prune")).select("bad", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in names))).alias("x"))
        out: dict[tuple[str, int], list[int]] = {}
        for f, b, bad, n in long.groupBy("x.f", "x.b", "bad").agg(F.sum("n")).collect():
            out.setdefault((f, b), [0, 0])[bad] += n
        return out

    def best_cut(where: Column, p0: int, n0: int):
        counts, best = by_bin(where), None
        for k in names:
            for above in (True, False):
                for cut in range(len(cuts[k])):
                    got = [v for (f, b), v in counts.items() if f == k and (b > cut if above else b <= cut)]
                    n, p = sum(v[0] for v in got), sum(v[1] for v in got)
                    if p < min_cover:
                        continue
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, k, above, cut, p, n
        return best

    rules, left = [], F.lit(True)
    while len(rules) < max_rules:
        found = totals(left)
        p, n = found.get((False, 1), 0), found.get((False, 0), 0)
        if p < min_cover or not n:
            break
        conds: list[tuple[str, bool, int]] = []
        where = left
        while len(conds) < max_conditions and n and (best := best_cut(where, p, n)):
            _, k, above, cut, p, n = best
            conds.append((k, above, cut))
            where = where & ((F.col(k) > cut) if above else (F.col(k) <= cut))
        if not conds:
            break
        # Prune: the prefix of the conditions with the best (bad - good) / covered on the held-back third.
        scored = []
        for size in range(1, len(conds) + 1):
            held = totals(left & _all(conds[:size]))
            bad, good = held.get((True, 1), 0), held.get((True, 0), 0)
            scored.append(((bad - good) / (bad + good) if bad + good else -1.0, -size, bad, good))
        worth, size, bad, good = max(scored)
        conds = conds[:-size]
        if not bad or bad / (bad + good) < min_precision:
            break
        rules.append((tuple(Condition(k, above, cuts[k][cut]) for k, above, cut in conds), bad / (bad + good)))
        left = left & ~_all(conds)
    drop_materialized(rows, cells)
    return RuleList(tuple(rules))


def _all(conds: list[tuple[str, bool, int]]) -> Column:
    out = F.lit(True)
    for k, above, cut in conds:
        out = out & ((F.col(k) > cut) if above else (F.col(k) <= cut))
    return out


def apply_rules(docs: DataFrame, rules: RuleList, text: str = "text") -> DataFrame:
    """`docs` with text_statistics, base_failed, rule (0: none) and kept.

    Empty and null texts fail the base rule (fewer than 20 words). Repeated rows each get their own, equal, row.
    """
    return judge(text_statistics(docs, text), rules)


def judge(stats: DataFrame, rules: RuleList) -> DataFrame:
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("base_failed", base).withColumn("rule", F.expr(rules.expression()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
