"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are Spark columns over the whole text.  Trees fitted to a bounded sample of labelled rows
give their paths as candidate rules; an L1 logistic regression keeps few of them and weighs them; the
survivors are compiled into one Spark column, so that scoring is a map in the JVM without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .toxicity import held_out, sample

#: Frequent function words of four languages, in lower case.
FUNCTION_WORDS = ["the", "and", "of", "to", "in", "that", "is", "was", "for", "it", "with", "as", "der", "die", "das", "und", "den", "von", "zu", "le", "la", "les", "des", "et", "un", "une", "de", "que", "el", "los", "las", "y", "en"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÑÍÓÚÁÊÔÎ"
SYMBOLS = "#$%&*+<=>@\\^_`{|}~[]"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words, lines = F.split(t, r"\s+"), F.split(t, "\n")
    n, k = F.greatest(F.length(t), F.lit(1)), F.size(words)

    def without(chars: str) -> Column:
        return F.length(t) - F.length(F.translate(t, chars, ""))

    return {
        "log_chars": F.log1p(F.length(t)),
        "log_words": F.log1p(k),
        "mean_word": F.length(t) / k,
        "capitals": without(CAPITALS) / n,
        "symbols": without(SYMBOLS) / n,
        "digits": without("0123456789") / n,
        "exclaims": without("!?") / n,
        "stops": without(".,;:") / n,
        "distinct_words": F.size(F.array_distinct(words)) / k,
        "function_words": F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS))) / k,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_a_line": k / F.size(lines),
    }


NAMES = ("log_chars", "log_words", "mean_word", "capitals", "symbols", "digits", "exclaims", "stops", "distinct_words", "function_words", "distinct_lines", "words_a_line")

Rule = tuple[tuple[str, float, bool], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, t, at_most in rule:
        column = x[:, NAMES.index(name)]
        out &= (column <= t) if at_most else (column > t)
    return out


class RuleModel:
    """intercept and rules with weights; an empty model scores every text by the intercept."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def column(self, stats: Column) -> Column:
        """The score as a Spark column over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            condition = None
            for name, t, at_most in rule:
                one = stats[name] <= t if at_most else stats[name] > t
                condition = one if condition is None else condition & one
            total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, l1: float = 0.002, most: int = 60) -> RuleModel:
    """Tree paths as rules, weighed by lasso logistic regression; the `most` heaviest stay."""
    _, trees = gbt.fit_trees(x, y, rounds=rounds, depth=depth, rate=0.3, least=8)
    seen: dict[bytes, Rule] = {}
    for tree in trees:
        for path in tree.paths():
            rule = tuple((NAMES[f], float(t), at_most) for f, t, at_most in path)
            on = holds(rule, x)
            if 0.002 < on.mean() < 0.998:
                seen.setdefault(np.packbits(on).tobytes(), rule)  # rules that agree on all rows count once
    rules = list(seen.values())
    if not rules:
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    z = np.stack([holds(r, x) for r in rules], 1).astype(float)
    b, w = gbt.lasso_logistic(z, y, l1)
    kept = [i for i in np.argsort(-np.abs(w))[:most] if abs(w[i]) > 1e-4]
    # without the penalty's shrinkage, on the rules that stay
    b, w2 = gbt.lasso_logistic(z[:, kept], y, l1 / 20)
    return RuleModel(float(b), [(rules[i], float(v)) for i, v in zip(kept, w2, strict=True) if v])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, usable: Column | None = None) -> RuleModel:
    """usable: which label rows may be learned from; default: crc32(doc_id) mod 5 = 0 is held out.  At most max_rows rows are used (their
    statistics, about 100 bytes each, go to the driver)."""
    usable = ~held_out(F.col("doc_id"), 5, 0) if usable is None else usable
    rows = sample(docs, labels, label, usable, max_rows)
    got = rows.select("doc_id", "y", *(c.alias(n) for n, c in statistics(F.col("text")).items())).toPandas().sort_values(["doc_id", "log_chars"], kind="stable")
    x, y = got[list(NAMES)].to_numpy(dtype=float), got.y.to_numpy(dtype=float)
    return fit_rules(x, y)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3, score_col: str = "score", flag_col: str = "predicted") -> DataFrame:
    """docs plus score (0 to 1, higher: better) and predicted (1 if score >= threshold).

    Null and empty texts count as texts without words and get a score too; repeated rows score alike;
    without labels every score is one constant; columns of the result's names are replaced.
    """
    docs = docs.drop(score_col, flag_col)
    docs = docs.withColumn("__stats", F.struct(*(c.alias(n) for n, c in statistics(F.col("text")).items())))
    return docs.withColumn(score_col, model.column(F.col("__stats"))).withColumn(flag_col, (F.col(score_col) >= threshold).cast("int")).drop("__stats")
