"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed lexicon and of lexicons learned from the labelled rows
(words and word beginnings), the nearest second-person pronoun to a lexicon hit, rates of capitals,
punctuation and obfuscation (digits or symbols inside words, which are also undone before the lexicon
lookup).

Fitting: at most `max_rows` labelled rows (the lowest by a hash of doc_id; a documented bound) take part.
Their terms are counted on the executors in two folds; the terms that a likelihood ratio clears form the learned lexicon.  The
features of fitting rows use the lexicon of the other fold, so the trees see what unseen texts look like.
One row in four only calibrates.  Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt

#: General insults and slurs of low grade in four languages.
LEXICON = frozenset("""
idiot idiots idiotic moron morons moronic loser losers scum trash garbage stupid stupidity worthless disgusting pathetic
clown clowns dumb dumbass imbecile jerk creep filth filthy vermin parasite ugly fool fools hate bastard bitch crap damn
freak fuck fucking shit retard retarded pig pigs rat scumbag shut kys sucker twat whore wanker
idiote idiotes imbécile abruti débile salaud salope connard connasse merde ordure pourriture nul
dumm dummkopf trottel arschloch scheiße scheisse abschaum müll vollidiot depp miststück
idiota estúpido estúpida imbécil tonto tonta basura escoria mierda cabrón pendejo asqueroso inútil
""".split())
#: Second-person pronouns in four languages.
SECOND = frozenset("you your yours yourself u ur tu toi vous votre ton ta tes du dich dir dein deine ihr euch usted tú ti tuyo vosotros".split())
#: Look-alikes that obfuscation uses.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
TOKEN = re.compile(r"[\w@$!|*]*\w[\w@$*]*")
PREFIXES = (4, 5, 6)
NAMES = ("fixed_count", "fixed_density", "learned_count", "learned_density", "prefix_count", "prefix_density", "nearest_second", "second_density", "capital_rate", "punct_rate", "exclaim_rate", "obfuscated_rate", "log_words", "hit_any")
#: Learned terms at most, by strength (about 1 MB in each task).
MAX_TERMS = 20_000


def terms_of(text: str | None) -> list[str]:
    """Words in lower case; tokens with digits or symbols inside letters also in plain letters."""
    out = []
    for w in TOKEN.findall((text or "").lower()):
        out.append(w if w.isalpha() else undone(w))
    return out


def undone(w: str) -> str:
    plain = w.rstrip("!|").translate(LOOKALIKE).replace("*", "")
    return plain if any(c.isalpha() for c in w) else w


def stems(words: set[str]) -> set[str]:
    """The words, and their beginnings marked by a trailing `*`."""
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


@functools.cache
def classes() -> np.ndarray:
    """For each character of the basic plane: 1 letter, 2 capital letter, 3 neither letter, digit, underscore nor space."""
    out = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            out[i] = 2 if c.isupper() else 1
        elif not (c.isalnum() or c.isspace() or c == "_"):
            out[i] = 3
    return out


class Known(dict):
    """token -> (fixed, learned weight, weight of the beginning, obfuscated, second person), or None if nothing holds."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned

    def __missing__(self, token: str):
        odd = not token.isalpha() and any(map(str.isalpha, token))
        w = undone(token) if odd else token
        get = self.learned.get
        found = (w in LEXICON, get(w, 0.0), max((get(w[:k] + "*", 0.0) for k in PREFIXES if len(w) > k), default=0.0), odd, w in SECOND)
        v = self[token] = found if any(found) else None
        return v


def features(text: str | None, known: Known) -> list[float]:
    text = text or ""
    raw = TOKEN.findall(text.lower())
    n = len(raw)
    if not n:
        return [0.0] * 6 + [99.0] + [0.0] * 7
    if len(known) > 400_000:
        known.clear()
    fixed = learned = starts = odd = 0
    weight = start_weight = 0.0
    hits, second = [], []
    for i, k in enumerate(map(known.__getitem__, raw)):
        if k:
            fixed += k[0]
            learned += k[1] > 0
            weight += k[1]
            starts += k[2] > 0
            start_weight += k[2]
            odd += k[3]
            if k[4]:
                second.append(i)
            if k[0] or k[1] or k[2]:
                hits.append(i)
    near = 99.0
    if hits and second:
        a, b = np.array(hits), np.array(second)
        p = np.searchsorted(b, a)
        near = float(min(np.abs(b[np.minimum(p, len(b) - 1)] - a).min(), np.abs(b[np.maximum(p - 1, 0)] - a).min(), 99))
    points = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    count = np.bincount(classes()[points], minlength=4)
    letters = max(int(count[1] + count[2]), 1)
    return [fixed, fixed / n, learned, weight / n, starts, start_weight / n, near, len(second) / n, count[2] / letters, count[3] / len(text), text.count("!") / n, odd / n, float(np.log1p(n)), float(bool(hits))]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """The fitting rows (doc_id, text, y): labelled, usable, at most max_rows.  The label table is cut to its
    bound first and broadcast (under 1 MB), so only these rows' texts are shuffled.  Of a repeated doc_id the text with the smallest
    hash counts."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("double").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", F.col("__y").alias("y")).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def learn_terms(rows: DataFrame, least: int = 4, strength: float = 12.0) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Lexicons from fold 0, from fold 1 and from both: term -> weight."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for i, t, y in zip(b.doc_id, b.text, b.y, strict=True):
                k = 2 * (int(i) % 2) + int(y)
                for w in stems(set(terms_of(t))):
                    counts.setdefault(w, [0, 0, 0, 0])[k] += 1
            yield pd.DataFrame([(w, *c) for w, c in counts.items()], columns=["term", "n0", "p0", "n1", "p1"])

    base = {(r["f"], int(r["y"])): r["count"] for r in rows.select((F.col("doc_id") % 2 != 0).cast("int").alias("f"), "y").groupBy("f", "y").count().collect()}
    tot = [base.get((f, y), 0) for f in (0, 1) for y in (0, 1)]
    counted = rows.mapInPandas(spread, "term string, n0 long, p0 long, n1 long, p1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")))
    n, p = F.col("n0") + F.col("n1"), F.col("p0") + F.col("p1")
    all_n, all_p = max(tot[0] + tot[2], 1), max(tot[1] + tot[3], 1)
    ratio = (p / all_p) / ((n + 0.5) / all_n)
    top = counted.where((p >= least) & (ratio > 8)).orderBy((p * F.log(ratio)).desc(), "term").limit(MAX_TERMS).collect()

    def lexicon(pick) -> dict[str, float]:
        n0, p0 = (max(pick(*tot)[k], 1) for k in (0, 1))
        out = {}
        for r in top:
            neg, pos = pick(r.n0, r.p0, r.n1, r.p1)
            odds = (pos / p0) / ((neg + 0.5) / n0)
            # under equal chances a term is this positive once in exp(strength) terms
            rare = pos * np.log((pos + neg) and (pos / (pos + neg)) / (p0 / (p0 + n0)) or 1e-9) if pos else 0
            if pos >= 3 and odds > 8 and rare > strength:
                out[r.term] = float(min(np.log(odds), 8))
        return out

    return lexicon(lambda n0, p0, n1, p1: (n0, p0)), lexicon(lambda n0, p0, n1, p1: (n1, p1)), lexicon(lambda n0, p0, n1, p1: (n0 + n1, p0 + p1))


class Model:
    """learned: lexicon; base and trees: boosting; knots: calibration."""

    def __init__(self, learned, base, trees, knots):
        self.learned, self.base, self.trees, self.knots = learned, base, trees, knots

    @functools.cached_property
    def known(self) -> Known:
        return Known(self.learned)

    def score(self, texts) -> np.ndarray:
        texts = list(texts)
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.known) for t in texts], dtype=float)
        return np.clip(np.interp(gbt.margin(self.base, self.trees, x), *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, usable: Column | None = None) -> Model:
    """usable: which label rows may be learned from (a condition on doc_id); default: remainder 2 of 4 held out."""
    usable = ~held_out(F.col("doc_id"), 4, 2) if usable is None else usable
    rows = sample(docs, labels, label, usable, max_rows)
    zero, one, both = learn_terms(rows)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other = Known(one), Known(zero)  # the lexicon of the other fold
        for b in batches:
            x = [features(t, other[int(i) % 2]) for i, t in zip(b.doc_id, b.text, strict=True)]
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "x": x})

    got = rows.mapInPandas(dense, "doc_id long, y double, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got.x.tolist(), dtype=float).reshape(len(got), len(NAMES))
    y = got.y.to_numpy()
    # calibrated on margins of trees that have not seen the row: four folds, at every size
    fold = pd.util.hash_array(got.doc_id.to_numpy().astype("int64")) % 4
    apart = np.zeros(len(y))
    for k in range(4):
        apart[fold == k] = gbt.margin(*gbt.fit_trees(x[fold != k], y[fold != k]), x[fold == k])
    return Model(both, *gbt.fit_trees(x, y), gbt.isotonic(apart, y))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, score_col: str = "score", flag_col: str = "predicted") -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts get the score of a text without words; every text is read whole; repeated rows
    score alike; without any labels all scores are one constant; columns of the result's names are replaced.
    """
    docs = docs.drop(score_col, flag_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TERMS and the number of trees

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for s in parts:
            yield pd.Series(own.score(s))

    # not the text, its score: the other columns stay in the JVM
    return docs.withColumn(score_col, scored("text")).withColumn(flag_col, (F.col(score_col) >= threshold).cast("int"))
