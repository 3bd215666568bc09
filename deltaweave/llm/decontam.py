"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters (lower case, single spaces) may occur with up to e = floor(rate * n) edits.
It is split into e + 1 pieces: at least one of them is intact in every such occurrence.  An Aho-Corasick
automaton finds all piece hits in a text; each hit fixes where the item would lie, hits that agree on the place are
merged, and Myers' bit-parallel algorithm verifies the window.

The items go to the executors in blocks of bounded size, one pass over the texts for each block.  There is no shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items in one broadcast block (its automaton takes about 100 times as many bytes).
BLOCK_CHARS = 1_000_000
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """e + 1 pieces (offset, piece) that cover the item, of nearly equal length."""
    n = int(rate * len(item)) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(distance, end) of the best occurrence of pattern as a substring of text, the first of the best;
    (most + 1, 0) if none has a distance of at most `most`."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, min(m, most + 1), 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask  # the pattern may start anywhere: no carry into the first row
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """items: (item_id, normal text), none empty."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.rate = items, rate
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces(text, rate):
                found.setdefault(piece, []).append((k, offset))
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item index, distance, start, end) of the best occurrence of each item in a normal text;
        start is the earliest place the window allows for."""
        if not len(self.automaton):
            return []
        places: dict[int, set[int]] = {}
        for at, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                places.setdefault(k, set()).add(at + 1 - length - offset)
        out = []
        for k, starts in places.items():
            item = self.items[k][1]
            most = int(self.rate * len(item))
            best = (most + 1, 0, 0)
            low = high = None
            for s in [*sorted(starts), None]:
                if low is not None and (s is None or s - high > 2 * most + 1):
                    a, b = max(0, low - most), min(len(text), high + len(item) + most)
                    window = text[a:b]
                    exact = window.find(item)
                    if exact >= 0:
                        d, e = 0, exact + len(item)
                    elif most:
                        d, e = myers(item, window, most)
                    else:
                        d, e = 1, 0
                    if d < best[0]:
                        best = (d, max(0, a + e - len(item) - d), a + e)
                    low = None
                    if best[0] == 0:
                        break
                if s is not None:
                    low = s if low is None else low
                    high = s
            if best[0] <= most:
                out.append((k, *best))
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of at most block_chars characters (one item at least)."""
    out: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in benchmark.select(F.col(id_col).cast("long"), text_col).where(f"{text_col} is not null").distinct().sort(id_col, text_col).toLocalIterator():
        text = normal(r[1])
        if text and r[0] is not None:
            if out[-1] and size + len(text) > block_chars:
                out.append([])
                size = 0
            out[-1].append((r[0], text))
            size += len(text)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best occurrence of each item in each text, if it has
    at most floor(rate * length) edits.  start and end count characters of the normal text; end is exact, start is within
    `distance` characters.

    Null and empty texts and items match nothing; an item with a null id takes no part; repeated rows are matched
    each; an item id with several texts gives a row for each that matches; other columns are ignored; an empty table
    on either side gives no rows.
    """
    spark = docs.sparkSession
    found = [spark.createDataFrame([], SCHEMA)]
    for block in blocks(benchmark, "item_id", "text", block_chars):
        if not block:
            continue
        shared = spark.sparkContext.broadcast(block)  # block_chars characters at most

        def match(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = None
            for b in batches:
                matcher = matcher or Matcher(shared.value, rate)
                rows = []
                for i, t in zip(b.doc_id, b.text, strict=True):
                    rows += [(i, matcher.items[k][0], d, s, e) for k, d, s, e in matcher.matches(normal(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"])

        hits = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(match, SCHEMA)
        found.append(hits)
    return functools.reduce(DataFrame.unionByName, found[1:] or found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows whose text has an item of the benchmark, in one pass without a shuffle; other rows stay as they are."""
    rate, block_chars = how.get("rate", 0.08), how.get("block_chars", BLOCK_CHARS)
    text_col = how.get("text_col", "text")
    spark = docs.sparkSession
    for block in blocks(benchmark, "item_id", "text", block_chars):
        if not block:
            continue
        docs = docs.where(~holder(spark.sparkContext.broadcast(block), rate)(text_col))
    return docs


def holder(shared, rate: float):
    """A Pandas UDF: whether a text holds an item of the broadcast block."""
    @F.pandas_udf("boolean")
    def hit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = None
        for s in parts:
            matcher = matcher or Matcher(shared.value, rate)
            yield pd.Series([bool(matcher.matches(normal(t))) for t in s], dtype=bool)

    return hit
