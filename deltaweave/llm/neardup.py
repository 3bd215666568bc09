"""MinHash near-dedup with BagMinHash signatures over multisets of word shingles.

Signature: every (shingle, dyadic weight interval [0,1), [1,2), [2,4), ...) carries a Poisson process whose rate is
the interval's length; a point has a time, a weight position and a register.  A text with multiplicity w
of the shingle sees the points with position under w, and each register keeps its earliest point.  Two texts agree in a
register with probability equal to their weighted Jaccard similarity.  Times beyond a limit cannot matter once
each register has a point, so long texts draw few points beside one per shingle.

Registers are banded; texts that share a band are candidates, and a link needs a verified multiset overlap of the
shingles.  Buckets are not expanded into pairs: each round compares some centres of a bucket with the members that
are not yet in the centre's component, first the member that shares most buckets with others, then 32 times as many members
in each further round.  A centre that met all others leaves its bucket.  A bucket ends when it is one component or all were
centres, so no link between components is lost, however large the bucket.  Three exact bounds spare comparisons.  The smaller
multiset must reach the threshold times the larger.  One minus the weighted Jaccard similarity is a metric, so the
similarities of both texts to the bucket's first centre may differ by one minus the threshold at most.  And large buckets that
the first round leaves in several components (texts around one common passage, say) are dealt anew by prefix tokens:
linked texts share a shingle among the rarest of both (a ninth of each text if all are of one size, a fifth at most), and from
the first of these shingles on either text still holds the overlap that the two totals ask for.
Components come from label propagation with shortcuts, cut by files in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, digest_of, drop_materialised, materialise, observed, words_of

BANDS, ROWS = 21, 4
#: Buckets over this size are dealt anew after the hub round; also how many times more centres each further round has.
SMALL = 32
#: Counters of shingle frequency, in chunks; 4 MB are sent to the driver and back, whatever the number of texts.
COUNTERS, CHUNK = 1 << 20, 1 << 12
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class WordHashes(dict):
    """Word -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        v = self[word] = word_hash(word)
        return v


class Shingler:
    """Texts to arrays of 64-bit shingle hashes; remembers word hashes up to a bound."""

    def __init__(self, width: int, most_words: int = 400_000):
        self.width, self.most, self.memo = width, most_words, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.memo) > self.most:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for j in range(min(self.width, len(h))):
            out = mix(out * _GOLD + h[j : j + n] + np.uint64(j + 1))
        return out


def bag(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def processes(s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Poisson processes a bag sees: key, rate and the weight up to which points count, by dyadic interval
    [0, 1), [1, 2), [2, 4), ... of the multiplicity."""
    keys, rates, limits = [mix(s + _M2)], [np.ones(len(s))], [np.ones(len(s))]
    low = 1
    while (on := w > low).any():
        part = s[on]
        keys.append(mix(part + np.uint64((low.bit_length() + 1) * int(_M2) % (1 << 64))))
        rates.append(np.full(len(part), float(low)))
        limits.append(np.minimum(w[on] - low, low).astype(float))
        low *= 2
    return np.concatenate(keys), np.concatenate(rates), np.concatenate(limits)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """len(bags) x m point identities (uint64).  Rows of empty bags stay 0."""
    best = np.full(len(bags) * m, np.inf)
    ident = np.zeros(len(bags) * m, np.uint64)
    todo = [i for i, (s, _) in enumerate(bags) if len(s)]
    slack = math.log(m) + 2.0  # a register stays empty with probability exp(-2) / m; then the horizon is doubled
    while todo:
        seen = [processes(*bags[i]) for i in todo]
        size = np.array([len(k) for k, _, _ in seen])
        key = np.concatenate([k for k, _, _ in seen])
        rate = np.concatenate([r for _, r, _ in seen])
        limit = np.concatenate([x for _, _, x in seen])
        base = np.repeat(np.array(todo) * m, size)
        end = np.repeat(np.array([m * slack / float(bags[i][1].sum()) for i in todo]), size)
        at, time = np.arange(len(key)), np.zeros(len(key))
        plain = bool((rate == 1).all())
        points = []
        while len(at):
            key = mix(key + _GOLD)
            step = np.log(unit(key))
            time = time - (step if plain else step / rate[at])
            live = np.flatnonzero(time < end[at])
            key, at, time = key[live], at[live], time[live]
            two = mix(key ^ _M1)
            slot = base[at] + ((two >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            if plain:
                points.append((slot, time, key))
            else:  # only points whose weight position lies under the multiplicity
                ok = np.flatnonzero((two & np.uint64(0xFFFFFFFF)).astype(np.float64) * (1.0 / (1 << 32)) * rate[at] < limit[at])
                points.append((slot[ok], time[ok], key[ok]))
        slot, time, key = (np.concatenate(c) for c in zip(*points, strict=True))
        np.minimum.at(best, slot, time)
        first = time == best[slot]
        ident[slot[first]] = key[first]
        rows = best.reshape(len(bags), m)
        todo = [i for i in todo if np.isinf(rows[i]).any()]
        slack *= 2
    return ident.reshape(len(bags), m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def banded(batches: Iterator[pd.DataFrame], width: int, bands: int, rows: int) -> Iterator[pd.DataFrame]:
    """Batches (node, text) to (node, bands): one 64-bit hash for each band; none for texts without words."""
    shingle = Shingler(width)
    for b in batches:
        for at in range(0, len(b), 512):
            part = b.iloc[at : at + 512]
            bags = [bag(shingle(t)) for t in part.text]
            sig = signatures(bags, bands * rows).reshape(len(part), bands, rows)
            h = np.zeros((len(part), bands), np.uint64)
            for r in range(rows):
                h = mix(h * _GOLD + sig[:, :, r] + np.uint64(r + 1))
            h = h.view(np.int64)
            yield pd.DataFrame({"node": part.node, "bands": [list(v) if len(s) else [] for v, (s, _) in zip(h, bags, strict=True)]})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps until the edges stay the same (their count and checksums, taken as they are
    written); the edges are files in the shared folder.  Neighbour lists are never gathered: a step is a minimum by node and a join.
    """
    def sides(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame) -> DataFrame:
        both = sides(e)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").repartition("a").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))  # dealt by a already, as is the join
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        return small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()

    mark = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("a", "b")), "s": F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))}
    start = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = observed(star(start), "cc", **mark)
    for _ in range(most_rounds):
        new, now = observed(star(edges), "cc", **mark)
        drop_materialised(edges)
        edges = new
        if now == before:  # the same edges: a star forest
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def measured(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) with the overlap `s` of their multisets."""
    left = bags.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = bags.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    met = pairs.join(left, "a").join(right, "b")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(h, c):
            shingles = np.frombuffer(h, np.uint64)
            return shingles, np.frombuffer(c, np.int32) if len(c) else np.ones(len(shingles), np.int32)

        for t in batches:
            s = [similarity(read(p, q), read(r, s)) for p, q, r, s in zip(t.ha, t.ca, t.hb, t.cb, strict=True)]
            yield pd.DataFrame({"a": t.a, "b": t.b, "s": np.array(s, float)})

    return met.select("a", "b", "ha", "ca", "hb", "cb").mapInPandas(measure, "a binary, b binary, s double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row of docs; class_id is the smallest doc_id of the class.

    Equal texts are of one class; different texts are linked when the weighted Jaccard similarity of their
    multisets of `width`-word shingles reaches the threshold (texts of fewer words are one shingle).
    Texts without words are linked to equal texts only, null and empty texts to none.  A null
    doc_id stays null and forms no smallest id unless all ids of the class are null.  Repeated rows stay
    repeated.  Other columns are ignored.  A pair at the threshold is missed by the bands with probability
    (1 - threshold^rows)^bands, 2e-5 here.
    """
    return classed(docs, threshold, width, bands, rows, id_col, text_col).select("doc_id", "class_id")


def classed(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates with the text's digest (node) and the class's own (root); root and class_id together name a class,
    as one doc_id may be the smallest of several."""
    base = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    light = base.select("doc_id", "node", (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("blank"))
    sig = base.select("node", "text").mapInPandas(lambda it: banded(it, width, bands, rows), "node binary, bands array<long>")
    sig = materialise(sig.where("size(bands) > 0"), "bag-bands")
    keyed = sig.select("node", F.posexplode("bands").alias("band", "h")).distinct()
    keyed = keyed.select("node", F.xxhash64("band", "h").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("bucket")
    members = materialise(keyed.join(shared, "bucket"), "bag-members")
    drop_materialised(sig)
    roots = None
    if members.take(1):
        roots = link_members(members, base, threshold, width)
    nodes = light.groupBy("node").agg(F.min("doc_id").alias("first"))
    if roots is None:
        classes = nodes.select("node", F.col("node").alias("root"), F.col("first").alias("class_id"))
    else:
        placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = placed.groupBy("root").agg(F.min("first").alias("class_id"))
        classes = placed.join(smallest, "root").select("node", "root", "class_id")
    out = light.join(classes, "node")
    return out.select("doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "node", "root")


def least_partner(large: DataFrame, threshold: float) -> DataFrame:
    """(node, deg, total, partner): partner is a lower bound of the totals of those that the node could be linked with in its
    buckets.  Totals go by classes 2 % wide, of which a bucket has a thousand at most."""
    step = math.log(1.02)
    kind = lambda total: F.floor(F.log(total) / step)
    sizes = large.groupBy("bucket").agg(F.collect_set(kind(F.col("total"))).alias("kinds"))
    lowest = kind(F.greatest(F.col("total") * threshold, F.lit(1.0)))
    met = large.join(sizes, "bucket").withColumn("kind", F.array_min(F.filter("kinds", lambda k: k >= lowest)))
    bound = F.greatest(F.exp(F.col("kind") * step) * (1 - 1e-9), F.col("total") * threshold)
    return met.groupBy("node").agg(F.first("deg").alias("deg"), F.first("total").alias("total"), F.min(bound).alias("partner"))


def shingle_counts(bags: DataFrame) -> np.ndarray:
    """In how many of these bags a shingle of each of the counters occurs; COUNTERS numbers, whatever the number of bags."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(COUNTERS, np.int64)
        for t in batches:
            for h in t.hashes:
                np.add.at(n, (np.frombuffer(h, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        yield from chunks(n.reshape(-1, CHUNK))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[int, np.ndarray] = {}
        for t in batches:
            for c, at, k in zip(t.chunk, t["at"], t.n, strict=True):
                n.setdefault(c, np.zeros(CHUNK, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(k, np.int32)
        for c, row in n.items():
            yield from chunks(row[None], c)

    def chunks(rows: np.ndarray, first: int = 0) -> Iterator[pd.DataFrame]:
        for c, row in enumerate(rows, first):
            at = np.flatnonzero(row)
            if len(at):
                yield pd.DataFrame({"chunk": [c], "at": [at.astype(np.uint16).tobytes()], "n": [np.minimum(row[at], (1 << 31) - 1).astype(np.int32).tobytes()]})

    schema = "chunk int, at binary, n binary"
    parts = bags.select("hashes").mapInPandas(count, schema).repartition("chunk").mapInPandas(add, schema)
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.int32)
    for r in parts.toLocalIterator():
        out[r.chunk, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r.n, np.int32)
    return out.ravel()


def prefix_tokens(large: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, n0, deg, total, left, p): for the nodes of these buckets the rare shingles of the bag of which two linked
    bags share one, as new buckets, and the weight of the bag from there on.

    Shingles are ordered by their counter's frequency in these bags, then by hash.  The first common shingle of two linked bags
    has the whole overlap from it onwards, and so at least the overlap that the two totals ask for.  A shingle whose counter is 1
    is in one bag only and is left out."""
    mine = materialise(bags.select("node", "hashes", "counts").join(least_partner(large, threshold), "node"), "bag-large")
    often = mine.sparkSession.sparkContext.broadcast(shingle_counts(mine))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for node, h, c, deg, total, partner in zip(t.node, t.hashes, t.counts, t.deg, t.total, t.partner, strict=True):
                h = np.frombuffer(h, np.uint64)
                w = np.frombuffer(c, np.int32).astype(np.int64) if len(c) else np.ones(len(h), np.int64)
                n = often.value[(h % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((h, n))
                left = w[order][::-1].cumsum()[::-1]
                keep = (left >= (total + partner) * (threshold / (1 + threshold) - 1e-9)) & (n[order] > 1)
                yield pd.DataFrame({"bucket": h[order][keep].view(np.int64), "node": [node] * int(keep.sum()), "deg": deg, "total": total, "left": left[keep]})

    dealt = mine.mapInPandas(tokens, "bucket long, node binary, deg long, total long, left long")
    return dealt.select("bucket", "node", F.lit(0).cast("long").alias("n0"), "deg", "total", "left", F.lit(None).cast("double").alias("p"))


def link_members(members: DataFrame, base: DataFrame, threshold: float, width: int) -> DataFrame | None:
    """Rounds of centres; (node, root) of the linked nodes, None without links."""
    def to_bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for b in batches:
            bags = [bag(shingle(t)) for t in b.text]
            counts = [w.astype(np.int32).tobytes() if (w > 1).any() else b"" for _, w in bags]  # none: all are 1
            yield pd.DataFrame({"node": b.node, "hashes": [s.tobytes() for s, _ in bags], "counts": counts, "total": [int(w.sum()) for _, w in bags]})

    def unsolved(of: DataFrame) -> tuple[DataFrame, int]:
        """The members of buckets that hold two components or more, and how many rows these are."""
        now = of.withColumn("root", F.col("node")) if roots is None else of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("node", F.struct("deg", "node")).alias("first"), F.count("*").alias("n")).where("lo != hi")
        return counted(now.join(split.select("bucket", "first", "n"), "bucket"), "bag-round")

    wanted = members.select("node").distinct()
    texts = base.select("node", "text").dropDuplicates(["node"]).join(wanted, "node", "left_semi")
    bags = materialise(texts.mapInPandas(to_bags, "node binary, hashes binary, counts binary, total long"), "bags")
    first = members
    sized = members.join(members.groupBy("bucket").agg(F.count("*").alias("n0")), "bucket")
    about = sized.groupBy("node").agg(F.sum("n0").alias("deg")).join(bags.select("node", "total"), "node")
    members = materialise(sized.join(about, "node").withColumn("left", F.col("total")).withColumn("p", F.lit(None).cast("double")), "bag-members")
    drop_materialised(first)
    roots, number, tried = None, 1, None
    while True:
        now, rows = unsolved(members)
        drop_materialised(members)
        if number == SMALL and rows:  # the hub round is over: what large buckets left unsolved is dealt anew
            kept, large = now.where(F.col("n0") <= SMALL), now.where(F.col("n0") > SMALL)
            dealt = prefix_tokens(large, bags, threshold)
            members = materialise(kept.select(*dealt.columns).unionByName(dealt), "bag-members")
            drop_materialised(now)
            now, rows = unsolved(members)
            drop_materialised(members)
        if not rows:
            break
        # this round's centres: the hub, and later about `number` members chosen by hash
        chance = F.pmod(F.xxhash64("node", F.lit(number)), F.col("n"))
        centre = now.where((F.col("node") == F.col("first")) | (chance < number - 1)).select("bucket", F.col("node").alias("c"), F.col("root").alias("cr"), F.col("total").alias("ct"), F.col("left").alias("cl"), F.col("p").alias("cp"))
        overlap = F.least("left", "cl") >= (F.col("total") + F.col("ct")) * (threshold / (1 + threshold) - 1e-9)
        reachable = overlap & (F.least("total", "ct") >= F.greatest("total", "ct") * (threshold - 1e-9)) & (F.coalesce(F.abs(F.col("p") - F.col("cp")), F.lit(0.0)) <= 1 - threshold + 1e-9)
        pairs = now.join(centre, "bucket").where("root != cr").where(reachable).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        linked = F.col("s") >= threshold
        seen, figures = observed(measured(pairs, bags), "bag-pairs", links=F.count_if(linked))
        if figures["links"]:
            # earlier links are in the roots, which are a star forest already
            found = seen.where(linked).select("a", "b")
            links = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            before, roots = roots, materialise(components(links), "bag-roots")
            if before is not None:
                drop_materialised(before)
        # who was compared with all others of the bucket leaves it
        rest = now.join(centre.select("bucket", F.col("c").alias("node")), ["bucket", "node"], "left_anti")
        if tried is None:  # the pivot's similarities
            pivot = seen.select("a", "b", "s")
            rest = rest.withColumns({"a": F.least("node", "first"), "b": F.greatest("node", "first")}).drop("p").join(pivot, ["a", "b"], "left").withColumnRenamed("s", "p")
        members = materialise(rest.select("bucket", "node", "n0", "deg", "total", "left", "p"), "bag-members")
        tried = seen.select("a", "b") if tried is None else tried.unionByName(seen.select("a", "b"))
        drop_materialised(now)
        number *= SMALL
    drop_materialised(bags)
    return roots


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class: the row with the smallest doc_id (of repeated rows, one; of several texts
    of the class with that doc_id, the one with the smallest digest).

    Rows go by doc_id and text, so that a doc_id on unrelated texts stays on each.  Rows with a null doc_id stay unless
    their class has an id."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    rows = materialise(classed(docs, **how).groupBy("doc_id", "class_id", "node", "root").agg(F.count("*").alias("n")), "bag-classes")
    heads = rows.where("doc_id = class_id")
    firsts = heads.groupBy("root", "class_id").agg(F.min("node").alias("first"))
    heads = heads.join(firsts, ["root", "class_id"])
    gone = rows.where("class_id is not null and (doc_id is null or doc_id != class_id)").select("doc_id", "node")
    gone = gone.unionByName(heads.where("node != first").select("doc_id", "node")).toDF("__gone", "__node")
    digest = digest_of(docs[text_col])
    kept = docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")) & (digest == F.col("__node")), "left_anti")
    twice = heads.where("node = first and n > 1").select(F.col("doc_id").alias("__twice"), F.col("node").alias("__node"))
    if not twice.take(1):
        return kept
    same = (docs[id_col] == F.col("__twice")) & (digest == F.col("__node"))
    again = kept.join(twice, same, "left_semi").withColumn("__text", digest).dropDuplicates([id_col, "__text"]).drop("__text")
    return kept.join(twice, same, "left_anti").unionByName(again)
