"""Approximate nearest neighbours by largest inner product: an inverted file whose lists are scanned
adaptively.

Equal vectors form one class, which is searched once.  Classes are dealt to the nearest of about sqrt(n)
centroids (k-means on a bounded sample).  How many lists a query probes is measured: a bounded sample of queries is compared
with all rows, and the least number of lists that holds the wanted share of their neighbours is taken.

Vectors are rotated by a random orthogonal matrix and scanned in blocks of columns, many queries side by side.  Over d of D
columns of a random rotation the partial inner product of vectors q, x with inner product s has mean s d / D and variance
d (D - d) / (D (D - 1) (D + 2)) (|q|^2 |x|^2 + s^2 (D - 2) / D).  After each block the hypothesis that a candidate reaches the
query's current k-th best is tested, and the candidate is abandoned when its partial product lies `sigma` deviations under
what a candidate just as good would show (by chance 1 of 740 true neighbours at 3 deviations, whatever the data).  A
query's first lists are scanned before its others, which begin with the k-th best found there and give no row below
it.  Whoever survives is scored in double precision on the original vectors.

Lists are packed into cells of bounded rows (a longer list is cut), queries into bounded blocks; a cell and a block that
probes it are one task's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import counted, materialise

BLOCK = 16
CELL_ROWS, QUERY_ROWS, TILE = 4096, 8192, 512
#: Below this share of survivors single pairs are carried on instead of whole blocks.
SPARSE = 0.1


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: id and vector not null, no component
    null or non-finite, not all zero, of the table's most frequent dimension.  Repeated rows count once."""
    v = F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.where(F.size("v") == (top.d if top else 0))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T - 0.5 * (c * c).sum(1), 1) for part in np.array_split(x, -(-len(x) // 2048))])
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def scan(q: np.ndarray, x: np.ndarray, bar: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x, inner product) of rotated vectors that reach the queries' bars and are not abandoned."""
    dims = x.shape[1]
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    slack = 1e-9 * (1.0 + np.sqrt(qq * xx.max(initial=0.0)))  # rounding of rotated sums
    least = bar - slack
    some = np.isfinite(bar).any()
    square = np.where(np.isfinite(bar), bar, 0.0) ** 2 * ((dims - 2) / dims)

    def floor(d: int, i=None, j=None) -> np.ndarray:
        """What a partial product over d columns must reach: of all pairs, or of the pairs (i, j)."""
        width = sigma * np.sqrt(d * (dims - d) / (dims * (dims - 1) * (dims + 2)))
        if i is None:
            return (least * (d / dims))[:, None] - width * np.sqrt(np.multiply.outer(qq, xx) + square[:, None])
        return least[i] * (d / dims) - width * np.sqrt(qq[i] * xx[j] + square[i])

    total, alive, end = np.zeros((len(q), len(x))), None, 0
    while end < dims:
        at, end = end, min(end + BLOCK, dims)
        total += q[:, at:end] @ x[:, at:end].T
        if end < dims and some:
            fits = total >= floor(end)
            alive = fits if alive is None else alive & fits
            if alive.mean() < SPARSE:
                break
    if alive is None:
        i, j = np.nonzero(total >= least[:, None])
    else:
        i, j = np.nonzero(alive)
    s = total[i, j]
    while end < dims:
        at, end = end, min(end + BLOCK, dims)
        s = s + np.einsum("ij,ij->i", q[i, at:end], x[j, at:end])
        if end < dims:
            keep = s >= floor(end, i, j)
            i, j, s = i[keep], j[keep], s[keep]
    keep = s >= least[i]
    return i[keep], j[keep], s[keep]


def leading(i: np.ndarray, s: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest s of each i, ties to the smaller tie."""
    order = np.lexsort((tie, -s, i))
    begin = np.concatenate([[True], i[order][1:] != i[order][:-1]])
    place = np.arange(len(order))
    return order[place - np.maximum.accumulate(np.where(begin, place, 0)) < k]


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def packed(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first cell and the number of cells it is cut into; small lists share a cell."""
    first, parts, cell, room = np.zeros(len(count), int), -(-count // CELL_ROWS), 0, CELL_ROWS
    for i, n in enumerate(count):
        if n > room and room < CELL_ROWS:
            cell, room = cell + 1, CELL_ROWS
        first[i] = cell
        if n > CELL_ROWS:
            cell += int(parts[i])
        else:
            room -= int(n)
    return first, np.maximum(parts, 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, sigma: float = 3.0, sample_rows: int = 20_000, sample_queries: int = 128, max_lists: int = 4096, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors` with another id
    and the largest inner product that were found; ties go to the smaller id.

    Rows that clean() leaves out take no part.  Lists are probed in order of centroid score: the least number that held `recall` of
    the neighbours of `sample_queries` queries, or as many as hold k + 1 classes.  A query's vector may be repeated in any number
    of rows.  An empty table gives an empty result; other columns are ignored.  The centroids come from `sample_rows` rows at most.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vec_col)
    # one class for each vector: its k + 1 smallest ids (a query needs k besides its own)
    ranked = rows.distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes, n = counted(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]), "ann-classes")
    schema = "query_id long, rank int, vec_id long, score double"
    asked = clean(queries, id_col, vec_col).distinct()
    # queries by their vector's class id: each vector is searched once
    q, nq = counted(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "ann-queries")
    if not n or not nq:
        return spark.createDataFrame([], schema)
    sample = matrix(classes.select("cid", "v").orderBy(F.xxhash64("cid")).limit(sample_rows).toPandas().v)
    dims, nlist = sample.shape[1], int(min(max_lists, max(1, round(n**0.5)), len(sample)))
    center = kmeans(sample, nlist, seed)
    half = 0.5 * (center * center).sum(1)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    some = q.orderBy(F.xxhash64("qid")).limit(sample_queries).toPandas()
    shared = spark.sparkContext.broadcast((center, half, turn, some.qid.to_numpy(), matrix(some.v)))  # (max_lists + dims + sample_queries) * dims numbers at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        center, half, *_ = shared.value
        for b in batches:
            if len(b):
                b["list"] = np.argmax(matrix(b.v) @ center.T - half, 1).astype("int32")
                yield b

    listed = materialise(classes.mapInPandas(assign, "v array<double>, ids array<long>, cid long, list int"), "ann-lists")
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # max_lists rows at most
    count = np.array([sizes.get(i, 0) for i in range(nlist)])

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "cid"))).where(F.col("r") <= k + 1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sampled queries' best rows of a partition."""
        *_, qid, v = shared.value
        best = None
        for b in batches:
            s = v @ matrix(b.v).T if len(b) else np.zeros((len(v), 0))
            i = np.repeat(np.arange(len(v)), s.shape[1])
            new = pd.DataFrame({"i": i, "cid": np.tile(b.cid.to_numpy(), len(v)), "list": np.tile(b["list"].to_numpy(), len(v)), "score": s.ravel()})
            best = new if best is None else pd.concat([best, new])
            best = best.iloc[leading(best.i.to_numpy(), best.score.to_numpy(), best.cid.to_numpy(), k + 1)]
        if best is not None:
            yield pd.DataFrame({"qid": qid[best.i.to_numpy()], "cid": best.cid, "list": best["list"], "score": best.score})

    order = {i: np.argsort(-(center @ v), kind="stable") for i, v in zip(some.qid, shared.value[4], strict=True)}
    true = best_of(listed.select("cid", "v", "list").mapInPandas(compare, "qid long, cid long, list int, score double")).collect()  # sample_queries * (k + 1) rows
    place = np.sort([int(np.flatnonzero(order[r.qid] == r["list"])[0]) for r in true if r.qid != r.cid])
    nprobe = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1 if len(place) else 1
    first, parts = packed(count)
    blocks = max(1, -(-nq // QUERY_ROWS))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        center = shared.value[0]
        for b in batches:
            for at in range(0, len(b), TILE):
                part = b.iloc[at : at + TILE]
                out = []
                # maximal inner product within a list: by the centroid's inner product
                orders = np.argsort(-(matrix(part.v) @ center.T), axis=1, kind="stable")
                for qid, v, order in zip(part.qid, part.v, orders, strict=True):
                    order = order[count[order] > 0]
                    enough = int(np.searchsorted(count[order].cumsum(), k + 1)) + 1
                    early, need = max(min(8, nprobe), enough), max(nprobe, enough)
                    for chosen, soon in ((order[:early], True), (order[early:need], False)):
                        cells: dict[int, list[int]] = {}
                        for i in chosen.tolist():
                            for c in range(first[i], first[i] + parts[i]):
                                cells.setdefault(c, []).append(i)
                        out += [(qid, v, c, own, soon) for c, own in cells.items()]
                yield pd.DataFrame(out, columns=["qid", "v", "cell", "lists", "early"])

    probes = q.mapInPandas(probe, "qid long, v array<double>, cell int, lists array<int>, early boolean")
    probes = materialise(probes.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")), "ann-probes")
    cells = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(nlist)], "list int, first int, parts int")
    celled = listed.join(F.broadcast(cells), "list").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    celled = celled.select("cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "list", "cid", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "cid": [], "score": []}).astype({"qid": "int64", "cid": "int64", "score": "float64"})
        turn = shared.value[2]
        right = right.sort_values(["list", "cid"])
        x, cid, of = matrix(right.v), right.cid.to_numpy(), right["list"].to_numpy()
        xr = x @ turn
        out = []
        for a in range(0, len(left), TILE):
            part = left.iloc[a : a + TILE]
            v, bar = matrix(part.v), part.least.to_numpy(float).copy()
            vr = v @ turn
            asked: dict[int, list[int]] = {}
            for row, own in enumerate(part.lists):
                for i in own:
                    asked.setdefault(int(i), []).append(row)
            kept = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
            for i, who in sorted(asked.items()):
                lo, hi = np.searchsorted(of, [i, i + 1])
                who = np.array(who)
                qi, xj, s = scan(vr[who], xr[lo:hi], bar[who], sigma)
                top = leading(qi, s, cid[lo:hi][xj], k + 1)
                qi, xj, s = qi[top], xj[top], s[top]
                n = np.bincount(qi, minlength=len(who))
                full = np.flatnonzero(n == k + 1)
                bar[who[full]] = np.maximum(bar[who[full]], s[n.cumsum()[full] - 1])  # a bar to go on with
                kept.append((who[qi], lo + xj, s))
            qi, xj, s = (np.concatenate(c) for c in zip(*kept, strict=True))
            near = s >= bar[qi] - 1e-9 * (1.0 + np.abs(bar[qi]))
            qi, xj = qi[near], xj[near]
            s = np.einsum("ij,ij->i", v[qi], x[xj])  # on the original vectors
            top = leading(qi, s, cid[xj], k + 1)
            out.append(pd.DataFrame({"qid": part.qid.to_numpy()[qi[top]], "cid": cid[xj[top]], "score": s[top]}))
        return pd.concat(out)

    def scanned(part: DataFrame) -> DataFrame:
        """The k + 1 best classes of each query in these lists; k + 1 suffice, as their members are ranked for each query row."""
        asking = part.select("qid", "v", "cell", "block", "lists", "least").groupBy("cell", "block")
        return best_of(asking.cogroup(celled.groupBy("cell", "block")).applyInPandas(search, "qid long, cid long, score double"))

    best = materialise(scanned(probes.where("early").withColumn("least", F.lit(float("-inf")))), "ann-first")
    least = best.where(F.col("r") == k + 1).select("qid", F.col("score").alias("least"))
    later = probes.where("not early").join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    best = best_of(best.drop("r").unionByName(scanned(later).drop("r")))
    members = best.join(listed.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    members = members.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") <= k + 1)
    lists = members.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    # back to every row that asked
    keys = asked.join(q, "v").select(F.col("vec_id").alias("query_id"), "qid")
    answers = keys.join(lists, "qid").select("query_id", F.expr(f"slice(filter(near, x -> x.vec_id != query_id), 1, {k})").alias("near"))
    out = answers.select("query_id", F.posexplode("near").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
