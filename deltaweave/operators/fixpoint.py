"""Semi-naive iteration: the one operator behind all solvers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.storage import stored


def semi_naive(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 1000, on_round: Callable[[int, DataFrame], bool] | None = None) -> DataFrame:
    """The least set that holds `seed` and is closed under `step(delta, seen)`.

    Each round joins only the new rows.  Rounds end when nothing is new or when
    on_round(number, delta) gives False (stepping, time limits); max_rounds without a fixpoint raise an error.  Rows must be comparable as a whole."""
    delta = stored(seed.distinct())
    parts = [delta]
    for n in range(max_rounds):
        if on_round and not on_round(n, delta):
            break
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        fresh = step(delta, seen).select(*seed.columns).distinct()
        same = [fresh[c].eqNullSafe(seen[c]) for c in seed.columns]
        delta = stored(fresh.join(seen, same, "left_anti"))
        if not delta.take(1):
            break
        parts.append(delta)
        if len(parts) > 16:  # few files a scan
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            parts = [stored(whole)]
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Transitive closure (source, target) by doubling: logarithmically many rounds."""
    def step(delta: DataFrame, seen: DataFrame) -> DataFrame:
        a, b = delta.toDF("x", "y"), seen.toDF("u", "v")
        right = a.join(b, a.y == b.u).selectExpr(f"x as {source}", f"v as {target}")
        left = b.join(a, a.x == b.v).selectExpr(f"u as {source}", f"y as {target}")
        return right.unionByName(left)

    return semi_naive(edges.select(source, target), step)
