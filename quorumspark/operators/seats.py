"""Replacing and adding seats of a panel, by hash order instead of a random stream.

A panel is one row with its seats in an array (panels have some ten seats), and every draw reorders that array: a seat's hash, taken once, times
the draw's own hash modulo a prime. Draws are elements of arrays, so no row is shuffled for them.
"""

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumspark.functions.core import six, u
from quorumspark.operators.panel import CELL

#: Prime modulus of the reordering, and the range of the hashes that it multiplies.
PRIME = (1 << 31) - 1


def draws_of(draws: int, *seeds: str) -> Column:
    """array<struct<r0, r1, ...>>: for each draw a multiplier of every seed; a constant of the plan, written as text so that it is one literal."""
    number = lambda seed, d: int(hashlib.md5(f"{seed}|{d}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1
    text = json.dumps([{f"r{i}": number(seed, d) for i, seed in enumerate(seeds)} for d in range(1, draws + 1)])
    return F.from_json(F.lit(text), "array<struct<" + ", ".join(f"r{i}: bigint" for i in range(len(seeds))) + ">>")


def seats(rows: DataFrame, seed: str, ids: list[str], name: str, keep=None) -> DataFrame:
    """(cell, name array<struct<id, a, rating, *keep>>): each seat's identifier, its hash and its rating (below 16), by identifier."""
    a = u(seed, *CELL, *ids) % (PRIME - 1) + 1
    who = F.concat_ws("|", *(F.col(i).cast("string") for i in ids))
    # all shuffle partitions are used: panels are few bytes but many draws of work
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *CELL)
    return spread.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct(who.alias("id"), a.alias("a"), "rating", *(keep or ())))).alias(name))


def in_order(array: Column, r: Column) -> Column:
    """Ratings of the seats in a draw's order, ties by identifier: one number a seat holds its key, its place and its rating, so numbers are sorted and not structs."""
    keyed = F.transform(array, lambda s, i: (s.a * r % PRIME * (1 << 20) + i) * 16 + s.rating)
    return F.transform(F.sort_array(keyed), lambda k: (k % 16).cast("int"))


def total(ratings: Column, begin: int, n: int) -> Column:
    """Sum of n ratings from the 1-based place `begin` on; null if there are fewer."""
    part = F.slice(ratings, begin, n)
    return F.when(F.size(part) == n, F.aggregate(part, F.lit(0), lambda s, x: s + x))


def removed(ratings: Column, cell_hash: Column, n: Column, r: list[Column]) -> list[Column]:
    """Ratings of up to three different random seats, by the index each has among the seats that are left: no seat but these is looked at."""
    at = [F.pmod(cell_hash * x % PRIME, F.nullif(n - j, F.lit(0))).cast("int") for j, x in enumerate(r)]
    i = at[0]
    j = at[1] + (at[1] >= i).cast("int")
    low, high = F.least(i, j), F.greatest(i, j)
    k = at[2] + (at[2] >= low).cast("int")
    return [F.get(ratings, x) for x in (i, j, k + (k >= high).cast("int"))]


def replacement(ratings: DataFrame, machines: DataFrame, draws: int, ks: list[int], priority: list[str]) -> DataFrame:
    """Per cell and k (at most 3): remove k random coders, add the first k machines by priority; |new mean - full mean| over draws: mean, median and the order statistics at 2.5 and 97.5 %.

    Cells need 2 coders, more than k, and k machines.
    """
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("model"))
    added = machines.where(rank > 0).groupBy(*CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("p"), "rating"))), lambda x: x.rating).alias("ai"))
    panels = seats(ratings, "seat", ["coder"], "seats").where(F.size("seats") >= 2).join(added, CELL)
    panels = panels.withColumns({"n": F.size("seats"), "s": F.aggregate("seats", F.lit(0), lambda t, x: t + x.rating), "ratings": F.transform("seats", lambda x: x.rating), "c": u("cell", *CELL) % (PRIME - 1) + 1})
    gone = F.transform(draws_of(draws, "seat1", "seat2", "seat3"), lambda d: F.array(*removed(F.col("ratings"), F.col("c"), F.col("n"), [d.r0, d.r1, d.r2])))
    panels = panels.select(*CELL, "n", "s", "ai", gone.alias("gone"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), total(F.col("ai"), 1, k).alias("s_ai")) for k in ks)))
    rows = panels.select(*CELL, "n", "s", "gone", each.alias("x")).where("x.s_ai IS NOT NULL AND x.k < n")
    left = lambda o: F.get(o, F.lit(0)) + F.when(F.col("x.k") > 1, F.get(o, F.lit(1))).otherwise(0) + F.when(F.col("x.k") > 2, F.get(o, F.lit(2))).otherwise(0)
    d = F.transform("gone", lambda o: F.abs((F.col("s") - left(o) + F.col("x.s_ai")) / F.col("n") - F.col("s") / F.col("n")))
    return nearest(rows.select(*CELL, "x.k", F.sort_array(d).alias("d")), [*CELL, "k"], "d")


def nearest(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """mean, median, and the order statistics max(0, int(.025 n) - 1) and min(n - 1, int(.975 n)) of a sorted array."""
    n = F.size(values)
    at = lambda i: F.get(values, i.cast("int"))
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return rows.select(*by, mean.alias("mean"), middle.alias("median"), at(F.greatest(F.lit(0), F.floor(n * 0.025) - 1)).alias("lo"), at(F.least(n - 1, F.floor(n * 0.975))).alias("hi"))


def divergence(cells: DataFrame) -> DataFrame:
    return cells.groupBy("k").agg(six(F.avg("mean")).alias("mean"), six(F.avg("lo")).alias("lo"), six(F.avg("hi")).alias("hi"), F.count("*").alias("n_cells"))


def augmentation(scored: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """Shift of a thin panel's mean by one more seat: (r - m) / (n + 1)."""
    return scored.where(F.col("n_coders").between(low, high)).withColumn("shift", F.col("signed_dev") / (F.col("n_coders") + 1))


def degradation(scored: DataFrame, min_coders: int = 9) -> DataFrame:
    """Sum and mean over all seats of the shift (r_ai - r_coder) / n when a machine takes the seat: n * r_ai - sum(r) over n, without the fan-out join."""
    rows = scored.where(F.col("n_coders") >= min_coders)
    return rows.withColumn("shift", (F.col("n_coders") * F.col("rating") - F.col("n_coders") * F.col("raw_mean")) / F.col("n_coders") / F.col("n_coders"))


def dose_augmentation(means: DataFrame, machines: DataFrame, draws: int, top: int) -> DataFrame:
    """(cell, k, shift, size): mean over draws of (sum of k machine ratings - k * mean) / (n + k), and of its size; machines are drawn without replacement."""
    rows = seats(machines, "aug", ["model", "condition"], "ai").join(means.select(*CELL, "raw_mean", "n_coders"), CELL)
    shift = lambda o, k: (total(o, 1, k) - k * F.col("raw_mean")) / (F.col("n_coders") + k)
    return _by_dose(rows, draws, "aug", top, {"shift": lambda d, k: shift(d.ai, k)}, ["ai"]).withColumn("size", F.col("shift_size"))


def _by_dose(rows, draws, seed, top, values, arrays):
    """(cell, k, value, value_size, ...): means over draws of each value and of its size, for k = 1..top; k where a value is null in any draw is left out."""
    drawn = F.transform(draws_of(draws, seed), lambda d: F.struct(*(in_order(F.col(c), d.r0).alias(c) for c in arrays)))
    rows = rows.withColumn("_draws", drawn)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / draws
    at = lambda v, k: F.transform("_draws", lambda d: v(d, k))
    each = [F.struct(F.lit(k).alias("k"), *(at(v, k).alias(n) for n, v in values.items())) for k in range(1, top + 1)]
    out = rows.select(*CELL, F.explode(F.array(*each)).alias("x")).select(*CELL, "x.*")
    return out.select(*CELL, "k", *(c for n in values for c in (mean(F.col(n)).alias(n), mean(F.transform(n, F.abs)).alias(f"{n}_size")))).where(" AND ".join(f"{n} IS NOT NULL" for n in values))


def dose_degradation(ratings: DataFrame, machines: DataFrame, draws: int, top: int, same: tuple, fine_tuned: list[str], min_coders: int = 9) -> DataFrame:
    """(cell, k, same_ai, mixed_ft, mixed_pool and their sizes): mean shift of a panel's mean when k random coders give their seats to one machine k times, or to k
    machines drawn without replacement from the fine-tuned ones or from all. Panels of `min_coders` coders, with `top` machines of either kind and the one."""
    m, c = same
    panel = seats(ratings, "deg", ["coder"], "coders").where(F.size("coders") >= min_coders).withColumn("n", F.size("coders"))
    pool = seats(machines, "deg_ai", ["model", "condition"], "pool", ["model", "condition"])
    rows = panel.join(pool, CELL).withColumn("ft", F.filter("pool", lambda s: s.model.isin(*fine_tuned))).withColumn("a1", F.get(F.filter("pool", lambda s: (s.model == m) & (s.condition == c)), 0).rating)
    rows = rows.where((F.size("ft") >= top) & (F.size("pool") >= top) & F.col("a1").isNotNull())
    gone = lambda d, k: total(d.coders, 1, k)
    values = {"same_ai": lambda d, k: (k * F.col("a1") - gone(d, k)) / F.col("n"), "mixed_ft": lambda d, k: (total(d.ft, 1, k) - gone(d, k)) / F.col("n"), "mixed_pool": lambda d, k: (total(d.pool, 1, k) - gone(d, k)) / F.col("n")}
    return _by_dose(rows, draws, "deg", top, values, ["coders", "ft", "pool"])


def flips(ratings: DataFrame, machines: DataFrame, draws: int, base: int = 4, top: int = 4) -> DataFrame:
    """(cell, arm, k, flip, net): share of draws in which a base panel's verdict changes, and downs less ups.

    Panels of 2 * base coders or more, in hash order: the first `base` are the panel, the next ones held out. Arms: add_ai, add_human (k
    more seats), replace_ai, replace_human (k of the base seats). Machines are drawn without replacement; a panel needs `top` of them.
    """
    panel = seats(ratings, "flip", ["coder"], "coders").where(F.size("coders") >= 2 * base)
    rows = panel.join(seats(machines, "flip_ai", ["model", "condition"], "ai").where(F.size("ai") >= top), CELL)
    verdict = lambda s, n: F.floor(s / n + 0.5)

    def arms(k):
        s, gone, held, ai = (lambda d: total(d.coders, 1, base)), (lambda d: total(d.coders, 1, k)), (lambda d: total(d.coders, base + 1, k)), (lambda d: total(d.ai, 1, k))
        new = {"add_ai": (lambda d: s(d) + ai(d), base + k), "add_human": (lambda d: s(d) + held(d), base + k), "replace_ai": (lambda d: s(d) - gone(d) + ai(d), base), "replace_human": (lambda d: s(d) - gone(d) + held(d), base)}
        moves = lambda f, n: F.transform("_draws", lambda d: verdict(f(d), n) - verdict(s(d), base))
        return [F.struct(F.lit(arm).alias("arm"), F.lit(k).alias("k"), moves(f, n).alias("moves")) for arm, (f, n) in new.items()]

    rows = rows.withColumn("_draws", F.transform(draws_of(draws, "flip"), lambda d: F.struct(in_order(F.col("coders"), d.r0).alias("coders"), in_order(F.col("ai"), d.r0).alias("ai"))))
    each = rows.select(*CELL, F.explode(F.array(*(x for k in range(1, top + 1) for x in arms(k)))).alias("x")).select(*CELL, "x.*")
    share = lambda f: F.aggregate(F.transform("moves", f), F.lit(0.0), lambda s, x: s + x) / F.size("moves")
    return each.select(*CELL, "arm", "k", share(lambda m: (m != 0).cast("double")).alias("flip"), share(lambda m: F.signum(-m)).alias("net"))


def net_of_churn(flipped: DataFrame) -> DataFrame:
    """Machine arms less the human arm of the same kind: flip_d and net_d."""
    kind = F.regexp_extract("arm", "^(add|replace)", 1)
    ai = flipped.where("arm LIKE '%ai'").select(*CELL, kind.alias("kind"), "k", "flip", "net")
    human = flipped.where("arm LIKE '%human'").select(*CELL, kind.alias("kind"), "k", F.col("flip").alias("h_flip"), F.col("net").alias("h_net"))
    return ai.join(human, [*CELL, "kind", "k"]).select(*CELL, "kind", "k", (F.col("flip") - F.col("h_flip")).alias("flip_d"), (F.col("net") - F.col("h_net")).alias("net_d"))
