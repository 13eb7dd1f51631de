"""Cluster bootstrap: entities are drawn with replacement, rows never are.

Rows are summed to (entity, group) first, so what meets the draws is a table of entities and groups and
not of rows. Draw 0 is the apparent one: every entity once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumspark.functions.core import ratio, six, u
from quorumspark.sources.views import kept


def weights(entities: DataFrame, draws: int, seed: str = "boot", key: str = "entity") -> DataFrame:
    """(draw, entity, w): how often each entity is drawn; only entities with w > 0. Slot s of draw d takes the entity number hash(seed, d, s) mod n in key order."""
    from pyspark.sql import Window as W

    # the clusters are the (few) entities of the study
    names = entities.select(key).distinct().withColumn("k", F.row_number().over(W.orderBy(key)) - 1)
    n = names.agg(F.count("*").alias("n"))
    slots = n.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = slots.select("draw", (u(seed, "draw", "s") % F.col("n")).alias("k")).groupBy("draw", "k").agg(F.count("*").alias("w"))
    return drawn.join(names, "k").select("draw", key, "w").union(names.select(F.lit(0), key, F.lit(1).cast("long")))


def sums(rows: DataFrame, by: list[str], key: str = "entity", **measures: Column) -> DataFrame:
    """One row a (cluster, group): the sum of each measure."""
    return rows.groupBy(key, *by).agg(*(F.sum(c).cast("double").alias(name) for name, c in measures.items()))


def resampled(presummed: DataFrame, w: DataFrame, by: list[str], key: str = "entity") -> DataFrame:
    """The measures' weighted sums for each draw and group."""
    measures = [c for c in presummed.columns if c not in (key, *by)]
    return presummed.join(w, key).groupBy("draw", *by).agg(*(F.sum(F.col(m) * F.col("w")).alias(m) for m in measures))


def boot_mean(rows: DataFrame, w: DataFrame, by: list[str], value: Column, key: str = "entity") -> DataFrame:
    """(draw, *by, x): weighted mean of `value` over rows where it is not null."""
    pre = sums(rows, by, key, s=value, n=value.isNotNull().cast("int"))
    return resampled(pre, w, by, key).select("draw", *by, ratio(F.col("s"), F.col("n")).alias("x"))


def ci(draws: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """est (apparent draw), lo and hi (2.5 and 97.5 % of the others), p_gt (share above 0), p_two (two-sided p)."""
    boot = F.when(F.col("draw") > 0, F.col(x))
    q = F.percentile(boot, [0.025, 0.975])
    above, below = F.avg((boot > 0).cast("int")), F.avg((boot <= 0).cast("int"))
    out = draws.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, F.col(x))).alias("est"), q.alias("q"), above.alias("p_gt"), F.least(F.lit(1.0), 2 * F.least(below, F.avg((boot >= 0).cast("int")))).alias("p_two"))
    return out.select(*by, six(F.col("est")).alias("est"), six(F.col("q")[0]).alias("lo"), six(F.col("q")[1]).alias("hi"), six(F.col("p_gt")).alias("p_gt"), six(F.col("p_two")).alias("p_two"))


def paired(draws: DataFrame, spec: DataFrame, cell: list[str], floor: Column, x: str = "x") -> DataFrame:
    """Contrasts a - b of a spec (label, a_<cell>..., b_<cell>...) within each draw, their intervals and whether they pass the smallest effect of interest. A contrast with a missing side is left out."""
    a = draws.select("draw", *(F.col(c).alias(f"a_{c}") for c in cell), F.col(x).alias("xa"))
    b = draws.select("draw", *(F.col(c).alias(f"b_{c}") for c in cell), F.col(x).alias("xb"))
    both = a.join(F.broadcast(spec), [f"a_{c}" for c in cell]).join(b, ["draw", *(f"b_{c}" for c in cell)])
    return ci(both.withColumn("x", F.col("xa") - F.col("xb")), ["label"]).withColumn("sesoi_out", F.abs("est") > floor)


def difference(draws: DataFrame, by: list[str], flag: str, x: str = "x") -> DataFrame:
    """(draw, *by, x): the value where `flag` holds less the value where it does not."""
    return draws.groupBy("draw", *by).agg((F.max(F.when(F.col(flag), F.col(x))) - F.max(F.when(~F.col(flag), F.col(x)))).alias("x"))


def paired_rows(rows: DataFrame, by: list[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """(*by, d): value where `side` is a less value where it is b, of groups that have both."""
    one = lambda x: F.max(F.when(F.col(side) == x, F.col(value)))
    return rows.groupBy(*by).agg((one(a) - one(b)).alias("d")).where("d IS NOT NULL")


def contrasts(draws: DataFrame, by: list[str], key: str, spec: dict[str, dict[str, float]], x: str = "x") -> DataFrame:
    """(contrast, draw, *by, x): linear combinations of a group's values within each draw; null where a side is missing."""
    sides = sorted({k for weights_ in spec.values() for k in weights_})
    wide = draws.groupBy("draw", *by).agg(*(F.max(F.when(F.col(key) == k, F.col(x))).alias(f"_s{i}") for i, k in enumerate(sides)))
    # nine decimals: a difference that is 0 in exact arithmetic is 0
    value = lambda w: F.round(sum((F.col(f"_s{sides.index(k)}") * float(c) for k, c in w.items()), F.lit(0.0)), 9)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("contrast"), value(w).alias("x")) for n, w in spec.items()))).alias("_c")
    return wide.select("draw", *by, each).select("_c.contrast", "draw", *by, "_c.x")


def in_all_arms(rows: DataFrame, by: list[str], arm: str, n: int) -> DataFrame:
    """Rows of groups that have all n arms."""
    from pyspark.sql import Window as W

    return rows.withColumn("_k", F.count(arm).over(W.partitionBy(*by))).where(F.col("_k") == n).drop("_k")


def arm_outcomes(rows: DataFrame, w: DataFrame, by: list[str], key: str = "entity") -> DataFrame:
    """(draw, *by, arm, outcome, x): mean error a, mean signed error s and slope of a on h of every arm, from one table of sums."""
    a, s, h = (F.col(c) for c in "ash")
    m = resampled(sums(rows, [*by, "arm"], key, n=F.lit(1), sa=a, ss=s, sh=h, sha=h * a, shh=h * h), w, [*by, "arm"], key)
    c = {x: F.col(x) for x in ("n", "sa", "ss", "sh", "sha", "shh")}
    values = {"mae": c["sa"] / c["n"], "signed": c["ss"] / c["n"], "slope": ratio(c["sha"] - c["sh"] * c["sa"] / c["n"], c["shh"] - c["sh"] ** 2 / c["n"])}
    return m.select("draw", *by, "arm", F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), x.alias("x")) for o, x in values.items()))).alias("_o")).select("draw", *by, "arm", "_o.*")


def boot_slope(rows: DataFrame, w: DataFrame, by: list[str], y: Column, x: Column, key: str = "entity") -> DataFrame:
    """(draw, *by, x, a): weighted slope and intercept of y on x, from five sums; null pairs are left out."""
    ok = rows.withColumn("_y", y.cast("double")).withColumn("_x", x.cast("double")).where("_y IS NOT NULL AND _x IS NOT NULL")
    m = resampled(sums(ok, by, key, n=F.lit(1), sx=F.col("_x"), sy=F.col("_y"), sxy=F.col("_x") * F.col("_y"), sxx=F.col("_x") ** 2), w, by, key)
    slope = ratio(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") ** 2 / F.col("n"))
    return m.select("draw", *by, slope.alias("x"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("a"))


def row_boot(rows: DataFrame, draws: int, by: list[str], value: str, keys: list[str], seed: str = "row") -> DataFrame:
    """Bootstrap of a mean over rows, not clusters: each row's weight in a draw is a Poisson(1) count by hash of (draw, row), so it depends on nothing else and needs no shuffle of rows."""
    r = (u(seed, "draw", *keys) / F.lit(4294967296.0)).alias("r")
    each = rows.select(*by, value, *keys, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("draw", *by, value, r)
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, 8):
        total += term
        steps.append(total)
        term /= k
    weight = sum((F.col("r") >= s).cast("int") for s in steps[1:]) + (F.col("r") >= steps[0]).cast("int")
    out = each.withColumn("w", weight).groupBy("draw", *by).agg(ratio(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("x"))
    return out.union(rows.groupBy(*by).agg(F.avg(value).alias("x")).select(F.lit(0), *by, "x"))


def count_boot(rows: DataFrame, draws: int, by: list[str], value: Column, seed: str = "count", per_block: int = 2048, per_chunk: int = 100) -> DataFrame:
    """(draw, *by, n, x): the mean of `value` over n rows drawn with replacement from a group's n, for draws 0 (the rows as they are) to `draws`; nulls are left out.

    The counts of a draw are multinomial, split down a tree: over blocks of values first, then within each block over its distinct values with their numbers of rows, so they sum to n in every draw. Equal
    values are one leaf. No row meets a draw: a block's task holds its distinct values and gives one sum a draw. Generators are seeded by (seed, group, block, chunk of draws) and not by task.
    """
    import numpy as np
    import pandas as pd

    leaves = kept(rows.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_c")))
    n_blocks = max(1, -(-leaves.count() // per_block))
    block = F.pmod(F.xxhash64("_v"), F.lit(n_blocks)).cast("int")
    types = dict(leaves.dtypes)
    keys = "".join(f"{c} {types[c]}, " for c in by)
    blocks = leaves.groupBy(*by, block.alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_leaves"), F.sum("_c").alias("_n"))
    blocks = kept(blocks)
    chunks = -(-draws // per_chunk)
    tops = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("_blocks")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    tops = tops.withColumn("_seed", F.xxhash64(F.lit(seed), "_k", *by))

    def over_blocks(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                n = np.array([x["_n"] for x in r["_blocks"]])
                drawn = np.random.Generator(np.random.Philox(key=r["_seed"] % 2**64)).multinomial(n.sum(), n / n.sum(), size=min(per_chunk, draws - per_chunk * r["_k"]))
                out += [{**{c: r[c] for c in by}, "_b": x["_b"], "_k": r["_k"], "_t": d} for x, d in zip(r["_blocks"], drawn.T, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "_b", "_k", "_t"])

    given = tops.mapInPandas(over_blocks, f"{keys}_b int, _k int, _t array<long>")
    names = [f"_g{i}" for i in range(len(by))]
    same = F.col("_b") == F.col("_gb")
    for c, g in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    within = given.join(blocks.select(*(F.col(c).alias(g) for c, g in zip(by, names, strict=True)), F.col("_b").alias("_gb"), "_leaves"), same).drop(*names, "_gb").withColumn("_seed", F.xxhash64(F.lit(seed), "_k", "_b", *by))

    def over_values(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                v, c = np.array([x["_v"] for x in r["_leaves"]]), np.array([x["_c"] for x in r["_leaves"]])
                drawn = np.random.Generator(np.random.Philox(key=r["_seed"] % 2**64)).multinomial(np.asarray(r["_t"]), c / c.sum())
                out.append({**{x: r[x] for x in by}, "_k": r["_k"], "_n": drawn.sum(axis=1), "_s": drawn @ v})
            yield pd.DataFrame(out, columns=[*by, "_k", "_n", "_s"])

    sums = within.mapInPandas(over_values, f"{keys}_k int, _n array<long>, _s array<double>")
    each = sums.select(*by, "_k", F.posexplode(F.arrays_zip("_n", "_s")).alias("_i", "_e")).select(*by, (F.col("_k") * per_chunk + F.col("_i") + 1).alias("draw"), "_e.*")
    drawn = each.groupBy("draw", *by).agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"))
    own = leaves.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_v") * F.col("_c")).alias("_s"))
    return drawn.union(own.select(F.lit(0), *by, "n", "_s")).select("draw", *by, "n", ratio(F.col("_s"), F.col("n")).alias("x"))


def boot_wasserstein(own: DataFrame, ref: DataFrame, w: DataFrame, by: list[str], step: float, common: list[str] = (), key: str = "entity", per_block: int = 256) -> DataFrame:
    """(draw, *by, x): Wasserstein-1 distance in every draw between histograms own (key, *by, b, n) and ref (key, *common, b, n), bins of width `step`.

    A group's histograms are a matrix of bins by clusters, a block of `per_block` draws one of clusters by draws: each (group, block) is a task's product and running sums, of bins by draws. Groups are known by
    one row that lists them, so nothing is multiplied out but histograms by blocks and weights by groups.
    """
    import numpy as np
    import pandas as pd

    groups = own.select(*by).distinct()
    listed = groups.agg(F.collect_list(F.struct(*by)).alias("_groups"))  # one row
    spread = lambda df: df.crossJoin(F.broadcast(listed)).withColumn("_to", F.explode("_groups")).select("*", "_to.*").drop("_groups", "_to")
    at = ref.join(groups, list(common)) if common else spread(ref)
    both = own.select(*by, key, "b", F.col("n").alias("f"), F.lit(0.0).alias("g")).union(at.select(*by, key, "b", F.lit(0.0), "n"))
    both = both.groupBy(*by, key, "b").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    last = w.agg(F.floor(F.max("draw") / per_block).alias("_last"))
    none = F.lit(None)
    hist = both.crossJoin(F.broadcast(last)).withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).select(*by, "_d", key, "b", "f", "g", none.cast("array<int>").alias("_draws"), none.cast("array<double>").alias("_w"))
    cut = w.groupBy(key, F.floor(F.col("draw") / per_block).alias("_d")).agg(F.collect_list(F.struct("draw", "w")).alias("_e"))
    lists = spread(cut).select(*by, "_d", key, none.cast("int").alias("b"), none.cast("double").alias("f"), none.cast("double").alias("g"), F.transform("_e", lambda e: e.draw.cast("int")).alias("_draws"), F.transform("_e", lambda e: e.w.cast("double")).alias("_w"))

    def distances(rows):
        weights_, hist = rows[rows["b"].isna()], rows[~rows["b"].isna()]
        if not len(hist) or not len(weights_):
            return pd.DataFrame(columns=["draw", *by, "x"])
        bins, row = np.unique(hist["b"].to_numpy(), return_inverse=True)
        draws = np.unique(np.concatenate(list(weights_["_draws"])))
        names = pd.Index(sorted(set(hist[key]) | set(weights_[key])))
        m = np.zeros((len(names), len(draws)))
        for name, d, x in zip(weights_[key], weights_["_draws"], weights_["_w"], strict=True):
            m[names.get_loc(name), np.searchsorted(draws, d)] = x
        cdf = []
        for c in ("f", "g"):
            x = np.zeros((len(bins), len(names)))
            x[row, names.get_indexer(hist[key])] = hist[c]
            x = np.cumsum(x @ m, axis=0)
            with np.errstate(invalid="ignore"):
                cdf.append(x / np.where(x[-1] == 0, np.nan, x[-1]))
        gap = np.abs(cdf[0] - cdf[1])[:-1] * np.diff(bins)[:, None] * step
        return pd.DataFrame({"draw": draws, **{c: hist[c].iloc[0] for c in by}, "x": gap.sum(axis=0)})

    types = dict(both.dtypes)
    out = hist.union(lists).groupBy(*by, "_d").applyInPandas(distances, ", ".join(["draw int", *(f"{c} {types[c]}" for c in by), "x double"]))
    return out.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
