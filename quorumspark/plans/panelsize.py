"""Panel size and absorbed factors: fixed effects, adjusted levels and marginals, shares of variation, slopes across a moderator."""

from pyspark.sql import functions as F

from quorumspark.functions.core import six
from quorumspark.operators import absorb as A
from quorumspark.operators import regress as G
from quorumspark.plans.registry import query

FACTORS = ["entity", "indicator", "year"]
#: Panel sizes of the published figure: a step for each up to here, one level beyond, contrasts to the recommended floor.
TOP, REFERENCE = 16, 5
ZONES = {"advised against": (2, 3), "no guidance": (4, 4), "at the floor": (5, 8), "above the floor": (9, 1_000_000)}


def _fit_sql(name: str, src: str, y: str, xs: list[str], factors: list[str], rounds: int = 40) -> list[str]:
    """Common table expressions that end in {name}_b (i, beta, v: list of a row of the covariance, r2, within_r2, n, g): factors taken off by turns, normal equations inverted by elimination, clustered by entity."""
    k, cols = len(xs), ["y", *(f"x{i}" for i in range(1, len(xs) + 1))]
    keys = ", ".join(dict.fromkeys(["entity", *factors]))
    out = [f"{name}_r AS (SELECT {keys}, ({y})::DOUBLE AS raw, ({y})::DOUBLE AS y{''.join(f', ({x})::DOUBLE AS x{i + 1}' for i, x in enumerate(xs))} FROM {src})"]
    if factors:
        turn = f"{name}_i"
        for f in factors:
            turn = f"(SELECT it, {keys}, raw, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {f}) AS {c}" for c in cols) + f" FROM {turn})"
        out.append(f"{name}_i AS (SELECT 0 AS it, * FROM {name}_r UNION ALL SELECT it + 1, {keys}, raw, {', '.join(cols)} FROM {turn} WHERE it < {rounds})")
        out.append(f"{name}_f AS (SELECT * FROM {name}_i WHERE it = {rounds})")
        levels = " + ".join(f"count(DISTINCT {f})" for f in factors) + f" - {len(factors) - 1}"
    else:
        out.append(f"{name}_f AS (SELECT * FROM {name}_r)")
        levels = "0"
    square = lambda value: "[" + ", ".join("[" + ", ".join(value(i, j) for j in range(1, k + 1)) + "]" for i in range(1, k + 1)) + "]"
    out.append(f"{name}_a AS (SELECT {square(lambda i, j: f'sum(x{i} * x{j})')} AS a, [{', '.join(f'sum(x{i} * y)' for i in range(1, k + 1))}] AS b, sum(y * y) AS yy, var_pop(raw) * count(*) AS tss, count(*) AS n, count(DISTINCT entity) AS g, {levels} AS levels FROM {name}_f)")
    out.append(f"{name}_j AS (SELECT 0 AS p, list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {2 * k + 1}), lambda j: CASE WHEN j <= {k} THEN a[i][j] ELSE (j - {k} = i)::INT::DOUBLE END)) AS m FROM {name}_a UNION ALL SELECT p + 1, list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {2 * k + 1}), lambda j: CASE WHEN i = p + 1 THEN m[p + 1][j] / m[p + 1][p + 1] ELSE m[i][j] - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END)) FROM {name}_j WHERE p < {k})")
    out.append(f"{name}_v AS (SELECT list_transform(range(1, {k + 1}), lambda i: m[i][{k + 1}:{2 * k}]) AS inv, {name}_a.* FROM {name}_j CROSS JOIN {name}_a WHERE p = {k})")
    out.append(f"{name}_c AS (SELECT *, list_transform(range(1, {k + 1}), lambda i: list_dot_product(inv[i], b)) AS beta FROM {name}_v)")
    u = "y - list_dot_product([" + ", ".join(f"x{i}" for i in range(1, k + 1)) + "], (SELECT beta FROM " + f"{name}_c))"
    out.append(f"{name}_s AS (SELECT {', '.join(f'sum(x{i} * u) AS s{i}' for i in range(1, k + 1))} FROM (SELECT *, {u} AS u FROM {name}_f) GROUP BY entity)")
    out.append(f"{name}_w AS (SELECT {square(lambda i, j: f'sum(s{i} * s{j})')} AS w FROM {name}_s)")
    out.append(f"{name}_h AS (SELECT *, list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 1}), lambda j: list_dot_product(inv[i], w[j]))) AS half FROM {name}_c CROSS JOIN {name}_w)")
    scale = f"(g / (g - 1.0)) * ((n - 1.0) / (n - {k} - levels))"
    out.append(f"{name}_b AS (SELECT unnest(range(1, {k + 1})) AS i, unnest(beta) AS beta, unnest(list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 1}), lambda j: list_dot_product(half[i], inv[j]) * {scale}))) AS v, 1 - (yy - list_dot_product(beta, b)) / tss AS r2, 1 - (yy - list_dot_product(beta, b)) / yy AS within_r2, n, g FROM {name}_h)")
    return out


_E8 = "(SELECT m.*, covariate FROM means m JOIN (SELECT entity, year, covariate FROM entity_year) USING (entity, year))"


@query("e8_fixed_effects", "SELECT ['covariate', 'n_coders'][i] AS term, round(beta, 6) AS est, round(sqrt(v[i]), 6) AS se, round(r2, 6) AS r2, round(within_r2, 6) AS within_r2, n, g AS n_clusters FROM e8_b", *_fit_sql("e8", _E8, "raw_mean", ["covariate", "n_coders"], FACTORS))
def _(v):
    rows = v.means.join(v.entity_year.select("entity", "year", "covariate"), ["entity", "year"])
    out = A.fit(rows, F.col("raw_mean"), {c: F.col(c) for c in ("covariate", "n_coders")}, FACTORS, "entity").coefficients()
    return out.select("term", *(six(F.col(c)).alias(c) for c in ("est", "se", "r2", "within_r2")), "n", "n_clusters")


_SIZES = list(range(2, TOP + 1))
_ADJUSTED = [s for s in _SIZES if s != REFERENCE]
_UNC = "(SELECT * FROM releases WHERE release = 3 AND posterior_sd IS NOT NULL)"
_SIZED = [*_fit_sql("raw", _UNC, "posterior_sd", [f"least(n_coders, {TOP}) = {s}" for s in _SIZES], []), *_fit_sql("adj", _UNC, "posterior_sd", [f"least(n_coders, {TOP}) = {s}" for s in _ADJUSTED], FACTORS)]
_SIZED += [
    f"rawl_ AS (SELECT {_SIZES}[i] AS size, i, beta, v FROM raw_b)",
    f"adjl_ AS (SELECT {_ADJUSTED}[i] AS size, i, beta, v FROM adj_b UNION ALL SELECT {REFERENCE}, NULL, 0, NULL)",
    f"levels_ AS (SELECT 'raw' AS series, size, beta AS est, sqrt(v[i]) AS se FROM rawl_ UNION ALL SELECT 'adjusted', size, beta + (SELECT beta FROM rawl_ WHERE size = {REFERENCE}), coalesce(sqrt(v[i]), 0) FROM adjl_)",
    "steps_ AS (" + " UNION ALL ".join(f"SELECT '{s}' AS series, a.size, a.beta - b.beta AS d, sqrt(coalesce(a.v[a.i], 0) + coalesce(b.v[b.i], 0) - 2 * coalesce(a.v[b.i], 0)) AS se FROM {t} a JOIN {t} b ON a.size = b.size + 1" for s, t in (("raw", "rawl_"), ("adjusted", "adjl_"))) + ")",
]


def _sized(v):
    return A.size_levels(v.releases.where("release = 3"), "posterior_sd", "n_coders", FACTORS, "entity", REFERENCE, TOP, _SIZES[0])


@query("e9_size_levels", "SELECT series, size, round(est, 6) AS est, round(se, 6) AS se FROM levels_", *_SIZED)
def _(v):
    return _sized(v)[0].select("series", "size", six(F.col("est")).alias("est"), six(F.col("se")).alias("se"))


@query("e9_marginals", "SELECT series, size, round(d, 6) AS d, round(se, 6) AS se FROM steps_", *_SIZED)
def _(v):
    return _sized(v)[1].select("series", "size", six(F.col("d")).alias("d"), six(F.col("se")).alias("se"))


_ZONE = "CASE " + " ".join(f"WHEN size BETWEEN {a} AND {b} THEN '{z}'" for z, (a, b) in ZONES.items()) + " END"


@query("e14_zones", f"SELECT {_ZONE} AS zone, count(*) AS positions, round(avg(d), 6) AS mean_d, round(min(d), 6) AS least_d, round(max(d), 6) AS most_d FROM steps_ WHERE series = 'adjusted' GROUP BY zone", *_SIZED)
def _(v):
    return A.zones(_sized(v)[1].where("series = 'adjusted'"), ZONES)


_GROUPS = {"entity": ["entity"], "year": ["year"], "indicator": ["indicator"], "entity + indicator": ["entity", "indicator"], "+ year": FACTORS}
_ONE = "SELECT '{g}' AS grouping, round((SELECT sum(n * (m - a) ** 2) FROM (SELECT avg(n_coders) AS m, count(*) AS n, (SELECT avg(n_coders) FROM means) AS a FROM means GROUP BY {g})) / (SELECT var_pop(n_coders) * count(*) FROM means), 6) AS r2, (SELECT count(DISTINCT {g}) FROM means) AS n_levels"
_MANY = "SELECT '{g}', round((SELECT 1 - sum(y * y) / (var_pop(raw) * count(*)) FROM {t}_f), 6), NULL"


@query("e10_group_r2", " UNION ALL ".join([_ONE.format(g=g) for g in ("entity", "year", "indicator")] + [_MANY.format(g="entity + indicator", t="two"), _MANY.format(g="+ year", t="three")]), *_fit_sql("two", "means", "n_coders", ["year"], FACTORS[:2])[:3], *_fit_sql("three", "means", "n_coders", ["year"], FACTORS)[:3])
def _(v):
    return A.nested_r2(v.means, "n_coders", _GROUPS)


_E13 = "(SELECT m.*, c, n_coders * c AS n_c FROM means m JOIN (SELECT entity, year, covariate - avg(covariate) OVER () AS c FROM entity_year) USING (entity, year))"


@query("e13_slope_across_moderator", "SELECT x / 100.0::DOUBLE AS at, round(b + d * x / 100.0, 6) AS slope, round(b - 1.96 * sb + (d - 1.96 * sd) * x / 100.0, 6) AS lo, round(b + 1.96 * sb + (d + 1.96 * sd) * x / 100.0, 6) AS hi FROM (SELECT max(beta) FILTER (i = 1) AS b, max(sqrt(v[1])) FILTER (i = 1) AS sb, max(beta) FILTER (i = 3) AS d, max(sqrt(v[3])) FILTER (i = 3) AS sd FROM e13_b) CROSS JOIN range(-50, 51) g(x)", *_fit_sql("e13", _E13, "raw_mean", ["n_coders", "c", "n_c"], FACTORS))
def _(v):
    centre = v.entity_year.agg(F.avg("covariate").alias("centre"))
    rows = v.means.join(v.entity_year.select("entity", "year", "covariate"), ["entity", "year"]).crossJoin(F.broadcast(centre)).withColumn("c", F.col("covariate") - F.col("centre")).withColumn("n_c", F.col("n_coders") * F.col("c"))
    fit = A.fit(rows, F.col("raw_mean"), {c: F.col(c) for c in ("n_coders", "c", "n_c")}, FACTORS, "entity").coefficients()
    return G.slope_grid(fit, "n_coders", "n_c", -0.5, 0.5, 0.01).select("at", *(six(F.col(c)).alias(c) for c in ("slope", "lo", "hi")))
