"""The driver's tables in the roles of composition data, in Spark and in SQL.

sample = an order, tumour = the customer's nation, patient = the customer,
structure = the order's priority, part = the part type, method = the measure the
shares are taken by, truth = the shares by quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.catalog.registry import Tables
from partwise.functions.draws import unit

PARTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
STRUCTURES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
METHODS = ["price", "lines", "net", "control"]

# id, kind, part, ordered structures, comparison set, weight
CONSTRAINTS = [
    ("C1", "pairwise", "PROMO", ["1-URGENT", "5-LOW"], [], 1.0),
    ("C2", "pairwise", "ECONOMY", ["5-LOW", "1-URGENT"], [], 1.0),
    ("C3", "pairwise", "LARGE", ["3-MEDIUM", "1-URGENT"], [], 1.0),
    ("C4", "maximum", "LARGE", ["3-MEDIUM"], STRUCTURES, 1.0),
    ("C5", "pairwise", "SMALL", ["4-NOT SPECIFIED", "5-LOW"], [], 1.0),
    ("C6", "pairwise", "SMALL", ["3-MEDIUM", "1-URGENT"], [], 1.0),
    ("C7", "monotone", "PROMO", ["5-LOW", "2-HIGH", "1-URGENT"], [], 2.0),
]


AMOUNTS = {
    "price": "l_extendedprice",
    "quantity": "l_quantity",
    "lines": "1.0D",
    "net": "l_extendedprice * (1 - l_discount)",
}


def weights(t: Tables, *measures: str) -> DataFrame:
    """One row per order with a total per measure and part; absent parts are 0."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    sums = [
        F.expr(f"sum(CASE WHEN p_type = '{p}' THEN {AMOUNTS[m]} ELSE 0.0D END) AS {m}_{p}")
        for m in measures for p in PARTS
    ]
    return rows.groupBy(F.col("l_orderkey").alias("sample")).agg(*sums)


def _by_part(t: Tables, methods: tuple[str, ...], extra: tuple[str, ...] = (), beside: DataFrame | None = None,
             dealt: str | None = None) -> DataFrame:
    """One row per (sample, part): the measures and, as t_<measure>, their sample totals.

    Opened in two small steps (parts here, methods in the callers), which keeps
    each generated function short enough to be compiled.  ``beside`` has columns of
    a sample; they are joined while a sample is one row, so no join sorts the opened rows.  ``dealt`` is the one
    that the caller groups by; samples are dealt by it as one row, too.
    """
    measures = [*dict.fromkeys([m for m in methods if m != "control"] + list(extra))]
    wide = weights(t, *(measures or ["lines"]))
    if "control" in methods:
        # Draw first, in a projection of its own, so each hash is computed once.
        wide = wide.withColumns({f"control_{p}": unit(F.lit("control"), "sample", F.lit(p)) for p in PARTS})
        measures.append("control")
    others = []
    if beside is not None:
        others = [c for c in beside.columns if c != "sample"]
        wide = wide.join(beside, "sample")
        wide = wide.repartition(dealt) if dealt else wide
    totals = [f"{' + '.join(f'{m}_{p}' for p in PARTS)} AS t_{m}" for m in measures]
    wide = wide.selectExpr("*", *totals)
    rows = ", ".join(
        f"named_struct('part', '{p}', " + ", ".join(f"'{m}', {m}_{p}" for m in measures) + ")" for p in PARTS)
    return wide.selectExpr("sample", *others, *[f"t_{m}" for m in measures], f"inline(array({rows}))")


def _share(m: str) -> str:
    return f"round(try_divide({m}, t_{m}), 10)"


def estimates(t: Tables, *methods: str, beside: DataFrame | None = None) -> DataFrame:
    """est(method, sample, part, value): shares of each order by part type, and the columns of ``beside``."""
    others = [c for c in beside.columns if c != "sample"] if beside is not None else []
    methods = methods or tuple(METHODS)
    cells = ", ".join(f"named_struct('method', '{m}', 'value', {_share(m)})" for m in methods)
    return _by_part(t, methods, beside=beside).selectExpr("sample", *others, "part", f"inline(array({cells}))").select(
        "method", "sample", "part", "value", *others)


def paired(t: Tables, *methods: str, beside: DataFrame | None = None, dealt: str | None = None) -> DataFrame:
    """et(method, sample, part, e, t): estimate beside truth, from one pass over the lines, and the columns of ``beside``.

    With ``dealt``, one of these, grouping by it deals no row of a method and part.
    """
    others = [c for c in beside.columns if c != "sample"] if beside is not None else []
    methods = methods or tuple(METHODS)
    cells = ", ".join(f"named_struct('method', '{m}', 'e', {_share(m)})" for m in methods)
    return _by_part(t, methods, ("quantity",), beside, dealt).selectExpr(
        "sample", *others, "part", f"{_share('quantity')} AS t", f"inline(array({cells}))").select(
        "method", "sample", "part", "e", "t", *others)


def truth(t: Tables) -> DataFrame:
    return estimates(t, "quantity").select("sample", "part", "value")


def samples(t: Tables) -> DataFrame:
    """sample, patient, tumour, structure."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("patient"),
        F.col("c_nationkey").alias("tumour"), F.col("o_orderpriority").alias("structure"),
    )


def cells(t: Tables) -> DataFrame:
    """cell, donor, part, library."""
    return t.embeddings.select(
        F.col("vec_id").alias("cell"), (F.col("vec_id") % 8).alias("donor"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("part"),
    )


def cell_expr(t: Tables) -> DataFrame:
    """feature, cell, value (shifted to be non-negative)."""
    return t.embeddings.select(
        F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("feature", "v")
    ).select("feature", "cell", F.round(F.col("v").cast("double") + 1, 6).alias("value"))


def matrix(t: Tables) -> DataFrame:
    """feature x sample matrix: brand x supplier, summed quantity."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("feature"), F.col("l_suppkey").alias("sample")
    ).agg(F.sum("l_quantity").alias("value"))


def signature(t: Tables, parts: list[str] | None = None) -> DataFrame:
    """feature x part: mean price per line of a brand within a part type."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    if parts:
        rows = rows.where(F.col("p_type").isin(parts))
    return rows.groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("part")).agg(
        F.round(F.avg("l_quantity"), 6).alias("mean")
    )


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def h32(*parts: str) -> str:
    text = ", ".join(parts)
    return f"CAST(concat('0x', substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT)"


_SHARES = " UNION ALL ".join(
    f"SELECT '{m}' AS method, sample, part, round({m} / nullif(t_{m}, 0), 10) AS value FROM tot"
    for m in ("price", "lines", "net")
)
_CON = ", ".join(
    f"('{i}', '{k}', '{p}', {_list(s)}, {_list(a) if a else '[]::VARCHAR[]'}, {w}::DOUBLE)"
    for i, k, p, s, a, w in CONSTRAINTS
)

CTES = {
    "w": ("", """SELECT l_orderkey AS sample, p_type AS part, sum(l_extendedprice) AS price,
        sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS lines,
        sum(l_extendedprice * (1 - l_discount)) AS net
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "roster": ("", f"SELECT unnest({_list(PARTS)}) AS part"),
    "dense": ("w roster", """SELECT s.sample, r.part, coalesce(price, 0) AS price, coalesce(quantity, 0) AS quantity,
        coalesce(lines, 0) AS lines, coalesce(net, 0) AS net
        FROM (SELECT DISTINCT sample FROM w) s CROSS JOIN roster r
        LEFT JOIN w ON w.sample = s.sample AND w.part = r.part"""),
    "tot": ("dense", """SELECT *, sum(price) OVER (PARTITION BY sample) AS t_price,
        sum(quantity) OVER (PARTITION BY sample) AS t_quantity, sum(lines) OVER (PARTITION BY sample) AS t_lines,
        sum(net) OVER (PARTITION BY sample) AS t_net FROM dense"""),
    "ctl": ("dense", f"""SELECT sample, part, round(u / sum(u) OVER (PARTITION BY sample), 10) AS value FROM (
        SELECT sample, part, ({h32("'control'", "sample", "part")} + 1) / 4294967296.0::DOUBLE AS u FROM dense)"""),
    "est": ("tot ctl", _SHARES + " UNION ALL SELECT 'control' AS method, sample, part, value FROM ctl"),
    "truth": ("tot", "SELECT sample, part, round(quantity / nullif(t_quantity, 0), 10) AS value FROM tot"),
    "smp": ("", """SELECT o_orderkey AS sample, o_custkey AS patient, c_nationkey AS tumour,
        o_orderpriority AS structure FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "et": ("est truth", """SELECT method, sample, part, e.value AS e, t.value AS t
        FROM est e JOIN truth t USING (sample, part)"""),
    "m": ("est smp", """SELECT method, tumour, structure, part, round(avg(value), 10) AS v
        FROM est JOIN smp USING (sample) GROUP BY ALL"""),
    "con": ("", f"SELECT * FROM (VALUES {_CON}) AS c(id, kind, part, structures, among, weight)"),
    "cells": ("", "SELECT vec_id AS cell, vec_id % 8 AS donor, concat('L', label) AS part FROM embeddings"),
    "expr": ("", """SELECT vec_id AS cell, generate_subscripts(embedding, 1) - 1 AS feature,
        round(CAST(unnest(embedding) AS DOUBLE) + 1, 6) AS value FROM embeddings"""),
    "matrix": ("", """SELECT p_brand AS feature, l_suppkey AS sample, sum(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "sig": ("", """SELECT p_brand AS feature, p_type AS part, round(avg(l_quantity), 6) AS mean
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
}


def verdict_sql(means: str, keys: str = "method, tumour") -> str:
    """Verdicts of every constraint over a means relation (keys, structure, part, v)."""
    return f"""SELECT {keys}, id, weight, CASE kind
        WHEN 'pairwise' THEN CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN s1 > s2 END
        WHEN 'maximum' THEN CASE WHEN s1 IS NOT NULL AND n_others >= 2 THEN s1 > others END
        ELSE CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL THEN s1 < s2 AND s2 < s3 END END AS ok
        FROM (SELECT {keys}, c.id, c.kind, c.weight,
          max(v) FILTER (structure = structures[1]) AS s1, max(v) FILTER (structure = structures[2]) AS s2,
          max(v) FILTER (structure = structures[3]) AS s3,
          max(v) FILTER (list_contains(among, structure) AND structure <> structures[1]) AS others,
          count(v) FILTER (list_contains(among, structure) AND structure <> structures[1]) AS n_others
          FROM {means} JOIN con c USING (part) GROUP BY {keys}, c.id, c.kind, c.weight)"""


CTES["verdict"] = ("m con", f"SELECT * FROM ({verdict_sql('m')}) WHERE ok IS NOT NULL")


def q(needs: str, body: str) -> str:
    """Prefix the named CTEs (and what they need) to a query."""
    order: list[str] = []

    def add(name: str):
        deps, _ = CTES[name]
        for d in deps.split():
            add(d)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    body = body.strip()
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if not head:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
