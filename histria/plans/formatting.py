"""Formatter pipelines over the order log, with every stage counted."""

from pyspark.sql import functions as F

from histria.operators import formatting as M
from histria.operators import sequences as S
from histria.sources import driver as D

from .compile import _SHUFFLE
from .registry import INTER, plan
from .sequences import text

#: Captioned items, and items with complete vectors.
_SETS = "cap AS (SELECT p_partkey AS item FROM part WHERE p_size <= 40), vecs AS (SELECT p_partkey AS item FROM part WHERE p_partkey % 7 <> 0)"


def _sets(spark, d):
    i = D.items(spark, d)
    return i.where("p_size <= 40"), i.where("item % 7 <> 0")


def _accounted(names):
    """Rows, users, items, interactions and lengths of tables x0, x1, ... of (usr, item, n rows a user)."""
    each = " UNION ALL ".join(
        f"""SELECT {k} AS place, '{name}' AS stage, (SELECT count(*) FROM x{k}_rows)::BIGINT AS rows, coalesce((SELECT sum(n) FROM x{k}_rows), 0)::BIGINT AS interactions, (SELECT min(n) FROM x{k}_rows)::INT AS min_length,
      (SELECT max(n) FROM x{k}_rows)::INT AS max_length, (SELECT avg(n) FROM x{k}_rows) AS mean_length, (SELECT count(DISTINCT usr) FROM x{k}_rows) AS users, (SELECT count(DISTINCT item) FROM x{k}) AS items"""
        for k, name in enumerate(names)
    )
    return f"""a AS ({each})
SELECT *, coalesce(lag(rows) OVER (ORDER BY place) - rows, 0)::BIGINT AS removed_rows, coalesce(lag(interactions) OVER (ORDER BY place) - interactions, 0)::BIGINT AS removed_interactions FROM a"""


_ROWS = lambda k: f"x{k}_rows AS (SELECT usr, count(*) AS n FROM x{k} GROUP BY usr)"


def _cut(source, longest, shortest):
    return f"""(SELECT usr, item, pos FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY pos DESC) AS rn, count(*) OVER (PARTITION BY usr) AS m FROM {source}) WHERE rn <= {longest} AND least(m, {longest}) >= {shortest})"""


def _full_sql(longest, shortest):
    sql = f"WITH RECURSIVE {INTER}, {_SETS}, x0 AS MATERIALIZED (SELECT usr, item, pos FROM inter), {_ROWS(0)}"
    for k, allowed in enumerate(("cap", "vecs", "cap"), 1):
        sql += f", x{k} AS MATERIALIZED (SELECT * FROM {_cut(f'(SELECT * FROM x{k - 1} SEMI JOIN {allowed} USING (item))', longest, shortest)}), {_ROWS(k)}"
    return sql


def _full(spark, d):
    captions, complete = _sets(spark, d)
    return M.full(D.histories(spark, d), captions, complete, 24, 8, seed=42, test_ratio=0.1)


@plan("full_pipeline_stages", _full_sql(24, 8) + ", " + _accounted(["raw", "captions", "vectors", "aligned"]))
def full_pipeline_stages(spark, d):
    return M.accounting(_full(spark, d).stages)


def _tables_sql(base, last, percent, ratio):
    """The users of table x<last> in Fisher-Yates order, with their split."""
    shuffle = _SHUFFLE.format(key="usr", table=f"x{last}").removeprefix("WITH RECURSIVE ")
    ctes, final = shuffle.rsplit("\nSELECT ", 1)
    return f"""{base}, {ctes}, o AS (SELECT {final}), c AS (SELECT count(*) AS total, greatest(1, least(floor(count(*) * (1 - {ratio}::DOUBLE))::BIGINT, count(*) - 1)) AS start FROM o),
z AS (SELECT usr, idx, CASE WHEN idx >= start THEN 'test' WHEN idx < least(start, floor(total * {percent}::DOUBLE / 100)::BIGINT) THEN 'train' END AS split FROM o, c)
SELECT usr AS user, idx, split, string_agg(item, ',' ORDER BY pos) AS items FROM z JOIN x{last} USING (usr) WHERE split IS NOT NULL GROUP BY ALL"""


def _tables(got):
    return got.users.select("user", "idx", "split", text(F.col("history")).alias("items"))


@plan("full_pipeline", _tables_sql(_full_sql(24, 8), 3, 100, 0.1))
def full_pipeline(spark, d):
    return _tables(_full(spark, d))


def _core_rounds(prefix, allowed, n, longest, shortest, rounds):
    """Unrolled: {prefix}r is the histories after that many rounds and the last rebuild, {prefix}i its item set."""
    sql = f"{prefix}a0 AS MATERIALIZED (SELECT item FROM {allowed})"
    for k in range(rounds + 1):
        sql += f", {prefix}b{k} AS MATERIALIZED (SELECT * FROM {_cut(f'(SELECT usr, item, pos FROM inter SEMI JOIN {prefix}a{k} USING (item))', longest, shortest)})"
        sql += f", {prefix}a{k + 1} AS MATERIALIZED (SELECT item FROM {prefix}b{k} GROUP BY item HAVING count(*) >= {n})"
    return sql


def _small_sql(n, longest, shortest, rounds):
    return f"""WITH RECURSIVE {INTER}, {_SETS}, x0 AS MATERIALIZED (SELECT usr, item, pos FROM inter), {_core_rounds('p', 'cap', n, longest, shortest, rounds)},
x1 AS MATERIALIZED (SELECT * FROM pb{rounds}), kept AS (SELECT item FROM pa{rounds} SEMI JOIN vecs USING (item) SEMI JOIN x1 USING (item)), {_core_rounds('q', 'kept', n, longest, shortest, rounds)},
x2 AS MATERIALIZED (SELECT * FROM qb{rounds}), last AS (SELECT item FROM cap SEMI JOIN x2 USING (item)),
x3 AS MATERIALIZED (SELECT * FROM {_cut('(SELECT usr, item, pos FROM inter SEMI JOIN last USING (item))', longest, shortest)}), {', '.join(_ROWS(k) for k in range(4))}"""


def _small(spark, d):
    captions, complete = _sets(spark, d)
    return M.small_scale(D.histories(spark, d), captions, complete, 10, 15, 5, rounds=3, seed=42, test_ratio=0.1, percent=60)


@plan("small_scale_stages", _small_sql(10, 15, 5, 3) + ", " + _accounted(["raw", "captions_core", "vectors_core", "aligned"]))
def small_scale_stages(spark, d):
    return M.accounting(_small(spark, d).stages)


@plan("small_scale_pipeline", _tables_sql(_small_sql(10, 15, 5, 3), 3, 60, 0.1))
def small_scale_pipeline(spark, d):
    return _tables(_small(spark, d))


_LATEST_SQL = f"""WITH RECURSIVE {INTER}, {_SETS}, x0_rows AS MATERIALIZED (SELECT o_custkey AS usr, o_orderdate AS t, o_orderkey AS r, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
x0 AS MATERIALIZED (SELECT o_custkey AS usr, l_partkey AS item, l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
x1 AS MATERIALIZED (SELECT * FROM x0 SEMI JOIN cap USING (item) QUALIFY row_number() OVER (PARTITION BY r ORDER BY pos DESC) <= 4),
x1_rows AS MATERIALIZED (SELECT usr, t, r, coalesce(m, 0) AS n FROM x0_rows LEFT JOIN (SELECT r, count(*) AS m FROM x1 GROUP BY r) USING (r)),
x2_rows AS MATERIALIZED (SELECT * FROM x1_rows QUALIFY row_number() OVER (PARTITION BY usr ORDER BY t DESC, r DESC) = 1), x2 AS MATERIALIZED (SELECT * FROM x1 SEMI JOIN x2_rows USING (r)),
x3_rows AS MATERIALIZED (SELECT * FROM x2_rows WHERE n >= 2), x3 AS MATERIALIZED (SELECT * FROM x1 SEMI JOIN x3_rows USING (r))"""


def _latest(spark, d):
    lines = D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = D.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    baskets = S.fold(lines, "l_orderkey", "l_partkey", "l_linenumber")
    rows = orders.join(baskets, orders["o_orderkey"] == baskets["l_orderkey"]).select(F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("time"), "o_orderkey", "history")
    return M.latest_rows(rows, _sets(spark, d)[0], "time", ["o_orderkey"], 4, 2, seed=42, test_ratio=0.1)


@plan("latest_rows_stages", _LATEST_SQL + ", " + _accounted(["raw", "known_items", "latest_row", "long_enough"]))
def latest_rows_stages(spark, d):
    return M.accounting(_latest(spark, d).stages)


@plan("latest_rows_pipeline", _tables_sql(_LATEST_SQL, 3, 100, 0.1))
def latest_rows_pipeline(spark, d):
    return _tables(_latest(spark, d))
