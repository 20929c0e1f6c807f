"""Histories from the order log and the event stream."""

from pyspark.sql import functions as F

from histria.operators import sequences as S
from histria.sources import driver as D

from .registry import EVENTS, INTER, plan


def text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def shown(df, *extra):
    return df.select("user", *extra, F.size("history").cast("long").alias("n"), text(F.col("history")).alias("items"))


_TEXT = "array_to_string(history, ',')"


@plan("user_histories", f"WITH {INTER} SELECT usr AS user, len(history)::BIGINT AS n, {_TEXT} AS items FROM hist")
def user_histories(spark, d):
    return shown(D.histories(spark, d))


@plan("event_histories", f"WITH {EVENTS} SELECT usr AS user, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM ev GROUP BY usr")
def event_histories(spark, d):
    return shown(S.fold(D.events(spark, d), "user", "item", "pos"))


@plan("history_tail", f"WITH {INTER} SELECT usr AS user, least(len(history), 20)::BIGINT AS n, array_to_string(history[-20:], ',') AS items FROM hist")
def history_tail(spark, d):
    return shown(D.histories(spark, d).withColumn("history", S.tail(F.col("history"), 20)))


@plan("history_head", f"WITH {INTER} SELECT usr AS user, least(len(history), 7)::BIGINT AS n, array_to_string(history[:7], ',') AS items FROM hist")
def history_head(spark, d):
    return shown(D.histories(spark, d).withColumn("history", S.head_or_tail(F.col("history"), 7)))


@plan("history_min_length", f"WITH {INTER} SELECT usr AS user, least(len(history), 40)::BIGINT AS n, array_to_string(history[-40:], ',') AS items FROM hist WHERE len(history) >= 30")
def history_min_length(spark, d):
    return shown(S.length_limits(D.histories(spark, d), 40, 30))


@plan("history_chunks", f"""WITH {INTER} SELECT usr AS user, pos // 16 AS segment, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items
FROM inter GROUP BY usr, pos // 16 HAVING count(*) >= 5""")
def history_chunks(spark, d):
    return shown(S.chunks(D.histories(spark, d), 16, 5), "segment")


@plan("segment_records", f"""WITH {INTER}, c AS (SELECT usr, pos // 16 AS segment, count(*) AS n FROM inter GROUP BY ALL HAVING count(*) >= 5)
SELECT 'hist-finetune-' || lpad((row_number() OVER (ORDER BY usr::VARCHAR, segment) - 1)::VARCHAR, 8, '0') AS uid, usr AS source_uid, segment AS segment_index,
  n AS segment_length, row_number() OVER (ORDER BY usr::VARCHAR, segment) - 1 AS global_sequence_index FROM c""")
def segment_records(spark, d):
    out = S.segment_records(D.histories(spark, d), 16, 5, "hist", "finetune").drop("history")
    return out.withColumn("segment_length", F.col("segment_length").cast("long"))


_SMALL = "small AS (SELECT p_partkey AS item FROM part WHERE p_size <= 25)"


@plan("aligned_histories", f"WITH {INTER}, {_SMALL} SELECT usr AS user, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM inter SEMI JOIN small USING (item) GROUP BY usr")
def aligned_histories(spark, d):
    return shown(S.align(D.histories(spark, d), D.items(spark, d).where("p_size <= 25")))


@plan("latest_valid_backfill", f"""WITH {INTER}, {_SMALL}, r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY pos DESC) AS rn FROM inter SEMI JOIN small USING (item))
SELECT usr AS user, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM r WHERE rn <= 10 GROUP BY usr HAVING count(*) >= 3""")
def latest_valid_backfill(spark, d):
    return shown(S.latest_valid(D.histories(spark, d), D.items(spark, d).where("p_size <= 25"), 10, 3))


@plan("filter_and_chunk", f"""WITH {INTER}, {_SMALL}, r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY pos) - 1 AS k FROM inter SEMI JOIN small USING (item))
SELECT usr AS user, (k // 8)::INT AS segment, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM r GROUP BY usr, k // 8 HAVING count(*) >= 2""")
def filter_and_chunk(spark, d):
    return shown(S.filter_and_chunk(D.histories(spark, d), D.items(spark, d).where("p_size <= 25"), 8, 2), "segment")


@plan("latest_per_user", """SELECT o_custkey AS user, arg_max(o_orderkey, (o_orderdate, o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def latest_per_user(spark, d):
    o = D.read(spark, d, "orders").select(F.col("o_custkey").alias("user"), "o_orderkey", "o_orderdate", "o_totalprice")
    return S.latest_per_user(o, "user", "o_orderdate", "o_totalprice", "o_orderkey").select("user", "o_orderkey")


@plan("positive_histories", f"WITH {EVENTS} SELECT usr AS user, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM ev WHERE event_type IN ('purchase', 'click') GROUP BY usr")
def positive_histories(spark, d):
    e = D.events(spark, d).withColumn("label", F.col("event_type").isin("purchase", "click").cast("int"))
    return shown(S.fold(S.positives(e), "user", "item", "pos"))


@plan("rating_labels", """WITH r AS (SELECT l_partkey AS item, l_quantity / 10 AS rating FROM lineitem)
SELECT item, count(*) FILTER (WHERE rating <> 3) AS rated, count(*) FILTER (WHERE rating <> 3 AND rating >= 4) AS good,
  count(*) FILTER (WHERE rating <> 3 AND rating > 3) AS liked, count(*) FILTER (WHERE trunc(rating) <> 3 AND trunc(rating) > 3) AS whole FROM r GROUP BY item HAVING rated > 0""")
def rating_labels(spark, d):
    r = D.read(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_quantity") / 10).alias("rating"))
    a = S.rating_label(r, "rating", 4, True).groupBy("item").agg(F.count("*").alias("rated"), F.sum("label").cast("long").alias("good"))
    b = S.rating_label(r, "rating", 3, False).groupBy("item").agg(F.sum("label").cast("long").alias("liked"))
    c = S.rating_label(r, "rating", 3, False, truncate=True).groupBy("item").agg(F.sum("label").cast("long").alias("whole"))
    return a.join(b, "item").join(c, "item", "left").fillna(0, ["whole"])


@plan("keep_first_items", "SELECT p_brand, min_by(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def keep_first_items(spark, d):
    return S.keep_first(D.read(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey")


def _core_sql(n, longest, shortest, rounds):
    cut = lambda src: f"""(SELECT * FROM (SELECT usr, item, pos, row_number() OVER (PARTITION BY usr ORDER BY pos DESC) AS rn, count(*) OVER (PARTITION BY usr) AS n FROM {src})
      WHERE rn <= {longest} AND least(n, {longest}) >= {shortest})"""  # noqa: E731
    sql = f"WITH {INTER}, r0 AS MATERIALIZED (SELECT usr, item, pos FROM {cut('inter')})"
    for k in range(rounds):
        sql += f", f{k} AS (SELECT * FROM r{k} SEMI JOIN (SELECT item FROM r{k} GROUP BY item HAVING count(*) >= {n}) USING (item)), r{k + 1} AS MATERIALIZED (SELECT usr, item, pos FROM {cut(f'f{k}')})"
    return sql + f" SELECT usr AS user, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM r{rounds} GROUP BY usr"


@plan("ncore_three_rounds", _core_sql(24, 40, 10, 3))
def ncore_three_rounds(spark, d):
    return shown(S.n_core_rounds(D.histories(spark, d), 24, 40, 10))


def _fixpoint_sql(n, longest, shortest, rounds):
    sql = f"WITH {INTER}, a0 AS (SELECT DISTINCT item FROM inter)"
    for k in range(rounds + 1):
        sql += f""", b{k} AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY usr) AS n FROM (SELECT usr, item, pos, row_number() OVER (PARTITION BY usr ORDER BY pos DESC) AS rn
          FROM inter SEMI JOIN a{k} USING (item)) WHERE rn <= {longest}) WHERE n >= {shortest}), a{k + 1} AS MATERIALIZED (SELECT item FROM b{k} GROUP BY item HAVING count(*) >= {n})"""
    return sql + f" SELECT usr AS user, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM b{rounds} GROUP BY usr"


@plan("ncore_backfill", _fixpoint_sql(10, 15, 5, 2))
def ncore_backfill(spark, d):
    return shown(S.n_core_fixpoint(D.histories(spark, d), 10, 15, 5, max_rounds=2, parts=D.log_parts(spark, d)).histories)


@plan("public_items", f"""WITH {INTER} SELECT item FROM (SELECT item FROM inter WHERE usr % 10 < 3 UNION SELECT p_partkey FROM part WHERE p_size = 1)""")
def public_items(spark, d):
    h = D.histories(spark, d).where("user % 10 < 3")
    extra = D.items(spark, d).where("p_size = 1").select(F.array("item").alias("history"))
    return S.public_items([h.select("history"), extra])


@plan("target_items", f"WITH {INTER} SELECT usr AS user, history[-1] AS item FROM hist")
def target_items(spark, d):
    return S.targets(D.histories(spark, d))
