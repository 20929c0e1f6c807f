"""Statistics of histories, items and columns."""

from pyspark.sql import functions as F

from histria.operators import frequency as Q
from histria.operators import profile as P
from histria.operators import sequences as S
from histria.sources import driver as D

from .registry import EVENTS, INTER, plan


def rounded(df, *names):
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


@plan("item_frequency", f"WITH {INTER} SELECT item, count(*) AS freq FROM inter GROUP BY item")
def item_frequency(spark, d):
    return Q.item_frequency(D.histories(spark, d))


@plan("usable_item_frequency", f"WITH {INTER} SELECT item, count(*) AS freq FROM inter JOIN (SELECT usr FROM inter GROUP BY usr HAVING count(*) >= 40) USING (usr) GROUP BY item")
def usable_item_frequency(spark, d):
    return Q.item_frequency(D.histories(spark, d), 40)


@plan("target_frequency", f"WITH {INTER} SELECT item, count(*) AS freq FROM inter WHERE pos > 0 GROUP BY item")
def target_frequency(spark, d):
    return Q.target_frequency(D.histories(spark, d))


@plan("stage_counts", f"WITH {INTER} SELECT count(*) AS rows, count(DISTINCT usr) AS users, sum(len(history))::BIGINT AS interactions FROM hist")
def stage_counts(spark, d):
    return P.stage_counts(D.histories(spark, d))


_P = ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{round(100 * p)}" for p in P.PERCENTS)
_DESCRIBE = f"count(v) AS count, round(sum(v), 6) AS sum, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, {_P}, max(v) AS max"
_ROUND = ("sum", "mean", "std", *[f"p{round(100 * p)}" for p in P.PERCENTS])


@plan("length_summary", f"WITH {INTER} SELECT {_DESCRIBE} FROM (SELECT len(history)::DOUBLE AS v FROM hist)")
def length_summary(spark, d):
    return rounded(P.describe(D.histories(spark, d), F.size("history")), *_ROUND)


@plan("numeric_describe", f"SELECT {_DESCRIBE} FROM (SELECT p_retailprice AS v FROM part)")
def numeric_describe(spark, d):
    return rounded(P.describe(D.items(spark, d), F.col("p_retailprice")), *_ROUND)


def _bucket_sql(source, buckets):
    rows = ", ".join(f"({i}, '{P.bucket_name(a, b)}', {a}, {'NULL' if b is None else b})" for i, (a, b) in enumerate(buckets))
    return f"""v AS (SELECT {source}), b(bucket_index, bucket, lo, hi) AS (VALUES {rows}),
    m AS (SELECT b.bucket_index, b.bucket, count(v.v) AS n FROM b LEFT JOIN v ON v.v >= lo AND (hi IS NULL OR v.v <= hi) GROUP BY ALL
      UNION ALL SELECT {len(buckets)}, 'unmatched', count(*) FROM v WHERE NOT EXISTS (SELECT 1 FROM b WHERE v.v >= lo AND (hi IS NULL OR v.v <= hi)))
    SELECT bucket_index, bucket, n, round(n / (SELECT count(*) FROM v), 6) AS ratio FROM m"""


@plan("length_buckets", f"WITH {INTER}, {_bucket_sql('len(history) AS v FROM hist', P.LENGTH_BUCKETS)}")
def length_buckets(spark, d):
    return rounded(P.count_buckets(D.histories(spark, d), F.size("history")), "ratio")


_OVERLAPPING = ((1, 1), (2, 25), (20, 30), (40, None))


@plan("popularity_histogram", f"WITH {INTER}, {_bucket_sql('count(*) AS v FROM inter GROUP BY item', _OVERLAPPING)}")
def popularity_histogram(spark, d):
    return rounded(P.count_buckets(Q.item_frequency(D.histories(spark, d)), F.col("freq"), _OVERLAPPING), "ratio")


@plan("equal_width_bins", """WITH l AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT least(12, greatest(1, ceil((p_retailprice - lo) / ((hi - lo) / 12))))::INT AS bin, count(*) AS n FROM part, l GROUP BY 1""")
def equal_width_bins(spark, d):
    return P.equal_width(D.items(spark, d), F.col("p_retailprice"), 12)


@plan("dataset_statistics", f"""WITH {INTER}, f AS (SELECT item, count(*) AS freq FROM inter GROUP BY item), n AS (SELECT usr, count(*) AS n FROM inter GROUP BY usr),
u AS (SELECT count(*) AS sequences, count(DISTINCT usr) AS users, count(DISTINCT usr) AS source_users, sum(n)::BIGINT AS interactions, round(avg(n), 6) AS mean_length, quantile_cont(n, 0.5) AS median_length,
  round(quantile_cont(n, 0.9), 6) AS p90_length, round(stddev_pop(n), 6) AS std_length, min(n)::INT AS min_length, max(n)::INT AS max_length FROM n),
i AS (SELECT count(*) AS observed_items, round(avg(freq), 6) AS mean_frequency, quantile_cont(freq, 0.5) AS median_frequency, round(stddev_pop(freq), 6) AS std_frequency, count(*) FILTER (WHERE freq < 25) AS cold_items FROM f),
c AS (SELECT count(DISTINCT p_partkey) AS catalog_items, count(DISTINCT p_partkey) FILTER (WHERE p_partkey IN (SELECT item FROM f)) AS covered_items FROM part)
SELECT *, round(100 * interactions / (users * catalog_items), 6) AS density_percent, round(100 - 100 * interactions / (users * catalog_items), 6) AS sparsity_percent,
  round(100 * cold_items / observed_items, 6) AS cold_percent, round(100 * covered_items / catalog_items, 6) AS coverage_percent FROM u, i, c""")
def dataset_statistics(spark, d):
    out = P.dataset_statistics(D.histories(spark, d), D.items(spark, d), 25)
    return rounded(out, "mean_length", "p90_length", "std_length", "mean_frequency", "std_frequency", "density_percent", "sparsity_percent", "cold_percent", "coverage_percent")


@plan("item_retention", f"""WITH {INTER}, r AS (SELECT s.scale_percent, 'scale' || s.scale_percent AS data, count(DISTINCT item) AS observed_items
  FROM inter, (VALUES (1), (10), (50), (99)) s(scale_percent) WHERE usr % 100 < s.scale_percent GROUP BY ALL)
SELECT data, scale_percent, observed_items, 'scale' AS family, round(100 * observed_items / (SELECT arg_max(observed_items, scale_percent) FROM r), 6) AS retention_percent FROM r""")
def item_retention(spark, d):
    i = D.log(spark, d).select("user", "item")
    scales = spark.createDataFrame([(1,), (10,), (50,), (99,)], "scale_percent int")
    r = i.join(F.broadcast(scales), F.col("user") % 100 < F.col("scale_percent")).groupBy("scale_percent").agg(F.count_distinct("item").alias("observed_items"))
    return rounded(P.retention(r.withColumn("data", F.concat(F.lit("scale"), F.col("scale_percent").cast("string")))), "retention_percent")


_FREQ = f"WITH {INTER}, f AS (SELECT item, count(*) AS x FROM inter GROUP BY item)"


def _counts(spark, d):
    return Q.item_frequency(D.histories(spark, d)).withColumnRenamed("freq", "cnt")


@plan("popularity_gini", f"{_FREQ} SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT x, row_number() OVER (ORDER BY x) AS i FROM f)")
def popularity_gini(spark, d):
    return rounded(P.gini(_counts(spark, d)), "gini")


@plan("effective_items", f"{_FREQ} SELECT round(exp(-sum(x / t * ln(x / t))), 6) AS effective_items FROM f, (SELECT sum(x) AS t FROM f)")
def effective_items(spark, d):
    return rounded(P.effective_items(_counts(spark, d)), "effective_items")


@plan("top_share", f"{_FREQ} SELECT round(sum(x) FILTER (WHERE i <= ceil(n * 0.1)) / sum(x), 6) AS top_share FROM (SELECT x, row_number() OVER (ORDER BY x DESC) AS i, count(*) OVER () AS n FROM f)")
def top_share(spark, d):
    return rounded(P.top_share(_counts(spark, d), 0.1), "top_share")


@plan("top_items", f"{_FREQ} SELECT item, x AS freq FROM f ORDER BY x DESC, item LIMIT 25")
def top_items(spark, d):
    return Q.item_frequency(D.histories(spark, d)).orderBy(F.desc("freq"), "item").limit(25)


_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_KINDS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@plan("column_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{_KINDS[c]}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
  min(length({c}::VARCHAR)) AS min_chars, round(avg(length({c}::VARCHAR)), 6) AS mean_chars, max(length({c}::VARCHAR)) AS max_chars FROM documents""" for c in _COLUMNS))
def column_profile(spark, d):
    return rounded(P.column_profile(D.read(spark, d, "documents"), _COLUMNS), "mean_chars")


@plan("history_profile", f"""WITH {INTER}, n AS (SELECT usr, count(*) AS n, count(DISTINCT item) AS u FROM inter GROUP BY usr)
SELECT count(*) AS rows, 0::BIGINT AS empty, sum(n)::BIGINT AS interactions, sum(u)::BIGINT AS unique_per_user, sum(n - u)::BIGINT AS repeats, count(*) FILTER (WHERE n > u) AS users_with_repeats, round(avg(n), 6) AS mean_length, max(n) AS max_length FROM n""")
def history_profile(spark, d):
    return rounded(P.history_profile(D.histories(spark, d)), "mean_length")


@plan("text_presence", """SELECT 'html' AS "column", count(*) FILTER (WHERE length(html) > 0) AS present, round(avg(length(html)) FILTER (WHERE length(html) > 0), 6) AS mean_size, max(length(html)) AS max_size FROM pages
UNION ALL SELECT 'url', count(*) FILTER (WHERE length(url) > 0), round(avg(length(url)) FILTER (WHERE length(url) > 0), 6), max(length(url)) FROM pages""")
def text_presence(spark, d):
    return rounded(P.presence(D.read(spark, d, "pages"), ["html", "url"], F.length), "mean_size")


@plan("sequence_presence", """SELECT 'embedding' AS "column", count(*) FILTER (WHERE len(embedding) > 0) AS present, round(avg(len(embedding)), 6) AS mean_size, max(len(embedding)) AS max_size FROM embeddings""")
def sequence_presence(spark, d):
    return rounded(P.presence(D.vectors(spark, d), ["embedding"], F.size), "mean_size")


@plan("split_overlap", f"""WITH {INTER}, s AS (SELECT CASE WHEN usr % 10 < 6 THEN 'finetune' WHEN usr % 10 < 8 THEN 'valid' ELSE 'test' END AS split, item FROM inter GROUP BY ALL),
p(l, r) AS (VALUES ('finetune', 'valid'), ('finetune', 'test'), ('valid', 'test'))
SELECT l AS "left", r AS "right", (SELECT count(*) FROM s WHERE split = l) AS n_left, (SELECT count(*) FROM s WHERE split = r) AS n_right,
  (SELECT count(*) FROM s a JOIN s b USING (item) WHERE a.split = l AND b.split = r) AS n_both FROM p""")
def split_overlap(spark, d):
    i = D.log(spark, d).select("user", "item")
    m = F.col("user") % 10
    return P.overlaps({"finetune": i.where(m < 6), "valid": i.where((m >= 6) & (m < 8)), "test": i.where(m >= 8)}, "item")


@plan("common_items", f"WITH {INTER} SELECT item FROM inter WHERE usr % 10 < 3 INTERSECT SELECT item FROM inter WHERE usr % 10 > 6 INTERSECT SELECT p_partkey FROM part WHERE p_size > 10")
def common_items(spark, d):
    i = D.log(spark, d).select("user", "item")
    return P.common_keys([i.where("user % 10 < 3"), i.where("user % 10 > 6"), D.items(spark, d).where("p_size > 10")], "item")


@plan("missing_items", f"WITH {INTER} SELECT item FROM inter EXCEPT SELECT p_partkey FROM part WHERE p_size > 5")
def missing_items(spark, d):
    return P.missing_items(D.histories(spark, d), D.items(spark, d).where("p_size > 5"))


@plan("seen_rate", f"""WITH {INTER}, f AS (SELECT item, count(*) AS freq FROM inter WHERE usr % 10 < 1 GROUP BY item), t AS (SELECT history[-1] AS item FROM hist WHERE usr % 10 >= 8)
SELECT count(*) AS targets, count(freq) AS seen, round(count(freq) / count(*), 6) AS seen_rate, round(avg(coalesce(freq, 0)), 6) AS mean_frequency FROM t LEFT JOIN f USING (item)""")
def seen_rate(spark, d):
    h = D.histories(spark, d)
    return rounded(P.seen_rate(S.targets(h.where("user % 10 >= 8")), Q.item_frequency(h.where("user % 10 < 1"))), "seen_rate", "mean_frequency")


@plan("id_space_coverage", f"""WITH {INTER}, i AS (SELECT DISTINCT item FROM inter)
SELECT 'vectors' AS name, count(*) AS ids, count(*) FILTER (WHERE item IN (SELECT vec_id FROM embeddings)) AS covered, round(100 * count(*) FILTER (WHERE item IN (SELECT vec_id FROM embeddings)) / count(*), 6) AS percent FROM i
UNION ALL SELECT 'captions', count(*), count(*) FILTER (WHERE item IN (SELECT doc_id FROM documents)), round(100 * count(*) FILTER (WHERE item IN (SELECT doc_id FROM documents)) / count(*), 6) FROM i""")
def id_space_coverage(spark, d):
    docs = D.read(spark, d, "documents").select(F.col("doc_id").alias("item"))
    return rounded(P.coverage_by(D.log(spark, d), {"vectors": D.vectors(spark, d), "captions": docs}, "item"), "percent")


# Frequency breakdowns. The rank of a target is a fixed function of the row, with misses.
_RANKS = f"""{INTER}, t AS (SELECT usr, history[-1] AS target, CASE WHEN usr % 7 = 0 THEN NULL ELSE usr % 23 + 1 END AS rank FROM hist),
f AS (SELECT item, count(*) AS freq FROM inter WHERE pos > 0 AND usr % 10 < 5 GROUP BY item)"""
_BOUNDS = [0, 5, 15, 20, 1000]


def _records(spark, d):
    h = D.histories(spark, d)
    rec = h.select(F.element_at("history", -1).alias("target"), F.when(F.col("user") % 7 != 0, F.col("user") % 23 + 1).cast("int").alias("rank"), "user")
    return rec, Q.target_frequency(h.where("user % 10 < 5"))


@plan("frequency_breakdown", f"""WITH {_RANKS}, b(bucket_index, frequency_bucket, low, high) AS (VALUES (0, '0', 0, 0), (1, '1-5', 1, 5), (2, '6-15', 6, 15), (3, '16-20', 16, 20), (4, '21-1000', 21, 1000), (5, '1001+', 1001, NULL)),
r AS (SELECT target, rank, coalesce(freq, 0) AS freq FROM t LEFT JOIN f ON target = item)
SELECT bucket_index, frequency_bucket, count(target) AS n, count(DISTINCT target) AS unique_targets, round(count(target) / (SELECT count(*) FROM t), 6) AS share, quantile_cont(freq, 0.5) AS median_frequency,
  round(avg(CASE WHEN target IS NULL THEN NULL WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS hr5, round(avg(CASE WHEN target IS NULL THEN NULL WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg5,
  round(avg(CASE WHEN target IS NULL THEN NULL WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hr10, round(avg(CASE WHEN target IS NULL THEN NULL WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg10,
  round(avg(CASE WHEN target IS NULL THEN NULL ELSE coalesce(1 / rank, 0) END), 6) AS mrr
FROM b LEFT JOIN r ON freq >= low AND (high IS NULL OR freq <= high) GROUP BY bucket_index, frequency_bucket""")
def frequency_breakdown(spark, d):
    rec, freq = _records(spark, d)
    return rounded(Q.breakdown(rec, freq, _BOUNDS, [5, 10]).drop("low", "high"), "share", "hr5", "ndcg5", "hr10", "ndcg10", "mrr")


_TQ = "tq AS (SELECT p_partkey AS item, p_size * 0.5 AS tq FROM part)"


def _items_with_metrics(spark, d, shift):
    rec, freq = _records(spark, d)
    rec = rec.withColumn("rank", F.when((F.col("user") + shift) % 7 != 0, (F.col("user") + shift) % 23 + 1).cast("int"))
    hit, ndcg, mrr = Q.rank_metrics(F.col("rank"), 10)
    rows = rec.join(freq, rec["target"] == freq["item"], "left").select(F.col("target").alias("item_id"), F.coalesce("freq", F.lit(0)).alias("frequency"), hit.alias("hr10"), ndcg.alias("ndcg10"), mrr.alias("mrr"))
    return Q.per_item(rows.withColumn("frequency_bucket", Q.frequency_bucket(F.col("frequency"), _BOUNDS)))


def _metrics_sql(name, shift):
    return f"""{name} AS (SELECT target AS item_id, max(coalesce(freq, 0)) AS frequency, avg(CASE WHEN rk <= 10 THEN 1 ELSE 0 END) AS hr10, avg(CASE WHEN rk <= 10 THEN 1 / log2(rk + 1) ELSE 0 END) AS ndcg10, avg(coalesce(1 / rk, 0)) AS mrr
      FROM (SELECT target, CASE WHEN (usr + {shift}) % 7 = 0 THEN NULL ELSE (usr + {shift}) % 23 + 1 END AS rk FROM t) LEFT JOIN f ON target = item GROUP BY target)"""


_CASE = "CASE WHEN frequency = 0 THEN '0' WHEN frequency <= 5 THEN '1-5' WHEN frequency <= 15 THEN '6-15' WHEN frequency <= 20 THEN '16-20' WHEN frequency <= 1000 THEN '21-1000' ELSE '1001+' END"


@plan("per_item_ranking", f"WITH {_RANKS}, {_metrics_sql('m', 0)} SELECT item_id, frequency, {_CASE} AS frequency_bucket, round(hr10, 6) AS hr10, round(ndcg10, 6) AS ndcg10, round(mrr, 6) AS mrr FROM m")
def per_item_ranking(spark, d):
    return rounded(_items_with_metrics(spark, d, 0), "hr10", "ndcg10", "mrr")


_THRESHOLD = f"""v AS (SELECT g, v, count(*) AS c FROM x GROUP BY ALL), w AS (SELECT g, v, sum(c) OVER (PARTITION BY g ORDER BY v) AS l, sum(c) OVER (PARTITION BY g) AS n, max(v) OVER (PARTITION BY g) AS top FROM v),
th AS (SELECT g, arg_min(v, (abs(2 * l - n), v)) AS threshold FROM w WHERE v < top GROUP BY g)"""


@plan("transfer_threshold", f"WITH x AS (SELECT p_brand AS g, p_size * 0.5 AS v FROM part), {_THRESHOLD} SELECT g AS p_brand, threshold::DOUBLE AS threshold FROM th")
def transfer_threshold(spark, d):
    return Q.balanced_threshold(D.items(spark, d).withColumn("v", F.col("p_size") * 0.5), "v", "p_brand").withColumn("threshold", F.col("threshold").cast("double"))


@plan("transfer_quality", f"""WITH x AS (SELECT 0 AS g, p_size * 0.5 AS v FROM part), {_THRESHOLD}
SELECT CASE WHEN v > threshold THEN 'high' ELSE 'low' END AS quality, count(*) AS n, max(threshold)::DOUBLE AS threshold FROM x, th GROUP BY 1""")
def transfer_quality(spark, d):
    out = Q.assign_quality(D.items(spark, d).withColumn("v", F.col("p_size") * 0.5), "v")
    return out.groupBy("quality").agg(F.count("*").alias("n"), F.max("threshold").cast("double").alias("threshold"))


@plan("transfer_summary", f"""WITH {_RANKS}, {_TQ}, {_metrics_sql('a', 0)}, {_metrics_sql('b', 5)},
j AS (SELECT {_CASE} AS g, tq AS v, a.hr10 AS uid_hr10, a.ndcg10 AS uid_ndcg10, a.mrr AS uid_mrr, b.hr10 AS sid_hr10, b.ndcg10 AS sid_ndcg10, b.mrr AS sid_mrr FROM a JOIN b USING (item_id, frequency) JOIN tq ON item_id = tq.item), x AS (SELECT g, v FROM j), {_THRESHOLD}
SELECT g AS frequency_bucket, CASE WHEN v > threshold THEN 'high' ELSE 'low' END AS quality, count(*) AS n, round(avg(v), 6) AS mean_tq, round(avg(uid_hr10), 6) AS uid_hr10, round(avg(uid_ndcg10), 6) AS uid_ndcg10, round(avg(uid_mrr), 6) AS uid_mrr,
  round(avg(sid_hr10), 6) AS sid_hr10, round(avg(sid_ndcg10), 6) AS sid_ndcg10, round(avg(sid_mrr), 6) AS sid_mrr, round(avg(sid_hr10) - avg(uid_hr10), 6) AS delta_hr10, round(avg(sid_ndcg10) - avg(uid_ndcg10), 6) AS delta_ndcg10, round(avg(sid_mrr) - avg(uid_mrr), 6) AS delta_mrr
FROM j JOIN th USING (g) GROUP BY 1, 2""")
def transfer_summary(spark, d):
    tq = D.items(spark, d).select(F.col("item").alias("item_id"), (F.col("p_size") * 0.5).cast("double").alias("tq"))
    out = Q.transfer_summary(_items_with_metrics(spark, d, 0), _items_with_metrics(spark, d, 5), tq)
    return rounded(out, *[c for c in out.columns if c not in ("frequency_bucket", "quality", "n")])


@plan("event_type_counts", f"WITH {EVENTS} SELECT event_type, count(*) AS n, count(DISTINCT usr) AS users, count(DISTINCT item) AS items FROM ev GROUP BY 1")
def event_type_counts(spark, d):
    return D.events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), F.count_distinct("item").alias("items"))
