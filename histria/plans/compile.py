"""Splits, samples, text functions, catalogues and streaming extensions."""

from pyspark.sql import functions as F

from histria.functions import text as X
from histria.operators import catalog as K
from histria.operators import codes as C
from histria.operators import frequency as Q
from histria.operators import profile as P
from histria.operators import samples as M
from histria.operators import sequences as S
from histria.operators import splits as L
from histria.operators import vectors as V
from histria.operators.shared import saved
from histria.sources import driver as D
from histria.streaming import events as E

from .analytics import _CODES, _M, _codes
from .registry import EVENTS, INTER, plan


def rounded(df, *names):
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# Splits. Users in the order of sha256("7:user").
_ORDER = f"{INTER}, us AS (SELECT DISTINCT usr FROM inter), od AS (SELECT usr, row_number() OVER (ORDER BY sha256('7:' || usr), usr::VARCHAR) - 1 AS idx, count(*) OVER () AS n FROM us)"


def _ordered(spark, d):
    return L.hash_order(D.log(spark, d).select("user").distinct(), "user", 7)


@plan("hash_order_split", f"""WITH {_ORDER}, c AS (SELECT *, greatest(1, least(floor(n * 0.8)::BIGINT, n - 1)) AS ft FROM od)
SELECT usr AS user, idx, CASE WHEN idx < ft THEN 'finetune' WHEN idx < ft + greatest(1, floor((n - ft) * 0.2::DOUBLE)::BIGINT) THEN 'valid' ELSE 'test' END AS split FROM c""")
def hash_order_split(spark, d):
    o = _ordered(spark, d)
    return L.ratio_split(o, o.count(), 0.8).withColumn("idx", F.col("idx").cast("long"))


@plan("count_split", f"WITH {_ORDER} SELECT usr AS user, CASE WHEN idx < 20 THEN 'valid' WHEN idx < 100 THEN 'test' ELSE 'finetune' END AS split FROM od WHERE idx < 600")
def count_split(spark, d):
    return L.count_split(_ordered(spark, d), 100, 500).drop("idx")


@plan("official_test_split", f"WITH {_ORDER} SELECT usr AS user, CASE WHEN idx < 50 THEN 'valid' ELSE 'finetune' END AS split FROM od WHERE idx < 450")
def official_test_split(spark, d):
    return L.official_test_split(_ordered(spark, d), 50, 400).drop("idx")


@plan("nested_scales", f"""WITH {_ORDER}, s AS (SELECT *, greatest(1, least(floor(n * 0.997)::BIGINT, n - 1)) AS start FROM od), x AS (SELECT *, CASE WHEN idx >= start THEN 'test' WHEN idx < least(floor(n * p / 100)::BIGINT, start) THEN 'train' END AS split FROM s, (VALUES (1), (10), (50), (99)) t(p))
SELECT p AS scale_percent, split, count(*) AS users, min(idx) AS first, max(idx) AS last FROM x WHERE split IS NOT NULL GROUP BY ALL""")
def nested_scales(spark, d):
    o = _ordered(spark, d)
    out = L.nested_scales(o, o.count(), [1, 10, 50, 99])
    return out.groupBy("scale_percent", "split").agg(F.count("*").alias("users"), F.min("idx").cast("long").alias("first"), F.max("idx").cast("long").alias("last"))


@plan("hash_sample", f"WITH {_ORDER} SELECT usr AS user FROM od WHERE idx < 40")
def hash_sample(spark, d):
    return L.hash_sample(D.log(spark, d).select("user").distinct(), "user", 40, 7)


_SHUFFLE = """WITH RECURSIVE n AS (SELECT count(DISTINCT {key}) AS n FROM {table}),
u AS (SELECT i, n - 1 - i AS c, i + 1 AS upper, CASE WHEN i + 1 < 256 THEN 1 WHEN i + 1 < 65536 THEN 2 WHEN i + 1 < 16777216 THEN 3 ELSE 4 END AS size FROM n, LATERAL (SELECT unnest(range(0, n)) AS i)),
v AS (SELECT i, upper, nonce, size, ('0x' || substr(sha256('42:' || c || ':' || nonce), 1, (2 * size)::INT))::BIGINT AS v FROM u, range(0, 40) t(nonce)),
s AS MATERIALIZED (SELECT i, arg_min(v % upper, nonce) AS j FROM v WHERE v < (1::BIGINT << (8 * size)) // upper * upper GROUP BY i),
up AS MATERIALIZED (SELECT j AS k, min(i) AS up FROM s WHERE i > j GROUP BY j),
l AS (SELECT i, j, lead(i) OVER (PARTITION BY j ORDER BY i) AS k FROM s),
f AS (SELECT i, coalesce(k, j) AS pos, k IS NOT NULL AS going FROM l UNION ALL SELECT i, coalesce(up, pos), up IS NOT NULL FROM f LEFT JOIN up ON up.k = f.pos WHERE going),
k AS (SELECT {key}, row_number() OVER (ORDER BY {key}::VARCHAR) - 1 AS pos FROM (SELECT DISTINCT {key} FROM {table}))
SELECT {key}, i AS idx FROM f JOIN k USING (pos) WHERE NOT going"""


@plan("exact_shuffle", _SHUFFLE.format(key="o_orderkey", table="orders"))
def exact_shuffle(spark, d):
    """Fisher-Yates over all orders; tests compare it with the plain loop."""
    return L.exact_shuffle(D.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42)


@plan("exact_shuffle_parts", _SHUFFLE.format(key="p_partkey", table="part"))
def exact_shuffle_parts(spark, d):
    return L.exact_shuffle(D.items(spark, d).select(F.col("item").alias("p_partkey")), "p_partkey", 42)


_POLICY = _SHUFFLE.format(key="usr", table="us").removeprefix("WITH RECURSIVE ")
_POLICY_CTES, _POLICY_LAST = _POLICY.rsplit("\nSELECT ", 1)


@plan("public_sets", f"""WITH RECURSIVE {INTER}, us AS (SELECT usr FROM inter WHERE usr % 10 <> 0), {_POLICY_CTES}, o AS (SELECT {_POLICY_LAST}), t AS (SELECT count(*) AS n, greatest(1, least(floor(count(*) * 0.7::DOUBLE)::BIGINT, count(*) - 1)) AS ft FROM o),
te AS (SELECT DISTINCT usr FROM inter WHERE usr % 10 = 0)
SELECT 'counts' AS policy, usr AS user, CASE WHEN idx < 8 THEN 'valid' WHEN idx < 40 THEN 'test' ELSE 'finetune' END AS split FROM o WHERE idx < 100
UNION ALL SELECT 'official', usr, CASE WHEN idx < 40 THEN 'valid' ELSE 'finetune' END FROM o WHERE idx < 100 UNION ALL SELECT 'official', usr, 'test' FROM te
UNION ALL SELECT 'ratio', usr, CASE WHEN idx < ft THEN 'finetune' WHEN idx < ft + greatest(1, floor((n - ft) * 0.2::DOUBLE)::BIGINT) THEN 'valid' ELSE 'test' END FROM o, t
UNION ALL SELECT 'ratio, given test', usr, CASE WHEN idx < ft THEN 'finetune' ELSE 'valid' END FROM o, t UNION ALL SELECT 'ratio, given test', usr, 'test' FROM te""")
def public_sets(spark, d):
    """The three policies over the users of the order log; some have their test users given."""
    users = saved(D.log(spark, d).select("user").distinct())
    mine, given = users.where("user % 10 <> 0"), users.where("user % 10 = 0")
    same = {"ordered": saved(L.exact_shuffle(mine, "user", 42))}
    cuts = {
        "counts": L.public_sets(mine, "counts", 42, pool=40, finetune=60, **same), "official": L.public_sets(mine, "official", 42, official=given, pool=40, finetune=60, **same),
        "ratio": L.public_sets(mine, "ratio", 42, ratio=0.7, **same), "ratio, given test": L.public_sets(mine, "ratio", 42, official=given, ratio=0.7, remaining_as_valid=True, **same),
    }
    out = None
    for name, cut in cuts.items():
        one = cut.select(F.lit(name).alias("policy"), "user", "split")
        out = one if out is None else out.unionByName(one)
    return out


# Samples. An item costs a marker and its uid, a marker and its three codes.
_LEN = f"""{INTER}, lg AS (SELECT usr, pos, 2 + 1 + 3 + item % 2 AS len, 2 + item % 2 AS last_len, count(*) OVER (PARTITION BY usr) AS n, row_number() OVER (PARTITION BY usr ORDER BY pos DESC) AS rn FROM inter)"""


def _lengths(spark, d):
    i = D.interactions(spark, d)
    extra = F.col("item") % 2
    return i.select("user", "pos", (M.item_length([F.lit(1), F.lit(3)]) + extra).alias("len"), (M.item_length([F.lit(1)]) + extra).alias("last_len"))


_SUFFIX = f"""{_LEN}, cs AS (SELECT *, sum(CASE WHEN rn = 1 THEN last_len ELSE len END) OVER (PARTITION BY usr ORDER BY rn) + (rn - 1) AS total FROM lg),
sf AS (SELECT usr, min(pos) AS start, max(rn) AS n_items, max(total)::BIGINT AS total FROM cs WHERE total <= 128 GROUP BY usr HAVING max(rn) >= 2)"""


@plan("usable_suffix", f"WITH {_SUFFIX} SELECT usr AS user, start, n_items, total FROM sf")
def usable_suffix(spark, d):
    return M.usable_suffix(_lengths(spark, d), 128, 1)


@plan("usable_history", f"""WITH {_LEN}, h AS (SELECT *, rn - 1 AS k FROM lg WHERE rn > 1), cs AS (SELECT *, sum(len) OVER (PARTITION BY usr ORDER BY k) + k + 9 + 2 AS total FROM h)
SELECT usr AS user, min(pos) AS start, max(k) AS n_items, max(total)::BIGINT AS total FROM cs WHERE total <= 100 GROUP BY usr""")
def usable_history(spark, d):
    long = _lengths(spark, d)
    target = long.groupBy("user").agg(F.max("pos").alias("target_pos")).withColumn("target_len", F.lit(2))
    return M.usable_history(long, target, 100, 9, 1)


@plan("finetune_samples", f"""WITH {_SUFFIX} SELECT usr AS user, array_to_string(history[start + 1:], ',') AS sequence, n_items AS sequence_item_count, n_items - 1 AS prediction_count, total AS total_input_length FROM sf JOIN hist USING (usr)""")
def finetune_samples(spark, d):
    h = D.histories(spark, d).withColumnRenamed("history", "uids")
    out = M.finetune_samples(h, M.usable_suffix(_lengths(spark, d), 128, 1))
    return out.withColumn("sequence", joined(F.col("sequence_uids"))).drop("sequence_uids")


@plan("eval_samples", f"""WITH {_LEN}, h AS (SELECT *, rn - 1 AS k FROM lg WHERE rn > 1), cs AS (SELECT *, sum(len) OVER (PARTITION BY usr ORDER BY k) + k + 9 + 2 AS total FROM h),
u AS (SELECT usr, min(pos) AS start, max(k) AS n_items, max(total)::BIGINT AS total FROM cs WHERE total <= 100 GROUP BY usr)
SELECT usr AS user, array_to_string(history[start + 1:len(history) - 1], ',') AS sequence, history[-1] AS target_uid, history[-1]::VARCHAR AS truths, n_items AS history_item_count, total AS total_input_length, len(history) - 1 AS target_pos FROM u JOIN hist USING (usr)""")
def eval_samples(spark, d):
    long = _lengths(spark, d)
    target = long.groupBy("user").agg(F.max("pos").alias("target_pos")).withColumn("target_len", F.lit(2))
    out = M.eval_samples(D.histories(spark, d).withColumnRenamed("history", "uids"), M.usable_history(long, target, 100, 9, 1))
    return out.select("user", joined(F.col("history_uids")).alias("sequence"), "target_uid", joined(F.col("ground_truth_uids")).alias("truths"), "history_item_count", "total_input_length", "target_pos")


@plan("uid_vocabulary", "SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS uid FROM part")
def uid_vocabulary(spark, d):
    return M.vocabulary(D.items(spark, d).select("item")).withColumn("uid", F.col("uid").cast("long"))


@plan("packed_lengths", f"WITH {_LEN} SELECT usr AS user, (sum(CASE WHEN rn = 1 THEN 2 ELSE len END) + 2 * (count(*) - 1))::BIGINT AS total FROM lg GROUP BY usr")
def packed_lengths(spark, d):
    h = S.fold(_lengths(spark, d).withColumnRenamed("len", "item"), "user", "item", "pos")
    return h.select("user", M.packed_length(F.col("history"), F.lit(2), 2).cast("long").alias("total"))


@plan("sample_statistics", f"WITH {_SUFFIX} SELECT count(*) AS samples, round(avg(n_items), 6) AS mean_items, max(n_items) AS max_items, round(avg(total), 6) AS mean_length, max(total) AS max_length, quantile_cont(total, 0.5) AS median_length FROM sf")
def sample_statistics(spark, d):
    return rounded(M.sample_statistics(M.usable_suffix(_lengths(spark, d), 128, 1), "n_items", "total"), "mean_items", "mean_length")


# Text
@plan("clean_titles", r"""SELECT page_id, length(c)::BIGINT AS chars, sha256(c) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '&#[0-9]+;', '', 'g'), '&[a-zA-Z]+;', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g') AS c FROM pages)""")
def clean_titles(spark, d):
    c = X.clean_title(F.col("html"))
    return D.read(spark, d, "pages").select("page_id", F.length(c).cast("long").alias("chars"), F.sha2(c, 256).alias("digest"))


@plan("ascii_titles", "SELECT doc_id, sha256(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) AS digest FROM documents")
def ascii_titles(spark, d):
    return D.read(spark, d, "documents").select("doc_id", F.sha2(X.ascii_only(F.col("text")), 256).alias("digest"))


@plan("tokenize_text", r"""SELECT doc_id, len(t)::BIGINT AS tokens, array_to_string(t[:12], ' ') AS head FROM (SELECT doc_id, regexp_extract_all(lower(trim(text)), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM documents)""")
def tokenize_text(spark, d):
    t = X.tokens(F.col("text"))
    return D.read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.array_join(F.slice(t, 1, 12), " ").alias("head"))


@plan("item_text_profile", """SELECT p_partkey AS item, 'p_name: ' || p_name || ', p_brand: ' || p_brand || ', p_type: ' || p_type AS text FROM part""")
def item_text_profile(spark, d):
    return D.items(spark, d).select("item", X.item_text(["p_name", "p_brand", "p_type"]).alias("text"))


@plan("experiment_pairs", """WITH e(name, data, repr, parts) AS (SELECT 'run' || p_partkey, p_brand || p_type, CASE p_partkey % 4 WHEN 0 THEN 'uid+emb' WHEN 1 THEN 'emb+sid' WHEN 2 THEN 'sid' ELSE 'uid' END, CASE WHEN p_partkey % 4 < 2 THEN 'emb' ELSE '' END FROM part)
SELECT u.name AS uid_name, s.name AS sid_name FROM e u JOIN e s USING (data, parts) WHERE u.repr LIKE '%uid%' AND s.repr LIKE '%sid%'""")
def experiment_pairs(spark, d):
    k = F.col("item") % 4
    e = D.items(spark, d).select(
        F.concat(F.lit("run"), "item").alias("name"), F.concat("p_brand", "p_type").alias("data"), F.lit("m").alias("model"), F.lit("s").alias("source"),
        F.when(k == 0, "uid+emb").when(k == 1, "emb+sid").when(k == 2, "sid").otherwise("uid").alias("repr_type"),
    )
    return K.experiment_pairs(e).select("uid_name", "sid_name")


@plan("set_signatures", f"WITH {EVENTS} SELECT usr AS user, sha1(string_agg(item, chr(0) ORDER BY item::VARCHAR)) AS signature FROM (SELECT DISTINCT usr, item FROM ev) GROUP BY usr")
def set_signatures(spark, d):
    h = S.fold(D.events(spark, d), "user", "item", "pos")
    return h.select("user", X.set_signature(F.col("history")).alias("signature"))


@plan("code_texts", f"WITH {_CODES} SELECT item, '<a_' || codes[1] || '><b_' || codes[2] || '><c_' || codes[3] || '>' AS text FROM c")
def code_texts(spark, d):
    return _codes(spark, d).select("item", X.code_text(F.col("codes")).alias("text"))


@plan("chat_export", f"""WITH {INTER}, {_CODES}, t AS (SELECT item, '<a_' || codes[1] || '><b_' || codes[2] || '><c_' || codes[3] || '>' AS t FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY pos DESC) AS rn FROM inter WHERE item IN (SELECT item FROM c)),
h AS (SELECT usr, string_agg(t, '' ORDER BY pos) AS h FROM k JOIN t USING (item) WHERE rn BETWEEN 2 AND 9 GROUP BY usr)
SELECT usr AS user, '[{{"role":"system","content":"Recommend."}},{{"role":"user","content":"History: ' || h || '"}},{{"role":"assistant","content":"' || t || '"}}]' AS messages FROM h JOIN (SELECT usr, item FROM k WHERE rn = 1) USING (usr) JOIN t USING (item)""")
def chat_export(spark, d):
    from histria.sources.sinks import chat_export as export

    codes = _codes(spark, d)
    known = S.latest_valid(D.histories(spark, d), codes, 9, 2)
    n = F.size("history")
    samples = known.select("user", F.slice("history", F.lit(1), n - 1).alias("history"), F.element_at("history", -1).alias("target"))
    return export(samples, codes, "Recommend.", "History: ").select("user", "messages")


@plan("numeric_code_targets", f"WITH {_CODES}, {_M} SELECT count(*) AS pairs, round(avg((a.codes[1] = b.codes[1])::INT + (a.codes[2] = b.codes[2])::INT + (a.codes[3] = b.codes[3])::INT) / 3, 6) AS token_accuracy, round(avg((a.codes = b.codes)::INT), 6) AS sequence_accuracy FROM cm a JOIN c b ON b.item = (a.item + 1) % a.m")
def numeric_code_targets(spark, d):
    from histria.operators.ranking import accuracy

    c = _codes(spark, d)
    n = D.vectors(spark, d).count()
    b = c.select(((F.col("item") + n - 1) % n).alias("item"), F.col("codes").alias("other"))
    p = c.join(b, "item")
    return accuracy(p, "codes", "other").select(F.lit(p.count()).cast("long").alias("pairs"), F.round("token_accuracy", 6).alias("token_accuracy"), F.round("sequence_accuracy", 6).alias("sequence_accuracy"))


@plan("quantization_loss", f"""WITH {_CODES}, {_M}, p AS (SELECT a.item, b.item AS other, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s, CASE WHEN a.codes[1] <> b.codes[1] THEN 0 WHEN a.codes[2] <> b.codes[2] THEN 1 WHEN a.codes[3] <> b.codes[3] THEN 2 ELSE 3 END / 3 AS q
FROM cm a JOIN c b ON b.item = (a.item * 7 + 3) % a.m JOIN embeddings x ON x.vec_id = a.item JOIN embeddings y ON y.vec_id = b.item) SELECT item, round(s - q, 6) AS loss FROM p""")
def quantization_loss(spark, d):
    """Content similarity minus code similarity of fixed pairs."""
    v = D.vectors(spark, d).select("item", F.col("embedding").alias("v"))
    c = _codes(spark, d).join(v, "item")
    o = c.select(F.col("item").alias("other"), F.col("codes").alias("oc"), F.col("v").alias("ov"))
    p = c.withColumn("other", (F.col("item") * 7 + 3) % D.vectors(spark, d).count()).join(o, "other")
    return p.select("item", F.round(V.dot(F.col("v"), F.col("ov")) - C.common_prefix(F.col("codes"), F.col("oc")) / 3, 6).alias("loss"))


# Extensions on the event stream, here over the whole table as a batch.
@plan("event_windows", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, json_extract_string(props, '$.k')::INT AS item, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    e = D.read(spark, d, "events").select("ts", F.get_json_object("props", "$.k").cast("int").alias("item"))
    return E.item_counts(e, "1 hour", "1 hour").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@plan("user_sessions", """WITH g AS (SELECT user_id AS user, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user ORDER BY ts) AS k FROM g)
SELECT user, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user, k""")
def user_sessions(spark, d):
    e = D.read(spark, d, "events").select("ts", F.col("user_id").alias("user"))
    out = E.user_sessions(e, "6 hours", "1 hour")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("session_start", "session_end")})


@plan("scale_comparison", f"""WITH {INTER}, r AS (SELECT 'a' AS data, count(*) AS n, count(DISTINCT item) AS items FROM inter WHERE usr % 10 < 5 UNION ALL SELECT 'b', count(*), count(DISTINCT item) FROM inter)
SELECT round(a.n / b.n, 6) AS interactions_ratio, round(a.items / b.items, 6) AS items_ratio FROM r a, r b WHERE a.data = 'a' AND b.data = 'b'""")
def scale_comparison(spark, d):
    i = D.log(spark, d)
    half = F.col("user") % 10 < 5
    one = i.agg(F.count(F.when(half, 1)).alias("na"), F.count("*").alias("nb"), F.count_distinct(F.when(half, F.col("item"))).alias("ia"), F.count_distinct("item").alias("ib"))
    return one.select(F.round(F.try_divide("na", "nb"), 6).alias("interactions_ratio"), F.round(F.try_divide("ia", "ib"), 6).alias("items_ratio"))


@plan("negative_pair_sample", f"""WITH {INTER}, f AS (SELECT item, count(*) AS cnt FROM inter GROUP BY item), c AS (SELECT item, sum(cnt) OVER (ORDER BY item) - cnt AS lo, sum(cnt) OVER (ORDER BY item) AS hi FROM f),
t AS (SELECT sum(cnt)::BIGINT AS total, CASE WHEN sum(cnt) < 256 THEN 1 WHEN sum(cnt) < 65536 THEN 2 WHEN sum(cnt) < 16777216 THEN 3 ELSE 4 END AS size FROM f),
u AS (SELECT k, total, size, nonce, ('0x' || substr(sha256('0:' || k || ':' || nonce), 1, (2 * size)::INT))::BIGINT AS v FROM t, range(0, 40000) a(k), range(0, 40) b(nonce)),
x AS (SELECT k, arg_min(v % total, nonce) AS x FROM u WHERE v < (1::BIGINT << (8 * size)) // total * total GROUP BY k), g AS (SELECT k // 2 AS a, k % 2 AS side, item FROM x JOIN c ON lo <= x AND x < hi),
p AS (SELECT l.a, least(l.item, r.item) AS "left", greatest(l.item, r.item) AS "right" FROM g l JOIN g r ON l.a = r.a AND l.side = 0 AND r.side = 1 AND l.item <> r.item),
pos AS (SELECT DISTINCT least(x.item, y.item) AS "left", greatest(x.item, y.item) AS "right" FROM inter x JOIN inter y ON x.usr = y.usr AND y.pos - x.pos BETWEEN 1 AND 5 AND x.item <> y.item)
SELECT "left", "right" FROM p ANTI JOIN pos USING ("left", "right") ORDER BY a LIMIT 2000""")
def negative_pair_sample(spark, d):
    """Frequency-weighted negatives: as many as asked for. tests/test_cooccurrence.py compares the draws with the frequencies."""
    from histria.operators import cooccurrence as O

    counts = Q.item_frequency(D.histories(spark, d)).withColumnRenamed("freq", "cnt")
    return O.negative_pairs(counts, O.window_pairs(D.interactions(spark, d), 5, parts=D.log_parts(spark, d, 5)), 2000)


@plan("residual_codes")
def residual_codes(spark, d):
    """k-means codes; tests check their range and that each slot lowers the error."""
    from histria.operators.clustering import residual_codes as build

    return build(D.vectors(spark, d).select("item", F.col("embedding").alias("v")), 2, 8).select("item", joined(F.col("codes")).alias("codes"))


def _kmeans_sql(at, k, iterations):
    """Lloyd's iterations over the nodes of level `at` (table n{at}: item, x, freq, path), unrolled; gives n{at + 1}."""
    p = f"l{at}"
    sql = f"""{p}s AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM n{at}), {p}f AS MATERIALIZED (SELECT * FROM {p}s WHERE n > {k}),
{p}c0 AS MATERIALIZED (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY sha256('0:' || item), item) - 1)::INT AS cluster, x::DOUBLE[] AS c FROM {p}f QUALIFY cluster < {k})"""
    for t in range(iterations + 1):
        sql += f""", {p}a{t} AS MATERIALIZED (SELECT item, path, arg_min(cluster, (d, cluster)) AS cluster FROM
  (SELECT item, f.path, cluster, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM {p}f f JOIN {p}c{t} c ON f.path = c.path) GROUP BY item, path)"""
        if t < iterations:
            sql += f""", {p}c{t + 1} AS MATERIALIZED (SELECT path, cluster, list(s / n ORDER BY i) AS c FROM (SELECT path, cluster, i, sum(x[i])::DOUBLE AS s, count(*) AS n
  FROM (SELECT path, cluster, x, unnest(range(1, len(x) + 1)) AS i FROM {p}f JOIN {p}a{t} USING (item, path)) GROUP BY ALL) GROUP BY path, cluster)"""
    return sql + f""", {p}z AS (SELECT path, cluster, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, min(item)) - 1 AS label FROM {p}a{iterations} GROUP BY path, cluster),
{p}y AS (SELECT item, label FROM {p}a{iterations} JOIN {p}z USING (path, cluster) UNION ALL SELECT item, row_number() OVER (PARTITION BY path ORDER BY freq DESC, item) - 1 FROM {p}s WHERE n <= {k}),
n{at + 1} AS MATERIALIZED (SELECT item, x, freq, list_append(path, label::INT) AS path FROM n{at} JOIN {p}y USING (item))"""


_ITERATIONS, _SIZES = 4, (5, 40)
_TREE_SQL = f"""WITH {INTER}, q AS (SELECT item, count(*) AS freq FROM inter GROUP BY item),
n0 AS MATERIALIZED (SELECT vec_id AS item, list_transform(embedding, lambda a: round(a::DOUBLE * 1048576)::BIGINT) AS x, coalesce(freq, 0) AS freq, []::INT[] AS path FROM embeddings LEFT JOIN q ON vec_id = item),
{', '.join(_kmeans_sql(i, k, _ITERATIONS) for i, k in enumerate(_SIZES))},
m AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS node FROM (SELECT DISTINCT []::INT[] AS path FROM n0 UNION SELECT path FROM n1 UNION SELECT path FROM n2))"""


def _hierarchy(spark, d):
    from histria.operators.clustering import hierarchy

    v = D.vectors(spark, d).select("item", F.col("embedding").alias("v"))
    return hierarchy(v, Q.item_frequency(D.histories(spark, d)), list(_SIZES), iterations=_ITERATIONS)


@plan("cluster_leaves", f"{_TREE_SQL} SELECT item, node, array_to_string(path, ',') AS path, row_number() OVER (PARTITION BY node ORDER BY freq DESC, item) - 1 AS leaf_label FROM n2 JOIN m USING (path)")
def cluster_leaves(spark, d):
    """Two-level tree over all vectors: levels of five clusters and of up to forty (small nodes give one an item)."""
    return _hierarchy(spark, d)[1].select("item", "node", joined(F.col("path")).alias("path"), "leaf_label")


@plan("cluster_nodes", f"""{_TREE_SQL} SELECT m.node, len(m.path)::INT AS level, u.node AS parent, m.path[-1] AS label, CASE WHEN len(m.path) = {len(_SIZES)} THEN (SELECT count(*) FROM n2 WHERE n2.path = m.path)
  ELSE (SELECT count(*) FROM m c WHERE len(c.path) = len(m.path) + 1 AND c.path[:len(m.path)] = m.path) END AS child_count FROM m LEFT JOIN m u ON len(u.path) = len(m.path) - 1 AND u.path = m.path[:-2]""")
def cluster_nodes(spark, d):
    return _hierarchy(spark, d)[0]


_PRODUCT_SQL = f"""WITH n0 AS MATERIALIZED (SELECT vec_id AS item, 0 AS freq, [s::INT] AS path, list_transform(embedding[s * 16 + 1:s * 16 + 16], lambda a: round(a::DOUBLE * 1048576)::BIGINT) AS x FROM embeddings, range(0, 4) t(s)),
{_kmeans_sql(0, 16, 4)} SELECT item, string_agg(cluster, ',' ORDER BY path) AS codes FROM l0a4 GROUP BY item"""


@plan("product_codes", _PRODUCT_SQL)
def product_codes(spark, d):
    """Four codes of sixteen, one for each quarter of the vector."""
    from histria.operators.clustering import product_codes as build

    v = D.vectors(spark, d).select("item", F.col("embedding").alias("v"))
    return build(v, 4, 16, 4).select("item", joined(F.col("codes")).alias("codes"))


@plan("unmatched_users", f"WITH {INTER} SELECT c_custkey AS user FROM customer ANTI JOIN (SELECT DISTINCT usr FROM inter) ON c_custkey = usr")
def unmatched_users(spark, d):
    c = D.read(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return c.join(D.log(spark, d).select("user"), "user", "left_anti")


@plan("union_splits", f"WITH {INTER} SELECT item, count(*) AS cnt FROM (SELECT item FROM inter WHERE usr % 10 < 2 UNION ALL SELECT item FROM inter WHERE usr % 10 > 7) GROUP BY item")
def union_splits(spark, d):
    """The union keeps repeats, so a row counts once for each split that holds it: the log is read once for all splits."""
    splits = [F.col("user") % 10 < 2, F.col("user") % 10 > 7]
    times = sum((F.coalesce(s, F.lit(False)).cast("long") for s in splits), F.lit(0))
    return D.log(spark, d).select("item", times.alias("times")).where("times > 0").groupBy("item").agg(F.sum("times").alias("cnt"))


@plan("seen_items_by_split", f"WITH {INTER} SELECT usr % 10 AS part, count(*) AS rows, count(DISTINCT usr) AS users, count(DISTINCT item) AS items FROM inter GROUP BY 1")
def seen_items_by_split(spark, d):
    return D.log(spark, d).groupBy((F.col("user") % 10).alias("part")).agg(F.count("*").alias("rows"), F.count_distinct("user").alias("users"), F.count_distinct("item").alias("items"))


@plan("unique_history_items", f"WITH {INTER} SELECT count(DISTINCT item) AS items, (SELECT count(*) FROM (SELECT usr FROM inter GROUP BY usr HAVING count(*) > count(DISTINCT item))) AS users_with_repeats FROM inter")
def unique_history_items(spark, d):
    h = D.histories(spark, d)
    a = h.select(F.explode("history").alias("item")).agg(F.count_distinct("item").alias("items"))
    return a.crossJoin(P.history_profile(h).select("users_with_repeats"))  # one row each
