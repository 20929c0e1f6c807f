"""Ids, names, dates, readers of single columns, pairs and decoding: operators that no larger query goes through."""

from pyspark.sql import functions as F

from histria.functions import text as X
from histria.operators import catalog as K
from histria.operators import exports as E
from histria.operators import ranking as R
from histria.operators import samples as M
from histria.operators import sequences as S
from histria.operators import splits as L
from histria.operators import vocab as N
from histria.operators.shared import own_folder
from histria.sources import driver as D
from histria.sources import readers

from .analytics import _CODES, _codes, rounded
from .registry import INTER, plan
from .sequences import shown, text


def _chunked_sql(n, size, shortest, rounds):
    """Segments of `size` from histories, then rounds of: count, keep frequent items, cut again within the old segment."""
    sql = f"WITH {INTER}, s0 AS MATERIALIZED (SELECT usr, item, pos, pos // {size} AS seg FROM inter QUALIFY count(*) OVER (PARTITION BY usr, pos // {size}) >= {shortest})"
    for k in range(rounds):
        sql += f""", k{k} AS (SELECT usr, seg, item, row_number() OVER (PARTITION BY usr, seg ORDER BY pos) - 1 AS pos FROM s{k} SEMI JOIN (SELECT item FROM s{k} GROUP BY item HAVING count(*) >= {n}) USING (item)),
c{k} AS (SELECT *, pos // {size} AS part FROM k{k} QUALIFY count(*) OVER (PARTITION BY usr, seg, pos // {size}) >= {shortest}),
s{k + 1} AS MATERIALIZED (SELECT usr, item, pos, dense_rank() OVER (PARTITION BY usr ORDER BY seg, part) - 1 AS seg FROM c{k})"""
    return sql + f" SELECT usr AS user, seg::INT AS segment, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items FROM s{rounds} GROUP BY usr, seg"


@plan("ncore_chunked", _chunked_sql(22, 8, 3, 3))
def ncore_chunked(spark, d):
    return shown(S.n_core_chunked(D.histories(spark, d), 22, 8, 3), "segment")


_HASHED = "o AS (SELECT {key} AS k, row_number() OVER (ORDER BY sha256('{seed}:' || {key}), {key}::VARCHAR) - 1 AS idx FROM {table})"


@plan("random_item_pairs", f"""WITH {_HASHED.format(key="p_partkey", seed=9, table="part")}, t AS (SELECT count(*) AS n FROM o), q AS (SELECT c, n - c % 2 AS upper, CASE WHEN n < 256 THEN 1 WHEN n < 65536 THEN 2 ELSE 3 END AS size FROM t, range(0, 1000) r(c)),
v AS (SELECT c, upper, nonce, size, ('0x' || substr(sha256('9:' || c || ':' || nonce), 1, (2 * size)::INT))::BIGINT AS v FROM q, range(0, 40) m(nonce)),
x AS (SELECT c, arg_min(v % upper, nonce) AS x FROM v WHERE v < (1::BIGINT << (8 * size)) // upper * upper GROUP BY c), p AS (SELECT l.c // 2 AS id, l.x AS i, (l.x + 1 + r.x) % n AS j FROM t, x l JOIN x r ON r.c = l.c + 1 WHERE l.c % 2 = 0)
SELECT id, a.k AS a, b.k AS b FROM p JOIN o a ON a.idx = i JOIN o b ON b.idx = j""")
def random_item_pairs(spark, d):
    return L.random_pairs(D.items(spark, d), "item", 500, 9)


@plan("usable_ids", """SELECT p_partkey AS item, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS whole, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN 'x' || p_partkey WHEN 2 THEN NULL ELSE p_partkey::VARCHAR END AS normal FROM part""")
def usable_ids(spark, d):
    """Ids as text: whole numbers, words, nulls, and numbers with a point, which only one of the two rules takes."""
    k = F.col("item")
    raw = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("x"), k)).when(k % 4 == 3, F.concat(k.cast("string"), F.lit(".0")))
    return D.items(spark, d).select("item", X.int_or_null(raw).alias("whole"), X.normal_id(raw).alias("normal"))


@plan("id_lists", f"WITH {INTER} SELECT usr AS user, len(history)::INT AS n, history[1]::VARCHAR AS first, history[-1]::VARCHAR AS last FROM hist")
def id_lists(spark, d):
    """Histories written as JSON arrays, by spaces and by commas, and read back."""
    h = D.histories(spark, d).withColumn("s", F.transform("history", lambda x: x.cast("string")))
    raw = F.when(F.col("user") % 3 == 0, F.to_json("s")).when(F.col("user") % 3 == 1, F.array_join("s", " ")).otherwise(F.array_join("s", ", "))
    ids = X.id_list(raw)
    return h.select("user", F.size(ids).alias("n"), F.get(ids, F.lit(0)).alias("first"), F.element_at(ids, -1).alias("last"))


@plan("names", """SELECT p_brand AS brand, regexp_replace(lower(p_brand), '[0-9]+$', '') AS family, lower(replace(p_brand || '.' || p_size, '.', '')) AS model, 'sid+uid' || CASE WHEN p_size % 2 = 0 THEN '+text' ELSE '' END AS representation FROM (SELECT DISTINCT p_brand, p_size FROM part)""")
def names(spark, d):
    i = D.items(spark, d).select("p_brand", "p_size").distinct()
    extra = F.when(F.col("p_size") % 2 == 0, "text+sid").otherwise("uid")
    return i.select(
        F.col("p_brand").alias("brand"), X.family(F.lower("p_brand")).alias("family"), X.model_name(F.concat("p_brand", F.lit("."), "p_size")).alias("model"),
        X.representation(F.lit("uid+sid+uid"), extra).alias("representation"),
    )


@plan("written_dates", "SELECT o_orderkey, o_orderdate::DATE AS day, epoch(o_orderdate::DATE)::BIGINT + 41855 AS seconds FROM orders")
def written_dates(spark, d):
    """Dates as `06 3, 2013` and as `Fri Nov 17 11:37:35 -0800 2017`, whose offset is dropped."""
    o = D.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    clock = F.concat(F.date_format("day", "EEE MMM dd"), F.lit(" 11:37:35 -0800 "), F.date_format("day", "yyyy"))
    return o.select("o_orderkey", X.date_words(F.date_format("day", "MM d, yyyy")).alias("day"), X.local_epoch(clock).alias("seconds"))


@plan("caption_scan", "SELECT p_partkey AS item, min(p_name || ' ' || r) AS caption FROM part, range(0, 2) t(r) WHERE p_size <= 25 GROUP BY p_partkey")
def caption_scan(spark, d):
    """Captions of the wanted items, of repeated ones the first."""
    path = own_folder(spark, "captions")
    twice = D.items(spark, d).withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    twice.select(F.col("item").alias("pid"), F.concat("p_name", F.lit(" "), "r").alias("dense_caption")).write.parquet(path)
    return readers.captions(spark, path, D.items(spark, d).where("p_size <= 25"))


@plan("answer_lists", f"WITH {INTER} SELECT usr AS user, CASE WHEN usr % 4 = 0 THEN 0 ELSE least(len(history), 3) END::INT AS n, CASE WHEN usr % 4 <> 0 THEN history[1] END AS first FROM hist")
def answer_lists(spark, d):
    """Answers out of a JSON text; some have none."""
    h = D.histories(spark, d)
    few = F.slice("history", 1, 3)
    meta = h.withColumn("metadata", F.when(F.col("user") % 4 == 0, "{}").otherwise(F.to_json(F.struct(few.alias("answer_pid")))))
    return readers.answers(meta).select("user", F.size("answers").alias("n"), F.get("answers", F.lit(0)).alias("first"))


@plan("uid_histories", f"""WITH {INTER}, v AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS uid FROM part WHERE p_size <= 30) SELECT usr AS user, count(*) AS n, string_agg(uid, ',' ORDER BY pos) AS uids FROM inter JOIN v USING (item) GROUP BY usr""")
def uid_histories(spark, d):
    vocab = M.vocabulary(D.items(spark, d).where("p_size <= 30").select("item"))
    out = M.to_uids(D.histories(spark, d), vocab)
    return out.select("user", F.size("uids").cast("long").alias("n"), text(F.col("uids")).alias("uids"))


@plan("longest_histories_first", f"WITH {INTER} SELECT usr AS user, len(history)::INT AS total_input_length FROM hist")
def longest_histories_first(spark, d):
    return M.by_length(D.histories(spark, d).select("user", F.size("history").alias("total_input_length")))


@plan("deletable_runs", "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 50 NOT IN (1, 2, 3, 5, 8) AND o_orderkey % 7 = 0")
def deletable_runs(spark, d):
    """Runs on this host without metrics whose process is gone."""
    k = F.col("o_orderkey")
    metrics = F.when(k % 14 == 0, F.lit(None).cast("map<string,double>")).when(k % 7 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("ndcg"), F.lit(0.5)))
    runs = D.read(spark, d, "orders").select(k.alias("path"), F.when(k % 3 == 0, "here").otherwise("there").alias("host"), (F.col("o_custkey") % 50).alias("pid"), metrics.alias("metrics"))
    return K.deletable(runs, "here", [1, 2, 3, 5, 8]).select("path")


@plan("decoded_items", """WITH c AS (SELECT p_partkey AS uid, p_size AS a, p_partkey % 9 AS b FROM part), e AS (SELECT s AS sample, a, b, -((s * 7 + a * 5 + b * 3) % 31) AS score FROM range(0, 6) t(s), (SELECT DISTINCT a, b FROM c) WHERE (a + b + s) % 4 = 0)
SELECT sample, uid, max(score)::DOUBLE AS score FROM e JOIN c USING (a, b) GROUP BY ALL""")
def decoded_items(spark, d):
    """Items that beams of two codes name."""
    codes = D.items(spark, d).select(F.col("item").alias("uid"), F.array(F.col("p_size").cast("int"), (F.col("item") % 9).cast("int")).alias("codes"))
    beams = codes.select(F.col("codes").alias("prefix")).distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(5))))
    a, b, s = F.get("prefix", F.lit(0)), F.get("prefix", F.lit(1)), F.col("sample")
    beams = beams.where((a + b + s) % 4 == 0).select(s.cast("long").alias("sample"), "prefix", (-((s * 7 + a * 5 + b * 3) % 31)).cast("double").alias("score"))
    return R.decode_items(beams, codes)


@plan("level_accuracy", """WITH x AS (SELECT [p_size % 3, p_size % 5, p_partkey % 2] AS p, CASE WHEN p_partkey % 10 = 0 THEN [p_size % 3] ELSE [p_size % 3, p_size % 4, p_partkey % 4] END AS l FROM part)
SELECT level::INT AS level, count(*) AS rows, round(avg(CASE WHEN level < 0 THEN p = l ELSE p[level + 1] = l[level + 1] END::INT), 6) AS accuracy FROM x, range(-1, 3) t(level) WHERE level < len(l) GROUP BY level""")
def level_accuracy(spark, d):
    k, z = F.col("item"), F.col("p_size").cast("long")
    rows = D.items(spark, d).select(F.array(z % 3, z % 5, k % 2).alias("p"), F.when(k % 10 == 0, F.array(z % 3)).otherwise(F.array(z % 3, z % 4, k % 4)).alias("l"))
    return R.level_accuracy(rows, "p", "l", 3).withColumn("accuracy", F.round("accuracy", 6))


_GROUPS = "gr AS (SELECT max(n) AS most FROM (SELECT codes, count(*) AS n FROM c GROUP BY codes))"


@plan("slot_ranges", f"WITH {_CODES}, {_GROUPS} SELECT s::INT AS slot, (s * 16)::BIGINT AS first, (s * 16 + CASE WHEN s < 3 THEN 16 ELSE most END - 1)::BIGINT AS last FROM gr, range(0, 4) t(s)")
def slot_ranges(spark, d):
    return N.slot_ranges(_codes(spark, d), 3, 16)


@plan("vocabulary_registry", f"""WITH {_CODES}, {_GROUPS} SELECT 'uid' AS name, 'uid' AS kind, count(*) AS size, NULL::BIGINT AS slots, NULL::BIGINT AS collision_size, NULL::BIGINT AS collision_offset FROM c
UNION ALL SELECT 'special', 'special', 4, NULL, NULL, NULL UNION ALL SELECT 'codes', 'sid', 48 + most, 4, most, 48 FROM gr""")
def vocabulary_registry(spark, d):
    codes = _codes(spark, d)
    return N.registry(spark, codes, {"codes": (codes, 3, 16)}, N.marker_tokens(["codes", "uid", "title"], ["codes", "uid"]))


_UNIT = "list_transform({v}, lambda a: a / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


def _exports_sql():
    pairs = f"""{_HASHED.format(key="vec_id", seed=42, table="embeddings")}, t AS (SELECT count(*) AS n FROM o), q AS (SELECT c, n - c % 2 AS upper, CASE WHEN n < 256 THEN 1 WHEN n < 65536 THEN 2 ELSE 3 END AS size FROM t, range(0, 1000) r(c)),
v AS (SELECT c, upper, nonce, size, ('0x' || substr(sha256('42:' || c || ':' || nonce), 1, (2 * size)::INT))::BIGINT AS v FROM q, range(0, 40) m(nonce)),
x AS (SELECT c, arg_min(v % upper, nonce) AS x FROM v WHERE v < (1::BIGINT << (8 * size)) // upper * upper GROUP BY c), pl AS (SELECT l.c // 2 AS id, l.x AS i, (l.x + 1 + r.x) % n AS j FROM t, x l JOIN x r ON r.c = l.c + 1 WHERE l.c % 2 = 0),
pa AS (SELECT id, a.k AS a, b.k AS b FROM pl JOIN o a ON a.idx = i JOIN o b ON b.idx = j), few AS (SELECT k AS item FROM o WHERE idx < 200)"""
    tables = f"""s0 AS MATERIALIZED (SELECT vec_id AS item, {_UNIT.format(v="embedding::DOUBLE[]")} AS v FROM embeddings), s1 AS (SELECT vec_id AS item, list_transform(embedding, lambda a: CASE WHEN a > 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS r FROM embeddings),
s2 AS (SELECT vec_id AS item, list_transform(embedding, lambda a: round(a::DOUBLE * 8) / 8) AS r FROM embeddings), e1 AS MATERIALIZED (SELECT item, {_UNIT.format(v="r")} AS v FROM s1), e2 AS MATERIALIZED (SELECT item, {_UNIT.format(v="r")} AS v FROM s2),
k1 AS (SELECT item, codes FROM c), k2 AS (SELECT vec_id AS item, [label, label % 3] AS codes FROM embeddings)"""
    each = []
    for e in (1, 2):
        tables += f""", z{e} AS MATERIALIZED (SELECT round(list_inner_product(a.v, b.v), 6) AS s, round(list_inner_product(x.v, y.v), 6) AS e FROM pa JOIN s0 a ON a.item = pa.a JOIN s0 b ON b.item = pa.b JOIN e{e} x ON x.item = pa.a JOIN e{e} y ON y.item = pa.b),
r{e} AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS a, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS b FROM z{e}),
n{e} AS MATERIALIZED (SELECT a.item AS anchor, b.item, row_number() OVER (PARTITION BY a.item ORDER BY round(list_inner_product(s.v, t.v), 6) DESC, b.item) AS rs, row_number() OVER (PARTITION BY a.item ORDER BY round(list_inner_product(x.v, y.v), 6) DESC, b.item) AS re
  FROM few a JOIN few b ON a.item <> b.item JOIN s0 s ON s.item = a.item JOIN s0 t ON t.item = b.item JOIN e{e} x ON x.item = a.item JOIN e{e} y ON y.item = b.item),
g{e} AS (SELECT codes, count(*) AS n FROM k{e} GROUP BY codes), l{e} AS (SELECT unnest(range(0, len(codes))) AS slot, unnest(codes) AS val FROM k{e}), h{e} AS (SELECT slot, val, count(*) / sum(count(*)) OVER (PARTITION BY slot) AS p FROM l{e} GROUP BY slot, val),
u{e} AS (SELECT slot, -sum(p * ln(p)) / ln(max(val) + 1) AS entropy, 1 - count(*) / (max(val) + 1) AS dead FROM h{e} GROUP BY slot)"""
        each.append(f"""SELECT '{("signs", "steps")[e - 1]}' AS method, (SELECT sum(n) FROM g{e})::BIGINT AS item_count, (SELECT max(n) FROM g{e}) AS max_collision, (SELECT round(1 - count(*) / sum(n), 6) FROM g{e}) AS collision_rate, (SELECT round(avg(entropy), 6) FROM u{e}) AS slot_entropy,
(SELECT round(avg(dead), 6) FROM u{e}) AS dead_ratio, (SELECT round(corr(s, e), 6) FROM z{e}) AS pearson, (SELECT round(corr(a, b), 6) FROM r{e}) AS spearman, {", ".join(f"(SELECT round(count(*) FILTER (WHERE rs <= {k} AND re <= {k}) / count(*) FILTER (WHERE rs <= {k}), 6) FROM n{e}) AS recall_{k}" for k in (5, 20))}""")
    return f"WITH {_CODES}, {pairs}, {tables} " + " UNION ALL ".join(each)


@plan("export_comparison", _exports_sql())
def export_comparison(spark, d):
    """Two ways of giving vectors back: the signs of their coordinates, and coordinates in steps of an eighth."""
    v = D.vectors(spark, d)
    each = lambda f: v.select("item", F.transform("embedding", f).alias("v"))
    signs, steps = each(lambda a: F.when(a > 0, 1.0).otherwise(-1.0)), each(lambda a: F.round(a.cast("double") * 8) / 8)
    few = v.select("item", F.array("label", F.col("label") % 3).alias("codes"))
    out = E.compare_exports(v.select("item", F.col("embedding").alias("v")), {"signs": (_codes(spark, d), signs), "steps": (few, steps)}, 500, 200, (5, 20))
    names = ["collision_rate", "slot_entropy", "dead_ratio", "pearson", "spearman", "recall_5", "recall_20"]
    return rounded(out, *names).select("method", "item_count", "max_collision", *names)
