"""Run catalogues and training logs, stood in for by rows of parts and orders, and cluster trees over vectors' labels."""

from pyspark.sql import functions as F

from histria.operators import blocks as B
from histria.operators import catalog as K
from histria.operators import clustering as T
from histria.operators import frequency as Q
from histria.operators import ranking as R
from histria.operators import sequences as S
from histria.operators import vectors as V
from histria.sources import driver as D

from .registry import INTER, plan

_RUNS = """runs AS (SELECT 'runs/p' || p_partkey AS path, 'data' || p_partkey % 5 AS data, 'Model' || p_partkey % 3 AS model, p_brand AS signature, (p_partkey % 4)::VARCHAR AS seed,
  ((p_partkey % 7) / 10.0)::DOUBLE AS lr, 'layers' || p_size % 2 AS kind FROM part)"""


def _runs(spark, d):
    p = D.items(spark, d)
    config = F.create_map(F.lit("lr"), ((F.col("item") % 7) / 10.0).cast("string"), F.lit("kind"), F.concat(F.lit("layers"), F.col("p_size") % 2), F.lit("same"), F.lit("x"))
    return p.select(F.concat(F.lit("runs/p"), "item").alias("path"), F.concat(F.lit("data"), F.col("item") % 5).alias("data"), F.concat(F.lit("Model"), F.col("item") % 3).alias("model"), F.col("p_brand").alias("signature"), (F.col("item") % 4).cast("string").alias("seed"), config.alias("config"))


@plan("run_search", f"WITH {_RUNS} SELECT path, data, model, seed FROM runs WHERE lower(data) IN ('data1', 'data3') AND lower(model) = 'model2' AND abs(lr - 0.3) <= 1e-12 ORDER BY data, model, signature, seed, path")
def run_search(spark, d):
    return K.search(_runs(spark, d), {"data": "DATA1,data3", "model": "model2", "lr": "0.30"}).select("path", "data", "model", "seed")


@plan("run_comparison", f"WITH {_RUNS} SELECT path, 'lr' AS field, lr::VARCHAR AS value FROM runs WHERE path IN ('runs/p8', 'runs/p9', 'runs/p22') UNION ALL SELECT path, 'kind', kind FROM runs WHERE path IN ('runs/p8', 'runs/p9', 'runs/p22') AND (SELECT count(DISTINCT kind) FROM runs WHERE path IN ('runs/p8', 'runs/p9', 'runs/p22')) > 1")
def run_comparison(spark, d):
    """The config fields that differ between three runs."""
    return K.differing(_runs(spark, d).where(F.col("path").isin("runs/p8", "runs/p9", "runs/p22")))


@plan("run_reconciliation", f"""WITH {_RUNS}, l AS (SELECT DISTINCT signature, seed FROM runs WHERE data <> 'data0'), r AS (SELECT DISTINCT signature, seed FROM runs WHERE model <> 'Model1')
SELECT coalesce(l.signature, r.signature) AS signature, coalesce(l.seed, r.seed) AS seed, CASE WHEN l.seed IS NOT NULL AND r.seed IS NOT NULL THEN 'keep' WHEN l.seed IS NOT NULL THEN 'upload' ELSE 'orphan' END AS action FROM l FULL JOIN r USING (signature, seed)""")
def run_reconciliation(spark, d):
    r = _runs(spark, d)
    return K.reconcile(r.where("data <> 'data0'"), r.where("model <> 'Model1'"), "path")


@plan("alias_targets", """WITH RECURSIVE e AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 97 = 50 AND p_partkey % 2 = 0 THEN p_partkey + 3 ELSE p_partkey - 1 END AS alias FROM part),
w AS (SELECT name, name AS pl FROM e UNION SELECT w.name, e.alias FROM w JOIN e ON e.name = w.pl WHERE e.alias IS NOT NULL)
SELECT name, max(CASE WHEN e.alias IS NULL THEN pl END) AS target FROM (SELECT w.name, w.pl, e.alias FROM w JOIN e ON e.name = w.pl) e GROUP BY name""")
def alias_targets(spark, d):
    """Chains of up to 96 entries; every other one runs into a cycle, the first one to a missing entry."""
    k = F.col("item")
    alias = F.when(k % 97 != 0, F.when((k % 97 == 50) & (k % 2 == 0), k + 3).otherwise(k - 1))
    return K.resolve_aliases(D.items(spark, d).select(k.alias("name"), alias.alias("alias")))


_LOG = "lg AS (SELECT o_custkey AS run, o_orderkey AS epoch, o_totalprice AS loss, o_orderkey % 13 + 1 AS batch FROM orders)"


def _log(spark, d):
    return D.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"), (F.col("o_orderkey") % 13 + 1).alias("batch"))


@plan("metric_improvements", f"""WITH {_LOG}, b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM lg), i AS (SELECT *, best_before IS NULL OR loss < best_before AS improved FROM b)
SELECT run, epoch, improved, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS patience FROM i""")
def metric_improvements(spark, d):
    return R.improvements(_log(spark, d), "run", "epoch", "loss", True).select("run", "epoch", "improved", "patience")


@plan("weighted_metric_mean", f"WITH {_LOG} SELECT round(sum(loss * batch) / sum(batch), 4) AS loss FROM lg")
def weighted_metric_mean(spark, d):
    return R.weighted_means(_log(spark, d), ["loss"], "batch").select(F.round("loss", 4).alias("loss"))


@plan("cluster_labels", "WITH s AS (SELECT vec_id % 2 AS node, label AS cluster, count(*) AS n, min(vec_id) AS least FROM embeddings GROUP BY ALL) SELECT node, cluster, (row_number() OVER (PARTITION BY node ORDER BY n DESC, least) - 1)::INT AS label FROM s")
def cluster_labels(spark, d):
    v = D.vectors(spark, d)
    return T.relabel(v.select((F.col("item") % 2).alias("node"), F.col("label").alias("cluster"), "item"))


@plan("leaf_labels", f"""WITH {INTER}, f AS (SELECT item, count(*) AS freq FROM inter GROUP BY item) SELECT label AS node, vec_id AS item, (row_number() OVER (PARTITION BY label ORDER BY coalesce(freq, 0) DESC, vec_id) - 1)::INT AS leaf FROM embeddings LEFT JOIN f ON vec_id = item""")
def leaf_labels(spark, d):
    from pyspark.sql import Window

    v = D.vectors(spark, d).join(Q.item_frequency(D.histories(spark, d)), "item", "left")
    w = Window.partitionBy("label").orderBy(F.desc(F.coalesce("freq", F.lit(0))), "item")
    return v.select(F.col("label").alias("node"), "item", (F.row_number().over(w) - 1).alias("leaf"))


_TREE = "tr AS (SELECT 0::BIGINT AS parent, k AS label, k + 1 AS node FROM range(0, 4) t(k)), lv AS (SELECT vec_id % 4 + 1 AS node, vec_id // 4 AS label, vec_id AS uid FROM embeddings), lp AS (SELECT s AS sample, n AS node, l AS label, -((s * 7 + n * 5 + l * 3) % 23 + l / 64) AS logp FROM range(0, 5) a(s), range(0, 5) b(n), (SELECT DISTINCT vec_id // 4 AS l FROM embeddings))"


@plan("tree_search", f"""WITH {_TREE}, t AS (SELECT sample, tr.node, logp AS sc, row_number() OVER (PARTITION BY sample ORDER BY logp DESC, tr.node) AS r FROM tr JOIN lp ON lp.node = tr.parent AND lp.label = tr.label)
SELECT t.sample, uid, round(max(sc + logp), 6) AS score FROM t JOIN lv USING (node) JOIN lp ON lp.sample = t.sample AND lp.node = lv.node AND lp.label = lv.label WHERE r <= 2 GROUP BY ALL""")
def tree_search(spark, d):
    children = spark.range(4).select(F.lit(0).cast("long").alias("parent"), F.col("id").alias("label"), (F.col("id") + 1).alias("node"))
    leaves = D.vectors(spark, d).select((F.col("item") % 4 + 1).alias("node"), F.expr("item div 4").alias("label"), F.col("item").alias("uid"))
    five = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda x: x.cast("long")))
    at = leaves.select("label").distinct().withColumn("sample", five).withColumn("node", five)
    logp = at.withColumn("logp", -((F.col("sample") * 7 + F.col("node") * 5 + F.col("label") * 3) % 23 + F.col("label") / 64))
    return R.tree_search(children, leaves, logp, 1, [2]).withColumn("score", F.round("score", 6))


@plan("cluster_block", "WITH p AS (SELECT vec_id, embedding[:16]::DOUBLE[] AS a, embedding[17:]::DOUBLE[] AS b FROM embeddings) SELECT vec_id AS item, round(a[1] / greatest(sqrt(list_inner_product(a, a)), 1e-12) * sqrt(0.3), 6) AS first, round(b[48] / greatest(sqrt(list_inner_product(b, b)), 1e-12) * sqrt(0.7), 6) AS last FROM p")
def cluster_block(spark, d):
    v = D.vectors(spark, d)
    out = T.cluster_block(v.select("item", F.slice("embedding", 1, 16).alias("v")), v.select("item", F.slice("embedding", 17, 48).alias("v")), 0.3)
    return out.select("item", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@plan("multi_answer_targets", f"WITH {INTER} SELECT usr AS user, CASE WHEN usr % 3 = 0 THEN unnest([usr, usr + 1]) END AS item FROM hist WHERE usr % 3 = 0 UNION ALL SELECT usr, history[-1] FROM hist WHERE usr % 3 <> 0")
def multi_answer_targets(spark, d):
    u = F.col("user")
    h = D.histories(spark, d).withColumn("answers", F.when(u % 3 == 0, F.array(u, u + 1)).otherwise(F.array().cast("array<bigint>")))
    return S.targets(h, "answers")


@plan("core_items", "WITH n AS (SELECT label, vec_id FROM embeddings) SELECT vec_id AS item FROM embeddings WHERE vec_id % 2 = 0 INTERSECT SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 INTERSECT SELECT p_partkey FROM part")
def core_items(spark, d):
    from histria.operators.profile import common_keys

    v = D.vectors(spark, d)
    return common_keys([v.where("item % 2 = 0"), v.where("item % 3 = 0"), D.items(spark, d)], "item")


@plan("sign_codes", """WITH s AS (SELECT b, list(1 - 2 * (('0x' || right(sha256('0:' || b || ':' || i), 1))::INT % 2) ORDER BY i) AS p FROM range(0, 16) x(b), range(0, 64) y(i) GROUP BY b)
SELECT vec_id AS item, string_agg(CASE WHEN list_inner_product(embedding::DOUBLE[], p::DOUBLE[]) > 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS bits FROM embeddings, s GROUP BY vec_id""")
def sign_codes(spark, d):
    """Signs of 16 hashed projections of 64-dimensional vectors."""
    return T.sign_codes(D.vectors(spark, d).select("item", F.col("embedding").alias("v")), 16).select("item", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"))


@plan("neighbor_stability", """WITH s AS (SELECT a.vec_id AS anchor, b.vec_id AS item, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s1, round(list_inner_product(a.embedding[:40]::DOUBLE[], b.embedding[:40]::DOUBLE[]), 6) AS s2 FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY s1 DESC, item) AS r1, row_number() OVER (PARTITION BY anchor ORDER BY s2 DESC, item) AS r2 FROM s), o AS (SELECT anchor, count(*) FILTER (WHERE r1 <= 20 AND r2 <= 20) / 20 AS v FROM r GROUP BY anchor)
SELECT count(*) AS anchors, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, min(v) AS min, max(v) AS max FROM o""")
def neighbor_stability(spark, d):
    from histria.operators.profile import describe

    v = D.vectors(spark, d).select("item", F.col("embedding").alias("v"))
    part = v.select("item", F.slice("v", 1, 40).alias("v"))
    a, b = (B.exact_neighbors(x.where("item % 25 = 0"), x, 20, 6, 4) for x in (v, part))
    out = describe(V.neighbor_overlap(a, b, 20), F.col("overlap"), (0.5, 0.9))
    return out.select(F.col("count").alias("anchors"), *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p90")], "min", "max")
