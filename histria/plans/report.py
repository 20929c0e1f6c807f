"""The transfer report over the order log (local), the event stream (reference) and the vectors' items."""

from pyspark.sql import functions as F

from histria.operators import report as P
from histria.sources import driver as D

from .analytics import _CODES, _codes, rounded
from .registry import INTER, plan

_KS, _WINDOW, _LEAST, _BINS = (5, 10), 3, 4, 6
_LOG = f"""{INTER}, {_CODES}, vv AS (SELECT vec_id AS item, embedding::DOUBLE[] AS v FROM embeddings), com AS (SELECT vec_id AS item FROM embeddings WHERE vec_id % 5 <> 0),
own AS (SELECT usr, item FROM inter SEMI JOIN vv USING (item)),
bh AS MATERIALIZED (SELECT usr, item, row_number() OVER (PARTITION BY usr ORDER BY pos) AS pos FROM inter SEMI JOIN vv USING (item) SEMI JOIN com USING (item) WHERE usr % 3 <> 0),
fr AS MATERIALIZED (SELECT item, count(*) AS cnt FROM bh GROUP BY item),
pr AS MATERIALIZED (SELECT least(x.item, y.item) AS l, greatest(x.item, y.item) AS r, 2 * count(*) AS cnt FROM bh x JOIN bh y ON x.usr = y.usr AND y.pos - x.pos BETWEEN 1 AND {_WINDOW} AND x.item <> y.item
  SEMI JOIN (SELECT item FROM fr WHERE cnt >= {_LEAST}) a ON a.item = x.item SEMI JOIN (SELECT item FROM fr WHERE cnt >= {_LEAST}) b ON b.item = y.item GROUP BY ALL),
pp AS (SELECT l, r, greatest(0, ln((p.cnt / (SELECT sum(cnt) FROM pr)) / ((a.cnt / (SELECT sum(cnt) FROM fr)) * (b.cnt / (SELECT sum(cnt) FROM fr))))) AS ppmi FROM pr p JOIN fr a ON a.item = l JOIN fr b ON b.item = r),
rel AS MATERIALIZED (SELECT l AS anchor, r AS item, ppmi AS rel FROM pp UNION ALL SELECT r, l, ppmi FROM pp)"""
_NEGATIVE = """nt AS (SELECT sum(cnt)::BIGINT AS total, CASE WHEN sum(cnt) < 256 THEN 1 WHEN sum(cnt) < 65536 THEN 2 WHEN sum(cnt) < 16777216 THEN 3 ELSE 4 END AS size, (SELECT greatest(1, count(*)) FROM pr) AS wanted FROM fr),
nu AS (SELECT k, total, size, nonce, ('0x' || substr(sha256('0:' || k || ':' || nonce), 1, (2 * size)::INT))::BIGINT AS v FROM nt, LATERAL (SELECT unnest(range(0, 8 * wanted + 400)) AS k), range(0, 40) b(nonce)),
nx AS (SELECT k, arg_min(v % total, nonce) AS x FROM nu WHERE v < (1::BIGINT << (8 * size)) // total * total GROUP BY k), nc AS (SELECT item, sum(cnt) OVER (ORDER BY item) - cnt AS lo, sum(cnt) OVER (ORDER BY item) AS hi FROM fr),
ng AS (SELECT k // 2 AS a, k % 2 AS side, item FROM nx JOIN nc ON lo <= x AND x < hi), np AS (SELECT x.a, least(x.item, y.item) AS l, greatest(x.item, y.item) AS r FROM ng x JOIN ng y ON x.a = y.a AND x.side = 0 AND y.side = 1 AND x.item <> y.item),
nn AS MATERIALIZED (SELECT l, r FROM (SELECT *, row_number() OVER (ORDER BY a) AS i FROM np ANTI JOIN pr USING (l, r)) WHERE i <= (SELECT wanted FROM nt)),
bo AS (SELECT l, r, true AS y FROM pr UNION ALL SELECT l, r, false FROM nn),
sc AS MATERIALIZED (SELECT y, round(list_inner_product(a.v, b.v), 6) AS content, CASE WHEN p.codes[1] <> q.codes[1] THEN 0 WHEN p.codes[2] <> q.codes[2] THEN 1 WHEN p.codes[3] <> q.codes[3] THEN 2 ELSE 3 END::DOUBLE AS code_prefix,
  -((p.codes[1] <> q.codes[1])::INT + (p.codes[2] <> q.codes[2])::INT + (p.codes[3] <> q.codes[3])::INT)::DOUBLE AS code_hamming FROM bo JOIN vv a ON a.item = l JOIN vv b ON b.item = r JOIN c p ON p.item = l JOIN c q ON q.item = r),
x AS MATERIALIZED (UNPIVOT sc ON content, code_prefix, code_hamming INTO NAME space VALUE score)"""


def _report(spark, d):
    v = D.vectors(spark, d).select("item", F.col("embedding").alias("v"))
    log = D.interactions(spark, d)
    return P.TransferReport(log, v, v, _codes(spark, d), 3, _WINDOW, _LEAST, _KS, reference=log.where("user % 3 <> 0"), common=v.where("item % 5 <> 0"), bins=_BINS)


@plan("transfer_overview", f"""WITH {_LOG} SELECT (SELECT count(*) FROM vv) AS items, (SELECT count(*) FROM own) AS local_events, (SELECT count(*) FROM bh) AS reference_events, (SELECT count(DISTINCT usr) FROM bh) AS reference_histories,
(SELECT count(*) FROM fr WHERE cnt >= {_LEAST}) AS eligible_items, (SELECT count(*) FROM pr) AS pairs""")
def transfer_overview(spark, d):
    return _report(spark, d).overview


@plan("transfer_spaces", f"""WITH {_LOG}, {_NEGATIVE}, r AS (SELECT *, rank() OVER (PARTITION BY space ORDER BY score) + (count(*) OVER (PARTITION BY space, score) - 1) / 2 AS rk FROM x)
SELECT space, count(*) FILTER (WHERE y) AS n_positive, round(avg(score) FILTER (WHERE y), 6) AS mean_positive, quantile_cont(score, 0.5) FILTER (WHERE y)::DOUBLE AS median_positive,
count(*) FILTER (WHERE NOT y) AS n_negative, round(avg(score) FILTER (WHERE NOT y), 6) AS mean_negative, quantile_cont(score, 0.5) FILTER (WHERE NOT y)::DOUBLE AS median_negative,
round((sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS auc FROM r GROUP BY space""")
def transfer_spaces(spark, d):
    return rounded(_report(spark, d).spaces, "mean_positive", "mean_negative", "auc")


_NEAR = f"""ab AS (SELECT item FROM fr WHERE cnt >= {_LEAST}), an AS (SELECT DISTINCT anchor FROM rel),
sx AS (SELECT anchor, b.item, round(list_inner_product(a.v, b.v), 6) AS content, CASE WHEN p.codes[1] <> q.codes[1] THEN 0 WHEN p.codes[2] <> q.codes[2] THEN 1 WHEN p.codes[3] <> q.codes[3] THEN 2 ELSE 3 END AS sid
  FROM an JOIN vv a ON a.item = anchor JOIN vv b ON b.item <> anchor SEMI JOIN ab ON ab.item = b.item JOIN c p ON p.item = anchor JOIN c q ON q.item = b.item),
ne AS MATERIALIZED (SELECT 'content' AS space, anchor, item, row_number() OVER (PARTITION BY anchor ORDER BY content DESC, item) AS rank FROM sx UNION ALL SELECT 'sid', anchor, item, row_number() OVER (PARTITION BY anchor ORDER BY sid DESC, item) FROM sx),
rr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY rel DESC, item) AS rank FROM rel), ks AS (SELECT unnest([{', '.join(map(str, _KS))}]) AS k),
idl AS (SELECT k, anchor, sum(rel / log2(rank + 1)) AS ideal, count(*) AS n FROM rr, ks WHERE rank <= k GROUP BY ALL),
g AS (SELECT k, space, ne.anchor, sum(coalesce(rr.rel, 0) / log2(ne.rank + 1)) AS dcg, count(*) FILTER (WHERE rr.rank <= k) AS found, max(coalesce(rr.rel, 0)) AS most FROM ks, ne LEFT JOIN rr ON rr.anchor = ne.anchor AND rr.item = ne.item WHERE ne.rank <= k GROUP BY ALL),
m AS MATERIALIZED (SELECT k, space, anchor, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg, found / greatest(n, 1) AS recall, CASE WHEN most > 0 THEN 1.0 ELSE 0.0 END AS hit FROM g JOIN idl USING (k, anchor))"""


@plan("transfer_retrieval", f"WITH {_LOG}, {_NEAR} SELECT space, k, count(*) AS anchors, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(hit), 6)::DOUBLE AS hit FROM m GROUP BY space, k")
def transfer_retrieval(spark, d):
    return rounded(_report(spark, d).retrieval, "ndcg", "recall", "hit")


_COLUMNS = [(s, k) for s in ("content", "sid") for k in _KS]


@plan("transfer_items", f"""WITH {_LOG}, {_NEAR}, w AS (SELECT anchor AS item, {', '.join(f"round(max(ndcg) FILTER (WHERE space = '{s}' AND k = {k}), 6) AS {s}_ndcg_{k}" for s, k in _COLUMNS)}, {', '.join(f"round(max(ndcg) FILTER (WHERE space = 'content' AND k = {k}) - max(ndcg) FILTER (WHERE space = 'sid' AND k = {k}), 6) AS loss_ndcg_{k}" for k in _KS)} FROM m GROUP BY anchor)
SELECT vv.item, coalesce(lf, 0) AS local_freq, coalesce(fr.cnt, 0) AS reference_freq, w.* EXCLUDE item FROM vv LEFT JOIN (SELECT item, count(*) AS lf FROM own GROUP BY item) o USING (item) LEFT JOIN fr USING (item) LEFT JOIN w USING (item)""")
def transfer_items(spark, d):
    names = [f"{s}_ndcg_{k}" for s, k in _COLUMNS] + [f"loss_ndcg_{k}" for k in _KS]
    return rounded(_report(spark, d).items.select("item", "local_freq", "reference_freq", *names), *names)
