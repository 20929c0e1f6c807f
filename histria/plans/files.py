"""Readers of raw files: rows of the driver's tables are written in each raw format and read back."""

from pyspark.sql import functions as F

from histria.operators import samples as M
from histria.operators import sequences as S
from histria.operators import vectors as V
from histria.operators.shared import own_folder
from histria.sources import driver as D
from histria.sources import readers as R

from .registry import INTER, plan


def lines(spark, name, rows, *columns, header=None):
    """A folder of tab-separated text files."""
    path = own_folder(spark, name)
    rows.select(F.concat_ws("\t", *columns)).write.text(path)
    if header:
        spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def blank(c):
    """concat_ws leaves nulls out; an empty field stands for them."""
    return F.coalesce(c.cast("string"), F.lit(""))


@plan("news_scan", """SELECT 'N' || p_partkey AS nid, p_brand AS cat, p_type AS subcat, '"' || p_name || '" new' AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS abs FROM part""")
def news_scan(spark, d):
    """Tab-separated rows without header or quoting, five of eight columns."""
    i = D.items(spark, d)
    title, none = F.concat(F.lit('"'), "p_name", F.lit('" new')), F.lit("[]")
    path = lines(spark, "news", i, F.concat(F.lit("N"), "item"), "p_brand", "p_type", title, blank(F.when(F.col("item") % 3 != 0, F.col("p_type"))), F.lit("u"), none, none)
    return R.news_items(spark, path)


@plan("behaviour_scan", """SELECT 'U' || o_custkey AS uid, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 09:05:08' END AS time,
CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'N' || o_orderkey % 11 || ',N' || o_orderkey % 13 END AS history FROM orders""")
def behaviour_scan(spark, d):
    """Times that can't be read are null, blank histories empty."""
    o, k = D.read(spark, d, "orders"), F.col("o_orderkey")
    time = F.when(k % 5 != 0, F.date_format("o_orderdate", "M/d/yyyy '9:05:08 AM'")).otherwise("soon")
    history = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("N"), k % 11, F.lit("  N"), k % 13))
    path = lines(spark, "behaviours", o, k, F.concat(F.lit("U"), "o_custkey"), time, history, F.lit("p"))
    return R.behaviours(spark, path).select("uid", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.array_join("history", ",").alias("history"))


@plan("replaced_header_scan", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def replaced_header_scan(spark, d):
    """Each file's header line goes; the names are the schema's."""
    c = D.read(spark, d, "customer")
    path = own_folder(spark, "header")
    c.select("c_custkey", "c_mktsegment").write.option("sep", "\t").option("header", True).csv(path)
    return R.tsv(spark, path, "id BIGINT, segment STRING", header=True)


@plan("split_files_union", "SELECT 'U' || o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1")
def split_files_union(spark, d):
    o = D.read(spark, d, "orders")
    paths = [lines(spark, f"part{k}", o.where(F.col("o_orderkey") % 2 == k), "o_orderkey", F.concat(F.lit("U"), "o_custkey"), F.lit(""), F.lit("N1"), F.lit("")) for k in (0, 1)]
    return R.union_all(*[R.behaviours(spark, p) for p in paths]).groupBy("uid").agg(F.count("*").alias("n"))


@plan("latin1_ratings", """SELECT p_partkey AS item, 'Été, ' || p_name AS title, p_size % 5 + 0.5 AS rating FROM part""")
def latin1_ratings(spark, d):
    """Comma-separated values in ISO-8859-1, with a header and a comma inside quotes."""
    i = D.items(spark, d)
    path = own_folder(spark, "latin1")
    i.select("item", F.concat(F.lit("Été, "), "p_name").alias("title"), (F.col("p_size") % 5 + 0.5).alias("rating")).write.option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return R.delimited(spark, path, "item BIGINT, title STRING, rating DOUBLE", encoding="ISO-8859-1")


@plan("text_items_scan", "SELECT lpad((p_partkey % 300)::VARCHAR, 10, '0') AS item, min(p_name) AS text FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1")
def text_items_scan(spark, d):
    """Ids stay text (leading zeros), rows without text go, of repeated ids the first by text stays."""
    i, k = D.items(spark, d), F.col("item")
    path = own_folder(spark, "texts")
    i.select(F.lpad((k % 300).cast("string"), 10, "0").alias("id"), F.when(k % 4 != 0, F.col("p_name")).alias("text"), F.lit(1).alias("more")).write.option("header", True).csv(path)
    rows = R.delimited(spark, path, "item STRING, text STRING, more INT", ["item", "text"]).where("text is not null")
    return S.keep_first(rows, "item", "text")


@plan("capped_fields_scan", "SELECT o_orderkey AS id, o_custkey AS user, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 1000")
def capped_fields_scan(spark, d):
    """The first three of more fields, and the first 1,000 rows in an explicit order: the cap is the feature."""
    path = own_folder(spark, "fields")
    D.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.csv(path)
    rows = R.delimited(spark, path, "id BIGINT, user BIGINT, status STRING, rest STRING", ["id", "user", "status"], header=False)
    return R.first_rows(rows, 1000, F.col("id"))


@plan("gzip_json_scan", "SELECT 'R' || l_orderkey || '-' || l_linenumber AS review, l_partkey AS item, l_quantity::DOUBLE AS stars FROM lineitem WHERE l_linenumber <> 2")
def gzip_json_scan(spark, d):
    """Gzipped JSON lines with a given schema; rows with a blank title go."""
    rows = D.read(spark, d, "lineitem").select(
        F.concat(F.lit("R"), "l_orderkey", F.lit("-"), "l_linenumber").alias("review"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("double").alias("stars"),
        F.when(F.col("l_linenumber") == 2, "  ").otherwise("t").alias("title"), F.lit("x").alias("unused"),
    )
    path = own_folder(spark, "reviews")
    rows.write.option("compression", "gzip").json(path)
    return R.json_lines(spark, path, "review STRING, item BIGINT, stars DOUBLE, title STRING").where(F.trim("title") != "").drop("title")


@plan("embedding_shards_scan", """SELECT vec_id AS item, len(embedding) * 2 AS dims, round(embedding[1]::DOUBLE * 1.5, 5) AS pooled, round(embedding[1]::DOUBLE, 5) AS plain FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0""")
def embedding_shards_scan(spark, d):
    """Shards of a folder but the filtered ones; incomplete vectors go, nested ones are averaged, both columns joined."""
    v = D.vectors(spark, d)
    folder = own_folder(spark, "shards")
    e = F.col("embedding")
    two = v.select(F.col("item").alias("pid"), F.array(e, F.transform(e, lambda x: x * F.lit(2).cast("float"))).alias("vision"), F.when(F.col("item") % 5 != 0, e).alias("text"))
    two.where("pid % 2 = 0").write.parquet(f"{folder}/a.parquet")
    two.where("pid % 2 = 1").write.parquet(f"{folder}/b.parquet")
    shards = R.union_all(*[R.embedding_shards(spark, f"{folder}/{x}.parquet") for x in "ab"])
    out = R.pooled_vectors(shards, v.where("item % 3 <> 0").select("item"), ["vision", "text"])
    return out.select("item", F.size("v").alias("dims"), F.round(F.get("v", F.lit(0)), 5).alias("pooled"), F.round(F.get("v", F.lit(64)), 5).alias("plain"))


@plan("suffix_scan", "SELECT kind, p_partkey::VARCHAR AS item, p_brand AS brand FROM part, (VALUES ('csv'), ('json'), ('parquet')) t(kind)")
def suffix_scan(spark, d):
    """One table by three suffixes; the id is text in each."""
    i, folder, found = D.items(spark, d).select("item", F.col("p_brand").alias("brand")), own_folder(spark, "kinds"), []
    for kind in ("csv", "json", "parquet"):
        w = i.write.option("header", True) if kind == "csv" else i.write
        w.format(kind).save(f"{folder}/items.{kind}")
        read = R.json_lines(spark, f"{folder}/items.json", "item BIGINT, brand STRING").withColumn("item", F.col("item").cast("string")) if kind == "json" else R.by_suffix(spark, f"{folder}/items.{kind}", "item BIGINT, brand STRING", "item")
        found.append(read.select(F.lit(kind).alias("kind"), "item", "brand"))
    return R.union_all(*found)


@plan("ranking_records_scan", f"WITH {INTER} SELECT usr AS target_uid, 'i' || usr AS raw_item_id, count(*) AS frequency, 'all' AS frequency_bucket, (count(*) % 9)::INT AS rank FROM inter GROUP BY usr")
def ranking_records_scan(spark, d):
    """Reports of per-target records, one JSON document a file."""
    per = D.log(spark, d).groupBy("user").agg(F.count("*").alias("frequency"))
    record = F.struct(F.col("user").alias("target_uid"), F.concat(F.lit("i"), "user").alias("raw_item_id"), "frequency", F.lit("all").alias("frequency_bucket"), (F.col("frequency") % 9).cast("int").alias("rank"))
    folder = own_folder(spark, "records")
    docs = per.select((F.col("user") % 16).alias("g"), record.alias("r")).groupBy("g").agg(F.collect_list("r").alias("records")).select("records")
    docs.repartition(16).write.option("maxRecordsPerFile", 1).json(folder)
    return R.ranking_records(spark, folder)


@plan("aligned_matrix", "SELECT vec_id AS item, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, len(embedding) AS dims FROM embeddings WHERE vec_id % 2 = 0")
def aligned_matrix(spark, d):
    """An exported matrix for every wanted item exactly once (missing or repeated ones raise), L2-normalised."""
    folder = own_folder(spark, "matrix")
    D.vectors(spark, d).select("item", F.col("embedding").alias("v")).write.parquet(folder)
    rows = S.require_unique(R.parquet(spark, folder, item="item", v="v"), "item")
    out = S.require_all(rows, D.vectors(spark, d).where("item % 2 = 0").select("item"), "item")
    return out.select("item", F.round(F.get(V.l2_normalize(F.col("v")), F.lit(0)), 6).alias("first"), F.size("v").alias("dims"))


_TOKENS = "tk AS (SELECT vec_id, unnest(range(0, 8)) AS t, embedding, vec_id % 9 AS n FROM embeddings)"


@plan("token_pooling", f"""WITH {_TOKENS} SELECT vec_id AS item, round(avg(embedding[t * 8 + 1]::DOUBLE) FILTER (WHERE t < n), 6) AS mean, max(round(embedding[1]::DOUBLE, 6)) AS cls, max(round(embedding[greatest(n - 1, 0) * 8 + 1]::DOUBLE, 6)) AS last FROM tk GROUP BY vec_id""")
def token_pooling(spark, d):
    """Each embedding as eight tokens of eight numbers, of which the first item % 9 are unmasked."""
    v = D.vectors(spark, d).select("item", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8))).alias("h"))
    v = v.withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (t < F.col("item") % 9).cast("int")))
    return v.select("item", *[F.round(F.get(V.pool_tokens(F.col("h"), F.col("m"), how), F.lit(0)).cast("double"), 6).alias(how) for how in ("mean", "cls", "last")])


@plan("sample_roles", f"""WITH {INTER} SELECT usr AS user, pos + 1 AS position, item, CASE WHEN pos < greatest(n - 7, 0) THEN 'skip' WHEN pos < n - 2 THEN 'hist' WHEN pos = n - 2 THEN 'tgt' ELSE 'tail' END AS role
FROM (SELECT *, count(*) OVER (PARTITION BY usr) AS n FROM inter) WHERE n >= 2""")
def sample_roles(spark, d):
    """The last item but one as target, with the five items before it as its history."""
    h = D.histories(spark, d).where(F.size("history") >= 2)
    n = F.size("history")
    return M.roles(h.withColumn("target_pos", n - 2).withColumn("history_items", F.least(F.lit(5), n - 2)))


@plan("first_lines_csv", """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey::VARCHAR AS item, p_brand AS brand, p_size::VARCHAR AS size FROM part QUALIFY place < 150""")
def first_lines_csv(spark, d):
    """The first rows in the order of the files and their lines; each file has a header, lines have more fields than are read."""
    path = own_folder(spark, "first-lines")
    i = D.items(spark, d).select("item", "p_brand", "p_size", "p_type").repartitionByRange(4, "item").sortWithinPartitions("item")
    i.write.option("header", True).csv(path)
    out = R.capped_fields(spark, path, ["item", "brand", "size"], 150)
    return out


@plan("first_lines_json", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand FROM part QUALIFY place < 120")
def first_lines_json(spark, d):
    path = own_folder(spark, "first-json")
    i = D.items(spark, d).select("item", F.when(F.col("item") % 2 == 0, F.col("p_brand")).alias("brand")).repartitionByRange(4, "item").sortWithinPartitions("item")
    i.write.json(path)
    return R.capped_json(spark, path, "item BIGINT, brand STRING", 120)
