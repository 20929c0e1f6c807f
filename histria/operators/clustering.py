"""Content blocks, hierarchical k-means and item vectors, on pyspark.ml."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running
from .shared import saved
from .splits import hash_key
from .vectors import dot, l2_normalize


def pca(vectors: DataFrame, dims: int) -> tuple[DataFrame, list[float]]:
    """item, v: centred principal coordinates, and the explained variance ratios."""
    x = vectors.select("item", array_to_vector(F.transform("v", lambda a: a.cast("double"))).alias("x"))
    centred = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(x).transform(x)
    model = PCA(k=dims, inputCol="c", outputCol="p").fit(centred)
    return model.transform(centred).select("item", vector_to_array("p").alias("v")), model.explainedVariance.toArray().tolist()


def cluster_block(content: DataFrame, collaborative: DataFrame | None, alpha: float) -> DataFrame:
    """item, v: one block alone, or both L2-normalised and weighted by sqrt(alpha) and sqrt(1 - alpha)."""
    if collaborative is None or alpha >= 1:
        return content.select("item", l2_normalize(F.col("v")).alias("v"))
    if alpha <= 0:
        return collaborative.select("item", l2_normalize(F.col("v")).alias("v"))
    a, b = F.lit(alpha**0.5), F.lit((1 - alpha) ** 0.5)
    left = content.select("item", F.transform(l2_normalize(F.col("v")), lambda x: x * a).alias("x"))
    right = collaborative.select("item", F.transform(l2_normalize(F.col("v")), lambda x: x * b).alias("y"))
    return left.join(right, "item").select("item", F.concat("x", "y").alias("v"))


def relabel(assigned: DataFrame, node: str = "node") -> DataFrame:
    """label of each cluster inside its parent node, by (-size, smallest member)."""
    size = assigned.groupBy(node, "cluster").agg(F.count("*").alias("n"), F.min("item").alias("least"))
    w = Window.partitionBy(node).orderBy(F.desc("n"), "least")
    return size.select(node, "cluster", (F.row_number().over(w) - 1).alias("label"))


#: Broadcast limit of centroid tables; larger ones are joined by a shuffle that adaptive execution may split.
CENTROID_BYTES = 16_000_000


def _sized(df: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(df) if rows * width <= CENTROID_BYTES else df


def nearest_centroid(x: Column, centroids: Column) -> Column:
    """Cluster of the centroid (array of cluster, c) at the least squared distance, ties to the smaller cluster."""
    far = lambda c: F.aggregate(F.zip_with(x, c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return F.array_min(F.transform(centroids, lambda c: F.struct(far(c).alias("d"), c["cluster"].alias("cluster"))))["cluster"]


def grouped_kmeans(rows: DataFrame, k: int, iterations: int, dims: int, seed=0) -> DataFrame:
    """item, node, cluster: Lloyd's iterations in all nodes at once. rows: item, node, x (array<long>, the vector in fixed point).

    A node's first centroids are its first k items in the order of sha256("seed:item"). An iteration is one join by node
    and one aggregation of partial sums by (node, cluster): the number of jobs does not depend on the number of nodes. Sums
    are whole numbers, so centroids are the same at any partitioning. A centroid no item is nearest to goes. The loop ends
    after `iterations`, or when no centroid moves.
    """
    order = Window.partitionBy("node").orderBy(hash_key("item", seed), "item")
    first = rows.withColumn("cluster", (F.row_number().over(order) - 1).cast("int")).where(F.col("cluster") < k)
    now = saved(first.select("node", "cluster", F.transform("x", lambda a: a.cast("double")).alias("c")))

    def assigned(centroids: DataFrame) -> DataFrame:
        listed = centroids.groupBy("node").agg(F.collect_list(F.struct("cluster", "c")).alias("cs"))  # at most k a node
        return rows.join(_sized(listed, centroids.count(), 8 * dims + 32), "node").withColumn("cluster", nearest_centroid(F.col("x"), F.col("cs"))).drop("cs")

    for _ in range(iterations):
        sums = assigned(now).groupBy("node", "cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims)])
        new = saved(sums.select("node", "cluster", F.array(*[F.col(f"s{i}").cast("double") / F.col("n") for i in range(dims)]).alias("c")))
        still = new.join(now.withColumnRenamed("c", "old"), ["node", "cluster"]).where("c = old").count()
        stop = still == new.count() == now.count()
        now = new
        if stop:
            break
    return assigned(now).select("item", "node", "cluster")


def path_key(path: Column) -> Column:
    """Text that sorts as the tree is walked: a node before its children, children by label."""
    return F.array_join(F.transform(path, lambda x: F.lpad(x.cast("string"), 9, "0")), ".")


def hierarchy(vectors: DataFrame, freq: DataFrame, sizes: list[int], seed=0, iterations: int = 20, scale: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, level, parent, label, child_count; leaves: item, node, path, leaf_label).

    Each level splits every node of it into min(k, items) clusters, all nodes at once. One cluster, or one cluster an item
    (ordered by -frequency, item), needs no fit; others are labelled by (-size, smallest member). Leaves are labelled by
    (-frequency, item). Nodes are numbered as the tree is walked, a node before its children. Vectors are used in fixed
    point, round(v * scale), so |v * scale| has to stay below 2^43. Jobs: levels times iterations.
    """
    dims = max(1, dimensions(vectors))
    weight = freq.select("item", F.col("freq").alias("freq_"))
    rows = vectors.select("item", F.transform("v", lambda a: F.round(a.cast("double") * scale).cast("long")).alias("x"))
    rows = saved(rows.join(weight, "item", "left").withColumn("freq_", F.coalesce("freq_", F.lit(0)).cast("long")))
    now = rows.withColumn("path", F.array().cast("array<int>")).withColumn("node", F.lit(""))
    seen = now.select("path").limit(1)
    for k in sizes:
        counts = saved(now.groupBy("node").agg(F.count("*").alias("n")))  # one row a node
        sized = now.join(_sized(counts, counts.count(), 64), "node")
        alone = sized.where((F.col("n") == 1) | F.lit(k <= 1)).select("item", "node", F.lit(0).alias("label"))
        w = Window.partitionBy("node").orderBy(F.desc("freq_"), "item")
        each = sized.where((F.col("n") > 1) & (F.col("n") <= k)).select("item", "node", (F.row_number().over(w) - 1).alias("label"))  # k rows a node at most
        parts = alone.unionByName(each)
        fit = saved(sized.where(F.col("n") > k).select("item", "node", "x")) if k > 1 else None
        if fit is not None and not fit.isEmpty():
            found = saved(grouped_kmeans(fit, k, iterations, dims, seed))
            labels = relabel(found)
            parts = parts.unionByName(found.join(_sized(labels, k * counts.count(), 64), ["node", "cluster"]).select("item", "node", "label"))
        parts = parts.select("item", "label")
        now = saved(now.join(parts, "item").withColumn("path", F.array_append("path", F.col("label").cast("int"))).withColumn("node", path_key(F.col("path"))).drop("label"))
        seen = seen.unionByName(now.select("path").distinct())
    seen = saved(seen)
    numbered = saved(running(seen.withColumn("key_", path_key(F.col("path"))), ["key_"], out="node"))
    nodes = numbered.select(F.col("node").cast("long").alias("node"), F.size("path").alias("level"), "key_", "path", F.try_element_at("path", F.lit(-1)).alias("label"))
    upper = nodes.select(F.col("node").alias("parent"), F.col("key_").alias("parent_key"))
    nodes = nodes.withColumn("parent_key", F.when(F.col("level") > 0, path_key(F.slice("path", 1, F.greatest(F.col("level") - 1, F.lit(0))))))
    nodes = saved(nodes.join(upper, "parent_key", "left").select("node", "level", "parent", "label", "key_"))
    # leaf labels in two levels: places in the order of (leaf, -frequency, item), less the leaf's first place
    item = F.lpad(F.col("item").cast("string"), 20, "0") if dict(vectors.dtypes)["item"] in ("int", "bigint", "smallint") else F.col("item").cast("string")
    key = F.concat_ws("|", "node", F.lpad((F.lit(2**62) - F.col("freq_")).cast("string"), 20, "0"), item)
    placed = saved(running(now.select("item", "path", F.col("node").alias("key_"), key.alias("order_")), ["order_", "item"], out="place"))
    start = placed.groupBy("key_").agg(F.min("place").alias("start"), F.count("*").alias("leaf_count"))
    leaves = placed.join(start, "key_").join(nodes.select("key_", "node"), "key_").select("item", "node", "path", (F.col("place") - F.col("start")).alias("leaf_label"))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    out = nodes.join(kids, "node", "left").join(start, "key_", "left")
    return out.select("node", "level", "parent", "label", F.coalesce("children", "leaf_count", F.lit(0)).alias("child_count")), leaves


def residual_codes(vectors: DataFrame, slots: int, size: int, seed: int = 0) -> DataFrame:
    """item, codes: k-means on what the codes so far leave over, one slot after the other."""
    now = vectors.select("item", F.transform("v", lambda a: a.cast("double")).alias("v"), F.array().cast("array<int>").alias("codes"))
    for s in range(slots):
        x = saved(now.withColumn("features", array_to_vector("v")))
        model = KMeans(k=size, seed=seed + s, featuresCol="features", predictionCol="c").fit(x)
        centers = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "c int, center array<double>")
        now = model.transform(x).join(F.broadcast(centers), "c").select("item", F.zip_with("v", "center", lambda a, b: a - b).alias("v"), F.array_append("codes", F.col("c")).alias("codes"))
    return now.select("item", "codes")


def product_codes(vectors: DataFrame, slots: int, size: int, iterations: int = 20, seed=0, scale: int = 1 << 20) -> DataFrame:
    """item, codes: the vector cut into `slots` equal parts (filled up with zeros), each part's nearest of `size` centroids.

    The codebooks of all parts are fitted together: a part is a node of grouped_kmeans(), so an iteration is one pass."""
    width = -(-max(1, dimensions(vectors)) // slots)
    x = F.transform("v", lambda a: F.round(a.cast("double") * scale).cast("long"))
    padded = F.concat(x, F.array_repeat(F.lit(0).cast("long"), slots * width - F.size("v")))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.slice(padded, i * width + 1, F.lit(width)))
    rows = saved(vectors.select("item", F.posexplode(pieces).alias("node", "x")))
    found = grouped_kmeans(rows, size, iterations, width, seed)
    return found.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "cluster"))), lambda p: p["cluster"]).alias("codes"))


def product_codebook(vectors: DataFrame, codes: DataFrame, slots: int) -> DataFrame:
    """slot, code, center: the mean of each code's parts."""
    width = -(-max(1, dimensions(vectors)) // slots)
    both = vectors.join(codes, "item").select(F.posexplode("codes").alias("slot", "code"), "v")
    parts = both.select("slot", "code", F.posexplode(F.slice("v", F.col("slot") * width + 1, F.lit(width))).alias("i", "a"))
    means = parts.groupBy("slot", "code", "i").agg(F.avg(F.col("a").cast("double")).alias("m"))
    return means.groupBy("slot", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("center"))


def decode_product(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """item, v: the centers of an item's codes one after the other."""
    long = codes.select("item", F.posexplode("codes").alias("slot", "code")).join(codebook, ["slot", "code"])
    return long.groupBy("item").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "center"))), lambda p: p["center"])).alias("v"))


def turned(vectors: DataFrame, rotation: np.ndarray) -> DataFrame:
    """item, v: vectors times a matrix, one product an Arrow batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ rotation
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("item"), v], ["item", "v"])

    doubles = vectors.select("item", F.transform("v", lambda a: a.cast("double")).alias("v"))
    return doubles.mapInArrow(run, f"item {dict(vectors.dtypes)['item']}, v array<double>")


def cross_products(pairs: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Sum over rows of the outer products of arrays x and y: a matrix a task, added up by cell."""

    def run(batches):
        total = np.zeros((rows, columns))
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("x", "y"))
                total += x.T @ y
        i, j = np.divmod(np.arange(rows * columns), columns)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "a"])

    out = np.zeros((rows, columns))
    for r in pairs.select("x", "y").mapInArrow(run, "i long, j long, a double").groupBy("i", "j").agg(F.sum("a").alias("a")).collect():  # rows x columns numbers
        out[r["i"], r["j"]] = r["a"]
    return out


def rotated_product_codes(vectors: DataFrame, slots: int, size: int, rounds: int = 4, iterations: int = 10, seed=0) -> tuple[DataFrame, np.ndarray]:
    """(item, codes; rotation): product codes after the rotation that suits them.

    By turns: codes and codebooks of the turned vectors, then the orthogonal matrix that brings the vectors nearest to what
    the codes give back (Procrustes over the sums of outer products of all vectors). The number of dimensions has to be a
    multiple of the slots."""
    dims = dimensions(vectors)
    if dims % slots:
        raise ValueError("slots must divide the dimensions")
    plain = saved(vectors.select("item", F.transform("v", lambda a: a.cast("double")).alias("v")))
    rotation = np.eye(dims)
    for _ in range(rounds):
        x = saved(turned(plain, rotation))
        codes = saved(product_codes(x, slots, size, iterations, seed))
        back = decode_product(codes, product_codebook(x, codes, slots)).withColumnRenamed("v", "y")
        u, _, v = np.linalg.svd(cross_products(plain.select("item", F.col("v").alias("x")).join(back, "item"), dims, dims))
        rotation = u @ v
    return product_codes(turned(plain, rotation), slots, size, iterations, seed), rotation


def item_vectors(histories: DataFrame, items: DataFrame, dims: int, window: int, min_count: int = 1, seed: int = 0) -> DataFrame:
    """item, v from skip-grams over histories; items never seen get zeros."""
    words = histories.select(F.transform("history", lambda x: x.cast("string")).alias("h"))
    got = Word2Vec(vectorSize=dims, windowSize=window, minCount=min_count, seed=seed, inputCol="h", outputCol="o", maxIter=1).fit(words).getVectors()
    v = got.select(F.col("word").alias("w"), vector_to_array("vector").alias("v"))
    zero = F.array_repeat(F.lit(0.0), dims)
    return items.select("item", F.col("item").cast("string").alias("w")).join(v, "w", "left").select("item", F.coalesce("v", zero).alias("v"))


def signs(v: str, planes: list[list[float]]) -> Column:
    """1 where the vector lies on the positive side of a plane, else 0."""
    side = lambda p: F.when(dot(F.col(v), F.array(*[F.lit(float(x)) for x in p])) > 0, 1).otherwise(0)
    return F.array(*[side(p) for p in planes])


def hashed_planes(dims: int, bits: int, seed: int = 0) -> list[list[int]]:
    """+1 and -1 from the last hex digit of sha256("seed:bit:dimension")."""
    return [[1 - 2 * (int(hashlib.sha256(f"{seed}:{b}:{i}".encode()).hexdigest()[-1], 16) % 2) for i in range(dims)] for b in range(bits)]


def dimensions(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("v"))).first()[0] or 0


def sign_codes(vectors: DataFrame, bits: int, seed: int = 0) -> DataFrame:
    """item, bits: signs of `bits` hashed projections of the vector."""
    return vectors.select("item", signs("v", hashed_planes(dimensions(vectors), bits, seed)).alias("bits"))


def gaussian_codes(vectors: DataFrame, bits: int, seed: int = 0) -> DataFrame:
    """item, bits: signs of projections on normally distributed directions."""
    planes = np.random.default_rng(seed).standard_normal((bits, dimensions(vectors)))
    return vectors.select("item", signs("v", planes.tolist()).alias("bits"))


def pca_codes(vectors: DataFrame, bits: int) -> DataFrame:
    """item, bits: signs of the centred principal coordinates."""
    return pca(vectors, bits)[0].select("item", F.transform("v", lambda x: (x > 0).cast("int")).alias("bits"))


#: Vectors a rotation is fitted on, chosen by a hash of the item.
ROTATION_ROWS = 20_000


def rotated_codes(vectors: DataFrame, bits: int, rounds: int = 50, seed: int = 0, rows: int = ROTATION_ROWS) -> DataFrame:
    """item, bits: signs of principal coordinates after the rotation that brings them nearest to their signs (iterative
    quantization: signs for a fixed rotation, then the orthogonal Procrustes rotation for fixed signs). The rotation is
    fitted on a bounded sample and applied to all."""
    coordinates = saved(pca(vectors, bits)[0])
    sample = coordinates.orderBy(F.xxhash64("item"), "item").limit(rows).select("v").collect()
    x = np.array([r[0] for r in sample], float).reshape(len(sample), bits)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ rotation > 0, 1.0, -1.0).T @ x)
        rotation = (u @ v).T
    return coordinates.select("item", signs("v", rotation.T.tolist()).alias("bits"))


def encode_text(items: DataFrame, encode, dims: int, item: str = "item", text: str = "text") -> DataFrame:
    """item, v by a pluggable encoder: encode(list of texts) -> list of vectors, called once an Arrow batch."""
    def run(batches):
        import pandas as pd

        for b in batches:
            v = [list(map(float, x)) for x in encode(b[text].fillna("").tolist())]
            if any(len(x) != dims for x in v):
                raise ValueError("wrong dimension")
            yield pd.DataFrame({"item": b[item], "v": v})

    kind = dict(items.dtypes)[item]
    return items.select(item, text).mapInPandas(run, f"item {kind}, v array<double>")
