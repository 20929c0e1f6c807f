"""The transfer report: how well spaces of item vectors and codes tell items apart that follow one another in histories."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codes as C
from . import cooccurrence as O
from .blocks import exact_neighbors
from .sequences import restricted
from .shared import saved
from .vectors import dot

SPACES = ("content", "code_prefix", "code_hamming")
MEASURES = ("ndcg", "recall", "hit")


def _item_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("item").agg(F.count("*").alias("cnt"))


class TransferReport:
    """Tables of the report, each computed when it is first asked for.

    local, reference: user, pos, item. universe, common: item. vectors: item, v. codes: item, codes of `slots` codes.

    Behaviour comes from the reference log (by default the local one), over the universe and, if given, over the common
    items, with positions counted anew before windows are laid. Pairs are those of items with min_freq or more events. For
    each space: scores of these pairs against as many drawn by frequency, and how the nearest items by the space retrieve
    an item's relevant ones (PPMI). Items without vector or codes stay out of that space.
    """

    def __init__(
        self, local: DataFrame, universe: DataFrame, vectors: DataFrame, codes: DataFrame, slots: int, window: int = 10, min_freq: int = 5, ks: tuple[int, ...] = (5, 10),
        reference: DataFrame | None = None, common: DataFrame | None = None, negatives: int = 1, bins: int = 10, seed=0, digits: int = 6,
    ) -> None:
        self.universe = universe.select("item").distinct()
        self.slots, self.ks, self.negatives, self.bins, self.seed, self.digits = slots, ks, negatives, bins, seed, digits
        own = restricted(local, self.universe)
        behaviour = own if reference is None else restricted(reference, self.universe)
        self.behaviour, self._own = saved(behaviour if common is None else restricted(behaviour, common)), own
        self.counts = saved(_item_counts(self.behaviour))
        self.pairs = saved(O.ppmi(O.window_pairs(self.behaviour, window), self.counts, min_freq))
        self.able = self.counts.where(F.col("cnt") >= min_freq).select("item")
        self.tables = {"content": vectors.select("item", F.col("v").alias("x")), "sid": codes.select("item", F.col("codes").alias("x"))}
        self.tables = {name: saved(t.join(self.universe, "item", "left_semi")) for name, t in self.tables.items()}

    @cached_property
    def own(self) -> DataFrame:
        """The local log over the universe, which scores and neighbours do not ask for."""
        return saved(self._own)

    @cached_property
    def overview(self) -> DataFrame:
        """One row of sizes."""
        size = lambda t, name: t.agg(F.count("*").alias(name))
        histories = self.behaviour.agg(F.count_distinct("user").alias("reference_histories"))
        out = size(self.universe, "items")
        for one in (size(self.own, "local_events"), size(self.behaviour, "reference_events"), histories, size(self.able, "eligible_items"), size(self.pairs, "pairs")):
            out = out.crossJoin(one)  # one row each
        return out

    @cached_property
    def scores(self) -> DataFrame:
        """space, positive, score of the pairs and of the drawn ones; the Hamming distance is turned, so nearer is higher."""
        drawn = O.negative_pairs(self.counts, self.pairs, max(self.pairs.count() * self.negatives, 1), self.seed)
        both = saved(self.pairs.select("left", "right", F.lit(True).alias("positive")).unionByName(drawn.withColumn("positive", F.lit(False))))
        a, b = F.col("a"), F.col("b")

        def scored(table: DataFrame, **by: Column) -> DataFrame:
            left, right = table.select(F.col("item").alias("left"), F.col("x").alias("a")), table.select(F.col("item").alias("right"), F.col("x").alias("b"))
            each = F.explode(F.array(*[F.struct(F.lit(name).alias("space"), s.cast("double").alias("score")) for name, s in by.items()]))
            return both.join(left, "left").join(right, "right").select("positive", each.alias("s")).select("s.space", "positive", "s.score")

        content = scored(self.tables["content"], content=F.round(dot(a, b), self.digits))
        return saved(content.unionByName(scored(self.tables["sid"], code_prefix=C.common_prefix(a, b), code_hamming=-C.hamming(a, b))))

    @cached_property
    def spaces(self) -> DataFrame:
        """space, number, mean and median of positive and negative pairs, auc."""
        by = saved(O.by_score(self.scores, "score", F.col("positive"), "space"))
        out = None
        for name in SPACES:
            got = O.summary_of(by.where(F.col("space") == name), "score").withColumn("space", F.lit(name))
            out = got if out is None else out.unionByName(got)
        return out

    @cached_property
    def buckets(self) -> DataFrame:
        """space, bucket, low, high, n, rate of positive pairs."""
        out = None
        for name in SPACES:
            got = O.positive_rate_by_quantile(self.scores.where(F.col("space") == name), "score", F.col("positive"), self.bins).withColumn("space", F.lit(name))
            out = got if out is None else out.unionByName(got)
        return out

    @cached_property
    def anchor_metrics(self) -> DataFrame:
        """space, k, anchor, ndcg, recall, hit."""
        rel = saved(O.relevance(self.pairs, "ppmi"))
        anchors = rel.select(F.col("anchor").alias("item")).distinct()
        out = None
        for name, table in self.tables.items():
            asking, able = table.join(anchors, "item", "left_semi"), table.join(self.able, "item", "left_semi")
            if name == "content":
                nearest = exact_neighbors(asking.withColumnRenamed("x", "v"), able.withColumnRenamed("x", "v"), max(self.ks), self.digits)
            else:
                nearest = C.prefix_neighbors(asking.withColumnRenamed("x", "codes"), able.withColumnRenamed("x", "codes"), self.slots, max(self.ks))
            nearest = saved(nearest)
            mine = rel.join(table.select(F.col("item").alias("anchor")), "anchor", "left_semi")
            for k in self.ks:
                got = O.retrieval(nearest, mine, k).select(F.lit(name).alias("space"), F.lit(k).alias("k"), "anchor", *MEASURES)
                out = got if out is None else out.unionByName(got)
        return saved(out)

    @cached_property
    def retrieval(self) -> DataFrame:
        """space, k, anchors and means of their ndcg, recall and hit."""
        return self.anchor_metrics.groupBy("space", "k").agg(F.count("*").alias("anchors"), *[F.avg(c).alias(c) for c in MEASURES])

    @cached_property
    def items(self) -> DataFrame:
        """item, local_freq, reference_freq, for each space and k ndcg, recall and hit, and at each k the vectors' NDCG less the codes'."""
        columns = [(s, k) for s in self.tables for k in self.ks]
        at = lambda s, k, c: F.max(F.when((F.col("space") == s) & (F.col("k") == k), F.col(c)))
        wide = self.anchor_metrics.groupBy(F.col("anchor").alias("item")).agg(*[at(s, k, c).alias(f"{s}_{c}_{k}") for s, k in columns for c in MEASURES])
        for k in self.ks:
            wide = wide.withColumn(f"loss_ndcg_{k}", F.col(f"content_ndcg_{k}") - F.col(f"sid_ndcg_{k}"))
        freq = _item_counts(self.own).select("item", F.col("cnt").alias("local_freq")).join(self.counts.select("item", F.col("cnt").alias("reference_freq")), "item", "full")
        return self.universe.join(freq, "item", "left").join(wide, "item", "left").fillna(0, ["local_freq", "reference_freq"])
