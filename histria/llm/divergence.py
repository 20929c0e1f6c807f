r"""Source divergence audit (operator 11): how far the word use of a language's sources lies apart.

Tasks count words by DuckDB over their own rows; the counts are dealt into shards by a hash of (lang, term), where SQL over
a shard's rows gives the kept terms, and later the shard's part of every pair's sum; Spark adds these up and ranks.

A pair's sum runs over all kept terms of the language. Most counts are 0 in most sources, so with p0 the share of a count of
0 and f the divergence of two shares it is taken as ::

    V f(s0, t0)  +  sum over terms s has of f(s, t0) - f(s0, t0)  +  the same the other way round
                 +  sum over terms that both have of f(s, t) - f(s, t0) - f(s0, t) + f(s0, t0)

which is the same integer, and only the last sum needs terms to meet. The first two need the numbers of terms by count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts, small, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_DOCS, TOP_TERMS = 10, 10
#: Rows of counts a task adds up before it hands them on.
HELD_ROWS = 1_000_000
#: Text that one statement splits into words.
SLICE_BYTES = 16 << 20

_TERMS = f"""SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM (
  SELECT r, lang, source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM texts)
  GROUP BY ALL) GROUP BY lang, source, term"""
_ADD = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY lang, source, term"
_KEPT = "SELECT lang, term, source, n, sum(n) OVER t::BIGINT AS n_lang FROM counts WINDOW t AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER t >= {least}"
_F = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
_PARTS = f"""
SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, NULL::BIGINT AS p, NULL::BIGINT AS p0,
  sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.p0")} - {_F.format("a.p0", "b.p")} + {_F.format("a.p0", "b.p0")})::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
UNION ALL BY NAME SELECT 'count' AS kind, lang, source, NULL AS item, p, p0, count(*) AS value FROM shares GROUP BY lang, source, p, p0
UNION ALL BY NAME SELECT 'term' AS kind, lang, source, term AS item, NULL::BIGINT AS p, NULL::BIGINT AS p0, {_F.format("p", "q")} AS value FROM shares WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {{top}}"""
_COUNTS = "lang string, source string, term string, n long, docs long"


def _sql(statement: str, **tables: pa.Table) -> pa.Table:
    """One statement over Arrow tables: one thread, no files."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1500MB"}) as c:
        for name, rows in tables.items():
            c.register(name, rows)
        return c.sql(statement).to_arrow_table()


def _out(rows: pa.Table, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    yield from rows.combine_chunks().to_batches(max_chunksize=size)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Consecutive rows with about SLICE_BYTES of text, one row at least."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if held and held + n > SLICE_BYTES:
            yield pa.Table.from_batches([batch.slice(at, i - at)])
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield pa.Table.from_batches([batch.slice(at)])


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of this task's texts by lang, source and term: occurrences and documents. Handed on in parts of about HELD_ROWS."""
    held, rows = [], 0
    for batch in batches:
        for part in _slices(batch):
            got = _sql(_TERMS, texts=part.append_column("r", pa.array(range(part.num_rows), pa.int64())))
            held.append(got)
            rows += got.num_rows
            if rows > HELD_ROWS:
                held = [_sql(_ADD, counts=pa.concat_tables(held))]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from _out(held[0])
                    held, rows = [], 0
    if held:
        yield from _out(_sql(_ADD, counts=pa.concat_tables(held)))


def _shard_counts(least: int):
    """Kept terms of a shard. What comes in is added up as it comes, so a term that every task has met is held once a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > max(HELD_ROWS, 2 * last):
                held = [_sql(_ADD, counts=pa.concat_tables(held))]
                rows = last = held[0].num_rows
        if held:
            yield from _out(_sql(_KEPT.format(least=least).replace("FROM counts", f"FROM ({_ADD})"), counts=pa.concat_tables(held)))

    return run


def _shard_sums(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches]
        if held:
            yield from _out(_sql(_PARTS.format(top=top), shares=pa.concat_tables(held)))

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(count + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total + 2 * terms)) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: what tells a source from the others of its language.

    Part `pair`: item is each other source of the language, value the divergence of the two over all kept terms (those in
    at least min_docs documents of the language); the largest first. Part `term`: the top_terms terms that the source
    has too often against its language, by their divergence. Ties go by item in UTF-8 order.

    Null text, lang and source are ''. A source whose texts have no terms is compared all the same; in a language
    without kept terms all values are 0. A source that is alone in its language has no pairs. Repeated rows count each.
    No rows in, none out; other columns are not read. Texts are taken whole: a statement gets 16 MB of them or one text.
    A task's counts are added up before they are shuffled, so a word, a source or a group of copies that holds a third of
    the corpus reaches its shard as one row a task and source.
    """
    spark = docs.sparkSession
    words = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = words.mapInArrow(_local_counts, _COUNTS).repartition(parts(docs), "lang", "term")
    kept = materialize(counts.mapInArrow(_shard_counts(min_docs), "lang string, term string, source string, n long, n_lang long"), "kept-terms")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    groups = words.groupBy("lang", "source").agg(F.lit(0).alias("z")).drop("z")  # a source without kept terms too
    groups = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")))
    groups = materialize(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))), "groups")
    shares = kept.join(small(groups, 96), ["lang", "source"]).select(
        "lang", "term", "source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", share(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    sums = shares.repartition(parts(docs), "lang", "term").mapInArrow(_shard_sums(top_terms), "kind string, lang string, source string, item string, p long, p0 long, value long")
    sums = materialize(sums, "partial-sums")
    # terms by share, once for every other source of the language
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("i0"))
    ordered = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", "terms", "p0", "i0")
    alone = sums.where("kind = 'count'").groupBy("lang", "source", "p", "p0").agg(F.sum("value").alias("m"))
    one = alone.join(other, "lang").where("source <> item")
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (gap(F.col("p"), F.col("i0")) - gap(F.col("p0"), F.col("i0")))).alias("v"))
    both = sums.where("kind = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("v"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    base = ordered.select("lang", "source", "item", F.coalesce(F.col("terms") * gap(F.col("p0"), F.col("i0")), F.lit(0)).alias("v"))
    pairs = base.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    best = sums.where("kind = 'term'").select("lang", "source", "item", "value")
    out = pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = out.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
    return out.select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0)::HUGEINT + 2 * v))::BIGINT AS p,
  (1 + (1000000000 * (k.n + 2)::HUGEINT) // (z.total + 2 * v))::BIGINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN z ON g.lang = z.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
none AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM z)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM x WHERE n > 0 AND p > q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM none UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
