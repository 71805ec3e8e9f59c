"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's size is its number of words.  Sources, by code point with null
last, weigh 5, 2, 1, repeating, and share the size of the whole corpus by
weight; a target stops at ``MAX_REPEAT`` times its source's size and the excess
is shared again by weight (water filling over the sources, computed in closed
form with running sums over one row per source).

Within a source every document has the same expected number of copies, target /
source size.  The documents are laid out by size, then by a hash bucket of the
id, then by id and a hash of the row; the prefix sum of expected copies is taken,
an offset added, and a document is emitted once for each integer boundary its
stretch crosses.  Laying out by size keeps the words taken within about one
document's size of the target.  The offset is drawn from a hash of the seed and
the source; of it and ``OFFSETS - 1`` others spaced evenly from it, the one whose
words come nearest the target is used, which matters where a source has few
documents.

The prefix sum needs no sort of a whole source: counts by (source, size,
bucket) give each bucket's base, and only rows of one bucket are ordered
together, so a hot source, or a hot size in it, spreads over ``16 ** HEX``
buckets.  Texts are read once and never shuffled here: all steps work on short
rows, written to the shared folder after the words are counted.

A null text has size 0; a text of any length is counted whole; a null source is a
source of its own; a null id counts as an empty one in the bucket hash and sorts
first; equal rows are exchangeable; a corpus without words takes nothing; an
empty table gives an empty result; other columns are read only for the hash of
the row, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, cut

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "rowloom-mix"
#: Hex digits of the md5 that make a bucket.
HEX = 2
#: Offsets tried for each source.
OFFSETS = 64


def size_of(text: Column) -> Column:
    """Number of words of a whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEAT)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("free", F.col("cap") * F.col("left_w") > F.col("left_size") * F.col("w"))
    level = F.first(F.when(F.col("free"), F.struct("left_size", "left_w")), ignorenulls=True).over(every)
    rows = rows.withColumn("level", level)
    shared = F.col("level.left_size") * F.col("w") / F.col("level.left_w")
    return rows.select("source", "source_size", F.when(F.col("free"), shared).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """``(doc_id, row_hash, size, source_size, target, copies, taken)`` of every row.

    ``row_hash`` covers all columns of ``df``: with the id it finds the row again.
    """
    bucket = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, HEX)
    docs = cut(df.select(
        F.col(id_col).alias("doc_id"), row_hash(df).alias("row_hash"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), bucket.alias("bucket")
    ))
    counts = docs.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("m"))
    first = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("at_size", F.coalesce(F.sum("m").over(first), F.lit(0))).drop("m")
    plan = targets(by_source(counts))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("\\N"))).cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0
    plan = plan.withColumn("u", offset).withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    inner = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("at_bucket", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    base = null_safe(base, by_size, "source", "size")
    base = null_safe(base, plan, "source")
    base = base.select("source", "size", "bucket", (F.col("at_size") + F.col("at_bucket")).alias("base"), "source_size", "target", "u", "r")
    rows = null_safe(docs, base, "source", "size", "bucket")
    rank = F.col("base") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id", "row_hash"))
    rows = cut(rows.select("doc_id", "row_hash", "source", "size", "source_size", "target", "u", "r", rank.alias("rank")))
    # words taken under each offset: partial sums, one row a source
    tried = [F.sum(copies(F.col("r"), F.col("rank"), shifted(F.col("u"), F.lit(k))) * F.col("size")) for k in range(OFFSETS)]
    found = rows.groupBy("source", "target").agg(F.array(*tried).alias("words"))
    far = F.transform("words", lambda w, k: F.struct(F.abs(w - F.col("target")).alias("d"), k.alias("k")))
    best = found.select("source", F.array_min(far)["k"].alias("best"))
    rows = null_safe(rows, F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, "source")
    rows = rows.withColumn("copies", copies(F.col("r"), F.col("rank"), shifted(F.col("u"), F.col("best"))))
    return rows.select("doc_id", "row_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def shifted(u: Column, k: Column) -> Column:
    """The ``k``-th offset after ``u`` round the unit circle."""
    v = u + k / float(OFFSETS)
    return F.when(v >= 1.0, v - 1.0).otherwise(v)


def copies(r: Column, rank: Column, u: Column) -> Column:
    """Integer boundaries that a document's stretch crosses."""
    crossed = F.floor(r * rank + u) - F.floor(r * (rank - 1) + u)
    return F.least(F.lit(MAX_REPEAT).cast("long"), crossed)


def emit(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df``, all columns, as often as ``mixed`` (from ``mix``) takes them.

    Texts are shuffled at most once, by the join.  Rows equal in everything
    share what they take: each emits its part, the first ones one more.
    """
    keys = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n")).where("__copies > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    rows = df.select(row, F.col(id_col).alias("__own"), row_hash(df).alias("__h"))
    rows = rows.join(keys, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))).drop("__own", "__h")
    alone = rows.where("__n = 1").select("__row", "__copies")
    place = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(0)))
    part = F.floor(F.col("__copies") / F.col("__n")) + F.when(place <= F.col("__copies") % F.col("__n"), 1).otherwise(0)
    several = rows.where("__n > 1").select("__row", part.alias("__copies")).where("__copies > 0")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))
    return alone.unionByName(several).select("__row", again).select("__row.*")


def by_source(counts: DataFrame) -> DataFrame:
    """``(source, source_size)`` from counts by (source, size, ...)."""
    return counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))


def null_safe(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys of which ``source`` may be null."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"__{k}")) if k == "source" else F.col(k) == F.col(f"__{k}")
    return left.join(right, cond).drop(*[f"__{k}" for k in keys])


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HEX}) AS bucket
  FROM documents),
sized AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, {MAX_REPEAT} * source_size AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized),
running AS (
  SELECT *, CAST((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER win, 0) AS BIGINT) AS left_size,
         CAST((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER win, 0) AS BIGINT) AS left_w
  FROM weighed
  WINDOW win AS (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT left_size, left_w FROM running WHERE cap * left_w > left_size * w
  ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST LIMIT 1),
plan AS (
  SELECT source, source_size,
         CASE WHEN cap * running.left_w > running.left_size * w
              THEN (SELECT CAST(left_size * running.w AS DOUBLE) / left_w FROM level) ELSE CAST(cap AS DOUBLE) END AS target,
         CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(source, '\\N')), 1, 4) AS BIGINT) AS DOUBLE) / 65536.0 AS u
  FROM running),
ranked AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.u,
         CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS r,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.bucket, d.doc_id) AS k
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
offsets AS (SELECT source, target, o, CASE WHEN u + o / {OFFSETS}.0::DOUBLE >= 1 THEN u + o / {OFFSETS}.0::DOUBLE - 1 ELSE u + o / {OFFSETS}.0::DOUBLE END AS v
  FROM plan, (SELECT unnest(range({OFFSETS})) AS o)),
tried AS (
  SELECT f.source, f.o, any_value(f.v) AS v, abs(sum(least({MAX_REPEAT}, floor(r * k + v) - floor(r * (k - 1) + v)) * size) - any_value(f.target)) AS d
  FROM ranked JOIN offsets f ON ranked.source IS NOT DISTINCT FROM f.source GROUP BY f.source, f.o),
best AS (SELECT source, v FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, o) AS n FROM tried) WHERE n = 1)
SELECT doc_id, size, source_size, target,
       CAST(least({MAX_REPEAT}, floor(r * k + v) - floor(r * (k - 1) + v)) AS BIGINT) * size AS taken
FROM ranked JOIN best ON ranked.source IS NOT DISTINCT FROM best.source
"""
