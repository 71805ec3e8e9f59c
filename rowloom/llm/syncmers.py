"""Document fingerprints from closed syncmers, in DataFrame functions only.

A run of ``K`` code points is a closed syncmer if, among its inner runs of ``S``
code points, the one with the smallest hash is the first or the last.  That
depends on the run alone, not on what stands around it or where, so an unchanged
passage keeps its anchors wherever it moves, in texts of any length and script.
The fingerprint is the list of all anchors in text order: one long each, the
upper 32 bits a hash of the run, the lower 32 its position (code points).  Two
neighbours lie at most ``K - S`` apart, so a text of ``WIDE`` code points has
some; a shorter one without any, or of under ``K`` code points, has its whole
sequence as the only anchor, an empty text none.

Likeness is the share of distinct anchor hashes two texts have in common (Dice),
over all anchors.  ``aligned`` matches anchors by position: it gives the shifts
at which passages of one text stand in another.

Anchors of a text put together from two others are those of its parts, moved,
and those across the seam; so the edited text's fingerprint is not computed
from scratch.

A null text counts as empty; texts of any length are read whole; equal texts
have equal fingerprints; rows with the same id, null last, follow by a hash of
the text; repeated rows follow each other; an empty table gives an empty
result; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 16
S = 5
#: Code points from which a text surely has an anchor of its own.
WIDE = 2 * K
_HIGH = -(1 << 32)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors_of(text: Column) -> Column:
    """All anchors of a non-null text, in text order."""
    inner = K - S

    def run(code: Column, at: Column, length: Column | int) -> Column:
        return F.xxhash64(F.substring(code, at * 4 + 1, F.lit(length) * 4))

    def anchor(code: Column, at: Column, length: Column | int) -> Column:
        return run(code, at, length).bitwiseAND(F.lit(_HIGH)).bitwiseOR(at.cast("long"))

    def of(code: Column) -> Column:
        n = F.length(code) / 4
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n.cast("int") - S))

        def pick(h: Column) -> Column:
            # comparisons end at the first that fails, after three or so
            def first(x: Column, i: Column) -> Column:
                return F.when(reduce(lambda c, d: c & (x <= F.get(h, i + d)), range(1, inner + 1), i < F.size(h) - inner), i)

            def last(x: Column, i: Column) -> Column:
                return F.when(reduce(lambda c, d: c & (x <= F.get(h, i - d)), range(1, inner + 1), i >= inner), i - inner)

            at = F.sort_array(F.array_union(F.array_compact(F.transform(h, first)), F.array_compact(F.transform(h, last))))
            return F.transform(at, lambda i: anchor(code, i, K))

        whole = F.array(anchor(code, F.lit(0), n.cast("int")))
        many = _let(F.transform(starts, lambda i: run(code, i, S)), pick)
        return F.when(n >= K, _let(many, lambda x: F.when(F.size(x) > 0, x).otherwise(whole))).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return _let(F.encode(text, "UTF-32"), of)


def hashes(anchors: Column) -> Column:
    """Distinct hashes of an anchor column."""
    return F.array_distinct(F.transform(anchors, lambda a: F.shiftrightunsigned(a, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Share of hashes in common, 0 to 1, of two columns of distinct hashes; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def text_of(anchors: Column) -> Column:
    """Fingerprint string: 9 hex digits an anchor, 8 of its hash and one of its distance from the anchor before."""
    # neighbours lie less than 16 apart, so the last hex digit of both positions gives the distance
    last = lambda a: a.bitwiseAND(F.lit(15))

    def digits(x: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            step = F.coalesce((last(a) - last(F.get(x, i - 1))).bitwiseAND(F.lit(15)), last(a))
            return F.lpad(F.hex(F.shiftleft(F.shiftrightunsigned(a, 32), 4) + step), 9, "0")

        return F.lower(F.array_join(F.transform(x, one), ""))

    return _let(anchors, digits)


def spliced(a: Column, n_a: Column, b: Column, n_b: Column, seam: Column) -> Column:
    """Anchors of the first ``n_a`` code points of one text followed by the first ``n_b`` of another.

    ``a`` and ``b`` are their anchors; ``seam`` is the text across the seam, up
    to K - 1 code points on either side.  Both texts must have ``WIDE`` code points or more.
    """
    low = F.lit((1 << 32) - 1)

    # lengths are bound once: a lambda over anchors would work out a column's expression at each of them
    def moved(x: Column, by: Column) -> Column:
        return _let(by.cast("long"), lambda d: F.transform(x, lambda v: v + d))

    def within(x: Column, n: Column) -> Column:
        return _let(n.cast("long") - K, lambda last: F.filter(x, lambda v: v.bitwiseAND(low) <= last))

    def across(between: Column) -> Column:
        return F.when(F.char_length(between) >= K, moved(anchors_of(between), F.greatest(n_a - (K - 1), F.lit(0))))

    none = F.array().cast("array<bigint>")
    return F.concat(within(a, n_a), F.coalesce(_let(seam, across), none), moved(within(b, n_b), n_a))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_id, right_id, shift, anchors, first, last)``: passages that two tables of fingerprints share.

    Both tables are ``(doc_id, anchors)``.  Anchors of equal hash are matched by
    an equi-join and counted by shift, the position in ``right`` less that in
    ``left``; ``first`` and ``last`` bound them in ``left``.  Within a text a hash
    counts at its first position, so a text's repeats make no pairs of their own.
    """
    def rows(df: DataFrame, side: str) -> DataFrame:
        one = df.select(F.col("doc_id").alias(f"{side}_id"), F.explode("anchors").alias("a"))
        h, at = F.shiftrightunsigned("a", 32).alias("h"), F.col("a").bitwiseAND(F.lit((1 << 32) - 1))
        return one.select(f"{side}_id", h, at.alias("at")).groupBy(f"{side}_id", "h").agg(F.min("at").alias(f"{side}_at"))

    both = rows(left, "left").join(rows(right, "right"), "h")
    shift = (F.col("right_at") - F.col("left_at")).alias("shift")
    return both.groupBy("left_id", "right_id", shift).agg(F.count("*").alias("anchors"), F.min("left_at").alias("first"), F.max("left_at").alias("last"))


def id_ranges(df: DataFrame, n: int) -> Column:
    """Number of the range of a row ``(__key, __hash)``, rising with the key and then falling with the hash.

    Cuts the rows into about ``n`` ranges of equal row counts.  An id that holds
    several cuts (the null id, or a repeated one) is split again by its hash.
    The driver holds ``n`` cuts; a row finds its range by binary search.
    """
    cuts = df.agg(F.percentile_approx("__key", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else None
    values, first, parts, at = [], [], [], 0
    for v, times in sorted(Counter(cuts or []).items()):
        values.append(v)
        first.append(at)
        parts.append(times if times > 1 else 0)
        at += 1 + parts[-1]
    if not values:
        return F.lit(0)
    known, firsts, splits = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (values, [*first, at], parts))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(values).bit_length()))])
    # how many cuts lie below the key
    below = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(known, lo + step - 1) < F.col("__key"), lo + step).otherwise(lo))
    share = F.shiftrightunsigned(F.bitwise_not(F.col("__hash").bitwiseXOR(F.lit(-(1 << 63)))), 33)  # falls as the hash rises

    def number(b: Column) -> Column:
        hot = (F.get(known, b) == F.col("__key")) & (F.get(splits, b) > 0)
        return F.get(firsts, b) + F.coalesce(F.when(hot, 1 + F.floor(share * F.get(splits, b) / (1 << 31))), F.lit(0))

    return _let(below, number).cast("int")


def with_next(df: DataFrame, id_col: str, text_col: str, made: list[dict[str, Column]], cols: dict[str, str], ranges: int | None = None) -> DataFrame:
    """Add the ``made`` columns, then ``cols[c]``: column ``c`` of the next row by descending id; after the last comes the first.

    Rows are dealt by range and ordered inside it; the first row of the range
    below visits each range as a guest, so no task sees the whole table.  Only
    ``df`` is shuffled; ``made`` is computed after that.
    """
    ranges = ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("__key", F.coalesce(F.col(id_col), F.lit(-(1 << 63)).cast("long"))).withColumn("__hash", F.xxhash64(text_col))
    df = df.withColumn("__range", id_ranges(df, ranges))
    top = F.max(F.struct("__key", (-1 - F.col("__hash")).alias("h")))
    most = df.groupBy("__range").agg(top.alias("m")).orderBy("__range").collect()  # one row a range
    used = [r["__range"] for r in most]
    borders = [(r["m"]["__key"], -1 - r["m"]["h"], above) for r, above in zip(most, used[1:] + used[:1])]
    df = df.withColumn("__guest", F.lit(False))
    if borders:
        visits = F.broadcast(df.sparkSession.createDataFrame(borders, "__key long, __hash long, __to int"))
        guests = df.join(visits, ["__key", "__hash"]).withColumn("__range", F.col("__to")).drop("__to").withColumn("__guest", F.lit(True))
        df = df.unionByName(guests)
    # one partition per range: no range waits behind another in the same task
    df = df.repartitionById(max(used, default=0) + 1, "__range")
    df = reduce(DataFrame.withColumns, made, df)
    # the very first row visits the lowest range, after all of its rows; elsewhere ids order the guest last
    w = Window.partitionBy("__range").orderBy(F.col("__guest").asc(), F.col("__key").desc(), F.col("__hash").asc(), F.col(text_col))
    df = df.withColumn("__next", F.lead(F.struct(*cols)).over(w)).where("NOT __guest")
    return df.select("*", *[F.col(f"__next.{c}").alias(n) for c, n in cols.items()]).drop("__key", "__hash", "__range", "__guest", "__next")


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, anchors)``: all anchors of every whole text."""
    return df.select(F.col(id_col).alias("doc_id"), anchors_of(F.coalesce(F.col(text_col), F.lit(""))).alias("anchors"))


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are.

    The edited text has the last half of the code points replaced by the first
    as many of the next document, by descending id.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = [{"anchors": anchors_of(F.col("text"))}, {"own": hashes(F.col("anchors"))}]
    docs = with_next(docs, "doc_id", "text", made, {"text": "next_text", "anchors": "next_anchors", "own": "of_next"})
    docs = docs.withColumn("n_chars", F.char_length("text"))
    docs = docs.withColumn("half", F.floor(F.col("n_chars") / 2).cast("int")).withColumn("stays", F.col("n_chars") - F.col("half"))
    docs = docs.withColumn("head", F.substring("text", F.lit(1), F.col("stays"))).withColumn("tail", F.substring("next_text", F.lit(1), F.col("half")))
    edited = F.concat("head", "tail")
    left = F.least(F.col("stays"), F.lit(K - 1))
    seam = F.concat(F.when(left > 0, F.substring("head", -left, left)).otherwise(""), F.substring("tail", 1, K - 1))
    whole = spliced(F.col("anchors"), F.col("stays"), F.col("next_anchors"), F.char_length("tail"), seam)
    docs = docs.withColumn("edited", edited)
    wide = (F.char_length("edited") >= WIDE) & (F.char_length("next_text") >= WIDE)
    docs = docs.withColumn("edited_anchors", F.when(wide, whole).otherwise(anchors_of(F.col("edited"))))
    docs = docs.withColumns({"of_edited": hashes(F.col("edited_anchors"))})
    return docs.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("anchors")).alias("fingerprint"), text_of(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"), likeness(F.col("own"), F.col("of_next")).alias("near_next"),
    )
