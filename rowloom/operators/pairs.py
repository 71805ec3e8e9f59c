"""Pair quality control: treatment and control nonzero-cell counts.

``entries(feature_idx, cell_idx)`` are stored response entries; memberships are
tables keyed by cell, not de-duplicated (a cell listed twice counts twice):
``groups(group_id, cell_idx)``, ``controls(nt_id, cell_idx)``.  Counting is an
equi-join on the cell followed by a partial and a final count, so no order of
pairs or features is needed.  ``by_position`` turns position lists into cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dealing import deal


def by_position(members: DataFrame, cells_in_use: DataFrame) -> DataFrame:
    """Replace 1-based ``pos`` into ``cells_in_use(pos, cell_idx)`` by the cell."""
    return members.join(cells_in_use.select("pos", "cell_idx"), "pos").drop("pos")


def redirect(members: DataFrame, all_nt: DataFrame) -> DataFrame:
    """Replace 1-based ``nt_pos`` into ``all_nt(nt_pos, pos)`` by the position in the cells in use."""
    return members.join(all_nt.select("nt_pos", "pos"), "nt_pos").drop("nt_pos")


def nonzero(entries: DataFrame, cells_in_use: DataFrame) -> DataFrame:
    """``(feature_idx, cell_idx)`` of the entries in cells in use."""
    return entries.select("feature_idx", "cell_idx").join(cells_in_use.select("cell_idx"), "cell_idx", "left_semi")


def nonzero_matrix(y: DataFrame, controls: DataFrame, features: DataFrame, control_ids: DataFrame, sums: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """``(nt_id, feature_idx, n_nonzero)`` for every control guide and feature, zeros included.

    The result itself is the dense grid of both small dimensions.  It is neither
    shuffled nor sorted: only nonzero counts are, by feature, and each feature
    then gets its row of the grid in place.  ``sums(feature_idx, n_nonzero_tot)``
    adds that column.  ``n`` is the number of tasks.
    """
    control = controls.select("nt_id", "cell_idx").where("nt_id is not null")
    rows = y.where("feature_idx is not null").join(control, "cell_idx").join(control_ids.select("nt_id").distinct(), "nt_id", "left_semi")
    kind = "feature_idx int, nt_id int, asked int, n_nonzero_tot long"
    parts = [rows.withColumn("asked", F.lit(0)), features.select("feature_idx").withColumn("asked", F.lit(1))]
    if sums is not None:
        parts.append(sums.select("feature_idx", "n_nonzero_tot").distinct().withColumn("asked", F.lit(0)))
    names = [c.split() for c in kind.split(", ")]
    parts = [x.select(*[(F.col(c) if c in x.columns else F.lit(None)).cast(t).alias(c) for c, t in names]) for x in parts]
    dealt = reduce(DataFrame.unionByName, parts).repartition(n or y.sparkSession.sparkContext.defaultParallelism, "feature_idx")
    tot = F.max("n_nonzero_tot").alias("n_nonzero_tot")
    counts = dealt.groupBy("feature_idx", "nt_id").agg(F.count("*").alias("n"), F.sum("asked").alias("asked"), tot)
    own = F.collect_list(F.when(F.col("nt_id").isNotNull(), F.struct("nt_id", "n")))
    per = counts.groupBy("feature_idx").agg(own.alias("of"), F.sum("asked").cast("int").alias("asked"), tot)
    per = per.select("feature_idx", "of", "n_nonzero_tot", F.explode(F.expr("array_repeat(0, asked)")))
    # one row: all guides, and those listed more than once as often again
    ids = control_ids.groupBy("nt_id").agg((F.count("*") - 1).cast("int").alias("more")).agg(F.collect_list(F.struct("nt_id", "more")).alias("s"))
    ids = ids.select(F.col("s.nt_id").alias("ids"), F.flatten(F.transform("s", lambda g: F.array_repeat(g["nt_id"], g["more"]))).alias("again"))
    per = per.crossJoin(F.broadcast(ids)).select("feature_idx", "n_nonzero_tot", "ids", "again", F.col("of.nt_id").alias("has"), F.col("of.n").alias("n"))
    every = F.concat("has", F.array_except("ids", "has"), "again")
    grid = per.select("feature_idx", "n_nonzero_tot", "has", "n", F.size("ids").alias("k"), F.posexplode_outer(every).alias("pos", "nt_id")).where("pos is not null")
    at = F.when(F.col("pos") < F.col("k"), F.col("pos")).otherwise(F.array_position("has", F.col("nt_id")).cast("int") - 1)
    got = F.coalesce(F.get("n", at), F.lit(0)).cast("long").alias("n_nonzero")
    return grid.select("nt_id", "feature_idx", got, *(["n_nonzero_tot"] if sums is not None else []))


def totals(y: DataFrame, features: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """``(feature_idx, n_nonzero_tot)``: over the control lists, or over all cells in use.

    A cell in two control lists counts twice; pass the list of all control cells
    to count each of its entries once.
    """
    rows = y if controls is None else y.join(controls.select("cell_idx"), "cell_idx")
    got = rows.groupBy("feature_idx").agg(F.count("*").alias("n"))
    return features.select("feature_idx").join(got, "feature_idx", "left").select("feature_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n_nonzero_tot"))


#: Group that stands for the control.
CONTROL = -1


def members_of(groups: DataFrame, controls: DataFrame | None) -> DataFrame:
    """``(cell_idx, of)``: the groups of each cell, as structs (group_id, times); the control is group ``CONTROL``."""
    rows = groups.select("group_id", "cell_idx")
    if controls is not None:
        rows = rows.unionByName(controls.select(F.lit(CONTROL).alias("group_id"), "cell_idx"))
    return lists_of(rows.groupBy("cell_idx", "group_id").agg(F.count("*").alias("times")))


def lists_of(members: DataFrame) -> DataFrame:
    """``(cell_idx, of)`` from ``(cell_idx, group_id, times)``; a cell's list is at most as long as there are groups."""
    one = F.struct(F.col("group_id").cast("int").alias("group_id"), F.col("times").cast("long").alias("times"))
    return members.groupBy("cell_idx").agg(F.collect_list(one).alias("of"))


def pair_counts(y: DataFrame, groups: DataFrame, pairs: DataFrame, controls: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """``(feature_idx, group_id, n_nonzero_trt, n_nonzero_cntrl)`` of each pair.

    With ``controls`` the control count is the total over those cells, treated
    cells not removed; without, it is the complement of the treatment group.
    """
    return count_pairs(y, members_of(groups, controls), pairs, complement=controls is None, n=n)


def count_pairs(y: DataFrame, members: DataFrame, pairs: DataFrame, complement: bool, n: int | None = None) -> DataFrame:
    """The same from the list of groups of each cell (see ``members_of``).

    Entries are joined once, by cell, and counted once, by (feature, group); in
    the complement every entry also counts for the control.  Pairs and counts
    then meet in one exchange by feature.  Given a number of tasks ``n``, both
    exchanges have as many; otherwise counts are summed in part beforehand.
    """
    needed = y.join(pairs.select("feature_idx").distinct(), "feature_idx", "left_semi")
    of = F.col("of")
    if complement:
        whole = F.array(F.struct(F.lit(CONTROL).alias("group_id"), F.lit(1).cast("long").alias("times")))
        of = F.concat(whole, F.coalesce(of, F.array().cast("array<struct<group_id:int,times:bigint>>")))
    rows = needed.join(members, "cell_idx", "left" if complement else "inner").select("feature_idx", F.inline(of))
    rows = deal(rows, n, "feature_idx", "group_id") if n else rows
    counts = rows.groupBy("feature_idx", "group_id").agg(F.sum("times").alias("n")).withColumn("asked", F.lit(False))
    both = counts.unionByName(pairs.select(F.col("feature_idx").cast("int"), F.col("group_id").cast("int"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    by_feature = Window.partitionBy("feature_idx")
    total = F.sum(F.when((F.col("group_id") == CONTROL) & ~F.col("asked"), F.col("n"))).over(by_feature.orderBy("group_id").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = F.sum("n").over(Window.partitionBy("feature_idx", "group_id"))
    got = deal(both, n, "feature_idx").withColumn("tot", F.coalesce(total, F.lit(0))).withColumn("n_nonzero_trt", own).where("asked")
    control = F.col("tot") - F.col("n_nonzero_trt") if complement else F.col("tot")
    return got.select("feature_idx", "group_id", "n_nonzero_trt", control.alias("n_nonzero_cntrl"))


@dataclass(frozen=True)
class PairQC:
    """Counts of nonzero cells: ``matrix(nt_id, feature_idx, n_nonzero)``, ``totals(feature_idx, n_nonzero_tot)``,
    ``pairs(feature_idx, group_id, n_nonzero_trt, n_nonzero_cntrl)``, and ``matrix_and_totals``: the matrix with
    ``n_nonzero_tot`` beside each count, cheaper than a join of the two."""

    matrix: DataFrame
    totals: DataFrame
    pairs: DataFrame
    matrix_and_totals: DataFrame


def pair_qc(entries: DataFrame, features: DataFrame, cells_in_use: DataFrame, groups: DataFrame, controls: DataFrame, pairs: DataFrame, all_controls: DataFrame | None = None, n: int | None = None) -> PairQC:
    """All counts from position lists; see ``ExpressionMatrix.pair_qc``.

    The total of a feature is the sum over the control guides' lists, or with
    the complement as the control its number of nonzero cells in use.  ``n`` is
    the number of tasks that entries are dealt to.
    """
    y = nonzero(deal(entries.select("feature_idx", "cell_idx"), n, "cell_idx") if n else entries, cells_in_use)
    treated = by_position(groups, cells_in_use)
    listed = by_position(controls if all_controls is None else redirect(controls, all_controls), cells_in_use)
    control = None if all_controls is None else listed
    ids = controls.select("nt_id").distinct()
    sums = totals(y, features, control)
    return PairQC(nonzero_matrix(y, listed, features, ids, n=n), sums, pair_counts(y, treated, pairs, control, n), nonzero_matrix(y, listed, features, ids, sums, n))
