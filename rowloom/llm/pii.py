"""Personal data: pattern spans, and terms that give them away, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone
numbers.  Patterns use possessive runs and look-behinds, which find the same
leftmost matches as the plain forms but in time linear in the text.

The method adds terms by information-theoretic sanitisation.  What is protected
is each entity (the value of a base span) and each kind; a term (a run of three
or more letters, lower-cased) co-occurs with an entity if it stands within
``CONTEXT`` code points of it, and with a kind if it stands in the same text.
For a term t and a protected x, PMI(t; x) = log p(x|t) / p(x) is compared with
the information of x itself, -log p(x): their ratio is the disclosure, 1 if the
term always announces x.  p counts rows of the whole corpus, on both sides
alike, so repeating every row changes next to nothing; the evidence must come from
``SUPPORT`` different texts, for a kind also from as many entities.  A term with
a disclosure of ``DISCLOSURE`` or more that leaves at most one bit open, p(x|t)
of ``CERTAINTY`` or more, is marked wherever it stands in the corpus; without
the second condition rarer and rarer hints would do as the corpus grows.  It is generalised to its first ``PREFIX`` letters if these, taken
together over all terms that begin so, stay below the threshold, else removed.

Null texts count as empty; empty texts have no spans; a text of any length takes
time linear in it and its spans; spans that begin together follow by kind, and
of overlapping spans the first names the replacement; repeated rows get equal
spans, and rows are told apart by id and text, so ids may repeat or be null; an
empty table gives an empty result; columns other than id and text are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

KINDS = ("email", "ip", "card", "phone", "term")
_TERM = KINDS.index("term")
_L = "A-Za-z0-9._%+-"
#: Equivalents of the contract's patterns without backtracking over long runs.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CONTEXT = 160
TERM = r"\p{L}{3,}"
SUPPORT = 3
DISCLOSURE = 0.9
CERTAINTY = 0.5
FEW = 64
PREFIX = 3
#: Accepted terms are broadcast up to this many, and code points in all; beyond, Spark shuffles the join.
BROADCAST_TERMS, BROADCAST_CHARS = 200_000, 4_000_000
#: Elements of a running total handled at once.
BLOCK = 256
_SPAN = "struct<s:int,k:int,e:int,entity:string,near:array<string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Exclusive running totals of an int array under an associative ``op`` with unit 0, block by block."""
    def scan(x: Column, first: Column, get: Callable[[Column], Column]) -> Column:
        return F.aggregate(x, F.array(first), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), get(v)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    inner = F.transform(blocks, lambda x: scan(x, F.lit(0), lambda v: v))
    each = let(inner, lambda parts: let(
        scan(parts, F.lit(0), lambda part: F.element_at(part, -1)),
        lambda bases: F.flatten(F.transform(parts, lambda part, b: F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda v: op(F.get(bases, b), v)))),
    ))
    return F.when(F.size(values) > 0, each).otherwise(F.array().cast("array<int>"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind in ("card", "phone"):
        digits = F.regexp_replace(m, "[^0-9]+", "")
        if kind == "phone":
            return F.length(digits).between(10, 15)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.lit(True)


def located(text: Column, pattern: str, one: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    """``one(match, start, end, text before, text after)`` of each match, in order; null if there is none."""
    def spread(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: F.char_length(m) + F.char_length(F.get(x["p"], i)))

        def at(m: Column, i: Column, starts: Column) -> Column:
            before = F.get(x["p"], i)
            s = F.get(starts, i) + F.char_length(before)
            return one(m, s, s + F.char_length(m), before, F.get(x["p"], i + 1))

        return let(running(lengths, lambda a, b: a + b), lambda starts: F.transform(x["m"], lambda m, i: at(m, i, starts)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p")), spread)))


def terms_of(text: Column) -> Column:
    """Distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def _around(before: Column, after: Column) -> Column:
    """Terms beside a span; a word that the context's end may cut is left out."""
    left = F.when(F.char_length(before) > CONTEXT, F.regexp_replace(F.substring(before, -CONTEXT, CONTEXT), r"^\p{L}+", "")).otherwise(before)
    right = F.when(F.char_length(after) > CONTEXT, F.regexp_replace(F.substring(after, 1, CONTEXT), r"\p{L}+$", "")).otherwise(after)
    return terms_of(F.concat(left, F.lit(" "), right))


def _spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind, none as an empty array."""
    def one(m: Column, s: Column, e: Column, before: Column, after: Column) -> Column:
        plain = F.lower(m) if kind in ("email", "ip") else F.regexp_replace(m, "[^0-9]+", "")
        made = F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), e.alias("e"), plain.alias("entity"), _around(before, after).alias("near"))
        return F.when(_valid(kind, m), made)

    found = F.array_compact(located(text, PATTERNS[kind], one))
    if NEEDS[kind]:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found)
    return F.coalesce(found, F.array().cast(f"array<{_SPAN}>"))


def base_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, text_hash, spans, terms)``: valid base spans of every whole text, by start then kind.

    ``terms`` are the distinct terms outside the spans, of texts that have any; ``row`` numbers the rows of this plan.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = F.concat(*[_spans(F.col("text"), kind) for kind in PATTERNS])
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", every.alias("spans"))
    in_order = F.array_sort("spans", lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))
    blank = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(" ").alias("general")))
    rows = rows.select("row", "doc_id", "text", in_order.alias("spans"))
    own = F.when(F.size("spans") > 0, terms_of(sanitise(F.col("text"), blank)))
    return rows.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "spans", own.alias("terms"))


def co_occurrences(base: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``(k, entity, term, n, n_x)``: rows in which a term co-occurs with a protected value, and rows that hold this.

    ``entity`` is null where the kind itself is protected.  Only pairs with enough evidence.
    """
    some = base.where(F.size("spans") > 0)
    near = some.select("row", "text_hash", F.explode("spans").alias("x"))
    near = near.select("row", "text_hash", "x.k", "x.entity", "x.near")
    by_entity = near.groupBy("k", "entity").agg(F.count_distinct("row").alias("n_x"))
    with_term = near.select("row", "text_hash", "k", "entity", F.explode("near").alias("term")).distinct()
    with_term = with_term.groupBy("k", "entity", "term").agg(F.count("*").alias("n"), F.count_distinct("text_hash").alias("texts"))
    entities = with_term.where(F.col("texts") >= support).join(by_entity, ["k", "entity"]).select("k", "entity", "term", "n", "n_x")
    # one entity stands for those of a kind in a row
    kinds = near.groupBy("row", "k").agg(F.min("entity").alias("least"))
    by_kind = kinds.groupBy("k").agg(F.count("*").alias("n_x"))
    own = some.select("row", F.explode("terms").alias("term"))
    of_kind = own.join(kinds, "row").groupBy("k", "term").agg(F.count("*").alias("n"), F.count_distinct("least").alias("entities"))
    of_kind = of_kind.where(F.col("entities") >= support).join(by_kind, "k")
    return entities.unionByName(of_kind.select("k", F.lit(None).cast("string").alias("entity"), "term", "n", "n_x"))


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, total)``: rows that hold each term."""
    return df.select(F.explode(terms_of(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("total"))


def disclosure(n: Column, total: Column, n_x: Column, rows: int) -> Column:
    """PMI of a term and a protected value over the value's own information; 0 if p(x|t) is below ``CERTAINTY``.

    p(x|t) is estimated as if one more row held the term without the value, so
    that a term of a few rows must stand beside the value in all of them.
    """
    p, given = n_x / F.lit(float(max(rows, 1))), F.least(n / (total + 1), F.lit(1.0))
    return F.when((p < 1) & (given >= CERTAINTY), F.log(given / p) / -F.log(p)).otherwise(0.0)


def revealing_terms(pairs: DataFrame, counts: DataFrame, rows: int, least: float = DISCLOSURE) -> DataFrame:
    """``(term, general)``: the terms to mark, and the form that may stay of each, null if none may.

    Only tables of accepted terms and their prefixes are joined by prefix, so a prefix of many terms is no hot key.
    """
    judged = pairs.join(counts, "term").withColumn("d", disclosure(F.col("n"), F.col("total"), F.col("n_x"), rows))
    prefix = F.substring("term", 1, PREFIX).alias("prefix_term")
    wide = cut(judged.where(F.col("d") >= least).select("term").distinct().select("term", prefix))
    asked = _small(wide.select("prefix_term").distinct())
    totals = cut(counts.select(prefix, "total").join(asked, "prefix_term", "left_semi").groupBy("prefix_term").agg(F.sum("total").alias("total")))
    of_prefix = pairs.select("k", "entity", prefix, "n", "n_x").join(asked, "prefix_term", "left_semi")
    of_prefix = of_prefix.groupBy("k", "entity", "prefix_term", "n_x").agg(F.sum("n").alias("n")).join(_small(totals), "prefix_term")
    worst = of_prefix.groupBy("prefix_term").agg(F.max(disclosure(F.col("n"), F.col("total"), F.col("n_x"), rows)).alias("d"))
    return wide.join(worst, "prefix_term").select("term", F.when(F.col("d") < least, F.concat("prefix_term", F.lit("*"))).alias("general"))


def mark_terms(df: DataFrame, accepted: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """``(doc_id, text_hash, marked)``: every occurrence of an accepted term, of the rows that have any.

    Positions are worked out only for texts that hold such a term.  A text's
    terms are looked up in place among ``few`` marked ones; where there are more,
    they are joined, so that no text takes time quadratic in it.
    """
    def one(m: Column, s: Column, e: Column, before: Column, after: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), F.lower(m).alias("term"))

    def span(x: Column, general: Column) -> Column:
        return F.struct(x["s"].alias("s"), F.lit(_TERM).alias("k"), x["e"].alias("e"), general.alias("general"))

    def in_place(at: Column, held: Column) -> Column:
        return let(F.map_from_entries(held), lambda m: F.transform(F.filter(at, lambda x: F.map_contains_key(m, x["term"])), lambda x: span(x, F.element_at(m, x["term"]))))

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    held = rows.select("doc_id", "text_hash", F.explode(terms_of(F.col("text"))).alias("term")).join(_small(accepted), "term")
    held = held.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("term", "general")).alias("held"))
    held = cut(held.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))

    def hits(own: DataFrame) -> DataFrame:
        found = rows.join(small(own, F.size("held")), same).dropDuplicates(["doc_id", "text_hash"])
        return found.select("doc_id", "text_hash", "held", located(F.col("text"), TERM, one).alias("at"))

    marked = hits(held.where(F.size("held") <= few)).select("doc_id", "text_hash", in_place(F.col("at"), F.col("held")).alias("marked"))
    if held.where(F.size("held") > few).isEmpty():
        return marked
    at = hits(held.where(F.size("held") > few)).select("doc_id", "text_hash", F.inline("at"))
    listed = held.where(F.size("held") > few).select("__id", "__hash", F.inline("held")).withColumnRenamed("term", "__term")
    joined_ = at.join(listed, same & (F.col("term") == F.col("__term")))
    spans = F.collect_set(F.struct("s", F.lit(_TERM).alias("k"), "e", "general")).alias("marked")
    return marked.unionByName(joined_.groupBy("doc_id", "text_hash").agg(spans))


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is counted and found small; else Spark shuffles the join."""
    n, chars = df.agg(F.count("*"), F.sum(F.char_length([c for c in df.columns if c.endswith("term")][0]))).first()
    return F.broadcast(df) if n <= BROADCAST_TERMS and (chars or 0) <= BROADCAST_CHARS else df


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, least: float = DISCLOSURE) -> DataFrame:
    """``(doc_id, text_hash, spans)``: all spans struct(s, k, e, general) of every row, by start then kind."""
    base = cut(base_spans(df, id_col, text_col))
    plain = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(None).cast("string").alias("general")))
    none = base.select("doc_id", "text_hash", plain.alias("spans"))
    pairs = cut(co_occurrences(base, support))
    if pairs.isEmpty():
        return none
    accepted = cut(revealing_terms(pairs, cut(term_counts(df, text_col)), base.count(), least))
    if accepted.isEmpty():
        return none
    marked = mark_terms(df, accepted, id_col, text_col).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    both = none.join(marked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    every = F.sort_array(F.concat("spans", "marked"))
    return both.select("doc_id", "text_hash", F.when(F.col("marked").isNotNull(), every).otherwise(F.col("spans")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans and list of all spans."""
    spans = F.col("spans")

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    base = F.filter(spans, lambda x: x["k"] < _TERM)
    return found.select("doc_id", *counts[:-1], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), counts[-1])


def sanitise(text: Column, spans: Column) -> Column:
    """Text with every base span generalised to its kind, and every marked term generalised or replaced by ``<TERM>``.

    What overlapping spans cover goes as one, under the first's name.  The text
    is cut once a block of spans, not once a span, so that long texts take linear time.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(chunk: Column, start: Column, x: Column) -> Column:
        put = F.coalesce(x["general"], F.get(names, x["k"]))
        return F.when(x["s"] >= x["at"], F.concat(F.substring(chunk, x["at"] - start + 1, x["s"] - x["at"]), put)).otherwise("")

    def block(x: Column) -> Column:
        start = F.get(x, F.lit(0))["at"]
        chunk = F.substring(text, start + 1, F.greatest(F.element_at(x, -1)["s"] - start, F.lit(0)))
        return let(chunk, lambda c: F.array_join(F.transform(x, lambda y: piece(c, start, y)), ""))

    def whole(cuts: Column) -> Column:
        last = F.element_at(cuts, -1)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / BLOCK).cast("int")), lambda b: F.slice(cuts, b * BLOCK + 1, F.lit(BLOCK)))
        end = F.greatest(last["at"], last["e"])
        return F.concat(F.array_join(F.transform(blocks, lambda x: let(x, block)), ""), F.substring(text, end + 1, F.char_length(text)))

    def cuts(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: y["e"]), F.greatest)
        return let(ends, lambda at: F.transform(x, lambda y, i: F.struct(F.get(at, i).alias("at"), y["s"].alias("s"), y["k"].alias("k"), y["e"].alias("e"), y["general"].alias("general"))))

    return F.when(F.size(spans) > 0, let(spans, lambda x: let(cuts(x), whole))).otherwise(text)
