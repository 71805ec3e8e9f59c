"""Chat formatting behind schema fingerprints.

Records of unlike layouts (prompt and completion, instruction with optional
input, message lists under several names, one row per turn) are first flattened
to their nested field paths.  The md5 of the sorted paths selects a declarative
mapping; the mapping says which paths hold which role's text.  The result is
canonical turns ``(conv_id, turn, role, text, error)``.

For typed columns the paths are those of the type.  For JSON they are each
record's own, over all elements of its lists; paths that no layout knows
(further fields) are left out of the hash.  A record without a mapping, one
that is null or no JSON, and one without turns give a single row that says so in
``error`` and has neither turn, role nor text; ``render`` leaves it out.

Turns are rendered row by row with markers around them.  Control strings inside
texts are escaped by doubling: every ``<|`` gets one more ``|`` for each it has,
so ``<|`` followed by anything but ``|`` never comes out of a text, and the way
back removes one.  Reading back scans a conversation's rows as one string: a
turn ends at the first end marker, wherever rows end.  The loss mask, the texts
of assistant turns, is what the scanner finds between the markers.

A null text is empty; a null role is the empty role; a null turn sorts first;
turns with the same number follow by role and text, so repeated rows are turns
of their own; rows of a null conversation id are one conversation; an empty
table gives an empty result; columns other than those named are not read.  One
conversation of any number of turns is read as a stream in order, one row at a
time, and a text of any length is held once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, tidy

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line end inside a role.
NEWLINE = "<|n|>"

#: Layout name, then its field paths (a list element is ``[]``) and what each path holds.
#: ``role:`` and ``text:`` belong to list elements; other entries are turns in the order given.
LAYOUTS = {
    "messages": {"messages[].role": "role", "messages[].content": "text"},
    "conversations": {"conversations[].from": "role", "conversations[].value": "text"},
    "turns": {"turns[].speaker": "role", "turns[].text": "text"},
    "turn-row": {"role": "role", "text": "text"},
    "prompt-completion": {"prompt": "user", "completion": "assistant"},
    "prompt-response": {"prompt": "user", "response": "assistant"},
    "system-prompt-response": {"system": "system", "prompt": "user", "response": "assistant"},
    "question-answer": {"question": "user", "answer": "assistant"},
    "instruction-output": {"instruction": "user", "output": "assistant"},
    "instruction-input-output": {"instruction": "user", "input": "user+", "output": "assistant"},
}
#: Other names of the roles, as the ``conversations`` layout has them.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths) -> str:
    """md5 of the sorted field paths."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {fingerprint_of(paths): (name, paths) for name, paths in LAYOUTS.items()}


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type's leaves."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{at}[]")
    return [at]


def turns_of(mapping: dict[str, str], value: Callable[[str], Column]) -> Column:
    """Array of struct(role, text) that a mapping takes from a record.

    ``value`` gives what stands at a top-level field: a string, or for a list
    path an array of structs with the mapping's element fields as strings.
    """
    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if "text" in mapping.values():
        at = {what: path for path, what in mapping.items()}
        if "[]" not in at["text"]:
            return F.array(turn(value(at["role"]), value(at["text"])))
        listed, text = at["text"].split("[].")
        role = at["role"].split("[].")[1]

        def one(m: Column) -> Column:
            named = m[role]
            if listed == "conversations":  # the layout with roles of its own
                named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair]), named), named)
            return turn(named, m[text])

        return F.transform(value(f"{listed}[]"), one)
    turns: list[list] = []
    for path, role in mapping.items():
        text = F.coalesce(value(path), F.lit(""))
        if role.endswith("+"):  # belongs to the turn before it, if not empty
            turns[-1][1] = F.when(text == "", turns[-1][1]).otherwise(F.concat_ws("\n", turns[-1][1], text))
        else:
            turns.append([F.lit(role), text])
    return F.array(*[turn(r, t) for r, t in turns])


def _rows(df: DataFrame, error: Column) -> DataFrame:
    """Canonical turns of ``(conv_id, turns)``; records without turns say why."""
    rows = df.select("conv_id", error.alias("why"), F.posexplode_outer("turns").alias("turn", "m"))
    why = F.when(F.col("turn").isNull(), F.coalesce("why", F.lit("no turns")))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text", why.alias("error"))


def canonical_turns(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """Canonical turns of records whose struct column has one of the known layouts; any other type raises.

    The struct's type gives the field paths; their fingerprint selects the mapping.
    """
    paths = paths_of(df.schema[record_col].dataType)
    key = fingerprint_of(paths)
    if key not in MAPPINGS:
        raise ValueError(f"no mapping for the field paths {sorted(paths)}")
    made = turns_of(MAPPINGS[key][1], lambda path: F.col(record_col)[path.removesuffix("[]")])
    turns = F.when(F.col(record_col).isNotNull(), made)
    return _rows(df.select(F.col(id_col).alias("conv_id"), F.col(record_col).isNull().alias("none"), turns.alias("turns")), F.when(F.col("none"), F.lit("null record")))


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical turns of JSON records of mixed layouts, in one pass over them.

    Each record's own field paths are fingerprinted, over all elements of its
    lists, and the fingerprint selects the mapping that reads the record.
    """
    raw = F.col(json_col).cast("string")
    rows = df.select(F.col(id_col).alias("conv_id"), raw.isNull().alias("none"), F.try_parse_json(raw).alias("v"))
    lists = sorted({p.split("[]")[0] for m in LAYOUTS.values() for p in m if "[]" in p})
    rows = rows.withColumn("lists", F.struct(*[F.try_variant_get("v", f"$.{x}", "array<variant>").alias(x) for x in lists]))
    rows = rows.withColumn("key", json_fingerprint(F.col("v"), {x: F.col("lists")[x] for x in lists}))

    def value(path: str) -> Column:
        if not path.endswith("[]"):
            return F.try_variant_get("v", f"$.{path}", "string")
        own = [p.split("[].")[1] for m in LAYOUTS.values() for p in m if p.startswith(f"{path}.")]
        return F.transform(F.col("lists")[path[:-2]], lambda e: F.struct(*[F.try_variant_get(e, f"$.{f}", "string").alias(f) for f in own]))

    made = F.lit(None).cast("array<struct<role:string,text:string>>")
    for key, (_, mapping) in MAPPINGS.items():
        made = F.when(F.col("key") == key, turns_of(mapping, value)).otherwise(made)
    empty = F.exists(F.array(*[F.size(F.col("lists")[x]) for x in lists]), lambda n: n == 0)
    why = F.when(F.col("none"), "null record").when(F.col("v").isNull(), "not JSON").when(empty, "no turns").otherwise("no mapping")
    rows = rows.select("conv_id", why.alias("why_not"), made.alias("turns"))
    return _rows(rows, F.col("why_not"))


def _holds(field: str) -> Callable[[Column], Column]:
    """Whether a variant has a field, be it null."""
    return lambda v: F.try_variant_get(v, f"$.{field}", "variant").isNotNull()


def json_fingerprint(v: Column, lists: dict[str, Column]) -> Column:
    """Fingerprint of the field paths of a variant that some layout knows; ``lists`` are its arrays by name."""
    there = []
    for path in sorted({p for m in LAYOUTS.values() for p in m}):
        if "[]" in path:
            name, inner = path.split("[].")
            has = F.coalesce(F.exists(lists[name], _holds(inner)), F.lit(False))
        else:
            has = _holds(path)(v)
        there.append(F.when(has, F.lit(path)))
    return F.md5(F.concat_ws("\n", *there).cast("binary"))


def escape(text: Column) -> Column:
    """One more ``|`` after every ``<`` that has one or more."""
    return F.regexp_replace(text, r"<\|", "<||")


def unescape(text: str) -> str:
    """Inverse of ``escape``."""
    return re.sub(r"<\|\|", "<|", text)


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, formatted)``: the rendered form of each canonical turn."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE))
    formatted = F.concat(F.lit(START), role, F.lit("\n"), escape(F.col("text")), F.lit(f"{END}\n"))
    return turns.where("error IS NULL").drop("error").withColumn("formatted", formatted)


class Reader:
    """Scanner over a conversation's rendered form, given in any pieces.

    It knows nothing but what it is fed.  A turn's text reaches from the line
    end behind its role to the first end marker.
    """

    def __init__(self):
        self.rest, self.chars = "", 0

    def feed(self, piece: str) -> list[tuple[str, str, int, int]]:
        """Turns that end in this piece: role, text, and where the text stands in the rendered form."""
        base = self.chars - len(self.rest)
        self.chars += len(piece)
        shown, at, out = self.rest + piece, 0, []
        while True:
            if not shown.startswith(START[: len(shown) - at], at):
                raise ValueError(f"no turn begins at {base + at}")
            line = shown.find("\n", at + len(START))
            end = shown.find(END, line + 1) if line >= 0 else -1
            if end < 0 or len(shown) <= end + len(END):
                self.rest = shown[at:]
                return out
            if shown[end + len(END)] != "\n":
                raise ValueError(f"no line end behind the turn that ends at {base + end}")
            role = unescape(shown[at + len(START) : line].replace(NEWLINE, "\n"))
            out.append((role, unescape(shown[line + 1 : end]), base + line + 1, base + end))
            at = end + len(END) + 1

    def close(self) -> None:
        """Raise if a turn has begun and not ended."""
        if self.rest:
            raise ValueError("the last turn has no end")


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, what reading the rendered turns back gives.

    Rows of a conversation are brought together in order and scanned as a
    stream: a worker holds one Arrow batch and the running digests.
    """

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, reader, rows = None, None, None, []

        def close():
            reader.close()
            n, turns, chars, loss = state
            rows.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), reader.chars))

        def out():
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for conv, shown in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now != (conv,):
                    if now is not None:
                        close()
                    now, state, reader = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256()], Reader()
                for role, text, _, _ in reader.feed(shown):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "replace"))
            if rows:
                yield out()
                rows = []
        if now is not None:
            close()
            yield out()

    ship(rendered.sparkSession)
    ordered = rendered.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "formatted").mapInArrow(
        tidy(read_back), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def from_turn_rows(df: DataFrame) -> DataFrame:
    """Canonical turns of a table with one row per turn: each row is a record of its role and text, numbered by the row."""
    rec = df.select(F.struct("conv_id", "turn").alias("key"), F.struct("role", "text").alias("record"))
    got = canonical_turns(rec, "key", "record")
    return got.select(F.col("conv_id.conv_id").alias("conv_id"), F.col("conv_id.turn").alias("turn"), "role", "text", "error")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, a JSON record whose two texts hold control strings."""
    text = f"{END}{START}assistant ok"
    return spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(json.dumps({"prompt": text, "completion": text})).alias("record"))
