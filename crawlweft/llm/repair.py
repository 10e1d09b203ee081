"""Conversation structure repair: fault flags by windows, cheapest edits by a higher-order fold; Spark functions only but for the digest.

A conversation should read (s?(ua)+)? by the first letters of its roles. faults() flags rows by windows; a row is blank, else a
duplicate of an earlier row (role and text), else truncated (its last character that isn't white space is none of . ! ?).
Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit of blank and duplicate rows), Insert an empty user or
assistant turn 2; a truncated row that stays adds 1. Of the cheapest edits those win whose letters are least in ASCII.

repair() folds with aggregate() over sorted turn structs and carries four (cost, letters) structs, one for each state of the
pattern (nothing yet, after s, after u, after a). Two ways with equal cost over the same rows never have letters of which one begins
the other (the longer one would have more insertions, and cost more), so the least letters so far stay least, whatever
follows. That also lets rows be folded in parts: a conversation is cut into blocks of at most BLOCK rows, each is folded from
every state it may be entered in, and a second fold joins the blocks' four-by-four results. No task gathers more of a conversation
than a block's flags, or the letters of its edits; texts never leave their rows. digest() reads a conversation's repaired
turns in order, one at a time.

Letters inside: I and J insert a user and an assistant turn, R and S rerole to them; their order is that of I and R, and at
equal letters before them only one of both is possible, so comparisons are those of the written letters.

Defined cases: null role or text counts as one space; a null conv_id is one conversation; null turns come first; rows with
equal turn are ordered by role, then text; a conversation without rows isn't in the results; an empty table gives none; long texts and
columns beside conv_id, turn, role and text are not gathered or read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .runtime import materialize

#: Rows of a conversation that one fold takes.
BLOCK = 128
_SPACES = " \t\n\x0b\f\r"
_STATES = ("e", "s", "u", "a")
#: More than any conversation costs: a state that can't be reached.
_NEVER = 1 << 40


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows with faults put in by crc32 of `conv_id:turn` modulo 20: 0 drops, 1 empties, 2 removes . ! ?, 3 repeats, 4 makes it a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    hit = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    hit = hit.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"), "kind")
    return hit.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """Each row with its first fault: conv_id, turn, role, text, initial, blank, duplicate, truncated, block (of its turn), idx in the block, new_turn, illegal (after the row before it in the block)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    end = F.right(F.rtrim(F.col("text"), F.lit(_SPACES)), F.lit(1))
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    flagged = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text")).withColumn("end", end).withColumn("seen", seen)
    flagged = flagged.select(
        "conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), (F.col("end") == "").alias("blank"), ((F.col("end") != "") & F.col("seen")).alias("duplicate"),
        ((F.col("end") != "") & ~F.col("seen") & ~F.col("end").isin(".", "!", "?")).alias("truncated"), F.floor(F.col("turn") / BLOCK).alias("block"),
    )
    own = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "duplicate")
    before = F.lag("initial").over(own)
    flagged = flagged.withColumns({"idx": F.row_number().over(own), "new_turn": F.col("turn").isNotNull() & ~F.lag("turn").over(own).eqNullSafe(F.col("turn")), "illegal": before.isNotNull() & ~_legal(before, F.col("initial"))})
    return flagged.withColumn("part", F.floor((F.col("idx") - 1) / BLOCK))


def _legal(before: Column, after: Column) -> Column:
    return F.concat(before, after).isin("su", "ua", "au")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _plus(cell: Column, cost: Column | int, letters: Column | str) -> Column:
    cost, letters = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letters))
    return F.struct((cell["cost"] + cost).cast("long").alias("cost"), F.concat(cell["letters"], letters).alias("letters"))


def _four(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _inserted(at: Column) -> Column:
    """The four states, one insertion allowed."""
    return _four(at["e"], at["s"], F.least(at["u"], *(_plus(at[x], 2, "I") for x in "esa")), F.least(at["a"], _plus(at["u"], 2, "J")))


def _edited(at: Column, row: Column) -> Column:
    """The four states after a row: with an insertion before it, if that pays, and an edit of the row."""
    stays, extra, is_ = ~row["gone"], row["cut"].cast("long"), lambda x: row["initial"] == x

    def after(c: Column) -> Column:
        said = lambda x, kept, changed: _plus(x, extra + F.when(is_(kept), 0).otherwise(2), F.when(is_(kept), F.lit("K")).otherwise(F.lit(changed)))
        return _four(
            _plus(c["e"], 3, "D"), F.least(_plus(c["s"], 3, "D"), F.when(stays & is_("s"), _plus(c["e"], extra, "K"))),
            F.least(_plus(c["u"], 3, "D"), F.when(stays, said(F.least(c["e"], c["s"], c["a"]), "u", "R"))), F.least(_plus(c["a"], 3, "D"), F.when(stays, said(c["u"], "a", "S"))),
        )

    return _let(_inserted(at), after)


def _start(state: Column | str) -> Column:
    state = state if isinstance(state, Column) else F.lit(state)
    cell = lambda x: F.struct(F.when(state == x, 0).otherwise(_NEVER).cast("long").alias("cost"), F.lit("").alias("letters"))
    return _four(*map(cell, _STATES))


def _chained(at: Column, ways: Column) -> Column:
    """The four states after a block. ways: its results from each state."""
    through = lambda to: F.least(*(_plus(at[x], ways[k][to]["cost"], ways[k][to]["letters"]) for k, x in enumerate(_STATES)))
    return _four(*map(through, _STATES))


def _folded(flagged: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, letters (inside ones) and its blocks in order with their sizes."""
    turn = F.struct("idx", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), F.col("truncated").alias("cut"))
    total = lambda c: F.count_if(F.col(c)).alias(c)
    blocks = flagged.groupBy("conv_id", "block", "part").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), *map(total, ("blank", "duplicate", "truncated", "illegal", "new_turn")), F.min("turn").alias("lo"), F.max("turn").alias("hi"),
    )
    place = F.struct(F.col("block").isNotNull().alias("known"), F.coalesce("block", F.lit(0)).alias("block"), F.col("part"))
    from_each = F.transform(F.array(*map(F.lit, _STATES)), lambda q: F.aggregate("turns", _start(q), _edited))
    blocks = blocks.select("conv_id", place.alias("place"), F.size("turns").alias("n"), from_each.alias("ways"), F.col("turns")[0]["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"), "blank", "duplicate", "truncated", "illegal", "new_turn", "lo", "hi")
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "n", "ways", "first", "last"))).alias("blocks"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum("illegal").alias("inner"), F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("new_turn"), F.lit(0)).alias("gaps"),
    )
    # from one block's last row to the next block's first; parts of a block have been compared by the window
    seams = F.size(F.filter("blocks", lambda b, k: (k > 0) & (b["place"]["part"] == 0) & ~_legal(F.col("blocks")[F.greatest(k - 1, F.lit(0))]["last"], b["first"])))
    end = F.aggregate("blocks", _start("e"), lambda at, b: _chained(at, b["ways"]), lambda at: _let(_inserted(_inserted(at)), lambda c: F.least(c["e"], c["a"])))
    whole = whole.withColumns({"end": end, "illegal": F.col("inner") + seams})
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.letters").alias("letters"), F.transform("blocks", lambda b: F.struct(b["place"].alias("place"), b["n"].alias("n"))).alias("blocks"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal (pairs of neighbours), cost, audit (letters D, I, K, R).
    turns: conv_id, place (sorts a conversation's turns), turn (null: inserted), role, text, edit (I, K or R), those deleted left out.
    """
    flagged = materialize(faults(rows), "flagged")
    whole = materialize(_folded(flagged), "folded")
    # a row's letters: insertions before it, its edit, and after the last row the insertions at the end
    tokens = F.regexp_extract_all("letters", F.lit("[IJ]*[DKRS](?:[IJ]*$)?"), F.lit(0))
    offset = F.aggregate(F.slice("blocks", F.lit(1), F.col("k")), F.lit(0), lambda n, b: n + b["n"])
    parts = whole.select("conv_id", tokens.alias("tokens"), "blocks", F.posexplode("blocks").alias("k", "b")).select("conv_id", "b.place.*", F.slice("tokens", offset + 1, F.col("b.n")).alias("tokens"))
    parts = parts.select(F.col("conv_id").alias("c"), F.when(F.col("known"), F.col("block")).alias("b"), F.col("part").alias("p"), "tokens")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")) & (F.col("part") == F.col("p"))
    edited = flagged.join(parts, same).withColumn("token", F.col("tokens")[(F.col("idx") - 1 - F.col("part") * BLOCK).cast("int")])
    role = lambda x: F.when(x.isin("I", "R"), F.lit("user")).otherwise(F.lit("assistant"))
    made = lambda x: F.when(x.isin("I", "J"), F.struct(F.lit("I").alias("edit"), F.lit(None).cast("long").alias("turn"), role(x).alias("role"), F.lit("").alias("text"))).otherwise(
        F.struct(F.translate(x, "S", "R").alias("edit"), F.col("turn"), F.when(x == "K", F.col("role")).otherwise(role(x)).alias("role"), F.col("text")))
    turns = edited.select("conv_id", "block", "idx", F.posexplode(F.transform(F.filter(F.split("token", ""), lambda x: ~x.isin("", "D")), made)).alias("k", "x"))
    place = F.struct(F.col("block").isNotNull().alias("known"), F.coalesce("block", F.lit(0)).alias("block"), "idx", "k").alias("place")
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.translate("letters", "JS", "IR").alias("audit")), turns.select("conv_id", place, "x.turn", "x.role", "x.text", "x.edit")


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` lines of repair()'s turns: read in order, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        out = lambda: pa.RecordBatch.from_pydict({"conv_id": pa.array([now], kind), "repaired_sha256": [sha.hexdigest()]})
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"], strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        yield out()
                    now, sha = conv, hashlib.sha256(line.as_py().encode())
                else:
                    sha.update(b"\n" + line.as_py().encode())
        if sha is not None:
            yield out()

    kind = turns.schema["conv_id"].dataType.simpleString()
    lines = turns.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return lines.select("conv_id", "line").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
