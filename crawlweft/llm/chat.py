"""Chat formatting with typed content parts; DataFrame functions only.

A turn is START role BODY content END. A visitor goes over the typed parts of each turn: text is escaped; image, audio
and document parts become placeholders in order, the k-th placeholder of a conversation standing for its k-th
attachment (type, reference, expanded token count). Escaping is reversible: the mark is doubled, then put inside every
control string of a turn's joined parts, so that no control string is left in a text, nor made by two texts side by side.

Defined cases: null text and null role count as empty; a null conv_id is one conversation; rows with equal turn are
ordered by role, then text; an unknown part type is treated as a document; no rows, no output. A conversation is one
string by definition and is gathered in one row. Columns beside conv_id, turn, role and text (or parts) are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

START, BODY, END, MARK = "<|start|>", "<|body|>", "<|end|>", "^"
#: Strings that act as controls in this template or in common others; none survives in a text.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>")
#: Tokens for each unit of an attachment: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 800}
PART = "struct<type:string,text:string,ref:string,units:int>"


#: Stands on both sides of an attachment's type until the texts around are escaped; escaped itself where a text holds it.
_SLOT, _SLOT_ESCAPED = "\x01", "\x02^\x02"


def _doubled(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK), F.lit(MARK * 2)), F.lit(_SLOT), F.lit(_SLOT_ESCAPED))


def _split_controls(text: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + MARK + s[1:])), CONTROLS, text)


def escape(text: Column) -> Column:
    return _split_controls(_doubled(text))


def unescape(text: Column) -> Column:
    whole = reduce(lambda c, s: F.replace(c, F.lit(s[0] + MARK + s[1:]), F.lit(s)), CONTROLS, text)
    return F.replace(F.replace(whole, F.lit(_SLOT_ESCAPED), F.lit(_SLOT)), F.lit(MARK * 2), F.lit(MARK))


def text_parts(text: Column) -> Column:
    """A plain text as its one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))).cast(f"array<{PART}>")


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", "image", "audio"), part["type"]).otherwise(F.lit("document"))


def visit(part: Column) -> Column:
    """What a part is in its turn's joined parts, before body()."""
    return F.when(part["type"] == "text", _doubled(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit(_SLOT), _kind(part), F.lit(_SLOT)))


def body(parts: Column) -> Column:
    """The formatted text of a turn's parts."""
    joined = _split_controls(F.array_join(F.transform(parts, visit), ""))
    return reduce(lambda c, k: F.replace(c, F.lit(_SLOT + k + _SLOT), F.lit(f"<|{k}|>")), UNIT_TOKENS, joined)


def attachment(part: Column) -> Column:
    tokens = F.coalesce(part["units"], F.lit(1)) * F.element_at(F.create_map(*(F.lit(x) for kv in UNIT_TOKENS.items() for x in kv)), _kind(part))
    return F.struct(_kind(part).alias("type"), part["ref"].alias("ref"), tokens.cast("long").alias("n_tokens"))


def format_chat(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, parts. Returns conv_id, formatted, loss_runs (n_chars, loss: a run-length mask over formatted), attachments."""
    visited = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body(F.coalesce("parts", F.array())).alias("body"),
        F.transform(F.filter(F.coalesce("parts", F.array()), lambda p: ~p["type"].eqNullSafe(F.lit("text"))), attachment).alias("attached"),
    )
    turns = visited.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attached"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(BODY))
    run = lambda n, loss: F.struct(n.cast("long").alias("n_chars"), loss.alias("loss"))
    runs = lambda t: F.array(run(F.length(head(t)), F.lit(False)), run(F.length(t["body"]), t["role"] == "assistant"), run(F.lit(len(END)), F.lit(False)))
    return turns.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("turns", runs)).alias("loss_runs"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_chat() wrote, parsed again: turns (role, body still escaped) by the controls, loss_texts (still escaped) by the mask alone."""
    pieces = F.slice(F.split("formatted", r"\Q" + START + r"\E"), F.lit(2), F.size(F.split("formatted", r"\Q" + START + r"\E")))
    parsed = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), F.substring_index(F.substring_index(p, BODY, -1), END, 1).alias("body")))
    # the mask's runs one after the other: where the next begins, and the texts of those that count
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("texts"))
    step = lambda acc, r: F.struct(
        (acc["at"] + r["n_chars"]).alias("at"),
        F.when(r["loss"], F.concat(acc["texts"], F.array(F.col("formatted").substr(acc["at"].cast("int"), r["n_chars"].cast("int"))))).otherwise(acc["texts"]).alias("texts"),
    )
    return formatted.withColumn("turns", parsed).withColumn("loss_texts", F.aggregate("loss_runs", start, step, lambda acc: acc["texts"]))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from the output only."""
    read = read_back(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_texts", unescape), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_attachments")
