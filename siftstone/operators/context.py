"""From ranked hits to a cited context, and the messages of a chat request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSIONS, alnum_key, casefold, col, collapse, first_filled, mission_key, strip
from .files import span
from .ranks import numbered

NO_CONTEXT = "No retrieved documents were provided."
HISTORY = 6
ROLES = ("user", "assistant")


def dedup_key(text: str | Column) -> Column:
    return casefold(collapse(text))


def first_of_equals(ranked: DataFrame, text: str, group: str, order: str) -> DataFrame:
    """Of equal texts (white space and case aside) of a group the first by order; blank and null texts go. Each task keeps one row of a text
    before the shuffle, so texts that stand everywhere are no hot key."""
    first = Window.partitionBy(group, "_same").orderBy(order)
    kept = ranked.where(strip(text) != "").withColumn("_same", F.md5(dedup_key(text))).withColumn("_first", F.row_number().over(first))
    return kept.where("_first = 1").drop("_same", "_first")


def distinct_in_order(ranked: DataFrame, text: str, group: str, order: str, large: bool = False) -> DataFrame:
    """first_of_equals, with number, from 1, in that order. large: a group may be more than a task can sort, see ranks.numbered."""
    kept = first_of_equals(ranked, text, group, order)
    if large:
        return numbered(kept, group, [F.col(order)])
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def mission_label(c: str | Column) -> Column:
    known = reduce(lambda x, kv: F.when(mission_key(alnum_key(c)) == kv[0], F.lit(kv[1])).otherwise(x), MISSIONS.items(), col(c))
    return F.coalesce(known, F.lit("unknown"))


def cited_block(number, text, mission, source: list, filepath: list, kind: list, pages: tuple | None = None, lines: tuple | None = None) -> Column:
    """A document under its header lines. source, filepath and kind list columns, the first that is filled counts."""
    head = [
        F.format_string("[DOCUMENT %d]", col(number).cast("int")),
        F.concat(F.lit("MISSION = "), mission_label(mission)),
        F.concat(F.lit("SOURCE = "), F.coalesce(first_filled(*source), F.lit("Unknown source"))),
        F.concat(F.lit("FILEPATH = "), F.coalesce(first_filled(*filepath), F.lit("Unknown filepath"))),
        F.concat(F.lit("TYPE = "), F.coalesce(first_filled(*kind), F.lit("unknown"))),
    ]
    head += [F.regexp_replace(span(n, *s), "=", " = ") for n, s in (("PAGES", pages), ("LINES", lines)) if s]
    return F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), strip(text))


def cited_context(numbered: DataFrame, group: str | list[str], block: Column) -> DataFrame:
    """(group, context): blocks in the order of number; a group's blocks are bounded by the search's k, or by the context's size."""
    parts = F.array_sort(F.collect_list(F.struct("number", block.alias("b"))))
    return numbered.groupBy(*([group] if isinstance(group, str) else group)).agg(F.concat(F.lit("RETRIEVED DOCUMENTS\n\n"), F.array_join(F.transform(parts, lambda x: x.b), "\n\n---\n\n")).alias("context"))


def last_turns(turns: DataFrame, conversation: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last n turns of each conversation; 0 gives none."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("the number of turns must be at least 0")
    back = Window.partitionBy(conversation).orderBy(F.desc(order))
    return turns.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back")


def bad_turns(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Turns that no request may carry: another role, or blank."""
    return turns.where(~F.coalesce(F.col(role).isin(*ROLES), F.lit(False)) | (F.coalesce(strip(text), F.lit("")) == ""))


def user_prompt(question, context) -> Column:
    said = F.coalesce(F.nullif(strip(context), F.lit("")), F.lit(NO_CONTEXT))
    return F.concat(F.lit("USER QUESTION:\n"), strip(question), F.lit("\n\nRETRIEVED DOCUMENTS:\n"), said)


def messages(system: str, history: Column, prompt: Column) -> Column:
    """array of (role, content): the instructions, the history, the prompt."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.concat(F.array(message("developer", F.lit(system))), history, F.array(message("user", prompt)))
