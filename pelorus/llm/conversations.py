"""Conversations rebuilt from message rows, and the broken ones found by an automaton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The automaton. From the state before a turn (the last turn's role), the roles the turn may have.
NEXT = {"": "system user", "system": "user", "user": "assistant", "assistant": "user tool", "tool": "assistant"}
#: Roles as numbers, so that turns are added up in a hash table; any other role is UNKNOWN and accepted nowhere.
ROLES = {role: n for n, role in enumerate(NEXT)}
UNKNOWN = len(ROLES)
#: Anything that can be seen: no white space, separator, control or invisible format character.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}]"
_BLANK = r"^[\s\p{Z}\p{Cc}\p{Cf}]+|[\s\p{Z}\p{Cc}\p{Cf}]+$"


def clean_role(role: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), _BLANK, ""))


def is_visible(content: Column) -> Column:
    return F.coalesce(F.rlike(content, F.lit(VISIBLE)), F.lit(False))


def _turns(df: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """One row per turn; added up before the shuffle, however many copies a turn has."""
    who, seen = F.lit(UNKNOWN), is_visible(F.col(content))
    for name, n in ROLES.items():
        who = F.when(clean_role(F.col(role)) == name, n if name else UNKNOWN).otherwise(who)
    return (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("_key"), F.col(turn).cast("bigint").alias("_turn"), who.alias("_role"), seen.alias("_seen"))
        .groupBy("_key", "_turn")
        .agg(
            F.min("_role").alias("_first"),
            F.max("_role").alias("_last"),
            F.max("_seen").alias("_seen"),
            F.max(F.col("_seen") & F.col("_role").isin(ROLES["user"], ROLES["assistant"])).alias("_spoken"),
        )
    )


def drop_reasons(df: DataFrame, *, key: str, turn: str, role: str, content: str, block: int = 4096) -> DataFrame:
    """Conversations to drop, ``(key, reason)``, one row each, the first reason that fits:

    * ``empty``: no user or assistant message has visible content;
    * ``broken``: the turns are not 0, 1, 2, ... (a null turn included), a turn has two roles, or the automaton ``NEXT``
      does not accept the roles in order (a null or unknown role included);
    * ``no_reply``: the last turn is not the assistant's, or an assistant turn has no visible content.

    The automaton's state is the last turn's role, so a step needs only the turn before. Turns are therefore sorted
    and checked in blocks of ``block`` turns; a block's last turn is copied to the next block. No task ever sorts a
    whole conversation, which may hold a third of all rows. Repeated messages change nothing; rows without a key
    belong to no conversation; an empty table gives no row.
    """
    turns = _turns(df, key, turn, role, content)
    at = F.coalesce(F.floor(F.col("_turn") / block), F.lit(-1))
    edge = F.col("_turn") % block == block - 1
    placed = turns.withColumn("_block", F.explode(F.when(edge, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_block") == at)
    order = Window.partitionBy("_key", "_block").orderBy("_turn")
    before_turn, before = F.lag("_turn").over(order), F.lag("_last").over(order)
    state = F.when(F.col("_turn") == 0, ROLES[""]).when(before_turn == F.col("_turn") - 1, before)
    step = F.lit(False)
    for name, roles in NEXT.items():
        step = F.when(state == ROLES[name], F.col("_first").isin([ROLES[r] for r in roles.split()])).otherwise(step)
    accepted = (F.col("_first") == F.col("_last")) & step
    return (
        placed.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
        .where("_own")
        .groupBy("_key")
        .agg(
            F.max("_spoken").alias("spoken"),
            F.min("_ok").alias("ok"),
            F.max_by("_last", "_turn").alias("last"),
            F.max((F.col("_last") == ROLES["assistant"]) & ~F.col("_seen")).alias("mute"),
        )
        .select(
            F.col("_key").alias(key),
            F.when(~F.col("spoken"), "empty").when(~F.col("ok"), "broken").when((F.col("last") != ROLES["assistant"]) | F.col("mute"), "no_reply").alias("reason"),
        )
        .where(F.col("reason").isNotNull())
    )


def conversations(df: DataFrame, *, key: str, turn: str, role: str, content: str) -> DataFrame:
    """The messages of the kept conversations, ``(key, turn, message, role, content)``, with clean role and content.

    Rows alike in turn, role and content are one message; messages of a turn are numbered from 1 by content. Outer
    blanks of content are cut; messages without visible content stay, as an empty text, where the automaton allows
    them. Rows stay rows, so a conversation of any length fits; sort by key and turn where order matters on write.
    """
    dropped = drop_reasons(df, key=key, turn=turn, role=role, content=content)
    text = F.when(is_visible(F.col(content)), F.regexp_replace(F.col(content), r"^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$", "")).otherwise(F.lit(""))
    messages = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("_key"), F.col(turn).cast("bigint").alias("turn"), clean_role(F.col(role)).alias("role"), text.alias("content"))
        .distinct()
    )
    kept = messages.join(dropped.select(F.col(key).alias("_key")), "_key", "left_anti")
    number = F.row_number().over(Window.partitionBy("_key", "turn").orderBy("content"))
    return kept.select(F.col("_key").alias(key), F.col("turn").alias(turn), number.cast("bigint").alias("message"), "role", "content")
