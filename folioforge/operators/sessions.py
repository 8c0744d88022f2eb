"""Sessions of turns, caches with a life, notes and logs: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from folioforge.functions.intent import paper_ids

#: How long entries live, in days.
LIVES = {"response": 30, "search": 1, "purge": 30}


def number_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (session, at, id, ...) with ``turn`` from 1 and ``back`` from the last."""
    w = W.partitionBy("session")
    return turns.withColumns({"turn": F.row_number().over(w.orderBy("at", "id")), "back": F.row_number().over(w.orderBy(F.desc("at"), F.desc("id")))})


def roll_up(turns: DataFrame) -> DataFrame:
    """(session, messages, paper_ids, started_at, last_at) of turns (session, at,
    paper_ids): the papers of all turns, each once, in order. A turn's papers are made
    distinct before the shuffle."""
    n = turns.groupBy("session").agg(F.count("*").alias("messages"), F.min("at").alias("started_at"), F.max("at").alias("last_at"))
    p = turns.select("session", F.explode("paper_ids").alias("p")).distinct().groupBy("session").agg(F.array_sort(F.collect_list("p")).alias("paper_ids"))
    return n.join(p, "session", "left").withColumn("paper_ids", F.coalesce("paper_ids", F.array().cast("array<bigint>")))


def latest_session(sessions: DataFrame) -> DataFrame:
    """The session that was used last; ties go to the greater name."""
    return sessions.orderBy(F.desc("last_at"), F.desc("session")).limit(1)


def carry_over(turns: DataFrame) -> DataFrame:
    """``turns`` (session, at, id, question, paper_ids) with the question as it is asked:
    one that names no paper gets the papers of the session's last turn that had any."""
    named = F.transform(F.regexp_extract_all(F.lower("question"), F.lit(r"paper\s+(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    t = turns.withColumn("named", F.filter(named, lambda x: x.isNotNull()))
    held = F.when(F.size("named") > 0, F.col("named")).when(F.size("paper_ids") > 0, F.col("paper_ids"))
    before = W.partitionBy("session").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("carried", F.last(held, ignorenulls=True).over(before))
    hint = F.array_join(F.transform("carried", lambda p: F.concat(F.lit("["), p.cast("string"), F.lit("]"))), " ")
    asked = F.when((F.size("named") == 0) & (F.size("carried") > 0), F.concat("question", F.lit(" "), hint)).otherwise(F.col("question"))
    return t.withColumn("asked", asked).drop("named", "carried")


def expires(created: Column, days: int) -> Column:
    return created + F.make_dt_interval(F.lit(days))


def put(entries: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The entries with the fresh ones in place of those of the same key."""
    return entries.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*entries.columns))


def drop_containing(entries: DataFrame, changed: DataFrame, members: str = "paper_ids") -> DataFrame:
    """Entries (id, members, ...) without those that have a changed paper (paper_id)."""
    hit = entries.select("id", F.explode(members).alias("paper_id")).join(changed.select("paper_id").distinct(), "paper_id", "left_semi")
    return entries.join(hit.select("id").distinct(), "id", "left_anti")


def next_midnight(at: Column) -> Column:
    return F.date_trunc("day", at) + F.make_dt_interval(F.lit(1))


def cooldown(now: Column, day: Column, minute: Column) -> Column:
    """How long a model is blocked, as it is shown."""
    left = lambda until: F.unix_seconds(until) - F.unix_seconds(now)
    hours = F.concat(F.lit("Daily limit — resets in "), F.floor(left(day) / 3600).cast("string"), F.lit("h "), F.floor(left(day) % 3600 / 60).cast("string"), F.lit("m"))
    return F.when(now < day, hours).when(now < minute, F.concat(F.lit("RPM cooldown — "), left(minute).cast("string"), F.lit("s"))).otherwise("Available")


__all__ = ["carry_over", "cooldown", "drop_containing", "expires", "latest_session", "next_midnight", "number_turns", "paper_ids", "put", "roll_up"]
