"""Meeting annotations in XML: agents and names of a meetings file, and segment files by speaker code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENTS = ("A", "B", "C", "D")
#: The meetings of the test split, each in four sessions.
TEST_MEETINGS = ("EN2002", "ES2004", "IS1009", "TS3003")
SESSIONS = ("a", "b", "c", "d")


def split_meetings(spark: SparkSession, base: tuple[str, ...] = TEST_MEETINGS, sessions: tuple[str, ...] = SESSIONS) -> DataFrame:
    """(meeting): each base meeting with each session."""
    a = spark.createDataFrame([(x,) for x in base], "base string")
    return a.select(F.explode(F.array(*[F.lit(s) for s in sessions])).alias("session"), "base").select(F.concat("base", "session").alias("meeting"))


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """(meeting, agent, speaker): the global name of each meeting's agents A to D; a missing one is UNKNOWN."""
    schema = "_observation string, speaker array<struct<_nxt_agent: string, _global_name: string>>"
    rows = spark.read.format("xml").option("rowTag", "meeting").schema(schema).load(path).filter("_observation is not null")
    every = rows.select(F.col("_observation").alias("meeting"), F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("agent")).distinct()
    named = rows.select(F.col("_observation").alias("meeting"), F.explode("speaker").alias("s")).select("meeting", F.col("s._nxt_agent").alias("agent"), F.col("s._global_name").alias("speaker"))
    named = named.groupBy("meeting", "agent").agg(F.max("speaker").alias("speaker"))
    return every.join(named, ["meeting", "agent"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))


def require_meeting(agents: DataFrame, meeting: str) -> DataFrame:
    found = agents.filter(F.col("meeting") == meeting)
    if found.isEmpty():
        raise ValueError(f"meeting {meeting} is not in the meetings file")
    return found


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(meeting, agent, id, start, end, duration) of files named <meeting>.<agent>.segments.xml;
    segments without an id or with times that are no numbers are left out."""
    schema = "`_nite:id` string, _transcriber_start string, _transcriber_end string"
    rows = spark.read.format("xml").option("rowTag", "segment").schema(schema).load(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    start, end = F.expr("try_cast(_transcriber_start as double)"), F.expr("try_cast(_transcriber_end as double)")
    out = rows.select(
        F.element_at(F.split(name, r"\."), 1).alias("meeting"), F.element_at(F.split(name, r"\."), 2).alias("agent"),
        F.col("`_nite:id`").alias("id"), start.alias("start"), end.alias("end"),
    )
    return out.filter("id is not null and start is not null and end is not null").withColumn("duration", F.col("end") - F.col("start"))


def to_annotation(segments: DataFrame, agents: DataFrame) -> DataFrame:
    """(file_id, start, end, speaker): segments under their speakers' names, SPEAKER_<code> where none is known."""
    named = segments.join(agents, ["meeting", "agent"], "left")
    speaker = F.coalesce("speaker", F.concat(F.lit("SPEAKER_"), F.col("agent")))
    return named.select(F.col("meeting").alias("file_id"), "start", "end", speaker.alias("speaker"))
