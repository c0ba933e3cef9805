"""Draft answers of an agents' round: who takes part, what each says, and which level of synthesis is put forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The roles of each mode, in order, and the line before positions that nobody drew together.
ROLES = {"simple": ["jurist"], "standard": ["jurist", "professor", "judge"], "complex": ["jurist", "advocate", "prosecutor", "professor", "judge"]}
NO_SYNTHESIS = "Avtomatik xulosa shakllantirilmadi — quyida agentlarning xom pozitsiyalari."


def participation(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """(request_id, role, place, present) of every role that a request (request_id, mode, only_roles) asks for: those it
    names, else those of its mode; present tells whether it answered (request_id, role)."""
    by_mode = F.coalesce(*(F.when(F.col("mode") == mode, F.array(*map(F.lit, roles))) for mode, roles in ROLES.items()))
    wanted = requests.select("request_id", F.posexplode(F.coalesce("only_roles", by_mode)).alias("place", "role"))
    came = answered.select("request_id", "role").distinct().withColumn("present", F.lit(True))
    return wanted.join(came, ["request_id", "role"], "left").select("request_id", "role", "place", F.coalesce("present", F.lit(False)).alias("present"))


def missing_roles(taking_part: DataFrame) -> DataFrame:
    """(request_id, missing) in the order of roles."""
    absent = F.collect_list(F.when(~F.col("present"), F.struct("place", "role")))
    return taking_part.groupBy("request_id").agg(F.transform(F.sort_array(absent), lambda x: x["role"]).alias("missing"))


def block(title: str | Column, body: Column) -> Column:
    """A titled block, null without a body."""
    title = F.lit(title) if isinstance(title, str) else title
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(title, F.lit("\n"), body))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")


def verdict_text(verdict: Column) -> Column:
    """A verdict (conclusion, reasoning, caveats) as an answer; null without a verdict."""
    text = F.concat_ws("\n\n", block("XULOSA", verdict["conclusion"]), block("ASOSLAR", bullets(verdict["reasoning"])), block("OGOHLANTIRISHLAR", bullets(verdict["caveats"])))
    return F.when(verdict.isNotNull(), text)


def position_text(position: Column) -> Column:
    """A position (role, stance, arguments of strength, claim and citations, weaknesses, confidence) as an answer's part."""
    argument = lambda a: F.concat(F.lit("["), a["strength"], F.lit("] "), a["claim"], F.lit(" "), F.array_join(F.transform(a["citations"], lambda t: F.concat(F.lit("["), t, F.lit("]"))), " "))
    said = F.transform(F.coalesce(position["arguments"], F.array().cast("array<struct<strength:string,claim:string,citations:array<string>>>")), argument)
    head = F.concat(F.upper(position["role"]), F.lit(" POZITSIYASI\n"), F.coalesce(position["stance"], F.lit("")))
    sure = F.format_string("ISHONCH: %.2f", position["confidence"])
    return F.concat_ws("\n\n", head, block("DALILLAR", bullets(said)), block("ZAIF TOMONLAR", bullets(position["weaknesses"])), sure)


def frame_text(frame: Column) -> Column:
    """A frame (answer, norms of tag, title and article, unknowns) as an answer. Its norms are always listed, as they bear
    tags by which they outlast the check; what is unknown alone makes no answer."""
    norm = lambda n: F.concat(F.lit("["), n["tag"], F.lit("] "), n["title"], F.coalesce(F.concat(F.lit(", "), F.nullif(n["article"], F.lit("")), F.lit("-modda")), F.lit("")))
    said, listed = block("XULOSA", frame["answer"]), block("TEGISHLI NORMALAR", bullets(F.transform(frame["norms"], norm)))
    text = F.concat_ws("\n\n", said, listed, block("YETISHMAYOTGAN MA'LUMOT", bullets(frame["unknowns"])))
    return F.when(frame.isNotNull() & (said.isNotNull() | listed.isNotNull()), text)


def final_positions(positions: DataFrame) -> DataFrame:
    """Of each role's positions (request_id, place, round, position) that of the last round, in the order of first ones."""
    by_role = Window.partitionBy("request_id", "position.role")
    last = F.row_number().over(by_role.orderBy(F.col("round").desc()))
    return positions.withColumn("first", F.min("place").over(by_role)).withColumn("n", last).where("n = 1").select("request_id", F.col("first").alias("place"), "position")


def draft_answers(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """(request_id, level, draft) of requests (request_id, verdict, frame): the verdict, else the last positions of all
    sides, else the frame; an empty draft where there is none. Nothing is written anew, texts are only put together."""
    parts = final_positions(positions).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("place", position_text(F.col("position")).alias("text")))).alias("parts"))
    joined = requests.join(parts, "request_id", "left")
    sides = F.when(F.col("parts").isNotNull(), F.concat_ws("\n\n", F.lit(NO_SYNTHESIS), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")))
    verdict, frame = verdict_text(F.col("verdict")), frame_text(F.col("frame"))
    level = F.when(F.col("verdict").isNotNull(), "verdict").when(F.col("parts").isNotNull(), "positions").when(frame.isNotNull(), "frame").otherwise("none")
    return joined.select("request_id", level.alias("level"), F.coalesce(verdict, sides, frame, F.lit("")).alias("draft"))
