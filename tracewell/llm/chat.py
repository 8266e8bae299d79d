"""Chat formatting by perspective rotation.

A dialogue of several parties is rendered once for each of them: that speaker is
the assistant, every other one a named user, and the mask covers what the
speaker says. System turns are shown to all and are nobody's perspective.

A dialogue of more than PART turns comes in parts, cut by the rank of its turns.
Every participant of the dialogue gets a rendering of every part, silent or not,
and a participant's parts laid end to end are the rendering of the whole.

What is said can't forge a mark: in texts ``<|`` is written ``<||``, which undoes
as ``<||`` to ``<|``; in names ``%``, ``|`` and line breaks are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SYSTEM = "system"
#: Turns in one rendering at most; it bounds what a task holds of one dialogue.
PART = 4_096
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def name_of(speaker: Column) -> Column:
    for mark, code in (("%", "%25"), ("|", "%7C"), ("\n", "%0A"), ("\r", "%0D")):
        speaker = F.replace(speaker, F.lit(mark), F.lit(code))
    return speaker


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part: int = PART
) -> DataFrame:
    """A row per (dialogue, part, participant of the dialogue): conv_id, part, perspective, n_turns, rendered, mask, n_masked.

    Turns are in order of turn number, then speaker, then text, whatever the
    numbers are; repeated rows are repeated turns. ``mask`` lists the [start,
    end) of what the assistant says with its end mark, in code points,
    comma-joined; n_masked is their sum. A null text is empty; a null turn number
    comes first; a null speaker is a participant of its own, whose perspective is
    null and whose name is left out. Rows without a dialogue id each are a
    dialogue of their own, without an id. A dialogue of system turns alone has
    no perspective and no row; an empty table has none. Very long texts are kept
    whole. Further columns, whatever their names, are left out.
    """
    lone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    clean = turns.select(
        F.col(conv_col).alias("conv_id"),
        lone.alias("lone"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(speaker_col).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Counts alone, before any text moves; Spark broadcasts the long ones only while they are few.
    long_ = clean.where("conv_id IS NOT NULL").groupBy("conv_id").count().where(F.col("count") > part).select("conv_id")
    if long_.isEmpty():
        return _rendered(clean.withColumn("part", F.lit(0).cast("long")), None)
    short = clean.join(long_, "conv_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    cut = _ranked(clean.join(long_, "conv_id", "left_semi")).withColumn("part", F.floor((F.col("rank") - 1) / part).cast("long"))
    speakers = cut.select("conv_id", "speaker").distinct().where(~F.col("speaker").eqNullSafe(SYSTEM))
    return _rendered(short, None).unionByName(_rendered(cut, speakers))


def _ranked(rows: DataFrame) -> DataFrame:
    """Each turn's rank in its dialogue, from 1, however long the dialogue is.

    Slices of the sorted turns are ranked on their own, and a slice's ranks
    start after the turns of the slices before it.
    """
    order = ["turn", "speaker", "text"]
    of_dialogue = Window.partitionBy("conv_id").orderBy("slice")
    # Written, as another run would cut other slices. The row number splits repeats of one turn.
    sliced = rows.repartitionByRange("conv_id", *order, F.monotonically_increasing_id()).withColumn("slice", F.spark_partition_id())
    sliced = written(sliced, "turns")
    sizes = sliced.groupBy("conv_id", "slice").count()
    before = sizes.select("conv_id", "slice", (F.sum("count").over(of_dialogue) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order))
    ranked = sliced.withColumn("own", own).join(before, ["conv_id", "slice"])
    return ranked.withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "slice")


def _rendered(clean: DataFrame, speakers: DataFrame | None) -> DataFrame:
    """Renderings of (conv_id, lone, part); ``speakers`` are the dialogues' participants, or else the part's own."""
    said = F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("said")
    if speakers is None:
        own = F.collect_set(F.when(~F.col("speaker").eqNullSafe(SYSTEM), F.struct("speaker")))
        grouped = clean.groupBy("conv_id", "lone", "part").agg(said, own.alias("speakers"))
        shown = grouped.select("conv_id", "part", "said", F.explode("speakers").alias("who")).withColumn("perspective", F.col("who.speaker"))
    else:
        grouped = clean.groupBy("conv_id", "part").agg(said)
        shown = grouped.join(speakers.withColumnRenamed("speaker", "perspective"), "conv_id")

    def piece(t):
        own = t["speaker"].eqNullSafe(F.col("perspective"))
        head = (
            F.when(t["speaker"].eqNullSafe(SYSTEM), F.lit("<|system|>\n"))
            .when(own, F.lit("<|assistant|>\n"))
            .when(t["speaker"].isNull(), F.lit("<|user|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), name_of(t["speaker"]), F.lit("|>\n")))
        )
        body = F.concat(escaped(t["text"]), F.lit(END))
        return F.struct(F.concat(head, body).alias("all"), F.length(head).alias("head"), F.length(body).alias("body"), own.alias("own"))

    pieces = shown.withColumn("pieces", F.transform("said", piece))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("mask"), F.lit(0).cast("long").alias("n"))

    def step(acc, p):
        begin, end = acc["at"] + p["head"], acc["at"] + p["head"] + p["body"]
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(
            end.alias("at"),
            F.when(p["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"),
            F.when(p["own"], acc["n"] + p["body"]).otherwise(acc["n"]).alias("n"),
        )

    masked = pieces.withColumn("m", F.aggregate("pieces", start, step))
    return masked.select(
        "conv_id",
        "part",
        "perspective",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["all"]), "").alias("rendered"),
        F.array_join("m.mask", ",").alias("mask"),
        F.col("m.n").alias("n_masked"),
    )


ORACLE_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1) AS rank
  FROM conversations),
t AS (SELECT *, rank // {PART} AS part FROM r),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM '{SYSTEM}'),
s AS (
  SELECT t.conv_id, t.part, p.perspective, t.rank, t.speaker,
         CASE WHEN t.speaker = '{SYSTEM}' THEN '<|system|>' || chr(10)
              WHEN t.speaker IS NOT DISTINCT FROM p.perspective THEN '<|assistant|>' || chr(10)
              WHEN t.speaker IS NULL THEN '<|user|>' || chr(10)
              ELSE '<|user name=' || replace(replace(replace(replace(t.speaker, '%', '%25'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D')
                   || '|>' || chr(10) END AS head,
         replace(t.text, '<|', '<||') || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id = p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
      PARTITION BY conv_id, part, perspective ORDER BY rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS begin
  FROM s)
SELECT conv_id, part::BIGINT AS part, perspective, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY rank) AS rendered,
       coalesce(string_agg(begin || ':' || (begin + length(body)), ',' ORDER BY rank)
                FILTER (speaker IS NOT DISTINCT FROM perspective), '') AS mask,
       sum(CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN length(body) ELSE 0 END)::BIGINT AS n_masked
FROM o GROUP BY conv_id, part, perspective
"""
