"""Multi-party perspective rotation, with DataFrame functions alone.

A dialogue is rendered once for each participant: that speaker's messages become the assistant's, and carry the loss;
all others speak as named users.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """`text` without the control marks of the template: "<|" within a message becomes "< |"."""
    return F.regexp_replace(text, r"<\|", "< |")


def segmented(rows: DataFrame, size: int, system_roles: tuple[str, ...]) -> DataFrame:
    """Of (conv, message): conv, segment and messages, in order. A segment has `size` messages at most, besides the system messages
    of the conversation's first one, which every later segment repeats before its own.

    Messages of longer conversations are numbered by ranges of turns, whose sizes are summed first, so that no task needs a whole conversation.
    """
    order = ["message.turn", "message.role", "message.text"]
    long = rows.groupBy("conv").count().filter(F.col("count") > size).select("conv")
    if long.isEmpty():
        return rows.groupBy("conv").agg(F.sort_array(F.collect_list("message")).alias("messages")).withColumn("segment", F.lit(0).cast("long"))
    named = rows.withColumn("range", F.coalesce(F.floor(F.col("message.turn") / size), F.lit(-(2**62))))
    ranges = named.groupBy("conv", "range").count()
    before = F.sum("count").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(F.col("conv").alias("of"), F.col("range").alias("of_range"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = named.withColumn("place", F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order)))
    placed = placed.join(ranges, F.col("conv").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    numbered = placed.select("conv", F.floor((F.col("before") + F.col("place") - 1) / size).alias("segment"), "message")
    segments = numbered.groupBy("conv", "segment").agg(F.sort_array(F.collect_list("message")).alias("messages"))
    heads = segments.filter("segment = 0").select(F.col("conv").alias("of"), F.filter("messages", lambda m: m["role"].isin(*system_roles)).alias("head")).filter(F.size("head") > 0)
    with_heads = segments.join(heads, F.col("conv").eqNullSafe(F.col("of")) & (F.col("segment") > 0), "left")
    return with_heads.select("conv", "segment", F.when(F.col("head").isNull(), F.col("messages")).otherwise(F.concat("head", "messages")).alias("messages"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_roles: tuple[str, ...] = ("system",), messages_per_segment: int = 4096) -> DataFrame:
    """One row for each conversation, participant and segment of at most `messages_per_segment` messages.

    Returns conv_id, participant, segment, n_messages, n_trained, rendered, mask_spans. rendered: the messages in the order of
    turn, role and text. mask_spans: start:end of the stretches of `rendered` that carry the loss (the participant's contents
    with their end marks), in code points, end exclusive, comma-joined. A conversation of up to messages_per_segment messages, whatever
    their turn numbers, is one segment, 0; longer ones are cut by the rank of their messages, so that no task holds a whole
    conversation of any length, and each later segment begins with the system messages of the first.

    Edge cases: messages of `system_roles` are rendered as system messages and are no participants; a null role is the speaker
    "unknown", a null text an empty message, a null turn comes before all others; null conversation ids form one
    conversation; repeated rows stay repeated; a conversation of system messages alone gives no row; an empty table gives none.
    A segment in which a participant is silent is rendered for them with an empty mask.
    """
    role = F.coalesce(col(role_col).cast("string"), F.lit("unknown"))
    message = F.struct(col(turn_col).alias("turn"), role.alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = turns.select(col(conv_col).alias("conv"), message.alias("message"))
    segments = segmented(rows, messages_per_segment, system_roles)
    speakers = rows.select(F.col("conv").alias("of"), F.col("message.role").alias("participant")).filter(~F.col("participant").isin(*system_roles)).distinct()
    views = segments.join(speakers, F.col("conv").eqNullSafe(F.col("of"))).drop("of")

    def rendering(m: Column) -> Column:
        own = m["role"] == F.col("participant")
        name = F.regexp_replace(escaped(m["role"]), r"[\r\n]", " ")
        head = F.when(own, f"{OPEN}assistant\n").when(m["role"].isin(*system_roles), f"{OPEN}system\n").otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
        return F.struct(own.alias("own"), head.alias("head"), F.concat(escaped(m["text"]), F.lit(CLOSE)).alias("body"))

    def placed(state: Column, p: Column) -> Column:
        start, end = state["at"] + F.length(p["head"]), state["at"] + F.length(p["head"]) + F.length(p["body"])
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return views.withColumn("parts", F.transform("messages", rendering)).select(
        F.col("conv").alias("conv_id"), "participant", "segment",
        F.size("parts").cast("long").alias("n_messages"), F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.aggregate("parts", none, placed)["spans"], ",").alias("mask_spans"),
    )
