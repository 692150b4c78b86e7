"""Chat formatting of typed content parts.

A message's content is plain text, or a JSON array of parts with a ``type`` of
text, image, audio or document. A visitor flattens the parts in order: text
stands for itself, every attachment for a numbered placeholder such as
<|image_2|>, numbered through the whole conversation. Attachments are recorded
with their number, kind and reference, and tokens are counted as expanded: an
image by its patches, audio by its seconds, a document by its pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,url:string,width:int,height:int,seconds:double,pages:int>>"
TEXT = "array<struct<type:string,text:string>>"
#: Fields of a part besides type and text.
FIELDS = (("url", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
KINDS = ("image", "audio", "document")
#: Side of an image's patch, and its patches where its size isn't given.
PATCH, IMAGE_TOKENS = 28, 256
#: Tokens a second of audio, and seconds where they aren't given.
AUDIO_TOKENS, AUDIO_SECONDS = 12.5, 30.0
#: Tokens a page of a document (one page where they aren't given).
PAGE_TOKENS = 512
#: Tokens of a message's frame: role, start and end.
FRAME_TOKENS = 4


def regex_tokens(text: Column) -> Column:
    """Words and single symbols."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^ \t\r\n\f\p{L}\p{N}]")).cast("bigint")


def escaped(text: Column) -> Column:
    """``text`` in which nothing reads as a control token or placeholder."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 count: Callable[[Column], Column] = regex_tokens) -> DataFrame:
    """``(conv_id, messages, rendered, parts, attachments, refs, text_tokens,
    expanded_tokens)``, one row a conversation.

    Messages are in the order of turn, then role and text among ties (a null
    turn comes first); repeated rows are repeated messages. A null role is
    'unknown'; null and empty content is an empty message. Content that begins
    with '[' but isn't such an array is plain text. A part of unknown type counts
    as text, a null part is skipped. Rows with a null conv_id are left out.
    ``refs`` lists number|kind|reference, a line each; '|' and line ends in a reference
    are percent-encoded. '<|' in text and role becomes '< |' and line ends in a role blanks, so
    that nobody's text makes turns or placeholders. An empty table gives an empty one.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"),
    ).where("conv_id IS NOT NULL")
    rows = rows.withColumn("m", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "content")))
    parsed = F.when(F.ltrim("content").startswith("["), F.from_json("content", PART))
    # an array of other things parses as parts without any field
    typed = F.filter(parsed, lambda p: p.isNotNull())
    typed = F.when((F.size(typed) > 0) & F.forall(typed, lambda p: p["type"].isNotNull()), typed)
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).cast(TEXT)
    plain = F.transform(plain, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), *[F.lit(None).cast(k).alias(c) for c, k in FIELDS]))
    parts = rows.select("conv_id", "m", "role", F.coalesce(typed, plain).alias("parts"))
    each = parts.select("conv_id", "m", "role", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "p")).select("conv_id", "m", "role", "n", "i", "p.*")

    attached = F.col("type").isin(*KINDS)
    order = Window.partitionBy("conv_id").orderBy("m", "i")
    each = each.withColumn("kind", F.when(attached, F.col("type"))).withColumn("number", F.sum(attached.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("kind").isNotNull(), F.concat(F.lit("<|"), "kind", F.lit("_"), F.col("number").cast("string"), F.lit("|>"))).otherwise(escaped(text))
    framed = F.concat(
        F.when(F.col("i") == 0, F.concat(F.lit("<|start|>"), escaped(F.regexp_replace("role", r"[\r\n]", " ")), F.lit("\n"))).otherwise(F.lit("")), body,
        F.when(F.col("i") == F.col("n") - 1, F.lit("<|end|>\n")).otherwise(F.lit("")),
    )
    image = F.when((F.col("width") > 0) & (F.col("height") > 0), F.ceil(F.col("width") / PATCH) * F.ceil(F.col("height") / PATCH)).otherwise(IMAGE_TOKENS)
    expanded = (
        F.when(F.col("kind") == "image", image)
        .when(F.col("kind") == "audio", F.ceil(F.coalesce(F.greatest("seconds", F.lit(0.0)), F.lit(AUDIO_SECONDS)) * AUDIO_TOKENS))
        .when(F.col("kind") == "document", F.coalesce(F.greatest("pages", F.lit(0)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(0).cast("bigint")
    )
    url = F.coalesce("url", F.lit(""))
    for char, code in (("|", "%7C"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code))
    shown = each.select(
        "conv_id", "m", "i", framed.alias("s"), F.when(F.col("kind").isNotNull(), F.concat_ws("|", F.col("number").cast("string"), "kind", url)).alias("ref"),
        F.when(F.col("kind").isNull(), count(text)).otherwise(0).cast("bigint").alias("text_tokens"), expanded.alias("attachment_tokens"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("m", "i", "s", "ref")))
    done = shown.groupBy("conv_id").agg(
        F.max("m").cast("bigint").alias("messages"), ordered.alias("o"), F.count("*").alias("parts"), F.count("ref").alias("attachments"),
        F.sum("text_tokens").alias("text_tokens"), F.sum("attachment_tokens").alias("attachment_tokens"),
    )
    return done.select(
        "conv_id", "messages", F.array_join("o.s", "").alias("rendered"), "parts", "attachments", F.array_join("o.ref", "\n").alias("refs"), "text_tokens",
        (F.col("text_tokens") + F.col("attachment_tokens") + FRAME_TOKENS * F.col("messages")).alias("expanded_tokens"),
    )
