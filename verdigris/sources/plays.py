"""Splitting an e-book of collected works into sonnets, plays and scenes.

Text in, rows out; every step is a projection or a window over the pieces of
one text, so many books are split side by side.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What opens a section. The chorus marker, followed by a line start that can't
#: be there, never matches; it is left out, with the same result.
MARKER = r"INDUCTION\.|(?:PRO|EPI)LOGUE\.\n|SCENE ([1-9VXI]+)\.?\s+|ACT ([VI]+)"
OPEN, SHUT = "\x01", "\x02"
STRIP = r"^\s+|\s+$"


def _from(text: Column, mark: str, skip: int = 0) -> Column:
    """The text from the first ``mark`` on, less ``skip`` characters; all of it without the mark."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + skip, F.length(text))).otherwise(text)


def split_book(book: DataFrame, text: str = "text") -> DataFrame:
    """``(sonnets, plays)``: the sonnets lie between the second heading of that
    name and the first THE END after it, the plays from there to the trailer."""
    t, head = F.col(text), "THE SONNETS"
    start = F.expr(f"locate('{head}', `{text}`, instr(`{text}`, '{head}') + {len(head)})")
    rows = book.withColumn("__s", start + len(head)).withColumn("__e", F.expr(f"locate('THE END', `{text}`, __s)"))
    rows = rows.withColumn("__t", F.instr(t, "*** END OF THE PROJECT GUTENBERG EBOOK"))
    end = F.when(F.col("__t") > 0, F.col("__t")).otherwise(F.length(t) + 1)
    return rows.select(F.substring(t, F.col("__s"), F.col("__e") - F.col("__s")).alias("sonnets"), F.substring(t, F.col("__e") + 8, end - F.col("__e") - 8).alias("plays"))


def parse_sonnets(texts: DataFrame, text: str = "sonnets") -> DataFrame:
    """``(number, text)``: every number is the heading of what follows it. Texts
    without a number have no sonnets."""
    marked = F.split(F.regexp_replace(text, r"(\d+)", f"{OPEN}$1{SHUT}"), OPEN)
    pieces = texts.select(F.posexplode(marked).alias("pos", "piece")).where("pos > 0")
    cut = F.split("piece", SHUT, 2)
    return pieces.select(cut[0].cast("int").alias("number"), F.regexp_replace(cut[1], STRIP, "").alias("text"))


def slice_plays(texts: DataFrame, titles: DataFrame, text: str = "plays") -> DataFrame:
    """``(title, text)``: from the first occurrence of each title (``titles``: idx,
    title, in the order of the book) to that of the next."""
    found = texts.select(F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__book")).crossJoin(F.broadcast(titles.select("idx", "title")))
    found = found.withColumn("__at", F.expr("instr(__text, title)"))
    after = F.lead("__at").over(Window.partitionBy("__book").orderBy("idx"))
    end = F.coalesce(after, F.length("__text") + 1)
    return found.withColumn("__end", end).where("__at > 0").select("title", F.substring(F.col("__text"), F.col("__at"), F.col("__end") - F.col("__at")).alias("text"))


def body(text: Column, title: Column) -> Column:
    """A play's text after its front matter. With a table of contents it begins
    at the first prologue, or without one at the second heading of act one; a work without acts
    begins after its title."""
    contents, prologue = F.instr(text, "Contents") > 0, F.instr(text, "PROLOGUE.") > 0
    return (
        F.when(contents & prologue, _from(text, "PROLOGUE."))
        .when(contents, _from(_from(text, "ACT I\n", 6), "ACT I"))
        .when(F.instr(text, "ACT") == 0, F.substring(text, F.instr(text, title) + F.length(title), F.length(text)))
        .otherwise(text)
    )


def sections(plays: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """``(title, pos, act, name, text)`` of marked-up texts: each marker but that
    of an act opens a section that ends at the next marker of any kind; an act
    holds until the next. Text before the first marker, and between an act's
    heading and the next marker, is dropped."""
    marked = F.split(F.regexp_replace(text, MARKER, f"{OPEN}$0{SHUT}"), OPEN)
    pieces = plays.select(F.col(title).alias("title"), F.posexplode(marked).alias("pos", "piece")).where("pos > 0")
    cut = F.split("piece", SHUT, 2)
    pieces = pieces.select("title", "pos", cut[0].alias("mark"), cut[1].alias("text")).withColumn("heading", F.when(F.col("mark").startswith("ACT"), F.regexp_extract("mark", "ACT ([IV]+)", 1)))
    running = Window.partitionBy("title").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    act = F.coalesce(F.last("heading", ignorenulls=True).over(running), F.lit(""))
    name = F.when(F.col("mark").startswith("SCENE"), F.regexp_extract("mark", "SCENE ([IVX1-9]+)", 1)).otherwise(F.regexp_extract("mark", "^([A-Z]+)", 1))
    return pieces.select("title", "pos", act.alias("act"), name.alias("name"), "text", "heading").where("heading IS NULL").drop("heading")


def parse_plays(plays: DataFrame) -> DataFrame:
    """``(title, pos, act, name, text)`` of whole plays (title, text); a work without acts is one
    section without a name."""
    whole = F.col("text")
    special = (F.instr(whole, "ACT") == 0) & (F.instr(whole, "Contents") == 0)
    bare = plays.where(special).select("title", F.lit(0).alias("pos"), F.lit("").alias("act"), F.lit("").alias("name"), F.regexp_replace(body(whole, F.col("title")), STRIP, "").alias("text"))
    acted = sections(plays.where(~special).select("title", body(whole, F.col("title")).alias("text")))
    return acted.unionByName(bare)


def paths(scenes: DataFrame) -> DataFrame:
    """``scenes`` with ``folder`` and ``file``; of several with one path the last stays."""
    folder = F.translate(F.replace(F.lower("title"), F.lit(" "), F.lit("-")), "’:,", "")
    file = F.when((F.col("act") != "") & (F.col("name") != ""), F.concat(F.lit("ACT-"), "act", F.lit("-SCENE-"), "name")).when(F.col("name") != "", F.col("name")).otherwise(F.col("folder"))
    named = scenes.withColumn("folder", folder).withColumn("file", F.concat(file, F.lit(".txt")))
    last = Window.partitionBy("folder", "file").orderBy(F.desc("pos"))
    return named.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def write_scenes(scenes: DataFrame, path: str) -> None:
    """Parquet, a folder a title."""
    paths(scenes).write.partitionBy("folder").mode("overwrite").parquet(path)


def main() -> None:
    """python -m verdigris.sources.plays BOOK TITLES OUT: split a book, whose plays'
    titles TITLES lists line by line, into tables below OUT."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    for name in ("book", "titles", "out"):
        parser.add_argument(name)
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    book = split_book(spark.read.text(args.book, wholetext=True).withColumnRenamed("value", "text"))
    lines = spark.read.text(args.titles, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("idx", "title")).where("title <> ''")
    parse_sonnets(book).write.mode("errorifexists").parquet(f"{args.out}/sonnets")
    write_scenes(parse_plays(slice_plays(book, lines)), f"{args.out}/plays")


if __name__ == "__main__":
    main()
