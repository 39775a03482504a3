"""A labelled corpus of any size for scale runs: one document per number, every draw from its key, so a larger corpus contains a smaller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.functions.hashing import draw, one_of

SUBJECTS = ("The intake desk", "The routing team", "The billing crew", "The archive group", "The field office")
VERBS = ("checks", "moves", "renews", "closes", "reviews")
OBJECTS = ("the open orders", "the cold store", "the spare keys", "the weekly report", "the access list")
TIMES = ("before noon", "after each release", "every ten days", "when the queue is empty", "during the night shift")
HEADINGS = ("Purpose", "Steps", "Limits", "Owners", "History", "Checks", "Contacts")
SENTENCE_WORDS = 9


def sentence(key: Column) -> Column:
    return F.concat(
        F.concat_ws(" ", one_of("g1", key, *SUBJECTS), one_of("g2", key, *VERBS), one_of("g3", key, *OBJECTS), one_of("g4", key, *TIMES)), F.lit(".")
    )


def section(key: Column) -> Column:
    """A heading and its sentences in paragraphs of five; one section in ten is long enough to be split."""
    words = F.when(draw("long", key) % 10 == 0, 420 + draw("words", key) % 281).otherwise(40 + draw("words", key) % 161)
    count = F.ceil(words / SENTENCE_WORDS).cast("int")
    said = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(sentence(F.concat_ws(":", key, i.cast("string"))), F.when(i % 5 == 0, "\n\n").otherwise(" ")))
    return F.concat(F.lit("## "), one_of("heading", key, *HEADINGS), F.lit("\n\n"), F.array_join(said, ""))


def labelled_corpus(numbers: DataFrame, seed: str) -> DataFrame:
    """(number) to labelled documents: 15 % public, 60 % internal, 15 % confidential, 10 % restricted; 15 % limited to a department; 2 % to
    either project; 10 % of a second tenant; three to seven sections."""
    key = F.col("key")
    none = F.expr("cast(array() as array<string>)")
    c, p = draw("gclass", key) % 100, draw("gproj", key) % 100
    sections = F.transform(
        F.sequence(F.lit(1), (draw("sections", key) % 5 + 3).cast("int")), lambda i: section(F.concat_ws("/", key, i.cast("string")))
    )
    return (
        numbers.withColumn("key", F.concat(F.lit(f"{seed}-"), F.lpad(F.col("number").cast("string"), 9, "0")))
        .withColumn("tenant_id", F.when(draw("gtenant", key) % 100 < 10, "external").otherwise("northstar"))
        .withColumn("classification", F.when(c < 15, "public").when(c < 75, "internal").when(c < 90, "confidential").otherwise("restricted"))
        .withColumn(
            "allowed_departments", F.when(draw("gdept?", key) % 100 < 15, F.array(one_of("gdept", key, "engineering", "support", "sales"))).otherwise(none)
        )
        .withColumn(
            "required_projects",
            F.when(F.col("tenant_id") != "northstar", none).when(p < 2, F.array(F.lit("atlas"))).when(p < 4, F.array(F.lit("borealis"))).otherwise(none),
        )
        .withColumn("content", F.concat(F.lit("# Notes "), F.col("number").cast("string"), F.lit("\n\n"), F.array_join(sections, "\n\n")))
    )
