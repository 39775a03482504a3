"""Operator 13: mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents are dealt to shards and, in a seeded order, laid end to end; each shard's run of words is cut into blocks of equal
size. Seats are blocks: the highest quotients target / (2 k + 1) over all sources win them, and a source's seats go to its shards by the
highest quotients of their words, which gives every (source, shard) a whole quota. A quota takes every block of the shard so many times,
and once more as many as are left over, chosen by a seeded walk over the block numbers. All of it is DataFrame functions.

Sources and shards are never listed in one place: their numbers come from distributed running totals, and of the quotients only those that
can decide a seat are made, at most three a party.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from permlens.functions.hashing import draw
from permlens.llm.common import hidden, order_id, text_of
from permlens.operators.numbering import number_rows
from permlens.operators.spread import spread_join
from permlens.session import written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 21
SEED = "mix"
# Primes of which, for any number of blocks below 2 ** 60, one at least is coprime to it.
STRIDES = (1048583, 1048589, 1048601, 1048609)


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+, counted without a list of them."""
    return F.length(F.translate(F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "w"), " \t\n\x0b\x0c\r", "")).cast("long")


def apportioned(parties: DataFrame, group: list[str], order: str, votes: str, seats: str, total: str, members: str, most: str, name: str) -> DataFrame:
    """Adds the seats each party gets of its group's, by the highest quotients votes / (2 k + 1); equal quotients go by `order`, and no party
    gets more than `most`, so a group all of whose parties are nearly full may be some seats short. `total` are the group's votes and `members` its parties. Between the divisors that give `members` seats too few
    and too many at least, a party has a lowest and a highest number of seats; only the quotients in between are ranked."""
    lowest = F.least(F.col(most), F.greatest(F.lit(0), F.floor(F.col(votes) * (F.col(seats) - F.col(members)) / F.col(total) + 0.5).cast("long")))
    highest = F.least(F.col(most), F.floor(F.col(votes) * (F.col(seats) + F.col(members)) / F.col(total) + 0.5).cast("long"))
    bounded = written(parties.where(F.col(total) > 0).withColumn("_low", lowest).withColumn("_high", highest), "parties")
    sure = bounded.groupBy(*group).agg(F.sum("_low").alias("_sure"))
    contested = bounded.where("_high > _low").select(*group, order, votes, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    quotients = contested.select(*group, order, (F.col(votes) / (2 * F.col("_k") + 1)).alias("_quotient"))
    ranked = number_rows(quotients, group, [F.col("_quotient").desc(), F.col(order)], "_place")
    if group:
        limits = bounded.select(*group, seats).distinct().join(sure, group)
        won = ranked.join(limits, group)
    else:
        limit = bounded.agg(F.max(seats), F.sum("_low")).first()
        won = ranked.withColumn(seats, F.lit(limit[0])).withColumn("_sure", F.lit(limit[1]))
    won = won.where(F.col("_place") <= F.col(seats) - F.col("_sure")).groupBy(*group, order).agg(F.count("*").alias("_won"))
    return bounded.join(won, [*group, order], "left").withColumn(name, F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_low", "_high", "_won")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds weight, target and is_full to sources (number from 1, source_size): shares of all words by weight, at most `most` times a source's
    size, the excess shared again among the others until none is above. Each round is one aggregate over the sources."""
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    table = sources.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size"))
    words, weighing = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (words or 0) / (weighing or 1), None
    while True:
        above = F.col("_cap") <= F.col("weight") * F.lit(level)
        capped, free, n = table.agg(F.sum(F.when(above, F.col("_cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if n == full or not free:
            break
        level, full = (words - capped) / free, n
    return table.select("*", F.when(above, F.col("_cap")).otherwise(F.col("weight") * F.lit(level)).cast("double").alias("target"), above.alias("is_full")).drop("_cap")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, passes and extra of every row: the mix takes the document's words `passes` times and the word
    ranges [start, stop) in `extra` once more. Sources are numbered by code point, null last, and weigh `weights` in turn.

    A source that cannot reach its share is taken `most` times, whole; others come to within about a block a shard of their target. No word is
    taken more than `most` times. A null text has no words and takes part with none; rows without words get nothing. Repeated rows are
    documents of their own, alike in all but their place. The order, and so the choice, depends on seed, id and text alone. Without any
    words all targets are 0; an empty table gives no rows."""
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    sized = docs.select(
        order_id().alias("rank_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), word_count(text_of()).alias("size"),
        draw(seed, F.concat(order_id().cast("string"), F.lit(":"), text_of())).alias("draw"),
    )
    sized = written(sized, "mix-sizes")
    sources = written(number_rows(sized.groupBy("source", "key").agg(F.sum("size").alias("source_size")), [], [F.col("source").asc_nulls_last()], "number"), "mix-sources")
    sources = written(targets(sources, weights, most), "mix-targets")
    words, full, parties = (n or 0 for n in sources.agg(F.sum("source_size"), F.sum(F.when(F.col("is_full"), most * F.col("source_size"))), F.count_if(~F.col("is_full"))).first())
    shards, wanted = max(1, -(-words // shard_words)), words - full

    docs_of = spread_join(sources.drop("source"), sized, ["key"], ["draw"]).select("i.*", "w.number", "w.source_size", "w.target", F.pmod(F.col("draw"), F.lit(shards)).alias("shard"))
    cells = docs_of.groupBy("number", "shard").agg(F.sum("size").alias("words"), F.count("*").alias("n_docs")).where("words > 0")
    cells = written(cells.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long")), "mix-cells")
    per_source = cells.groupBy("number").agg((most * F.sum("blocks")).alias("most_blocks"), F.count("*").alias("n_shards"))
    totals = sources.where("not is_full").join(per_source, "number").withColumn("all_seats", F.lit(round(wanted / block_words)))
    totals = totals.withColumn("all_target", F.lit(float(wanted))).withColumn("all_parties", F.lit(parties))
    granted = apportioned(totals, [], "number", "target", "all_seats", "all_target", "all_parties", "most_blocks", "seats")
    bounded = cells.withColumn("most_of_cell", most * F.col("blocks"))
    shared = bounded.join(granted.select("number", "source_size", "seats", "n_shards"), "number")
    shared = apportioned(shared, ["number"], "shard", "words", "seats", "source_size", "n_shards", "most_of_cell", "quota")
    whole = bounded.join(sources.where("is_full").select("number"), "number").withColumn("quota", F.col("most_of_cell"))
    quotas = shared.select("number", "shard", "blocks", "quota").unionByName(whole.select("number", "shard", "blocks", "quota"))
    luck = draw(seed, F.concat_ws("/", "number", "shard"))
    strides = F.filter(F.array(*map(F.lit, STRIDES)), lambda p: F.col("blocks") % p != 0)
    quotas = quotas.select(
        "number", "shard", "blocks", F.expr("quota div blocks").cast("int").alias("passes"), (F.col("quota") % F.col("blocks")).alias("spare"),
        (luck % F.col("blocks")).alias("first"), F.element_at(strides, (luck % F.size(strides) + 1).cast("int")).cast("long").alias("stride"),
    )

    in_shard = Window.partitionBy("number", "shard").orderBy("draw", "rank_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs_of.withColumn("stop", F.sum("size").over(in_shard)).withColumn("start", F.col("stop") - F.col("size"))
    found = placed.join(quotas, ["number", "shard"], "left")
    touched = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(stop - 1) div {block_words}"))
    chosen = F.filter(touched, lambda b: F.pmod(b * F.col("stride") + F.col("first"), F.col("blocks")) < F.col("spare"))
    ranges = F.transform(chosen, lambda b: F.struct((F.greatest(b * block_words, F.col("start")) - F.col("start")).alias("start"), (F.least((b + 1) * block_words, F.col("stop")) - F.col("start")).alias("stop")))
    extra = F.when((F.col("size") > 0) & (F.col("spare") > 0), ranges).otherwise(F.array().cast("array<struct<start: bigint, stop: bigint>>"))
    return found.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("passes", F.lit(0))).otherwise(0).alias("passes"), extra.alias("extra"))


def taken(mix: DataFrame) -> DataFrame:
    """Adds the words the mix takes of each document, repeats counted."""
    extra = F.aggregate("extra", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return mix.withColumn("taken", F.col("passes") * F.col("size") + extra)


def texts(mix: DataFrame, docs: DataFrame) -> DataFrame:
    """The mix itself: doc_id and a text for every pass over a document and for every extra range of its words, words joined by one space.
    Documents are found again by their id, which must be theirs alone."""
    words, whole = hidden("words"), F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))
    ranges = F.concat(F.array_repeat(whole, F.col("passes")), F.col("extra"))
    split = F.filter(F.split(text_of(), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    joined = mix.join(docs.select("doc_id", split.alias(words)), "doc_id").withColumn("range", F.explode(ranges)).where("range.stop > range.start")
    piece = F.slice(words, (F.col("range.start") + 1).cast("int"), (F.col("range.stop") - F.col("range.start")).cast("int"))
    return joined.select("doc_id", F.array_join(piece, " ").alias("text"))
