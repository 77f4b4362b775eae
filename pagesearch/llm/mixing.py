"""Mix sources to target weights: equal-token blocks apportioned by highest quotients (Sainte-Lague).

Each source's target is met by whole blocks. Blocks go to sources, and then from each source to its
shards, by the highest quotients weight / (2k - 1); what a cap cuts off is dealt again. A shard takes its quota
from its documents in a seeded order, starting over when the quota is more than it has. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesearch.llm.common import SPACE, let, words_of
from pagesearch.session import materialize

WEIGHTS = (5, 2, 1)     # of the sources in order, repeating
SHARE = 1.5             # words of the mix, as a share of all words
REPEAT = 2              # most times that a source, shard or document is taken
SEED = 20240229
ROWS_PER_SHARD, MOST_SHARDS = 2_000, 20_000
MOST_BLOCK_WORDS = 256
BLOCKS_PER_SHARD = 64   # at least, on average, in a source's shards; as far as they hold so many words


def sainte_lague(parties: DataFrame, houses: DataFrame) -> DataFrame:
    """Integer ``seats`` of each ``(house, party)`` with a weight over 0, by highest quotients.

    ``parties(house, party, weight)``, ``houses(house, seats)``. A party's k-th seat has the quotient
    weight / (2k - 1); equal quotients go to the smaller party. Only seats near the cut are ranked: with n
    parties and divisor W / (seats - n/2) no more seats than there are can be sure, and with
    W / (seats + n/2) no further seat can win, so that at most a few seats per party remain between.
    """
    live = parties.where("weight > 0")
    per_house = live.groupBy("house").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("n")).join(houses, "house")
    spare = F.col("seats") - F.col("n") / 2

    def rounded(weight: Column, seats: Column) -> Column:
        return F.floor(weight * seats / F.col("all") + 0.5)

    bounded = live.join(per_house, "house").select(
        "house", "party", "weight", "seats",
        # one seat of slack on both sides for the rounding of doubles
        F.when(spare > 0, F.greatest(rounded(F.col("weight"), spare) - 1, F.lit(0))).otherwise(F.lit(0)).alias("sure"),
        (rounded(F.col("weight"), F.col("seats") + F.col("n") / 2) + 1).alias("most"))
    open_seats = bounded.groupBy("house").agg((F.first("seats") - F.sum("sure")).alias("open"))
    contest = bounded.select("house", "party", "weight", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("k"))
    rank = F.row_number().over(Window.partitionBy("house").orderBy((F.col("weight") / (2 * F.col("k") - 1)).desc(), "party", "k"))
    won = (contest.withColumn("rank", rank).join(open_seats, "house").where("rank <= open")
           .groupBy("house", "party").agg(F.count(F.lit(1)).alias("won")))
    return (bounded.join(won, ["house", "party"], "left")
            .select("house", "party", (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("seats")))


def bounded_words(parties: DataFrame, houses: DataFrame) -> DataFrame:
    """``house, party, words``: the words of each house dealt to its parties by seats, none above its cap.

    ``parties(house, party, weight, cap)``, ``houses(house, words, block)``, caps and words whole. A seat is a block;
    what a cap cuts off, and what is left of the words, goes by seats of one word to the room below the caps.
    With no more words than room, the k-th word of a party wins only while k is at most its room, so all words of
    a house are dealt unless its caps hold fewer.
    """
    seats = sainte_lague(parties.select("house", "party", "weight"),
                         houses.select("house", F.floor(F.col("words") / F.col("block")).alias("seats")))
    given = materialize(parties.join(houses, "house").join(seats, ["house", "party"], "left").select(
        "house", "party", "cap", F.col("words").alias("all_words"),
        F.least(F.coalesce("seats", F.lit(0)) * F.col("block"), F.col("cap")).alias("given")), "mix-given")
    short = given.groupBy("house").agg(F.least(F.first("all_words") - F.sum("given"), F.sum(F.col("cap") - F.col("given")))
                                       .alias("seats")).where("seats > 0")
    more = sainte_lague(given.select("house", "party", (F.col("cap") - F.col("given")).cast("double").alias("weight")), short)
    return given.join(more, ["house", "party"], "left").select(
        "house", "party", (F.col("given") + F.coalesce("seats", F.lit(0))).alias("words"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source_key, source_size, target, party`` of ``sizes(source_key, source_size)``, a row per source.

    A target is min(REPEAT * size, level * weight) with one level for all sources, such that the targets
    sum to SHARE of all words. Sources in order of REPEAT * size / weight stop at their cap one after
    the other. The windows run over one row per source.
    """
    in_order = Window.orderBy("source_key")
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    party = F.row_number().over(in_order) - 1
    named = sizes.withColumn("party", party.cast("long")).withColumn(
        "weight", F.get(weights, (F.col("party") % len(WEIGHTS)).cast("int"))).withColumn(
        "cap", F.col("source_size") * float(REPEAT))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * SHARE
    before = named.withColumns({
        "level": (budget - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))})
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    # levels fall behind the first source that is not capped, whose level holds for all
    level = F.max(F.when(~capped, F.col("level"))).over(everything)
    return before.withColumn("final", level).select(
        "source_key", "source_size", "party",
        F.when(capped | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, carried: list[str], seed: int = SEED, rows: int | None = None) -> DataFrame:
    """The ``carried`` columns of every row with ``size, source_size, target, taken``.

    ``docs(doc_id, text, source)``. A null text has no words, takes none, and a null source is a source of
    its own, last in order. A row's order within its source's shard is a hash of seed, id and text, so
    reruns agree; equal rows are interchangeable. No rows give no rows. ``carried`` may name any columns.
    """
    rows = docs.count() if rows is None else rows
    shards = min(MOST_SHARDS, max(1, rows // ROWS_PER_SHARD))
    source = F.col("source").cast("string")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"),
        F.size(words_of(F.col("text").cast("string"))).cast("long").alias("size"),
        F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source)).alias("source_key"),
        order.alias("_order"), F.pmod(F.xxhash64(F.lit("shard"), order), F.lit(shards)).alias("shard"))
    held = materialize(sized.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size")), "mix-shards")
    sources = materialize(targets(held.groupBy("source_key").agg(F.sum("shard_size").alias("source_size"))), "mix-targets")
    wanted = sources.agg(F.sum("target").alias("t")).first().t or 0.0
    block = int(min(MOST_BLOCK_WORDS, max(1, wanted // 1_000_000)))

    by_source = materialize(bounded_words(
        sources.select(F.lit(0).alias("house"), "party", F.col("target").alias("weight"),
                       (F.col("source_size") * REPEAT).alias("cap")),
        sources.groupBy().agg((F.round(F.sum("target") / block) * block).cast("long").alias("words"))
        .select(F.lit(0).alias("house"), "words", F.lit(block).alias("block")))
        .select(F.col("party").alias("house"), "words"), "mix-sources")
    shares = held.join(sources, "source_key")
    # a source with few words has smaller blocks, so that its shards are taken evenly
    parts = shares.groupBy(F.col("party").alias("house")).agg(F.count(F.lit(1)).alias("n"))
    by_shard = bounded_words(
        shares.select(F.col("party").alias("house"), F.col("shard").alias("party"),
                      F.col("shard_size").cast("double").alias("weight"), (F.col("shard_size") * REPEAT).alias("cap")),
        by_source.join(parts, "house").select("house", "words", F.least(F.lit(block), F.greatest(
            F.lit(1), F.floor(F.col("words") / (F.col("n") * BLOCKS_PER_SHARD)))).alias("block")))
    quotas = materialize(shares.join(by_shard, (shares["party"] == by_shard["house"])
                                     & (shares["shard"] == by_shard["party"]), "left").select(
        "source_key", "shard", "source_size", "target", "shard_size", F.coalesce("words", F.lit(0)).alias("quota")), "mix-quotas")

    before = (Window.partitionBy("source_key", "shard").orderBy("_order", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rounds = F.floor(F.col("quota") / F.greatest("shard_size", F.lit(1)))
    rest = F.col("quota") - rounds * F.col("shard_size")
    part = F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("size"))
    return placed.join(quotas, ["source_key", "shard"]).select(
        "_row.*", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def op4_source_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs, ["doc_id"])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as it is taken whole, and once cut after its last taken word.

    All columns of ``docs`` stay; ``n_chars`` follows the text where it exists.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text", "source")
    taken = mix(inner, ["_doc"])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(F.lit(0))
    cut = F.when(F.col("size") > 0, F.col("taken") % F.greatest("size", F.lit(1))).otherwise(F.lit(0))
    text = F.col("_doc.text")
    # pieces: each word with the white space after it, behind any white space that starts the text
    starts = F.split(text, rf"(?<=[{SPACE}])(?=[^{SPACE}])", -1)
    head = let(starts, lambda p: F.array_join(F.slice(
        p, 1, F.col("_cut").cast("int") + F.when(F.get(p, F.lit(0)).rlike(rf"^[{SPACE}]*$"), 1).otherwise(0)), ""))
    times = taken.select("_doc", cut.alias("_cut"), F.explode(F.flatten(F.array(
        F.array_repeat(F.lit(False), whole.cast("int")),
        F.array_repeat(F.lit(True), F.when(cut > 0, 1).otherwise(0))))).alias("_partly"))
    shown = times.select("_doc", F.when(F.col("_partly"), F.regexp_replace(head, rf"[{SPACE}]+$", "")).otherwise(text)
                         .alias("_text"))
    return shown.select(*[
        F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
