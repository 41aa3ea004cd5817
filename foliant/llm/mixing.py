"""Mixing sources to target weights with a golden-ratio schedule.

Each source's documents, shuffled by hash and laid end to end, are cut into blocks of equal words, the
source's own size of block, and the source weighs as many slots of the mix as its target takes. Slot i stands at
the i-th point of a golden-ratio lattice, and the cumulative weights (in slots) say whose interval that point falls
into. The lattice has a point for each slot and visits each once, so that a source gets exactly its
slots; and as golden-ratio points fill every interval evenly, every run of slots holds each source in its target
share but for a few slots. A source's slots are ranked in the order of the mix: rank r takes block r, beyond the last block
the source repeats, and the last takes only what is left of the target. So every source, however small beside
the others, takes its target to the word. Beyond the targets all is integer arithmetic: reruns agree.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stash, table, with_uid
from .lines import positions

#: Of the sources by code point, null last, in turn.
WEIGHTS = (5, 2, 1)
#: Words that the mix takes, as a share of all words, and the most a source may repeat.
SHARE, REPEATS = 1.5, 2
#: About the slots of the large sources together, the slots that a smaller source has nevertheless, and the least words of a block.
SLOTS, OWN_SLOTS, LEAST_BLOCK = 1 << 18, 64, 16
#: Slots that one row lays out.
RUN = 1 << 12


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, target): words that the mix is to take of each source.

    Takes (source, source_size). The total is shared by weight; a share above ``repeats`` times the source's
    size stops there, and the excess is shared again by weight until none is above. In closed form:
    with sources in order of cap over weight, those are capped whose ratio is at most the level
    that the rest of the total gives the rest of the weights.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = weighed.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    capped = level.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    # capped sources come first; the first that is not capped has the level of all that follow
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    return capped.withColumn("final", final).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final"))).alias("target"))


def blocks_of(goals: DataFrame, block: int) -> DataFrame:
    """Adds to (source, source_size, target): ``own``, the words of a block, ``blocks`` of one pass, ``passes`` that are whole, ``rest`` words of the last, ``slots``.

    A block has ``block`` words, but at most a share of the source's target (LEAST_BLOCK words in any case).
    """
    words = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    sized = goals.withColumn("words", words).withColumn("own", F.least(F.lit(block), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("words") / OWN_SLOTS))).cast("long"))
    filled = F.greatest("source_size", F.lit(1))
    whole = sized.withColumn("blocks", F.expr("(source_size + own - 1) DIV own")).withColumn("passes", F.floor(F.col("words") / filled).cast("long")).withColumn("rest", F.col("words") % filled)
    return whole.withColumn("slots", F.col("passes") * F.col("blocks") + F.expr("(rest + own - 1) DIV own")).drop("words")


def lattice(total: int) -> tuple[int, int]:
    """Step and inverse step of the golden-ratio lattice of ``total`` points: slot i stands at point i * step modulo total."""
    step = next(s for d in range(total + 1) for s in (round(total * 0.6180339887498949) + d,) if gcd(s, total) == 1)
    return step % total, pow(step, -1, total) if total > 1 else 0


def schedule(plan: DataFrame, total: int, run: int = RUN) -> DataFrame:
    """(slot, rank, *columns of plan): which source each slot of the mix takes from, and how many slots it had before.

    Takes plan (source, slots, ...), ``total`` slots in all. A source's interval of points begins where the slots of the sources before it end.
    """
    _, back = lattice(max(1, total))
    before = F.coalesce(F.sum("slots").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = plan.where("slots > 0").withColumn("begin", before).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) DIV {run}"))))
    points = parts.repartition("source", "part").withColumn("point", F.explode(F.sequence(F.col("begin") + F.col("part") * run, F.col("begin") + F.least((F.col("part") + 1) * run, F.col("slots")) - 1)))
    slot = F.expr(f"CAST(CAST(point AS DECIMAL(18, 0)) * {back} % {max(1, total)} AS BIGINT)")
    told = points.select(slot.alias("slot"), *plan.columns).withColumn("uid", F.col("slot")).withColumn("one", F.lit(1).cast("long"))
    return positions(told, "source", F.col("slot") * F.lit((1 << 63) // max(1, total) - 1), "one", "rank", total).drop("uid", "one")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, slots: int = SLOTS, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """What the mix takes of every row, and the mix itself.

    First: (uid, key, source, size, source_size, target, taken) for every row; ``taken`` counts the words of the
    second, with repeats, and never exceeds ``repeats`` times the size. Second: (slot, source, block, epoch, uid, size,
    begin, length): the words of documents that each slot takes, in words from the document's begin. uid numbers the
    rows as with_uid() does. A null or empty text has size 0, a null source is a source, repeated rows count
    each, ties in the shuffle go by row number, a very long text is cut into as many blocks as it fills, an empty table gives empty results. Other columns are not read, so their names do not matter.
    What is reckoned for sources alone (targets, first points) takes one task a row for each distinct source.

    Texts are read once, for their sizes; what is shuffled has a few numbers a row. Places on a source's
    line come from sums over parts (lines.positions), so that a hot source is spread over many tasks.
    """
    sized = stash(with_uid(docs.select(docs[key].alias("key"), docs[source].cast("string").alias("source"), n_words_of(docs, text).alias("size"))))
    stats = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    total = int(stats[0] * share)
    block = max(LEAST_BLOCK, -(-total // slots))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    plan = stash(blocks_of(goals, block))
    slotted = schedule(plan.select("source", "slots", "own", "blocks", "passes", "rest"), plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    # the last pass ends where the target is reached
    slotted = slotted.select("slot", "source", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank DIV blocks").alias("epoch"), F.when(F.expr("rank DIV blocks") == F.col("passes"), F.col("rest")).alias("until"))
    # by key: the same mix however the table is split; rows without a key are told apart by number
    spread = F.xxhash64("key", "size", F.when(F.col("key").isNull(), F.col("uid")))
    placed = positions(sized.where("size > 0"), "source", spread, "size", "line", stats[1])
    placed = placed.join(plan.select(F.col("source").alias("s"), "own"), F.col("source").eqNullSafe(F.col("s")))
    cut = placed.withColumn("block", F.explode(F.sequence(F.expr("line DIV own"), F.expr("(line + size - 1) DIV own"))))
    begin = F.greatest("line", F.col("block") * F.col("own"))
    pieces = cut.select("uid", "size", F.col("source").alias("of"), F.col("block").alias("at"), "line", begin.alias("from"), F.least(F.col("line") + F.col("size"), (F.col("block") + 1) * F.col("own")).alias("to"))
    met = slotted.join(pieces, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).withColumn("to", F.least("to", "until"))
    mixed = met.where(F.col("to") > F.col("from")).select("slot", "source", "block", "epoch", "uid", "size", (F.col("from") - F.col("line")).alias("begin"), (F.col("to") - F.col("from")).alias("length"))
    got = mixed.groupBy(F.col("uid").alias("u")).agg(F.sum("length").alias("got"))
    rows = sized.join(got, F.col("uid") == F.col("u"), "left").join(plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")), "left")
    taken = rows.select("uid", F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    return taken, mixed


def n_words_of(docs: DataFrame, text: str):
    return n_words(text) if dict(docs.dtypes)[text] == "string" else F.lit(0).cast("long")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")
