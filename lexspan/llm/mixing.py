"""Mixing sources to target weights by exact cuts in a hash-random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, join_unique, ranked, word_count

#: Sources in code-point order weigh 1, 2, 3, 1, 2, 3 ...; no source is taken more than MAX_EPOCHS times.
WEIGHTS = 3
MAX_EPOCHS = 3
#: Ranges of the random key for each shuffle partition (hashing spreads them evenly), and the fewest documents of one.
RANGES, RANGE_ROWS = 8, 64


def water_level(sources: DataFrame) -> float:
    """Words for each unit of weight, once every source whose share exceeds MAX_EPOCHS times its size is held there.

    Only two sums come to the driver in each round; the level rises until no further source is held.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        held = F.lit(MAX_EPOCHS) * F.col("source_size") < F.lit(level) * F.col("weight")
        fixed, free = sources.agg(F.coalesce(F.sum(F.when(held, MAX_EPOCHS * F.col("source_size"))), F.lit(0)), F.sum(F.when(~held, F.col("weight")))).first()
        new = (total - fixed) / free if free else level
        if new <= level or not free:
            return max(level, 0.0)
        level = new


def mix_sources(docs: DataFrame, seed: str = "mix", with_text: bool = False) -> DataFrame:
    """How many words of each document the mixture takes.

    Size: words of the text (null: 0). Sources by code point, null last, weigh 1, 2, 3, repeating, and share 100 % of
    all sizes; a target stops at three times its source's size and the excess is shared again by weight. Documents
    of a source are put in the order of md5(seed:doc_id); whole epochs are taken while they fit, then the order is
    cut where the budget (the target's whole words) ends, inside a document if need be. Returns the columns of `docs`
    in `row` (text only if `with_text`), with size, source_size, target, epochs (whole copies), part (words of one more
    copy) and taken.

    Defined cases: empty tables give no rows; texts without words have size 0 and taken 0; a null source is a source of
    its own; rows without a doc_id are ordered by their texts' md5; repeated rows are each a document; ties in the order
    go by doc_id, then size. The same rows give the same result in any partitioning.

    The order is range-sorted by equal-width ranges of the uniform key, RANGES times as many as there are shuffle partitions
    (their number changes no result), so a hot source is spread over as many tasks as it needs; prefix sums add the sums
    of the ranges before.
    """
    ws = Workspace(docs.sparkSession, "mix")
    kept = [c for c in docs.columns if with_text or c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text").alias("__text"))
    size = word_count(F.col("__text"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("__text", F.lit("")))))))
    sized = ws.stage(rows.select("row", size.alias("size"), key.alias("__key"), F.coalesce(F.concat(F.lit("s"), "row.source"), F.lit("t")).alias("__source")), "sized")
    return _cut(ws, sized, ws.stage(sized.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs")), "sources"))


def _cut(ws: Workspace, sized: DataFrame, sources: DataFrame) -> DataFrame:
    sources = ranked(ws, sources, [F.col("__source")], "__rank").withColumn("weight", F.col("__rank") % WEIGHTS + 1).drop("__rank")
    sources = ws.stage(sources, "weighted")
    level = water_level(sources)
    total = sources.agg(F.sum("__docs")).first()[0] or 0
    per = max(RANGE_ROWS, -(-total // (RANGES * int(ws.spark.conf.get("spark.sql.shuffle.partitions")))))
    share = F.least((MAX_EPOCHS * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    sources = sources.withColumn("target", share).withColumn("__ranges", F.ceil(F.col("__docs") / per))
    rows = join_unique(sized, sources, ["__source"], "__docs", "inner")
    place = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__range", F.floor(place * F.col("__ranges") / F.lit(2**32)))
    sums = rows.groupBy("__source", "__range").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("__source", "__range", (F.sum("__sum").over(before) - F.col("__sum")).alias("__base"))
    inside = Window.partitionBy("__source", "__range").orderBy("__key", F.col("row.doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__run", F.sum("size").over(inside) - F.col("size")).join(sums, ["__source", "__range"])
    budget, whole = F.floor("target"), F.greatest("source_size", F.lit(1))
    rows = rows.withColumn("epochs", F.floor(budget / whole).cast("long")).withColumn("__rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__base") - F.col("__run"))).cast("long")
    return rows.withColumn("part", part).select("row", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself, with the columns of `docs`: each document as many times as it is taken.

    A document at its source's cut comes with its first words only, those the budget still holds; n_chars, where the
    table has it, follows. Documents of which nothing is taken are left out, and so are null texts and texts without words;
    null ids and sources, repeated rows and clashing column names are as in mix_sources; an empty table gives no rows.
    """
    mixed = mix_sources(docs, seed, with_text=True)
    text = F.col("row.text")
    words = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("part").cast("int")), "")
    whole = mixed.where("epochs > 0 and size > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("__copy"), text.alias("__text"))
    more = mixed.where("part > 0").select("row", F.lit(0).cast("long").alias("__copy"), F.when(F.col("part") < F.col("size"), cut).otherwise(text).alias("__text"))
    replaced = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return whole.unionByName(more).select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
