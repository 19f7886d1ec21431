"""Line de-duplication in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, UPPER, WHITE, Workspace, join_unique


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Drop from every document the lines that a document with a smaller doc_id holds too.

    A text is split at \\n; a line's key is the line without white space at both ends, A-Z in lower case. A key of at
    least `min_chars` code points that two or more documents hold keeps all its lines in the smallest doc_id and
    loses them everywhere else. Returns the columns of `docs` in `row` (text as it was) with kept_text, n_lines
    (before dropping) and n_dropped.

    Defined cases: a null or empty text is one empty line and stays empty (kept_text ''); a null doc_id counts as one
    document after all others; rows that repeat a doc_id are one document, so they don't make a line repeated, and
    each gets its own text back; other columns, whatever their names, pass through untouched in `row`.

    Keys travel as 128 bits of hash with doc_id and position, never as text. Owners are found by a partially
    aggregated min/max, hot keys are joined by broadcast (see join_unique), and each text is shuffled once, to meet
    the mask of its dropped lines.
    """
    ws = Workspace(docs.sparkSession, "lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"), F.coalesce("row.text", F.lit("")).alias("__text"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    lines = rows.select("__id", "__hash", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    key = F.translate(F.btrim("__line", F.lit(WHITE)), UPPER, UPPER.lower())
    lines = lines.select("__id", "__hash", "__pos", key.alias("__key"))
    long_enough = F.length("__key") >= min_chars
    keyed = ws.stage(lines.select("__id", "__hash", "__pos", F.when(long_enough, F.xxhash64("__key")).alias("__k1"), F.when(long_enough, F.xxhash64(F.lit("line"), "__key")).alias("__k2")), "keys")

    held = keyed.where("__k1 is not null").groupBy("__k1", "__k2").agg(F.min("__id").alias("__owner"), F.max("__id").alias("__last"), F.count(F.lit(1)).alias("__n"))
    owners = ws.stage(held.where("__owner < __last").drop("__last"), "owners")
    found = join_unique(keyed.where("__k1 is not null"), owners, ["__k1", "__k2"], "__n")
    flags = found.select("__id", "__hash", "__pos", F.coalesce(F.col("__owner") != F.col("__id"), F.lit(False)).alias("__drop"))
    flags = flags.unionByName(keyed.where("__k1 is null").select("__id", "__hash", "__pos", F.lit(False).alias("__drop")))
    # one entry for each line of one document; repeats of a whole row fall together
    masks = flags.groupBy("__id", "__hash").agg(F.max("__drop").alias("__any"), F.sort_array(F.collect_set(F.struct("__pos", "__drop"))).alias("__mask"))
    masks = masks.where("__any").select("__id", "__hash", F.col("__mask.__drop").alias("__mask"))

    out = rows.join(masks, ["__id", "__hash"], "left")
    marked = F.zip_with(F.split("__text", "\n"), "__mask", lambda line, drop: F.when(~drop, line))
    return out.select(
        "row",
        F.when(F.col("__mask").isNull(), F.col("__text")).otherwise(F.array_join(marked, "\n")).alias("kept_text"),
        (F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("__mask", lambda drop: drop)), F.lit(0)).cast("long").alias("n_dropped"),
    )
