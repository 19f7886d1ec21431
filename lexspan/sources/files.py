"""File sources: gazetteer TSV, manual source lists, request logs, saved HTML trees, PDF text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import clean_place
from ..schema import TABLES

#: Two-digit state codes of place ids, for files without the state's own column.
STATE_OF_FIPS = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE", "11": "DC", "12": "FL", "13": "GA", "15": "HI", "16": "ID", "17": "IL", "18": "IN", "19": "IA", "20": "KS",
    "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN", "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM", "36": "NY", "37": "NC",
    "38": "ND", "39": "OH", "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA", "54": "WV", "55": "WI", "56": "WY",
    "60": "AS", "66": "GU", "69": "MP", "72": "PR", "78": "VI",
}


def gazetteer(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Places of a tab-separated gazetteer file; rows without an id, a position or a state are left out.

    Headers and values are trimmed, missing numbers count as absent, population defaults to 0.
    """
    raw = spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip().upper() for c in raw.columns])
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    states = F.create_map(*[F.lit(x) for kv in STATE_OF_FIPS.items() for x in kv])
    geoid = pick("GEOID", "GEOID_LC")
    rows = raw.select(
        geoid.alias("fips"), clean_place(F.coalesce(pick("NAME"), F.lit(""))).alias("name"), F.coalesce(pick("USPS"), F.try_element_at(states, F.left(geoid, F.lit(2)))).alias("state"), F.lit(kind).alias("type"),
        pick("INTPTLAT").try_cast("double").alias("lat"), pick("INTPTLONG", "INTPTLON").try_cast("double").alias("lng"), F.coalesce(pick("POP", "POPPT", "ESTIMATESBASE2020").try_cast("bigint"), F.lit(0)).alias("pop"),
    )
    return rows.where("fips is not null and lat is not null and lng is not null and state is not null")


def json_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A JSON array file (registry, census places, manual sources) with the table's schema."""
    return spark.read.schema(TABLES[table]).json(path, multiLine=True)


def manual_documents(sources: DataFrame) -> DataFrame:
    """A row for each document of each manual source; section ids are 'document:section'."""
    return sources.select("id", "sourceUrl", F.posexplode("documents").alias("ord", "d")).select(F.col("id").alias("jurisdiction_id"), "ord", F.col("d.id").alias("document_id"), F.col("d.title").alias("title"), F.col("d.url").alias("url"), F.col("d.format").alias("format"))


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; corrupt lines are skipped."""
    return spark.read.schema(TABLES["request_log"]).json(path, mode="DROPMALFORMED").where("ts is not null")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def html_tree(spark: SparkSession, root: str) -> DataFrame:
    """Saved section pages below root/<jurisdiction>/...: jurisdiction_id, path, html."""
    pages = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html").select("value", F.input_file_name().alias("file"))
    inside = F.regexp_extract("file", r"^.*?" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + r"/([^/]+)/(.+)\.html$", 1)
    return pages.select(inside.alias("jurisdiction_id"), F.regexp_extract("file", r"^.*?" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + r"/([^/]+)/(.+)\.html$", 2).alias("path"), F.col("value").alias("html"))


HEADING = re.compile(r"^([A-Z])\.\s+(.+)$", re.M)
#: An introduction before the first heading counts from so many characters on.
MIN_INTRO = 50


def lettered_sections(text: str) -> list[tuple[str, str, str]]:
    """(letter, heading, body) of a text with 'A. Heading' lines; contents lines (leaders and a page number) are no headings."""
    marks = [m for m in HEADING.finditer(text) if not re.search(r"\.{3,}\s*\d+\s*$|\s\d+\s*$", m[2])]
    found = []
    intro = text[: marks[0].start()] if marks else text
    if len(intro.strip()) > MIN_INTRO:
        found.append(("", "Introduction", intro.strip()))
    for m, after in zip(marks, [*marks[1:], None]):
        found.append((m[1], m[2].strip(), text[m.end() : after.start() if after else len(text)].strip()))
    return found


@udtf(returnType="letter string, heading string, body string")
class LetteredSections:
    """Table function over the text of a document: from lateral lettered_sections(text)."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str]]:
        yield from lettered_sections(text or "")


def register(spark: SparkSession) -> None:
    spark.udtf.register("lettered_sections", LetteredSections)
