"""Saved contents (`_toc.json`) with their section files, and section documents in XML, to rows and back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import escape_xml, identifier, slug_of_number, strip_html, temporal_id
from ..operators import tree
from ..staging import Workspace

#: Subdivisions of a section, from the outside in.
SUBDIVISIONS = ("subsection", "paragraph", "subparagraph", "clause", "subclause", "item")


def contents(saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of saved contents (jurisdiction_id, toc: JSON of any depth), and the problems: (jurisdiction_id, problem) for texts that
    are no JSON or have no nodes.

    Nodes: jurisdiction_id, path, slug, parent_path, level, num and heading ('' where absent), has_content, depth and sort_order
    (place in a walk). JSON is kept as a variant; a level's children are exploded at a time, and only they go on.
    """
    ws = Workspace(saved.sparkSession, "contents")
    get = lambda v, f, kind="string": F.try_variant_get(v, f"$.{f}", kind)
    given = ws.stage(saved.select("jurisdiction_id", F.try_parse_json("toc").alias("v")), "parsed")
    children = F.try_variant_get("v", "$.children", "array<variant>")
    problem = F.when(F.col("v").isNull(), "corrupt contents").when(F.coalesce(F.size(children), F.lit(0)) <= 0, "empty contents")
    level = given.select("jurisdiction_id", F.lit(None).cast("string").alias("parent_path"), F.array().cast("array<int>").alias("place"), children.alias("children"))
    depth, levels = 1, []
    while True:
        each = level.where("children is not null").select("jurisdiction_id", "parent_path", "place", F.posexplode("children").alias("pos", "v"))
        made = each.select(
            "jurisdiction_id", get(F.col("v"), "path").alias("path"), get(F.col("v"), "slug").alias("slug"), "parent_path", get(F.col("v"), "level").alias("level"), *[F.coalesce(get(F.col("v"), c), F.lit("")).alias(c) for c in ("num", "heading")],
            F.coalesce(get(F.col("v"), "hasContent", "boolean"), F.lit(False)).alias("has_content"), F.lit(depth).alias("depth"), F.concat("place", F.array("pos")).alias("place"), children.alias("children"))
        made = ws.stage(made, f"level-{depth}")
        if not made.limit(1).count():
            break
        levels.append(made.drop("children"))
        level = made.select("jurisdiction_id", F.col("path").alias("parent_path"), "place", "children")
        depth += 1
    nodes = reduce(DataFrame.unionByName, levels, made.drop("children").limit(0))
    walked = tree.preorder(nodes.withColumn("sort_path", F.col("place")), F.col("jurisdiction_id")).drop("place", "sort_path")
    return walked, given.select("jurisdiction_id", problem.alias("problem")).where("problem is not null")


def _files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """jurisdiction_id, path (without the suffix) and value of the files below root/<jurisdiction>/."""
    top = root.rstrip("/").rsplit("/", 1)[-1]
    pages = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").select("value", F.url_decode(F.input_file_name()).alias("file"))
    inside = F.split_part("file", F.lit(f"/{top}/"), F.lit(-1))
    rest = F.substr(inside, F.length(F.substring_index(inside, "/", 1)) + 2)
    return pages.select(F.substring_index(inside, "/", 1).alias("jurisdiction_id"), F.left(rest, F.length(rest) - len(suffix)).alias("path"), "value")


def _contents_files(spark: SparkSession, root: str) -> DataFrame:
    """jurisdiction_id and toc of root/<jurisdiction>/_toc.json. Spark's readers pass over names that begin with _, so the names are
    listed by Hadoop and the files opened in tasks by pyarrow, which must know the storage (local, HDFS, S3, GCS, ABFS)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/_toc.json")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
    names = spark.createDataFrame([(f.getPath().getParent().getName(), f.getPath().toUri().toString()) for f in found], "jurisdiction_id string, uri string")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, uri in zip(batch.column("jurisdiction_id").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
                store, at = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(at) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([who]), pa.array([file.read().decode("utf-8", "replace")])], names=["jurisdiction_id", "toc"])

    return names.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism * 4))).mapInArrow(opened, "jurisdiction_id string, toc string")


def import_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, sections and problems of a saved tree root/<jurisdiction>/_toc.json with root/<jurisdiction>/<path>.html and .xml.

    Sections: jurisdiction_id, path, html, xml, text, num and heading (null where blank) of the nodes with content that have a
    file. Problems: (jurisdiction_id, problem, path) of contents that can't be used, nodes with content but no
    file, and files without a node.
    """
    nodes, bad = contents(_contents_files(spark, root))
    html = _files(spark, root, ".html").withColumnRenamed("value", "html")
    xml = _files(spark, root, ".xml").withColumnRenamed("value", "xml")
    files = html.join(xml, ["jurisdiction_id", "path"], "full_outer")
    content = nodes.where("has_content").select("jurisdiction_id", "path", "num", "heading").dropDuplicates(["jurisdiction_id", "path"])
    both = content.withColumn("known", F.lit(True)).join(files.withColumn("there", F.lit(True)), ["jurisdiction_id", "path"], "full_outer")
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    sections = both.where("known and there").select("jurisdiction_id", "path", "html", "xml", strip_html(F.col("html")).alias("text"), blank("num"), blank("heading"))
    problems = bad.select("jurisdiction_id", "problem", F.lit(None).cast("string").alias("path"))
    lost = both.where("known is null or there is null").select("jurisdiction_id", F.when(F.col("known"), "node without file").otherwise("file without node").alias("problem"), "path")
    return nodes, sections, problems.unionByName(lost)


def uslm(jurisdiction: Column, parent_path: Column, num: Column, heading: Column, escaped: Column) -> Column:
    """A section's XML document from its number, heading and escaped paragraph texts (paragraphs_of_html)."""
    path = F.concat_ws("/", parent_path, slug_of_number(num))
    id_ = escape_xml(identifier(jurisdiction, path))
    body = F.array_join(F.transform(escaped, lambda p: F.concat(F.lit("        <p>"), p, F.lit("</p>"))), "\n")
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<lawDoc xmlns="http://xml.house.gov/schemas/uslm/1.0" identifier="'), id_, F.lit('">\n  <meta>\n    <dc:title>'), escape_xml(heading),
        F.lit('</dc:title>\n  </meta>\n  <main>\n    <section identifier="'), id_, F.lit('" temporalId="'), escape_xml(temporal_id(num)), F.lit('">\n      <num>'), escape_xml(num), F.lit("</num>\n      <heading>"), escape_xml(heading),
        F.lit("</heading>\n      <content>\n"), body, F.lit("\n      </content>\n    </section>\n  </main>\n</lawDoc>\n"))


def _schema() -> T.StructType:
    texts = T.StructType().add("p", T.ArrayType(T.StringType()))
    inner: T.StructType | None = None
    for kind, below in zip(reversed(SUBDIVISIONS), [None, *reversed(SUBDIVISIONS[1:])], strict=True):
        own = T.StructType().add("num", "string").add("heading", "string").add("content", texts)
        inner = own if inner is None else own.add(below, T.ArrayType(inner))
        del kind
    section = T.StructType().add("_identifier", "string").add("_temporalId", "string").add("num", "string").add("heading", "string").add("content", texts).add(SUBDIVISIONS[0], T.ArrayType(inner))
    return T.StructType().add("meta", T.StructType().add("title", "string")).add("main", T.StructType().add("section", T.ArrayType(section))).add("_corrupt", "string")


def uslm_rows(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """Content rows of XML documents: key, identifier, place (numbers of the subdivisions and text on the way, an order), type, num,
    heading and text. Types are section, the SUBDIVISIONS and text (one for each paragraph of text); corrupt and null documents
    have no rows. Documents are parsed once, by a schema that nests as deep as the subdivisions do."""
    options = {"attributePrefix": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    parsed = docs.select(F.col(key).alias("key"), F.from_xml(F.col(xml), _schema(), options).alias("d"))
    level = parsed.where("d._corrupt is null").select("key", F.posexplode("d.main.section").alias("pos", "x")).select("key", F.col("x._identifier").alias("identifier"), F.array("pos").alias("place"), "x")
    parts = []
    for kind, below in zip(("section", *SUBDIVISIONS), (*SUBDIVISIONS, None), strict=True):
        parts.append(level.select("key", "identifier", "place", F.lit(kind).alias("type"), "x.num", "x.heading", F.lit(None).cast("string").alias("text")))
        texts = level.select("key", "identifier", "place", F.posexplode("x.content.p").alias("pos", "text"))
        # texts come before subdivisions
        parts.append(texts.select("key", "identifier", F.concat("place", F.array(F.lit(-1), F.col("pos"))).alias("place"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("num"), F.lit(None).cast("string").alias("heading"), "text"))
        if below:
            level = level.select("key", "identifier", "place", F.posexplode(f"x.{below}").alias("pos", "x")).select("key", "identifier", F.concat("place", F.array("pos")).alias("place"), "x")
    return reduce(DataFrame.unionByName, parts)


def text_of(rows: DataFrame) -> DataFrame:
    """(key, body): the texts of uslm_rows() in order, joined by line feeds."""
    listed = F.sort_array(F.collect_list(F.struct("place", "text")))
    return rows.where("type = 'text'").groupBy("key").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("body"))


def write_catalog(rows: DataFrame, path: str, *order: Column) -> None:
    """A catalog as one pretty-printed JSON array, as people keep it under version control: rows by `order`, two spaces of indent. A
    catalog has a row for each jurisdiction, so one file holds it; it is written by one task as a stream of lines."""
    last = F.lead(F.lit(1)).over(Window.orderBy(*order)).isNull()
    first = F.row_number().over(Window.orderBy(*order)) == 1
    indented = F.regexp_replace(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}), "(?m)^", "  ")
    lines = rows.select(F.concat(F.when(first, "[\n").otherwise(""), indented, F.when(last, "\n]").otherwise(",")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
