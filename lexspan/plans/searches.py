"""Phrase search over documents (columns text and source)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_text
from ..operators import search
from ..staging import shared_root
from .base import query, table

N = "trim(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
TEXT, SOURCE = N.format("text"), N.format("source")
FIELDS = ["text", "source"]

def index_of(spark, sf_dir) -> search.PhraseIndex:
    """The index of documents in `sf_dir` as their files are now, in the shared folder: any session that has this folder uses it."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    mark = repr((search.LAYOUT, sf_dir, sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)))
    return search.PhraseIndex(spark, f"{shared_root(spark)}/lexspan/search-{hashlib.sha256(mark.encode()).hexdigest()[:32]}")


def build_index(spark, sf_dir) -> search.PhraseIndex:
    """The index anew."""
    return index_of(spark, sf_dir).build(table(spark, sf_dir, "documents"), "doc_id", FIELDS)


def index(spark, sf_dir) -> search.PhraseIndex | None:
    """The index, if index_build has made it: queries without one scan the table, which costs less than a build."""
    found = index_of(spark, sf_dir)
    return found if found.exists() else None


def found(spark, sf_dir, text: str) -> DataFrame:
    """doc_id of the documents that hold all phrases of a query."""
    have = index(spark, sf_dir)
    if have:
        return have.find(text).select(F.col("key").alias("doc_id"))
    return table(spark, sf_dir, "documents").where(search.matches(text, *FIELDS)).select("doc_id")


def has(phrase: str, *columns: str) -> str:
    return "(" + " or ".join(f"contains(' ' || coalesce({c}, '') || ' ', ' {phrase} ')" for c in columns or (TEXT, SOURCE)) + ")"


@query("select f field, count(*) filter (where n > 0) docs, sum(n)::bigint places from (select 'text' f, case when t = '' then 0 else len(string_split(t, ' ')) end n from (select " + f"coalesce({TEXT}, '') t from documents) " +
       "union all select 'source' f, case when t = '' then 0 else len(string_split(t, ' ')) end n from (select " + f"coalesce({SOURCE}, '') t from documents)) group by f")
def index_build(spark, sf_dir):
    """The index of documents, built if it isn't there; how many documents and places of tokens each field has in it."""
    have = index_of(spark, sf_dir)
    return (have if have.exists() else build_index(spark, sf_dir)).sizes()


@query(f"select doc_id, source from documents where {has('of the')} and {has('with')} and doc_id in (select doc_id from labels where quality = 1) order by doc_id limit 20")
def phrase_search(spark, sf_dir):
    """Flagship: an AND of two phrases, the first of two words, over usable documents."""
    usable = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rows.join(found(spark, sf_dir, "of-the with"), "doc_id", "left_semi").join(usable, "doc_id", "left_semi").orderBy("doc_id").limit(20)


@query(f"with q as (select item_id, list_distinct(list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''), lambda x: {N.format('x')})) p from benchmark), "
       f"w as (select item_id, p, list_distinct(string_split(array_to_string(p, ' '), ' ')) t from q), d as (select doc_id, ' ' || {TEXT} || ' ' x, string_split({TEXT}, ' ') t from documents), "
       "h as (select item_id, doc_id, p, x from w join d on list_has_all(d.t, w.t) where len(p) > 0 and not list_contains(p, '')) "
       "select w.item_id, (select count(*) from h where h.item_id = w.item_id and len(list_filter(h.p, lambda y: not contains(h.x, ' ' || y || ' '))) = 0) hits from w")  # fmt: skip
def multi_phrase_search(spark, sf_dir):
    """How many documents hold all words of each benchmark text."""
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text")
    asked, have = items.select(F.col("item_id").alias("query"), "text"), index(spark, sf_dir)
    hits = have.find_each(asked, docs, "doc_id", ["text"]) if have else search.scan_each(asked, docs, "doc_id", ["text"])
    hits = hits.groupBy(F.col("query").alias("item_id")).agg(F.count(F.lit(1)).alias("hits"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


@query(f"select doc_id, {has('in the', TEXT)} by_hyphen, {has('in the', TEXT)} by_space from documents")
def phrase_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.matches("in-the", "text").alias("by_hyphen"), search.holds([search_text(F.col("text"))], search_text(F.lit("in the"))).alias("by_space"))


@query("select item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''), lambda x: '\"' || replace(x, '\"', '\"\"') || '\"'), ' ') q from benchmark")
def query_tokens(spark, sf_dir):
    quoted = F.transform(F.split(F.trim("text"), r"\s+"), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.filter(quoted, lambda t: t != '""'), " ").alias("q"))


@query(f"with d as (select doc_id, text, {TEXT} t, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*[^\\p{{L}}\\p{{N}}]*') g from documents), k as (select *, list_position(string_split(t, ' '), 'with') - 1 b from d where contains(' ' || t || ' ', ' with ')), "
       "s as (select *, array_to_string(list_slice(g, b + 1, b + 20), '') w, len(g) > b + 20 more from k) "
       "select doc_id, case when b > 0 then '...' else regexp_extract(text, '^[^\\p{L}\\p{N}]*') end || case when more then regexp_replace(w, '[^\\p{L}\\p{N}\\p{M}]+$', '') || '...' else w end snippet from s")  # fmt: skip
def snippet_window(spark, sf_dir):
    """The text itself, 20 tokens from the first hit on, with an ellipsis where some was left out."""
    rows, have = table(spark, sf_dir, "documents").select("doc_id", "text"), index(spark, sf_dir)
    if have:
        return have.snippets(have.find("with", ["text"]), rows, "doc_id", "text").withColumnRenamed("key", "doc_id")
    return rows.where(search.matches("with", "text")).select("doc_id", search.snippet(F.col("text"), F.lit("with")).alias("snippet"))


@query("select doc_id from documents where lang = 'en' and " + has("was") + " order by doc_id limit 30")
def search_scoped(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return rows.join(found(spark, sf_dir, "was"), "doc_id", "left_semi").orderBy("doc_id").limit(30)


@query(f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) n from documents where {has('the')} and {has('and')} and doc_id in (select doc_id from labels where quality = 1)) where n <= 3 order by source, doc_id limit 25")
def global_search(spark, sf_dir):
    usable = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id").join(found(spark, sf_dir, "the and"), "doc_id", "left_semi").join(usable, "doc_id", "left_semi")
    return search.top_per_group(rows, "source", 3, 25, F.col("doc_id"))


@query(f"select count(*) filter (where {has('avec', TEXT)}) plain, count(*) filter (where {has('etait', TEXT)}) folded, count(*) filter (where {has('mas', TEXT)}) spanish from documents")
def accent_search(spark, sf_dir):
    """Hits of words written with and without accents: queries and texts are folded alike."""
    return table(spark, sf_dir, "documents").agg(*[F.count_if(search.matches(q, "text")).alias(n) for q, n in (("avec", "plain"), ("ÉTAIT", "folded"), ("más", "spanish"))])


@query(f"(select 'one' scope, source jurisdiction_id, lang code_id, doc_id as key from documents where {has('the')} and source = 'src1' and lang = 'en' order by doc_id limit 10) union all "
       f"(select 'all', source, lang, doc_id from documents where {has('the')} and source in ('src2', 'src3') order by source, doc_id limit 25)")  # fmt: skip
def search_dispatch(spark, sf_dir):
    """Search within one jurisdiction and code, or over the usable ones of a state."""
    docs = table(spark, sf_dir, "documents")
    sections = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("jurisdiction_id"), F.col("lang").alias("code_id"))
    places = docs.select("source").distinct().select(F.col("source").alias("id"), F.upper("source").alias("name"), F.when(F.col("source").isin("src2", "src3", "src4"), "CA").otherwise("NY").alias("state"), (F.col("source") != "src4").alias("usable"))
    hits = found(spark, sf_dir, "the").withColumnRenamed("doc_id", "key")
    one = search.search_code(hits, sections, places, "src1", "en")
    every = search.search_code(hits, sections, places, state="ca", limit=25)
    return one.withColumn("scope", F.lit("one")).unionByName(every.withColumn("scope", F.lit("all"))).select("scope", "jurisdiction_id", "code_id", "key")
