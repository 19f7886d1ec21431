"""Tables of the data model as Spark DDL, and the values that enumerated columns may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CODE = "_default"

TABLES = {
    "jurisdictions": "id string, name string, type string, state string, parent_id string, fips string, publisher_name string, publisher_source_id string, publisher_url string, last_crawled timestamp, last_updated timestamp",
    "codes": "jurisdiction_id string, code_id string, name string, source_id string, source_url string, last_crawled timestamp, last_updated timestamp, is_primary boolean, sort_order int",
    "toc_nodes": "jurisdiction_id string, code_id string, path string, slug string, parent_path string, level string, num string, heading string, has_content boolean, sort_order int",
    "sections": "jurisdiction_id string, code_id string, path string, html string, xml string, text string, num string, heading string, fetched_at timestamp",
    "court_decisions": "cluster_id bigint, case_name string, court string, date_filed date, url string, citation string, cite_count int, fetched_at timestamp",
    "decision_refs": "cluster_id bigint, jurisdiction_id string, code_id string, section_path string, snippet string",
    "search_log": "jurisdiction_id string, code_id string, section_path string, queries array<string>, last_checked_at timestamp, total_count int",
    "feedback": "id bigint, jurisdiction_id string, code_id string, path string, report_type string, description string, status string, triage_notes string, created_at timestamp, resolved_at timestamp, ip_address string",
    "annotations": "id bigint, target_type string, jurisdiction_id string, code_id string, path string, cluster_id bigint, url string, title string, source_name string, source_domain string, annotation_type string, description string, status string, triage_notes string, created_at timestamp, reviewed_at timestamp, ip_address string",
    "trusted_domains": "domain string, source_name string, source_type string",
    "registry": "id string, name string, type string, state string, fips string, lat double, lng double, population bigint, publisher string, sourceId string, sourceUrl string, status string, censusMatch string, lastScanned timestamp",
    "census_places": "fips string, name string, state string, type string, lat double, lng double, pop bigint",
    "manual_sources": "id string, name string, type string, state string, parentId string, fips string, sourceUrl string, documents array<struct<id: string, title: string, url: string, format: string>>",
    "request_log": "ts timestamp, method string, path string, jurisdiction string, query map<string, string>, status int, duration_ms bigint, error string",
    "raw_toc": "id string, title string, level string, has_content boolean, parent_id string",
}

#: Fixed values of the data model.
ENUMS = {
    "type": ("federal", "state", "county", "city", "hoa"),
    "level": ("title", "subtitle", "chapter", "subchapter", "article", "subarticle", "division", "subdivision", "part", "subpart", "section"),
    "status": ("pending", "approved", "rejected"),
}


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def problems(rules: dict[str, Column]) -> Column:
    """Name of the first rule that a row breaks, or null; a rule that is null counts as broken."""
    return F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`rows` with `ok` and `reason`, for routing good rows and rejects in one pass."""
    reason = problems(rules)
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
