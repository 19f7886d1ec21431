"""Joins, matching and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import client_name, lookup_name, norm, url_host
from ..operators import changes, registry, resolve
from .base import pick, pick_sql, query, relation, table, values


@query("select doc_id from documents where exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def semi_join_exists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("select doc_id, doc_id in (select doc_id from labels) has_label from documents")
def exists_flag(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("has_label"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_join_fips(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("select l_orderkey, l_linenumber, l_partkey, p_name, p_brand from lineitem left join part on l_partkey = p_partkey")
def enrich_left_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey", "left")


@query("with k as (select min(l_partkey) p from (select l_partkey from lineitem group by l_partkey having count(*) >= 25)) "
       "select distinct o_orderkey, strftime(o_orderdate, '%Y-%m-%d') filed from lineitem join orders on l_orderkey = o_orderkey where l_partkey = (select p from k) order by filed desc, o_orderkey limit 20 offset 5")  # fmt: skip
def join_topk_page(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    busy = lines.groupBy("l_partkey").count().where("count >= 25").agg(F.min("l_partkey").alias("l_partkey"))  # one row
    refs = lines.join(F.broadcast(busy), "l_partkey").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    dates = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))
    return changes.page(refs.join(dates, "o_orderkey"), 20, 5, F.desc("filed"), F.col("o_orderkey"))


@query("select p_partkey, l_orderkey, l_linenumber from part left join (select *, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc) n from lineitem) on l_partkey = p_partkey and n = 1")
def match_exact_key(spark, sf_dir):
    """Rows with the last of the rows that have their key; a key's other rows don't fan out."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return registry.match_exact(table(spark, sf_dir, "part").select("p_partkey"), lines, ["p_partkey"], F.col("l_orderkey"), F.col("l_linenumber"), how="left")


PARTS = "trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"select l.p_partkey, r.p_partkey matched from (select p_partkey, {PARTS} k, p_size % 5 b from part where p_type = 'PROMO') l join lateral "
       f"(select p_partkey from (select p_partkey, {PARTS} k, p_size % 5 b, p_type from part where p_type <> 'PROMO') r where r.k = l.k and r.b = l.b order by case when p_type in ('ECONOMY') then 0 else 1 end, p_partkey limit 1) r on true")  # fmt: skip
def match_name_pref(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", norm(F.col("p_name")).alias("k"), (F.col("p_size") % 5).alias("b"), "p_type")
    left, right = rows.where("p_type = 'PROMO'").select("p_partkey", "k", "b"), rows.where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("matched"), "k", "b", "p_type")
    return registry.match_name(left, right, "b", "k", "p_partkey", "p_type", ["ECONOMY"], "matched").select("p_partkey", "matched")


FUZZY = """
with t as (select doc_id, lang, list_distinct(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) s from documents),
p as (select a.doc_id, b.doc_id partner, len(list_intersect(a.s, b.s)) i, len(a.s) na, len(b.s) nb from t a join t b on a.lang = b.lang and a.doc_id <> b.doc_id and least(len(a.s), len(b.s)) >= 0.85 * greatest(len(a.s), len(b.s))),
q as (select doc_id, partner, round(i::double / (na + nb - i), 6) score from p where i >= 0.85 * (na + nb - i))
select doc_id, partner, score from (select *, row_number() over (partition by doc_id order by score desc, partner) n from q) where n = 1
"""


@query(FUZZY)
def match_fuzzy_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.split(norm(F.col("text")), " ").alias("tokens"))
    found = registry.match_fuzzy_self(rows, "lang", "tokens", "doc_id")
    return found.select("doc_id", F.col("match").alias("partner"), F.round("score", 6).alias("score"))


@query("select strategy, count(*) n from (select case when s.s_suppkey is not null then 'key' when p.k is not null then 'name' else 'unmatched' end strategy from customer c "
       "left join (select s_suppkey from supplier) s on s.s_suppkey = c.c_custkey left join (select distinct right(s_name, 3) k from supplier) p on s.s_suppkey is null and right(c.c_name, 3) = p.k) group by strategy")  # fmt: skip
def match_cascade(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.substring("s_name", -3, 3).alias("k"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", -3, 3).alias("k"))

    def by_key(rest):
        return rest.join(suppliers.select(F.col("s_suppkey").alias("c_custkey"), F.col("k").alias("match")), "c_custkey")

    def by_name(rest):
        best = suppliers.groupBy("k").agg(F.min("s_suppkey").cast("string").alias("match"))
        return rest.join(best, "k")

    return registry.cascade(customers, "c_custkey", [("key", by_key), ("name", by_name)]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


NAME_OF = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"with c as (select c_custkey, c_nationkey b, {NAME_OF.format('c_name')} k, list_distinct(string_split({NAME_OF.format('c_name')}, ' ')) t from customer), "
       f"s as (select s_suppkey, s_nationkey b, {NAME_OF.format('s_name')} k, list_distinct(string_split({NAME_OF.format('s_name')}, ' ')) t from supplier) "
       "select strategy, count(*) n from (select case when exists (select 1 from s where s_suppkey = c_custkey) then 'key' when exists (select 1 from s where s.b = c.b and s.k = c.k) then 'name' "
       "when exists (select 1 from s where s.b = c.b and len(list_intersect(s.t, c.t)) >= 0.85 * (len(s.t) + len(c.t) - len(list_intersect(s.t, c.t)))) then 'fuzzy' else 'unmatched' end strategy from c) group by strategy")  # fmt: skip
def match_cascade_full(spark, sf_dir):
    """All three stages, by whole names within a nation; match_cascade has two and compares the ends of names."""
    named = lambda t, key, name, nation: table(spark, sf_dir, t).select(F.col(key).alias("c_custkey"), F.col(nation).alias("b"), norm(F.col(name)).alias("k"))
    found = registry.match_catalog(named("customer", "c_custkey", "c_name", "c_nationkey"), named("supplier", "s_suppkey", "s_name", "s_nationkey"), "c_custkey", "b", "k")
    return found.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


@query("select c.c_custkey, coalesce(s.s_nationkey, c.c_nationkey) nation, coalesce(s.s_acctbal, c.c_acctbal) bal from customer c left join supplier s on c.c_custkey = s.s_suppkey")
def merge_keep_geo(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return registry.merge_keep(new, old, "c_custkey", ["nation", "bal"])


DOMAINS = [(1, "example.org"), (2, "blog.theran.example.com"), (3, "example.com"), (4, "ads-track.example.net")]
HOST = "nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '')"


@query(f"with h as (select distinct {HOST} host from pages), d as (select * from {values('id, domain', DOMAINS)}) "
       "select host, (select min_by(domain, id) from d where host = domain or suffix(host, '.' || domain)) trusted_by, exists (select 1 from d where host = domain or suffix(host, '.' || domain)) or suffix(host, '.gov') trusted from h where host is not null")  # fmt: skip
def suffix_trust(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    return resolve.trust(hosts, "host", relation(spark, "id, domain", DOMAINS), "domain", "id").select("host", "trusted_by", "trusted")


@query("select k, coalesce(s, c) name, case when s is not null then 0 else 1 end found_in from (select coalesce(s_suppkey, c_custkey) k, s_name s, c_name c from supplier full join customer on s_suppkey = c_custkey)")
def slug_fallback(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    second = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return resolve.first_source([first, second], "k")


@query("select p_name, p_partkey, p_type from (select *, row_number() over (partition by p_name order by case p_type when 'ECONOMY' then 0 when 'STANDARD' then 1 else 9 end, p_partkey) n from part) where n = 1")
def slug_priority(spark, sf_dir):
    priority = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(9)
    return changes.keep_first(table(spark, sf_dir, "part"), ["p_name"], priority, F.col("p_partkey")).select("p_name", "p_partkey", "p_type")


WANTED = [("Customer#000000004", "a"), ("Supplier#000000003", "b"), ("Nobody", "c"), ("NATION_2", "d")]


@query(f"with q as (select * from {values('name, tag', WANTED)}), s as (select s_name name, 0 r from supplier union all select c_name, 1 from customer union all select n_name, 2 from nation) "
       "select q.name, tag, coalesce(min(r), 3)::bigint step from q left join s on lower(s.name) = lower(q.name) group by all")  # fmt: skip
def lookup_cascade(spark, sf_dir):
    sources = [table(spark, sf_dir, t).select(F.lower(c).alias("k"), F.lit(i).cast("long").alias("step")) for i, (t, c) in enumerate((("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name")))]
    known = sources[0].unionByName(sources[1]).unionByName(sources[2]).groupBy("k").agg(F.min("step").alias("step"))
    asked = relation(spark, "name, tag", WANTED).withColumn("k", F.lower("name"))
    return asked.join(known, "k", "left").select("name", "tag", F.coalesce("step", F.lit(3)).cast("long").alias("step"))


@query(f"with q as (select * from {values('name, tag', WANTED)}) select tag, (select min(c_custkey) from customer where c_name = q.name and c_acctbal > 0) hit from q")
def resolve_batch(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_name").alias("name"), "c_custkey")
    first = changes.keep_first(known, ["name"], F.col("c_custkey"))
    return relation(spark, "name, tag", WANTED).join(first, "name", "left").select("tag", F.col("c_custkey").alias("hit"))


@query("select d.doc_id, case when l.quality = 1 then 'cached' when l.toxic = 1 then 'crawl_failed' when l.doc_id is not null then 'crawling' else 'not_found' end state from documents d left join labels l using (doc_id)")
def resolve_status(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "cached").when(F.col("toxic") == 1, "crawl_failed").when(F.col("hit"), "crawling").otherwise("not_found")
    return rows.select("doc_id", state.alias("state"))


NAMES, NAME_ENDS, NAME_KINDS = ["Nashville", "Nashville-Davidson County Metro", "City of Nashville, TN", "East Nashville", "Memphis", "nashville "], ["", " #", ""], ["city", "county"]
NAMED = f"(select c_custkey, replace({pick_sql(NAMES, 'c_custkey')} || {pick_sql(NAME_ENDS, 'c_custkey // 6')}, '#', c_custkey::varchar) as name, {pick_sql(NAME_KINDS, 'c_custkey // 3')} kind from customer)"
LOOKUP = "trim(regexp_replace(lower(regexp_replace(regexp_replace(name, '(?i)^(City of|Town of|Village of|County of|Borough of)\\s+', ''), ',\\s*[A-Z]{2}$', '')), '\\s+', ' ', 'g'))"


@query(f"with n as (select *, {LOOKUP} own from {NAMED}), s as (select c_custkey, name, kind, round((case when trim(regexp_replace(own, '[^a-z0-9]+', '-', 'g'), '-') = 'nashville' then 8 else 0 end + case when own = 'nashville' then 6 else 0 end "
       "+ case when kind = 'city' then 4 else 0 end + case when own like 'nashville%' then 2 else 0 end - abs(length(own) - 9) / 100.0)::double, 4) score from n where contains(own, 'nashville')) select * from s order by score desc, name, c_custkey limit 20")  # fmt: skip
def best_match(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.replace(F.concat(pick(NAMES, key), pick(NAME_ENDS, F.floor(key / 6))), F.lit("#"), key.cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), pick(NAME_KINDS, F.floor(key / 3)).alias("kind"))
    score = F.round(resolve.score_name(F.col("name"), F.col("kind"), "Nashville", "city").cast("double"), 4)
    return rows.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "name", "c_custkey").limit(20)


CLIENTS = ["City of Palm", "Palm Desert", "Desert Palm", "Oak", "Palm Springs", "Town of Oak", "PALM"]


@query(f"select c_custkey, client, tier from (select c_custkey, client, case when k = 'palm' then 0 when k like 'palm%' then 1 when contains(k, 'palm') then 2 end tier from (select *, trim(regexp_replace(regexp_replace(lower(client), '^(city|town|village|county)\\s+of\\s+', ''), '[^a-z0-9]+', ' ', 'g')) k "
       f"from (select c_custkey, {pick_sql(CLIENTS, 'c_custkey')} || case when c_custkey % 2 = 0 then '' else ' ' || c_custkey end client from customer))) where tier is not null order by tier, c_custkey limit 300")  # fmt: skip
def tiered_match(spark, sf_dir):
    client = F.concat(pick(CLIENTS, F.col("c_custkey")), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", client.alias("client")).withColumn("tier", resolve.tier(client_name(F.col("client")), client_name(F.lit("Palm"))))
    return rows.where("tier is not null").orderBy("tier", "c_custkey").limit(300)


@query("with n as (select s_suppkey id, s_name name, 'known' publisher, s_acctbal bal from supplier union all select c_custkey, c_name, 'unknown', c_acctbal from customer where c_custkey not in (select s_suppkey from supplier)) "
       "select id, name, publisher from n where contains(lower(name), '#00000000') order by case when lower(name) = 'supplier#000000003' then 0 else 1 end, case when publisher = 'unknown' then 1 else 0 end, case when publisher = 'unknown' then -bal else 0 end, name, id")  # fmt: skip
def relevance_sort(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("known").alias("publisher"), F.col("s_acctbal").alias("bal"))
    second = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("unknown").alias("publisher"), F.col("c_acctbal").alias("bal")).join(first.select("id"), "id", "left_anti")
    unknown = F.col("publisher") == "unknown"
    rows = first.unionByName(second).where(F.contains(lookup_name(F.col("name")), F.lit("#00000000")))
    exact = F.when(lookup_name(F.col("name")) == "supplier#000000003", 0).otherwise(1)
    return rows.orderBy(exact, F.when(unknown, 1).otherwise(0), F.when(unknown, -F.col("bal")).otherwise(0.0), "name", "id").select("id", "name", "publisher")


@query("select s_name name, 'registry' origin from supplier union all select c_name, 'census' from customer where c_custkey not in (select s_suppkey from supplier)")
def union_sources(spark, sf_dir):
    first = table(spark, sf_dir, "supplier")
    second = table(spark, sf_dir, "customer").join(first.select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti")
    return first.select(F.col("s_name").alias("name"), F.lit("registry").alias("origin")).unionByName(second.select(F.col("c_name").alias("name"), F.lit("census").alias("origin")))


@query("select id, source_rank, name from (select *, row_number() over (partition by id order by source_rank, name) n from (select s_suppkey id, 0 source_rank, s_name name from supplier union all select c_custkey, 1, c_name from customer union all select n_nationkey, 2, n_name from nation)) where n = 1")
def union_precedence(spark, sf_dir):
    named = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).cast("long").alias("id"), F.col(n).alias("name"))
    return registry.by_precedence([named("supplier", "s_suppkey", "s_name"), named("customer", "c_custkey", "c_name"), named("nation", "n_nationkey", "n_name")], "id", "name").select("id", "source_rank", "name")


@query("select s_suppkey id, s_name name from supplier union all select c_custkey, c_name from customer where not (c_mktsegment = 'BUILDING' or c_nationkey = 3) and c_custkey not in (select s_suppkey from supplier)")
def merge_unscanned(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment", "c_nationkey")
    scanned = (F.col("c_mktsegment") == "BUILDING") | (F.col("c_nationkey") == 3)
    return registry.merge_unscanned(new, old, "id", scanned)


FORMS = ["#n Desert Falls East, #c, #a", "#n desert falls east #c #a 92260", "#n Fairway Dr, #c, #s", "#c, #s", "#n Main Street #c #s", "#c", "#n Elm St #c #s 97201-1234", "#c, #a 43004", "#c, nowhere"]
CITIES, PLACES = ["Palm Desert", "Albany", "Costa Mesa", "Portland"], [("CA", "California"), ("NY", "new york"), ("OR", "Oregon"), ("TX", "Texas"), ("NC", "North Carolina")]
CITY, SHORT, LONG = pick_sql(CITIES, "c_custkey // 9"), pick_sql([a for a, _ in PLACES], "c_custkey // 4"), pick_sql([s for _, s in PLACES], "c_custkey // 4")


@query(f"select c_custkey, case when c_custkey % 9 not in (5, 8) then {CITY} end city, case when c_custkey % 9 not in (5, 8) then {SHORT} end state from customer")
def parse_address(spark, sf_dir):
    """City and state of addresses put together from a city and a state in nine forms; two of them name no state."""
    key = F.col("c_custkey")
    fourth = F.floor(key / 4)
    text = pick(FORMS, key)
    for mark, value in (("#n", key.cast("string")), ("#c", pick(CITIES, F.floor(key / 9))), ("#a", pick([a for a, _ in PLACES], fourth)), ("#s", pick([s for _, s in PLACES], fourth))):
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf_dir, "customer").select("c_custkey", resolve.parse_address(text).alias("p")).select("c_custkey", "p.city", "p.state")
