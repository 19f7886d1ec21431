"""Names, addresses and domains to rows: scores, tiers, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_name, slugify
from .changes import keep_first

# States by name, and words that end a street's name.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC",
}
STREET = (
    "st", "street", "ave", "avenue", "blvd", "boulevard", "dr", "drive", "ln", "lane", "rd", "road", "ct", "court", "pl", "place", "way", "cir", "circle", "pkwy", "parkway", "hwy", "highway", "tr", "trail",
    "east", "west", "north", "south", "e", "w", "n", "s",
)


def score_name(name: Column, kind: Column, query: str, preferred: str | None) -> Column:
    """How well a name answers a lookup; null where it doesn't contain the query."""
    wanted, own = lookup_name(F.lit(query)), lookup_name(name)
    score = (
        F.when(slugify(lookup_name(name)) == slugify(wanted), 8).otherwise(0)
        + F.when(own == wanted, 6).otherwise(0)
        + F.when(kind.eqNullSafe(F.lit(preferred)), 4).otherwise(0)
        + F.when(F.startswith(own, wanted), 2).otherwise(0)
        - F.abs(F.length(own) - F.length(wanted)) / 100
    )
    return F.when(F.contains(own, wanted), score)


def tier(name: Column, query: Column) -> Column:
    """0 equal, 1 begins with, 2 contains, null otherwise."""
    return F.when(name == query, 0).when(F.startswith(name, query), 1).when(F.contains(name, query), 2)


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """For each key the row of the earliest source that has one."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("found_in", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return keep_first(out, [key], F.col("found_in"))


def host_suffixes(host: Column) -> Column:
    """The host and everything after each of its dots: what a domain must equal to cover it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def trust(hosts: DataFrame, host: str, domains: DataFrame, domain: str, rank: str) -> DataFrame:
    """`hosts` with the lowest-ranked domain that equals or covers each host; hosts under .gov are trusted as such.

    The suffix test becomes an equi join on exploded suffixes. `domains` is a curated list.
    """
    pairs = hosts.select(host, F.explode(host_suffixes(F.col(host))).alias(domain)).distinct().join(domains, domain)
    best = pairs.groupBy(host).agg(F.min_by(domain, rank).alias("trusted_by"))
    out = hosts.join(best, host, "left")
    government = F.endswith(F.col(host), F.lit(".gov"))
    return out.withColumn("trusted", F.col("trusted_by").isNotNull() | government)


def parse_address(address: Column) -> Column:
    """struct(city, state) of a US address, or null: comma form, then a trailing code, two-word or one-word state name.

    Without a comma the city is what follows the street: a leading number, and words up to the first that ends a street's
    name (one word if none does).
    """
    codes = sorted(set(STATES.values()))
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    state_of = lambda t: F.when((F.length(t) == 2) & F.upper(t).isin(codes), F.upper(t)).otherwise(F.try_element_at(table, F.lower(t)))
    without_zip = lambda t: F.regexp_replace(F.trim(t), r"\s+\d{5}(-\d{4})?$", "")
    parts = F.transform(F.split(F.trim(address), ","), lambda p: F.trim(p))
    comma_state = state_of(without_zip(F.try_element_at(parts, F.lit(-1))))
    comma_city = F.when(F.size(parts) >= 2, F.nullif(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    by_comma = F.when(comma_state.isNotNull() & comma_city.isNotNull(), F.struct(comma_city.alias("city"), comma_state.alias("state")))

    words = F.split(without_zip(address), r"\s+")
    n = F.size(words)

    def city(given: Column) -> Column:
        ends = F.transform(given, lambda w, i: F.when((i > 0) & F.lower(w).isin(*STREET), i + 1))
        first = F.array_min(F.array_compact(ends))
        cut = F.coalesce(first, F.when(F.size(given) > 2, F.lit(2)).otherwise(F.lit(1)))
        rest = F.slice(given, cut + 1, F.size(given))
        numbered = F.try_element_at(given, F.lit(1)).rlike(r"^\d+$") & (F.size(rest) > 0)
        return F.when(F.size(given) > 0, F.array_join(F.when(numbered, rest).otherwise(given), " "))

    last = F.try_element_at(words, F.lit(-1))
    two = F.lower(F.concat_ws(" ", F.try_element_at(words, F.lit(-2)), last))
    upto = lambda k: F.slice(words, 1, F.greatest(n - k, F.lit(0)))
    as_code = F.when((n >= 2) & (F.length(last) == 2) & F.upper(last).isin(codes), F.struct(city(upto(1)).alias("city"), F.upper(last).alias("state")))
    as_two = F.when((n >= 3) & F.try_element_at(table, two).isNotNull(), F.struct(city(upto(2)).alias("city"), F.try_element_at(table, two).alias("state")))
    as_one = F.when((n >= 2) & F.try_element_at(table, F.lower(last)).isNotNull(), F.struct(city(upto(1)).alias("city"), F.try_element_at(table, F.lower(last)).alias("state")))
    whole = lambda s: F.when(s["city"].isNotNull(), s)
    return F.coalesce(by_comma, whole(as_code), whole(as_two), whole(as_one))


def probes(name: Column, state: Column) -> Column:
    """Where a place may be published, in the order to try: (publisher, id), the second publisher with both of its spellings."""
    slug = slugify(name)
    at = lambda publisher, key: F.struct(F.lit(publisher).alias("publisher"), key.alias("id"))
    return F.array(at("municode", F.concat_ws("-", F.lower(state), slug)), at("amlegal", F.replace(slug, F.lit("-"), F.lit("_"))), at("amlegal", slug))


def codes_known(rows: DataFrame, code: str, catalog: DataFrame, key: str) -> DataFrame:
    """The rows with the publisher's own key of their code; a code that the catalog lacks raises ValueError."""
    found = rows.join(catalog.select(code, key).dropDuplicates([code]), code, "left")
    missing = found.where(F.col(key).isNull()).select(code).first()
    if missing:
        raise ValueError(f"no {key} for {missing[0]!r}")
    return found


def look_up(asked: DataFrame, cached: DataFrame, catalog: DataFrame, gazetteer: DataFrame, published: DataFrame) -> DataFrame:
    """Where each request leads: query, status (bad_request, ready, known, discovered or not_found), step (cached, catalog or gazetteer),
    id and, if it was found by probing, publisher and source_id.

    asked: query, slug, city, county, state, address; an address gives city and state where these are absent. What is given
    first of slug, city and county is looked up, counties among counties only (with or without that word), by slug or
    normalised name, within the state: first what is cached (id, name, type, state), then the catalog (with publisher), then the gazetteer. Of several rows
    the first id counts. A catalog or gazetteer row without a publisher is probed: the first of probes() that is
    `published` (publisher, id) counts; without one the place isn't found. No state, or nothing to look up, is a bad request.
    """
    parsed = F.when(F.col("slug").isNull() & F.col("city").isNull(), parse_address(F.col("address")))
    given = asked.withColumn("__p", parsed).select("query", F.coalesce("state", "__p.state").alias("state"), "slug", F.coalesce("city", "__p.city").alias("city"), "county")
    kind = F.when(F.col("slug").isNotNull(), "slug").when(F.col("city").isNotNull(), "city").when(F.col("county").isNotNull(), "county")
    county = lambda name: F.regexp_replace(lookup_name(name), r"\s+(county|parish|borough)$", "")
    key = F.when(kind == "slug", F.lower("slug")).when(kind == "city", lookup_name(F.col("city"))).otherwise(county(F.col("county")))
    wanted = given.select("query", F.lower("state").alias("state"), kind.alias("kind"), key.alias("key"))

    def step(rows: DataFrame, n: int, publisher: Column) -> DataFrame:
        keyed = rows.select(F.explode(F.array(F.struct(F.lit("slug").alias("kind"), slugify(F.col("name")).alias("key")), F.struct(F.lit("city").alias("kind"), lookup_name(F.col("name")).alias("key")), F.struct(F.when(F.col("type") == "county", "county").alias("kind"), county(F.col("name")).alias("key")))).alias("k"),
                            F.lower("state").alias("state"), F.struct(F.lit(n).alias("n"), F.col("id").cast("string").alias("id"), "name", publisher.cast("string").alias("publisher")).alias("hit"))
        return keyed.where("k.kind is not null and k.key != ''").groupBy("k.kind", "k.key", "state").agg(F.min("hit").alias("hit"))

    known = step(cached, 0, F.lit(None)).unionByName(step(catalog, 1, F.col("publisher"))).unionByName(step(gazetteer, 2, F.lit(None)))
    found = wanted.join(known.groupBy("kind", "key", "state").agg(F.min("hit").alias("hit")), ["kind", "key", "state"], "left")
    tried = found.where("hit.n > 0 and hit.publisher is null").select("query", F.posexplode(probes(F.col("hit.name"), F.col("state"))).alias("pos", "p"))
    met = tried.join(published.select(F.col("publisher").alias("__publisher"), F.col("id").alias("__id")).distinct(), (F.col("p.publisher") == F.col("__publisher")) & (F.col("p.id") == F.col("__id")))
    first = met.groupBy("query").agg(F.min_by("p", "pos").alias("probe"))
    status = (
        F.when(F.col("state").isNull() | F.col("kind").isNull(), "bad_request").when(F.col("hit.n") == 0, "ready").when(F.col("hit.publisher").isNotNull(), "known")
        .when(F.col("probe").isNotNull(), "discovered").otherwise("not_found")
    )
    steps = F.when(F.col("hit.n") == 0, "cached").when(F.col("hit.n") == 1, "catalog").when(F.col("hit.n") == 2, "gazetteer")
    return found.join(first, "query", "left").select("query", status.alias("status"), steps.alias("step"), F.col("hit.id").alias("id"), F.coalesce("probe.publisher", "hit.publisher").alias("publisher"), F.col("probe.id").alias("source_id"))
