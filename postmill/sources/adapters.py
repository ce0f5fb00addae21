"""Landed board payloads (one JSON, HTML or XML text per row, column `payload`) as postings of one schema.

Every adapter is a narrow projection: parse, explode, map. Rows carry `arrival_seq`, a long that fixes their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language
from ..functions import text as X

COLUMNS = ("external_id", "source", "title", "company_name", "location", "country", "description", "salary_min", "salary_max", "salary_currency", "url", "is_remote", "posted_at", "raw_data")
CURRENCIES = {"gb": "GBP", "us": "USD", "pl": "PLN", "ch": "CHF", "br": "BRL", "au": "AUD"}


def postings(df: DataFrame, source: str, **values: Column) -> DataFrame:
    """df's arrival_seq and the posting columns; those not given are null."""
    kinds = {"salary_min": "double", "salary_max": "double", "is_remote": "boolean", "posted_at": "timestamp_ntz"}
    made = {"source": F.lit(source), **values}
    return df.select("arrival_seq", *[made.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


#: Elements of one array that keep their place in arrival_seq, and rows of one source in a union of sources.
PLACES, SOURCE_ROWS = 10_000, 1 << 56


def _placed(seq: Column, place: Column) -> Column:
    """A sequence number refined by a place inside its row; more places than PLACES are an error, not a wrong order."""
    return F.when(place < PLACES, seq * PLACES + place).otherwise(F.raise_error(F.lit(f"a payload holds more than {PLACES} elements: land it in smaller pages")).cast("long"))


def _numbered(df: DataFrame, array: Column, name: str = "r") -> DataFrame:
    """One row per element, arrival_seq refined by the element's place."""
    return df.select(F.col("arrival_seq").alias("_a"), F.posexplode(array).alias("_p", name)).select(_placed(F.col("_a"), F.col("_p")).alias("arrival_seq"), name)


def from_paged_api(df: DataFrame, country: str) -> DataFrame:
    """S01. Nested names, bold tags off, currency of the country (default EUR)."""
    schema = "struct<results:array<struct<id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,description:string,salary_min:double,salary_max:double,redirect_url:string,created:string>>>"
    r = _numbered(df, F.from_json("payload", schema)["results"])
    return postings(
        r, "paged", external_id=F.concat(F.lit(f"paged_{country}_"), F.col("r.id")), title=F.regexp_replace("r.title", "</?b>", ""), company_name=F.col("r.company.display_name"), location=F.col("r.location.display_name"),
        country=F.lit(country), description=F.col("r.description"), salary_min=F.col("r.salary_min"), salary_max=F.col("r.salary_max"), salary_currency=F.lit(CURRENCIES.get(country, "EUR")), url=F.col("r.redirect_url"), posted_at=X.to_utc_naive(F.col("r.created")),
    )


def from_feed_api(df: DataFrame, queries: list[str]) -> DataFrame:
    """S02. Epoch dates; kept if a query word of over four characters is part of title or description."""
    schema = "struct<data:array<struct<slug:string,title:string,company_name:string,location:string,description:string,url:string,remote:boolean,created_at:bigint>>>"
    r = _numbered(df, F.from_json("payload", schema)["data"])
    words = sorted({w for q in queries for w in q.lower().split() if len(w) > 4})
    text = F.lower(F.concat_ws(" ", F.col("r.title"), F.col("r.description")))
    kept = r.where(X.has_part(text, words)) if queries else r
    return postings(kept, "feed", external_id=F.concat(F.lit("feed_"), F.col("r.slug")), title=F.col("r.title"), company_name=F.col("r.company_name"), location=F.col("r.location"), description=F.col("r.description"), url=F.col("r.url"), is_remote=F.col("r.remote"), posted_at=F.timestamp_seconds(F.col("r.created_at")))


def from_remote_api(df: DataFrame, countries: list[str]) -> DataFrame:
    """S03. Kept when the required place is empty, worldwide, global, Europe, or holds a requested code."""
    schema = "struct<jobs:array<struct<id:bigint,title:string,company_name:string,candidate_required_location:string,description:string,url:string,publication_date:string>>>"
    r = _numbered(df, F.from_json("payload", schema)["jobs"])
    place = F.lower(F.coalesce("r.candidate_required_location", F.lit("")))
    ok = (place == "") | X.has_part(place, ("worldwide", "global", "europe", *[c.lower() for c in countries]))
    return postings(r.where(ok), "remote", external_id=F.concat(F.lit("remote_"), F.col("r.id").cast("string")), title=F.col("r.title"), company_name=F.col("r.company_name"), location=F.col("r.candidate_required_location"), country=F.lit("Remote"), description=F.col("r.description"), url=F.col("r.url"), is_remote=F.lit(True), posted_at=X.to_utc_naive(F.col("r.publication_date")))


def from_public_agency(df: DataFrame) -> DataFrame:
    """S04. First date that parses; place is city and code; remote if the work models say so, else unknown."""
    schema = "struct<offers:array<struct<refnr:string,title:string,employer:string,place:struct<city:string,code:string>,published:string,changed:string,models:array<string>>>>"
    r = _numbered(df, F.from_json("payload", schema)["offers"])
    return postings(r, "agency", external_id=F.concat(F.lit("agency_"), F.col("r.refnr")), title=F.col("r.title"), company_name=F.col("r.employer"), location=F.concat_ws(" ", "r.place.city", "r.place.code"), country=F.lit("de"), is_remote=F.when(F.array_contains("r.models", "HOME_OFFICE"), True), posted_at=F.coalesce(X.to_utc_naive(F.col("r.published")), X.to_utc_naive(F.col("r.changed"))))


def from_snippet_api(df: DataFrame) -> DataFrame:
    """S05. Rows without id or title go; free-text salary."""
    schema = "struct<jobs:array<struct<id:string,title:string,company:string,location:string,snippet:string,salary:string,link:string,updated:string>>>"
    r = _numbered(df, F.from_json("payload", schema)["jobs"]).where((F.coalesce("r.id", F.lit("")) != "") & (F.coalesce("r.title", F.lit("")) != ""))
    pay = X.parse_salary(F.col("r.salary"))
    return postings(r, "snippet", external_id=F.concat(F.lit("snippet_"), F.col("r.id")), title=F.col("r.title"), company_name=F.col("r.company"), location=F.col("r.location"), description=X.html_to_text(F.col("r.snippet")), salary_min=pay["min"], salary_max=pay["max"], url=F.col("r.link"), posted_at=X.to_utc_naive(F.col("r.updated")), raw_data=F.to_json(F.struct(F.col("r.id").alias("id"), F.col("r.salary").alias("salary"), F.col("r.updated").alias("updated"))))


def from_embedded_state(df: DataFrame, prefix: str) -> DataFrame:
    """S06. Entries of a JSON state in a script block whose key starts with a prefix. Where the state does not parse (cut
    off, or broken in another entry), flat entries are taken one by one from its text."""
    fields = ("id", "title", "company", "location", "refreshedAt", "activatedAt", "activeUntil", "url")
    kind = f"struct<{','.join(f'{f}:string' for f in fields)}>"
    state = F.regexp_extract("payload", r"(?s)<script[^>]*id=\"state\"[^>]*>(.*?)(?:</script>|$)", 1)
    parsed = F.map_entries(F.from_json(state, f"map<string,{kind}>"))
    flat = F.regexp_extract_all(state, F.lit(r'("[^"\\]+":\{[^{}]*\})'), 1)

    def entry(text: Column) -> Column:
        return F.struct(F.regexp_extract(text, r'^"([^"\\]+)"', 1).alias("key"), F.from_json(F.regexp_extract(text, r"(\{.*\})$", 1), kind).alias("value"))

    entries = F.coalesce(parsed, F.transform(flat, entry))
    kept = F.filter(entries, lambda e: F.startswith(e["key"], F.lit(prefix)) & e["value"]["id"].isNotNull())
    r = _numbered(df, kept).select("arrival_seq", F.col("r.value").alias("r"))
    stamp = F.coalesce(*[X.to_utc_naive(F.col(f"r.{c}")) for c in ("refreshedAt", "activatedAt", "activeUntil")])
    return postings(r, "state", external_id=F.concat(F.lit("state_"), F.col("r.id")), title=F.col("r.title"), company_name=F.col("r.company"), location=F.col("r.location"), url=F.col("r.url"), posted_at=stamp)


def from_search_index(df: DataFrame) -> DataFrame:
    """S07. Description from summary, bulleted missions and profile; first office gives the place; remote in three values."""
    schema = "struct<hits:array<struct<id:string,name:string,company:string,summary:string,missions:array<string>,profile:string,offices:array<struct<city:string,country_code:string>>,remote:string,url:string,published_at:string>>>"
    r = _numbered(df, F.from_json("payload", schema)["hits"])
    office = F.try_element_at("r.offices", F.lit(1))
    text = F.concat_ws("\n", F.col("r.summary"), F.array_join(F.transform("r.missions", lambda m: F.concat(F.lit("- "), m)), "\n"), F.regexp_replace("r.profile", r"(?m)^#+\s*", ""))
    remote = F.when(F.col("r.remote") == "full", True).when(F.col("r.remote") == "no", False)
    return postings(r, "index", external_id=F.concat(F.lit("index_"), F.col("r.id")), title=F.col("r.name"), company_name=F.col("r.company"), location=office["city"], country=F.lower(office["country_code"]), description=F.substring(text, 1, 4000), url=F.col("r.url"), is_remote=remote, posted_at=X.to_utc_naive(F.col("r.published_at")))


def from_company_feed(df: DataFrame, queries: list[str], countries: list[str], senior: tuple[str, ...] = ("head", "director", "chief"), domain: tuple[str, ...] = ("procurement", "supply chain", "logistics"), cap: int = 2000) -> DataFrame:
    """S08. Companies with jobs inside; kept are requested countries and titles in scope; at most `cap`, in order (a feed limit)."""
    schema = "struct<companies:array<struct<name:string,jobs:array<struct<id:string,name:string,country:string,city:string,state:string,description:string,duties:string,needs:string,url:string,published:string>>>>>"
    c = _numbered(df, F.from_json("payload", schema)["companies"], "c")
    r = c.select(F.col("arrival_seq").alias("_a"), F.col("c.name").alias("company"), F.posexplode("c.jobs").alias("_p", "r")).select(_placed(F.col("_a"), F.col("_p")).alias("arrival_seq"), "company", "r")
    title, country = F.lower("r.name"), F.lower("r.country")
    either = reduce(lambda a, q: a | F.contains(title, F.lit(q.lower())) | F.contains(F.lit(q.lower()), title), queries, F.lit(False))
    in_scope = either | (X.has_part(title, senior) & X.has_part(title, domain))
    kept = r.where((country.isNull() | country.isin([x.lower() for x in countries])) & in_scope).orderBy("arrival_seq").limit(cap)
    return postings(kept, "company", external_id=F.concat(F.lit("company_"), F.col("r.id")), title=F.col("r.name"), company_name=F.col("company"), location=F.coalesce("r.city", "r.state"), country=country, description=F.concat_ws("\n", "r.description", "r.duties", "r.needs"), url=F.col("r.url"), posted_at=X.to_utc_naive(F.col("r.published")))


_ITEM = "struct<title:string,link:string,description:string,pubDate:string>"
_FEED = f"struct<item:array<{_ITEM}>,channel:struct<item:array<{_ITEM}>>,broken:string>"
#: Dates of feeds after the day's name, with an offset or a zone's name; without, they are in UTC.
_DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss X", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy")


def _feed(payload: Column) -> Column:
    """A feed as a struct; `broken` holds a text that is no XML."""
    return F.from_xml(payload, _FEED, {"columnNameOfCorruptRecord": "broken"})


def feed_date(text: Column) -> Column:
    """A feed's date (session zone UTC) as UTC without zone; null if it is none."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{2,9}\.?,?\s+", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in _DATES], F.try_to_timestamp(plain)).cast("timestamp_ntz")


def broken_feeds(df: DataFrame) -> DataFrame:
    """Rows of S09's input whose payload is no XML; the adapter finds no items in them."""
    return df.where(F.col("payload").isNotNull() & _feed(F.col("payload"))["broken"].isNotNull())


def from_rss(df: DataFrame, details: DataFrame, queries: list[str], relevant: tuple[str, ...] = ()) -> DataFrame:
    """S09. Items of a feed (in its channel or directly below the root) with title and link. `Title // Company`; kept if the title has a
    relevant part or a query word of over four characters; text of the detail page, else of the item."""
    x = _feed(F.col("payload"))
    none = F.array().cast(f"array<{_ITEM}>")
    r = _numbered(df, F.concat(F.coalesce(x["channel"]["item"], none), F.coalesce(x["item"], none)))
    r = r.select("arrival_seq", *[F.trim(F.coalesce(F.col(f"r.{c}"), F.lit(""))).alias(n) for c, n in (("title", "head"), ("link", "url"), ("description", "text"))], F.col("r.pubDate").alias("date"))
    parts = F.split("head", r"\s+//?\s+")
    words = sorted({w for q in queries for w in q.lower().split() if len(w) > 4} | {w.lower() for w in relevant})
    kept = r.where((F.col("head") != "") & (F.col("url") != "")).withColumns({"title": F.trim(parts[0]), "company": F.trim(F.try_element_at(parts, F.lit(2)))})
    kept = kept.where(X.has_part(F.lower("title"), words)) if words else kept
    joined = kept.join(details.select("url", F.col("html")), "url", "left")
    main = F.nullif(X.main_text(F.col("html")), F.lit(""))
    return postings(joined, "rss", external_id=F.concat(F.lit("rss_"), F.sha2("url", 256)), title=F.col("title"), company_name=F.col("company"), description=F.coalesce(main, X.html_to_text(F.col("text"))), url=F.col("url"), posted_at=feed_date(F.col("date")))


def from_tabular(df: DataFrame, country: str, ignores_country: tuple[str, ...] = ("google",)) -> DataFrame:
    """S10. A scraped table (site, id, title, company, location, description, min_amount, max_amount, currency, job_url, is_remote,
    date_posted, and optionally the query that found the row, which is kept in raw_data)."""
    found_by = F.to_json(F.struct(F.col("query"))) if "query" in df.columns else F.lit(None)
    clean = lambda c: X.null_if_placeholder(F.col(c))
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    out = postings(df, "table", external_id=F.concat_ws("_", "site", "id"), title=clean("title"), company_name=clean("company"), location=clean("location"), country=F.when(~F.col("site").isin(*ignores_country), F.lit(country)), description=clean("description"), salary_min=number("min_amount"), salary_max=number("max_amount"), salary_currency=clean("currency"), url=clean("job_url"), is_remote=F.col("is_remote"), posted_at=X.to_utc_naive(F.col("date_posted").cast("string")), raw_data=found_by)
    return out.where(F.col("title").isNotNull())


def watchlist_postings(found: DataFrame, companies: DataFrame) -> DataFrame:
    """S11. Postings found for watched companies (company, country); the watched name stands in for a missing one."""
    pairs = companies.groupBy(F.lower("company").alias("_l"), F.lower("country").alias("_k")).agg(F.min("company").alias("_c"))
    kept = found.join(pairs, (F.lower("watched") == F.col("_l")) & (F.lower("country") == F.col("_k"))).drop("_l")
    return kept.withColumn("company_name", F.coalesce("company_name", "_c")).withColumn("source", F.lit("watchlist")).drop("_c", "_k", "watched")


def union_sources(frames: dict[str, DataFrame], disabled: tuple[str, ...] = ()) -> DataFrame:
    """S13. All enabled sources in order; arrival_seq then follows (source, arrival in the source)."""
    off = {d.lower() for d in disabled}
    used = [(i, f) for i, (name, f) in enumerate(frames.items()) if name.lower() not in off]
    if not used:
        raise ValueError("every source is disabled")
    if len(frames) > 127:
        raise ValueError("a union holds at most 127 sources")
    seq = F.col("arrival_seq")
    fits = lambda i: F.when(seq < SOURCE_ROWS, seq + F.lit(i * SOURCE_ROWS)).otherwise(F.raise_error(F.lit("arrival_seq is too large for a union of sources")).cast("long"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("arrival_seq", fits(i)) for i, f in used])


def source_report(frames: dict[str, DataFrame], disabled: tuple[str, ...] = ()) -> DataFrame:
    """S13. Per source its raw count and status: ok, empty or disabled (not counted)."""
    off = {d.lower() for d in disabled}
    count = lambda name, f: f.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n", F.when(F.col("n") > 0, "ok").otherwise("empty").alias("status"))
    rows = [f.limit(0).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n", F.lit("disabled").alias("status")) if name.lower() in off else count(name, f) for name, f in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def scan_scope(profiles: DataFrame, titles: tuple[str, ...] = (), countries: tuple[str, ...] = ()) -> DataFrame:
    """W03. kind (title, country), item, user_id and pos: target titles and preferred countries over all profiles,
    case-insensitive, first wins by user, then place; the defaults (user_id null) where a kind has none."""
    listed = lambda c, kind: profiles.select("user_id", F.lit(kind).alias("kind"), F.posexplode(X.clean_list(F.col(c))).alias("pos", "item"))
    items = listed("target_titles", "title").unionByName(listed("preferred_countries", "country").withColumn("item", X.normalize_country(F.col("item"))))
    items = items.where("item is not null").withColumn("item", F.regexp_replace(F.trim("item"), r"\s+", " "))
    first = items.groupBy("kind", F.lower("item").alias("k")).agg(F.min(F.struct("user_id", "pos", "item")).alias("f")).select("kind", "f.item", "f.user_id", "f.pos")
    given = [(k, t, i) for k, own in (("title", titles), ("country", countries)) for i, t in enumerate(own)]
    if not given:
        return first
    default = profiles.sparkSession.createDataFrame(given, "kind string, item string, pos int")
    missing = default.join(items.select("kind").distinct(), "kind", "left_anti")
    return first.unionByName(missing.select("kind", "item", F.lit(None).cast(profiles.schema["user_id"].dataType).alias("user_id"), "pos"))


def numbered(items: DataFrame, column: str, letters: int = 3) -> DataFrame:
    """Distinct items with their place (from 0) in ascending order and the number of all. Counted by first letters: the places of
    a group begin after the items of smaller ones, so no task sees all items, and the window over all sees only the groups."""
    rows = items.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_g", F.substring(column, 1, letters))
    groups = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select("_g", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("size"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(column)) - 1 + F.col("_before")
    return rows.join(starts, "_g").select(column, place.alias("place"), "size")


def rotate(items: DataFrame, slot: int, n: int) -> DataFrame:
    """W04. n items (columns place, from 0, and size, see `numbered`) from slot * n on, wrapping around."""
    return items.withColumn("_at", F.pmod(F.col("place") - F.lit(slot * n), F.col("size"))).where(F.col("_at") < n).orderBy("_at").drop("_at")


def crawl_plan(queries: DataFrame, countries: list[str], locations: DataFrame, cap: int = 80, aliases: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """W05. The first `cap` steps (the plan's size) of a plan that keeps the top queries in all countries: the first query of each
    country's list at each place, then the second ones. `queries` (query, place) and `locations` (location, place) are in order of
    place; a country's list has its local aliases behind each query. Without locations a step has the empty one."""
    aliases = {"br": language.TITLE_ALIASES} if aliases is None else aliases

    def first(df: DataFrame, column: str) -> DataFrame:
        """One row: the first `cap` items in order; no plan needs more of them."""
        top = df.where(F.col(column).isNotNull()).orderBy("place", column).limit(cap)
        return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(column).alias("item")))), lambda x: x["item"]).alias(f"{column}_list"))

    lists = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(k).alias("country"), language.expand_queries(F.col("query_list"), aliases.get(k.lower(), {})).alias("own")) for i, k in enumerate(countries)])
    steps = first(queries, "query").select(F.explode(lists).alias("x")).select("x.c", "x.country", F.posexplode("x.own").alias("q", "query"))
    places = first(locations, "location").select(F.posexplode(F.when(F.size("location_list") > 0, F.col("location_list")).otherwise(F.array(F.lit("")))).alias("l", "location"))
    return steps.crossJoin(places).orderBy("q", "c", "l").limit(cap).select("query", "country", "location")
