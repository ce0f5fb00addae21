"""Canonical tables derived from the given parquet, in SQL that Spark and DuckDB both run.

The SQL of one table is written once; `{ts}` is the literal type of a time without zone in each engine.
Every query reads the given tables through these views, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read

AS_OF = "2024-01-31 00:00:00"

TABLES = {
    "jobs": """
select d.doc_id as id, d.doc_id as arrival_seq, d.source || '_' || cast(d.doc_id as varchar(20)) as external_id, d.source,
 case d.doc_id % 12 when 0 then 'Director Supply Chain (m/w/d)' when 1 then 'Head of Procurement'
   when 2 then 'Senior Head of Procurement' when 3 then 'Logistics Manager' when 4 then 'Leiter Logistik'
   when 5 then 'Supply Chain Intern' when 6 then 'International Operations Director'
   when 7 then 'Director of Retail Operations' when 8 then 'COO - Berlin' when 9 then 'Junior Buyer ' || coalesce(regexp_extract(d.text, '[A-Za-z]{{4,12}}', 0), '')
   when 10 then 'Diretor de Compras' else case d.doc_id % 24 when 11 then 'Chief Data Officer' else 'Chief ' || coalesce(regexp_extract(d.text, '[A-Za-z]{{4,12}}', 0), '') || ' Manager' end end as title,
 case d.doc_id % 7 when 0 then 'Nordwerk GmbH' when 1 then 'Nordwerk' when 2 then 'Nordwerk ' || coalesce(regexp_extract(d.text, '[A-Za-z]{{4,12}}', 0), '') || ' GmbH & Co. KG'
   when 3 then 'VTX AG' when 4 then 'nan' when 5 then 'Hafenlogistik SE' end as company_name,
 case d.doc_id % 5 when 0 then 'Berlin, DE' when 1 then case d.doc_id % 35 when 1 then '12345' else '10115 Berlin' end when 2 then 'Austin, TX' when 3 then 'Düsseldorf' end as location,
 case d.doc_id % 6 when 0 then 'DE' when 1 then 'de' when 2 then 'us' when 3 then 'Remote' when 4 then 'AT' end as country,
 d.text as description, p.url,
 case d.doc_id % 3 when 0 then true when 1 then false end as is_remote,
 {ts} '2024-01-31 00:00:00' - (d.doc_id % 90) * INTERVAL '1' DAY as posted_at,
 {ts} '2024-01-31 00:00:00' - (d.doc_id % 60) * INTERVAL '1' DAY as scraped_at,
 case d.doc_id % 4 when 0 then 'active' when 1 then 'closed' when 2 then 'unreachable' end as url_status,
 case when d.doc_id % 3 > 0 then {ts} '2024-01-31 00:00:00' - (d.doc_id % 50) * INTERVAL '1' HOUR end as url_checked_at
from documents d left join pages p on p.page_id = d.doc_id % (select count(*) from pages)""",
    "job_scores": """
select job_id, user_id, score, ts as scored_at,
 case when score = 0 and (job_id + user_id) % 2 = 0 then cast(null as varchar(9)) else 'note' end as ai_analysis,
 case (job_id + user_id) % 4 when 0 then 'prefilter' when 1 then 'gemini:a' when 2 then 'primary' end as model_version,
 case (job_id * 7 + user_id) % 3 when 0 then 'h' || cast(user_id as varchar(20)) when 1 then 'old' end as profile_hash
from (select event_id % (select count(*) from documents) as job_id, user_id,
  cast(floor(least(100.0, greatest(0.0, value - 20))) as int) as score, ts,
  row_number() over (partition by event_id % (select count(*) from documents), user_id order by ts desc, event_id desc) as rn
  from events) t where rn = 1""",
    "application_events": """
select o_custkey % 150 as user_id, o_orderkey % (select count(*) from documents) as job_id,
  case when o_orderstatus = 'F' then 'rejected' when o_orderstatus = 'O' then 'applied'
       when o_orderpriority = '1-URGENT' then 'interviewing' else 'saved' end as status,
  o_orderdate as changed_at, o_orderkey as event_id from orders""",
    "applications": """
select user_id, job_id, status, changed_at as updated_at from (
 select *, row_number() over (partition by user_id, job_id order by changed_at desc, event_id desc) as rn from application_events) t where rn = 1""",
    "users": """
select c_custkey as user_id, c_name as name, c_acctbal > 0 as is_active,
 case c_custkey % 3 when 0 then 'telegram' when 1 then 'email' else 'google' end as login,
 {ts} '2024-01-31 00:00:00' - c_custkey * INTERVAL '1' DAY as created_at from customer""",
    # The profiles of the users that events know: scoring pairs them with every posting.
    "scored_profiles": """select * from profiles where user_id in (select user_id from events)""",
    "profiles": """
select c_custkey as user_id, 'h' || cast(c_custkey as varchar(20)) as profile_hash,
 case c_custkey % 3 when 0 then 'Head of Procurement, COO' when 1 then 'Director Supply Chain,  director supply chain, nan' else '' end as target_titles,
 case c_custkey % 4 when 0 then 'remote' when 1 then 'onsite' when 2 then 'hybrid' else 'any' end as work_mode,
 case c_custkey % 3 when 0 then 'de,at' when 1 then 'de' else '' end as preferred_countries,
 case c_custkey % 4 when 0 then 'at' when 1 then 'us,de1' else '' end as hidden_countries,
 case c_custkey % 5 when 0 then 'retail' when 1 then 'nan, intern ' when 2 then 'Hafenlogistik SE, growth' else '' end as excluded_keywords,
 case c_custkey % 6 when 0 then 'nordwerk' when 1 then 'VTX AG' else '' end as excluded_companies,
 c_custkey % 2 = 0 as english_only,
 {ts} '2024-01-31 00:00:00' - c_custkey * INTERVAL '1' DAY as updated_at,
 case when c_custkey % 2 = 0 then 'h' || cast(c_custkey as varchar(20)) else 'old' end as embedding_profile_hash
from customer""",
    "ops_events": """
select event_id as id, case event_type when 'purchase' then 'scan' when 'error' then 'api' else event_type end as event_type,
 case when value >= 300 then 'error' when value >= 100 then 'warn' else 'ok' end as status,
 'src' || cast(user_id % 5 as varchar(20)) as source,
 'GET /api/x -> ' || case event_id % 5 when 0 then '401' when 1 then '500' when 2 then '404' else '200' end as message,
 '{{"sources":[{{"name":"src1","api_requests":' || cast(event_id % 7 as varchar(20)) || '}},{{"name":"src2","api_requests":2}}]}}' as payload,
 ts as created_at from events""",
    "fetches": """
select p.page_id * 4 + n as fetch_id, p.url, p.html as body, p.page_id as job_id, {ts} '2024-01-31 00:00:00' - (4 - n) * INTERVAL '1' DAY as checked_at,
 case (p.page_id + n) % 10 when 0 then 404 when 1 then 301 when 2 then 403 when 3 then 503 when 4 then 405 when 5 then cast(null as int) when 6 then 410 when 7 then case p.page_id % 5 when 0 then cast(null as int) else 200 end else 200 end as status_code,
 case (p.page_id + n) % 10 when 1 then case p.page_id % 4 when 0 then '/' when 1 then '/jobs/12345' when 2 then '/careers' else '/job/a1b2c3d4e' end end as location,
 case when (p.page_id + n) % 10 = 5 then case p.page_id % 2 when 0 then 'timeout' else 'unsafe' end end as error_kind,
 case when (p.page_id + n) % 10 = 4 then case p.page_id % 3 when 0 then 200 when 1 then 404 else 302 end end as get_status_code,
 case when (p.page_id + n) % 10 = 4 then case p.page_id % 2 when 0 then '/jobs/98765' else '/careers' end end as get_location
from pages p cross join (select 0 as n union all select 1 union all select 2 union all select 3) k""",
    "vectors": """select vec_id, embedding, label from embeddings""",
}

#: Views that a view is made from.
_NEEDS = {"applications": ["application_events"], "scored_profiles": ["profiles"]}
_GIVEN = {"jobs": ["documents", "pages"], "job_scores": ["documents", "events"], "application_events": ["documents", "orders"], "applications": [], "users": ["customer"], "profiles": ["customer"], "scored_profiles": ["events"], "ops_events": ["events"], "fetches": ["pages"], "vectors": ["embeddings"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical table."""
    for given in _GIVEN[name]:
        read(spark, sf_dir, given).createOrReplaceTempView(given)
    for need in _NEEDS.get(name, []):
        load(spark, sf_dir, need).createOrReplaceTempView(need)
    return spark.sql(TABLES[name].format(ts="TIMESTAMP_NTZ"))


def load_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table jobs with a null url, for what does not read it: texts are not joined with pages, so they are not shuffled.

    Where a page id repeats, a posting comes as often as its page, which only the join can tell."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    if not pages.groupBy("page_id").count().where("count > 1").isEmpty():
        return load(spark, sf_dir, "jobs")
    read(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    spark.sql("select cast(null as bigint) as page_id, cast(null as string) as url").createOrReplaceTempView("pages")
    return spark.sql(TABLES["jobs"].format(ts="TIMESTAMP_NTZ"))


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the tables named, then the query."""
    order = [n for need in names for n in [*_NEEDS.get(need, []), need]]
    tables = ", ".join(f"{n} as ({TABLES[n].format(ts='TIMESTAMP')})" for n in dict.fromkeys(order))
    if not tables:
        return body.strip()
    return f"with {tables} {body.strip()}" if not body.strip().startswith(",") else f"with {tables}{body.rstrip()}"
