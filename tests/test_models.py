"""Order-dependent and stateful operators against plain sequential models, and edge rows of the text functions."""

import datetime as dt
import ipaddress
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.functions import language
from postmill.functions import text as X
from postmill.functions import urls
from postmill.operators import dedup, feed, liveness, rules, scoring, search, stats, store, tracker
from postmill.operators.connected import connected
from postmill.plans import catalog
from postmill.sources import adapters, tables
from postmill.streaming import jobs as S

POSTINGS = "arrival_seq long, id long, source string, title string, company_name string, location string, country string, description string"


def random_postings(n, seed, odd=()):
    """`odd` are places without a root, such as a postal code alone."""
    rng = random.Random(seed)
    pick = rng.choice
    return [
        (i, i, pick(["a", "b", "c"]), pick(["Head of Ops", "head of ops (m/w/d)", "COO"]), pick([None, "", "Acme GmbH", "Acme Tools GmbH", "Tools", "VW", "VW AG"]), pick([None, "", "Berlin, DE", "10115 Berlin", "Köln", *odd]), pick([None, "de", "DE", "at"]), "x" * rng.randint(0, 5))
        for i in range(n)
    ]


def alike(a, b):
    """Whether two prepared rows are the same posting, condition by condition."""
    if a["title_key"] != b["title_key"]:
        return False
    if None not in (a["c_country"], b["c_country"]) and a["c_country"] != b["c_country"]:
        return False
    if places_conflict(a["root"], b["root"]):
        return False
    if a["c_words"] is None or b["c_words"] is None:
        return a["c_words"] is b["c_words"]
    if a["c_tokens"] and b["c_tokens"]:
        return set(a["c_tokens"]) <= set(b["c_tokens"]) or set(b["c_tokens"]) <= set(a["c_tokens"])
    n = min(len(a["c_words"]), len(b["c_words"]))
    return n > 0 and a["c_words"][:n] == b["c_words"][:n]


def sequential_fuzzy(rows):
    """The greedy merge over prepared rows, one after another: all accepted rows of the title are looked through, and counted."""
    accepted, looks = {}, {}
    for r in rows:
        own = accepted.setdefault(r["title_key"], [])
        for n, seen in enumerate(own):
            s = seen["row"]
            if alike(r, s):
                seen["looks"] += n + 1
                if r["source"] not in seen["sources"]:
                    seen["sources"].append(r["source"])
                seen["members"] += 1
                if len(r["description"] or "") > len(s["description"] or ""):
                    seen["row"] = r
                break
        else:
            own.append({"row": r, "slot": r["arrival_seq"], "sources": [r["source"]], "members": 1, "looks": len(own)})
    return {(a["slot"], a["row"]["arrival_seq"], a["members"], tuple(a["sources"]), a["looks"]) for own in accepted.values() for a in own}


def merged_rows(df):
    return {(r["slot"], r["arrival_seq"], r["members"], tuple(r["merged_sources"]), r["comparisons"]) for r in dedup.fuzzy_dedup(df).collect()}


@pytest.mark.parametrize("seed, odd", [(1, ()), (2, ()), (3, ("12345", "DE")), (4, ("12345",))])
def test_fuzzy_dedup_equals_the_sequential_merge(spark, seed, odd):
    df = spark.createDataFrame(random_postings(150, seed, odd), POSTINGS)
    if seed % 2:  # titles whose rows all have a country
        df = df.withColumn("country", F.coalesce(F.nullif("country", F.lit("")), F.lit("fr")))
    rows = sorted((r.asDict() for r in dedup.fuzzy_keys(df).collect()), key=lambda r: r["arrival_seq"])
    assert merged_rows(df.repartition(3)) == sequential_fuzzy(rows)


def test_comparisons_are_those_of_the_whole_title(spark):
    places = ["Berlin", "Hamburg", "Munich", "Berlin", "Hamburg"]
    df = spark.createDataFrame([(i, i, "a", "COO", "Acme", p, "de", "x") for i, p in enumerate(places)], POSTINGS)
    assert sum(r["comparisons"] for r in dedup.fuzzy_dedup(df).collect()) == 6


def test_a_popular_title_is_split_by_what_can_meet(spark):
    """A thousand companies of one title, in chains of names of which each holds the one before, and names without words."""
    rng = random.Random(9)
    names = [f"Firma{rng.randint(0, 60)}" + "".join(f" Werk{w}" for w in range(rng.randint(0, 2))) for _ in range(300)] + ["--", "--", "VW", "VW AG", "VW Nord AG", None]
    rows = [(i, i, rng.choice("ab"), "COO", names[i % len(names)], rng.choice(["Berlin", "Köln", "12345"]), "de", "x" * rng.randint(0, 3)) for i in range(900)]
    df = spark.createDataFrame(rows, POSTINGS)
    prepared = sorted((r.asDict() for r in dedup.fuzzy_keys(df).collect()), key=lambda r: r["arrival_seq"])
    assert merged_rows(df) == sequential_fuzzy(prepared)
    forms = dedup.with_form(dedup.fuzzy_keys(df))
    sets = connected(dedup.form_links(forms)).groupBy("root_form").count().collect()
    assert len(sets) > 20 and max(r["count"] for r in sets) < forms.select("form").distinct().count() / 4


def test_connected_sets(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root_form"] for r in found} == root and connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_place_without_a_root_goes_with_any(spark):
    rows = [(0, 0, "a", "COO", "Acme", "Berlin", "de", "x"), (1, 1, "b", "COO", "Acme", "12345", "de", "long"), (2, 2, "c", "COO", "Acme", None, "de", "x")]
    out = dedup.fuzzy_dedup(spark.createDataFrame(rows, POSTINGS)).collect()
    assert {(r["slot"], r["id"], r["members"]) for r in out} == {(0, 1, 2), (2, 2, 1)}


def test_the_scan_report_adds_up(spark):
    df = spark.createDataFrame(random_postings(150, 6, ("12345",)), POSTINGS)
    unique = dedup.exact_dedup(dedup.with_hash(df))
    merged = dedup.fuzzy_dedup(unique).withColumn("reject_reason", F.when(F.col("source") == "a", "old"))
    got = {r["stage"]: r["n"] for r in stats.scan_report(df, unique, merged).collect()}
    rows = sorted((r.asDict() for r in dedup.fuzzy_keys(unique).collect()), key=lambda r: r["arrival_seq"])
    left = sequential_fuzzy(rows)
    assert (got["raw"], got["exact"], got["unique"], got["fuzzy_removed"]) == (150, len(rows), len(left), len(rows) - len(left))
    assert sum(n for k, n in got.items() if k.startswith("source:")) == 150 and got["kept"] + got["old"] == len(left) and got["comparisons"] == sum(x[4] for x in left)


def test_liveness_state_equals_the_fold(spark):
    rng = random.Random(3)
    rows = [(j, j * 100 + k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), rng.choice([200, 404, 503])) for j in range(40) for k in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "job_id long, fetch_id long, checked_at timestamp_ntz, status_code int").withColumns({"location": F.lit(None).cast("string"), "error_kind": F.lit(None).cast("string"), "get_status_code": F.lit(None).cast("int")})
    got = {r["job_id"]: (r["status"], r["failures"]) for r in liveness.liveness_state(df.withColumn("c", liveness.classify_fetch())).collect()}
    want = {}
    for j, _, _, code in rows:
        status, failures = want.get(j, (None, 0))
        if code == 503:
            want[j] = ("unreachable" if failures + 1 >= 3 else status, failures + 1)
        else:
            want[j] = ("closed" if code == 404 else "active", 0)
    assert got == want


def test_limit_audit_counts_admitted_events_only(spark):
    """Against every pair of events: one counts while it is at most a window old, the far edge included."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), "k", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 300)), i) for i in range(200)]
    rows += [("edge", "k", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 300 + i) for i, s in enumerate([0, 0, 0, 0, 0, 60, 60.001, 61])]
    df = spark.createDataFrame(rows, "subject string, key string, ts timestamp_ntz, event_id long").repartition(4)
    got = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in S.limit_audit(df, 5, 60.0).collect()}
    for subject in ("a", "b", "edge"):
        admitted = []
        for at, event in sorted((r[2], r[3]) for r in rows if r[0] == subject):
            recent = [t for t in admitted if (at - t).total_seconds() <= 60]
            ok = len(recent) < 5
            assert got[event] == (ok, pytest.approx(0 if ok else 60 - (at - recent[0]).total_seconds(), abs=1e-3))
            admitted += [at] if ok else []
    assert [got[300 + i][0] for i in range(8)] == [True] * 5 + [False, True, True]


def test_breaker_opens_until_midnight(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [("x", at(1), False, 1), ("x", at(2), True, 2), ("x", at(3), False, 3), ("x", at(4), False, 4), ("x", at(5), False, 5), ("x", at(6), False, 6), ("y", at(1), False, 7)]
    out = S.breaker_intervals(spark.createDataFrame(rows, "backend string, ts timestamp_ntz, ok boolean, event_id long")).collect()
    assert [(r["backend"], r["opened_at"], r["until"]) for r in out] == [("x", at(5), dt.datetime(2024, 1, 2))]


def test_streams_dedup_and_insert_once(spark, tmp_path):
    rows = [(i, i, "s", f"t{i % 3}", "Acme", None, "DE", "d") for i in range(9)]
    df = dedup.with_hash(spark.createDataFrame(rows, POSTINGS)).withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = S.stream_dedup(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    store = str(tmp_path / "store")
    stream.writeStream.foreachBatch(S.insert_batches(store)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    S.insert_batches(store)(df, 7)  # a later batch adds nothing
    assert spark.read.parquet(store).select("dedup_hash").count() == 3


def test_text_functions_on_edge_rows(spark):
    rows = [("Ärger & Söhne GmbH", "Café (DE) 12345", "2024-01-01T15:30:00+03:00", "€ 50,000 - 60.000"), (None, None, None, None), ("", " ", "bad", "none"), ("nan", "Xy 1", "2024-01-01 01:00:00", "12")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    out = df.select(X.normalize_text(F.col("a")), X.location_root(F.col("b")), X.to_utc_naive(F.col("c")).cast("string"), X.parse_salary(F.col("d"))["max"], X.null_if_placeholder(F.col("a"))).collect()
    assert [r[0] for r in out] == ["arger & sohne", None, "", "nan"]
    assert [r[1] for r in out] == ["cafe", None, None, ""]
    assert [r[2] for r in out] == ["2024-01-01 12:30:00", None, None, "2024-01-01 01:00:00"]
    assert [r[3] for r in out] == [60000.0, None, None, None]
    assert out[3][4] is None and out[2][4] is None


def test_score_responses_are_repaired(spark):
    texts = ['```json\n[{"index":0,"score":120},{"index":1,"score":-4}]\n```', '[{"index":0,"score":50},{"index":1,"sco', '[{"score":7},{"index":9,"score":1},{"index":-1,"score":2}]', "no"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(scoring.parse_score_response(F.col("t"), F.lit(3)).alias("x")).collect()
    assert [[(i["index"], i["score"]) for i in r["x"] or []] for r in out] == [[(0, 100), (1, 0)], [(0, 50)], [(0, 7)], []]


def test_urls_and_redirects(spark):
    cases = {"https://a.example/x": True, "http://10.0.0.1/": False, "ftp://a.example": False, "https://u:p@a.example": False, "https://a.example:8443/": False, "http://[::1]/": False, None: False}
    cases |= {"http://127.0.0.1./": False, "http://localhost./": False, "http://@a.example/": False, "http://2130706433/": False, "http://0x7f.1/": False, "http://a.localhost": False, "http://8.8.8.8./": True, "http://134744072": True}
    cases |= {"HTTP://A.EXAMPLE:80?q": True, "https://a.example:": True, "https://a.example:0/": True, "https://a.example:44x/": False, "http://[fe80::1%25eth0]/": False, "http://[::ffff:127.0.0.1]/": False, "http://[::ffff:808:808]/": True}
    cases |= {"http://[2a00::1": False, "http://[2a00::1]x/": False, "http://[1:2:3]/": False, "http://[2a00::1::2]/": False, "http://0300.0250.0.1/": False, "http://256.1.1.1/": False, "http://1.2.3.4.5/": False, "http://.../": False, "http:///x": False}
    cases |= {"https://a.example/" + "x" * 4079: False, " \thttps://a.ex\nample/": True, "http://192.0.0.9/": True, "http://192.0.0.8/": False, "http://100.64.0.1": False, "http://example.123": False}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    found = df.select("u", urls.is_safe_public_url(F.col("u")).alias("ok"))
    assert {r["u"]: r["ok"] for r in found.collect()} == cases
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_literal_addresses_are_judged_as_the_address_library_does(spark):
    rng = random.Random(8)
    v4 = [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(300)] + [n[i] for b in urls.V4_CLOSED + urls.V4_OPEN for n in [ipaddress.ip_network(b)] for i in (0, -1)]
    v6 = [ipaddress.ip_address(rng.getrandbits(128)) for _ in range(100)] + [n[i] for b in urls.V6_CLOSED + urls.V6_OPEN for n in [ipaddress.ip_network(b)] for i in (0, -1)]
    v6 = [a for a in v6 if a not in ipaddress.ip_network("3fff::/20")]  # older libraries do not know this block
    cases = {f"http://{a}/": a.is_global for a in v4} | {f"http://[{a}]/": a.is_global for a in v6} | {f"http://[{a.exploded}]/": a.is_global for a in v6}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["ok"] for r in df.select("u", urls.is_safe_public_url(F.col("u")).alias("ok")).collect()} == cases


def test_redirects(spark):
    targets = {None: "closed", "/": "closed", "/careers/": "closed", "https://x.example/jobs/12345": "active", "/job/abc": "closed", "/job/a1b2c3d4": "active"}
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", liveness.classify_redirect(F.col("t")).alias("c")).collect()} == targets


def test_intern_is_a_whole_word_and_opted_regions_pass(spark):
    df = spark.createDataFrame([("International Director", "Singapore", None), ("Supply Intern", "Berlin", "de"), ("Head", "Singapore", None)], "title string, location string, country string").withColumns({"description": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    out = df.select(rules.is_intern_title(F.col("title")).alias("i"), rules.is_wrong_region().alias("w"), rules.is_wrong_region(("sg",)).alias("o")).collect()
    assert [(r["i"], r["w"], r["o"]) for r in out] == [(False, True, False), (True, False, False), (False, True, False)]


def test_plug_ins_use_the_given_functions(spark):
    df = spark.createDataFrame([(1, 0, "p")], "user_id long, batch long, prompt string")
    assert scoring.score_with(df, lambda ps: ["r:" + p for p in ps]).first()["response"] == "r:p"
    texts = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert scoring.embed_with(texts, lambda ts: [[float(len(t))] for t in ts], 3).first()["embedding"] == [3.0, 0.0, 0.0]
    assert re.match("p", "p")


def test_duplicate_pair_counts_equal_all_pairs(spark):
    df = spark.createDataFrame(random_postings(80, 5), POSTINGS)
    rows = [r.asDict() for r in dedup.fuzzy_keys(df).collect()]
    pairs = {}
    for b in rows:
        for a in rows:
            equal_forms = all(a[c] == b[c] for c in ("c_tokens", "c_words", "c_country", "root"))
            if a["arrival_seq"] < b["arrival_seq"] and a["title_key"] == b["title_key"] and (equal_forms or alike(b, a)):
                pairs[a["title_key"]] = pairs.get(a["title_key"], 0) + 1
    assert {r["title_key"]: r["pairs"] for r in dedup.duplicate_pair_counts(df).collect() if r["pairs"]} == pairs


def places_conflict(a, b):
    """Places conflict unless both are missing, both are equal, or one is there without a root."""
    return (a is None) != (b is None) or a is not None and a != b and "" not in (a, b)


def brute_rank(head, body, wanted):
    """Every stretch that holds all words while neither of its two shorter ones does."""
    words = [(w, 1.0) for w in head] + [(w, 0.4) for w in body]
    holds = lambda i, j: all(any(w.startswith(q) for w, _ in words[i : j + 1]) for q in wanted)
    total = 0.0
    for i in range(len(words)):
        for j in range(i, len(words)):
            if holds(i, j) and not holds(i + 1, j) and not holds(i, j - 1):
                last = [max(k for k in range(i, j + 1) if words[k][0].startswith(q)) for q in wanted]
                total += sum(words[k][1] for k in last) / len(wanted) / (j - i + 1)
    return round(total, 6)


@pytest.mark.parametrize("term", ["supply direct", "su supply", "su sup supply"])
def test_search_rank_equals_all_stretches(spark, tmp_path, term):
    rng = random.Random(6)
    some = lambda n: [rng.choice(["supply", "sugar", "support", "director", "direct", "of"]) for _ in range(n)]
    rows = [(i, some(3), some(rng.randint(0, 12))) for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(h), None, " ".join(b)) for i, h, b in rows], "id long, title string, company_name string, description string")
    wanted = term.split()
    got = {r["id"]: r["rank"] for r in feed.search_rank(df, term).collect()}
    assert got == {i: brute_rank(h, b, wanted) for i, h, b in rows if i in got}
    assert set(got) == {i for i, h, b in rows if all(any(w.startswith(q) for w in h + b) for q in wanted)}
    search.write_token_index(df, str(tmp_path / "index"))
    assert {r["id"]: r["rank"] for r in search.indexed_rank(search.read_token_index(spark, str(tmp_path / "index")), term).collect()} == got


def test_the_index_reads_the_letters_asked_for(spark, tmp_path):
    texts = ["Supply ünder été", "x_ray a1 9to5", "супер s", None, "su", "Z-supplier", "_mark a_b a"]
    df = spark.createDataFrame([(i, t, None, "Ärger über Öl") for i, t in enumerate(texts)], "id long, title string, company_name string, description string")
    search.write_token_index(df, str(tmp_path / "index"))
    index = search.read_token_index(spark, str(tmp_path / "index"))
    for term in ("su", "s", "SUPPL", "ün", "été", "x", "x_", "a1", "9", "9to", "суп", "öl über", "z su", "_", "a_b", "a", "s öl", "nothing", "", "& *"):
        assert {r["id"] for r in search.indexed_search(index, term).collect()} == {r["id"] for r in feed.prefix_search(df, term).collect()}, term
    plan = search.indexed_search(index, "supply")
    assert {f.split("letters=")[1].split("/")[0] for f in index.where(search._range("supply")).inputFiles()} >= {"su"}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(letters" in text and "(letters" in text.split("PartitionFilters")[1] and "GreaterThanOrEqual(token,supply)" in text


def test_profile_hash_ignores_order_blanks_and_other_columns(spark):
    rows = [(1, " remote", ["b", " a ", ""], "x"), (2, "remote ", ["a", "b"], "y"), (3, "onsite", ["a", "b"], "x"), (4, "remote", ["a"], "x"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "user_id long, work_mode string, titles array<string>, shown string")
    h = {r["user_id"]: r["h"] for r in df.select("user_id", tracker.profile_hash(["work_mode"], ["titles"]).alias("h")).collect()}
    assert h[1] == h[2] and len(set(h.values())) == 4 and None not in h.values()
    other = df.where("user_id = 1").select(tracker.profile_hash(["work_mode"], ["titles"], "2")).first()[0]
    assert other != h[1]


def test_merged_postings_are_those_of_several_sources(spark):
    """T09 over the small table: newest first, as the sequential merge has them."""
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.asDict() for r in dedup.fuzzy_keys(catalog.unique_jobs(spark, sf)).collect()), key=lambda r: r["arrival_seq"])
    by_seq = {r["arrival_seq"]: r for r in rows}
    merged = sorted(((-by_seq[kept]["scraped_at"].timestamp(), by_seq[kept]["id"], len(sources)) for _, kept, _, sources, _ in sequential_fuzzy(rows) if len(sources) > 1))
    assert merged and [(r["id"], r["n_sources"]) for r in catalog.QUERIES["T09_merged_postings"](spark, sf).collect()] == [(i, n) for _, i, n in merged[:50]]


def test_profile_text_leaves_out_what_is_missing(spark):
    schema = "resume string, target_titles array<string>, work_mode string, preferred_countries array<string>, excluded_keywords array<string>, excluded_companies array<string>, english_only boolean"
    rows = [(None,) * 7, (" ", [], "", [], [], [], False), ("r" * 2501, ["COO"], None, None, ["sales"], ["X"], True)]
    out = [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(scoring.profile_text()).collect()]
    assert out[0] == out[1] == "No profile"
    assert out[2] == "Background\n" + "r" * 2500 + "\n[cut]\n\nPreferences\nRoles: COO\n\nReject if required\nsales\n\nReject employers\nX\n\nLanguage\nEnglish only"


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_tables_come_back_and_layout_prunes(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "x, y", "a"), (2, None, "b"), (3, "z", "a")], "id long, t string, source string")
    path = str(tmp_path / kind)
    tables.write_table(df, path, kind, by=("source",))
    back = tables.read_table(spark, path, kind, "id long, t string, source string")
    assert {tuple(r) for r in back.select("id", "t", "source").collect()} == {(1, "x, y", "a"), (2, None, "b"), (3, "z", "a")}
    assert {r["id"] for r in back.where("source = 'a'").collect()} == {1, 3}
    with pytest.raises(Exception, match="exists"):
        tables.write_table(df, path, kind)


def test_redaction_takes_whole_values_of_named_keys(spark):
    deep = '{"a":' * 7 + "1" + "}" * 7
    cases = {
        '{"excluded_companies": ["Acme", {"x": "Tools"}], "n": 1.50}': '{"excluded_companies":"***","n":1.50}',
        '{"a":[{"Name":{"first":"Ann","last":["Lee"]},"b":"n\\"ame"}],"c":null}': '{"a":[{"Name":"***","b":"n\\"ame"}],"c":null}',
        '{"name":"x","d":{"name":7}}': '{"name":"***","d":{"name":"***"}}',
        deep: deep.replace("1", '"[depth-limit]"'),
        'got {"name":"x","k":1} and {"name":["Ann"': 'got {"name":"***","k":1} and {"name":"***"',
        None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, payload string")
    out = df.select("i", language.redact_json(F.col("payload"), ("name", "excluded_companies")).alias("p")).collect()
    assert [r["p"] for r in sorted(out)] == list(cases.values())


@pytest.mark.parametrize("tile", [2048, 4])
def test_every_query_vector_gets_its_nearest_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(scoring, "QUERY_TILE", tile)
    monkeypatch.setattr(scoring, "ROW_TILE", 4 * tile)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    asked = [r for r in rows if r[0] % 4 == 0]
    out = scoring.similarity(spark.createDataFrame(rows, "id long, embedding array<float>"), spark.createDataFrame(asked, "query_id long, embedding array<float>"), 5)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((-r["cosine"], r["id"]))
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v in rows}
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in unit)[:5]] for q, _ in asked}


def test_prompts_and_top_k_leave_no_profile_or_query_vector_out(spark):
    sf = "/root/testdata/sf0.001"
    users = {r["user_id"] for r in catalog.load(spark, sf, "scored_profiles").collect()}
    assert len(users) > 10 and {r["user_id"] for r in catalog.QUERIES["F30_prompts"](spark, sf).select("user_id").distinct().collect()} == users
    asked = {r["vec_id"] for r in catalog.load(spark, sf, "vectors").where("vec_id % 100 = 0").collect()}
    assert {r["query_id"] for r in catalog.QUERIES["T08_semantic_top_k"](spark, sf).select("query_id").distinct().collect()} == asked


TEXTS = {
    "en": "We are looking for a leader of the supply chain team. The role is based in our office and you will work with the board on the plan that is to come.",
    "de": "Wir suchen für den Einkauf eine Leitung mit Erfahrung. Das Team ist in der Zentrale und die Arbeit mit den Partnern ist von Vertrauen und Freude geprägt, supply chain.",
    "fr": "Nous cherchons une personne pour la direction de la supply chain dans le groupe. Les missions et les projets sont pour une équipe que la direction et le conseil est heureux de voir.",
    "es": "Buscamos una persona para el equipo de la supply chain con experiencia. Los proyectos por venir son para una empresa que es del grupo y para los socios con las metas.",
}


def profile(spark, **given):
    row = {"user_id": 1, "work_mode": "any", "english_only": False, "target_titles": "", "preferred_countries": "", "excluded_keywords": "", "excluded_companies": "", **given}
    return rules.profile_terms(spark.createDataFrame([tuple(row.values())], "user_id long, work_mode string, english_only boolean, target_titles string, preferred_countries string, excluded_keywords string, excluded_companies string"))


def posting_rows(spark, rows):
    return rules.job_flags(spark.createDataFrame([(i, t, x, c, k, r) for i, (t, x, c, k, r) in enumerate(rows)], "id long, title string, description string, company_name string, country string, is_remote boolean"))


def test_english_only_profiles_reject_texts_surely_in_another_language(spark):
    flags = posting_rows(spark, [("Head of Supply Chain", t, None, None, None) for t in TEXTS.values()] + [("Head of Supply Chain", "kurz und gut", None, None, None), ("Leiter Logistik", TEXTS["en"], None, None, None), ("Head of Supply Chain", TEXTS["de"].replace(" ", "&nbsp; "), None, None, None)])
    strict = {r["id"]: (r["rule"], r["passed"], r["bucket"]) for r in rules.pre_filter(flags, profile(spark, english_only=True)).collect()}
    assert [strict[i] for i in range(7)] == [(14, True, "high"), (8, False, "low"), (8, False, "low"), (8, False, "low"), (14, True, "high"), (8, False, "low"), (8, False, "low")]
    assert all(r["rule"] != 8 for r in rules.pre_filter(flags, profile(spark)).collect())


def test_rules_decide_in_their_order(spark):
    cases = [
        (("Supply Chain Intern", "x", None, None, None), 1, (False, "low")),
        (("Interim COO", "supply chain", None, None, None), 2, (False, "low")),
        (("Legal Director", "supply chain", None, None, None), 3, (False, "low")),
        (("Sales Director", "supply chain", None, None, None), 4, (False, "low")),
        (("Director Operations", "French required", None, None, None), 5, (False, "low")),
        (("Director Operations", "with growth", None, None, None), 6, (False, "low")),
        (("Director Operations", "x", " ACME  Tools", None, None), 7, (False, "low")),
        (("Director Finance", "x", None, None, None), 9, (False, "low")),
        (("Director Operations", "x", None, None, False), 10, (False, "low")),
        (("Director Operations", "x", None, None, None), 10, (False, "low")),
        (("Director Operations", "remote", None, "us", None), 11, (False, "low")),
        (("Head of Legal Procurement", "x", None, None, True), 12, (True, "high")),
        (("Logistics Manager", "x", None, "Remote", True), 13, (False, "manager_tier2")),
        (("Senior Logistics Manager", "x", None, None, True), 13, (False, "manager_tier2")),
        (("Director Operations", "x", None, "de", True), 14, (True, "high")),
        (("Lead Logistics Manager", "x", None, None, True), 15, (True, "medium")),
        (("Logistics Buyer", "x", None, None, True), 15, (True, "medium")),
    ]
    terms = profile(spark, work_mode="remote", english_only=True, target_titles="Head Legal Procurement", preferred_countries="DE", excluded_keywords="Growth, nan", excluded_companies="acme tools")
    flags = posting_rows(spark, [c for c, _, _ in cases])
    out = {r["id"]: (r["rule"], (r["passed"], r["bucket"])) for r in rules.pre_filter(flags, terms).collect()}
    assert [out[i] for i in range(len(cases))] == [(rule, verdict) for _, rule, verdict in cases]
    pairs = spark.createDataFrame([(3, 1), (14, 1), (5, 9)], "id long, user_id long")
    assert {(r["id"], r["rule"]) for r in rules.pre_filter_pairs(pairs, flags, terms).collect()} == {(3, 4), (14, 14)}


def test_the_queue_cuts_before_it_shuffles(spark):
    rows = [(u, i, i % 3 == 0 and u > 0, "low" if i % 2 else "manager_tier2") for u in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, id long, passed boolean, bucket string")
    queue = scoring.tiered_queue(df, tier1=5, rejects=8)
    want = set()
    for u in range(3):
        tiers = {1: [i for x, i, p, _ in rows if x == u and p], 2: [i for x, i, p, b in rows if x == u and not p and b == "manager_tier2"], 3: [i for x, i, p, b in rows if x == u and not p and b == "low"]}
        for t, ids in tiers.items():
            if t != 2 or not tiers[1]:
                want |= {(u, i, t, n + 1) for n, i in enumerate(sorted(ids)[: 8 if t == 3 else 5])}
    assert {tuple(r) for r in queue.select("user_id", "id", "tier", "place").collect()} == want
    assert "WindowGroupLimit" in queue._jdf.queryExecution().executedPlan().toString()


def test_an_alias_of_a_target_title_is_an_explicit_match(spark):
    titles = ["Chefe de Compras", "Gerente Geral de Suprimentos (m/w/d)", "Head of Procurement", "Diretor de Vendas"]
    jobs = spark.createDataFrame([(i, t, "text", None, None, None) for i, t in enumerate(titles)], "id long, title string, description string, company_name string, country string, is_remote boolean")
    profile = spark.createDataFrame([(1, "any", False, "Head  of Procurement", "", "", "")], "user_id long, work_mode string, english_only boolean, target_titles string, preferred_countries string, excluded_keywords string, excluded_companies string")
    out = {r["id"]: (r["passed"], r["bucket"]) for r in rules.pre_filter(rules.job_flags(jobs), rules.profile_terms(profile)).collect()}
    assert [out[i] for i in range(4)] == [(True, "high")] * 3 + [(False, "low")]


def test_profile_blocks_are_bounded_and_leave_nobody_out(spark, monkeypatch):
    jobs = spark.createDataFrame([(i, t, "supply chain", None, None, None) for i, t in enumerate(["COO", "Head of Ops"])], "id long, title string, description string, company_name string, country string, is_remote boolean")
    profiles = spark.createDataFrame([(u, "any", False, "COO" if u % 2 else "", "", "", "") for u in range(7)] + [(7, "any", False, "Other", "", "", "")], "user_id long, work_mode string, english_only boolean, target_titles string, preferred_countries string, excluded_keywords string, excluded_companies string")
    flags, terms = rules.job_flags(jobs), rules.profile_terms(profiles)
    sizes, judged = [], rules._judged
    monkeypatch.setattr(rules, "_judged", lambda f, t: sizes.append(t.count()) or judged(f, t))
    got = rules.pre_filter(flags, terms, size=2).collect()
    # Eight profiles have three signatures: a posting meets each of these once.
    assert sizes == [2, 1] and len(got) == 16
    pairs = flags.select("id").crossJoin(terms.select("user_id"))
    assert sorted(got) == sorted(rules.pre_filter_pairs(pairs, flags, terms).collect())
    counts = {(r["user_id"], r["bucket"]): r["n"] for r in rules.bucket_counts(flags, terms).collect()}
    assert sum(counts.values()) == 16 and counts == {(u, b): sum((r["user_id"], r["bucket"]) == (u, b) for r in got) for u, b in counts}


def test_a_broken_state_still_gives_its_postings(spark):
    entry = lambda i: f'"JobAd:{i}":{{"id":"{i}","title":"T{i}","activatedAt":"2024-01-0{i}T00:00:00Z"}}'
    bodies = ["{" + entry(1) + "," + entry(2) + "}</script>", "{" + entry(1) + ',"Page:0":{"id":"x","a":[{}]},' + entry(2) + ',"JobAd:3":{"id":"3","ti', "no state", "{}</script>"]
    df = spark.createDataFrame([(i, f'<script id="state">{b}' if "state" not in b else b) for i, b in enumerate(bodies)], "arrival_seq long, payload string")
    out = adapters.from_embedded_state(df, "JobAd:").collect()
    assert sorted((r["arrival_seq"] // adapters.PLACES, r["external_id"], r["title"]) for r in out) == [(i, f"state_{k}", f"T{k}") for i in (0, 1) for k in (1, 2)]


def test_places_beyond_the_packing_are_an_error_not_a_wrong_order(spark):
    df = spark.createDataFrame([(1, adapters.PLACES - 1), (2, 5)], "arrival_seq long, p int")
    assert [r[0] for r in df.select(adapters._placed(F.col("arrival_seq"), F.col("p"))).collect()] == [2 * adapters.PLACES - 1, 2 * adapters.PLACES + 5]
    with pytest.raises(Exception, match="smaller pages"):
        df.select(adapters._placed(F.col("arrival_seq"), F.col("p") + 1)).collect()
    union = adapters.union_sources({"a": df, "b": df})
    assert len({r["arrival_seq"] for r in union.collect()}) == 4
    with pytest.raises(Exception, match="too large"):
        adapters.union_sources({"a": df.withColumn("arrival_seq", F.lit(1 << 57))}).collect()


def test_scan_scope_falls_back_to_defaults(spark):
    schema = "user_id long, target_titles string, preferred_countries string"
    df = spark.createDataFrame([(2, "COO,  Head  of X", "nan"), (1, "coo", "")], schema)
    got = {(r["kind"], r["item"], r["user_id"]) for r in adapters.scan_scope(df, ("Buyer",), ("de", "at")).collect()}
    assert got == {("title", "coo", 1), ("title", "Head of X", 2), ("country", "de", None), ("country", "at", None)}


def test_a_plan_keeps_the_top_queries_in_all_countries(spark):
    queries = spark.createDataFrame([("Zeta top", 0), ("Alpha low", 1), (None, 2)], "query string, place int")
    places = spark.createDataFrame([("Wien", 1), ("Aachen", 2)], "location string, place int")
    plan = lambda *a, **k: [tuple(r) for r in adapters.crawl_plan(*a, **k).collect()]
    assert plan(queries, ["de", "br"], places.limit(0), 2) == [("Zeta top", "de", ""), ("Zeta top", "br", "")]
    local = {"br": {"zeta top": ["Zeta local", "ALPHA LOW"]}}
    assert plan(queries, ["br", "de"], places, 80, local) == [
        (q, c, p) for q, c in [("Zeta top", "br"), ("Zeta top", "de"), ("Zeta local", "br"), ("Alpha low", "de"), ("ALPHA LOW", "br")] for p in ("Wien", "Aachen")
    ]
    assert plan(queries.limit(0), ["de"], places) == []


def test_pages_after_a_key_lose_and_repeat_nothing(spark):
    rng = random.Random(2)
    at = lambda: None if rng.random() < 0.3 else dt.datetime(2024, 1, rng.randint(1, 3))
    df = spark.createDataFrame([(at(), at(), i) for i in range(40)], "posted_at timestamp_ntz, scraped_at timestamp_ntz, id long")
    for down in (True, False):
        whole = [tuple(r) for r in feed.feed_page(df, "date", down, 1, 100).collect()]
        seen = whole[:7]
        while page := [tuple(r) for r in feed.after_key(df, tuple(x and str(x) for x in seen[-1][:2]) + (seen[-1][2],), 7, down).collect()]:
            seen += page
        assert seen == whole


def test_feeds_by_schema(spark):
    item = lambda title, link, date, more="": f"<item{more}><title>{title}</title><link>{link}</link><pubDate>{date}</pubDate></item>"
    payloads = [
        "<rss xmlns:rdf='x'><channel>" + item("Head of procurement // A", "u1", "Tue, 05 Mar 2024 10:00:00 +0300", " rdf:about='q'") + item("Procurement", "", "x") + item("", "u2", "x") + "</channel></rss>",
        "<feed>" + item("<![CDATA[Procurement & more // B]]>", " u3 ", "5 Mar 2024 10:00:00 EST") + item("Cook", "u4", "x").replace("<link>", "<description>procurement</description><link>") + "</feed>",
        "<rss><item><title>procurement",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "arrival_seq long, payload string")
    rows = adapters.from_rss(df, spark.createDataFrame([], "url string, html string"), ["procurement"]).collect()
    assert sorted((r["title"], r["company_name"], r["url"], str(r["posted_at"])) for r in rows) == [("Head of procurement", "A", "u1", "2024-03-05 07:00:00"), ("Procurement & more", "B", "u3", "2024-03-05 15:00:00")]
    assert [r["arrival_seq"] for r in adapters.broken_feeds(df).collect()] == [2]


def test_rotation_wraps_around(spark):
    items = adapters.numbered(spark.createDataFrame([(f"q{i % 5}",) for i in range(9)] + [(None,)], "item string"), "item")
    assert sorted((r["item"], r["place"], r["size"]) for r in items.collect()) == [(f"q{i}", i, 5) for i in range(5)]
    assert [[r["item"] for r in adapters.rotate(items, slot, 2).collect()] for slot in range(3)] == [["q0", "q1"], ["q2", "q3"], ["q4", "q0"]]


def test_second_probes_and_markers_decide(spark):
    schema = "url string, body string, status_code int, location string, error_kind string, get_status_code int, get_location string"
    rows = [
        ("https://jobs.board.example/1", "x" * 49_990 + " GONE now", 200, None, None, None, None),
        ("https://board.example/2", "x" * 50_000 + " gone now", 200, None, None, None, None),
        ("https://other.example/3", "gone now", 200, None, None, None, None),
        ("https://board.example/4", "", 405, "/jobs/99999", None, 302, "/careers"),
        ("https://board.example/5", "", 405, None, None, 302, "/jobs/99999"),
        ("https://board.example/6", "gone", None, None, "timeout", None, None),
        ("https://board.example/7", None, None, None, None, None, None),
    ]
    df = liveness.with_gone_marker(spark.createDataFrame(rows, schema), {"board.example": ["gone"]})
    found = df.withColumn("c", liveness.classify_fetch(F.col("gone_marker"), F.col("get_location")))
    got = {r["url"][-1]: (r["c"]["status"], r["c"]["transient"], r["c"]["soft404"]) for r in found.collect()}
    assert got == {"1": ("closed", False, True), "2": ("active", False, False), "3": ("active", False, False), "4": ("closed", False, False), "5": ("active", False, False), "6": ("unreachable", True, False), "7": ("active", False, False)}
    n = liveness.liveness_counts(found).first()
    assert (n["checked"], n["skipped"], n["soft_404"], n["closed"]) == (6, 1, 1, 2)


def test_actions_respect_owners_and_leave_history(spark):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    current = spark.createDataFrame([(1, 10, "saved", at(0), None), (1, 11, "applied", at(0), at(0))], "user_id long, job_id long, status string, updated_at timestamp_ntz, applied_at timestamp_ntz")
    actions = [
        (1, 10, "saved", at(1), 1, None),  # there already
        (1, 10, "applied", at(2), 2, None),
        (1, 11, "applied", at(3), 3, 1),  # an update keeps the first time
        (1, 11, "offer", at(4), 4, 2),  # not the owner's
        (1, 12, "offer", at(5), 5, 1),  # nothing to update
        (1, 13, "saved", at(6), 6, None),
        (1, 13, "rejected", at(7), 7, 1),
        (1, 14, "applied", at(8), 8, None),
        (1, 14, "bad", at(9), 9, None),
        (1, 14, "applied", at(10), 10, None),  # again: the time moves
    ]
    a = spark.createDataFrame(actions, "user_id long, job_id long, action string, at timestamp_ntz, seq long, owner_id long")
    got = {r["job_id"]: (r["status"], r["applied_at"]) for r in tracker.apply_actions(current, a).collect()}
    assert got == {10: ("applied", at(2)), 11: ("applied", at(0)), 13: ("rejected", None), 14: ("applied", at(10))}
    history = {(r["job_id"], r["seq"], r["old_status"], r["new_status"]) for r in tracker.action_history(current, a).collect()}
    assert history == {(10, 2, "saved", "applied"), (11, 3, "applied", "applied"), (13, 7, "saved", "rejected"), (14, 8, None, "applied"), (14, 10, "applied", "applied")}


def drained(stream, tmp_path, mode="append"):
    """Rows of a stream over all micro-batches, in order of the batches."""
    out = []
    stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend((i, r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def in_files(spark, tmp_path, frames):
    """Each frame a file of its own, read as one micro-batch each."""
    import os
    import time

    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(tmp_path / "in" / name, tmp_path / "in" / f"b{i}.parquet")
                os.utime(tmp_path / "in" / f"b{i}.parquet", (time.time() - 100 + i,) * 2)
    return spark.readStream.option("maxFilesPerTrigger", 1).schema(frames[0].schema).parquet(str(tmp_path / "in"))


def test_liveness_as_a_stream_folds_over_micro_batches(spark, tmp_path):
    """Several micro-batches, checks of one time by fetch_id; the batch form gives the same; a job long unseen is forgotten."""
    rng = random.Random(7)
    rows = [(j, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 2), 100 * j + k, rng.choice(["active", "closed", "unreachable"])) for k in range(18) for j in range(5)]
    df = spark.createDataFrame([(j, t, f, s, s == "unreachable") for j, t, f, s in rows], "job_id long, checked_at timestamp_ntz, fetch_id long, status string, transient boolean")
    frames = [df.where((F.hour("checked_at") >= a) & (F.hour("checked_at") < a + 3)) for a in (0, 3, 6)]
    got = {r["job_id"]: (r["status"], r["failures"]) for r in drained(S.liveness_stream(in_files(spark, tmp_path, frames)), tmp_path, "update")}
    want = {}
    for j, _, _, status in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before, failures = want.get(j, (None, 0))
        want[j] = ("unreachable" if failures >= 2 else before, failures + 1) if status == "unreachable" else (status, 0)
    assert got == want
    batch = liveness.liveness_state(df.select("job_id", "checked_at", "fetch_id", F.struct("status", "transient").alias("c")))
    assert {r["job_id"]: (r["status"], r["failures"]) for r in batch.collect()} == want


def test_state_has_a_lifetime(spark, tmp_path):
    """Keys that no later event can need leave the state once the watermark has passed their time."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    frames = [spark.createDataFrame([(f"s{n}-{i}", "k", day(n), n * 10 + i, False) for i in range(5)], "subject string, key string, ts timestamp_ntz, event_id long, ok boolean") for n in range(0, 50, 10)]
    for name, run, mode in (
        ("limit", lambda x: S.limit_stream(x, 3, 60.0), "append"),
        ("breaker", lambda x: S.breaker_stream(x.withColumnRenamed("subject", "backend"), days=5), "append"),
        ("live", lambda x: S.liveness_stream(x.select((F.col("event_id") % 100).alias("job_id"), F.col("ts").alias("checked_at"), F.col("event_id").alias("fetch_id"), F.lit("active").alias("status"), F.lit(False).alias("transient")), days=5), "update"),
    ):
        path = tmp_path / name
        path.mkdir()
        query = run(in_files(spark, path, frames)).writeStream.outputMode(mode).format("noop").option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert len(held) >= 5 and max(held) < 25 and held[-1] <= 20, (name, held)


def test_a_late_duplicate_comes_again_after_the_delay(spark, tmp_path):
    """The watermark moves with the events, and what it leaves behind is dropped from the state."""
    at = lambda d: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d)
    frames = [spark.createDataFrame([(h, at(n)) for h in hashes], "dedup_hash string, event_time timestamp") for n, hashes in enumerate([["a", "a", "b"], ["a"], ["c"], ["d"], ["e"], ["f"], ["g"], ["a"], ["g"]])]
    query = S.stream_dedup(in_files(spark, tmp_path, frames), "1 day")
    found = sorted(r["dedup_hash"] for r in drained(query, tmp_path))
    assert found == sorted("aabcdefg")


def test_alerts_join_before_the_sink_and_replay_the_same(spark, tmp_path):
    jobs = spark.createDataFrame([(i, "at" if i % 2 else "de") for i in range(8)], "id long, country string")
    profiles = spark.createDataFrame([(1, "at"), (2, "")], "user_id long, hidden_countries string")
    frames = [spark.createDataFrame([(u, j, 75 + j) for u in (1, 2) for j in js], "user_id long, job_id long, score int") for js in ([0, 1, 5, 6], [2, 7])]
    alerts = S.match_alerts(in_files(spark, tmp_path, frames), jobs, profiles)
    for sink in ("x", "y"):
        write = S.alert_batches(str(tmp_path / sink), 2)
        alerts.writeStream.foreachBatch(lambda b, i, w=write: (w(b, i), w(b, i))).option("checkpointLocation", str(tmp_path / f"c{sink}")).trigger(availableNow=True).start().awaitTermination(180)
    for sink in ("x", "y"):
        got = {(r["batch"], r["user_id"], r["job_id"], r["place"]) for r in spark.read.parquet(str(tmp_path / sink)).collect()}
        assert got == {(0, 1, 6, 1), (0, 2, 6, 1), (0, 2, 5, 2), (1, 2, 7, 1)}


def test_a_store_rewrites_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "store")
    kinds = "dedup_hash string, arrival_seq long, country string"
    rows = lambda ids, c="DE": spark.createDataFrame([(f"h{i}", i, c) for i in ids], kinds)
    held = lambda **k: sorted((r["dedup_hash"], r["country"]) for r in store.read_store(spark, path, kinds, **k).collect())
    assert held() == []
    first = store.insert_batch(rows(range(40)), path, 0, buckets=8)
    assert len(first) > 4 and held() == sorted((f"h{i}", "de") for i in range(40))
    # Known rows change nothing; one new row changes one bucket, and the plan reads this bucket only.
    assert store.insert_batch(rows(range(40), "at"), path, 1, buckets=8) == set()
    changed = store.insert_batch(rows([3, 99, 99]), path, 2, buckets=8)
    assert len(changed) == 1 and ("h99", "de") in held() and len(held()) == 41
    files = store.read_store(spark, path, kinds, changed).inputFiles()
    assert files and all(f"bucket={k}/" in f for f in files for k in changed)
    # Cut short after the data and before the commit: no trace. The same batch again: the same rows.
    before = held()
    (tmp_path / "store" / "commits" / "batch=2").rename(tmp_path / "lost")
    assert ("h99", "de") not in held() and len(held()) == 40
    assert store.insert_batch(rows([3, 99, 99]), path, 2, buckets=8) == changed and held() == before
    assert store.insert_batch(rows([3, 99, 99]), path, 2, buckets=8) == changed and held() == before
    assert len(held(before=2)) == 40
    assert store.outdated(spark, path) == [f"{path}/data/batch=0/bucket={k}" for k in changed]


def test_scores_are_upserted_in_their_buckets(spark, tmp_path):
    path, kinds = str(tmp_path / "store"), "job_id long, user_id long, score int, profile_hash string, model_version string"
    make = lambda rows: spark.createDataFrame(rows, kinds)
    old = [(j, 1, 10, "h", "m") for j in range(30)]
    store.upsert_batch(make(old), path, 0, buckets=8)
    assert store.upsert_batch(make([(j, 1, 99, "h", "m") for j in range(30)]), path, 1, buckets=8) == set()
    new = [(5, 1, 50, "other", "m"), (77, 2, 60, None, None)]
    changed = store.upsert_batch(make(new), path, 2, buckets=8)
    assert 1 <= len(changed) <= 2
    found = sorted(tuple(r)[:5] for r in store.read_store(spark, path, kinds).drop("bucket").collect())
    assert found == sorted([r for r in old if r[0] != 5] + new)


def test_limits_and_breakers_as_streams_equal_their_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted((rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 200_000)), rng.random() < 0.5, i) for i in range(150))
    rows.sort(key=lambda r: (r[1], r[3]))
    df = spark.createDataFrame([(s, "k", t, ok, i, n // 50) for n, (s, t, ok, i) in enumerate(rows)], "subject string, key string, ts timestamp_ntz, ok boolean, event_id long, part int")
    stream = in_files(spark, tmp_path, [df.where(F.col("part") == p) for p in range(3)])
    got = {(r["event_id"], r["admitted"], round(r["retry_after"], 3)) for r in drained(S.limit_stream(stream, 3, 9000.0), tmp_path)}
    assert got == {(r["event_id"], r["admitted"], round(r["retry_after"], 3)) for r in S.limit_audit(df, 3, 9000.0).collect()}
    calls = lambda d: d.select(F.col("subject").alias("backend"), "ts", "ok", "event_id")
    opened = drained(S.breaker_stream(calls(stream)), tmp_path / "b")
    batch = S.breaker_intervals(calls(df)).collect()
    seconds = lambda t: t.replace(tzinfo=dt.timezone.utc).timestamp()
    assert len(batch) > 2 and {(r["backend"], r["opened_at"].timestamp(), r["until"].timestamp()) for r in opened} == {(r["backend"], seconds(r["opened_at"]), seconds(r["until"])) for r in batch}


def test_late_events_are_dropped_and_windows_slide(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m, tzinfo=dt.timezone.utc)
    schema = "ts timestamp, event_type string, status string"
    frames = [spark.createDataFrame([(t, "scan", "ok") for t in ts], schema) for ts in ([at(1, 5), at(1, 20)], [at(6, 0)], [at(6, 5)], [at(1, 30), at(6, 10)], [at(12, 0)])]
    rows = drained(S.event_rate_windows(in_files(spark, tmp_path, frames), "1 hour", "30 minutes"), tmp_path)
    hours = {(r["start"].astimezone(dt.timezone.utc).strftime("%H:%M"), r["n"]) for r in rows}
    assert hours == {("00:30", 2), ("01:00", 2), ("05:30", 3), ("06:00", 3)}  # the event of 01:30 came too late


def test_a_database_table_is_read_in_parts_with_its_filters(spark, tmp_path):
    """JDBC against the database that Spark ships: round trip, several queries, filters and columns in the database."""
    url = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"t{i}", None if i % 7 == 0 else i * 0.5) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, title string, score double")
    tables.write_table(df, None, "jdbc", mode="overwrite", dbtable="jobs", **url)
    back = tables.read_table(spark, None, "jdbc", dbtable="jobs", **url)
    assert sorted(tuple(r) for r in back.collect()) == rows
    parts = tables.read_split(spark, url["url"], "jobs", "id", 4, driver=url["driver"])
    assert parts.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in parts.collect()) == rows
    some = parts.where((F.col("id") >= 90) & F.col("score").isNotNull()).select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(id,90)" in plan and "title" not in plan
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(90, 100) if i % 7]


def test_a_missing_package_of_the_training_operators_costs_only_these(monkeypatch):
    import builtins
    import sys

    import __spark_entry__

    whole = set(__spark_entry__.queries())
    kept = {name: sys.modules.pop(name) for name in list(sys.modules) if name.split(".")[0] in ("corpus_pipeline", "public_tokenizers") or name.startswith("postmill.llm")}
    real = builtins.__import__
    try:
        monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ModuleNotFoundError(name)) if name == "public_tokenizers" else real(name, *a, **k))
        left = set(__spark_entry__.queries())
        assert left and not any(q.startswith("op") or q == "pipeline" for q in left) and left == {q for q in whole if not q.startswith("op") and q != "pipeline"}
        assert set(__spark_entry__.oracle_sql()) <= left
    finally:
        monkeypatch.undo()
        sys.modules.update(kept)
