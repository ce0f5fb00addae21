"""What the review of round 4 found, on small tables."""

import duckdb
from pyspark.sql import functions as F

from postmill.functions import text as X
from postmill.operators import rules, scoring
from postmill.plans import catalog


def test_entities_that_were_cut_stay_as_they_are(spark, tmp_path):
    odd = ["<title>the&amp;&amp;&amp</title>", "a &am b &quo c &copy d &lt", "x&amp;amp;lt; &middot;&copy;2024", "&lt;b&gt; &quot;q&quot; &amp;quot;", "no entity", "<script>var t='&amp';</script>&amp"]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.execute(catalog.ORACLE_SQL["F13_page_text"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["F13_page_text"](spark, str(tmp_path)).collect()) == sorted(theirs)
    paragraph = "<p>" + "word " * 30 + "&amp; &quot;end&quot; &am</p>"
    texts = spark.createDataFrame([(paragraph,), ("<div class='x'></div><p>&#65;&#x42;&unknown;&amp</p>",)], "html string")
    assert texts.select(X.main_text(F.col("html"))).first()[0].endswith('word & "end" &am')
    assert [r[0] for r in texts.select(X.html_to_text(F.col("html"))).collect()][1] == "AB&unknown;&amp"


def test_users_come_to_the_rows_of_their_signature(spark, monkeypatch):
    terms = spark.createDataFrame([(u, "ab"[u % 2]) for u in range(9)], "user_id long, sig string")
    found = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "id long, sig string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for size in (100, 2):
            rows = rules.for_users(found, terms, size)
            assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
            assert sorted((r["id"], r["user_id"]) for r in rows.collect()) == [(i, u) for i in range(6) for u in range(9) if i % 2 == u % 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_priority_by_signature_equals_that_of_all_pairs(spark):
    terms = spark.createDataFrame([(u, "ab"[u % 2]) for u in range(8)], "user_id long, sig string")
    found = spark.createDataFrame([(i, s, i % 3 == 0, i) for i in range(12) for s in "ab" if (i + ord(s)) % 4], "id long, sig string, explicit boolean, seq long")
    vectors = [(i, None if i == 2 else [0.0, 0.0] if i == 3 else [float(i - 5), float(i % 3)]) for i in range(10) if i not in (4, 5, 6)]
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    pairs = found.join(terms, "sig").drop("sig")
    near = scoring.pair_similarity(pairs, vectors.withColumnRenamed("vec_id", "id"), vectors.withColumnRenamed("vec_id", "user_id"))
    names = ["user_id", "id", "group", "place", "n_low"]
    want = sorted(tuple(r) for r in scoring.semantic_priority(near).select(*names).collect())
    assert sorted(tuple(r) for r in scoring.signature_priority(found, terms, vectors).collect()) == want


def test_summaries_and_candidates_make_no_pairs_with_texts(spark, monkeypatch):
    monkeypatch.setattr(rules, "pre_filter_pairs", None)
    monkeypatch.setattr(rules, "pre_filter", None)
    for name in ("A13_rescore_summary", "W11_candidate_order"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns
