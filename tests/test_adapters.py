"""Adapters of markup payloads, which have no SQL."""

from postmill.sources import adapters


def test_embedded_state_takes_entries_by_prefix_and_the_first_date(spark):
    page = '<html><script id="state" type="x">{"JobAd:1":{"id":"1","title":"Head","activatedAt":"2024-01-02T03:00:00Z"},"Other:2":{"id":"2","title":"No"}}</script></html>'
    df = spark.createDataFrame([(1, page), (2, "<html></html>"), (3, None)], "arrival_seq long, payload string")
    rows = adapters.from_embedded_state(df, "JobAd:").collect()
    assert [(r["external_id"], r["title"], str(r["posted_at"])) for r in rows] == [("state_1", "Head", "2024-01-02 03:00:00")]


def test_rss_splits_heads_and_prefers_the_detail_page(spark):
    item = lambda t, u: f"<item><title>{t}</title><link>{u}</link><description>&lt;p&gt;Short operations text&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item>"
    df = spark.createDataFrame([(1, "<rss>" + item("Head of Operations // Acme", "u1") + item("Cook", "u2").replace("operations", "kitchen") + "</rss>")], "arrival_seq long, payload string")
    pages = spark.createDataFrame([("u1", '<div class="job-description">Full <b>text</b></div>')], "url string, html string")
    rows = adapters.from_rss(df, pages, ["Operations"]).collect()
    assert [(r["title"], r["company_name"], r["description"], str(r["posted_at"])) for r in rows] == [("Head of Operations", "Acme", "Full text", "2024-01-02 03:04:05")]


def test_watchlist_keeps_watched_companies_in_their_countries(spark):
    found = spark.createDataFrame([(1, "acme", "DE", None), (2, "acme", "us", "Acme Inc"), (3, "other", "de", "Other")], "arrival_seq long, watched string, country string, company_name string")
    rows = adapters.watchlist_postings(found, spark.createDataFrame([("Acme", "de")], "company string, country string")).collect()
    assert [(r["arrival_seq"], r["company_name"], r["source"]) for r in rows] == [(1, "Acme", "watchlist")]
    assert "watched" not in rows[0].asDict()
