"""The pipeline's stages: each against brute force over awkward rows, and in a row on the small tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import PII_BASE, ROWS, WORDS, brute_features, library, luhn

import corpus_pipeline as P
from postmill.llm import crf, pii, simhash

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeats, and columns named as the stages' own."""
    df = spark.createDataFrame([(i, t, g, "s", None if t is None else len(t)) for i, t, g in ROWS], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("score", "row", "h", "copies", "kept_id", "pii", "stratum", "cutoffs", "level", "bins", "root")})


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


ALL = Counter((i, t) for i, t, _ in ROWS)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_an_empty_table_gives_no_rows(spark, docs, stage):
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_quality_keeps_what_the_field_scores_high(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = P.quality(spark, docs, SMALL)
    field = crf.fit_documents(docs.select(P.COLUMNS), labels)
    assert out.columns == P.COLUMNS and texts_of(out) == Counter({k: n for k, n in ALL.items() if field.score([k[1] or ""])[0] >= 0.5})


def test_rules_keep_what_passes_the_base_rule(spark, docs):
    """The labels of the small tables are too few to certify a cutoff."""

    def passes(t):
        words, _, _, _, repeats = brute_features(t or "")
        return words >= 50 and 100 * repeats <= 50 * words

    out = P.rules(spark, docs, SMALL)
    assert out.columns == P.COLUMNS and texts_of(out) == Counter({k: n for k, n in ALL.items() if passes(k[1])})


def test_near_duplicates_keep_one_row_of_each_linked_group(spark, docs):
    extra = [(None, " ".join(random.Random(i).choices(WORDS, k=40)), "en", "s", 1) for i in range(4)]
    rows = [(i, t) for i, t, _ in ROWS] + [(i, t) for i, t, *_ in extra]
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    out = P.near_duplicates(spark, docs.select(P.COLUMNS).unionByName(spark.createDataFrame(extra, SCHEMA)), SMALL)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == P.COLUMNS and len(kept) == len(set(group)) and set(kept) <= set(rows)
    for g in set(group):
        own = [rows[k] for k in range(len(rows)) if group[k] == g]
        least = min(((i is not None, i or 0) for i, _ in own))
        assert [k for k in kept if k in own and (k[0] is not None, k[0] or 0) == least]


def test_personal_data_is_replaced_by_brute_force_too(spark, docs):
    """Spans of the base kinds, by the score of their context; iban apart."""

    def clean(t):
        if t is None:
            return None
        found = [(m.start(), m.end(), k) for k, p, ok in PII_BASE for m in re.finditer(p, t) if ok(m)]
        found += [(m.start(), m.end(), "iban") for m in re.finditer("DE89 3704 0044 0532 0130 00", t)]
        out, at = [], 0
        for a, b, k in sorted(found):
            if a >= at:
                out += [t[at:a], f"<{k}>"]
            at = max(at, b)
        return "".join(out) + t[at:]

    out = P.personal_data(spark, docs, SMALL)
    assert out.columns == P.COLUMNS and texts_of(out) == Counter({(i, clean(t)): n for (i, t), n in ALL.items()})
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert luhn("4111111111111111") and pii.THRESHOLD < 0.5


def test_packing_places_every_token_once(spark, docs):
    t = library()
    out = P.pack(spark, docs, SMALL).collect()
    want = Counter()
    for i, x, _ in ROWS:
        want[i] += len(t.encode(x or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == want
    size = Counter()
    for r in out:
        size[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in size.values()) and len({r["tier"] for r in out}) > 1


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = P.quality(spark, docs, SMALL)
    assert kept.columns == P.COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(i in ids for i, q in marks.items() if q == 1) >= 0.95 * sum(marks.values())
    ruled = P.rules(spark, kept, SMALL)
    assert ruled.columns == P.COLUMNS and {r["doc_id"] for r in ruled.collect()} <= ids
    single = P.near_duplicates(spark, ruled, SMALL)
    texts = [r["text"] for r in single.collect()]
    assert single.columns == P.COLUMNS and len(texts) == len(set(texts))
    clean = P.personal_data(spark, single, SMALL).collect()
    assert len(clean) == len(texts) and not any("@example" in r["text"] for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    assert any(r["text"] != before[r["doc_id"]]["text"] for r in clean)


def test_run_gives_pieces_of_whole_documents(spark):
    rows = P.run(spark, SMALL).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in by_doc.values():
        pieces.sort()
        assert pieces[0][0] == 0 and sum(n for _, n, _ in pieces) == pieces[0][2]
