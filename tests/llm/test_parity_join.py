"""The parity-sketch join against all pairs of shingle sets."""

import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import parity_join

R = random.Random(11)
WORDS = [f"v{i}" for i in range(3000)]


def text(n):
    return " ".join(R.choices(WORDS, k=n))


def edited(t, edits):
    words = t.split(" ")
    for _ in range(edits):
        words[R.randrange(len(words))] = R.choice(WORDS)
    return " ".join(words)


def corpus():
    out = [None, "", " \n\t", "one", "One", "one two three", "ONE two\tthree", "a b c d", "a b c d e"]
    for n in (7, 20, 60, 120, 400, 900):
        base = text(n)
        # Copies around one original: those of twice the edits link through it only.
        out += [base, base, base.upper(), *(edited(base, 1 + n // 60) for _ in range(12)), *(edited(base, n // 20) for _ in range(8))]
        # A chain in which each links with its neighbours.
        for _ in range(12):
            base = edited(base, max(1, n // 90))
            out.append(base)
        # Prefixes of growing length: sizes across bands.
        words = text(n).split(" ")
        out += [" ".join(words[: int(n * (0.86 + 0.01 * i))]) for i in range(15)]
    # A passage that many documents share without linking, in part nearly all they have.
    passage = text(90)
    out += [f"{passage} {text(R.choice([5, 12, 20, 60]))}" for _ in range(60)]
    out.append(text(30_000))
    return [(i, t) for i, t in enumerate(out)] + [(None, text(50)), (None, edited(out[20], 1)), (5, out[20]), (5, out[20])]


def words_of(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words_of(t)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    texts = sorted({t for _, t in rows if shingles(t)})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * min(len(sets[i]), len(sets[j])) >= 85 * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if t in at and i is not None:
            least[at[t]] = min(i, least.get(at[t], i))
    return sorted(((i, len(shingles(t)), least.get(at[t]) if t in at else i) for i, t in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("sid", "n", "key", "root", "a", "b", "sketch")}).repartition(3)


def result(df):
    return sorted((tuple(r) for r in parity_join.linked_documents(df).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_all_links(spark, rows):
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len(expected) - 100
    assert result(frame(spark, rows)) == expected


def test_crowded_buckets_small_tiles_and_repeated_search(spark, rows, monkeypatch):
    """Every way out of a full bucket at once: sets with blocks to spare leave, tiles of a few rows, one pair at first; and a sieve that
    lets most ids pass."""
    monkeypatch.setattr(parity_join, "CROWDED", 3)
    monkeypatch.setattr(parity_join, "TILE", 4)
    monkeypatch.setattr(parity_join, "SMALL", 2)
    monkeypatch.setattr(parity_join, "SIEVE_BITS", 1 << 15)
    monkeypatch.setattr(parity_join.text_roots, "__defaults__", (1,))
    assert result(frame(spark, rows)) == brute(rows)


def test_empty_table_and_nothing_to_link(spark):
    df = frame(spark, [(1, None), (2, "x y"), (None, "")])
    assert result(df.limit(0)) == []
    assert result(df) == sorted([(1, 0, 1), (2, 1, 2), (None, 0, None)], key=str)


def test_no_linked_pair_is_lost_by_its_blocks():
    """For pairs at the edge of linking: a common key that neither leaves out, and sketches within the bound."""
    rng = np.random.default_rng(1)
    for size in (6, 7, 13, 14, 40, 100, 333, 1200):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            most = parity_join.differ(2 * size)
            lost = rng.integers(0, most // 2 + 1)
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**64, most - 2 * (most // 2) + lost, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common) or len(a) == common == len(b):
                continue
            own = {(p[0], k) for p in parity_join.plan(len(a)) for k in parity_join.block_keys(a, *p)[0].tolist()}
            other = {(p[0], k) for p in parity_join.plan(len(b)) for k in parity_join.block_keys(b, *p)[0].tolist()}
            assert own & other
            x, y = parity_join.sketch(a), parity_join.sketch(b)
            length = min(len(x), len(y))
            bits = np.bitwise_count((parity_join.folded(x, length) ^ parity_join.folded(y, length)).view(np.uint64)).sum()
            assert bits <= len(a) + len(b) - 2 * common <= parity_join.differ(len(a) + len(b))


def test_bands_hold_all_partners():
    for size in range(1, 3000):
        starts = parity_join.band_starts(parity_join.partner(size) + 1)
        band = max(i for i, s in enumerate(starts) if s <= size)
        assert parity_join.partner(size) < (*starts, 10**9)[band + 2]


def test_keys_are_counted_after_the_shuffle_and_the_sieve_needs_no_python_worker(spark, rows):
    """Tables of keys before the shuffle, and a second worker in the tasks that verify, took more than an executor's memory at size."""
    explained = lambda df: df._jdf.queryExecution().executedPlan().toString()
    texts = parity_join.distinct_texts(frame(spark, rows).select("doc_id", "text"), lambda df, _: df.localCheckpoint())
    before, after = explained(parity_join.key_counts(texts)).split("Exchange")
    assert "HashAggregate" in before and "HashAggregate" not in after
    ids = texts.where("n > 100").select("sid")
    table = parity_join.sieve_table(ids, "sid")
    held, left = parity_join.where(texts, table, "sid"), parity_join.where_not(texts, table, "sid")
    assert not any(p in explained(df) for df in (held, left) for p in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas"))
    kept, rest, wanted = ({r["sid"] for r in df.select("sid").collect()} for df in (held, left, ids))
    assert wanted <= kept and not kept & rest and len(kept) <= len(wanted) + 2 and len(kept | rest) == texts.count()


def test_only_buckets_that_left_pairs_out_are_searched_again(spark, rows, monkeypatch):
    """The repeated search once took all buckets, so that the shuffles grew faster than the input."""
    monkeypatch.setattr(parity_join, "SMALL", 2)
    monkeypatch.setattr(parity_join.text_roots, "__defaults__", (1,))
    searched, of = [], parity_join.open_members

    def counted(members, roots, cut):
        searched.append({r["key"] for r in members.select("key").collect()})
        return of(members, roots, cut)

    monkeypatch.setattr(parity_join, "open_members", counted)
    assert result(frame(spark, rows)) == brute(rows)
    assert len(searched) > 1 and all(b < a for a, b in zip(searched, searched[1:]))


def test_shingle_sets_are_stored_only_of_the_texts_of_pairs(spark, monkeypatch):
    """Sets of all texts once filled the disk; now their keys do, under numbers that the shuffle can compress."""
    written = {}
    of = parity_join.steps

    @contextmanager
    def steps(*args):
        with of(*args) as own:
            def cut(df, name):
                out = own(df, name)
                if name in ("texts", "needed"):
                    written.setdefault(name, []).extend(out.collect())
                return out

            yield cut

    monkeypatch.setattr(parity_join, "steps", steps)
    base = text(400)
    lone = [text(400) for _ in range(200)]
    found = result(frame(spark, [(i, t) for i, t in enumerate([base, edited(base, 1), *lone])]))
    assert [c for _, _, c in sorted(found)] == [0, 0, *range(2, 202)]
    texts, needed = written["texts"], written["needed"]
    assert len(texts) == 202 and len(needed) == 2
    assert sum(len(v) for r in texts for v in r if isinstance(v, list | bytearray)) < 0.7 * sum(r["n"] for r in texts)
    assert max(r["sid"] & ((1 << 33) - 1) for r in texts) < len(texts)
