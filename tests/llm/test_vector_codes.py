"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import vector_codes

SCHEMA = "vec_id long, label int, embedding array<float>, code string, kind int"


def brute(rows):
    """vec_id, code, error, label_error and the digest, from rows of (vec_id, label, vector)."""
    kept = [(i, l, v) for i, l, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    length = len(kept[0][2])
    cuts = [p * length // 8 for p in range(9)]
    ints = [[math.floor(Fraction(x) * 4096) for x in v] for _, _, v in kept]
    parts = [[v[a:b] for v in ints] for a, b in zip(cuts, cuts[1:])]
    codes, errors, final = [], [0] * len(kept), []
    for own in parts:
        book = own[:16]

        def nearest(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

        for _ in range(6):
            groups = defaultdict(list)
            for x in own:
                groups[nearest(x)[1]].append(x)
            book = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if groups[e] else c for e, c in enumerate(book)]
        found = [nearest(x) for x in own]
        codes.append([e for _, e in found])
        errors = [a + d for a, (d, _) in zip(errors, found)]
        final += [str(x) for c in book for x in c]
    total = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        total[label] += e
    top = 2**63 - 1
    digest = hashlib.sha256(",".join(final).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[n]:02x}" for c in codes), min(e, top), min(total[l], top), digest) for n, ((i, l, _), e) in enumerate(zip(kept, errors))), key=str)


def result(df):
    return sorted((tuple(r) for r in vector_codes.encode_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def floats(x):
    return [None if v is None else float(np.float32(v)) for v in x]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    centres = [[r.uniform(-1, 1) for _ in range(16)] for _ in range(25)]
    rows = [(i, i % 5 or None, floats([c + r.gauss(0, 0.05) for c in r.choice(centres)])) for i in range(700)]
    rows += [(900, 1, None), (901, 1, []), (902, 1, floats([0.1] * 15) + [None]), (903, 1, floats([0.1] * 15) + [math.nan]), (904, 1, floats([0.1] * 15) + [math.inf])]
    rows += [(905, 2, floats([0.0] * 16)), (906, None, floats([0.5] * 12)), (None, 3, floats([0.25] * 16)), rows[7], rows[7]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, l, v, "clash", 1) for i, l, v in rows], SCHEMA).repartition(3)


def test_equal_to_plain_rounds(spark, rows):
    assert result(frame(spark, rows)) == brute(rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, 0, floats([(i * 7 % 5) / 4096] * 8)) for i in range(60)]
    assert result(frame(spark, rows)) == brute(rows)


def test_fewer_vectors_than_entries_uneven_parts_and_one(spark):
    r = random.Random(1)
    rows = [(i, i, floats([r.random() for _ in range(11)])) for i in range(9)]
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, rows[:1])) == brute(rows[:1])


def test_components_beyond_64_bits(spark):
    r = random.Random(2)
    rows = [(i, i % 2, floats([r.uniform(-1, 1) * 10.0 ** r.choice([0, 9, 30]) for _ in range(8)])) for i in range(50)]
    assert result(frame(spark, rows)) == brute(rows)
    wide = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert result(wide) == brute(rows)


def test_no_vectors(spark, rows):
    for rows in ([], [(1, 1, None)]):
        out = vector_codes.encode_vectors(frame(spark, rows) if rows else frame(spark, [(1, 1, None)]).limit(0))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_bounds_spare_distances_and_lists_shrink():
    """On separated clusters few parts are looked at again, and the lists get shorter."""
    rng = np.random.default_rng(3)
    book = rng.integers(-4000, 4000, (16, 8))
    x = book[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    own = vector_codes.Bounds.fresh(x, book, 8)
    moved = book + rng.integers(-20, 20, book.shape)
    moves = np.nextafter(np.sqrt(((moved - book) ** 2).sum(axis=1).astype(float)), np.inf)
    own.moved(moves, 4)
    looked = own.settle(x, moved)
    assert own.near.shape[1] == 4 and (looked > 1).mean() < 0.05
    square = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
    assert (own.near[:, 0] == square.argmin(axis=1)).all()
    # Every bound holds.
    real = np.sqrt(np.take_along_axis(square, own.near.astype(int), axis=1))
    assert (own.upper >= real[:, 0]).all()
    for i in range(3):
        assert (own.low[:, i] <= real[:, i + 1] + 1e-9).all()
    np.put_along_axis(square, own.near.astype(int), 2**60, axis=1)
    assert (own.low[:, 3] <= np.sqrt(square.min(axis=1))).all()
