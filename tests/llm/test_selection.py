"""Clustering by partial distances, the bit-sliced index and importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import bitsliced, clusters, resample

VECTORS = "vec_id long, embedding array<double>, cluster string, QUERY string, rank string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", None, "x") for i, v in rows], VECTORS)


def floored(v, scale):
    return [math.floor(scale * x) for x in v]


def usable(v, scale):
    return v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)


def brute_clusters(rows, dims, scale, k, rounds, salt):
    kept = [(i, floored(v, scale)) for i, v in rows if usable(v, scale) and len(v) == dims]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", [x for x in r[1]]))
    points = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        points = [
            [sum(v[d] for (_, v), c in zip(kept, own) if c == at) // own.count(at) for d in range(dims)] if at in own else p
            for at, p in enumerate(points)
        ]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    top = 2**63 - 1
    inertia = Counter()
    for _, c, d in placed:
        inertia[c] += d
    told = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, min(d, top), min(inertia[c], top), min(sum(inertia.values()), top), told[c]) for i, c, d in placed), key=repr)


def found_clusters(spark, rows, **options):
    return sorted((tuple(r) for r in clusters.clustered(vector_table(spark, rows), **options).collect()), key=repr)


def odd_vectors(dims, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.standard_normal(dims) / 3).tolist()) for k in range(n)]
    rows += [(100 + k, rows[0][1]) for k in range(n)]  # a very frequent vector
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1])]
    rows += [(500, None), (501, []), (502, [0.1] * (dims - 1) + [None]), (503, [0.1] * (dims - 1) + [math.nan]), (504, [math.inf] * dims), (505, [0.0] * dims), (506, [1e308] * dims), (507, [0.5] * (dims + 1))]
    return rows


@pytest.mark.parametrize("large", [False, True])
def test_clusters(spark, large):
    rows = odd_vectors(12)
    if large:  # beyond 64 bits, in components, sums and distances
        rows += [(600, [1e200] + [0.0] * 11), (601, [-3e25] * 12), (602, [2.0**24] * 12), (603, [2.0**24 + 1] * 12)]
    options = {"dims": 12, "scale": 64, "k": 7, "rounds": 3, "salt": "1:"}
    assert found_clusters(spark, rows, **options) == brute_clusters(rows, **options)


def test_clusters_of_few_or_no_vectors(spark):
    options = {"dims": 3, "scale": 64, "k": 16, "rounds": 3, "salt": "1:"}
    same = [(k, [0.25, -0.5, 1.0]) for k in range(5)]  # all centroids are equal: the first takes all, the others are empty and stay
    assert found_clusters(spark, same, **options) == brute_clusters(same, **options)
    assert {r[1] for r in found_clusters(spark, same, **options)} == {0}
    assert found_clusters(spark, [], **options) == found_clusters(spark, [(1, None)], **options) == []


def test_partial_search_is_exact_whatever_the_order():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (500, 64))
    x[:200] = x[7]
    points = np.concatenate([x[:10], x[:3]]).astype(object)
    d = ((x[:, None] - points[None].astype(np.int64)) ** 2).sum(axis=2)
    for order in (np.arange(64), rng.permutation(64)):
        nearest, distance = clusters.partial_search(x, clusters.Centroids(points, order))
        assert (nearest == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def brute_products(rows, asks, scale, top):
    kept = [(i, floored(v, scale)) for i, v in rows if i is not None and usable(v, scale)]
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for i, q in {(i, tuple(v)) for i, v in kept if asks(i)}:
        scores = {(-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i and len(v) == len(q)}
        out += [(i, at + 1, j, limit(-s)) for at, (s, j) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def found_products(spark, rows, modulus, parts=4, **options):
    table = vector_table(spark, rows).repartition(parts)
    return sorted(tuple(r) for r in bitsliced.best(table, table["vec_id"] % modulus == 0, **options).collect())


@pytest.mark.parametrize("large", [False, True])
def test_largest_products(spark, large, monkeypatch):
    rows = odd_vectors(9, 90)
    rows += [(700 + k, [x if x is None else -x for x in rows[k][1]]) for k in range(20)]
    if large:
        rows += [(800, [1e200] + [0.0] * 8), (801, [1e199] + [0.0] * 8), (802, [-1e200] + [0.0] * 8), (803, [2.0**24] * 9), (900, [3e20] * 9), (910, [2.0**16 + 5] * 9)]
    asks = lambda i: i % 10 == 0
    want = brute_products(rows, asks, 1024, 10)
    assert found_products(spark, rows, 10, block=64) == want
    monkeypatch.setattr(bitsliced, "GROUP", 8)  # several groups of queries
    assert found_products(spark, rows, 10, parts=1, block=1000) == want


def test_products_of_few_or_no_vectors(spark):
    few = [(100, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5])]
    assert found_products(spark, few, 100) == [(100, 1, 1, 524288), (100, 2, 2, 524288)]
    assert found_products(spark, [(1, [1.0])], 100) == found_products(spark, [], 100) == found_products(spark, [(100, [1.0])], 100) == []


def test_bitmaps_add_and_select():
    rng = np.random.default_rng(5)
    values, queries = rng.integers(-300, 300, (1000, 16)), rng.integers(-900, 900, (11, 16))
    values[200:600] = values[1]
    least, shift, slices = bitsliced.sliced(values)
    kept = (values - np.array(least)) >> shift
    bitmaps = slices.reshape(-1, slices.shape[-1])
    bitmaps = np.concatenate([bitmaps, ~bitmaps, np.zeros((1, bitmaps.shape[1]), np.uint64)])
    there, weights = bitsliced._pack(np.ones(1000, np.uint8)), bitsliced.Weights(queries)
    for begin, end, terms in weights.chunks:
        sums = bitsliced.added(bitmaps, terms)
        bits = np.stack([np.unpackbits(s.view(np.uint8), axis=1, count=1000, bitorder="little") for s in sums]).astype(np.int64)
        found = (bits << np.arange(len(sums))[:, None, None]).sum(axis=0) - weights.below[begin:end, None]
        exact = queries[begin:end] @ kept.T
        assert (found == exact).all()
        for k in (1, 10, 700, 5000):
            kth = bitsliced.kth_largest(sums, there, k)
            assert (kth - weights.below[begin:end] == np.sort(exact, axis=1)[:, ::-1][:, min(k, 1000) - 1]).all()
            near = bitsliced.at_least(sums, there, kth)
            assert (np.bitwise_count(near).sum(axis=1) == (exact >= (kth - weights.below[begin:end])[:, None]).sum(axis=1)).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, grams, buckets, share, least, salt):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def runs(text):
        words = WORD.findall((text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(words) - n + 1)]

    own, other = Counter(), Counter()
    for _, t in docs:
        own.update(runs(t)[1])
    for t in target:
        other.update(runs(t)[1])
    s_all, t_all = sum(own.values()), sum(other.values())
    gain = [math.floor(1000 * math.log(float((other[b] + 1) * (s_all + buckets)) / float((own[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, t in docs:
        n, found = runs(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    chosen = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    ranks = Counter((r, at + 1) for at, r in enumerate(chosen[: share * len(chosen) // 100]))
    drawn = Counter(r for r, _ in ranks.elements())
    rest = Counter(out) - drawn
    return sorted([(*r[1:], at) for r, at in ranks.elements()] + [(*r[1:], None) for r in rest.elements()], key=repr)


RESAMPLE = {"grams": 1, "buckets": 500, "share": 10, "least": 20, "salt": "2024:"}


def found_resample(spark, docs, target, grams=1, buckets=500, share=10, least=20, salt="2024:"):
    table = spark.createDataFrame([(i, t, "x", 1.5, "y") for i, t in docs], "doc_id long, text string, a string, SCORE double, place string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resampled(table, goal, grams=grams, buckets=buckets, share=share, least_words=least, salt=salt)
    assert out.columns == ["doc_id", "text", "a", "place", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("grams", [1, 3])
def test_resampling(spark, grams, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "日本", "X9", "don't"]
    docs = [(rng.randrange(-(2**40), 2**40), " ".join(rng.choices(words[k % 20 :], k=rng.randrange(5, 60)))) for k in range(300)]
    docs += [docs[5]] * 150 + [(None, docs[6][1])] * 3 + [(docs[5][0], docs[7][1]), (1, None), (2, ""), (3, " .-! "), (4, "\x00A\x7fb\x80c"), (2**63 - 1, docs[9][1]), (-(2**63), docs[10][1]), (7, "long " * 5000)]
    target = [" ".join(words[:9]), None, "", "W3 w4-w5"]
    monkeypatch.setattr(resample, "PIECE", 50)
    monkeypatch.setattr(resample, "KNOWN", 20)
    options = RESAMPLE | {"grams": grams}
    for share in (10, 37, 100):
        assert found_resample(spark, docs, target, **options | {"share": share}) == brute_resample(docs, target, **options | {"share": share})


def test_resampling_of_few_or_no_documents(spark):
    docs = [(k, "a few words") for k in range(9)]
    for own, target in ((docs, ["words"]), ([], ["words"]), (docs, []), ([], [])):
        assert found_resample(spark, own, target) == brute_resample(own, target, **RESAMPLE)
        assert found_resample(spark, own, target, least=3) == brute_resample(own, target, **RESAMPLE | {"least": 3})


def test_kth_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 0, -1, rng.randrange(-99, 99)]), rng.choice([-(2**63), 2**63 - 1, rng.randrange(-(2**50), 2**50)])) for _ in range(200)]
    table = spark.createDataFrame(rows, "a long, b long")
    for k in (1, 77, 200):
        assert resample.kth_key(table, k) == sorted(rows)[k - 1]
    assert resample.kth_key(spark.createDataFrame([(5, 6)] * 4, "a long, b long"), 3) == (5, 6)
