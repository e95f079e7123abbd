import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import documents, frame, sentence

from leverscope.llm import common, near_duplicates, vectors


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return set() if not words else {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i)))) if d is not None else (-1, len(sets[i]), least.get(find(i), -1), find(i) not in least) for i, (d, _) in enumerate(rows))


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_duplicates, "CROWD", 4)  # so that crowded regions occur
    rng = random.Random(width)
    rows = [(r[0], r[1]) for r in documents(40)]
    for base in range(6):  # groups about the threshold, a crowd among them
        text = sentence(rng, "xa", 120)
        rows += [(1000 + 100 * base + k, edited(rng, text, rng.randint(0, 7))) for k in range(40 if base == 0 else 6)]
    rows += [(2000, "One Two"), (2001, "one two"), (2002, "one"), (2003, "One  two \n")]
    df = frame(spark, [(i, t, None, None, None, "x", "x", "x", "x", 0) for i, t in rows]).repartition(5)
    got = near_duplicates.near_duplicates(df, width, percent).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in got)
    assert got == brute(rows, width, percent)


def test_pairs_at_the_threshold_in_a_large_family_that_is_not_linked(spark):
    rows = []  # pair 44 shares four values in trees in which the crowd splits further
    for pair in range(400):  # 108 of 144 words common to any two (0.75), 112 of 140 to a pair (0.8)
        for side in range(2):
            words = [f"f{k}" for k in range(108)] + [f"t{pair}x{k}" for k in range(4)] + [f"ot{pair}x{side}x{k}" for k in range(14)]
            rows.append((2 * pair + side, " ".join(words)))
    got = near_duplicates.near_duplicates(frame(spark, rows, "doc_id long, text string").repartition(4), 1, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(800)}


def test_with_row_numbers_one_row_of_a_group_stays(spark):
    rows = [(7, "a b c d e f g", 3), (7, "a b c d e f g", 2), (9, "A b c d e f g", 1), (None, "a b c d e f g", 0), (5, None, 4), (5, None, 5)]
    got = near_duplicates.near_duplicates(frame(spark, rows, "doc_id long, text string, num long"), row="num").collect()
    assert sorted(r["row"] for r in got if r["kept"]) == [2, 4, 5]
    assert near_duplicates.near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0


def test_common_counts_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n, dtype=np.uint64)) for n in (1, 50, 5000, 7000, 3)]
    got = near_duplicates._common(sets[:3], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(201, 200), (200, 201), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)} | {200: 200, 201: 200}
    assert common.components(frame(spark, [], "a long, b long")).count() == 0


def test_sieve_loses_nothing(spark):
    sieve = common.Sieve(spark.range(0, 100_000, 7).select("id"))
    hits = sieve.maybe(np.arange(100_000))
    assert hits[::7].all() and hits.mean() < 0.25
    assert not common.Sieve(spark.range(0).select("id")).maybe(np.arange(10)).any()


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # so that buckets are dealt into blocks
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    near = np.concatenate([base[:20] + 0.03 * rng.standard_normal((20, 24)) for _ in range(4)] + [np.repeat(base[:1] * 2, 50, axis=0) + 0.05 * rng.standard_normal((50, 24))])
    all_ = [*base, *near, base[3], base[3], base[4] * 1e30]
    rows = [(i, [float(v) for v in x], i % 2, 1) for i, x in enumerate(all_)]
    n = len(rows)
    rows += [(n, None, 0, 1), (n + 1, [0.0] * 24, 0, 1), (n + 2, [float("nan")] * 24, 0, 1), (n + 3, [1.0] * 23 + [None], 0, 1), (n + 4, list(rows[0][1]), None, 1),
             (n + 5, [1.0, 2.0], 0, 1), (n + 6, [2.0, 4.0], 0, 1), (n + 7, [], 0, 1), rows[7]]
    got = vectors.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int, class int")).collect()

    def fine(r):
        return r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if fine(r) else None for r in rows]
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
              and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(len(rows))]
    want = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        want.append((r[0], len(links[i]), least, r[0] == least))
    assert sorted(map(tuple, got)) == sorted(want)
    assert vectors.near_vectors(frame(spark, [], "vec_id long, embedding array<double>, label int")).count() == 0


def test_recall_of_links_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.935 * a + (1 - 0.935**2) ** 0.5 * side
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(np.concatenate([a, b]))]
    got = vectors.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int")).filter("n_links > 0").count()
    assert got >= 0.9 * 1200


def test_recall_of_links_of_vectors_with_a_common_mean(spark):
    rng = np.random.default_rng(8)
    y = rng.standard_normal((600, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a = 0.7**0.5 * np.full(64, 64**-0.5) + 0.3**0.5 * y
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([a, 0.935 * a + (1 - 0.935**2) ** 0.5 * side])
    rows = [(i, [float(v) for v in one], 0) for i, one in enumerate(x)]
    got = vectors.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int")).agg({"n_links": "sum"}).first()[0]
    assert got >= 0.97 * (np.triu(x @ x.T, 1) >= 0.93).sum() * 2


def test_labels_may_be_texts(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None), (5, [3.0, 0.1], "b")]
    got = vectors.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 0, 4), (5, 1, 3)]
