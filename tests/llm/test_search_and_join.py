"""Neighbour search and n-gram join against brute force."""

from collections import Counter

import numpy as np

from tidepost.llm import jaccard, nearest, queries
from tidepost.llm.components import components


def grams(text, n=5):
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").split() if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_links(rows, similarity=0.8):
    """Links and smallest id of the component, over distinct gram sets."""
    sets = [frozenset(grams(text or "")) for _, text in rows]
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where[g]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low.setdefault(find(i), []).append(doc_id)
    return [(d, min(low[find(i)]), links[i]) for i, (d, _) in enumerate(rows)]


def test_join_equals_brute_force(spark, folder, tables):
    rows = sorted((r[0], r[1]) for r in tables("documents"))
    found = sorted(tuple(r) for r in queries.op5_jaccard_join(spark, folder).collect())
    assert found == sorted(brute_links(rows))


def test_large_group_of_near_copies(spark, make):
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        words[int(random.integers(120))] = f"x{i}"
        rows.append((i, " ".join(words), "a", ""))
    docs = make(rows)
    found = sorted((r.doc_id, r.class_id, r.links) for r in jaccard.join(docs).collect())
    assert found == brute_links([(r[0], r[1]) for r in rows])
    assert [r.doc_id for r in jaccard.keep_one(docs).collect()] == [0]


def test_join_of_odd_rows(make, odd):
    docs = make(odd)
    found = sorted(((r.doc_id or 0, r.class_id, r.links) for r in jaccard.join(docs).collect()))
    assert found == [(0, 5, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 2), (5, 5, 2), (7, 7, 0)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7]
    assert jaccard.join(make([])).count() == 0 == jaccard.keep_one(make([])).count()


def test_bands_reach_the_recall():
    bands = jaccard.Join().bands
    assert 1 - (1 - 0.8**bands.rows) ** bands.count >= 0.9995


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 8), (5, 5), (20, 10), (10, 4)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({found[i] for i in (1, 2, 3, 4, 10, 20)}) == 1 == len({found[i] for i in (7, 8, 9)})
    assert found[1] != found[7]
    chain = [(i, i + 1) for i in range(300)]
    found = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len({r.root for r in found}) == 1 and len(found) == 301


def test_hilbert_is_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = nearest.hilbert(cells, 3)
    walk = cells[np.argsort(place)]
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def recall(found, ids, vectors, k):
    row_of = {d: i for i, d in enumerate(ids)}
    right = wanted = 0
    for q in {r[0] for r in found}:
        score = vectors @ vectors[row_of[q]]
        order = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])) if ids[i] != q][:k]
        mine = sorted((r for r in found if r[0] == q), key=lambda r: r[1])
        assert [r[1] for r in mine] == list(range(1, len(mine) + 1))
        assert all(abs(r[3] - score[row_of[r[2]]]) < 1e-9 for r in mine)
        right += len({r[2] for r in mine} & set(order))
        wanted += len(order)
    return right / wanted


def test_search_finds_the_neighbours(spark, folder, tables):
    rows = tables("embeddings")
    found = [tuple(r) for r in queries.op2_curve_neighbours(spark, folder).collect()]
    assert {r[0] for r in found} == {r[0] for r in rows if r[0] % 20 == 0}
    assert recall(found, [r[0] for r in rows], np.array([r[1] for r in rows], float), 20) >= 0.9


def test_search_of_odd_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0])]
    df = spark.createDataFrame([(*r, "v") for r in rows], "vec_id long, embedding array<float>, v string")
    found = [tuple(r) for r in nearest.search(df, F.col("vec_id") == 0, 5).collect()]
    assert found == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]
    assert nearest.search(df.filter("vec_id > 99"), F.col("vec_id") == 0, 5).count() == 0


def test_search_tells_rows_of_one_id_apart(spark):
    from pyspark.sql import functions as F

    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in nearest.search(df, F.col("vec_id") == 20, 3).collect()]
    one = [(20, 1, 1, 3.0), (20, 2, 2, 0.0), (20, 3, 2, 0.0)]
    other = [(20, 1, 2, 3.0), (20, 2, 2, 3.0), (20, 3, 1, 0.0)]
    assert sorted(found) == sorted(one + other)
    found = [tuple(r) for r in nearest.search(df, F.col("vec_id") == 20, 4).collect()]
    assert sorted(r for r in found if r[1] == 4) == [(20, 4, 20, 0.0)] * 2


def test_join_of_a_row_that_stands_in_the_table_very_often(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["other"])
    rows = [(1, " ".join(base))] * 20_000 + [(2, near), (3, "something else altogether here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = Counter(tuple(r) for r in jaccard.join(docs).collect())
    assert found == {(1, 1, 20_000): 20_000, (2, 1, 20_000): 1, (3, 3, 0): 1}
