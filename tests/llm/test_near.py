"""The operators on pairs and neighbours, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentivote.llm import near_join, pivots, prefix_forest
from sentivote.llm.common import components, shingle_set


def reach(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_near(texts, similarity=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, pairs = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                pairs.append((a, b))
    links = {i: sum(i in p for p in pairs) for i in ids}
    return links, reach(ids, pairs)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def texts():
    out, i = {}, 0
    for group in range(6):
        base = prose(group, 60 + 40 * group)
        for k in range(8):  # copies with more and more words changed
            words = list(base)
            for j in range(k):
                words[(j * 17 + group) % len(words)] = f"x{k}{j}"
            out[i] = " ".join(words)
            i += 3
    out |= {200: out[0], 201: out[0].upper(), 202: None, 203: "", 204: "one two", 205: "One  two", 206: "   ", 207: "w " * 3000}
    return out


def test_near_join_equals_brute_force(docs_of, rows_of, texts):
    got = {r["doc_id"]: r for r in rows_of(near_join.near_duplicates(docs_of(list(texts.items()))))}
    links, groups = brute_near(texts)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == groups
    assert {i for i, r in got.items() if r["kept"]} == set(groups.values())


def test_near_join_in_small_blocks_is_the_same(docs_of, rows_of, texts):
    docs = docs_of(list(texts.items()))
    key = lambda r: r["doc_id"]
    whole = sorted(rows_of(near_join.near_duplicates(docs)), key=key)
    cut = sorted(rows_of(near_join.near_duplicates(docs, block_classes=3)), key=key)
    assert whole == cut


def test_near_join_of_nothing_and_of_repeated_rows(docs_of, rows_of):
    assert rows_of(near_join.near_duplicates(docs_of([]))) == []
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])
    got = sorted(rows_of(near_join.near_duplicates(docs)), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_links"], r["kept"]) for r in got] == [(1, 1, True), (2, 1, False)]
    kept = near_join.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in rows_of(kept)))) == ["1", "None"]


def test_prefix_shortens_until_the_recall():
    d = near_join.prefix_length(0.8, 32, 10, 0.999)
    meets = lambda k: 1 - (1 - 0.8**k) ** 32
    assert meets(d) >= 0.999 > meets(d + 1)


def test_shingles_tell_texts_apart():
    assert len(shingle_set("a b c d e a b c d e", 5)) == 5
    assert len(shingle_set("a b", 5)) == 1 and len(shingle_set(" \n", 5)) == 0 == len(shingle_set(None, 5))
    assert (shingle_set("É b c d e", 5) == shingle_set("é\tB c  d\ne", 5)).all()


def test_components_of_a_long_chain(spark, rows_of):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(900, 905), (905, 905)], "u long, v long"))
    got = {r["node"]: r["component"] for r in rows_of(components(chain))}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 905: 900}


def vectors_of(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string"
    )


def sample_vectors(n=400, width=16):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, width))
    x[100:160] = x[100] + 0.12 * rng.standard_normal((60, width))  # a dense group, links and near misses
    x[200:210] = x[200]
    return [[float(np.float32(c)) for c in v] for v in x]


ODD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]


def test_pivots_equal_brute_force(spark, rows_of):
    x = sample_vectors()
    rows = list(enumerate(x)) + list(zip(range(1000, 1006), ODD)) + [(5, x[5]), (None, x[6])]
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    groups = reach(range(len(x)), zip(*np.nonzero(near)))
    for block in (2048, 16):
        got = {r["vec_id"]: r for r in rows_of(pivots.near_vectors(vectors_of(spark, rows), block=block))}
        assert set(got) == {*range(len(x)), *range(1000, 1006)}
        assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
        assert {i: got[i]["component_id"] for i in range(len(x))} == groups
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1006))


def test_pivots_of_nothing(spark, rows_of):
    assert rows_of(pivots.near_vectors(vectors_of(spark, []))) == []


def test_forest_search_finds_the_nearest(spark, rows_of):
    x = sample_vectors(1500)
    rows = list(enumerate(x)) + list(zip(range(2000, 2006), ODD)) + [(40, x[40]), (None, x[6])]
    got = rows_of(prefix_forest.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=20, shard=500, block=30))
    dots = np.array(x) @ np.array(x).T
    found = total = 0
    for q in range(0, len(x), 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(math.isclose(r["score"], dots[q, r["vec_id"]], rel_tol=1e-12) for r in mine)
        best = set(sorted((j for j in range(len(x)) if j != q), key=lambda j: (-dots[q, j], j))[:20])
        found, total = found + len(best & {r["vec_id"] for r in mine}), total + 20
    assert {r["query_id"] for r in got} == set(range(0, len(x), 20))
    assert found / total >= 0.9


def test_forest_search_with_few_candidates(spark, rows_of):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.5, 1.0])]
    got = rows_of(prefix_forest.search(vectors_of(spark, rows), F.col("vec_id") == 0))
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)]
    assert rows_of(prefix_forest.search(vectors_of(spark, []), F.col("vec_id") == 0)) == []
    assert rows_of(prefix_forest.search(vectors_of(spark, rows[:1]), F.col("vec_id") == 0)) == []


def test_forest_search_settles_ties_by_id(spark, rows_of):
    rng = np.random.default_rng(9)
    one, asking = rng.standard_normal((2, 64)).astype(np.float32).tolist()
    rows = [(0, asking), *((i, one) for i in range(1, 300))]
    for shard in (8192, 64):
        got = rows_of(prefix_forest.search(vectors_of(spark, rows), F.col("vec_id") == 0, shard=shard))
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21))
        assert len({r["score"] for r in got}) == 1


def recalls(spark, rows_of, x, asked, k=20):
    """Recall of each query of ``asked`` against brute force; of equal scores any will do."""
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in rows_of(prefix_forest.search(df, F.col("vec_id").isin([int(q) for q in asked]), k=k)):
        got.setdefault(r["query_id"], []).append(r["score"])
    dots = x.astype(np.float32).astype(float)
    out = []
    for q in asked:
        score = np.delete(dots @ dots[q], q)
        out.append(sum(s >= np.sort(score)[-k] - 1e-9 for s in got[q]) / k)
    return np.array(out)


def unit_vectors(n, seed=0):
    u = np.random.default_rng(seed).standard_normal((n, 64))
    return u / np.linalg.norm(u, axis=1)[:, None]


@pytest.mark.parametrize("noise", [0, 0.004])
def test_forest_recall_beside_a_large_group_of_copies(spark, rows_of, noise):
    x, third = unit_vectors(8192), 8192 // 3
    x[:third] = x[0] + noise * np.random.default_rng(1).standard_normal((third, 64))
    inside, outside = recalls(spark, rows_of, x, range(0, third, 131)), recalls(spark, rows_of, x, range(third, 8192, 37))
    assert inside.min() == 1
    assert outside.mean() >= 0.92 and np.percentile(outside, 5) >= 0.75


def test_forest_search_hands_out_copies_by_id(spark, rows_of):
    x = unit_vectors(40, seed=3)
    x[5:35] = x[5]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = rows_of(prefix_forest.search(vectors_of(spark, rows), F.col("vec_id").isin(7, 30), k=8))
    for q, wanted in ((7, [5, 6, 8, 9, 10, 11, 12, 13]), (30, [5, 6, 7, 8, 9, 10, 11, 12])):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == wanted


@pytest.mark.parametrize("spread", [0.3, 1.0])
def test_forest_recall_on_vectors_of_mixed_length(spark, rows_of, spread):
    x = unit_vectors(8192) * np.exp(spread * np.random.default_rng(2).standard_normal((8192, 1)))
    found = recalls(spark, rows_of, x, range(5, 8192, 67))
    assert found.mean() >= 0.95 and np.percentile(found, 5) >= 0.85


def test_near_join_of_different_texts_under_one_id(docs_of, rows_of):
    a, b, c = (" ".join(prose(k, 80)) for k in (50, 51, 52))
    for first, second in ((a, b), (b, a)):
        rows = [(1, first), (1, second), (2, a), (3, b), (4, c), (5, first), (5, c), (6, "")]
        kept = [r["text"] for r in rows_of(near_join.kept_documents(docs_of(rows)))]
        assert sorted(kept) == sorted(["", a, b, c])


def test_near_join_takes_the_row_with_the_smallest_set_hash(docs_of, rows_of):
    texts = [" ".join(prose(k, 80)) for k in range(60, 66)]
    near = [t.replace(t.split()[40], "changed", 1) for t in texts]
    least = lambda t: tuple(np.array(near_join.set_hash(shingle_set(t, 5))).view(np.int64).tolist())
    rows, wanted = [], {}
    for k in range(0, 6, 2):
        rows += [(k, texts[k]), (k, texts[k + 1]), (100 + k, near[k]), (101 + k, near[k + 1])]
        one = k if least(texts[k]) < least(texts[k + 1]) else k + 1
        wanted |= {k: 1, 100 + one: 1, 100 + (2 * k + 1 - one): 0}
    for some in (rows, rows[::-1]):
        got = {r["doc_id"]: r["n_links"] for r in rows_of(near_join.near_duplicates(docs_of(some)))}
        assert got == wanted
