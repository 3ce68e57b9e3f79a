import numpy as np
import pytest

from shoptide.llm import near_vectors, neighbours
from shoptide.llm.queries import op4_neighbours, op5_near_vectors
from tests.llm.data import FOLDER

ROWS = "vec_id long, embedding array<float>, label int, rank int, dim int, h1 long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, 3) for i, v, label in rows], ROWS)


def table(spark):
    return [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]


def cosines(vectors):
    unit = np.array(vectors, dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return unit @ unit.T


def brute_links(rows, threshold=0.98):
    ids = [r[0] for r in rows]
    near = (cosines([r[1] for r in rows]) >= threshold) & np.array([[a[2] == b[2] for b in rows] for a in rows])
    np.fill_diagonal(near, False)
    group = list(range(len(rows)))
    while True:
        new = [min([group[i], *(group[j] for j in np.flatnonzero(near[i]))], key=lambda g: ids[g]) for i in range(len(rows))]
        if new == group:
            return {ids[i]: (int(near[i].sum()), ids[group[i]]) for i in range(len(rows))}
        group = new


def odd():
    one = [1.0, 2.0, 0.0]
    return [(1, one, 1), (2, one, 1), (2, one, 1), (3, [2.0, 4.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1),
            (7, [1.0, float("nan"), 0.0], 1), (8, [1.0, float("inf"), 0.0], 1), (None, one, 1), (9, one, None), (10, one, 2), (11, [1.0, 2.0], 1),
            (12, [-1.0, -2.0, 0.0], 1), (50, [1.0, 2.0, 0.001], 1), (100, [], 1)]


def test_neighbours_are_found(spark):
    rows = table(spark)
    ids, near = np.array([r[0] for r in rows]), cosines([r[1] for r in rows])
    found = {}
    for r in op4_neighbours(spark, FOLDER).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, answers in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        answers.sort()
        assert [a[0] for a in answers] == [1, 2, 3, 4, 5] and q not in [a[1] for a in answers]
        assert all(a[2] == pytest.approx(near[at][ids == a[1]][0], abs=1e-12) for a in answers)
        order = [i for i in np.lexsort((ids, -near[at])) if i != at][:5]
        hits += len({a[1] for a in answers} & set(ids[order].tolist()))
    assert hits >= 0.9 * 5 * len(found)


def test_small_blocks_change_nothing(spark):
    rows = frame(spark, table(spark))
    queries = rows.where("vec_id % 10 = 0")
    small, large = (sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in neighbours.nearest(rows, queries, block=b).collect()) for b in (7, 4096))
    assert small == large


def test_odd_vectors_have_no_neighbours_and_ties_go_to_smaller_ids(spark):
    rows = frame(spark, odd())
    found = neighbours.nearest(rows, rows.where("vec_id in (2, 4, 5, 6, 7, 8, 11, 50)"), probes=6).orderBy("query_id", "rank").collect()
    answers = {}
    for r in found:
        answers.setdefault(r.query_id, []).append(r.vec_id)
    assert answers[50] == [1, 2, 3, 9, 10]
    assert set(answers) == {2, 50}  # 11 has no other vector of its length
    assert [r.rank for r in found if r.query_id == 50] == [1, 2, 3, 4, 5]
    assert neighbours.nearest(rows.limit(0), rows).count() == neighbours.nearest(rows, rows.limit(0)).count() == 0


def test_short_answers_are_whole(spark):
    """Vectors far from each other share no bucket; all of them are answers all the same."""
    rng = np.random.default_rng(2)
    for n in (2, 4, 9):
        far = [(i, np.float32(row).tolist(), 1) for i, row in enumerate(rng.normal(size=(n, 64)))]
        far += [(100 + i, [1.0, float(i)], 1) for i in range(3)]
        rows = frame(spark, far)
        for block in (4096, 2):
            found = {}
            for r in neighbours.nearest(rows, rows, tables=1, probes=1, block=block).collect():
                found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
            for i, v, _ in far:
                near = sorted((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w, _ in far if j != i and len(w) == len(v))
                got = sorted(found.get(i, []))
                assert [g[0] for g in got] == list(range(1, min(5, len(near)) + 1))
                if len(near) <= 5:
                    assert [g[1] for g in got] == [j for _, j in near] and all(abs(g[2] + s) < 1e-12 for g, (s, _) in zip(got, near))


def near_rows():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for spread in (0.02, 0.01, 0.025):
        centre = rng.normal(size=64)
        for _ in range(60):
            rows.append((n, centre + spread * np.linalg.norm(centre) / 8 * 3 * rng.normal(size=64), 1))
            n += 1
    rows += [(n + k, rows[k][1] * 3, rows[k][2]) for k in range(10)]
    rows += [(1000 + k, rng.normal(size=64), k % 3) for k in range(150)]
    return [(i, np.float32(v).tolist(), label) for i, v, label in rows]


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, block):
    rows = near_rows()
    want = brute_links(rows)
    assert sum(n for n, _ in want.values()) > 1000
    found = {r.vec_id: r for r in near_vectors.near_duplicates(frame(spark, rows), block=block).collect()}
    wrong = [i for i, (n, c) in want.items() if (found[i].n_links, found[i].component_id) != (n, c)]
    assert len(wrong) <= 0.01 * len(want), wrong
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_given_vectors_equal_brute_force(spark):
    want = brute_links(table(spark))
    assert {r.vec_id: (r.n_links, r.component_id) for r in op5_near_vectors(spark, FOLDER).collect()} == want


def test_odd_vectors_link_with_nothing(spark):
    rows = odd()
    found = near_vectors.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=repr)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (50, 4, 1, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 100)]
    assert got == sorted(want, key=repr)
    assert near_vectors.near_duplicates(frame(spark, [])).count() == 0
