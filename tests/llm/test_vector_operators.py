"""Vector codes and whitening against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoscan.llm import vector_codes, whitening
from orthoscan.llm.common import clean_vectors
from tests.conftest import same_rows

SCHEMA = "vec_id long, embedding array<float>, label int, code string, features int, error long, of_label string"


def table_of(spark, rows):
    """Rows (vec_id, vector, label) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "c", 1, 2, "l") for i, v, g in rows], SCHEMA)


def awkward(dims=16, n=60):
    """Usable vectors, some of them repeated, and others that are to be dropped."""
    rng = np.random.Generator(np.random.PCG64(4))
    v = rng.standard_normal((n, dims)).astype(np.float32)
    rows = [(i * 3 % 101, v[i], i % 3 if i % 7 else None) for i in range(n)]
    rows += [(500 + i, v[0], 1) for i in range(n)]  # one vector that half of the rows repeat
    rows += [(3, v[1], 0), (None, v[2], 2), (None, v[2], 2)]
    bad = [None, [], [None] * dims, [np.nan] * dims, [np.inf] + [0.0] * (dims - 1), [1.0] * (dims - 1)]
    return rows, rows + [(900 + k, b, 0) for k, b in enumerate(bad)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(map(float, r[1]))))
    x = np.floor(4096 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64)
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own := x[at[:, p] == e, p]).size:
                    books[p, e] = np.floor_divide(own.sum(0), len(own))
    at = assign()
    error = sum(((x[:, p] - books[p][at[:, p]]) ** 2).sum(1) for p in range(parts))
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(repr((r[0], r[2], bytes(a.astype(np.uint8)).hex(), int(e), by_label[r[2]])) for r, a, e in zip(rows, at, error, strict=True)), digest


@pytest.mark.parametrize(("dims", "salts"), [(16, 16), (13, 2)])
def test_codes_equal_plain_lloyd_rounds(spark, monkeypatch, dims, salts):
    monkeypatch.setattr(vector_codes, "SALTS", salts)
    monkeypatch.setattr(vector_codes, "SALT_ROWS", 50)
    monkeypatch.setattr(vector_codes, "BLOCK", 5)
    good, every = awkward(dims)
    coded, books = vector_codes.vector_codes(table_of(spark, every).repartition(3))
    want, digest = plain_codes(good)
    assert sorted(repr((r.vec_id, r.label, r.code, r.error, r.label_error)) for r in coded.collect()) == want
    assert books.digest() == digest


def test_codes_of_few_or_no_rows_and_of_large_components(spark):
    rows = [(2, [1.0] * 8, None), (1, [-0.5] * 8, None), (1, [-0.5] * 8, 4)]
    coded, books = vector_codes.vector_codes(table_of(spark, rows))
    want, digest = plain_codes(rows)
    assert sorted(repr((r.vec_id, r.label, r.code, r.error, r.label_error)) for r in coded.collect()) == want
    assert books.entries.shape == (8, 3, 1) and books.digest() == digest
    coded, books = vector_codes.vector_codes(table_of(spark, [(1, None, 0)]))
    assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    coded, books = vector_codes.vector_codes(table_of(spark, [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0)]))
    assert [r.error for r in coded.collect()] == [0, 0] and books.entries.max() == books.limit


def test_only_members_that_change_entry_move(spark):
    """Stayers keep their partition: the union has as many partitions as before, and arrivals alone are shuffled."""
    rng = np.random.Generator(np.random.PCG64(6))
    rows = np.column_stack([np.zeros(400, dtype=np.int64), rng.integers(-50, 50, (400, 2)), np.ones(400, dtype=np.int64)])
    books = np.array([[[-20, -20], [20, 20], [0, 30]]])
    first = vector_codes.nearest(rows[:, 1:-1], books[0])[0]
    members = spark.sparkContext.parallelize(list(vector_codes._dealt(rows, first, 3, 4)), 3).partitionBy(6, vector_codes._place)
    after = books + np.array([[[3, 0], [0, -9], [4, 4]]])
    state = members.mapPartitions(lambda x: vector_codes._reassigned(x, after, 4), preservesPartitioning=True)
    moved = sum(len(b) for _, (gone, b) in state.collect() if gone)
    found = vector_codes.nearest(rows[:, 1:-1], after[0])[0]
    assert 0 < moved == int((found != first).sum()) < 200
    stay = state.filter(lambda x: not x[1][0]).mapValues(lambda v: v[1])
    move = state.filter(lambda x: x[1][0]).mapValues(lambda v: v[1]).mapPartitions(list).partitionBy(6, vector_codes._place)
    both = stay.union(move)
    assert both.getNumPartitions() == 6 and both.partitioner == members.partitioner
    assert all(vector_codes._place(owner) % 6 == k for k, part in enumerate(both.glom().collect()) for owner, _ in part)
    held = {(o // 4, *r) for o, b in both.collect() for r in b[:, 1:-1].tolist()}
    assert held == {(int(e), *r) for e, r in zip(found, rows[:, 1:-1].tolist(), strict=True)}


def test_op11_equals_sql(spark, sf, duck):
    same_rows(vector_codes.op11_vector_codes(spark, sf), duck, vector_codes.OP11_SQL)


def plain_whitening(rows, components=4):
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float64)) + 0.0
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = ((n * x.astype(np.int64) - sums.astype(np.int64)) ** 2).sum(axis=1)
    return n, deviation, (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(v)


def check_whitened(out, rows):
    n, deviation, white, explained = plain_whitening(rows)
    got = {}
    for r in out.collect():
        assert r.n == n and r.identity_error <= 1e-4
        got.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened, r.explained))
    want = {}
    for i, r in enumerate(rows):
        want.setdefault((r[0], int(deviation[i])), []).append(white[i])
    assert got.keys() == want.keys()
    signs = {}
    for key, found in got.items():
        assert len(found) == 4 * len(want[key])
        for component, value, share in found:
            assert abs(share - explained[component - 1]) <= 1e-9
            near = want[key][0][component - 1]
            if abs(near) > 1e-3:
                assert signs.setdefault(component, np.sign(near * value)) == np.sign(near * value)
            assert abs(abs(value) - abs(near)) <= 1e-8


def test_whitening_equals_a_dense_solution(spark):
    good, every = awkward(dims=20)
    check_whitened(whitening.whiten(table_of(spark, every).repartition(3)), good)


def test_op13_equals_a_dense_solution(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitened(whitening.op13_embedding_whitening(spark, sf), rows)


@pytest.mark.parametrize("spectrum", ["dominant", "flat"])
def test_filter_converges_for_hard_spectra(spark, spectrum):
    """One direction far above all others, and wanted ones close to each other."""
    rng = np.random.Generator(np.random.PCG64(8))
    scale = np.linspace(1.0, 0.9, 48)
    if spectrum == "dominant":
        scale[:3] = 300, 20, 1.4
    basis = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    v = (rng.standard_normal((3000, 48)) * scale @ basis).astype(np.float32)
    rows = [(i, x, 0) for i, x in enumerate(v)]
    kept, dims = clean_vectors(spark.createDataFrame([(i, x.tolist()) for i, x, _ in rows], "vec_id long, features array<float>"), "features")
    found = whitening.fit_whitener(kept, dims)
    x = np.floor(256 * v.astype(np.float64))
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    assert np.allclose(found.values, values[::-1][:4], rtol=1e-12)
    assert np.abs(1 - np.abs((found.vectors * vectors[:, ::-1][:, :4]).sum(axis=0))).max() < 1e-12
    assert found.residual <= 1e-12 * values[-1]


def test_whitening_without_variance(spark):
    line = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(5)]
    out = whitening.whiten(table_of(spark, line)).collect()
    assert {r.component for r in out} == {1} and len(out) == 5 and abs(out[0].explained - 1) < 1e-12
    assert whitening.whiten(table_of(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    assert whitening.whiten(table_of(spark, [])).count() == 0
    assert whitening.whiten(table_of(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    far = whitening.whiten(table_of(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 0.5], 0), (3, [0.0, 0.0], 0)])).where(F.col("component") == 1).collect()
    assert len(far) == 3 and all(np.isfinite(r.whitened) for r in far)


def test_deviations_are_exact_or_null():
    w = whitening.Whitener(3, [10**9, -5], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[10.0**9, 2.0], [0.0, 0.0], [2.0**40, 1.0]])
    exact = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, w.sums, strict=True)) for row in x]
    assert w.deviations(x) == [v if v < 2**63 else None for v in exact] and w.deviations(x)[2] is None
