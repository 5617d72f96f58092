"""Whitening against exact arithmetic in Python."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, code string"


def table(spark, vectors):
    rows = [(i, v, 1, 5, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute(vectors, components=16):
    """n, sums, exact covariance, and each kept row's deviation; by length."""
    by = {}
    for i, v in enumerate(vectors):
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            by.setdefault(len(v), []).append((i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)))
    out = {}
    for d, rows in by.items():
        fit = sorted({x for _, x in rows})
        n = len(fit)
        sums = [sum(x[j] for x in fit) for j in range(d)]
        cov = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3) for b in range(d)] for a in range(d)]
        out[d] = n, sums, np.array([[float(c) for c in line] for line in cov]).reshape(d, d), dict(rows), {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in rows}
    return out


def check(got, vectors, components=16):
    want = brute(vectors, components)
    assert len(got) == sum(min(d, components) * len(x[3]) for d, x in want.items())
    for d, (n, sums, cov, rows, deviation) in want.items():
        if not d:
            continue
        e = np.linalg.eigvalsh(cov)[::-1][:components]
        mine = {}
        for r in got:
            if r.vec_id in rows:
                mine.setdefault(r.vec_id, {})[r.component] = r
        mean = np.array([float(Fraction(s, n)) for s in sums])
        for i, x in rows.items():
            assert sorted(mine[i]) == list(range(1, min(d, components) + 1))
            assert {(r.n, r.deviation) for r in mine[i].values()} == {(n, deviation[i])}
        floor = 1e-9 * max(e.max(), 1e-300)
        for k in range(1, len(e) + 1):
            if e[k - 1] > floor:
                assert all(abs(mine[i][k].explained - e[k - 1] / np.trace(cov)) < 1e-9 for i in rows)
            else:
                assert all(mine[i][k].whitened is None for i in rows)
        some = [k for k in range(len(e)) if e[k] > floor]
        if some:
            first = {x: i for i, x in rows.items()}
            w = np.array([[mine[i][k + 1].whitened for k in some] for i in first.values()])
            assert np.abs(w.mean(0)).max() < 1e-9 and np.abs(w.T @ w / n - np.eye(len(some))).max() < 1e-6
            x = np.array([*first], float) - mean  # unit eigenvectors: w * sqrt(e) = x projected
            u = np.linalg.lstsq(x, w * np.sqrt(e[some]), rcond=None)[0]
            if len(first) > d:
                assert np.abs((cov @ u) - u * e[some]).max() < 1e-6 * e.max()
        assert len({r.identity_error for r in got if r.vec_id in rows}) == 1


def test_whitening_matches_exact_arithmetic(spark):
    r = np.random.default_rng(2)
    vectors = (r.normal(0.1, 0.3, (300, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 150 + [vectors[7]] * 3  # a third of all rows are one vector
    vectors += [None, [*vectors[1][:19], None], [*vectors[1][:19], float("nan")], [*vectors[1][:19], float("inf")]]
    got = whitening.whiten(table(spark, vectors)).collect()
    check(got, vectors)
    assert all(x.identity_error < 1e-9 for x in got)


def test_large_entries_and_far_means(spark):
    r = np.random.default_rng(3)
    vectors = (r.normal(0, 0.05, (60, 3)) + [9e6, -3e5, 2.0]).astype(np.float32).tolist()
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)
    vectors = (r.normal(0, 1, (40, 3)) * [1e12, 1e9, 1e10]).astype(np.float32).tolist()  # squares beyond a long
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_lengths_ranks_and_empty_tables(spark):
    r = np.random.default_rng(4)
    two = [[float(a), float(b), float(a + b), 1.0] for a, b in r.integers(-50, 50, (40, 2))]
    vectors = two + r.normal(0, 1, (30, 2)).tolist() + [[]] * 3 + [[5.0] * 7] * 4
    got = whitening.whiten(table(spark, vectors)).collect()
    check(got, vectors)
    assert {x.explained for x in got if x.vec_id == 75} == {None}  # one vector alone has no variance
    assert whitening.whiten(table(spark, vectors).where("false")).collect() == []
    assert whitening.whiten(table(spark, [None, []])).collect() == []
    held = whitening.whiten(table(spark, [[3e38], [-3e38], [0.0]])).collect()
    assert len(held) == 3 and all(np.isfinite(x.whitened) for x in held)


def test_remainders_and_ranks():
    r = np.random.default_rng(5)
    y = r.integers(-(10**9), 10**9, (500, 6))
    moduli = whitening.primes(2 * 500 * 10**18)
    got = whitening.remaindered({p: whitening.product(y, p) for p in moduli})
    one = np.concatenate((y, np.ones((500, 1), np.int64)), 1).astype(object)
    assert (got == one.T @ one).all()
    a = r.integers(-9, 9, (6, 3)) @ r.integers(-9, 9, (3, 6))
    assert whitening.rank(a, moduli[0]) == np.linalg.matrix_rank(a) == 3
    assert len(whitening.primes(1)) == 2 and all(all(p % q for q in range(2, 1024)) for p in moduli)


def test_rows_in_any_order_give_one_fit():
    y = np.random.default_rng(6).integers(-40, 40, (50_000, 5))
    whole, parts = whitening.product(y, 1048573), sum(whitening.product(part, 1048573) for part in np.array_split(y[::-1], 7)) % 1048573
    assert (whole == parts).all()


@pytest.mark.parametrize("values", [[[0.5, None]], [None, [1.5, -0.015625]]])
def test_codes(values):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(values, pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    out = pa.Table.from_batches(whitening._code(iter([batch])))
    assert out.to_pylist() == [{"vec_id": i, "dim": 2, "code": bytes([96, 255])} for i, v in enumerate(values) if v == [1.5, -0.015625]]


def test_query_has_the_contract_columns(spark):
    out = queries.op12_whitening(spark, "/root/testdata/sf0.001")
    assert [c for c, _ in out.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 16 * len({r.vec_id for r in rows}) and rows[0].identity_error < 1e-9
