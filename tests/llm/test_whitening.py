import numpy as np
import pytest

from glossa.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA)


def by_numpy(rows):
    """vec_id, deviation and the whitened components, and the shares explained, for rows without a flaw."""
    x = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    own = np.array([v for _, v in x], object) * n - s
    return n, [int(d) for d in (own * own).sum(axis=1)], (own.astype(float) / n) @ axes[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()


def test_against_numpy(table):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + rng.normal(size=12) * 50
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))] + [(1000 + i, base[0].tolist()) for i in range(200)] + [(7, base[1].tolist())] * 2 + [(None, base[2].tolist())]
    bad = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] + [1.0] * 11), (2003, [float("-inf")] * 12), (2004, [float("inf")] + [0.0] * 11)]
    got = whitening.whiten(table(rows + bad)).collect()
    n, deviations, whitened, explained = by_numpy(rows)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} == {300}
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    for k in range(4):
        own = {r.vec_id: r for r in got if r.component == k + 1}
        sign = np.sign(own[0].whitened * whitened[0, k])
        for (i, _), d, w in zip(rows, deviations, whitened[:, k], strict=True):
            if i not in (7, None):
                assert own[i].deviation == d and own[i].whitened == pytest.approx(sign * w, abs=1e-9)
                assert own[i].explained == pytest.approx(explained[k], rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    # the order of rows and tasks does not matter
    again = whitening.whiten(table(rows).repartition(7)).collect()
    assert {(r.vec_id, r.component, round(r.whitened, 8)) for r in again} == {(r.vec_id, r.component, round(r.whitened, 8)) for r in got}


def test_leading_components_alone(table, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(120, 16)) * np.linspace(4, 1, 16)).astype(np.float32))]
    _, _, whitened, explained = by_numpy(rows)
    monkeypatch.setattr(whitening, "MOST_DENSE", 2)
    got = whitening.whiten(table(rows)).collect()
    for r in got:
        assert abs(r.whitened) == pytest.approx(abs(whitened[r.vec_id, r.component - 1]), abs=1e-6)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-6) and r.identity_error < 1e-6


def test_shorter_vectors_and_few_components(table):
    got = whitening.whiten(table([(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [])])).collect()
    # 256, 512 and 0 in one dimension: one component
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == [(1, 1, 3, 0), (2, 1, 3, 0), (3, 1, 3, 768**2), (4, 1, 3, 768**2)]
    assert {round(r.explained, 12) for r in got} == {1.0}


def test_large_entries(table):
    got = whitening.whiten(table([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [1e30, 1.0]), (4, [0.0, 5.0])])).collect()
    assert len(got) % 4 == 0 and any(r.deviation is None for r in got)
    assert all(np.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [3.0, 4.0])], [(1, [3.0]), (2, [3.0])]])
def test_no_variance(table, rows):
    out = whitening.whiten(table(rows))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
