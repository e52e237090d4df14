"""The minimum-covariance-determinant estimate of the quality rules against NumPy."""

import math

import numpy as np
import pytest

from moodlens.llm import quality as q

P = q.P


def chi_samples(p, n=400_000):
    return (np.random.default_rng(p).standard_normal((n, p)) ** 2).sum(axis=1)


def test_chi_squared_and_consistency_against_samples():
    for p in (4, 5, 7):
        d = chi_samples(p)
        for x in (1.0, 4.4, 9.0):
            assert abs(q.chi_squared(x, p) - (d <= x).mean()) < 5e-3
        assert abs(q.chi_quantile(0.75, p) - np.quantile(d, 0.75)) < 0.05
    z = np.random.default_rng(1).standard_normal((400_000, 5))
    d = (z ** 2).sum(axis=1)
    inner = z[d <= np.quantile(d, 0.75)]
    assert abs(1 / inner.var(axis=0).mean() - q.consistent(0.75)) < 0.02
    assert abs(1 - q.chi_squared(q.CUT, 5) - 1e-6) < 1e-9


# brute force


def class_quantile(x, share):
    b = np.sort(np.floor(x * q.FINE))
    return (b[math.ceil(share * len(b)) - 1] + 0.5) / q.FINE


def squared(x, e):
    z = np.linalg.solve(e[1], (x - e[0]).T)
    return (z ** 2).sum(axis=0)


def factor(c):
    return np.linalg.cholesky(c)


def blended(nearest, share):
    """The estimates of all groups from their nearest rows."""
    n = {k: len(x) for k, x in nearest.items()}
    total = sum(n.values())
    own = {k: (x.mean(axis=0), np.cov(x.T, bias=True).reshape(P, P)) for k, x in nearest.items()}
    pooled = [sum(own[k][i] * n[k] for k in own) / total for i in range(2)]
    mix = lambda k, i: (own[k][i] * n[k] + pooled[i] * q.POOLED_ROWS) / (n[k] + q.POOLED_ROWS)
    off = {k: own[k][0] - mix(k, 0) for k in own}
    return {k: (mix(k, 0), factor(mix(k, 1) * q.consistent(share) + np.outer(off[k], off[k]))) for k in own}


def step(groups, estimate):
    near = {}
    for k, x in groups.items():
        b = np.floor(q.CLASSES * np.log2(squared(x, estimate[k]) + 1e-3))
        near[k] = x[b <= np.sort(b)[math.ceil(q.BULK * len(b)) - 1]]
    return blended(near, q.BULK)


def fall(e):
    return 2 * np.log(np.diag(e[1])).sum()


def brute_force(groups):
    starts = []
    for kind in range(3):
        e = {}
        for k, x in groups.items():
            m = np.array([class_quantile(c, 0.5) for c in x.T])
            s = np.array([max((class_quantile(c, 0.75) - class_quantile(c, 0.25)) / 1.349, 0.5 / q.FINE) for c in x.T])
            z = (x - m) / s
            a = np.tanh(z) if kind == 1 else z / np.sqrt((z ** 2).sum(axis=1) + 1e-9)[:, None]
            a = a.T @ a
            scale = np.sqrt(np.diag(a) + 1e-9)
            r = a / np.outer(scale, scale) * len(x) / (len(x) + q.POOLED_ROWS) * (kind > 0)
            np.fill_diagonal(r, 1.0)
            e[k] = (m, factor(r * np.outer(s, s)))
        for _ in range(q.EXPLORE):
            e = step(groups, e)
        starts.append(e)
    # equal determinants: by the starts' names
    best = {k: min((starts[i] for i in (0, 2, 1)), key=lambda e: fall(e[k]))[k] for k in groups}
    for _ in range(q.MOST_STEPS):
        new = step(groups, best)
        fell = {k for k in groups if fall(new[k]) < fall(best[k]) - q.FALL}
        best = {k: new[k] if k in fell else best[k] for k in groups}
        if not fell:
            break
    limit = q.chi_quantile(q.NEAR, P)
    return blended({k: x[squared(x, best[k]) <= limit] for k, x in groups.items()}, q.NEAR)


def rows_of(groups):
    return [(*k, *map(float, v)) for k, x in groups.items() for v in x]


SCHEMA = "__lang string, __source string, " + ", ".join(f"{x} double" for x in q.X)


@pytest.fixture(scope="module")
def contaminated():
    rng = np.random.default_rng(3)
    out = {}
    for i, n in enumerate((900, 300, 40)):
        a = rng.standard_normal((P, P))
        c = a @ a.T / P + 0.2 * np.eye(P)
        x = rng.multivariate_normal(np.arange(P) + i, c, n)
        bad = n // 5
        x[:bad] = rng.multivariate_normal(np.arange(P) + i + 9, 0.1 * np.eye(P), bad)
        out["=en", f"=s{i}"] = x
    return out


def test_estimate_against_numpy(spark, contaminated):
    got = q.estimated(spark.createDataFrame(rows_of(contaminated), SCHEMA)).collect()
    want = brute_force(contaminated)
    assert len(got) == len(want)
    for r in got:
        m, low = want[r["__lang"], r["__source"]]
        assert np.allclose([r[f"m{i}"] for i in range(P)], m, rtol=1e-6, atol=1e-6)
        assert np.allclose([r[f"l{i}{j}"] for i, j in q.PAIRS], [low[i, j] for i, j in q.PAIRS], rtol=1e-6, atol=1e-6)


def test_a_fifth_of_far_rows_does_not_move_the_estimate(spark, contaminated):
    frame = spark.createDataFrame(rows_of(contaminated), SCHEMA)
    found = q.measured(frame, q.estimated(frame)).toPandas()
    for (lang, source), x in contaminated.items():
        own = found[(found["__lang"] == lang) & (found["__source"] == source)]
        bad = len(x) // 5
        far = np.array([d for *v, d in own[[*q.X, "d"]].itertuples(index=False) if (x[:bad] == np.array(v)).all(axis=1).any()])
        clean = own[~own["d"].isin(far)]["d"]
        assert len(far) == bad
        if len(x) >= 300:
            assert far.min() > q.CUT and (clean <= q.CUT).all()
            # quartiles of chi-squared with five degrees: 2.67, 4.35, 6.63
            assert np.allclose(np.quantile(clean, [0.25, 0.5, 0.75]), [2.67, 4.35, 6.63], rtol=0.25)


def test_groups_without_spread_and_of_one_row(spark):
    same = [("=a", "=one", 1.0, 2.0, 3.0, 4.0, 5.0)] * 50
    got = q.measured(spark.createDataFrame([*same, ("=b", "=alone", 2.0, 2.0, 3.0, 4.0, 5.0)], SCHEMA),
                     q.estimated(spark.createDataFrame([*same, ("=b", "=alone", 2.0, 2.0, 3.0, 4.0, 5.0)], SCHEMA))).collect()
    assert len(got) == 51
    assert all(r.d <= 1.01 for r in got if r["__source"] == "=one")


def test_bulk_of_the_documents_is_near_chi_squared(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = np.array([r.distance for r in q.assess(docs).where("not base_failed").select("distance").collect()])
    assert np.allclose(np.quantile(d, [0.25, 0.5, 0.75]), [2.67, 4.35, 6.63], rtol=0.3)


def test_copies_share_a_verdict_and_long_texts_stay(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    copy, page = text(300), text(200)
    rows = [(i, text(int(rng.lognormal(5.6, 0.8)) + 50), "en", "s") for i in range(300)]
    rows += [(1000 + i, copy, "en", "s") for i in range(40)] + [(2000, text(8000), "en", "s")]
    rows += [(3000, page + "\n" + page + " " + text(900), "en", "s"), (4000, None, "en", "s"), (4001, "", None, None)]
    got = {r.doc_id: (r.kept, r.distance) for r in q.assess(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert len({got[1000 + i] for i in range(40)}) == 1 and got[1000][0]
    assert got[2000][0]
    assert not got[4000][0] and not got[4001][0]
