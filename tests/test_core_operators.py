"""Operators of the analyses on literal fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewell.functions import scalars as S
from brinewell.operators import causal, cellfits, models, profile, regression, reshape, retrieval, text
from brinewell.sources import tables


def col(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_scalars(spark):
    got = col(spark, [None, 0.0, -1.0, 1.0], "double", S.safe_ln)
    assert got[0] is None and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0
    assert col(spark, [None, 0.0, 0.5, 1.0, 1.5], "double", lambda c: S.cap(c, 1.0)) == [None, 0.0, 0.5, 1.0, 1.0]
    assert col(spark, [0.0, 0.5, 5.0, 10.0, 10.1, 20.0, 21.0], "double", lambda v: S.bin_index(v, F.lit(0.0), F.lit(20.0), F.lit(10.0))) == [0, 0, 0, 0, 1, 1, None]
    assert col(spark, [0.125, None], "double", S.round_even) == [0.12, None]
    assert col(spark, ["a-b, c", "x,", "a+b", ""], "string", S.split_tokens) == [["a", "b", "", "c"], ["x", ""], ["a", "b"], [""]]
    assert col(spark, ["1. abc\n\n#. d\n- e", None], "string", S.strip_list_marks) == ["abc\n\nd\n- e", None]
    assert col(spark, ["예", " yes\n", "Yes", "아니오", None], "string", S.is_yes) == [True, True, False, False, False]
    assert col(spark, ["x" * 19, "x" * 40, None], "string", S.expected_count) == [0, 2, None]
    assert col(spark, [-math.inf, 0.123, math.nan], "double", lambda c: S.scaled_ceil(c, 100))[:2] == [-math.inf, 0.13]
    dates = ["1/2/2015 12:00:00 AM", "2015-01-02", "2015/01/02", "20150102", "02.01.2015", "soon", None]
    assert [d and d.strftime("%F") for d in col(spark, dates, "string", S.parse_date)] == ["2015-01-02"] * 5 + [None, None]
    with pytest.raises(ValueError):
        S.edges(0, 5, 0)


def test_profiles(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 8.0), ("b", None)], "k string, v double")
    assert {tuple(r) for r in profile.group_size(df, "k").collect()} == {("a", 4), ("b", 1)}
    q = {(r["k"], r["q"]): r["value"] for r in profile.group_quantiles(df, "v", ["k"], [0.25, 0.5]).collect()}
    assert q[("a", 0.25)] == 1.75 and q[("a", 0.5)] == 3.0
    r = np.random.default_rng(3)
    many = [("abc"[int(k)], float(v)) for k, v in zip(r.integers(0, 3, 3000), np.round(r.normal(0, 5, 3000), 1))] + [("a", -math.inf), ("a", math.inf), ("d", 7.0), ("e", None)]
    for parts in (1, 9):
        big = spark.createDataFrame(many, "k string, v double").repartition(parts)
        got = {(x["k"], x["q"]): x["value"] for x in profile.group_quantiles(big, "v", ["k"], [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
        want = {(k, x): float(np.quantile([v for j, v in many if j == k], x)) for k in "abcd" for x in (0.1, 0.5, 0.999)}
        assert {k: v for k, v in got.items() if k in want} == pytest.approx(want) and got[("a", 0.0)] == -math.inf and got[("a", 1.0)] == math.inf and len(got) == 20
        whole = {x["q"]: x["value"] for x in profile.group_quantiles(big, "v", [], [0.25, 0.75]).collect()}
        assert whole == pytest.approx({x: float(np.quantile([v for _, v in many if v is not None], x)) for x in (0.25, 0.75)})
    h = profile.histogram(df, "v", 7).orderBy("bin").collect()
    assert [(r["bin"], r["count"]) for r in h] == [(0, 2), (1, 1), (3, 1), (6, 1)]
    inf = spark.createDataFrame([(x,) for x in (-math.inf, -math.inf, -3.0, -1.0, 0.0, 0.0, 0.0)], "v double")
    r = profile.quantile_scan(inf, "v", -7.5, 0.0).first()
    assert r["low_value"] > -7.5 and r["high_value"] < 0
    for f in (lambda d: profile.group_stats(d, "v", "k"), lambda d: profile.histogram(d, "v", 5), lambda d: profile.zscore(d, "v")):
        assert f(df.limit(0)).collect() == []
    assert profile.describe(df.limit(0), "v").first()["count"] == 0


def test_reshape(spark):
    p = spark.createDataFrame([(1, 2000, 0.0), (1, 2001, 1.0), (2, 2000, 0.0)], "u int, y int, w double")
    assert {(r["u"], r["2000"], r["2001"]) for r in reshape.treatment_matrix(p, "u", "y", "w", [2000, 2001]).collect()} == {(1, 0.0, 1.0), (2, 0.0, 0.0)}
    with pytest.raises(Exception, match="two rows"):
        reshape.treatment_matrix(p.union(p), "u", "y", "w", [2000, 2001]).collect()
    two = spark.createDataFrame([("a", 2000, 1.0), ("b", 2000, 1.0)], "u string, y int, m double")
    assert reshape.once_per(two, ["y", "m"]).count() == 1 and reshape.once_per(two, ["u", "y"]).count() == 2
    assert sorted(r["top"] for r in reshape.spread_max(p, "u", "w", "top").collect()) == [0.0, 1.0, 1.0]


def cells(spark, n=1):
    rows = [(t, p, m, 2000 + p, f"u{t}") for t, p, m in ((0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 7.0))] * n
    return spark.createDataFrame(rows, "treated int, post int, y double, year int, unit string")


def test_difference_in_differences(spark):
    r = causal.att_2x2(cells(spark), "y").first()
    assert (r["counterfactual"], r["att"], r["mirrored_att"]) == (4.0, 3.0, -5.0)
    _, g = causal.outcome_growth(cells(spark), "unit", "y")
    assert g.first()["att"] == 3.0 and g.first()["reversed"] == -3.0
    fit = regression.ols(cells(spark), "y ~ treated*post")
    assert fit.coefficient("treated:post") == pytest.approx(3.0) and fit.df_resid == 0 and fit.rows()[3][2] is None
    with pytest.raises(ValueError):
        causal.require_treated_after(cells(spark).where("treated = 0"))
    assert causal.att_2x2(cells(spark).limit(0), "y").first()["att"] is None


def test_rank_deficient_design(spark):
    df = cells(spark, 3).withColumn("same", F.col("treated")).withColumn("y", F.col("y") + F.rand(1))
    fit = regression.ols(df, "y ~ treated + same + treated:post + C(year)")
    assert fit.coefficient("treated") is None and fit.coefficient("same") is None and fit.coefficient("treated:post") == pytest.approx(3.0, abs=1.0)


def test_least_squares_against_numpy(spark):
    r = np.random.default_rng(0)
    x, z, g = r.normal(2000, 5, 200), r.normal(0, 1, 200), r.integers(0, 12, 200)
    y = 3 + 0.5 * x - 2 * z + r.normal(0, 1, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for a, b, c, k in zip(x, z, y, g)] + [(1.0, None, 1.0, 0), (1.0, 1.0, math.nan, 0), (1.0, 1.0, math.inf, 0)], "x double, z double, y double, g int")
    fit = regression.ols(df, "y ~ x + z")
    X = np.stack([np.ones(200), x, z], 1)
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    assert fit.beta == pytest.approx(beta, rel=1e-6) and fit.n == 200
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss[0] / 197)
    p = [r[4] for r in fit.rows()]
    assert p[1] < 1e-6 and regression.t_chance(1.9721, 197) == pytest.approx(0.975, abs=1e-4) and regression.t_chance(2.0, 5) == pytest.approx(0.949030, abs=1e-5) and regression.t_chance(1.96, 9000) == pytest.approx(0.975, abs=1e-4)
    assert fit.se == pytest.approx(se, rel=1e-4) and fit.critical == pytest.approx(1.9721, abs=1e-3)
    e = y - X @ beta
    meat = sum(np.outer(s, s) for s in (X[g == k].T @ e[g == k] for k in range(12)))
    inv = np.linalg.inv(X.T @ X)
    want = np.sqrt(np.diag(inv @ meat @ inv) * 12 / 11 * 199 / 197)
    assert regression.ols(df, "y ~ x + z", cluster="g").se == pytest.approx(want, rel=1e-4)


def test_logistic_paths_agree(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, 300)
    t = (r.uniform(size=300) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, t)], "x double, t int")
    one = regression.logit(df, "t ~ x")
    monkeypatch.setattr(regression, "MAX_CELLS", 10)
    two = regression.logit(df, "t ~ x")
    assert one.beta == pytest.approx(two.beta, abs=1e-8)
    p = 1 / (1 + np.exp(-(one.beta[0] + one.beta[1] * x)))
    assert (t - p).sum() == pytest.approx(0, abs=1e-6) and (x * (t - p)).sum() == pytest.approx(0, abs=1e-6)


def test_logistic_with_large_covariates(spark, monkeypatch):
    r = np.random.default_rng(4)
    year = r.integers(1995, 2024, 500)
    t = (r.uniform(size=500) < 1 / (1 + np.exp(-0.3 * (year - 2012)))).astype(int)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(year, t)], "year int, t int")
    X = np.stack([np.ones(500), year - 2012.0], 1)
    want = numpy_logit(X, t)
    for cells in (20_000, 5):
        monkeypatch.setattr(regression, "MAX_CELLS", cells)
        fit = regression.logit(df, "t ~ year")
        assert 1 / (1 + np.exp(-(fit.beta[0] + fit.beta[1] * year))) == pytest.approx(want, abs=1e-6)
        inv = np.linalg.inv((X * (want * (1 - want))[:, None]).T @ X)
        assert fit.se[1] == pytest.approx(math.sqrt(inv[1, 1]), rel=1e-4) and all(fit.identified)


def test_matching_ties(spark):
    rows = [(1, 1, 0.5, 10.0), (2, 1, 0.5, 20.0), (3, 0, 0.4, 1.0), (4, 0, 0.6, 2.0), (5, 0, 0.4, 9.0), (6, 0, 0.9, 5.0), (7, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, t int, ps double, y double")
    m = {r["id"]: r["match"] for r in causal.nearest_match(df, "id", "y", "t", "ps").collect()}
    assert m == {1: 1.0, 2: 1.0, 3: 10.0, 4: 10.0, 5: 10.0, 6: 10.0, 7: None}


@pytest.mark.parametrize("parts", [1, 7])
def test_matching_against_brute_force(spark, parts):
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(0, 2)), float(np.round(r.uniform(), 2)), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t int, ps double, y double").repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r["id"]: r["match"] for r in causal.nearest_match(df, "id", "y", "t", "ps").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    for i, t, p, _ in rows:
        best = min((round(abs(p - q), 9), q, j) for j, u, q, _ in rows if u != t)
        assert got[i] == float(best[2])


def test_weights_agree(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 7), "ab"[i % 3 % 2]) for i in range(60)], "id long, t int, y double, c string")
    s = causal.cell_score(df, "t", ["c"])
    assert causal.ipw(s, "y", "t", "ps").first()["ate"] == pytest.approx(causal.ipw_short(s, "y", "t", "ps").first()["ate"])
    one = causal.synthetic_sample(spark, 4000)
    ps = regression.probability(regression.logit(one, "t ~ x"))
    m1, m0 = (regression.ols(one.where(f"t = {a}"), "y ~ x") for a in (1, 0))
    assert causal.doubly_robust(one, "y", "t", ps, m1.predict(), m0.predict()).first()["ate"] == pytest.approx(1.0, abs=0.05)
    edge = spark.createDataFrame([(1, 1.0, 1.0), (0, 2.0, 0.0)], "t int, y double, ps double")
    assert causal.ipw(edge, "y", "t", "ps").first()["n"] == 2


def numpy_logit(X, t):
    b = np.zeros(X.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.pinv((X * (q * (1 - q))[:, None]).T @ X) @ (X.T @ (t - q))
    return 1 / (1 + np.exp(-X @ b))


def test_bootstrap_of_fitted_estimators(spark):
    r = np.random.default_rng(8)
    n, rounds = 400, 12
    g, x = r.integers(0, 3, n), r.integers(0, 4, n)
    t = (r.uniform(size=n) < 0.3 + 0.1 * g).astype(int)
    y = 1.0 * t + g - 0.5 * x + r.normal(0, 1, n)
    df = spark.createDataFrame([(i, "abc"[g[i]], int(x[i]), int(t[i]), float(y[i])) for i in range(n)], "id long, g string, x int, t int, y double")
    ipw = cellfits.ipw_ate("t ~ C(g) + x", ["g", "x"], "t", "y")
    dr = cellfits.doubly_robust_ate("t ~ C(g) + x", ["g", "x"], "t", "y")
    draws = causal.poisson_draws(np.arange(n), rounds, 123)
    X = np.stack([np.ones(n), g == 1, g == 2, x], 1).astype(float)
    for fit, robust in ((ipw, False), (dr, True)):
        for parts in (1, 5):
            got = {k["round"]: k["estimate"] for k in causal.bootstrap_rows(df.repartition(parts), "id", ["g", "x", "t"], "y", fit, rounds=rounds).collect()}
            for k in range(rounds):
                at = np.repeat(np.arange(n), draws[:, k])  # the rows themselves, as often as drawn
                Xk, tk, yk = X[at], t[at], y[at]
                ps = numpy_logit(Xk, tk)
                if robust:
                    m1, m0 = (Xk @ np.linalg.lstsq(Xk[tk == a], yk[tk == a], rcond=None)[0] for a in (1, 0))
                    want = np.mean(tk * (yk - m1) / ps + m1) - np.mean((1 - tk) * (yk - m0) / (1 - ps) + m0)
                else:
                    want = np.mean((tk - ps) / (ps * (1 - ps)) * yk)
                assert got[k] == pytest.approx(want, abs=1e-6)
    w = causal.poisson_draws(np.arange(20000), 2, 1)
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.06) and abs(np.corrcoef(w.T)[0, 1]) < 0.03
    assert causal.bootstrap_rows(df.limit(0), "id", ["g", "x", "t"], "y", ipw).collect() == []


def test_block_bootstrap_against_numpy(spark):
    r = np.random.default_rng(9)
    rows = [(f"u{i % 6}", int(i % 6 < 3), int(i % 4 // 2), 2000 + i % 4, float(r.normal() + (i % 6 < 3) * (i % 4 // 2))) for i in range(300)] + [(None, 1, 1, 2000, 5.0)]
    df = spark.createDataFrame(rows, "u string, treated int, post int, year int, y double")
    fit = cellfits.coefficient("y ~ treated:post + C(treated) + C(year)", "treated:post", "y")
    got = {k["round"]: k for k in causal.bootstrap_blocks(df, "u", ["treated", "post", "year"], "y", fit, rounds=25, seed=5).collect()}
    draws = causal.block_draws([f"u{i}" for i in range(6)], 25, 5)
    for k in range(25):
        own = [x for rd, u, n in draws if rd == k for _ in range(n) for x in rows if x[0] == u]
        T, P, Y, y = (np.array([x[i] for x in own], float) for i in (1, 2, 3, 4))
        X = np.stack([np.ones(len(T)), T, *[(Y == v) for v in (2001, 2002, 2003)], T * P], 1).astype(float)
        assert got[k]["n_units"] == len({x[0] for x in own})
        if abs((np.linalg.pinv(X) @ X)[5, 5] - 1) < 1e-6:
            assert got[k]["estimate"] == pytest.approx(np.linalg.lstsq(X, y, rcond=None)[0][5], abs=1e-8)
        else:
            assert got[k]["estimate"] is None
    one = causal.bootstrap_blocks(df.where("u = 'u0'"), "u", ["treated", "post", "year"], "y", fit, rounds=3).collect()
    assert {x["identified"] for x in one} == {False}


def test_retrieval(spark):
    lists = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 3, 3)], "query_id long, rank int, seq_num long")
    got = {r["seq_num"]: r["score"] for r in retrieval.rank_score(lists).collect()}
    assert got[3] == pytest.approx((1 + 1 / 3) / 8) and got[5] == pytest.approx(0.0625)
    r = np.random.default_rng(2)
    v = r.integers(0, 4, (120, 6)).astype(float)
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(120)] + [(500, None, 1)], "id long, v array<float>, g int").repartition(5)
    q = df.where("id % 10 = 0")
    for filt in (None, "g"):
        hits = retrieval.nearest(df, q, "id", "v", 7, filter_by=filt, query_rows=5, corpus_rows=16).collect()
        for i in range(0, 120, 10):
            d = sorted((float(((v[i] - v[j]) ** 2).sum()), j) for j in range(120) if not filt or i % 3 == j % 3)[:7]
            assert [(h["distance"], h["id"]) for h in sorted(hits, key=lambda h: h["rank"]) if h["query_id"] == i] == d
    hits = retrieval.nearest(df, q, "id", "v", 10)
    assert retrieval.greedy_diverse(hits, df, q, "id", "v", 4).groupBy("query_id").count().where("count <> 4").count() == 0
    assert retrieval.drop_redundant(hits, df, "id", "v", 1.1).count() == hits.count()
    assert retrieval.drop_redundant(hits, df, "id", "v", -1.1).count() == 12


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, None), (4, ""), (5, "d d d d")], "id long, t string")
    q = spark.createDataFrame([(9, "a x")], "id long, t string")
    got = {r["seq_num"]: r["score"] for r in retrieval.bm25(docs, "id", S.split_tokens(F.col("t")), q, "id", S.split_tokens(F.col("t"))).collect()}
    idf, avg = math.log((5 - 2 + 0.5) / 2.5), 9 / 5
    f = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {1: pytest.approx(f(1, 2)), 2: pytest.approx(f(2, 3))}


@pytest.mark.parametrize("size,overlap,seps", [(20, 5, ("\n",)), (10, 3, text.SENTENCE_SEPARATORS)])
def test_chunks_stay_within_the_size(size, overlap, seps):
    t = "One two. Three, four!\nFive six seven eight\n\nnine。十、十一" * 3
    got = text.chunk(t, size, overlap, seps)
    assert all(0 < len(c) <= size for c in got)
    assert set("".join(t.split())) == set("".join("".join(got).split()))
    assert text.chunk("", size, overlap, seps) == [] and text.chunk(" \n ", size, overlap, seps) == []


def test_self_check_rounds(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma. Delta epsilon zeta. Eta theta iota. Kappa."), (2, "short"), (3, None)], "id long, text string")
    few = lambda ps: ["1. Alpha beta gamma?" for _ in ps]
    rows = {r["id"]: r for r in models.self_check(docs, "id", "text", [few, models.question_stub], models.check_stub).collect()}
    got = {i: (len(r["queries"]), r["round"], r["done"]) for i, r in rows.items()}
    assert got[1] == (3, 2, True) and got[2] == (0, 3, False) and len({r["thread_id"] for r in rows.values()}) == 3
    never = models.self_check(docs.where("id = 1"), "id", "text", few, models.check_stub, max_rounds=2).first()
    assert (never["round"], never["done"]) == (2, False)
    seen = []

    def spy(ps):
        return [f"calls {len(ps)}"] * len(ps)

    one = models.verify_queries(spark.createDataFrame([("A b. C d.", ["A b?", "x?", "C\nd?", None])], "t string, q array<string>"), "t", "q", models.check_stub).first()
    assert one["valid"] == ["A b?", "C\nd?"] and not seen and spy(["a"]) == ["calls 1"]


def test_model_stand_ins_read_the_text():
    ask = models.ANSWER_PROMPT.replace("{context}", "The net is blue. The boat left Alva Bay at six.\n\nIt rained.").replace("{question}", "When did the boat leave Alva Bay?")
    assert models.extract_stub([ask]) == ["The boat left Alva Bay at six"]
    assert models.extract_stub([models.OTHER_PROMPT.replace("{text}", "Fibres sink. Fibres of rope sink fast in the bay. It rained.")])[0].startswith("Fibres")
    assert models.extract_stub([models.OTHER_PROMPT.replace("{text}", "")]) == [""]


def test_intents_and_keywords(spark):
    df = spark.createDataFrame([(1, "이 영향은 크다"), (2, "대응 계획"), (3, "현상과 영향"), (4, "x"), (5, None)], "id long, text string")
    assert {r["id"]: r["intent"] for r in models.metadata(df, "text").collect()} == {1: "영향", 2: "대응", 3: "현상", 4: "기타", 5: "기타"}
    k = {r["id"]: r["keywords"] for r in models.keyword_terms(spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, None), (4, "")], "id long, text string"), "id", S.split_tokens(F.col("text")), 2).collect()}
    assert k == {1: "b,a", 2: "c,a"}


def test_separators_go_with_what_follows():
    assert text._parts("a\nbb\nccc", 3, ("\n",)) == ["a", "\nbb", "\n", "ccc"] or text._parts("a\nbb\nccc", 4, ("\n",)) == ["a", "\nbb", "\nccc"]
    assert text.chunk("aaa bbb,ccc", 4, 0, text.SENTENCE_SEPARATORS) == ["aaa", "bbb", ",ccc"]


def test_embedding_search_and_compression(spark):
    v = retrieval.hashed_words(["the net is blue", "The NET, is blue!", "", "a boat"])
    assert np.allclose(v[0], v[1]) and np.linalg.norm(v[0]) == pytest.approx(1) and not v[2].any()
    docs = spark.createDataFrame([(1, "nets are blue and nets are blue. boats sail far away from here"), (2, "nets are blue"), (3, "fibres sink in water"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(7, "nets are blue")], "query_id long, question string")
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "query_id long, rank int, id long")
    got = retrieval.compress(hits, docs, q, F.split("text", r"\. "), redundant=0.95, relevant=0.5).orderBy("rank").collect()
    # the second document repeats the first one's sentence, the rest is off the question
    assert [(r["id"], r["piece_no"]) for r in got] == [(1, 0)] and got[0]["query_similarity_score"] > 0.9
    e = docs.where("text is not null").select("id", retrieval.embed(F.col("text")).alias("v"))
    assert [r["id"] for r in retrieval.search(e, e.where("id = 2"), "id", "v", 2).orderBy("rank").collect()] == [2, 1]
    assert retrieval.search(e, e.where("id = 2"), "id", "v", 2, search_type="mmr").count() == 2
    assert [r["id"] for r in retrieval.search(e, e.where("id = 3"), "id", "v", 3, search_type="similarity_score_threshold").collect()] == [3]
    with pytest.raises(ValueError):
        retrieval.search(e, e, "id", "v", search_type="other")


def test_sources(spark, tmp_path):
    csv = tmp_path / "o.csv"
    csv.write_text("Date,Measurement,Unit,Sampling Method,Density Class,Oceans,Regions,Longitude,Latitude,x,y\n2015-01-02,1.5,pieces/m3,Pump,Low,Pacific Ocean,,1,2,3,4\n,,,,,,,,,,\n")
    rows = tables.read_observation_csv(spark, str(csv)).collect()
    assert rows[0]["Measurement"] == 1.5 and rows[0]["Regions"] is None and len(rows) == 2
    for k in (1, 2):
        (tmp_path / f"a{k}.json").write_text('[{"title": "t%d", "content": "c"}, {"content": "d", "date": "x", "more": 1}]' % k)
    got = tables.read_article_json(spark, str(tmp_path / "a*.json")).orderBy("seq_num").collect()
    assert [(r["seq_num"], r["title"], r["content"]) for r in got] == [(1, "t1", "c"), (2, None, "d"), (3, "t2", "c"), (4, None, "d")]
    df = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    tables.save_index(df, str(tmp_path / "idx"))
    tables.save_index(df, str(tmp_path / "idx"), "append")
    assert tables.load_index(spark, str(tmp_path / "idx")).count() == 2
