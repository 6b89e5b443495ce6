import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewell.operators.units import optimal_cuts, pelt, reversed_values, stated_unit, to_common_units, unit_shifts

UNITS = [
    ("pieces/m3", "number_per_volume", 1.0), ("Pieces / M3", "number_per_volume", 1.0), ("10^3 pieces/m3", "number_per_volume", 1e3), ("x1000 items/m3", "number_per_volume", 1e3),
    ("items per ten cubic metres", "number_per_volume", 0.1), ("items per 1,000 m³", "number_per_volume", 1e-3), ("pcs L-1", "number_per_volume", 1e3), ("n (100 m3)-1", "number_per_volume", 0.01),
    ("particles per US gallon", "number_per_volume", 1 / 0.003785411784), ("pieces/gal (US)", "number_per_volume", 1 / 0.003785411784), ("pcs/cu ft", "number_per_volume", 1 / 0.028316846592), ("MP/dm3", "number_per_volume", 1e3), ("천 개/m3", "number_per_volume", 1e3), ("개/ℓ", "number_per_volume", 1e3),
    ("백만 개/km2", "number_per_area", 1.0), ("items per square nautical mile", "number_per_area", 1 / 3429904.0), ("pieces/sq mi", "number_per_area", 1 / 2589988.110336), ("pieces/ha", "number_per_area", 1e-4), ("10^6 items km-2", "number_per_area", 1.0),
    ("particles per 50 g d.w.", "number_per_mass", 20.0), ("items/100g", "number_per_mass", 10.0), ("n g-1", "number_per_mass", 1e3), ("items per pound", "number_per_mass", 1 / 0.45359237),
    ("㎎/㎥", "mass_per_volume", 1e-3), ("μg L-1", "mass_per_volume", 1e-3), ("nanograms per litre", "mass_per_volume", 1e-6), ("mg m-3", "mass_per_volume", 1e-3),
]
NO_UNITS = [None, "", "Volume filtered 436 m3", "94 g subsample kept", "20 L bucket sample", "sieved at 300 µm", "swept area 0.480 km2", "filter dried, 15 mg residue", "net torn, repeat tow", "5 L blanks", "시료 722 mL 보관", "calm sea, 2 m swell", "x" * 20000]


def test_spellings(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in UNITS], "u string").select("u", stated_unit(F.col("u")).alias("s"))
    got = {r["u"]: r["s"] for r in df.collect()}
    for u, family, factor in UNITS:
        assert got[u] is not None and got[u]["family"] == family and got[u]["factor"] == pytest.approx(factor), u


def test_bare_amounts_are_no_units(spark):
    df = spark.createDataFrame([(u,) for u in NO_UNITS], "u string").select("u", stated_unit(F.col("u")).alias("s"))
    assert [r["u"] for r in df.collect() if r["s"] is not None] == []


def test_texts_around_a_unit(spark):
    texts = ["lab sheet 697: 10^3 pieces/m3, sieve 300 µm", "conc. n (100 m3)-1 (filtered 475 L)", "not as stated, value is pcs/cm3 (lab mail 85)", "단위 정정: pieces/10 m3", "Mesh 300 µm. Results without unit: mg l-1.", "단위 표기가 없는 값은 개/㎥이다."]
    got = [r["s"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", stated_unit(F.col("t")).alias("s")).orderBy("i").collect()]
    assert [g["factor"] for g in got] == pytest.approx([1e3, 0.01, 1e6, 0.1, 1.0, 1.0])


def test_precedence_and_nulls(spark):
    obs = spark.createDataFrame(
        [(1, "A", 2.0, "pieces/L", "values in pieces/m3", "q"), (2, "A", 2.0, "pieces/L", None, "q"), (3, "A", 2.0, None, None, "q"), (4, "B", 2.0, None, None, "q"), (5, "A", 2.0, "odd", None, "q"), (6, None, None, None, "net torn", "q"), (1, "A", 2.0, "pieces/L", "values in pieces/m3", "q")],
        "obs_id long, survey_code string, measurement double, unit string, remarks string, quantity string",
    )
    notes = spark.createDataFrame([("A", "Results without unit: mg/L."), ("B", "Night tows only; 5 L blanks"), (None, "mg/L apply"), ("A", "Results without unit: mg/L.")], "survey_code string, protocol_note string")
    q = spark.createDataFrame([("number_per_volume", "pieces/m3"), ("mass_per_volume", "mg/m3")], "quantity string, common_unit string")
    got = {r["obs_id"]: (r["unit_from"], r["quantity"], r["common_value"]) for r in to_common_units(obs, notes, q).collect()}
    assert got == {1: ("remarks", "number_per_volume", 2.0), 2: ("unit", "number_per_volume", 2000.0), 3: ("note", "mass_per_volume", 2000.0), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}
    assert to_common_units(obs, notes, q).count() == 7
    assert to_common_units(obs.limit(0), notes.limit(0), q.limit(0)).collect() == []


def brute(x, penalty, size):
    n = len(x)
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    best = {0: (-penalty, [])}
    for t in range(size, n + 1):
        best[t] = min((best[s][0] + cost(s, t) + penalty, best[s][1] + [t]) for s in best if s <= t - size)
    return best[n][1]


@pytest.mark.parametrize("seed", range(6))
def test_changepoints_are_optimal(seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(m, 1, r.integers(6, 25)) for m in r.normal(0, 6, 4)])
    assert pelt(x, 10.0, 2) == brute(x, 10.0, 2)
    assert pelt(np.zeros(0), 1.0) == [] and pelt(np.ones(1), 1.0, 5) == [1]


def test_pieces_give_the_cuts_of_their_rows():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(m, 1, 60) for m in (0, 5, 5, -4)])
    ends = pelt(x, 15.0, 5)
    edges = sorted({*range(0, 241, 20), *ends})
    pieces = [x[a:b] for a, b in zip(edges, edges[1:])]
    got = optimal_cuts(np.array([len(p) for p in pieces]), np.array([p.sum() for p in pieces]), np.array([(p * p).sum() for p in pieces]), 15.0, 5)
    assert [edges[k] for k in got] == ends


def history(spark):
    r = np.random.default_rng(3)
    rows = [(k, ("S" if k < 600 else None), k, float(np.exp(r.normal(0, 0.3)) * (1000.0 if 200 <= k < 400 else 1.0))) for k in range(700)] + [(900, "S", 900, None), (901, "S", 901, -999.0), (902, "S", 902, 0.0)]
    return spark.createDataFrame(rows, "id long, code string, at long, v double")


@pytest.mark.parametrize("block", [4096, 150, 40])
def test_unit_change_is_found_whatever_the_blocks(spark, block):
    df = history(spark)
    got = unit_shifts(df, "code", ["at"], "id", "v", block_rows=block).orderBy("source", "segment").collect()
    # three segments and one: no block edge is a cut
    assert [(g["source"], g["first_key"], g["last_key"], g["factor"] and round(math.log10(g["factor"]))) for g in got] == [(None, 600, 699, None), ("S", 0, 199, None), ("S", 200, 399, 3), ("S", 400, 599, -3)]
    back = {r["id"]: r for r in reversed_values(df, "code", ["at"], "id", "v", block_rows=block).collect()}
    assert len(back) == 700 and all(b["factor"] == pytest.approx(1000.0 if 200 <= i < 400 else 1.0) for i, b in back.items())
    assert max(b["reversed_value"] for b in back.values()) < 5


def test_shifts_that_match_no_factor_stay(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(k, "S", k, float(np.exp(r.normal(0, 0.2)) * (4.5 if k >= 150 else 1.0))) for k in range(300)], "id long, code string, at long, v double")
    got = unit_shifts(df, "code", ["at"], "id", "v").orderBy("segment").collect()
    assert len(got) == 2 and got[1]["factor"] is None and got[1]["shift"] == pytest.approx(math.log(4.5), abs=0.1)
    assert reversed_values(df, "code", ["at"], "id", "v").where("factor <> 1").count() == 0
    assert unit_shifts(df.limit(0), "code", ["at"], "id", "v").collect() == [] and reversed_values(df.limit(0), "code", ["at"], "id", "v").collect() == []
