"""Quantities recorded in different units.

``stated_unit`` reads a unit expression from text inside whole-stage SQL
(no UDF): scale, counted or weighed thing, amount and denominator.  Units are
compared on SI bases, so a common unit is only another text to read.

``unit_shifts`` segments each source's history by exact penalised changepoint
search (PELT) on log values and matches level shifts with known factors;
``reversed_values`` takes the matched ones back.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bounded_rows, spill_table

# Spellings. Texts are compared in lower case after SIGNS.
SIGNS = {
    "㎥": "m3", "㎡": "m2", "㎢": "km2", "㎎": "mg", "㎍": "ug", "㎏": "kg", "㎖": "ml", "㎗": "dl", "㏄": "cm3", "ℓ": "l",
    "³": "3", "²": "2", "⁻¹": "-1", "¹": "1", "⁻": "-", "−": "-", "µ": "u", "μ": "u", "⁶": "^6", "×": "x", "·": " ",
}
SCALES = {
    "thousand": 1e3, "million": 1e6, "billion": 1e9, "천": 1e3, "만": 1e4, "백만": 1e6, "억": 1e8, "hundred": 1e2,
}
COUNTED = ("pieces", "piece", "pcs", "pc", "items", "item", "particles", "particle", "fragments", "counts", "count", "individuals", "n", "mps", "mp", "no.", "#", "개", "입자")
WEIGHED = {
    "micrograms": 1e-6, "microgram": 1e-6, "milligrams": 1e-3, "milligram": 1e-3, "nanograms": 1e-9, "nanogram": 1e-9, "kilograms": 1e3,
    "grams": 1.0, "gram": 1.0, "ug": 1e-6, "mg": 1e-3, "ng": 1e-9, "kg": 1e3, "g": 1.0,
}
VOLUMES = {  # cubic metres
    "cubic metres": 1.0, "cubic metre": 1.0, "cubic meters": 1.0, "cubic meter": 1.0, "cu m": 1.0, "m3": 1.0, "m^3": 1.0, "m**3": 1.0,
    "cubic decimetres": 1e-3, "cubic decimetre": 1e-3, "dm3": 1e-3, "dm^3": 1e-3, "cubic centimetres": 1e-6, "cubic centimetre": 1e-6, "cm3": 1e-6, "cm^3": 1e-6, "cc": 1e-6,
    "cubic feet": 0.028316846592, "cubic foot": 0.028316846592, "cu ft": 0.028316846592, "ft3": 0.028316846592, "ft^3": 0.028316846592,
    "litres": 1e-3, "litre": 1e-3, "liters": 1e-3, "liter": 1e-3, "l": 1e-3, "millilitres": 1e-6, "millilitre": 1e-6, "milliliters": 1e-6, "milliliter": 1e-6, "ml": 1e-6, "dl": 1e-4,
    "us gallons": 0.003785411784, "us gallon": 0.003785411784, "us gal": 0.003785411784, "gallons": 0.003785411784, "gallon": 0.003785411784, "gal": 0.003785411784,
}
AREAS = {  # square metres
    "square kilometres": 1e6, "square kilometre": 1e6, "square kilometers": 1e6, "square kilometer": 1e6, "sq km": 1e6, "km2": 1e6, "km^2": 1e6,
    "square metres": 1.0, "square metre": 1.0, "square meters": 1.0, "square meter": 1.0, "sq m": 1.0, "m2": 1.0, "m^2": 1.0, "cm2": 1e-4, "cm^2": 1e-4,
    "square nautical miles": 3429904.0, "square nautical mile": 3429904.0, "sq nmi": 3429904.0, "nmi2": 3429904.0, "nmi^2": 3429904.0, "nm2": 3429904.0,
    "square miles": 2589988.110336, "square mile": 2589988.110336, "sq mi": 2589988.110336, "mi2": 2589988.110336, "mi^2": 2589988.110336,
    "hectares": 1e4, "hectare": 1e4, "ha": 1e4,
}
MASSES = {  # kilograms
    "kilograms": 1.0, "kilogram": 1.0, "kg": 1.0, "grams": 1e-3, "gram": 1e-3, "g": 1e-3, "mg": 1e-6, "pounds": 0.45359237, "pound": 0.45359237, "lb": 0.45359237, "lbs": 0.45359237,
}
NUMBER_WORDS = {"one": 1.0, "two": 2.0, "five": 5.0, "ten": 10.0, "fifty": 50.0, "hundred": 100.0, "thousand": 1000.0}

# Conversion factors that a change of unit can leave in a history (as ratios).
KNOWN_FACTORS = (10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e9, 1 / 0.028316846592, 1 / 0.003785411784, 1.0 / 0.45359237)


def _alt(words) -> str:
    import re

    return "|".join(re.escape(w).replace(r"\ ", r"\s+").replace("/", "/") for w in sorted(words, key=len, reverse=True))


_NUM = r"\d+(?:,\d{3})*(?:\.\d+)?"
_DENOM = _alt({**VOLUMES, **AREAS, **MASSES})
#: A particle of another script may follow a unit directly. Groups: 1 power of ten, 2 scale word, 3 thing, 4 amount, 5 denominator | 6 amount, 7 denominator of the "-1" form.
UNIT = (
    rf"(?<![\p{{L}}\p{{N}}^.])(?:x?\s*(10\s*\^\s*\d+|1,?000(?:,?000)?)\s*x?\s*|({_alt(SCALES)})\s*)?"
    rf"((?:{_alt(COUNTED)}|{_alt(WEIGHED)}))"
    rf"(?:\s*/\s*|\s+per\s+)({_NUM}\s*|(?:{_alt(NUMBER_WORDS)})\s+)?({_DENOM})(?![\p{{IsLatin}}\p{{N}}])"
)
UNIT_INVERSE = (
    rf"(?<![\p{{L}}\p{{N}}^.])(?:x?\s*(10\s*\^\s*\d+|1,?000(?:,?000)?)\s*x?\s*|({_alt(SCALES)})\s*)?"
    rf"((?:{_alt(COUNTED)}|{_alt(WEIGHED)}))"
    rf"\s+\(?({_NUM}\s*)?((?:{_DENOM}|km|cm|dm|ft|nmi|mi|m))\)?\s*-([123])(?![\p{{IsLatin}}\p{{N}}])"
)


def normal_unit_text(text: Column) -> Column:
    out = F.lower(text)
    single = {k: v for k, v in SIGNS.items() if len(k) == 1 and len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for k, v in SIGNS.items():
        if k not in single:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def _lookup(key: Column, table: dict[str, float]) -> Column:
    m = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(m, key)


def _number(text: Column) -> Column:
    word = _lookup(text, NUMBER_WORDS)
    return F.when((text.isNull()) | (text == ""), F.lit(1.0)).otherwise(F.coalesce(word, F.expr("1.0D") * F.regexp_replace(text, ",", "").try_cast("double")))


def stated_unit(text: Column) -> Column:
    """struct(family, factor) of the unit expression that ``text`` states, or null.

    ``family`` is number_per_volume, number_per_area, mass_per_volume or
    number_per_mass; ``factor`` turns a value into things (grams) per cubic
    metre, square metre or kilogram.  An expression needs a thing and a
    denominator, so bare volumes, meshes and weights never count.  The first
    expression of a text holds.  Null, empty and unreadable texts give null.
    """
    norm = normal_unit_text(text)
    # One match, taken apart once: groups joined by a control character.
    sep = "\\u0001"
    hit = F.regexp_extract(norm, UNIT, 0)
    inv = F.regexp_extract(norm, UNIT_INVERSE, 0)
    flat = F.when(hit != "", F.concat(F.regexp_replace(hit, UNIT, "$1\x01$2\x01$3\x01$4\x01$5"), F.lit("\x01"))).when(inv != "", F.regexp_replace(inv, UNIT_INVERSE, "$1\x01$2\x01$3\x01$4\x01$5\x01$6"))
    parts = F.split(flat, sep, -1)
    return F.transform(F.array(parts), _unit_of)[0]


def _unit_of(parts: Column) -> Column:
    clean = lambda i: F.trim(F.regexp_replace(parts[i], r"\s+", " "))
    power, scale, thing, amount, den, exponent = (clean(i) for i in range(6))
    den = F.when(exponent.isin("2", "3"), F.concat(den, exponent)).otherwise(den)
    tens = F.regexp_extract(power, r"\^\s*(\d+)$", 1)
    factor_power = F.when(power == "", F.lit(1.0)).when(tens != "", F.pow(F.lit(10.0), F.regexp_extract(power, r"\^\s*(\d+)$", 1).try_cast("double"))).otherwise(F.regexp_replace(power, ",", "").try_cast("double"))
    factor_scale = F.when(scale == "", F.lit(1.0)).otherwise(_lookup(scale, SCALES))
    mass = _lookup(thing, WEIGHED)
    vol, area, kg = _lookup(den, VOLUMES), _lookup(den, AREAS), _lookup(den, MASSES)
    family = (
        F.when(mass.isNotNull() & vol.isNotNull(), F.lit("mass_per_volume"))
        .when(mass.isNull() & vol.isNotNull(), F.lit("number_per_volume"))
        .when(mass.isNull() & area.isNotNull(), F.lit("number_per_area"))
        .when(mass.isNull() & kg.isNotNull(), F.lit("number_per_mass"))
    )
    factor = factor_power * factor_scale * F.coalesce(mass, F.lit(1.0)) / (_number(amount) * F.coalesce(vol, area, kg))
    return F.when(parts.isNotNull() & family.isNotNull() & (factor > 0), F.struct(family.alias("family"), factor.alias("factor")))


def to_common_units(
    observations: DataFrame,
    notes: DataFrame,
    quantities: DataFrame,
    *,
    source: str = "survey_code",
    max_quantities: int = 1000,
) -> DataFrame:
    """Every reading with its value in the common unit of its quantity.

    Adds unit_from ('remarks', 'unit', 'note' or null), quantity, common_unit
    and common_value.  A unit stated in ``remarks`` holds before ``unit``, and
    ``unit`` before the source's note, which serves only rows whose ``unit`` is
    null.  Rows without a known unit keep null quantity and value.  ``notes``
    must have one row per source (others are reduced to the lowest note).
    Columns of the input that are named like the added ones are replaced.
    """
    common = bounded_rows(quantities.select("quantity", "common_unit"), max_quantities, "quantities")
    spark = observations.sparkSession
    # The few common units are read by the same parser.
    if common:
        base = {r["quantity"]: (r["common_unit"], r["u"]["factor"]) for r in spark.createDataFrame([(r[0], r[1]) for r in common], "quantity string, common_unit string").select("quantity", "common_unit", stated_unit(F.col("common_unit")).alias("u")).collect() if r["u"]}
    else:
        base = {}
    per_source = (
        notes.where(F.col(source).isNotNull() & F.col("protocol_note").isNotNull())
        .groupBy(F.col(source).alias("_source"))
        .agg(F.min("protocol_note").alias("_note"))
        .select("_source", stated_unit(F.col("_note")).alias("_nu"))
        .where("_nu is not null")
    )
    # the row travels as one struct, so its column names cannot clash with ours
    taken = {"unit_from", "quantity", "common_unit", "common_value"}
    packed = observations.select(F.struct("*").alias("_row"), F.col(source).alias("_own"), "remarks", "unit", "measurement")
    own = packed.withColumn("_ru", F.when(F.col("remarks").isNotNull(), stated_unit(F.col("remarks")))).withColumn("_uu", stated_unit(F.col("unit")))
    out = own.join(per_source, F.col("_own") == F.col("_source"), "left")
    unit = F.coalesce(F.col("_ru"), F.col("_uu"), F.when(F.col("unit").isNull(), F.col("_nu")))
    kind = F.when(F.col("_ru").isNotNull(), "remarks").when(F.col("_uu").isNotNull(), "unit").when(F.col("unit").isNull() & F.col("_nu").isNotNull(), "note")
    out = out.withColumn("_u", unit).withColumn("unit_from", kind)
    table = F.create_map(*(x for q, (u, f) in base.items() for x in (F.lit(q), F.struct(F.lit(u).alias("unit"), F.lit(f).alias("factor"))))) if base else None
    goal = F.try_element_at(table, F.col("_u.family")) if table is not None else F.lit(None).cast("struct<unit:string,factor:double>")
    out = out.withColumn("_g", goal)
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in observations.columns if c not in taken],
        F.when(F.col("_g").isNotNull(), F.col("unit_from")).alias("unit_from"),
        F.when(F.col("_g").isNotNull(), F.col("_u.family")).alias("quantity"),
        F.col("_g.unit").alias("common_unit"),
        (F.col("measurement") * F.col("_u.factor") / F.col("_g.factor")).alias("common_value"),
    )


# -- changepoints ---------------------------------------------------------------------------------


def optimal_cuts(n: np.ndarray, total: np.ndarray, squares: np.ndarray, penalty: float, min_size: int = 1) -> list[int]:
    """Ends of the optimal segments of a series of pieces (rows, sum, sum of squares of each), for squared
    error plus ``penalty`` per segment; a segment has at least ``min_size`` rows. Exact: candidates are pruned
    only when no later end can make them best."""
    k = len(n)
    if not k:
        return []
    c, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, total, squares))
    best, last = np.full(k + 1, np.inf), np.zeros(k + 1, np.int64)
    best[0] = -penalty
    starts = np.array([0])
    for t in range(1, k + 1):
        long = c[t] - c[starts] >= min_size
        ok = starts[long]
        if len(ok):
            cost = q[t] - q[ok] - (s[t] - s[ok]) ** 2 / (c[t] - c[ok])
            total_cost = best[ok] + cost + penalty
            i = int(np.argmin(total_cost))
            best[t], last[t] = total_cost[i], ok[i]
            if np.isfinite(best[t]):
                ok = ok[best[ok] + cost <= best[t]]
        starts = np.concatenate([ok, starts[~long], [t]]) if np.isfinite(best[t]) else np.concatenate([ok, starts[~long]])
    if not np.isfinite(best[k]):
        return [k]
    ends, t = [], k
    while t > 0:
        ends.append(t)
        t = int(last[t])
    return ends[::-1]


def pelt(x: np.ndarray, penalty: float, min_size: int = 2) -> list[int]:
    """Ends of the optimal segments of single values."""
    return optimal_cuts(np.ones(len(x)), x, x * x, penalty, min_size)


PIECE_DDL = "source string, start long, stop long, n double, total double, squares double, first_key long, last_key long, scale double"
SHIFT_DDL = "source string, segment int, start long, stop long, first_key long, last_key long, n long, level double, shift double, tolerance double, factor double, offset double"


def _ranked(history: DataFrame, source: str, order: list[str], key: str, value: str) -> DataFrame:
    """(source, _k, _x, _rank): log values with their place in the source's history.

    Places come from a range sort, counts per partition and offsets: no task holds a source.
    """
    rows = history.where((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) < float("inf"))).select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.struct(*[F.col(c) for c in order], F.col(key)).alias("_o"), F.col(key).cast("long").alias("_k"), F.ln(value).alias("_x")
    )
    # written once, since counts and places must see the same partitions
    ranged = spill_table(rows.repartitionByRange("source", "_o").withColumn("_p", F.spark_partition_id()), "history")
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p", "source").orderBy("_o")))
    counts = ranged.groupBy("_p", "source").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_p").alias("_bp"), F.col("source").alias("_bs"), "_before")
    placed = local.join(before, (F.col("_p") == F.col("_bp")) & (F.col("source") == F.col("_bs")))
    return spill_table(placed.select("source", "_k", "_x", (F.col("_i") + F.col("_before") - 1).alias("_rank")), "places")


def unit_shifts(
    history: DataFrame,
    source: str,
    order: list[str],
    key: str,
    value: str,
    *,
    penalty: float = 20.0,
    errors: float = 4.0,
    widest: float = 0.35,
    block_rows: int = 4096,
    min_size: int = 5,
) -> DataFrame:
    """Segments of each source's history, with the level shift into each and the unit factor that it matches.

    Blocks of ``block_rows`` consecutive rows are segmented exactly, once from the
    start and once half a block on, all with one noise scale a source; the places
    found and the block edges are the candidates among which the whole history is
    then segmented, again exactly, so an edge where nothing changes is no cut.
    What a task holds of a source are its pieces between candidates, about one for
    2,000 rows.  A shift matches a known factor if it is within ``errors`` standard
    errors of the two levels' difference, and within ``widest`` in any case (known
    factors are further apart than twice that).  Values that are null, NaN or not
    positive have no log and are left out; null sources form one history.

    Output: source, segment, start and stop (places in the history), first_key,
    last_key, n, level (mean log), shift (null for the first), tolerance, factor
    (null when no known factor matches), offset (sum of the matched shifts so far).
    """
    return _shifts(_ranked(history, source, order, key, value), penalty, errors, widest, block_rows, min_size)


def _shifts(ranked: DataFrame, penalty: float, errors: float, widest: float, block_rows: int, min_size: int) -> DataFrame:
    half = block_rows // 2
    block = F.floor(F.col("_rank") / block_rows)
    # noise: median absolute step between neighbours of a block
    steps = ranked.withColumn("_d", F.abs(F.col("_x") - F.lag("_x").over(Window.partitionBy("source", block).orderBy("_rank"))))
    scales = steps.groupBy("source").agg((F.percentile_approx("_d", 0.5, 1000) * (1.4826 / math.sqrt(2))).alias("scale"), F.count(F.lit(1)).alias("_total")).select(F.col("source").alias("_ss"), "_total", F.when(F.col("scale") > 1e-9, F.col("scale")).otherwise(1.0).alias("scale"))
    scaled = ranked.join(scales, F.col("source") == F.col("_ss")).drop("_ss")

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank", kind="stable")
        x, rank = pdf["_x"].to_numpy() / pdf["scale"].iloc[0], pdf["_rank"].to_numpy()
        ends = pelt(x, penalty, min_size)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "at": rank[[0, *ends[:-1]]] if ends else rank[:0]})

    found = None
    for shift in (0, half):
        # a history of one block has no edge to look beyond
        own = scaled.where(F.col("_total") > block_rows) if shift else scaled
        one = own.withColumn("_b", F.floor((F.col("_rank") + shift) / block_rows)).groupBy("source", "_b").applyInPandas(cuts, "source string, at long")
        found = one if found is None else found.unionByName(one)
    # edges of half blocks are candidates too, so that a piece lies in one half block
    candidates = spill_table(found.withColumn("_h", F.floor(F.col("at") / half)).groupBy("source", "_h").agg(F.sort_array(F.collect_set("at")).alias("_c")), "cuts").select(F.col("source").alias("_cs"), F.col("_h").alias("_ch"), "_c")
    inside = scaled.withColumn("_h", F.floor(F.col("_rank") / half)).join(candidates, (F.col("source") == F.col("_cs")) & (F.col("_h") == F.col("_ch")), "left")
    piece = F.coalesce(F.array_max(F.filter("_c", lambda c: c <= F.col("_rank"))), F.col("_h") * half)
    pieces = (
        inside.withColumn("_at", piece).groupBy("source", "_at")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_x").alias("total"), F.sum(F.col("_x") * F.col("_x")).alias("squares"), F.min_by("_k", "_rank").alias("first_key"), F.max_by("_k", "_rank").alias("last_key"), F.max("_rank").alias("stop"), F.first("scale").alias("scale"))
        .select("source", F.col("_at").alias("start"), "stop", "n", "total", "squares", "first_key", "last_key", "scale")
    )
    logs = np.log(KNOWN_FACTORS)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        scale = float(pdf["scale"].iloc[0])
        n, total, squares = (pdf[c].to_numpy(float) for c in ("n", "total", "squares"))
        mean = total.sum() / n.sum()  # sums about the mean keep their digits
        t, q = (total - n * mean) / scale, (squares - 2 * mean * total + n * mean * mean) / scale**2
        out, begin, level, rows, offset = [], 0, None, 0, 0.0
        for k, end in enumerate(optimal_cuts(n, t, q, penalty, min_size)):
            m, now = float(n[begin:end].sum()), float(total[begin:end].sum() / n[begin:end].sum())
            shift = tolerance = factor = None
            if level is not None:
                shift, tolerance = now - level, min(widest, errors * scale * math.sqrt(1 / m + 1 / rows))
                i = int(np.argmin(np.abs(abs(shift) - logs)))
                if abs(abs(shift) - logs[i]) <= tolerance:
                    factor = KNOWN_FACTORS[i] if shift > 0 else 1 / KNOWN_FACTORS[i]
                    offset += math.log(factor)
            out.append((pdf["source"].iloc[0], k, int(pdf["start"].iloc[begin]), int(pdf["stop"].iloc[end - 1]), int(pdf["first_key"].iloc[begin]), int(pdf["last_key"].iloc[end - 1]), int(m), now, shift, tolerance, factor, offset))
            begin, level, rows = end, now, m
        return pd.DataFrame(out, columns=[c.split()[0] for c in SHIFT_DDL.split(", ")]).astype({"shift": float, "tolerance": float, "factor": float})

    got = pieces.groupBy("source").applyInPandas(whole, SHIFT_DDL)
    return got.select(F.when(F.col("source") != "", F.col("source")).alias("source"), *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("shift", "tolerance", "factor") else F.col(c) for c in got.columns[1:]])


def reversed_values(history: DataFrame, source: str, order: list[str], key: str, value: str, *, block_rows: int = 4096, **options) -> DataFrame:
    """(source, key, value, factor, reversed_value) of every positive reading: ``factor`` is the product of the matched shifts
    between the reading and the source's main unit (that of most of its rows), by which the value is divided."""
    settings = {"penalty": 20.0, "errors": 4.0, "widest": 0.35, "min_size": 5} | options
    ranked = _ranked(history, source, order, key, value)
    found = spill_table(_shifts(ranked, settings["penalty"], settings["errors"], settings["widest"], block_rows, settings["min_size"]), "shifts").withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_f", F.round("offset", 9))
    held = found.groupBy("_s", "_f").agg(F.sum("n").alias("_n"))
    main = held.groupBy("_s").agg(F.max_by("_f", F.struct("_n", -F.abs("_f"), "_f")).alias("_main"))
    spans = found.join(main, "_s").select(F.col("_s"), "start", "stop", F.exp(F.col("_f") - F.col("_main")).alias("factor"), F.explode(F.sequence(F.floor(F.col("start") / block_rows), F.floor(F.col("stop") / block_rows))).alias("_b"))
    rows = ranked.withColumn("_b", F.floor(F.col("_rank") / block_rows))
    both = rows.join(spans, (rows["source"] == spans["_s"]) & (rows["_b"] == spans["_b"]) & F.col("_rank").between(F.col("start"), F.col("stop")))
    return both.select(F.when(F.col("_s") != "", F.col("_s")).alias(source), F.col("_k").alias(key), F.exp("_x").alias(value), "factor", F.exp(F.col("_x") - F.ln("factor")).alias("reversed_value"))
