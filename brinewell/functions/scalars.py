"""Column functions with defined results for nulls, infinities and ties; all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")

# Date formats, tried in order; slashes are month first.
DATE_FORMATS = ("M/d/yyyy h:mm:ss a", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy")


def _shape(fmt: str) -> str:
    """Pattern of the texts that a format can read: cheap to test, where a failed parse is not."""
    import re

    def part(m: "re.Match[str]") -> str:
        run = m.group(0)
        if run[0] == "a":
            return "[AaPp][Mm]"
        return r"\d{1,2}" if len(run) == 1 else rf"\d{{{len(run)}}}"

    return "^" + re.sub(r"([A-Za-z])\1*|[^A-Za-z]", lambda m: part(m) if m.group(1) else re.escape(m.group(0)), fmt) + "$"


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Timestamp by the first format that fits; null where none does."""
    return F.coalesce(*[F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats])


def safe_ln(c: Column) -> Column:
    """Natural log with -inf at 0 and NaN below; null stays null."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(-INF)).when(c.isNotNull(), F.lit(NAN))


def indicator(condition: Column) -> Column:
    """1 where the condition is true, else 0 (also where it is null)."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def cap(c: Column, most: float) -> Column:
    """Values over ``most`` become ``most``; null stays null (``least`` would not keep it)."""
    return F.when(c > most, F.lit(float(most))).otherwise(c)


def inside(c: Column, low: Column, high: Column) -> Column:
    """Strictly between, on both sides."""
    return (c > low) & (c < high)


def scaled_ceil(c: Column, scale: int) -> Column:
    """Smallest multiple of 1/scale at or above; infinities and NaN are kept."""
    finite = ~F.isnan(c) & (F.abs(c) < INF)
    return F.when(finite, F.ceil(c * scale) / F.lit(float(scale))).otherwise(c)


def round_even(c: Column, places: int = 2) -> Column:
    return F.bround(c, places)


def trim_all(c: Column) -> Column:
    """Every kind of white space off both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def edges(low: int, high: int, step: int) -> Column:
    """Bin edges low, low+step, ... reaching past ``high``; the step must be positive."""
    if step < 1:
        raise ValueError("the span is too small for a positive integer step")
    return F.sequence(F.lit(low), F.lit(high + step), F.lit(step))


def bin_index(v: Column, low: Column, high: Column, step: Column) -> Column:
    """Bins (a, b], 0-based, the lowest edge included; null outside ``low..high``."""
    return F.when(v == low, F.lit(0)).when((v > low) & (v <= high), (F.ceil((v - low) / step) - 1).cast("int"))


def midpoint_year(low: Column, high: Column) -> Column:
    return (low + (high - low) / 2).cast("int")


def split_tokens(text: Column) -> Column:
    """Tokens between hyphens, line breaks, commas, white space and plus signs; empty ones are kept."""
    return F.split(text, r"[-\n,\s+]", -1)


def clean_keywords(text: Column) -> Column:
    return F.regexp_replace(text, r"[-,\s]+", " ")


def strip_list_marks(text: Column) -> Column:
    """Numbered marks off the start of every line; blank lines stay, ``- item`` is untouched."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda s: F.regexp_replace(s, r"^\s*[-\p{Nd}#]+\.\s*", "")), "\n")


def non_empty_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda s: s != "")


def expected_count(text: Column, per: int = 20) -> Column:
    """One question for every ``per`` characters; none below."""
    return F.floor(F.length(text) / per).cast("int")


def is_yes(answer: Column) -> Column:
    return F.coalesce(trim_all(answer).isin("yes", "예"), F.lit(False))


def render(template: str, **slots: Column) -> Column:
    """The template with {name} replaced by columns; null slots become empty."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def stable_id(*parts: Column) -> Column:
    """A repeatable identifier of its parts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
