"""Sentence boundaries across languages and scripts, in SQL expressions only.

A working copy of the text, equal in length, has every end mark that ends
nothing (decimals, abbreviations, initials, URLs, list marks, ordinals, marks
inside quotations) replaced by private-use characters.  Script-specific
zero-width patterns split that copy; the lengths of the parts give the places of
the units in the text itself, which is thereby restored untouched.

Defined results: null and blank texts have no units; an empty line ends a unit,
a single line break counts as a space; a closing quotation belongs to its unit;
repeated rows have the same units; positions count Unicode code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use characters of the working copy.
DOT, QUOTED, BREAK, OTHER = "\ue000", "\ue001", "\ue002", "\ue003"
SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Abbreviations. Always followed by more of the sentence:
TITLES = (
    "Dr", "Dra", "Drs", "Mr", "Mrs", "Ms", "Prof", "Profa", "St", "Ste", "Sr", "Sra", "Srta", "Hr", "Fr", "Lic", "Ing", "Gen", "Col", "Capt", "Lt", "Rev", "Hon", "Mt", "Ft",
    "डॉ", "श्री", "सं", "क्र", "ดร", "cf", "Cf", "vgl", "Vgl", "vs", "approx", "Approx", "ca", "Ca", "e\\.g", "i\\.e", "E\\.g", "I\\.e", "viz", "z", "z\\. ?B", "d", "d\\. ?h", "u\\. ?a", "bzw", "bspw", "inkl", "zzgl", "sog", "incl", "Lab", "p\\. ?ej", "Véase", "Ud", "Uds",
)
#: Abbreviations before a number or a letter code.
BEFORE_NUMBER = ("no", "nos", "No", "Nos", "Nr", "nr", "Nrn", "núm", "Núm", "núms", "n", "vol", "Vol", "vols", "pág", "págs", "Pág", "pp", "p", "S", "fig", "figs", "Fig", "Figs", "Abb", "Tab", "Kap", "Abs", "Art", "art", "ch", "Ch", "sec", "Sec", "eq", "Eq", "ed", "op", "ver", "Ver", "No", "para")
#: Abbreviations that may also close a sentence: decided by what follows.
MAY_END = ("a\\.m", "p\\.m", "etc", "usw", "u\\.s\\.w", "Inc", "Ltd", "Co", "Corp", "Jr", "al", "U\\.S", "U\\.K", "B\\.C", "A\\.D", "EE\\. ?UU")
GERMAN_BEFORE_ORDINAL = ("am", "Am", "der", "Der", "die", "Die", "das", "Das", "dem", "Dem", "den", "Den", "des", "Des", "vom", "Vom", "zum", "Zum", "im", "Im", "beim", "Beim", "seit", "Seit", "bis", "Bis", "ab", "Ab", "ein", "eine", "jeder", "jede")


def _after(words) -> str:
    """Look-behind: the dot just read closes one of ``words``."""
    return rf"(?<=(?:^|[^\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(words)})\.)"


# Scripts as plain ranges: far cheaper per character than script properties.
HAN, KANA, HANGUL, THAI, DEVANAGARI = r"㐀-鿿豈-﫿", r"぀-ヿ", r"가-힣ᄀ-ᇿ㄰-㆏", r"฀-๿", r"ऀ-ॿ"

#: A dot that ends nothing, decided at the dot itself; the commonest cases first.
PLAIN_DOT = (
    r"\.(?:(?=[.a-z_/@-])"  # all but the last of an ellipsis; names of files and hosts
    r"|(?<=[0-9]\.)(?=\s?[0-9])"  # decimals, versions, dates such as 2017.5. 643
    rf"|(?<=\.\.)(?!\s*(?:[\p{{Lu}}“„«¿¡{BREAK}]|$))"  # an ellipsis inside a sentence
    r"|(?<=[\p{L}\p{M}]\.)(?:"
    rf"{_after(TITLES)}"
    rf"|{_after(BEFORE_NUMBER)}(?=\s*\p{{N}})"
    rf"|{_after(MAY_END)}(?!\s*(?:[\p{{Lu}}\p{{Lo}}“„«¿¡{BREAK}]|\p{{Ll}}\p{{Lu}}|$))"
    rf"|(?<=(?:^|{BREAK})\s{{0,8}}\p{{L}}\.)(?=\s)"
    r"|(?<=(?:^|[^\p{L}\p{M}\p{N}])\p{Lu}\.)(?=\s?\p{Lu}))"  # initials
    r"|(?<=\p{N}\.)(?:"
    rf"(?<=\b(?:{'|'.join(GERMAN_BEFORE_ORDINAL)})\s\p{{N}}{{1,2}}\.)(?=\s)"
    rf"|(?<=(?:^|{BREAK})[\s(]{{0,8}}\p{{N}}{{1,3}}\.)"  # the mark of a list item
    r"))"
)
MARKS = ".!?。！？।"
_URL = r"(?:https?://|www\.)"

_CLOSE = r"[”’\"»」』）)\]]"
_OTHER = HAN + KANA + HANGUL + THAI + DEVANAGARI
#: No unit ends after any other character.
_GUARD = rf"(?<=[.!?。！？।{BREAK}”’\"»」』）)\]“{THAI}])"
SPLIT = (
    _GUARD
    + "(?:"
    + "|".join(
        [
            # scripts without end marks: a space divides, unless a digit stands next to it
            rf"(?<=[{THAI}])(?=\s+[^\s\p{{N}},;:)\]])",
            # Latin, Hangul and others: a mark, then white space
            rf"(?<=[.!?]{_CLOSE}{{0,2}})(?=\s)",
            # full-width marks and danda end a unit wherever they stand
            rf"(?<=[。！？।]{_CLOSE}{{0,2}})(?![.!?。！？।]|{_CLOSE})",
            rf"(?<={BREAK})",
            # no white space where one is missing
            r"(?<=[\p{Ll}0-9)%”»][.!?]{1,2})(?=[\p{Lu}“«„¿¡][\p{L}\p{M}¿¡“«„\s])",
            rf"(?<=[\p{{L}}0-9)%][.!?]{{1,2}})(?=[{_OTHER}])",
            rf"(?<=[{HANGUL}][.!?]{{1,2}})(?=[0-9\p{{Lu}}'\"“])",
            # a quotation that closes with its own end mark, unless the reporting clause follows
            rf"(?<={QUOTED}[”»“])(?=\s+[^\s\p{{Ll}},;:–—{BREAK}-]|\s+\p{{Ll}}\p{{Lu}})",
            rf"(?<={QUOTED}”)(?=[{HAN}{KANA}])",
            rf"(?<={QUOTED}[」』])(?=\s+[^\s぀-ゟ,、])",
            rf"(?<={QUOTED}\")(?=\s+[\p{{Lu}}“])",
        ]
    )
    + ")"
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, start: str, masked) -> Column:
    """``text`` cut before every match of ``start``; ``masked(piece, next piece)`` tells what becomes of each. Linear in the text."""
    return _let(F.split(text, rf"(?={start})", -1), lambda p: F.array_join(F.transform(p, lambda s, i: masked(s, F.get(p, i + 1))), ""))


def _quoted(text: Column, signs: str, inside) -> Column:
    """Marks masked in pieces between two signs that ``inside(piece, next piece)`` says are a quotation, however long it is."""
    return _pieces(text, f"[{signs}{BREAK}]", lambda s, after: F.when(inside(s, after), F.translate(s, MARKS, QUOTED * len(MARKS))).otherwise(s))


def _first(piece: Column, signs: str) -> Column:
    return F.substring(piece, 1, 1).isin(*signs)


def _url_masked(piece: Column) -> Column:
    """The marks of the URL that a piece begins with, but for one that ends it."""
    url = F.regexp_extract(piece, rf"^{_URL}\S*", 0)
    body = F.length(F.regexp_replace(url, rf"[.!?]{_CLOSE}*$", ""))
    return F.concat(F.translate(F.substring(piece, F.lit(1), body), ".!?", DOT * 3), F.substring(piece, body + 1, F.length(piece)))


def working_copy(text: Column) -> Column:
    """``text`` with masked marks; the same number of code points."""
    t = F.translate(text, SPACES + DOT + QUOTED + BREAK, " " * len(SPACES) + OTHER * 3)
    t = F.regexp_replace(t, r"\n(?= *\n)", BREAK)
    t = F.translate(t, "\n", " ")
    t = _let(t, lambda x: F.when(x.contains("://") | x.contains("www."), _pieces(x, _URL, lambda s, _: F.when(s.rlike(rf"^{_URL}"), _url_masked(s)).otherwise(s))).otherwise(x))
    t = F.regexp_replace(t, PLAIN_DOT, DOT)
    # German quotations: from a low sign to the next high one
    t = _let(t, lambda x: F.when(x.contains("„"), _quoted(x, "“„", lambda s, after: _first(s, "„") & _first(after, "“"))).otherwise(x))
    # quotations whose two signs differ: the next sign is a closing one
    t = _let(t, lambda x: F.when(x.contains("”") | x.contains("»") | x.contains("」") | x.contains("』"), _quoted(x, "“”«»「」『』", lambda s, after: _first(after, "”»」』"))).otherwise(x))
    # straight quotations: the next sign follows a printing character, so it closes
    return _let(t, lambda x: F.when(x.contains('"'), _quoted(x, '"', lambda s, after: _first(s, '"') & _first(after, '"') & ~s.endswith(" ") & (F.length(s) > 1))).otherwise(x))


_BLOCK = 256


def sentence_spans(text: Column) -> tuple[Column, Column]:
    """Two steps: widths of the parts (to be named ``_w``), then array<struct<start_char, end_char>> of the units."""
    edge = " " + BREAK
    parts = F.split(working_copy(text), SPLIT, -1)

    def widths(segs: Column) -> Column:
        return F.transform(segs, lambda s: F.struct(F.length(s).alias("n"), (F.length(s) - F.length(F.ltrim(s, F.lit(edge)))).alias("a"), F.length(F.rtrim(s, F.lit(edge))).alias("b")))

    def place(acc: Column, w: Column) -> Column:
        span = F.struct((acc["at"] + w["a"]).alias("start_char"), (acc["at"] + w["b"]).alias("end_char"))
        return F.struct((acc["at"] + w["n"]).alias("at"), F.when(w["b"] > w["a"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start_char:int,end_char:int>>")
    # appending copies the array so far; blocks keep that small in very long texts
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_w") / _BLOCK).cast("int") - 1), lambda b: F.slice(F.col("_w"), b * _BLOCK + 1, F.lit(_BLOCK)))

    def run(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), empty.alias("out")), place)
        return F.struct(inner["at"].alias("at"), F.array_append(acc["out"], inner["out"]).alias("out"))

    both = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start_char:int,end_char:int>>>").alias("out")),
        run,
    )
    return widths(parts), F.flatten(both["out"])


def sentence_units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, start_char, end_char), one row per unit, in one pass without a shuffle."""
    widths, spans = sentence_spans(F.col("_t"))
    kept = docs.where(F.trim(F.col(text)) != "").select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    return (
        kept.select("_id", widths.alias("_w"))
        .select("_id", F.explode(spans).alias("_s"))
        .select(F.col("_id").alias(doc_id), F.col("_s.start_char").alias("start_char"), F.col("_s.end_char").alias("end_char"))
    )


def sentence_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sentence_no from 0, start_char, end_char, sentence) with the text restored."""
    widths, spans = sentence_spans(F.col("_t"))
    kept = docs.where(F.trim(F.col(text)) != "").select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    return (
        kept.select("_id", "_t", widths.alias("_w"))
        .select("_id", "_t", F.posexplode(spans).alias("sentence_no", "_s"))
        .select(F.col("_id").alias(doc_id), "sentence_no", F.col("_s.start_char").alias("start_char"), F.col("_s.end_char").alias("end_char"), F.substring("_t", F.col("_s.start_char") + 1, F.col("_s.end_char") - F.col("_s.start_char")).alias("sentence"))
    )
