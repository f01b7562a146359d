"""Text normalisers as native column expressions; words and boundaries are Unicode throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = "co company corp corporation group holding holdings inc limited llc ltd plc the".split()
MONTHS = "january february march april may june july august september october november december".split()
BRANDS = (
    r"benzinga|gurufocus|insider\s*monkey|investorplace|kiplinger|marketbeat|motley\s*fool|seeking\s*alpha|simply\s*wall"
    r"|smarteranalyst|stock\s*options\s*channel|tipranks|validea|yieldboost|zacks"
)
#: No letter, digit or underscore before, and after.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
SHORT_MONTH = "(?:" + "|".join(sorted(m[:3].title() for m in MONTHS)) + ")[A-Za-z]*"
#: Day, month and year in digits, either way round.
DIGIT_DATE = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}(?:-[0-9]{2}){2}"
#: A month's name, a day, perhaps a comma, and a year.
NAMED_DATE = SHORT_MONTH + r"\.?\s+[0-9]{1,2},?\s+[0-9]{2,4}"
FULL_YEAR = "(?:20|19)[0-9]{2}"


def squeeze(s: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " "))


def norm_entity(s: Column, aliases: dict[str, str] | None = None) -> Column:
    """Squeezed; if the lower-cased form is in ``aliases``, its value."""
    clean = squeeze(s)
    if not aliases:
        return clean
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(clean)), clean)


def key_norm(s: Column) -> Column:
    """Lower case, without ``. , ' " &`` and corporate words; a name made of such words only stays as it is."""
    low = F.regexp_replace(F.lower(F.trim(s)), "[.,'\"&]", "")
    bare = squeeze(F.regexp_replace(low, _BEFORE + "(" + "|".join(sorted(SUFFIXES, key=len, reverse=True)) + ")" + _AFTER, " "))
    return F.when(bare == "", low).otherwise(bare)


def first_word(s: Column) -> Column:
    return F.element_at(F.split(s, " "), 1)


def slot_norm(s: Column) -> Column:
    """Skeleton of a templated text: @T for short upper-case words, @M for months, @N for numbers and ordinals, in this
    order, then punctuation to spaces, lower case, squeezed."""
    s = F.regexp_replace(s, _BEFORE + "[A-Z]{1,5}" + _AFTER, "@T")
    s = F.regexp_replace(s, "(?i)" + _BEFORE + "(?:" + "|".join(MONTHS) + ")" + _AFTER, "@M")
    s = F.regexp_replace(s, r"\p{Nd}+(?:[.,]\p{Nd}+)*(?:th|st|nd|rd)?", "@N")
    return squeeze(F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}_@ ]+", " ")))


def lede(s: Column, n: int = 120) -> Column:
    return F.substring(s, 1, n)


def word_count(s: Column) -> Column:
    """Words between white space; 0 for an empty text and for null."""
    return F.coalesce(F.regexp_count(s, F.lit(r"[^\s]+")), F.lit(0))


def is_brand(s: Column) -> Column:
    """Names of templated media brands."""
    return F.coalesce(s.rlike("(?i)" + _BEFORE + f"({BRANDS})" + _AFTER), F.lit(False))


def is_numeric(s: Column) -> Column:
    """A bare number, amount or percentage."""
    return s.rlike(r"^[$€£¥\s]*(?:\+|-)?[0-9][0-9,.]*\s*(?:%\s*)?$")


def quoted(s: Column) -> Column:
    """A value to stand for itself inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def mask_dates(s: Column) -> Column:
    """Dates to [DATE], then years to [YEAR]."""
    dated = F.regexp_replace(F.coalesce(s, F.lit("")), rf"\b(?:{DIGIT_DATE}|{NAMED_DATE})\b", "[DATE]")
    return F.regexp_replace(dated, rf"\b{FULL_YEAR}\b", "[YEAR]")


def mask_article(body: Column, tag: Column | None = None, names: Column | None = None) -> Column:
    """Dates, years, the tag as a word, and names (array; longer than two characters, any case) masked."""
    out = mask_dates(body)
    if tag is not None:
        word = F.regexp_replace(out, F.concat(F.lit(_BEFORE), quoted(tag), F.lit(_AFTER)), F.lit("[ENT]"))
        out = F.when(F.coalesce(tag, F.lit("")) != "", word).otherwise(out)
    if names is not None:
        long_names = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.length(n) > 2)
        out = F.aggregate(
            long_names,
            out,
            lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?iu)" + _BEFORE), quoted(n), F.lit(_AFTER)), F.lit("[ENT]")),
        )
    return out


def mask_entities(body: Column, entities: Column, slots: int = 60) -> Column:
    """Distinct entities, longest first, to [ENT0], [ENT1], ... and dates to [DATE]."""
    own = F.array_distinct(F.filter(entities, lambda n: F.length(n) > 2))
    order = F.array_sort(F.transform(own, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    pairs = F.transform(order, lambda x, i: F.struct(x["n"].alias("n"), F.pmod(i, F.lit(slots)).alias("k")))
    step = lambda t, p: F.regexp_replace(
        t, F.concat(F.lit("(?iu)"), quoted(p["n"])), F.concat(F.lit("[ENT"), p["k"].cast("string"), F.lit("]"))
    )
    masked = F.aggregate(pairs, F.coalesce(body, F.lit("")), step)
    digits = "[0-9]{1,2}(?:[-/][0-9]{1,2})[-/][0-9]{2,4}"
    date = rf"(?i)\b(?:{SHORT_MONTH}\.?\s+[0-9]{{1,2}}|{digits}|{FULL_YEAR})\b"
    return F.regexp_replace(masked, date, "[DATE]")


def prompt(template: str, body: Column, most: int = 6000, slot: str = "<text>") -> Column:
    """The template with its slot filled by the first ``most`` characters of the body."""
    return F.replace(F.lit(template), F.lit(slot), F.substring(F.coalesce(body, F.lit("")), 1, most))


def label_of(answer: Column, labels: tuple[str, ...], default: str = "PARSE_FAIL") -> Column:
    """A JSON answer's label, else the first label that stands in it as a word, else the default."""
    either = "|".join(labels)
    strict = F.upper(F.regexp_extract(answer, rf'(?i)"label"\s*:\s*"({either})"', 1))
    loose = F.upper(F.regexp_extract(answer, rf"(?i)\b({either})\b", 1))
    return F.coalesce(F.nullif(strict, F.lit("")), F.nullif(loose, F.lit("")), F.lit(default))


def clipped_names(names: Column, n: int = 5, width: int = 28) -> Column:
    """The first n names, each cut to ``width`` characters, joined by bars."""
    return F.array_join(F.transform(F.slice(names, 1, n), lambda x: F.substring(x, 1, width)), " | ")


def duration(seconds: Column) -> Column:
    """XhYYm."""
    minutes = F.floor(seconds / 60).cast("long")
    return F.format_string("%dh%02dm", F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)).cast("long"))


def bucket_label(value: Column, edges: list[int]) -> Column:
    """``<a``, ``a-b``, ``>=z`` by the first edge above the value."""
    steps = [F.when(value < edges[0], f"<{edges[0]}")]
    out = reduce(lambda c, ab: c.when(value < ab[1], f"{ab[0]}-{ab[1]}"), zip(edges, edges[1:]), steps[0])
    return out.otherwise(f">={edges[-1]}")
