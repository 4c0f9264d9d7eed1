"""Column-returning scalar functions of the intake; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SIDES

# Qualifiers that a header may end with, in the order in which they are tried.
NOISE = ("usd", "eur", "gbp", "jpy", "chf", "hkd", "local", "base", "reporting", "inbase", "inlocal", "amt", "value1", "col")
# Spellings of no number, and first cells of totals rows.
NO_NUMBER = ("", "-", "--", "n/a", "N/A", "NULL", "null")
#: What goes from numbers: separators, currency signs, per cent, and white space.
SEPARATORS = ",$€£¥% \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOTALS = ("total", "totals", "grandtotal", "subtotal", "sum", "count", "endofreport", "eof", "end")
# Date patterns in the order in which they are tried, day before month.
DATE_PATTERNS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-MMM-yyyy", "dMMMyyyy", "yyyyMMdd", "d.M.yyyy")
DATE_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^\d{1,2}[A-Za-z]{3}\d{4}$", r"^\d{8}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$",
)
YEARS = (1990, 2100)


def normalize_header(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def strip_noise(c: Column) -> Column:
    """A normalised header without trailing qualifiers; each is tried once, and two letters must remain before it."""

    def cut(text: Column, word: Column) -> Column:
        rest = F.length(text) - F.length(word)
        return F.when(F.endswith(text, word) & (rest > 2), F.left(text, rest)).otherwise(text)

    # a fold, since nested conditions would double the expression with each word
    return F.aggregate(F.array(*map(F.lit, NOISE)), c, cut)


def bare_number(c: Column) -> Column:
    """A cell as struct(digits, minus): its text without parentheses, separators and currency signs, and whether it had parentheses; digits are null for no number."""
    text = F.trim(c)
    parens = text.startswith("(") & text.endswith(")")
    inside = F.when(parens, text.substr(F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.struct(F.when(~text.isin(*NO_NUMBER), F.translate(inside, SEPARATORS, "")).alias("digits"), parens.alias("minus"))


def signed_number(bare: Column, scale: int = 8) -> Column:
    """The number of a ``bare_number``; a trailing minus negates."""
    digits, trailing = bare["digits"], bare["digits"].endswith("-")
    number = F.when(trailing, F.left(digits, F.length(digits) - 1)).otherwise(digits).try_cast(f"decimal(28,{scale})")
    return F.when(bare["minus"] | trailing, -number).otherwise(number)


def looks_numeric(c: Column) -> Column:
    """Whether a cell is a number as it stands: separators, dollar and per cent signs and one pair of parentheses don't count."""
    text = F.regexp_replace(F.trim(c), "[,$%]", "")
    inside = F.regexp_replace(text, r"^\((.*)\)$", "$1")
    return F.coalesce(inside.rlike(r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?|inf(?:inity)?|nan)\s*$"), F.lit(False))


def to_decimal(c: Column, scale: int = 8) -> Column:
    """Number of a cell: parentheses or a trailing minus negate; separators and currency signs go; else null."""
    return signed_number(bare_number(c), scale)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it; within lambdas nothing else sees to that."""
    return F.get(F.transform(F.array(value), f), 0)


def day_text(c: Column) -> Column:
    """A cell up to the first ``T`` or space, with month names as the formatter wants them."""
    day = F.trim(F.regexp_substr(F.trim(c), F.lit("^[^T ]*")))
    day = F.when(day.rlike("[A-Za-z]"), F.initcap(F.regexp_replace(day, r"([A-Za-z]+)", " $1 "))).otherwise(day)
    return F.regexp_replace(day, " ", "")


def parse_date(c: Column) -> Column:
    """Date of a cell in the first pattern that fits; what follows the first ``T`` or space is cut; null outside 1990 to 2100."""
    day = day_text(c)
    out = []
    for pattern, shape in zip(DATE_PATTERNS, DATE_SHAPES, strict=True):
        parsed = F.when(day.rlike(shape), F.try_to_date(day, pattern))
        out.append(F.when(F.year(parsed).between(*YEARS), parsed))
    return F.coalesce(*out)


def parse_date_within(c: Column) -> Column:
    """``parse_date`` for use within lambdas."""

    def read(day: Column, pattern: str, shape: str) -> Column:
        return F.when(day.rlike(shape), let(F.try_to_date(day, pattern), lambda d: F.when(F.year(d).between(*YEARS), d)))

    return let(day_text(c), lambda day: F.coalesce(*(read(day, *x) for x in zip(DATE_PATTERNS, DATE_SHAPES, strict=True))))


# The shapes of dates in file names.
FILENAME_DATES = r"\d{4}-\d{2}-\d{2}|(?<!\d)\d{8}(?!\d)|\d{2}[A-Za-z]{3}\d{4}"


def filename_date(name: Column) -> Column:
    """Date of the leftmost ``2026-08-31``, ``20260831`` or ``31AUG2026`` in a name."""
    return parse_date(F.regexp_substr(name, F.lit(FILENAME_DATES)))


def normalise_side(c: Column) -> Column:
    """BUY, SELL, LONG or SHORT for the known spellings, else the trimmed upper-case text; null if blank."""
    known = F.create_map(*(F.lit(x) for pair in SIDES.items() for x in pair))
    text = F.trim(c)
    return F.when(text == "", None).otherwise(F.coalesce(F.try_element_at(known, F.lower(text)), F.upper(text)))


def mask_account(c: Column) -> Column:
    """All but the last four characters as stars; four or fewer are all stars."""
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(4))))


def slot_key(*parts: Column) -> Column:
    """The parts joined by colons, nulls as empty."""
    return F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def sanitize_name(c: Column) -> Column:
    """A safe file name: other characters and any ``..`` become underscores."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), r"\.\.", "_")


def queue_name(source: Column, message_id: Column, topic: Column, part: Column, offset: Column) -> Column:
    """``source_message.json``, or where the message came from if it names neither."""
    named = F.when((F.coalesce(source, F.lit("")) != "") & (F.coalesce(message_id, F.lit("")) != ""), F.concat_ws("_", source, message_id))
    place = F.concat(topic, F.lit("_p"), part.cast("string"), F.lit("_o"), offset.cast("string"))
    return F.concat(sanitize_name(F.coalesce(named, place)), F.lit(".json"))


def escapes_root(path: Column) -> Column:
    """Whether a path has a ``..`` segment."""
    return path.rlike(r"(^|/)\.\.(/|$)")


def rfc3339(ts: Column) -> Column:
    """UTC timestamp text with the shortest fraction of a second."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def record_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each followed by a unit separator."""
    mark = F.lit("\x1f")
    return F.sha2(F.concat(*(x for f in fields for x in (F.coalesce(f.cast("string"), F.lit("")), mark))), 256)


def readable(c: Column) -> Column:
    """camelCase and snake_case words apart."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-./]+", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def structural_confidence(strength: Column) -> Column:
    return F.round(F.least(0.55 + 0.35 * strength, F.lit(0.90)), 3)


def clamp_confidence(c: Column) -> Column:
    """A model's stated confidence within 0 and 0.85; 0.7 if it is no number."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.7)), F.lit(0.0)), F.lit(0.85))


def enum_name(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, f"^{prefix}_", "")


def template_fingerprint(client: Column, headers: Column) -> Column:
    """Sixteen hex digits that stand for a client's layout (SHA-256, cut; header order matters)."""
    text = F.concat_ws("|", F.coalesce(client, F.lit("")), F.transform(headers, normalize_header))
    return F.concat(F.lit("tf_"), F.left(F.sha2(text, 256), F.lit(16)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
