"""Names, identifiers, labels and coordinates in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The texts of the two truth values, in lower case.
TRUE_TEXTS = ("1", "true", "t", "yes", "y", "on")
FALSE_TEXTS = ("0", "false", "f", "no", "n", "off")


def normalize_name(c: Column) -> Column:
    """Letters and digits in lower case, everything else one blank; null for a blank result."""
    return F.nullif(F.trim(F.lower(F.regexp_replace(c, "[^0-9A-Za-z]+", " "))), F.lit(""))


def empty_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def boolish(c: Column) -> Column:
    """Truth values in their usual texts; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*TRUE_TEXTS), True).when(t.isin(*FALSE_TEXTS), False)


def strip_id(c: Column) -> Column:
    """An identifier without punctuation and case, for joins across spellings."""
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-z]+", ""))


def trigrams(c: Column) -> Column:
    """The distinct 3-grams of a text; texts under three characters have none."""
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, 3)))).otherwise(F.array().cast("array<string>"))


def edit_limit(c: Column) -> Column:
    """Edits allowed for a query of this length: 1 up to 5 characters, 2 up to 10, else 3."""
    return F.when(F.length(c) <= 5, 1).when(F.length(c) <= 10, 2).otherwise(3)


def identifier_kind(c: Column) -> Column:
    """Which catalog a query text names: gaia, hip, hd, numeric, or null for a name."""
    t = F.lower(F.trim(c))
    return (
        F.when(t.rlike(r"^[0-9]{10,}$"), "gaia").when(t.rlike(r"^[0-9]+$"), "numeric")
        .when(t.rlike(r"^gaia\s*(?:dr[0-9]+|edr3)?\s*[0-9]+$"), "gaia").when(t.rlike(r"^hip\s*[0-9]+$"), "hip").when(t.rlike(r"^hd\s*[0-9]+$"), "hd")
    )


def identifier_number(c: Column) -> Column:
    """The number an identifier query ends with, as text; '' for a name."""
    return F.when(identifier_kind(c).isNotNull(), F.regexp_extract(F.trim(c), r"([0-9]+)$", 1)).otherwise("")


TIC = r"(?i)^tic[\s._\-]*([0-9]{1,19})$"
TOI = r"(?i)^toi[\s_\-]*([0-9]{1,9})(?:[.\s_\-]+([0-9]{1,2}))?$"


def _tess_parts(c: Column) -> tuple[Column, Column, Column, Column]:
    t = F.trim(c)
    return t, F.regexp_extract(t, TIC, 1).try_cast("bigint"), F.regexp_extract(t, TOI, 1).try_cast("bigint"), F.regexp_extract(t, TOI, 2)


def candidate_designation(c: Column) -> Column:
    """``toi 123.1`` as ``TOI-123.01``, ``toi7`` as ``TOI-7``, ``tic 42`` as ``TIC 42``; null for anything else or a number out of range."""
    t, tic, host, part = _tess_parts(c)
    planet = F.concat(F.lit("TOI-"), host.cast("string"), F.when(part != "", F.concat(F.lit("."), F.lpad(part, 2, "0"))).otherwise(""))
    return F.when(tic > 0, F.concat(F.lit("TIC "), tic.cast("string"))).when((host > 0) & ~part.isin("0", "00"), planet)


def candidate_reason(c: Column) -> Column:
    """Why a text that begins like a TIC or TOI is none: malformed_identifier or identifier_out_of_range; null for valid ones and other texts."""
    t, tic, host, part = _tess_parts(c)
    begins = t.rlike(r"(?i)^(?:tic|toi)(?=$|[\s._\-]|[0-9])")
    formed = t.rlike(TIC) | t.rlike(TOI)
    return F.when(begins & ~formed, "malformed_identifier").when(begins & candidate_designation(c).isNull(), "identifier_out_of_range")


def deep_sky_designation(c: Column) -> Column:
    """``NGC 0123a`` as ``ngc 123a``: catalog prefix, number without leading zeros, suffix."""
    t = F.lower(F.trim(c))
    p = r"^(ngc|ic|messier|m|caldwell|c)\s*0*([0-9]+)\s*([a-z]?)$"
    prefix = F.regexp_extract(t, p, 1)
    short = F.when(prefix == "messier", "m").when(prefix == "caldwell", "c").otherwise(prefix)
    return F.when(t.rlike(p), F.concat(short, F.lit(" "), F.regexp_extract(t, p, 2), F.regexp_extract(t, p, 3)))


def ordinal_label(n: Column) -> Column:
    """0-based ordinals as letters: a..z, then aa..zz, then aaa.. up to four letters; null beyond (475,254)."""
    out, start = F.lit(None).cast("string"), 0
    steps = []
    for letters in range(1, 5):
        parts = [F.char(F.lit(97) + F.floor((n - start) / 26**i) % 26) for i in reversed(range(letters))]
        steps.append((start + 26**letters, F.concat(*parts)))
        start += 26**letters
    for end, label in reversed(steps):
        out = F.when(n < end, label).otherwise(out)
    return F.when(n >= 0, out)


def label_stem(c: Column) -> Column:
    """A component label without its last letter of lower case: ``Aab`` gives ``Aa``; null if it has none."""
    t = F.trim(c)
    return F.when(t.rlike("^[A-Za-z]+[a-z]$"), F.regexp_extract(t, "^(.*)[a-z]$", 1))


def pair_labels(c: Column) -> tuple[Column, Column]:
    """The two components a pair label names: blank is A and B, ``a1,2`` is a1 and a2, ``x,y`` and ``x-y`` are x and y, ``AB`` is A and B; else null."""
    t = F.trim(F.coalesce(c, F.lit("")))
    short, two = r"^([A-Za-z]*)([0-9]+),([0-9]+)$", r"^([A-Za-z0-9]+)\s*[,\-]\s*([A-Za-z0-9]+)$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    left = F.when(t == "", "A").when(t.rlike(short), F.concat(part(short, 1), part(short, 2))).when(t.rlike(two), part(two, 1)).when(t.rlike("^[A-Za-z]{2}$"), F.substring(t, 1, 1))
    right = F.when(t == "", "B").when(t.rlike(short), F.concat(part(short, 1), part(short, 3))).when(t.rlike(two), part(two, 2)).when(t.rlike("^[A-Za-z]{2}$"), F.substring(t, 2, 1))
    return left, right


def sexagesimal_degrees(c: Column, hours: bool = False) -> Column:
    """``±dd mm ss.s`` (or hours) as degrees; the sign is that of the text, so -00 counts."""
    p = r"^\s*([+-]?)([0-9]{1,3})[:\s]+([0-9]{1,2})[:\s]+([0-9]{1,2}(?:\.[0-9]+)?)\s*$"
    part = lambda i: F.regexp_extract(c, p, i).try_cast("double")
    size = part(2) + part(3) / 60 + part(4) / 3600
    signed = F.when(F.regexp_extract(c, p, 1) == "-", -size).otherwise(size)
    return F.when(c.rlike(p), signed * (15.0 if hours else 1.0))


def masked_vector(c: Column, mask: str = "--") -> Column:
    """``[1.0 -- 3.0]`` as an array of doubles with null for the mask."""
    inner = F.trim(F.translate(c, "[]", "  "))
    parts = F.filter(F.split(inner, r"[\s,]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.when(t == mask, F.lit(None)).otherwise(t.try_cast("double")))


def match_rank(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 every word of the query within the name, else null."""
    words = [w for w in query.split() if w]
    every = F.lit(bool(words))
    for w in words:
        every = every & F.contains(name, F.lit(w))
    return F.when(name == query, 0).when(name.startswith(query), 1).when(every, 2)


def compact_position(c: Column) -> tuple[Column, Column]:
    """``hhmmss.ss+ddmmss.s`` (also ``hhmmm+ddmm`` with tenths of minutes) as degrees; null for other texts."""
    full, short = r"^\s*([0-9]{2})([0-9]{2})([0-9]{2}(?:\.[0-9]*)?)\s*([+-])([0-9]{2})([0-9]{2})([0-9]{2}(?:\.[0-9]*)?)\s*$", r"^\s*([0-9]{2})([0-9]{3})([+-])([0-9]{2})([0-9]{2})\s*$"
    part = lambda p, i: F.regexp_extract(c, p, i).try_cast("double")
    sign = lambda p, i: F.when(F.regexp_extract(c, p, i) == "-", -1.0).otherwise(1.0)
    ra = F.when(c.rlike(full), 15 * (part(full, 1) + part(full, 2) / 60 + part(full, 3) / 3600)).when(c.rlike(short), 15 * (part(short, 1) + part(short, 2) / 600))
    dec = F.when(c.rlike(full), sign(full, 4) * (part(full, 5) + part(full, 6) / 60 + part(full, 7) / 3600)).when(c.rlike(short), sign(short, 3) * (part(short, 4) + part(short, 5) / 60))
    return ra, dec


def first_token(c: Column) -> Column:
    """The first blank-separated token; null for a blank text."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\S+)", 1), F.lit(""))


def power_of_ten(c: Column) -> Column:
    """10 to the number in a text; null for no number or one out of range."""
    v = c.try_cast("double")
    return F.when(F.abs(v) < 300, F.pow(F.lit(10.0), v))
