"""Text cleaning, tokens, grams and set similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical forms of corporate suffixes and street types, and the spellings read as missing.
CORPORATE = {"private": "pvt", "limited": "ltd", "corporation": "corp", "incorporated": "inc", "company": "co"}
STREETS = {"street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd"}
NA_SPELLINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

NOT_WORD = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"
SPACES = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def simplify(c: Column | str) -> Column:
    """Null to empty, lower case, punctuation to blanks, runs of white space to one blank."""
    plain = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), NOT_WORD, " ")
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def canonical_tokens(c: Column | str, words: dict[str, str] | None = None) -> Column:
    """Whole tokens replaced by their canonical forms."""
    names = F.create_map(*[F.lit(x) for kv in (words or CORPORATE | STREETS).items() for x in kv])
    return F.array_join(F.transform(F.split(_col(c), " "), lambda t: F.coalesce(F.try_element_at(names, t), t)), " ")


def normalize(c: Column | str) -> Column:
    """Names and addresses: simplify, then canonical tokens."""
    return canonical_tokens(simplify(c))


def normalize_country(c: Column | str) -> Column:
    return F.trim(F.upper(F.coalesce(_col(c), F.lit("UNKNOWN"))))


def known_country(c: Column | str) -> Column:
    """Countries that take part in blocking."""
    return ~_col(c).isin("", "UNKNOWN")


def tokens(c: Column | str) -> Column:
    """White-space tokens; none for empty or null."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACES, " ")), " "), lambda t: t != "")


def id_list(c: Column | str) -> Column:
    """Ids of a comma list; none for empty or null, and blank ones are none."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))


def joined(ids: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(ids)), ",")


def char_grams(c: Column | str, n: int = 3, short: bool = False) -> Column:
    """Distinct character grams across blanks; a text shorter than n has none, or itself if ``short``."""
    c = _col(c)
    last = F.length(c) - n + 1
    if short:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring(c, i, n)))
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def padded_grams(c: Column | str, n: int = 3) -> Column:
    """Character grams of each word padded with one blank on either side, with repeats."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.substring(padded, i, n))

    return F.flatten(F.transform(tokens(F.lower(_col(c))), of))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_jaccard(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats: only what they share is looked for, once."""
    shared = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n))[0]
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared)


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard(tokens(a), tokens(b))


def gram_jaccard(a: Column | str, b: Column | str, n: int = 3) -> Column:
    """Character grams; 0 if either text is shorter than n. Equal texts need no sets."""
    a, b = _col(a), _col(b)
    return F.when(a == b, (F.length(a) >= n).cast("double")).otherwise(jaccard(char_grams(a, n), char_grams(b, n)))


def profile_jaccard(a: Column | str, b: Column | str, n: int = 3) -> Column:
    """The profiling dialect: trimmed lower case, short texts are one gram, two empty texts are equal."""
    a, b = (F.lower(F.trim(F.coalesce(_col(x), F.lit("")))) for x in (a, b))
    both = jaccard(char_grams(a, n, True), char_grams(b, n, True))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(both)


def first_token_equal(a: Column | str, b: Column | str) -> Column:
    a, b = (F.get(tokens(F.lower(_col(x))), F.lit(0)) for x in (a, b))
    return F.coalesce(a == b, F.lit(False)).cast("int")


def same_text(a: Column | str, b: Column | str) -> Column:
    a, b = (F.lower(F.trim(F.coalesce(_col(x), F.lit("")))) for x in (a, b))
    return (a == b).cast("int")


def same_country(a: Column | str, b: Column | str) -> Column:
    """1 if equal and not empty."""
    a, b = (F.coalesce(_col(x), F.lit("")) for x in (a, b))
    return ((a == b) & (a != "")).cast("long")


def composition(c: Column | str) -> dict[str, Column]:
    """Counts of digits, punctuation, white space and letters."""
    c = F.coalesce(_col(c), F.lit(""))
    return {
        "digits": F.regexp_count(c, F.lit(r"\p{Nd}")),
        "punctuation": F.regexp_count(c, F.lit(NOT_WORD)),
        "spaces": F.regexp_count(c, F.lit(r"(?U)[\s\x1c-\x1f]")),
        "letters": F.regexp_count(c, F.lit(r"\p{L}")),
    }
