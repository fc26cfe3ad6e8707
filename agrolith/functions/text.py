"""String column functions (X1-X5, X11, X14, null tokens, header names)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens a CSV reader treats as missing (pandas defaults).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_name(name: str) -> str:
    """Strip, lower-case, blanks to underscores."""
    return name.strip().lower().replace(" ", "_")


# Characters stripped from both ends (ASCII white space, no-break and wide spaces).
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_all(c) -> Column:
    """Remove leading and trailing white space of any kind (``btrim`` over a fixed set, no regex)."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def title_case(c) -> Column:
    """Strip, then upper-case every letter that follows a non-letter.

    Runs of letters and runs of non-letters are split apart; each run gets its
    first character upper-cased and the rest lower-cased, so ``d'ivoire`` ->
    ``D'Ivoire`` and ``guinea-bissau`` -> ``Guinea-Bissau`` (``initcap`` only
    breaks at blanks).
    """
    runs = F.regexp_extract_all(F.lower(strip_all(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    cased = F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))
    return F.when(_c(c).isNull(), F.lit(None)).otherwise(F.array_join(cased, ""))


def null_tokens_to_null(c) -> Column:
    """Map CSV missing-value tokens to null; a cell must be the token itself, blanks around it count."""
    return F.when(_c(c).isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(_c(c))


def iso_time(c) -> Column:
    """A timestamp as ISO text with microseconds."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def file_extension(path) -> Column:
    """X11: lower-case extension with the dot, '' if none."""
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1))


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -2)


def parent_path(path) -> Column:
    return F.regexp_replace(_c(path), r"/[^/]*$", "")


def relative_path(path, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.regexp_replace(_c(path), "^" + re.escape(root), "")
