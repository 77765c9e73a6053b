"""String expressions whose results must not depend on the engine: Unicode strip, slugs, estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space when text is stripped.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """SC3: text without white space of any script at its ends; trim() would leave tabs."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    """SRC7: nothing but white space."""
    return ~text.rlike(f"[^{SPACE}]")


def collapse(text: Column) -> Column:
    """SC4: runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def name_key(text: Column) -> Column:
    """SC4: the key by which display names are compared; lower() stands for case folding (see name_key_folded)."""
    return F.lower(collapse(text))


def slug(name: Column) -> Column:
    """SC5: lower case, runs of other characters than a-z and 0-9 as hyphens; world if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("world"))


def display_filename(filename: Column) -> Column:
    """SC6: the stem with white space collapsed, 80 characters at most."""
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.substring(F.regexp_replace(strip(stem), f"[{SPACE}]+", " "), 1, 80)


def token_estimate(text: Column) -> Column:
    """SC10: a quarter of the characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


#: Characters that Windows forbids in the name of a file or folder, and line ends, in which no path goes on.
FORBIDDEN = '/:*?"<>|\r\n'


def redact_paths(line: Column) -> Column:
    """PRJ18: of a Windows path its drive and folders become a mark and its last name stays; a drive alone stays too.

    The line is cut before each drive, and what stands behind a drive at its backslashes. Names that are whole and
    allowed are folders as long as a name follows them.
    """

    def allowed(name: Column) -> Column:
        return (name != "") & (F.translate(name, FORBIDDEN, "") == name)

    def shortened(part: Column) -> Column:
        names = F.split(F.substring(part, F.lit(4), F.length(part)), r"\\")
        stops = F.array_position(F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda n: allowed(n).cast("string")), "false")
        folders = F.when(stops > 0, stops - 1).otherwise(F.size(names) - 1).cast("int")
        # The name behind the folders may go over into other text; where none begins, the last folder is the name.
        last = folders - F.when(allowed(F.substring(F.get(names, folders), 1, 1)), 0).otherwise(1)
        kept = F.array_join(F.slice(names, last + 1, F.size(names) - last), "\\")
        return F.when(part.rlike(r"^[A-Za-z]:\\") & (last >= 0), F.concat(F.lit("<local-path>\\"), kept)).otherwise(part)

    return F.array_join(F.transform(F.split(line, r"(?=[A-Za-z]:\\)"), shortened), "")


def suffix(path: Column) -> Column:
    """SRC1: the lower-cased suffix of a path with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))


def name_key_folded(text: Column) -> Column:
    """SC4 with full case folding, which Spark lacks: an Arrow UDF over Python's casefold()."""

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(v.split()).casefold())

    return folded(text)
