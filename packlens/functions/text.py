"""Small string helpers shared by all column expressions (JVM only, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V

# Java flags: U = Unicode classes, i = ignore case, d = only \n ends a line, m = multi-line.
SPACE = r"(?U)\s+"
#: The characters that ``(?U)\s`` matches.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


#: What a match of a pattern begins with. A word boundary is the slow part of a search, so the first character is looked at before it.
FIRST = {
    V.MRP_EXPLICIT: "[MR]", V.UNIT_SALE_PRICE: "U", V.SMALL_WEIGHT: r"\d", V.WEIGHT_MEASURE: r"\d",
    V.QTY_MULTIPACK: "[0-9]", V.QTY_EXPLICIT: "N", V.QTY_COUNT: r"[0-9])\b(?=[0-9.,]*+\s*+[TCSVAPBJR][AITMOH]", V.QTY_STANDALONE: r"[0-9])\b(?=[0-9.,]*+\s*+(?:[MGL]|KG|CM|P[CI]|UN)",
    V.ORG_PREFIXES["MANUFACTURER"]: "[MP]", V.ORG_PREFIXES["PACKER"]: "P", V.ORG_PREFIXES["IMPORTER"]: "I", V.ORG_PREFIXES["MARKETER"]: "[MD]",
    V.DATE_ANCHORS["DATE_OF_MANUFACTURE"]: "M", V.DATE_ANCHORS["DATE_OF_PACKING"]: "P", V.DATE_ANCHORS["DATE_OF_IMPORT"]: "I",
    V.DATE_ANCHORS["BEST_BEFORE"]: "[BU]", V.DATE_ANCHORS["EXPIRY_DATE"]: "[EU]", V.RELATIVE_DATE: r"[B\d]",
    V.BATCH: "[BL]", V.LICENCE_OR_ID: "[FLCGRBE]",
}


def ci(pattern: str) -> str:
    """Case-insensitive pattern."""
    first = FIRST.get(pattern)
    return "(?Uid)" + (f"(?={first})" if first else "") + pattern


def cs(pattern: str) -> str:
    """Case-sensitive pattern."""
    return "(?Ud)" + pattern


def any_of(patterns: Iterable[str]) -> str:
    """One alternation out of many patterns, so a cluster costs one scan of the text."""
    return cs("(?:" + "|".join(patterns) + ")")


def found(text: Column, pattern: str, multiline: bool = False) -> Column:
    return text.rlike(("(?m)" if multiline else "") + ci(pattern))


def group(text: Column, pattern: str, i: int = 1, multiline: bool = False) -> Column:
    """Capture group, or null when the pattern or the optional group did not match."""
    return F.nullif(F.regexp_extract(text, ("(?m)" if multiline else "") + ci(pattern), i), F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_set(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(strip(text), SPACE), lambda w: w != "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression that refers to it many times."""
    return F.transform(F.array(value), body)[0]


def one_of(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(mapping: dict[str, object], key: Column) -> Column:
    """Dictionary lookup with null for unknown keys (JN10)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter and lower-case the others."""

    def cased(c: Column) -> Column:
        return F.lower(c) != F.upper(c)

    def build(chars: Column) -> Column:
        return F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when((i > 0) & cased(F.get(chars, i - 1)), F.lower(c)).otherwise(F.upper(c)),
            ),
            "",
        )

    return let(F.split(text, ""), build)


def truncate_message(text: Column, limit: int) -> Column:
    """SC18: trimmed text, cut at ``limit`` characters with a marker."""
    clean = strip(text)
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit)), F.lit("... [truncated]"))).otherwise(clean)
