"""Scalar expressions over text, dates, identities, secrets: all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space as Python's str.split sees it; plain \s misses most of it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"

# What counts as a secret in a text.
SECRETS = (
    r"(?i)\b(?:api[_ -]?key|secret|password|passwd|token|authorization)\b\s*[:=]\s*\S+",
    r"(?i)\bbearer\s+\S+",
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
)
# Phrases of pages that have not loaded.
PLACEHOLDERS = ("加载中", "正在加载", "loading", "please wait", "enable javascript", "javascript required")
# Local paths that never leave the system.
LOCAL_PATHS = r"(?<![A-Za-z0-9])[A-Za-z]:[\\/]|file://|(?:^|[\s\x1c-\x1f\x85\p{Z}])/(?:home|Users|tmp|var)/"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join(MONTHS)
# Full dates as statements carry them, in the order in which they are tried.
DATE_NUMERIC = r"(?<![0-9])(20[0-9]{2})[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12][0-9]|3[01])(?![0-9])"
DATE_CJK = r"(?<![0-9])(20[0-9]{2})年(0?[1-9]|1[0-2])月(0?[1-9]|[12][0-9]|3[01])日"
DATE_MDY = rf"(?i)\b({_MONTH})\s+([0-3]?[0-9])(?:st|nd|rd|th)?,?\s+(20[0-9]{{2}})\b"
DATE_DMY = rf"(?i)\b([0-3]?[0-9])(?:st|nd|rd|th)?\s+({_MONTH}),?\s+(20[0-9]{{2}})\b"
# Full dates as metrics look for them; any year, no dots, months in words first.
DATE_ANY = r"(?<![0-9])([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})(?:日)?(?![0-9])"
DATE_ANY_MDY = rf"(?i)\b({_MONTH})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b"


def collapse(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def normalize_newlines(text: Column) -> Column:
    """Line ends as \\n and no white space at either end."""
    unified = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(unified, rf"^{BLANK}+|{BLANK}+$", "")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", "")).cast("long")


def contains_folded(content: Column, anchor: Column) -> Column:
    """Containment after white space collapse, without case."""
    return F.contains(F.lower(collapse(content)), F.lower(collapse(anchor)))


def escape_cell(cell: Column) -> Column:
    return F.replace(F.replace(F.replace(cell, F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")


def contains_secret(text: Column) -> Column:
    return F.coalesce(reduce(or_, [text.rlike(p) for p in SECRETS]), F.lit(False))


def redact(text: Column, secret_mask: str = "[secret]", path_mask: str = "[path]") -> Column:
    """A text with a secret is masked as a whole; so is one with a local path."""
    return F.when(contains_secret(text), F.lit(secret_mask)).when(text.rlike(LOCAL_PATHS), F.lit(path_mask)).otherwise(text)


def map_strings(value: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """`value` with each string in it changed, through arrays, structs and the values of maps."""
    if isinstance(kind, T.StringType):
        return change(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: map_strings(x, kind.valueType, change))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[map_strings(value[f.name], f.dataType, change).alias(f.name) for f in kind]))
    return value


def has_placeholder(content: Column) -> Column:
    low = F.lower(F.coalesce(content, F.lit("")))
    return reduce(or_, [F.contains(low, F.lit(p)) for p in PLACEHOLDERS])


def first_date(text: Column) -> Column:
    """First full date by order of patterns; an impossible numeric date moves on, an impossible English one gives NULL."""

    def numeric(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def english(pattern: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, k) for k in order)
        return F.try_to_date(F.concat_ws("-", y, month_number(m), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    found = F.coalesce(
        numeric(DATE_NUMERIC),
        numeric(DATE_CJK),
        F.when(text.rlike(DATE_MDY), english(DATE_MDY, (3, 1, 2))).when(text.rlike(DATE_DMY), english(DATE_DMY, (3, 2, 1))),
    )
    return F.when(text.rlike("20[0-9]{2}"), found)  # every pattern needs such a year


def month_number(name: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(name))
    return F.lpad(place.cast("string"), 2, "0")


def dates_in(text: Column) -> Column:
    """Every valid date of a text as ISO strings, sorted, each once; not the patterns of `first_date`."""

    def of(pattern: str, order: tuple[int, int, int], word: bool) -> Column:
        def iso(match: Column) -> Column:
            y, m, d = (F.regexp_extract(match, pattern, k) for k in order)
            return F.try_to_date(F.concat_ws("-", y, month_number(m) if word else F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd").cast("string")

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), iso)

    found = F.concat(of(DATE_ANY, (1, 2, 3), False), of(DATE_ANY_MDY, (3, 1, 2), True))
    real = F.filter(found, lambda x: x.isNotNull() & ~F.startswith(x, F.lit("0000")))
    return F.when(text.rlike("[0-9]{4}"), F.array_sort(F.array_distinct(real))).otherwise(F.array().cast("array<string>"))


def parse_instant(text: Column) -> Column:
    """A timestamp from ISO text that names its offset; NULL otherwise."""
    return F.when(text.rlike(r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def case_instant(text: Column) -> Column:
    """A case's time: a bare date is midnight UTC, the prefix `undated; retrieved ` goes, a time without offset is NULL."""
    bare = F.regexp_replace(text, r"^undated; retrieved ", "")
    return F.when(F.length(bare) == 10, F.try_to_timestamp(F.concat(bare, F.lit("T00:00:00+00:00")))).otherwise(parse_instant(bare))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(domain: Column, document: Column, document_hash: Column, max_chars: int, index: Column, version: str = "structure-v1") -> Column:
    return F.sha2(F.concat_ws("\u0000", domain, document, document_hash, F.lit(str(max_chars)), F.lit(version), index.cast("string")), 256)


def list_identity(*parts: Column) -> Column:
    """sha256 of a JSON list of strings, as `["a", "b"]`; NULL parts are null."""
    quoted = [F.coalesce(F.regexp_replace(F.to_json(F.array(p.cast("string"))), r"^\[|\]$", ""), F.lit("null")) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256)


def source_group(url: Column, reference: Column, result_id: Column) -> Column:
    return F.concat(F.lit("source_"), F.substring(F.sha2(F.coalesce(url, reference, result_id), 256), 1, 16))
