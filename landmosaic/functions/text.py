"""String, hashing and guard expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: str | Column, words: tuple[str, ...] = ()) -> Column:
    """Trim all white space; empty text and the given missing-value words become null."""
    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    bad = t == ""
    for w in words:
        bad = bad | (t == w)
    return F.when(~bad, t)


def first_text(*cs: str) -> Column:
    """The first of the columns that is not missing once cleaned."""
    return F.coalesce(*[clean(c) for c in cs])


def pasted(sep: str, *cs: str) -> Column:
    """Columns as text with a separator; null shows as NA, so that nulls compare equal in keys."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cs])


def truthy(c: str) -> Column:
    return F.coalesce(F.lower(F.col(c)).isin("yes", "true", "1"), F.lit(False))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does. A rule that is null doesn't hold."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules])


def first_tag(tags: list[str]) -> Column:
    """(key, value) of the first tag that is present."""
    return F.coalesce(*[F.when(F.col(t).isNotNull(), F.struct(F.lit(t).alias("key"), F.col(t).cast("string").alias("value"))) for t in tags])


def unit_hash(seed: str, *cs: str) -> Column:
    """A number in [0, 1] from the first 8 bytes, least significant first, of the SHA-256 of seed|id."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cs]), 256)
    swapped = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(1.8446744073709552e19)


def finite(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, unlike with least and greatest alone."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def human_bytes(c: str) -> Column:
    n = F.col(c).cast("double")
    steps = [("TB", 2**40), ("GB", 2**30), ("MB", 2**20), ("KB", 2**10)]
    return reduce(lambda acc, s: F.when(n >= s[1], F.format_string("%.1f " + s[0], n / s[1])).otherwise(acc), reversed(steps), F.format_string("%.0f B", n))


def sub_first(c: str | Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; the text itself where nothing matches. Null stays null."""
    t = F.col(c) if isinstance(c, str) else c
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group)).otherwise(t)


def base_name(c: str) -> Column:
    return F.regexp_replace(c, r"^.*[/\\]", "")


def stem(c: str) -> Column:
    return F.regexp_replace(base_name(c), r"\.[^.]*$", "")


def extension(c: str) -> Column:
    """Lower case, without the dot; empty without one."""
    return F.lower(F.regexp_extract(base_name(c), r"\.([^.]+)$", 1))


def safe_name(c: str | Column) -> Column:
    """Only letters, digits, dots and dashes; runs of others become one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9.-]+", "_"), r"^_+|_+$", "")


def listed(c: str | Column, sep: str = ",") -> Column:
    """The trimmed parts of a separated list, empty ones left out."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def url(base: str, **params: Column) -> Column:
    """A request address with percent-encoded parameters; secrets aren't among them."""
    parts = [F.concat(F.lit(k + "="), F.regexp_replace(F.url_encode(v.cast("string")), r"\+", "%20")) for k, v in params.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))


def human_seconds(c: str) -> Column:
    s = F.col(c)
    return F.when(s < 60, F.format_string("%.1f s", s)).when(s < 3600, F.format_string("%d min %d s", F.floor(s / 60), F.floor(s % 60))).otherwise(F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def year_of(c: str | Column) -> Column:
    """The year of 'YYYY-MM...'; null for anything else."""
    return F.substring(c, 1, 4).try_cast("int")


def signif(c: str | Column, digits: int) -> Column:
    """Rounded, half to even, to so many significant digits; 0 stays 0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, x).otherwise(F.bround(x / unit, 0) * unit)


def safe_log(c: str | Column, least: float = 1e-9) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.log(F.when(x.isNotNull(), F.greatest(x, F.lit(least))))


def hashed_id(prefix: str, *cs: str) -> Column:
    """A stable id: the prefix and 16 hexadecimal digits of a hash of the columns; nulls count as the text NA."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(pasted("|", *cs), 256), 1, 16))


def row_checksum(*cs: str) -> Column:
    """A number from a row's content; its sum over a table doesn't depend on the order of rows."""
    return F.conv(F.substring(F.sha2(pasted("|", *cs), 256), 1, 8), 16, 10).cast("bigint")


def sorted_json(**fields: Column) -> Column:
    """A JSON object with its keys in alphabetical order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def mapped(c: str, words: dict[str, str | int]) -> Column:
    """The word's entry; null for words that the map lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col(c))


def first_true(flags: list[Column]) -> Column:
    """The number, from 1, of the first flag that is true; null where none is."""
    return F.nullif(F.array_position(F.array(*[F.coalesce(f, F.lit(False)) for f in flags]), True), F.lit(0))


def gather(c: str | Column, index: Column) -> Column:
    """The element at ``index``, from 1; null outside."""
    return F.try_element_at(F.col(c) if isinstance(c, str) else c, index.cast("int"))


def wide(df_columns: list[str], pattern: str) -> Column:
    """The columns whose whole name matches, in the order of their names, as one array."""
    return F.array(*[F.col(x) for x in sorted(df_columns) if re.fullmatch(pattern, x)])


def guarded_ratio(a: Column, b: Column, least: float | None = None) -> Column:
    """a / b: null where b is not positive, or with b raised to ``least``."""
    return F.when(b > 0, a / b) if least is None else a / F.greatest(b, F.lit(least))
