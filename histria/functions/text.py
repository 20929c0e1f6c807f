"""String, date and id expressions. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_title(c: Column) -> Column:
    """Without numeric and named character references and without marks (letters of any script, digits, `_` and spaces stay)."""
    c = F.regexp_replace(c, r"&#\d+;", "")
    c = F.regexp_replace(c, r"&[a-zA-Z]+;", "")
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9 ]", "")


def tokens(c: Column, limit: int | None = None) -> Column:
    """Lower-cased word runs and single marks, at most `limit`."""
    out = F.regexp_extract_all(F.lower(F.trim(c)), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    return F.slice(out, 1, limit) if limit is not None else out


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def id_list(c: Column) -> Column:
    """ARRAY<STRING> from a JSON array or text parted by spaces or commas; null and empty give an empty array."""
    parsed = F.from_json(c, "array<string>")
    parts = F.filter(F.split(F.regexp_replace(c, r"[\[\]\"']", " "), r"[\s,]+"), lambda x: x != "")
    return F.coalesce(F.when(F.trim(c).startswith("["), parsed), parts, F.array().cast("array<string>"))


def int_or_null(c: Column) -> Column:
    return F.try_cast(c, "bigint") if hasattr(F, "try_cast") else c.try_cast("bigint")


def normal_id(c: Column) -> Column:
    """An integral number as such (`7.0` is `7`), anything else as text."""
    s = c.cast("string")
    d = s.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 9e15) & (d == F.floor(d)), d.cast("bigint").cast("string")).otherwise(s)


def date_words(c: Column) -> Column:
    """`06 3, 2013`: month, day, year."""
    return F.try_to_timestamp(c, F.lit("MM d, yyyy")).cast("date")


def local_epoch(c: Column) -> Column:
    """Seconds of `Fri Nov 17 11:37:35 -0800 2017` read as UTC: the offset is dropped, not applied."""
    plain = F.regexp_replace(c, r"^\w{3} (\w{3}) (\d{2}) (\d{2}:\d{2}:\d{2}) [+-]\d{4} (\d{4})$", "$4 $1 $2 $3")
    return F.unix_timestamp(F.try_to_timestamp(plain, F.lit("yyyy MMM dd HH:mm:ss")))


def item_text(attributes: list[str], empty: str = "[Empty Content]") -> Column:
    """One attribute as it is; several as `a: v, b: v`, nulls left out. Blank content gives `empty`."""
    if len(attributes) == 1:
        out = F.col(attributes[0]).cast("string")
    else:
        out = F.concat_ws(", ", *[F.concat(F.lit(f"{a}: "), F.col(a).cast("string")) for a in attributes])
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), F.lit(empty))


def family(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+$", "")


def model_name(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("."), F.lit("")))


def representation(task: Column, extra: Column) -> Column:
    """`a+b` texts: the task's parts sorted, then the other parts in their order, each once."""
    parts = lambda c: F.filter(F.split(c, r"\+"), lambda x: x != "")
    return F.array_join(F.array_union(F.array_sort(F.array_distinct(parts(task))), parts(extra)), "+")


def add_ons(c: Column) -> Column:
    """The representation's parts besides uid and sid, sorted."""
    return F.array_join(F.array_sort(F.array_except(F.split(c, r"\+"), F.array(F.lit("uid"), F.lit("sid")))), "+")


def code_text(codes: Column) -> Column:
    """`<a_1><b_7>...`: a letter for the slot and the code."""
    return F.array_join(F.transform(codes, lambda c, i: F.concat(F.lit("<"), F.char(i + 97), F.lit("_"), c.cast("string"), F.lit(">"))), "")


def messages(system: Column, user: Column, assistant: Column) -> Column:
    return F.to_json(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))]))


def set_signature(ids: Column) -> Column:
    """SHA-1 of the sorted distinct ids, parted by NUL."""
    return F.sha1(F.array_join(F.array_sort(F.array_distinct(F.transform(ids, lambda x: x.cast("string")))), "\0"))
