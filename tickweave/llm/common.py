"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names starting with ``wanted`` that no column of ``df`` has in any letter case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names in any letter case; results take their place."""
    gone = {n.lower() for n in names}
    return df.select(*(col(c) for c in df.columns if c.lower() not in gone))


def prefix(df: DataFrame, start: str) -> str:
    """``start``, lengthened until no column of ``df`` begins with it."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start += "_"
    return start


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(*parts: Column) -> Column:
    """0 to 2**32 - 1 from the MD5 of the parts' text; other engines can repeat it."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased; bytes.lower leaves every other byte alone."""
    return text.encode().lower().split() if text else []


def hash_sample(df: DataFrame, key: Column, most: int, *ties: Column) -> DataFrame:
    """``most`` rows of ``df`` (all, if fewer), those whose key has the smallest hash.

    Of large tables, rows with a hash far beyond the expected place are dropped first,
    so that tasks do not each send ``most`` candidates on.
    """
    order = F.xxhash64(F.lit("sample"), key)
    total = df.count()
    if total > 4 * most:
        span = 1 << 30
        df = df.where(F.pmod(order, F.lit(span)) < max(1, span * 2 * most // total))
        order = F.pmod(order, F.lit(span))
    return df.orderBy(order, key, *ties).limit(most)
