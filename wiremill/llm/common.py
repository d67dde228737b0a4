"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the bytes 9 to 13 (fixed values of the contracts).
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(column: str) -> Column:
    """CRC-32 of a column's text; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def share_of_hash(column: Column) -> Column:
    """A number in [0, 1) that depends on ``column`` only, for repeatable bounded samples."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / F.lit(float(1 << 30))


def spaced(text: Column, kept: str = "") -> Column:
    """``text`` with the separators of words other than ``kept`` as spaces; one pass of ``replace`` each is far cheaper than ``translate``."""
    for c in SPACES[1:]:
        if c not in kept:
            text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def native_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(spaced(F.coalesce(text, F.lit(""))), " "), "")


def checked(small: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``small`` (a written table of narrow rows), to be broadcast if it has ``most_rows`` at most; beyond that, joins shuffle it."""
    return F.broadcast(small) if small.count() <= most_rows else small


def join_skewed(big: DataFrame, small: DataFrame, on: list[str], n: str = "n", often: int = 10_000) -> DataFrame:
    """``big`` joined with ``small``, a written table of one row per key whose column ``n`` has the key's rows in ``big``.

    Keys with ``often`` rows or more, at most one in that many rows of ``big``,
    are broadcast (checked), so that no task gets all rows of a frequent key;
    the other keys are shuffled.
    """
    frequent = small.where(F.col(n) >= often)
    if frequent.first() is None:
        return big.join(small, on)
    frequent = checked(frequent)
    return big.join(frequent, on).unionByName(big.join(frequent.select(*on), on, "left_anti").join(small.where(F.col(n) < often), on))


def left_join_skewed(big: DataFrame, small: DataFrame, on: list[str], n: str = "n", often: int = 10_000) -> DataFrame:
    """``big`` left joined with ``small`` as :func:`join_skewed` does; rows of ``big`` without a match have nulls."""
    frequent = small.where(F.col(n) >= often)
    if frequent.first() is None:
        return big.join(small, on, "left")
    frequent = checked(frequent)
    rest = big.join(frequent.select(*on), on, "left_anti").join(small.where(F.col(n) < often), on, "left")
    return big.join(frequent, on).unionByName(rest)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """From now on hand Python workers ``rows`` rows at a time: texts that pass through them are held several times over."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def column_texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def chunks(texts: list[str], most_chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most_chars`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most_chars:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def byte_words(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (wrapping)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
