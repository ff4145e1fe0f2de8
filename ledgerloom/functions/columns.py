"""Column expressions of the account warehouse. All stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed_values as fixed

MONEY = "decimal(32,2)"


def newest(col: str | Column) -> Column:
    """Descending order with NULL as the largest value, as Impala and Postgres sort."""
    return (F.col(col) if isinstance(col, str) else col).desc_nulls_first()


def oldest(col: str | Column) -> Column:
    """Ascending order with NULL as the largest value."""
    return (F.col(col) if isinstance(col, str) else col).asc_nulls_last()


def spread_nulls(key: Column, *salt: Column, ways: int = 256) -> Column:
    """A string join key whose NULLs land in many partitions instead of one.

    NULL never matches in an equi-join; neither does the replacement, because no real
    key starts with a NUL character. Only the shuffle target of such rows changes.
    """
    lane = F.pmod(F.xxhash64(*salt), F.lit(ways)).cast("string")
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), lane))


def decode(code: Column, labels: Mapping[str, str], otherwise: Column) -> Column:
    """Label of a code from a fixed list, ``otherwise`` for codes outside it."""
    pairs = [F.lit(part) for pair in labels.items() for part in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), otherwise)


def holder_role(code: Column, sequence: Column) -> Column:
    return decode(F.trim(code), fixed.HOLDER_ROLES, F.concat(code, sequence))


def person_type(code: Column) -> Column:
    return decode(code, fixed.PERSON_TYPES, F.lit(""))


def balance_band(balance: Column) -> Column:
    """Upper-inclusive band label; no balance counts as an empty account."""
    (bound, label), *rest = fixed.BALANCE_BANDS
    bands = F.when(balance <= bound, label)
    for bound, label in rest:
        bands = bands.when(balance <= bound, label)
    return bands.when(balance > fixed.BALANCE_BANDS[-1][0], fixed.BALANCE_TOP).otherwise(fixed.BALANCE_NONE)


def product_family(level_3: Column, level_4: Column) -> Column:
    labels = {"\u0001".join(levels): family for levels, family in fixed.PRODUCT_FAMILIES.items()}
    return decode(F.concat(F.trim(level_3), F.lit("\u0001"), F.trim(level_4)), labels, F.lit(fixed.OTHER_FAMILY))


def iso_week_code(day: Column) -> Column:
    """ISO year and week as ``yyyyww``; the days around New Year follow the ISO year."""
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("int")


def day_number(raw: Column) -> Column:
    """Date held as a ``yyyyMMdd`` number or text; unreadable values give NULL."""
    return F.try_to_timestamp(F.trim(raw.cast("string")), F.lit("yyyyMMdd")).cast("date")


def epoch_ms(raw: Column) -> Column:
    """Epoch milliseconds as a zone-free timestamp, rounded to the nearest second."""
    seconds = F.round(raw / 1000, 0).cast("bigint")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def negative_id(raw: Column, kind: str = "int") -> Column:
    """Surrogate master id for a customer that has none."""
    return (-raw.try_cast(kind)).cast("bigint")


def rebuilt_product(raw: Column) -> Column:
    """``PPssss`` product code as ``PP-0sss``: two characters, dash, four positions."""
    return F.concat(F.substring(raw, 1, 2), F.lit("-"), F.lpad(raw.substr(F.lit(3), F.length(raw)), 4, "0"))


def padded_branch(raw: Column) -> Column:
    """Left-pad short branch numbers; longer ones stay whole (``lpad`` would cut them)."""
    return F.when(F.length(raw) < 4, F.lpad(raw, 4, "0")).otherwise(raw)


def dash_id(*parts: Column, missing: str | None = None) -> Column:
    """Parts joined by dashes. Missing parts are left out, or shown as ``missing``."""
    texts = [part.cast("string") for part in parts]
    if missing is not None:
        texts = [F.trim(F.coalesce(text, F.lit(missing))) for text in texts]
        return F.concat_ws("-", *texts)
    return F.nullif(F.trim(F.concat_ws("-", *texts)), F.lit(""))


def pct_change(now: Column, before: Column) -> Column:
    """Change from ``before`` to ``now`` in percent, NULL when there was nothing before."""
    return F.round(F.try_divide((now - before) * 100, F.nullif(before, F.lit(0))), 2).cast("decimal(18,2)")


Decoder = Callable[[Column, str, str, str], Column]


def aes_decoder(key: str) -> Decoder:
    """Decoder for deterministically AES-encrypted, base64-coded values.

    The returned function takes (value, table, column, error text). A NULL value stays
    NULL; a value that cannot be decoded becomes the error text.
    """

    def decode_value(value: Column, table: str, column: str, on_error: str) -> Column:
        plain = F.try_aes_decrypt(
            F.try_to_binary(value, F.lit("base64")), F.lit(key), F.lit("ECB"), F.lit("PKCS")
        ).cast("string")
        return F.when(value.isNotNull(), F.coalesce(plain, F.lit(on_error)))

    return decode_value


def base64_decoder() -> Decoder:
    """Decoder for values that are only base64-coded."""

    def decode_value(value: Column, table: str, column: str, on_error: str) -> Column:
        plain = F.try_to_binary(value, F.lit("base64")).cast("string")
        return F.when(value.isNotNull(), F.coalesce(plain, F.lit(on_error)))

    return decode_value


def aes_encode(value: Column, key: str) -> Column:
    """Counterpart of :func:`aes_decoder` for building encrypted columns."""
    return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("ECB"), F.lit("PKCS")))


def contains_any(text: Column, tokens: Sequence[str]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | text.contains(token)
    return found
