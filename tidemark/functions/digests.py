"""Canonical text of rows and digests of tables that neither partitions nor the order of rows can change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Significant digits of a number: a fixed value.
DIGITS = 12
#: 32-bit parts of a row's SHA-256, whose sums over all rows stand for the table.
_LANES = 8


def number(x: Column) -> Column:
    """A finite number to DIGITS significant digits, as d.ddd…e+xx; zero has no sign. What is not finite is an error."""
    v = x.cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a number is not finite")).cast("string")).otherwise(F.format_string(f"%.{DIGITS - 1}e", F.when(v == 0, F.lit(0.0)).otherwise(v)))


def quoted(x: Column) -> Column:
    """A string as JSON in ASCII: what is outside stands as \\uXXXX, in surrogate pairs beyond the first plane."""
    plain = F.to_json(F.array(x))
    plain = F.substring(plain, F.lit(2), F.length(plain) - 2)
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        at = F.ascii(c)
        far = at - 0x10000
        pair = F.concat(four(F.shiftright(far, 10) + 0xD800), four(far.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(at < 128, c).when(at < 0x10000, four(at)).otherwise(pair)

    return F.when(x.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(plain, ""), one), "")).otherwise(plain)


def canonical(x: Column, kind: T.DataType) -> Column:
    """The JSON of a column: keys sorted, no blanks, ASCII, numbers as `number` has them, instants and days as ISO text; null is null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(x)
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        text = x.cast("string")
    elif isinstance(kind, T.StructType):
        return F.when(x.isNull(), F.lit("null")).otherwise(_object([(f.name, x[f.name], f.dataType) for f in kind]))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: canonical(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(x)), entry), ","), F.lit("}"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = quoted(F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.lower(F.hex(x)))
    else:
        text = quoted(x.cast("string"))
    return F.coalesce(text, F.lit("null"))


def _object(fields: list[tuple[str, Column, T.DataType]]) -> Column:
    parts = [F.concat(quoted(F.lit(name)), F.lit(":"), canonical(x, kind)) for name, x, kind in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))


def row_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The canonical JSON of each row of df, of all or the named columns."""
    return _object([(c, F.col(f"`{c}`"), df.schema[c].dataType) for c in columns or df.columns])


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha2(row_json(df, columns), 256)


def _lanes(digest: Column) -> list[Column]:
    return [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"l{k}") for k in range(_LANES)]


def table_digest(df: DataFrame, by: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """(by..., n, digest) of df, or of each group: equal for equal rows in any order and partitions, repeated rows counted.

    Row digests are added up in parts, on every task before the shuffle, and the sums with their count are hashed: no rows
    are sorted or gathered. Columns are taken by name, so their order is no matter; groups are digested without `by`. No
    rows give n 0 without `by`, and no groups with it.
    """
    columns = sorted(columns or [c for c in df.columns if c not in by])
    kinds = F.lit(",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns))
    rows = df.select(*by, row_digest(df, columns).alias("d"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *_lanes(F.col("d")))
    text = F.concat_ws("|", kinds, F.col("n").cast("string"), *(F.coalesce(F.col(f"l{k}"), F.lit(0)).cast("string") for k in range(_LANES)))
    return sums.select(*by, "n", F.sha2(text, 256).alias("digest"))


def session_version(spec_sha256: str, as_of: Column) -> Column:
    """The version of what a specification made for an instant."""
    return F.sha2(F.concat(F.lit(spec_sha256), F.lit("@"), F.date_format(as_of.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")), 256)
