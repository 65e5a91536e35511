"""Column functions: vectors, guarded arithmetic, strings, hashes and schedules. Undefined results are null."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, StringType, StructType

#: The Euler-Mascheroni constant.
EULER = 0.5772156649015329


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """a at length one; null for a zero vector."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def safe_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)), without overflow, kept off 0 and 1."""
    e = F.exp(-F.abs(z))
    return F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bce_with_logits(z: Column, y: Column) -> Column:
    return softplus(z) - z * y


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def mapped_range(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """x from [a, b] to [c, d]; an error outside."""
    return F.when(x.between(a, b), c + (x - a) * ((d - c) / (b - a))).otherwise(F.raise_error(F.concat(F.lit("outside the range: "), x.cast("string"))).cast("double"))


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def linear_warmup(step: Column, warmup: int, peak: float) -> Column:
    return F.when(step < warmup, peak * step / max(1, warmup)).otherwise(F.lit(peak))


def cosine_schedule(step: Column, warmup: int, total: int, peak: float, final: float) -> Column:
    """Linear to the peak for `warmup` steps, then half a cosine to the final rate, which holds from `total` on."""
    down = final + (peak - final) * (1 + F.cos(F.lit(math.pi) * (step - warmup) / (total - warmup))) / 2
    return F.when(step < warmup, peak * step / max(1, warmup)).when(step >= total, F.lit(final)).otherwise(down)


def stem(path: Column) -> Column:
    """A file's name without folder and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(suffixes)


def safe_name(name: Column) -> Column:
    """Everything but letters, digits, dash, underscore and dot becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")


def last_space_split(line: Column) -> tuple[Column, Column]:
    """What stands before and after the last space."""
    return F.regexp_extract(line, r"^(.*) ([^ ]+)$", 1), F.regexp_extract(line, r"^(.*) ([^ ]+)$", 2)


def keyword(text: Column, word: str) -> Column:
    """Whether the word occurs, in any case; a hyphen in it stands for a hyphen or white space."""
    return text.rlike("(?i)\\b" + word.replace("-", r"[\s-]") + "\\b")


def numeric_range(text: Column) -> tuple[Column, Column]:
    """low and high of "low - high", as doubles; "?" is unknown."""

    def part(i: int) -> Column:
        return F.expr("1") * F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?|\?)\s*[-–]\s*(\d+(?:\.\d+)?|\?)", i), F.lit("?")).try_cast("double")

    return part(1), part(2)


@F.arrow_udf(DoubleType())
def power(x: pa.Array, y: pa.Array) -> pa.Array:
    """x to the power of y by the C library, as SQL engines in C have it: the JVM's pow differs in the last bit."""
    return pa.array([None if a is None or b is None else math.pow(a, b) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())


def one_decimal(x: Column) -> Column:
    """A double with one decimal and commas. From 2^53 on all digits of the whole number it is (up to 2^106), where
    format_number writes zeros after the seventeenth."""
    high = F.floor(x / 2.0**53)
    high, low = high.cast("decimal(16,0)"), (x - high * 2.0**53).cast("decimal(16,0)")
    whole = high * F.lit(2**53).cast("decimal(16,0)") + low
    return F.when((x >= 2.0**53) & (x < 2.0**106), F.format_number(whole, 1)).otherwise(F.format_number(x, 1))


def human_bytes(n: Column) -> Column:
    return F.when(n >= 1e12, F.concat(one_decimal(n / 1e12), F.lit(" TB"))).otherwise(F.concat(one_decimal(n / 1e9), F.lit(" GB")))


def hex_colour(text: Column) -> Column:
    """[red, green, blue] in [0, 1] of "#rrggbb" or "rgb(r, g, b)"; else null."""
    code = F.regexp_extract(text, r"^#([0-9A-Fa-f]{6})$", 1)
    of_hex = F.array(*(F.conv(F.substring(code, i, 2), 16, 10).try_cast("double") / 255 for i in (1, 3, 5)))
    pattern = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    return F.when(code != "", of_hex).when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, i).try_cast("double") / 255 for i in (1, 2, 3))))


def content_hash(*fields: Column, size: int = 8) -> Column:
    """The first digits of the SHA-256 of the fields as JSON, null fields left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, size)


def canonical_map(m: Column) -> Column:
    """A map as a string that does not depend on the order of its entries."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def shuffle_key(seed: int, *keys: Column) -> Column:
    """A key whose order is a fixed shuffle; equal for equal seeds and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed up to 15, beyond by the asymptotic series, whose error is below 1e-11."""
    x = m.cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(m, F.lit(16)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, j: s + 1 / j)
    many = F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(m < 1, F.lit(0.0)).when(m < 16, few).otherwise(many)


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether two numbers are equal up to a tolerance; NaN equals NaN, null equals null."""
    near = F.abs(a - b) <= absolute + relative * F.abs(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(near)


def two_sides(text: Column, separator: str = ":") -> tuple[Column, Column]:
    """What stands before and after the first separator; an error if either is empty."""
    at = F.locate(separator, text)
    left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(separator), F.length(text))
    whole = (at > 1) & (F.length(right) > 0)
    return tuple(F.when(whole, side).otherwise(F.raise_error(F.concat(F.lit("two sides are missing in "), text))) for side in (left, right))


def canonical(value: Column, kind: DataType, unordered: bool = False) -> Column:
    """A text that is equal for values that are equal whatever the order of a map's entries: maps by sorted entries,
    structs by fields, arrays in order (if unordered, as sets: sorted, without repeats); all NaN are equal, and so are
    -0.0 and 0.0. Values of different kinds differ. Works on any nesting, in one expression."""

    def joined(parts: Column, left: str, right: str) -> Column:
        return F.concat(F.lit(left), F.array_join(parts, ","), F.lit(right))

    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f"{f.name}="), canonical(value.getField(f.name), f.dataType, unordered)) for f in kind.fields]
        text = joined(F.array(*fields) if fields else F.array().cast("array<string>"), "(", ")")
    elif isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(canonical(e["key"], kind.keyType, unordered), F.lit("="), canonical(e["value"], kind.valueType, unordered)))
        text = joined(F.array_sort(entries), "{", "}")
    elif isinstance(kind, ArrayType):
        parts = F.transform(value, lambda x: canonical(x, kind.elementType, unordered))
        text = joined(F.array_sort(F.array_distinct(parts)), "<", ">") if unordered else joined(parts, "[", "]")
    elif isinstance(kind, (FloatType, DoubleType)):
        text = F.concat(F.lit("f:"), F.when(F.isnan(value), F.lit("nan")).when(value == 0, F.lit("0.0")).otherwise(value.cast("double").cast("string")))
    elif isinstance(kind, BinaryType):
        text = F.concat(F.lit("x:"), F.hex(value))
    elif isinstance(kind, StringType):
        text = F.concat(F.lit("s"), F.length(value).cast("string"), F.lit(":"), value)
    else:
        short = {"boolean": "b:", "byte": "i:", "short": "i:", "integer": "i:", "long": "i:"}.get(kind.typeName(), f"{kind.simpleString()}:")
        text = F.concat(F.lit(short), value.cast("string"))
    return F.when(value.isNull(), F.lit("n")).otherwise(text)


def canonical_hash(df: DataFrame, columns: list[str], unordered: bool = False) -> Column:
    """The SHA-256 of the columns' canonical text."""
    return F.sha2(F.concat_ws(";", *(canonical(F.col(c), df.schema[c].dataType, unordered) for c in columns)), 256)
