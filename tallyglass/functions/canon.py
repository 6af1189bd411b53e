"""Canonical bytes of values as Column expressions.

A field is F0, its name's length as 32-bit big-endian, its name, and its value; a
value is a tag and, but for null and bool, a length and text. Every encoder is
null-safe, since concat isn't. The encoder is chosen from the column's type when the
plan is made, so all of it stays in generated code.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import CanonSpec, ReconError, UnsupportedCanonVersion

# The tags of the canonical form.
FIELD, NULL, BOOL, STRING, DECIMAL, TIMESTAMP, ARRAY, MAP = "F0", "A0", "A1", "A2", "A3", "A4", "A5", "A6"


def binary(hexa: str) -> Column:
    return F.unhex(F.lit(hexa))


#: The 32-bit forms of the lengths that nearly all values have, one after another.
_SHORT = b"".join(i.to_bytes(4, "big") for i in range(256))


def u32(n: Column, short: bool = False) -> Column:
    """n as 32 bits; short: n is under 256 whatever the row, which is less generated code."""
    few = F.substring(F.lit(_SHORT), F.shiftleft(n.cast("int"), 2) + 1, F.lit(4))
    return few if short else F.when(n < 256, few).otherwise(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")))


def framed(tag: str, data: Column) -> Column:
    return F.concat(binary(tag), u32(F.octet_length(data)), data)


def _normal(a: pa.Array) -> pa.Array:
    """Normal form C of all strings in an Arrow array, also within lists and structs."""
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        other = pc.fill_null(pc.invert(pc.string_is_ascii(a)), False)
        if not pc.any(other).as_py():
            return a
        fixed = [unicodedata.normalize("NFC", x) for x in a.filter(other).to_pylist()]
        return pc.replace_with_mask(a, other, pa.array(fixed, a.type))
    if pa.types.is_list(a.type):
        items = _normal(a.flatten())
        sizes = pc.fill_null(pc.list_value_length(a), 0)
        ends = pc.cumulative_sum(sizes.cast(pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, items, type=a.type, mask=a.is_null())
    if pa.types.is_struct(a.type):
        return pa.StructArray.from_arrays([_normal(x) for x in a.flatten()], fields=list(a.type), mask=a.is_null())
    return a


def has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    return any(has_text(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.StringType)


def nfc(c: Column, kind: T.DataType, ascii_only: bool = False) -> Column:
    """Normal form C, by Arrow batches; with ascii_only no other form is expected and no Python runs."""
    return c if ascii_only or not has_text(kind) else F.arrow_udf(_normal, kind)(c)


def canonical_decimal(text: Column, scale: int = 6) -> Column:
    """Trimmed text cut (not rounded) to scale fraction digits; an error where it is no plain decimal."""
    s, form = F.trim(text), r"^([0-9-]+)(?:\.([0-9]*))?$"
    whole = F.regexp_extract(s, form, 1)
    out = whole if scale == 0 else F.concat(whole, F.lit("."), F.rpad(F.substring(F.regexp_extract(s, form, 2), 1, scale), scale, "0"))
    return F.when(whole != "", out).otherwise(F.when(text.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("invalid decimal: "), text)).cast("string")))


def double_text(c: Column) -> Column:
    """A double without exponent, like 12.5 or 100000000; shortest digits that read back."""
    s = c.cast("string")
    mantissa, exponent = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).cast("int")
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(mantissa, "[-.]", "")
    point = F.length(F.regexp_replace(F.substring_index(mantissa, ".", 1), "-", "")) + exponent
    large = F.concat(F.rpad(F.substring(digits, F.lit(1), point), point, "0"), F.when(F.length(digits) > point, F.concat(F.lit("."), F.substring(digits, point + 1, F.length(digits)))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    wide = F.concat(sign, F.when(point > 0, large).otherwise(small))
    plain = F.when(F.instr(s, "E") > 0, wide).otherwise(s)
    return F.when(F.instr(plain, ".") > 0, F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")).otherwise(plain)


def double_decimal(c: Column, scale: int) -> Column:
    """canonical_decimal of double_text, by way of DECIMAL(38, 18), which keeps a double's shortest digits and is small code. An error from 1e38 on."""
    fine, coarse = c.try_cast("decimal(38,18)").cast("string"), c.try_cast("decimal(38,0)").cast("string")
    cut = F.left(fine, F.length(fine) - F.lit(18 - min(scale, 18) + (scale == 0)))
    whole = F.concat(coarse, F.lit("." + "0" * scale if scale else ""))
    return F.coalesce(F.concat(cut, F.lit("0" * (scale - 18))), whole, F.when(c.isNotNull(), F.raise_error(F.lit("a double beyond 38 digits")).cast("string")))


def timestamp_text(c: Column, zoned: bool = False) -> Column:
    """UTC with microseconds. A zoned column is an instant, whatever the session's time zone; one without a zone is taken as UTC."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if zoned:  # date_format would take the session's zone
        epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        c = epoch + F.make_dt_interval(secs=(F.unix_micros(c).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    s = c.cast("timestamp_ntz").cast("string")
    fraction = F.rpad(F.when(F.instr(s, ".") > 0, F.substring_index(s, ".", -1)).otherwise(F.lit("")), 6, "0")
    return F.concat(F.replace(F.substring_index(s, ".", 1), F.lit(" "), F.lit("T")), F.lit("."), fraction, F.lit("Z"))


def normalized_timestamp(text: Column, precision: str = "micros") -> Column:
    """RFC 3339 text as UTC text with microseconds."""
    if precision != "micros":
        raise ReconError(f"unsupported timestamp precision: {precision}")
    return timestamp_text(F.to_timestamp(text), zoned=True)


def _text(c: Column, kind: T.DataType, spec: CanonSpec) -> tuple[Column, Column] | None:
    """Tag and text of a value that has such; None for other types. Strings that start with dec: or ts: are decimals and raw timestamps."""
    if isinstance(kind, T.StringType):
        dec, ts = c.startswith("dec:"), c.startswith("ts:")
        number = canonical_decimal(F.when(dec, F.substring(c, 5, 1 << 30)), spec.decimal_scale)
        return F.when(dec, binary(DECIMAL)).when(ts, binary(TIMESTAMP)).otherwise(binary(STRING)), F.when(dec, number).when(ts, F.substring(c, 4, 1 << 30)).otherwise(c)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        text = c.cast("string")
        return (binary(STRING), text) if spec.integers == "string" else (binary(DECIMAL), canonical_decimal(text, spec.decimal_scale))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return binary(DECIMAL), double_decimal(c, spec.decimal_scale)
    if isinstance(kind, T.DecimalType):
        return binary(DECIMAL), canonical_decimal(c.cast("string"), spec.decimal_scale)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return binary(TIMESTAMP), timestamp_text(c, isinstance(kind, T.TimestampType))
    return None


def _short(kind: T.DataType, spec: CanonSpec) -> bool:
    """Whether all texts of that type are under 256 bytes."""
    return not isinstance(kind, T.StringType) and spec.decimal_scale < 200


def _framed_text(tag: Column, text: Column, short: bool = False, name: str | None = None) -> Column:
    """Tag, length and text, after the field's name if there is one; tags of other types than strings are constants."""
    before = _name(name) if name is not None else None
    front = [tag] if before is None else [F.concat(before, tag)]
    return F.coalesce(F.concat(*front, u32(F.octet_length(text), short), F.encode(text, "UTF-8")), binary(NULL) if before is None else F.concat(before, binary(NULL)))


def encode_value(c: Column, kind: T.DataType, spec: CanonSpec) -> Column:
    """The canonical bytes of a value of that type."""
    return _encoded(nfc(c, kind, spec.ascii_only), kind, spec)


def _encoded(c: Column, kind: T.DataType, spec: CanonSpec) -> Column:
    """The same of a value in normal form."""
    if (text := _text(c, kind, spec)) is not None:
        return _framed_text(*text, _short(kind, spec))
    if isinstance(kind, T.NullType):
        return binary(NULL)
    if isinstance(kind, T.BooleanType):
        out = F.when(c, binary(BOOL + "01")).otherwise(F.when(~c, binary(BOOL + "00")))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: _encoded(x, kind.elementType, spec))
        if spec.array_as_set:
            items = F.array_sort(items)
        out = F.concat(binary(ARRAY), u32(F.size(c)), F.aggregate(items, F.lit(b""), lambda a, x: F.concat(a, x)))
    elif isinstance(kind, T.StructType) and spec.nested:
        names = sorted(kind.names, key=str.encode)
        out = F.concat(binary(MAP), u32(F.lit(len(names))), *(x for n in names for x in (_name(n), _encoded(c.getField(n), kind[n].dataType, spec))))
    else:
        raise ReconError(f"unsupported type of a content field: {kind.simpleString()}")
    return F.coalesce(out, binary(NULL))


def _name(name: str) -> Column:
    raw = name.encode()
    return binary(f"{FIELD}{len(raw):08x}{raw.hex()}")


def encode_fields(df: DataFrame, names: list[str], spec: CanonSpec) -> Column:
    if spec.version != 1:
        raise UnsupportedCanonVersion(f"unsupported canonicalization version: {spec.version}")
    types = {f.name: f.dataType for f in df.schema.fields}
    if missing := [n for n in names if n not in types]:
        raise ReconError(f"missing field: {missing[0]}")
    return F.concat(*(x for n in names for x in (_name(n), encode_value(F.col(f"`{n}`"), types[n], spec)))) if names else F.lit(b"")


def encoded_fields(df: DataFrame, names: list[str], spec: CanonSpec, carried: list[str]) -> DataFrame:
    """The carried columns, and for each name a column with its framed value, in steps of one projection each, so that no value is made twice."""
    encode_fields(df.limit(0), names, spec)  # the errors of a plan
    types = {f.name: f.dataType for f in df.schema.fields}
    kept = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carried)]
    x = df.select(*kept, *(nfc(F.col(f"`{n}`"), types[n], spec.ascii_only).alias(f"__v{i}") for i, n in enumerate(names)))
    kept = [F.col(f"__c{i}") for i in range(len(carried))]
    texts = {i: _text(F.col(f"__v{i}"), types[n], spec) for i, n in enumerate(names)}
    x = x.select(*kept, *(F.col(f"__v{i}") for i in texts), *(t[1].alias(f"__t{i}") for i, t in texts.items() if t is not None))
    ends = [_framed_text(t[0], F.col(f"__t{i}"), _short(types[n], spec), n) if t is not None else F.concat(_name(n), _encoded(F.col(f"__v{i}"), types[n], spec)) for (i, t), n in zip(texts.items(), names, strict=True)]
    return x.select(*(c.alias(o) for c, o in zip(kept, carried, strict=True)), *(e.alias(f"__e{i}") for i, e in enumerate(ends)))


def canon_identity(df: DataFrame, identity: list[str], spec: CanonSpec) -> Column:
    """Identity fields in the order of the rule."""
    return encode_fields(df, identity, spec)


def canon_content(df: DataFrame, fields: list[str], spec: CanonSpec) -> Column:
    """Content fields in the bytewise order of their names."""
    return encode_fields(df, sorted(fields, key=str.encode), spec)
