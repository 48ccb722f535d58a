"""Scalar vocabulary as built-in Spark expressions, by group.  Nulls in give nulls out unless said otherwise."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit

# ---- operators -------------------------------------------------------------------------------


def eq_missing(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def ne_missing(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def floor_div(a: Column, b: Column) -> Column:
    """Division rounded down; null by zero.  Exact for whole numbers of any size."""
    whole = [F.typeof(x).isin("tinyint", "smallint", "int", "bigint") for x in (a, b)]
    x, y = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    exact = F.call_function("div", x, y) - F.when((x % y != 0) & ((x < 0) != (y < 0)), 1).otherwise(0)
    return F.when(b != 0, F.when(whole[0] & whole[1], exact).otherwise(F.floor(a / b)))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null by zero."""
    return F.when(b != 0, ((a % b) + b) % b)


def xor(a: Column, b: Column) -> Column:
    return (a | b) & ~(a & b)


OPERATORS = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge, "add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": operator.truediv, "and": operator.and_, "or": operator.or_, "xor": xor, "floordiv": floor_div, "mod": modulo, "eq_missing": eq_missing, "ne_missing": ne_missing}

# ---- boolean ---------------------------------------------------------------------------------


def is_between(x: Column, low, high, closed: str = "both") -> Column:
    """``closed``: both, left, right or none."""
    a = x >= low if closed in ("both", "left") else x > low
    return a & (x <= high if closed in ("both", "right") else x < high)


BOOLEAN = {
    "any": F.bool_or, "all": F.bool_and, "is_null": Column.isNull, "is_not_null": Column.isNotNull, "is_nan": F.isnan, "is_not_nan": lambda x: ~F.isnan(x),
    "is_finite": lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")), "is_infinite": lambda x: F.abs(x) == float("inf"), "is_between": is_between,
    "is_in": lambda x, values: x.isin(list(values)), "not": operator.invert, "fill_null": lambda x, v: F.coalesce(x, lit(v)),
    "all_horizontal": lambda *c: reduce(operator.and_, c), "any_horizontal": lambda *c: reduce(operator.or_, c),
    "is_first_distinct": lambda x, order: F.row_number().over(_win(x).orderBy(order)) == 1, "is_last_distinct": lambda x, order: F.row_number().over(_win(x).orderBy(order.desc())) == 1,
    "is_unique": lambda x: F.count(lit(1)).over(_win(x)) == 1, "is_duplicated": lambda x: F.count(lit(1)).over(_win(x)) > 1,
}


def _win(x: Column):
    from pyspark.sql import Window

    return Window.partitionBy(x)


# ---- strings ---------------------------------------------------------------------------------


def pad(x: Column, n: int, fill: str, left: bool) -> Column:
    """Pads only; a longer text is not cut."""
    width = F.greatest(F.char_length(x), lit(n))
    return F.lpad(x, width, lit(fill)) if left else F.rpad(x, width, lit(fill))


def zfill(x: Column, n: int) -> Column:
    """Zeros after a leading sign."""
    sign = F.when(F.substring(x, 1, 1).isin("+", "-"), F.substring(x, 1, 1)).otherwise("")
    return F.concat(sign, F.lpad(F.substring(x, F.char_length(sign) + 1, F.char_length(x)), F.greatest(lit(n) - F.char_length(sign), F.char_length(x) - F.char_length(sign)), lit("0")))


def replace_many(x: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        x = F.replace(x, lit(a), lit(b))
    return x


def split_exact(x: Column, by: str, n: int) -> Column:
    """A struct of n + 1 parts, null where there are fewer."""
    parts = F.split(x, _quoted(by), -1)
    return F.struct(*(F.get(parts, lit(i)).alias(f"field_{i}") for i in range(n + 1)))


def split_n(x: Column, by: str, n: int) -> Column:
    """A struct of n parts, the last with all the rest."""
    parts = F.split(x, _quoted(by), n)
    return F.struct(*(F.get(parts, lit(i)).alias(f"field_{i}") for i in range(n)))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


STRING = {
    "concat_horizontal": lambda *c: F.concat_ws("", *c), "concat_vertical": lambda x, sep: F.listagg(x, lit(sep)), "contains": Column.contains, "contains_regex": Column.rlike, "count_matches": lambda x, p: F.regexp_count(x, lit(p)),
    "ends_with": Column.endswith, "starts_with": Column.startswith, "extract": lambda x, p, g=1: F.regexp_extract(x, p, g), "extract_all": lambda x, p: F.regexp_extract_all(x, lit(p), lit(0)),
    "extract_groups": lambda x, p, n: F.struct(*(F.regexp_extract(x, p, i).alias(str(i)) for i in range(1, n + 1))), "find": lambda x, p: F.when(x.rlike(p), F.regexp_instr(x, lit(p)) - 1),
    "to_integer": lambda x, base=10: F.expr("1") * F.conv(x, base, 10).try_cast("bigint"), "len_bytes": F.octet_length, "len_chars": F.char_length, "lower": F.lower, "upper": F.upper, "title": F.initcap,
    "json_decode": F.from_json, "json_path_match": F.get_json_object, "replace": lambda x, p, r: F.regexp_replace(x, p, r), "replace_literal": lambda x, a, b: F.replace(x, lit(a), lit(b)), "reverse": F.reverse,
    "pad_start": lambda x, n, f=" ": pad(x, n, f, True), "pad_end": lambda x, n, f=" ": pad(x, n, f, False), "slice": lambda x, o, n: F.substring(x, o + 1, n), "head": lambda x, n: F.left(x, lit(n)), "tail": lambda x, n: F.right(x, lit(n)),
    "hex_encode": lambda x: F.lower(F.hex(x)), "hex_decode": F.unhex, "base64_encode": lambda x: F.base64(x.cast("binary")), "base64_decode": F.unbase64,
    "strip_chars": lambda x, c=" ": F.btrim(x, lit(c)), "strip_chars_start": lambda x, c=" ": F.ltrim(x, lit(c)), "strip_chars_end": lambda x, c=" ": F.rtrim(x, lit(c)),
    "strip_prefix": lambda x, p: F.when(x.startswith(p), F.substring(x, len(p) + 1, 1 << 30)).otherwise(x), "strip_suffix": lambda x, p: F.when(x.endswith(p), F.left(x, F.char_length(x) - len(p))).otherwise(x),
    "split": lambda x, by: F.split(x, _quoted(by), -1), "split_exact": split_exact, "splitn": split_n, "strptime": lambda x, f: F.try_to_timestamp(x, lit(f)).cast("timestamp_ntz"), "to_decimal": lambda x, p=38, s=2: x.try_cast(f"decimal({p},{s})"),
    "zfill": zfill, "contains_any": lambda x, many: reduce(operator.or_, [x.contains(m) for m in many]), "replace_many": replace_many, "extract_many": lambda x, many: F.regexp_extract_all(x, lit("|".join(map(_quoted, many))), lit(0)),
    "find_many": lambda x, many: F.array_compact(F.array(*(F.when(F.locate(m, x) > 0, F.locate(m, x) - 1) for m in many))), "escape_regex": lambda x: F.regexp_replace(x, r"([\\.+*?()|\[\]{}^$])", r"\\$1"),
}

# ---- lists and arrays --------------------------------------------------------------------------


def _sum(x: Column) -> Column:
    return F.aggregate(F.filter(x, lambda v: v.isNotNull()), lit(0.0), lambda a, v: a + v)


def _mean(x: Column) -> Column:
    n = F.size(F.array_compact(x))
    return F.when(n > 0, _sum(x) / n)


def _var(x: Column, ddof: int = 1) -> Column:
    n, m = F.size(F.array_compact(x)), _mean(x)
    return F.when(n > ddof, F.aggregate(F.array_compact(x), lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (n - ddof))


def _median(x: Column) -> Column:
    s = F.sort_array(F.array_compact(x))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


LIST = {
    "len": F.size, "min": F.array_min, "max": F.array_max, "sum": _sum, "mean": _mean, "median": _median, "var": _var, "std": lambda x, ddof=1: F.sqrt(_var(x, ddof)), "unique": F.array_distinct, "n_unique": lambda x: F.size(F.array_distinct(x)),
    "any": lambda x: F.exists(x, lambda v: v), "all": lambda x: F.forall(x, lambda v: v), "sort": F.sort_array, "reverse": F.reverse, "arg_min": lambda x: F.array_position(x, F.array_min(x)) - 1, "arg_max": lambda x: F.array_position(x, F.array_max(x)) - 1,
    "get": lambda x, i: F.get(x, lit(i)) if i >= 0 else F.get(x, F.size(x) + i), "join": F.array_join, "contains": F.array_contains, "count_matches": lambda x, v: F.size(F.filter(x, lambda y: y == v)),
    "shift": lambda x, n: F.transform(x, lambda v, i: F.when((i - n >= 0) & (i - n < F.size(x)), F.get(x, i - n))), "explode": F.explode, "concat": F.concat, "drop_nulls": F.array_compact, "sample": lambda x, n: F.slice(F.shuffle(x), 1, n),
    "slice": lambda x, o, n: F.slice(x, o + 1, n), "head": lambda x, n: F.slice(x, 1, n), "gather": lambda x, ix: F.transform(ix, lambda i: F.get(x, i)), "gather_every": lambda x, n: F.filter(x, lambda v, i: i % n == 0),
    "diff": lambda x: F.transform(x, lambda v, i: F.when(i > 0, v - F.get(x, i - 1))), "union": F.array_union, "intersection": F.array_intersect, "difference": F.array_except, "to_struct": lambda x, n: F.struct(*(F.get(x, lit(i)).alias(f"field_{i}") for i in range(n))),
}

# ---- times -------------------------------------------------------------------------------------


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def truncate(x: Column, micros: int) -> Column:
    """Down to a multiple of ``micros`` since 1970."""
    t = _micros(x)
    return F.timestamp_micros(t - F.pmod(t, lit(micros))).cast("timestamp_ntz")


TEMPORAL = {
    "millennium": lambda x: F.ceil(F.year(x) / 1000), "century": lambda x: F.ceil(F.year(x) / 100), "year": F.year, "is_leap_year": lambda x: (F.year(x) % 4 == 0) & ((F.year(x) % 100 != 0) | (F.year(x) % 400 == 0)), "iso_year": lambda x: F.extract(lit("YEAROFWEEK"), x),
    "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "weekday": lambda x: F.weekday(x) + 1, "day": F.dayofmonth, "ordinal_day": F.dayofyear, "date": F.to_date, "hour": F.hour, "minute": F.minute, "second": F.second,
    "time": lambda x: F.date_format(x, "HH:mm:ss.SSSSSS"), "millisecond": lambda x: F.floor(F.pmod(_micros(x), lit(1_000_000)) / 1000), "microsecond": lambda x: F.pmod(_micros(x), lit(1_000_000)), "nanosecond": lambda x: F.pmod(_micros(x), lit(1_000_000)) * 1000,
    "total_days": lambda a, b: F.floor((_micros(b) - _micros(a)) / 86_400_000_000), "total_hours": lambda a, b: F.floor((_micros(b) - _micros(a)) / 3_600_000_000), "total_minutes": lambda a, b: F.floor((_micros(b) - _micros(a)) / 60_000_000),
    "total_seconds": lambda a, b: F.floor((_micros(b) - _micros(a)) / 1_000_000), "total_milliseconds": lambda a, b: F.floor((_micros(b) - _micros(a)) / 1000), "total_microseconds": lambda a, b: _micros(b) - _micros(a), "total_nanoseconds": lambda a, b: (_micros(b) - _micros(a)) * 1000,
    "to_string": F.date_format, "timestamp": _micros, "truncate": truncate, "date_trunc": lambda x, unit: F.date_trunc(unit, x), "offset_by": lambda x, **k: x + F.make_dt_interval(*(lit(k.get(n, 0)) for n in ("days", "hours", "mins", "secs"))),
    "offset_months": lambda x, n: x + F.make_ym_interval(lit(0), lit(n)), "month_start": lambda x: F.trunc(x, "month"), "month_end": F.last_day, "round": lambda x, micros: truncate(F.timestamp_micros(_micros(x) + micros // 2), micros),
    "convert_time_zone": lambda x, a, b: F.convert_timezone(lit(a), lit(b), x), "replace_time_zone": F.to_utc_timestamp, "combine": lambda d, h, m, s: F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), h, m, s), "datetime": F.make_timestamp_ntz,
    "duration": lambda d, h, m, s: F.make_dt_interval(d, h, m, s), "base_utc_offset": lambda x, zone: (F.unix_micros(F.from_utc_timestamp(x, zone)) - _micros(x)) / 1_000_000, "replace": lambda x, year: F.make_timestamp_ntz(lit(year), F.month(x), F.dayofmonth(x), F.hour(x), F.minute(x), F.second(x)),
}

# ---- structs, bytes, bits, angles ----------------------------------------------------------------

STRUCT = {
    "field": lambda x, name: x.getField(name), "with_field": lambda x, name, v: x.withField(name, v), "json_encode": F.to_json, "rename_fields": lambda x, old, new: F.struct(*(x.getField(o).alias(n) for o, n in zip(old, new))),
    "prefix_fields": lambda x, names, p: F.struct(*(x.getField(n).alias(p + n) for n in names)), "suffix_fields": lambda x, names, s: F.struct(*(x.getField(n).alias(n + s) for n in names)),
}
BINARY = {
    "contains": Column.contains, "starts_with": Column.startswith, "ends_with": Column.endswith, "size": F.octet_length, "hex_encode": lambda x: F.lower(F.hex(x)), "hex_decode": F.unhex, "base64_encode": F.base64, "base64_decode": F.unbase64,
    "from_buffer": lambda x: F.conv(F.hex(x), 16, 10).cast("decimal(20,0)"),
}


def _bits(x: Column, width: int) -> Column:
    return F.lpad(F.right(F.bin(x), lit(width)), width, lit("0"))


BITWISE = {
    "count_ones": F.bit_count, "count_zeros": lambda x, width=64: width - F.bit_count(x), "leading_zeros": lambda x, width=64: F.char_length(F.regexp_extract(_bits(x, width), "^0*", 0)), "leading_ones": lambda x, width=64: F.char_length(F.regexp_extract(_bits(x, width), "^1*", 0)),
    "trailing_zeros": lambda x, width=64: F.char_length(F.regexp_extract(_bits(x, width), "0*$", 0)), "trailing_ones": lambda x, width=64: F.char_length(F.regexp_extract(_bits(x, width), "1*$", 0)), "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor,
}
TRIGONOMETRIC = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "degrees": F.degrees, "radians": F.radians}
