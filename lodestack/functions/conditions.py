"""Column functions with the semantics of conditions: 0-based positions, -1 for missing, '' for absent text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"\s"


def text(c: Column) -> Column:
    """A missing value is the empty text."""
    return F.coalesce(c, F.lit(""))


def size(c: Column, kind: str = "string") -> Column:
    return F.coalesce(F.char_length(c) if kind == "string" else F.size(c), F.lit(0)).cast("long")


def contains(c: Column, part: str) -> Column:
    return text(c).contains(part)


def starts_with(c: Column, part: str) -> Column:
    return text(c).startswith(part)


def ends_with(c: Column, part: str) -> Column:
    return text(c).endswith(part)


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere."""
    return text(c).rlike(pattern)


def exists(c: Column, test) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def every(c: Column, test) -> Column:
    return F.coalesce(F.forall(c, test), F.lit(True))


def keep(c: Column, test) -> Column:
    return F.filter(c, test)


def each(c: Column, f) -> Column:
    return F.transform(c, f)


def has_key(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def is_in(value: Column, items: Column) -> Column:
    return F.coalesce(F.array_contains(items, value), F.lit(False))


def field(json: Column, path: str) -> Column:
    """A field of JSON text by dotted path with [i] indexes; missing: ''."""
    return text(F.get_json_object(json, f"$.{path}"))


def char_at(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1)


def format_text(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def index_of(c: Column, part: str) -> Column:
    return (F.instr(c, part) - 1).cast("long")


def last_index_of(c: Column, part: str) -> Column:
    n = F.char_length(c) - F.instr(F.reverse(c), part[::-1]) - len(part) + 1
    return F.when(F.instr(c, part) > 0, n).otherwise(-1).cast("long")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def literal_pattern(part: str) -> str:
    return "".join(f"\\{x}" if x in r"\.[]{}()*+-?^$|" else x for x in part)


def replace(c: Column, old: str, new: str, limit: int = -1) -> Column:
    if limit < 0:
        return F.replace(c, F.lit(old), F.lit(new))
    return F.array_join(F.split(c, literal_pattern(old), limit + 1), new)


def split(c: Column, separator: str) -> Column:
    return F.split(c, literal_pattern(separator), -1)


def substring(c: Column, start: int, end: int | None = None) -> Column:
    return F.substring(c, start + 1, (end if end is not None else 2**31 - 1 - start) - start)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def reverse(c: Column) -> Column:
    return F.reverse(c)


def join(c: Column, separator: str = "") -> Column:
    return F.array_join(c, separator)


def to_int(c: Column) -> Column:
    return c.try_cast("bigint")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_uint(c: Column) -> Column:
    """An integer of 64 bits without a sign, as a decimal; null where it is negative, too large or no number."""
    n = c.try_cast("decimal(20,0)")
    return F.when(n.between(0, F.lit(str(2**64 - 1)).cast("decimal(20,0)")), n)


def to_bool(c: Column) -> Column:
    return F.when(c == "true", True).when(c == "false", False)


def to_string(c: Column) -> Column:
    return c.cast("string")


def to_bytes(c: Column) -> Column:
    return c.cast("string").cast("binary")


def to_timestamp(c: Column) -> Column:
    """RFC 3339 text; null where it is none."""
    return F.try_to_timestamp(c)


# The units of durations in seconds; microseconds are written in three ways.
UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us|\u00b5s|\u03bcs": 0.000001, "ns": 0.000000001}
AMOUNT = r"\d+(?:\.\d*)?|\.\d+"


def to_duration(c: Column) -> Column:
    """Seconds of a duration like 1h30m or -1.5s, all amounts of a unit added up; 0 needs no unit; null where it is none."""
    amounts = lambda unit: F.regexp_extract_all(c, F.lit(rf"({AMOUNT})(?:{unit})(?![a-z\u00b5\u03bc])"), 1)
    total = sum((F.aggregate(amounts(u), F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0))) * F.lit(s) for u, s in UNITS.items()), F.lit(0.0))
    whole = c.rlike(rf"\A[+-]?(?:0|(?:(?:{AMOUNT})(?:{'|'.join(UNITS)}))+)\z")
    return F.when(whole, F.when(c.startswith("-"), -total).otherwise(total))


def type_of(c: Column) -> Column:
    """The name of a column's type in conditions."""
    names = {"bigint": "int", "int": "int", "double": "double", "float": "double", "boolean": "bool", "string": "string", "binary": "bytes", "void": "null_type"}
    out = F.when(F.typeof(c).startswith("array"), "list").when(F.typeof(c).startswith("map") | F.typeof(c).startswith("struct"), "map")
    for k, v in names.items():
        out = out.when(F.typeof(c) == k, v)
    return out.otherwise(F.typeof(c))


def truthy(c: Column, kind: str) -> Column:
    """A boolean itself; text unless blank or 'false' in any case; null is false; any other value, 0 too, is true."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(trim(c) != "", F.lit(False)) & (F.lower(trim(text(c))) != "false")
    return c.isNotNull()


def plain_decimal(c: Column) -> Column:
    """A double as the shortest decimal that reads back, without an exponent: 0.5, 0.000000000001, 1000000; NaN, +Inf and -Inf by name."""
    t = c.cast("string")
    whole = F.when(t.endswith(".0"), F.substring_index(t, ".", 1)).otherwise(t)
    # With an exponent, [-]d.dddE[-]n: the digits and where the point stands among them; a fraction of 0 alone is none. No patterns: they cost most of the time.
    mantissa = F.substring_index(F.ltrim(t, F.lit("-")), "E", 1)
    digits = F.when(mantissa.endswith(".0"), F.substring_index(mantissa, ".", 1)).otherwise(F.replace(mantissa, F.lit("."), F.lit("")))
    point = F.substring_index(t, "E", -1).try_cast("int") + 1
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, F.lit("0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    named = F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf")
    signed = F.when(t.contains("E"), F.concat(F.when(t.startswith("-"), "-").otherwise(""), body)).otherwise(whole)
    return F.when(c.isNotNull(), F.coalesce(named, signed))


def to_text(c: Column, kind: str) -> Column:
    """Null is '', booleans true/false, whole numbers plain, containers JSON. Doubles are the shortest plain decimals that read back."""
    if kind in ("string", "boolean", "int", "bigint"):
        return text(c.cast("string"))
    if kind in ("double", "float"):
        return text(plain_decimal(c))
    return text(F.to_json(c))
