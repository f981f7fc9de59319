"""Functions of other SQL dialects as Spark expressions, for names that Spark lacks or means otherwise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def iff(condition: Column, then: Column, otherwise: Column) -> Column:
    """A null condition takes the other branch."""
    return F.when(condition, then).otherwise(otherwise)


def zeroifnull(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def nullifzero(x: Column) -> Column:
    return F.when(x != 0, x)


def div0(a: Column, b: Column) -> Column:
    """0 for a division by zero; null stays null."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(a / b)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def integer_divide(a: Column, b: Column) -> Column:
    """Towards zero, as integer dialects divide."""
    return F.try_divide(a - F.try_mod(a, b), b).cast("bigint")


def strpos(text: Column, part: Column) -> Column:
    """Place of the first occurrence from 1, 0 if there is none."""
    return F.call_function("locate", part, text)


def split_part(text: Column, by: Column, n: Column) -> Column:
    return F.split_part(text, by, n)


def time_bucket(seconds: int, ts: Column) -> Column:
    """The start of the bucket of so many seconds (from 2000-01-03, as DuckDB counts) that holds a timestamp without zone."""
    base = F.lit("2000-01-03 00:00:00").cast("timestamp_ntz")
    passed = F.timestamp_diff("SECOND", base, ts)
    return F.timestamp_add("SECOND", (F.floor(passed / seconds) * seconds).cast("int"), base)


def date_bin(seconds: int, ts: Column, origin: str) -> Column:
    base = F.lit(origin).cast("timestamp_ntz")
    return F.timestamp_add("SECOND", (F.floor(F.timestamp_diff("SECOND", base, ts) / seconds) * seconds).cast("int"), base)


def datediff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit crossed from a to b (T-SQL, Snowflake, Redshift), not whole units passed."""
    unit = unit.upper()
    if unit == "YEAR":
        return F.year(b) - F.year(a)
    if unit == "MONTH":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return F.timestamp_diff(unit, F.date_trunc(unit, a), F.date_trunc(unit, b))


def generate_series(a: Column, b: Column, step: Column | None = None) -> Column:
    """Inclusive; empty where the step leads away."""
    step = F.lit(1) if step is None else step
    reachable = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    return F.when(reachable, F.sequence(a, b, step)).otherwise(F.array().cast("array<bigint>"))


def list_contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def decode(x: Column, *pairs: Column) -> Column:
    """Oracle's DECODE: nulls are equal; an odd last argument is the default."""
    out, rest = None, list(pairs)
    default = rest.pop() if len(rest) % 2 else F.lit(None)
    for k in range(0, len(rest), 2):
        out = F.when(x.eqNullSafe(rest[k]), rest[k + 1]) if out is None else out.when(x.eqNullSafe(rest[k]), rest[k + 1])
    return default if out is None else out.otherwise(default)


def initials(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.upper(F.substring(w, 1, 1))), "")


#: dialect name -> the function above, or the Spark function of another name with the same meaning.
MAPPING: dict[str, Callable[..., Column]] = {
    "iff": iff, "zeroifnull": zeroifnull, "nullifzero": nullifzero, "div0": div0, "safe_divide": safe_divide, "strpos": strpos, "charindex": lambda p, t: strpos(t, p),
    "position": lambda p, t: strpos(t, p), "instr": F.instr, "len": F.length, "datalength": F.octet_length, "isnull": F.coalesce, "ifnull": F.coalesce, "nvl": F.coalesce, "getdate": F.current_timestamp,
    "sysdate": F.current_timestamp, "list_contains": F.array_contains, "list_sort": F.array_sort, "list_distinct": F.array_distinct, "list_concat": F.concat, "array_length": F.size,
    "array_size": F.size, "cardinality": F.size, "list_value": F.array, "array_construct": F.array, "object_construct": F.create_map, "map_agg": lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v))),
    "array_agg": F.collect_list, "group_concat": F.listagg, "string_agg": F.listagg, "approx_distinct": F.approx_count_distinct, "any_value": F.any_value, "editdistance": F.levenshtein,
    "to_hex": F.hex, "from_hex": F.unhex, "md5_hex": F.md5, "sha2_hex": F.sha2, "regexp_substr": lambda t, p: F.nullif(F.regexp_extract(t, p, 0), F.lit("")), "regexp_matches": F.rlike,
    "time_bucket": time_bucket, "date_bin": date_bin, "datediff": datediff, "generate_series": generate_series, "decode": decode, "startswith": F.startswith, "endswith": F.endswith, "contains": F.contains,
    "square": lambda x: x * x, "trunc": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)), "truncate": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)), "stdev": F.stddev, "var": F.variance,
}


def translate(name: str, *args) -> Column:
    """A dialect's call as a Spark expression: by MAPPING, else the Spark function of that name; unknown names raise."""
    key = name.lower()
    return MAPPING[key](*args) if key in MAPPING else F.call_function(key, *args)


@dataclass(frozen=True)
class Behaviour:
    """How a dialect divides whole numbers, and where nulls stand in ascending order by default."""

    division: str  # float, integer or decimal
    nulls: str  # first or last


#: Dialect -> behaviour.
BEHAVIOUR = {
    "databricks": Behaviour("float", "first"), "tsql": Behaviour("integer", "first"), "snowflake": Behaviour("decimal", "last"), "bigquery": Behaviour("float", "first"), "redshift": Behaviour("integer", "last"),
    "postgres": Behaviour("integer", "last"), "duckdb": Behaviour("float", "last"), "trino": Behaviour("integer", "last"), "sqlite": Behaviour("integer", "first"), "mysql": Behaviour("decimal", "first"),
}


def divide(dialect: str, a: Column, b: Column) -> Column:
    """a / b of whole numbers as the dialect divides them; null for a division by zero."""
    kind = BEHAVIOUR[dialect].division
    if kind == "integer":
        return integer_divide(a, b).cast("double")
    quotient = F.when(b != 0, a / b)
    return F.round(quotient, 4 if dialect == "mysql" else 6) if kind == "decimal" else quotient


def ascending(dialect: str, x: Column) -> Column:
    """x in the dialect's default ascending order."""
    return x.asc_nulls_first() if BEHAVIOUR[dialect].nulls == "first" else x.asc_nulls_last()


def sqlite_quote(text: Column) -> Column:
    """A text as an SQL literal; null is NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
