"""Scalar functions of the query language as Column expressions. Failed conversions,
missing items and divisions by zero give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def literal(x) -> Column:
    if isinstance(x, (list, tuple)):
        return F.array(*[literal(y) for y in x])
    if isinstance(x, dict):
        return F.struct(*[literal(v).alias(k) for k, v in x.items()])
    return F.lit(x)


def item(x: Column, i: Column) -> Column:
    """The i-th item from 0; negative places count from the end; none: null."""
    return F.when(i >= 0, F.get(x, i.cast("int"))).otherwise(F.get(x, (F.size(x) + i).cast("int")))


def sliced(x: Column, low: Column | None, high: Column | None) -> Column:
    n = F.size(x)
    low = F.lit(0) if low is None else F.when(low < 0, F.greatest(n + low, F.lit(0))).otherwise(low)
    high = n if high is None else F.when(high < 0, n + high).otherwise(F.least(high, n))
    return F.slice(x, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))


def arithmetic(op: str, x: Column, y: Column, kx: T.DataType, ky: T.DataType) -> Column:
    if op == "+" and (isinstance(kx, T.ArrayType) or isinstance(ky, T.ArrayType)):
        return F.concat(x if isinstance(kx, T.ArrayType) else F.array(x), y if isinstance(ky, T.ArrayType) else F.array(y))
    if op == "+" and (isinstance(kx, T.StringType) or isinstance(ky, T.StringType)):
        return F.concat(x.cast("string"), y.cast("string"))
    if op == "/" and isinstance(kx, INTEGRAL) and isinstance(ky, INTEGRAL):
        return F.when(y != 0, F.call_function("div", x, F.when(y != 0, y)))
    if op == "/":
        return F.try_divide(x.cast("double"), y.cast("double"))
    if op == "%":
        return F.try_mod(x, y)
    if op == "^":
        return F.pow(x.cast("double"), y.cast("double"))
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()


def component(x: Column, kind: T.DataType, name: str) -> Column:
    """Parts of dates, timestamps and durations."""
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "dayofweek": F.dayofweek, "week": F.weekofyear, "ordinalday": F.dayofyear}
    if isinstance(kind, T.DayTimeIntervalType):
        seconds = F.unix_micros(F.timestamp_micros(F.lit(0)) + x) / 1_000_000
        size = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "milliseconds": 0.001}.get(name.lower())
        return F.floor(seconds / size) if size else F.lit(None)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and name.lower() in parts:
        return parts[name.lower()](x)
    if isinstance(kind, (T.DateType, T.TimestampType)) and name.lower() == "epochseconds":
        return F.unix_timestamp(x.cast("timestamp"))
    return F.lit(None)


def distance(a: Column, b: Column) -> Column:
    """Between points with longitude and latitude: metres on the sphere; else Euclidean
    over x and y."""
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371009.0) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(d_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def parse_duration(x: Column) -> Column:
    """Seconds of an ISO-8601 duration of days and smaller; anything else: null."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(x.rlike(pattern) & (x != "P"), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def call(name: str, args: list[Column], kinds: list[T.DataType]) -> Column:
    """A function by its lower-case name."""
    from ..cypher.parser import CypherError

    x = args[0] if args else None
    kind = kinds[0] if kinds else None
    numeric = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sign": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan, "radians": F.radians, "degrees": F.degrees, "asin": F.asin, "acos": F.acos, "atan": F.atan}
    text = {"tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim}
    if name in numeric:
        return numeric[name](x)
    if name in text:
        return text[name](x)
    if name == "round":
        return F.round(x, 0) if len(args) == 1 else F.round(x, args[1])
    if name in ("size", "length"):
        return (F.when(x.isNotNull(), F.size(x)) if isinstance(kind, T.ArrayType) else F.length(x)).cast("long")
    if name == "coalesce":
        return F.coalesce(*args)
    if name == "tostring":
        return x.cast("string")
    if name == "tointeger":
        return x.try_cast("double").cast("long") if isinstance(kind, T.StringType) else x.try_cast("long")
    if name == "tofloat":
        return x.try_cast("double")
    if name == "toboolean":
        return x.try_cast("boolean")
    if name == "substring":
        return F.substring(x, args[1] + 1, args[2]) if len(args) > 2 else F.substring(x, args[1] + 1, F.length(x))
    if name == "left":
        return F.left(x, args[1])
    if name == "right":
        return F.right(x, args[1])
    if name == "replace":
        return F.replace(x, args[1], args[2])
    if name == "split":
        return F.split(x, args[1])
    if name == "reverse":
        return F.reverse(x)
    if name == "head":
        return F.get(x, F.lit(0))
    if name == "last":
        return F.try_element_at(x, F.lit(-1))
    if name == "tail":
        return sliced(x, F.lit(1), None)
    if name == "range":
        step = args[2] if len(args) > 2 else F.lit(1)
        return F.sequence(x, args[1], step)
    if name == "valuetype":
        return F.lit(kind.simpleString().upper())
    if name in ("date", "datetime", "localdatetime"):
        target = "date" if name == "date" else "timestamp"
        if x is None:
            return F.current_date() if name == "date" else F.current_timestamp()
        return x.try_cast(target)
    if name == "duration":
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), parse_duration(x))
    if name in ("duration.between", "duration.inseconds"):
        return args[1].cast("timestamp") - x.cast("timestamp")
    if name == "duration.indays":
        return F.date_diff(args[1].cast("date"), x.cast("date"))
    if name == "point":
        fields = kind.names
        if {"longitude", "latitude"} <= set(fields):
            return F.struct(x["longitude"].cast("double").alias("x"), x["latitude"].cast("double").alias("y"), F.lit(4326).alias("srid"))
        return F.struct(x["x"].cast("double").alias("x"), x["y"].cast("double").alias("y"), F.lit(7203).alias("srid"))
    if name in ("point.distance", "distance"):
        a, b = args
        return F.when(a["srid"] == 4326, haversine(a["x"], a["y"], b["x"], b["y"])).otherwise(distance(a, b))
    if name == "isempty":
        return (F.size(x) == 0) if isinstance(kind, T.ArrayType) else (x == "")
    if name == "apoc.text.levenshteinsimilarity":
        from .text import lev_similarity

        return lev_similarity(x, args[1])
    raise CypherError(f"unknown function {name}")
