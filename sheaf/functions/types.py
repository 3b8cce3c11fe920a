"""Type inference, alias normalisation and the widening lattice (T1-T8, Q2 parts).

Type names are the SQL type strings the catalog stores (``bigint``,
``double precision``, ``character varying`` ...); ``to_spark_type`` maps them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sheaf.functions.dates import parse_formats, try_number

# ---- fixed values ------------------------------------------------------------
TYPE_ALIASES = {
    "int": "integer", "int4": "integer", "int8": "bigint", "int2": "smallint",
    "serial": "integer", "bigserial": "bigint", "float4": "real",
    "float8": "double precision", "float": "double precision",
    "varchar": "character varying", "char": "character", "bool": "boolean",
    "decimal": "numeric", "timestamp": "timestamp without time zone",
    "timestamptz": "timestamp with time zone",
}
# Safe widenings: from -> allowed targets.
WIDENING = {
    "smallint": ["integer", "bigint", "numeric", "text"],
    "integer": ["bigint", "numeric", "text"],
    "bigint": ["numeric", "text"],
    "numeric": ["text"],
    "real": ["double precision", "numeric", "text"],
    "double precision": ["numeric", "text"],
    "date": ["timestamp without time zone", "timestamp with time zone", "text"],
    "timestamp without time zone": ["timestamp with time zone", "text"],
    "timestamp with time zone": ["text"],
    "character varying": ["text"],
    "character": ["text"],
    "boolean": ["text"],
}
# Inference results of the heuristic cascade.
T_TEXT, T_BIGINT, T_DOUBLE, T_BOOL, T_TS = ("TEXT", "BIGINT", "DOUBLE PRECISION", "BOOLEAN",
                                            "TIMESTAMP WITHOUT TIME ZONE")
# VARCHAR sizing steps: max length <= bound -> declared size.
VARCHAR_STEPS = [(50, 100), (100, 200), (255, 500)]
# Integer ranges used to size integer columns up front.
SMALLINT_RANGE = (-32768, 32767)
INTEGER_RANGE = (-2147483648, 2147483647)
BIGINT_RANGE = (-9223372036854775808, 9223372036854775807)
# ------------------------------------------------------------------------------

def _alias_map() -> Column:
    return F.create_map(*[x for k, v in TYPE_ALIASES.items() for x in (F.lit(k), F.lit(v))])
INT_RE = r"^\s*[+-]?\d+\s*$"
TS_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
              "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd",
              "d MMM yyyy", "MMM d, yyyy", "MMM-yyyy", "MMM yyyy", "MMMM yyyy"]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def normalise_type(c: Column | str) -> Column:
    """Lower-case, trim, alias -> canonical name. Parameters like ``(100)`` and
    ``(15, 2)`` are stripped first (length/precision are compared separately)."""
    t = F.lower(F.trim(_c(c)))
    t = F.trim(F.regexp_replace(t, r"\s*\(.*\)\s*", ""))
    return F.coalesce(_alias_map()[t], t)


def normalise_type_py(t: str) -> str:
    t = re.sub(r"\s*\(.*\)\s*", "", t.strip().lower()).strip()
    return TYPE_ALIASES.get(t, t)


def varchar_length(declared: str) -> int | None:
    """n of a declared VARCHAR(n)."""
    m = re.fullmatch(r"\s*(?:varchar|character varying)\s*\(\s*(\d+)\s*\)\s*", declared, re.I)
    return int(m[1]) if m else None


def is_safe_widening_py(frm: str, to: str) -> bool:
    return normalise_type_py(to) in WIDENING.get(normalise_type_py(frm), [])


def lattice_df(spark: SparkSession) -> DataFrame:
    """T4 lattice as a small fixed dimension (24 rows; broadcast in joins)."""
    rows = [(a, b) for a, bs in WIDENING.items() for b in bs]
    return spark.createDataFrame(rows, "from_type string, to_type string")


def safe_widening(frm: Column | str, to: Column | str) -> Column:
    """T4 as an expression (lattice inlined as a literal map of arrays)."""
    m = F.create_map(*[x for k, vs in WIDENING.items()
                       for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    return F.coalesce(F.array_contains(m[normalise_type(frm)], normalise_type(to)), F.lit(False))


def spark_to_sql_type(dt: T.DataType) -> str:
    if isinstance(dt, T.ShortType) or isinstance(dt, T.ByteType):
        return "smallint"
    if isinstance(dt, T.IntegerType):
        return "integer"
    if isinstance(dt, T.LongType):
        return "bigint"
    if isinstance(dt, T.DecimalType):
        return "numeric"
    if isinstance(dt, T.FloatType):
        return "real"
    if isinstance(dt, T.DoubleType):
        return "double precision"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.TimestampNTZType):
        return "timestamp without time zone"
    if isinstance(dt, T.TimestampType):
        return "timestamp with time zone"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "text"


def to_spark_type(t: str) -> T.DataType:
    n = normalise_type_py(t)
    m = re.search(r"\((\d+)\s*,\s*(\d+)\)", t)
    return {
        "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(),
        "numeric": T.DecimalType(int(m.group(1)), int(m.group(2))) if m else T.DecimalType(38, 10),
        "real": T.FloatType(), "double precision": T.DoubleType(), "date": T.DateType(),
        "timestamp without time zone": T.TimestampNTZType(),
        "timestamp with time zone": T.TimestampType(), "boolean": T.BooleanType(),
    }.get(n, T.StringType())


def _typed_shortcut(dt: T.DataType) -> str | None:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T_BIGINT
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return T_DOUBLE
    if isinstance(dt, T.BooleanType):
        return T_BOOL
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return T_TS
    return None


def _ts_parse(s: Column) -> Column:
    return F.coalesce(s.try_cast("timestamp"), parse_formats(s, TS_FORMATS))


def _flags(v: Column):
    """Per-value tests of the cascade. Order matters for cost: an integer is a
    float too, so the (costlier) double parse only runs on non-integers of number
    shape; timestamps try Spark's exception-free ISO cast before formatted parses, and
    no format reads a trimmed text of over 64 characters."""
    t = F.trim(v)
    is_int = t.rlike(INT_RE) & t.try_cast("bigint").isNotNull()
    is_float = is_int | try_number(v).isNotNull()
    is_ts = F.when(is_float | (F.length(t) > 64) | ~t.rlike(r"\d"), F.lit(False)).otherwise(_ts_parse(t).isNotNull())
    return is_int, is_float, is_ts


def _verdict(n, a_int, a_float, a_ts):
    return (F.when(n.isNull() | (n == 0), F.lit(T_TEXT)).when(a_int, F.lit(T_BIGINT))
            .when(a_float, F.lit(T_DOUBLE)).when(a_ts, F.lit(T_TS)).otherwise(F.lit(T_TEXT)))


def long_values(df: DataFrame, table_name: str, columns: list[str], order_col: str | None = None) -> DataFrame:
    """``(table_name, column_name, _o, v)``: every cell of ``columns`` as text."""
    o = F.col(order_col) if order_col and order_col in df.columns else F.lit(0).cast("long")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
                                for c in columns]))
    return df.select(F.lit(table_name).alias("table_name"), o.cast("long").alias("_o"), cells.alias("x")) \
        .select("table_name", "x.column_name", "_o", "x.v")


def infer_long(values: DataFrame, sample: int | None = None) -> DataFrame:
    """T1 over a long ``(table_name, column_name, _o, v)`` frame of any number of
    tables: one aggregate (partial per partition, a small shuffle), one compiled
    expression set. ``sample``: only the first ``sample`` non-null values of each whole
    column (a row limit per group, kept per task before the shuffle)."""
    src = values.where(F.col("v").isNotNull())
    if sample is not None:
        from pyspark.sql import Window
        w = Window.partitionBy("table_name", "column_name").orderBy("_o")
        src = src.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= sample)
    fi, ff, ft = _flags(F.col("v"))
    agg = src.groupBy("table_name", "column_name").agg(
        F.count("v").alias("n"), F.bool_and(fi).alias("i"), F.bool_and(ff).alias("f"), F.bool_and(ft).alias("t"))
    return agg.select("table_name", "column_name",
                      _verdict(F.col("n"), F.col("i"), F.col("f"), F.col("t")).alias("inferred_type"))


def infer_types(df: DataFrame, sample: int | None = 50, order_col: str | None = "_row",
                table_name: str | None = None) -> DataFrame:
    """Heuristic cascade per column -> long ``(table_name, column_name, inferred_type)``.

    Typed columns map directly. String columns over their first ``sample``
    non-null values (``None`` = every value): all integers -> BIGINT, all floats ->
    DOUBLE PRECISION, all timestamps -> TIMESTAMP, else TEXT; no value -> TEXT.
    Columns that are all NULL also give TEXT."""
    spark = df.sparkSession
    name = table_name or ""
    direct, cols = {}, []
    for f in df.schema.fields:
        if f.name == order_col:
            continue
        sc = _typed_shortcut(f.dataType)
        if sc:
            direct[f.name] = sc
        else:
            cols.append(f.name)
    out = spark.createDataFrame([(name, c, t) for c, t in direct.items()],
                                "table_name string, column_name string, inferred_type string")
    if cols:
        inf = infer_long(long_values(df, name, cols, order_col), sample)
        every = spark.createDataFrame([(name, c) for c in cols], "table_name string, column_name string")
        inf = every.join(inf, ["table_name", "column_name"], "left").select(
            "table_name", "column_name", F.coalesce("inferred_type", F.lit(T_TEXT)).alias("inferred_type"))
        out = out.unionByName(inf)
    return out if table_name is not None else out.drop("table_name")


def varchar_size(max_len: Column | str) -> Column:
    """Declared type from the longest value: <=50 -> VARCHAR(100), <=100 ->
    VARCHAR(200), <=255 -> VARCHAR(500), else TEXT."""
    m = _c(max_len)
    out = F.when(m.isNull(), F.lit("VARCHAR(100)"))
    for bound, size in VARCHAR_STEPS:
        out = out.when(m <= bound, F.lit(f"VARCHAR({size})"))
    return out.otherwise(F.lit("TEXT"))


def fix_varchar(declared: Column | str, max_len: Column | str) -> Column:
    """T2 post-check: a VARCHAR(n) smaller than the data becomes
    VARCHAR(min(2*len, 500)), or TEXT past 255 characters."""
    d, m = _c(declared), _c(max_len)
    n = F.regexp_extract(d, r"(?i)VARCHAR\((\d+)\)", 1).try_cast("int")
    return (F.when(n.isNull() | (m <= n), d)
            .when(m > 255, F.lit("TEXT"))
            .otherwise(F.concat(F.lit("VARCHAR("), F.least(m * 2, F.lit(500)).cast("string"), F.lit(")"))))


def string_lengths(df: DataFrame, table_name: str | None = None) -> DataFrame:
    """Max length of every string column in one aggregate -> long (column_name, max_len)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, max_len int")
    one = df.agg(*[F.max(F.length(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(cols)])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("max_len")) for i, c in enumerate(cols)
    ])).alias("x")).select("x.*")
    if table_name is not None:
        long = long.select(F.lit(table_name).alias("table_name"), "*")
    return long


def integer_target_type(mn: Column | str, mx: Column | str, integral: Column | str) -> Column:
    """T8 up front: the narrowest integer type that holds [min, max], numeric past
    bigint; non-integral values -> numeric."""
    mn, mx, integral = _c(mn), _c(mx), _c(integral)
    fits = lambda r: (mn >= F.lit(r[0])) & (mx <= F.lit(r[1]))
    return (F.when(~integral, F.lit("numeric"))
            .when(fits(SMALLINT_RANGE), F.lit("smallint"))
            .when(fits(INTEGER_RANGE), F.lit("integer"))
            .when(fits(BIGINT_RANGE), F.lit("bigint")).otherwise(F.lit("numeric")))
