"""Spark tables with the catalog tables.

Every table is a Parquet table of the session catalog, in one database. Keyed tables are
partitioned by a hash of the key (``_part``); the number of partitions follows the number
of rows (``rows_per_part``) and is kept, with keys and declared types, in the table's
properties. An upsert merges the partitions its keys hash to and overwrites just those
(dynamic partition overwrite); when a table has outgrown its partitions, or a column type
is widened, it is written anew and renamed. The merge is written to the checkpoint folder
before a partition is overwritten, and a batch that is run again ends in the same rows.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import numbers as NUM
from sheaf.functions import types as TY
from sheaf.operators import upsert as U
from sheaf.session import cut_lineage, keep

# ---- fixed values: columns of the catalog tables ------------------------------
_TEXT, _TIME, _LONG, _LIST = T.StringType(), T.TimestampType(), T.LongType(), T.ArrayType(T.StringType())
CATALOG_COLUMNS = {
    "tables_metadata": [
        ("data_domain", _TEXT), ("table_name", _TEXT), ("columns", _LIST), ("comments", _TEXT), ("source", _TEXT),
        ("source_url", _TEXT), ("released_on", _TIME), ("updated_on", _TIME), ("rows_count", _LONG),
        ("business_metadata", _TEXT), ("table_view", _TEXT), ("period_cols", _TEXT), ("min_period_sql", _TEXT),
        ("max_period_sql", _TEXT), ("created_at", _TIME), ("key_columns", _LIST)],
    "operational_metadata": [
        ("table_name", _TEXT), ("table_view", _TEXT), ("period_cols", _TEXT), ("first_available_value", _TEXT),
        ("last_available_value", _TEXT), ("last_updated_on", _TIME), ("rows_count", _LONG), ("columns", _LIST),
        ("source_url", _TEXT), ("business_metadata", _TEXT), ("major_domain", _TEXT), ("sub_domain", _TEXT),
        ("brief_summary", _TEXT)],
    "load_audit": [
        ("table_name", _TEXT), ("batch_id", _LONG), ("rows_before", _LONG), ("rows_inserted", _LONG),
        ("rows_updated", _LONG), ("rows_after", _LONG), ("duplicates", _LONG), ("null_keys", _LONG),
        ("columns_added", _LIST), ("schema_changes", _LIST), ("warnings", _LIST), ("keys", _LIST), ("timestamp", _TIME)],
    "signatures": [
        ("table_name", _TEXT), ("columns", _LIST), ("column_types", T.MapType(_TEXT, _TEXT)), ("sample_rows", _LIST),
        ("row_count", _LONG)],
}
# ------------------------------------------------------------------------------
CATALOG_KEYS = {"tables_metadata": ["table_name"], "operational_metadata": ["table_name"],
                "load_audit": ["table_name", "batch_id"], "signatures": ["table_name"]}
CATALOG_SCHEMAS = {n: T.StructType([T.StructField(c, t, True) for c, t in cols]) for n, cols in CATALOG_COLUMNS.items()}
TABLES_METADATA, OPERATIONAL_METADATA = CATALOG_SCHEMAS["tables_metadata"], CATALOG_SCHEMAS["operational_metadata"]
LOAD_AUDIT = CATALOG_SCHEMAS["load_audit"]
PART = "_part"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


#: Names of a table while it is swapped: the new one before, the old one after the switch.
NEXT, BEFORE = "__next", "__before"


class TableStore:
    def __init__(self, spark: SparkSession, database: str = "sheaf", location: str | None = None,
                 rows_per_part: int = 2_000_000):
        self.spark, self.database, self.rows_per_part = spark, database, rows_per_part
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")
        self.recover()

    def recover(self) -> None:
        """Finish or undo rewrites that a failure cut short: a table that was moved away
        and not replaced comes back; what is left of a swap goes."""
        there = {t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary}
        for moved in sorted(t for t in there if t.endswith(BEFORE)):
            name = moved.removesuffix(BEFORE)
            if name in there:
                self.spark.sql(f"DROP TABLE {self._t(moved)}")
            else:
                self.spark.sql(f"ALTER TABLE {self._t(moved)} RENAME TO {self._t(name)}")

    # ---- names and properties -----------------------------------------------------
    def _t(self, name: str) -> str:
        return f"`{self.database}`.`{name.lower()}`"

    def _property(self, name: str, key: str, default):
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._t(name)}").where(F.col("key") == f"sheaf.{key}").collect()
        return json.loads(rows[0]["value"]) if rows else default

    @staticmethod
    def _properties(values: dict) -> str:
        text = {k: json.dumps(v).replace("\\", "\\\\").replace("'", "\\'") for k, v in values.items()}
        return ", ".join(f"'sheaf.{k}' = '{v}'" for k, v in text.items())

    def _set(self, name: str, **values) -> None:
        self.spark.sql(f"ALTER TABLE {self._t(name)} SET TBLPROPERTIES ({self._properties(values)})")

    # ---- S7 / S8 --------------------------------------------------------------------
    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._t(name))

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database)
                      if not t.isTemporary and not t.name.endswith((BEFORE, NEXT)))

    def schema(self, name: str) -> T.StructType:
        return T.StructType([f for f in self.spark.table(self._t(name)).schema.fields if f.name != PART])

    def column_types(self, name: str) -> dict[str, str]:
        """{column: declared SQL type}."""
        declared = self._property(name, "types", {})
        return {f.name: declared.get(f.name, TY.spark_to_sql_type(f.dataType)) for f in self.schema(name).fields}

    def columns(self) -> DataFrame:
        """``(table_name, column_name, data_type, pos)`` of every table."""
        rows = [(t, c, d, i) for t in self.tables() for i, (c, d) in enumerate(self.column_types(t).items())]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, pos int")

    def key_columns(self) -> DataFrame:
        """``(table_name, column_name, data_type, key_pos)``: the keys that the catalog
        lists, joined with the columns there are."""
        keys = self.read("tables_metadata").select("table_name", F.posexplode("key_columns").alias("key_pos", "column_name"))
        return (keys.join(self.columns().drop("pos"), ["table_name", "column_name"])
                .select("table_name", "column_name", "data_type", "key_pos").orderBy("table_name", "key_pos"))

    def primary_keys(self, name: str) -> list[str]:
        return self._property(name, "keys", [])

    # ---- L1 -------------------------------------------------------------------------
    def create_table(self, name: str, schema: T.StructType | dict, key_columns=None, if_absent: bool = True) -> bool:
        """L1: create from a StructType or ``{col: sql_type}``; identifiers lower-cased,
        colliding sanitised names rejected (H12)."""
        plain = lambda c: c.replace('"', "").strip().lower()
        declared = {plain(c): t for c, t in schema.items()} if isinstance(schema, dict) else {}
        given = schema.items() if isinstance(schema, dict) else [(f.name, f.dataType) for f in schema.fields]
        fields = [T.StructField(plain(c), TY.to_spark_type(t) if isinstance(t, str) else t, True) for c, t in given]
        names = [f.name for f in fields]
        if len(set(names)) != len(names):
            raise ValueError(f"column names collide after sanitising: {names}")
        if U.AUDIT_COLUMN not in names:
            fields.append(T.StructField(U.AUDIT_COLUMN, T.TimestampType(), True))
        if self.exists(name):
            if if_absent:
                return False
            raise ValueError(f"table {name} exists")
        self._create(name, T.StructType(fields), [k.lower() for k in key_columns or []], 1, declared)
        return True

    def _create(self, name: str, schema: T.StructType, keys: list[str], parts: int, declared: dict) -> None:
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        props = self._properties({"keys": keys, "parts": parts, "types": declared})
        self.spark.sql(f"CREATE TABLE {self._t(name)} ({cols}, `{PART}` int) USING parquet "
                       f"PARTITIONED BY (`{PART}`) TBLPROPERTIES ({props})")

    # ---- S6 -------------------------------------------------------------------------
    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._t(name)).drop(PART)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def sample(self, name: str, n: int = 5) -> DataFrame:
        return self.read(name).limit(n)

    # ---- types before a write ---------------------------------------------------------
    def widen(self, name: str, df: DataFrame) -> list[str]:
        """T7 + T8, decided before anything is written: a VARCHAR(n) whose values are
        longer becomes text, integers whose values do not fit become bigint, and beyond
        that numeric. One aggregate over the batch. Returns the changes."""
        schema, declared = self.schema(name), self.column_types(name)
        cols = {c.strip().lower(): c for c in df.columns}
        aggs, meant = [], []
        for f in schema.fields:
            if f.name not in cols:
                continue
            col = F.col(f"`{cols[f.name]}`")
            size = TY.varchar_length(declared[f.name])
            if size is not None:
                meant.append((f, "text"))
                aggs.append(F.max(F.length(col.cast("string"))) > size)
            elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                exact = (NUM.coerce_numeric(col, "decimal(38,0)") if isinstance(df.schema[cols[f.name]].dataType, T.StringType)
                         else col.try_cast("decimal(38,0)"))
                low, high = TY.INTEGER_RANGE if not isinstance(f.dataType, T.LongType) else TY.BIGINT_RANGE
                if isinstance(f.dataType, (T.ByteType, T.ShortType)):
                    low, high = TY.SMALLINT_RANGE
                meant.append((f, "bigint"))
                big = F.max((exact < F.lit(TY.BIGINT_RANGE[0]).cast("decimal(38,0)")) | (exact > F.lit(TY.BIGINT_RANGE[1]).cast("decimal(38,0)")))
                aggs.append(F.when(big, "numeric").when(F.max((exact < F.lit(low)) | (exact > F.lit(high))), "bigint"))
        if not aggs:
            return []
        found = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        changes, types = [], dict(declared)
        for i, (f, _) in enumerate(meant):
            to = "text" if found[i] is True else found[i] if isinstance(found[i], str) else None
            if to and TY.normalise_type_py(declared[f.name]) != to:
                changes.append(f"{f.name}: {declared[f.name]} -> {to}")
                types[f.name] = to
        if changes:
            spark_type = lambda t: T.DecimalType(38, 0) if t == "numeric" else TY.to_spark_type(t)
            new = T.StructType([T.StructField(f.name, spark_type(types[f.name]) if types[f.name] != declared[f.name] else f.dataType, True)
                                for f in schema.fields])
            self.replace_schema(name, new, types)
        return changes

    def _coerce(self, df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
        """L2 coercion before a write: text into numbers exactly (N2), into dates (N3);
        the table's type wins (T6). Returns the frame and a warning for each column with
        values that could not be read, with their number."""
        df = df.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])
        kinds = {}
        for f in schema.fields:
            if f.name in df.columns and isinstance(df.schema[f.name].dataType, T.StringType):
                if isinstance(f.dataType, T.DateType):
                    kinds[f.name] = "date"
                elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                    kinds[f.name] = "timestamp"
        decisions = NUM.temporal_decision(df, list(kinds)) if kinds else {}
        out, lost = [], {}
        for c in df.columns:
            f = schema[c] if c in schema.names else None
            src, col = df.schema[c].dataType, F.col(f"`{c}`")
            if f is None or src == f.dataType or isinstance(f.dataType, T.StringType):
                out.append(col)
                continue
            if c in kinds:
                new = NUM.format_temporal(col, kinds[c], decisions[c]).try_cast(f.dataType)
            elif isinstance(src, T.StringType) and isinstance(f.dataType, T.NumericType):
                exact = isinstance(f.dataType, (T.IntegralType, T.DecimalType))
                new = NUM.coerce_numeric(col, "decimal(38,9)" if exact else "double").try_cast(f.dataType)
                if exact:  # beyond 29 whole digits the wider scale does not fit
                    new = F.coalesce(new, NUM.coerce_numeric(col, "decimal(38,0)").try_cast(f.dataType))
            else:
                new = col.try_cast(f.dataType)
            lost[c] = new.isNull() & col.isNotNull() & (F.trim(col.cast("string")) != "")
            out.append(new.alias(c))
        warnings = []
        if lost:
            n = df.agg(*[F.count_if(x).alias(c) for c, x in lost.items()]).first()
            warnings = [f"{c}: {n[c]} values do not fit {TY.spark_to_sql_type(schema[c].dataType)}; NULL" for c in lost if n[c]]
        return df.select(*out), warnings

    # ---- writes ---------------------------------------------------------------------
    @staticmethod
    def _part_of(keys: list[str], parts: int):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(parts)).cast("int") if keys else F.lit(0)

    def _insert(self, name: str, df: DataFrame, overwrite: bool) -> int:
        """Write rows that have ``_part``, by the order of the table's columns."""
        seen = Observation()
        rows = df.select(*[f"`{c}`" for c in self.spark.table(self._t(name)).columns]).observe(seen, F.count(F.lit(1)).alias("n"))
        conf, key = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"  # insertInto reads it from here
        before = conf.get(key)
        conf.set(key, "dynamic")
        try:
            rows.write.insertInto(self._t(name), overwrite=overwrite)
        finally:
            conf.set(key, before)
        return int(seen.get["n"])

    def _rewrite(self, name: str, schema: T.StructType, keys: list[str], parts: int, declared: dict) -> None:
        """Write the table anew (other types, keys or partitions) and swap it in by name.
        The old table is moved away first and dropped last, so that there is a whole table
        at any time; ``recover`` ends a swap that a failure cut short."""
        fresh, moved = f"{name.lower()}{NEXT}", f"{name.lower()}{BEFORE}"
        self.spark.sql(f"DROP TABLE IF EXISTS {self._t(fresh)}")
        self._create(fresh, schema, keys, parts, declared)
        rows = self.read(name).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
        self._insert(fresh, rows.withColumn(PART, self._part_of(keys, parts)), overwrite=False)
        self.spark.sql(f"ALTER TABLE {self._t(name)} RENAME TO {self._t(moved)}")
        self.spark.sql(f"ALTER TABLE {self._t(fresh)} RENAME TO {self._t(name)}")
        self.spark.sql(f"DROP TABLE {self._t(moved)}")

    def replace_schema(self, name: str, schema: T.StructType, declared: dict | None = None) -> None:
        """L6 persisted: new columns are added to the table; other types mean a rewrite."""
        declared = declared or {c: t for c, t in self.column_types(name).items()}
        old = {f.name: f for f in self.schema(name).fields}
        if all(old[f.name].dataType == f.dataType for f in schema.fields if f.name in old):
            added = [f for f in schema.fields if f.name not in old]
            if added:
                cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
                self.spark.sql(f"ALTER TABLE {self._t(name)} ADD COLUMNS ({cols})")
            self._set(name, types=declared)
            return
        types = {f.name: declared.get(f.name) if old.get(f.name) and old[f.name].dataType == f.dataType
                 else TY.spark_to_sql_type(f.dataType) for f in schema.fields}
        self._rewrite(name, schema, self.primary_keys(name), self._property(name, "parts", 1), {c: t for c, t in types.items() if t})

    def append(self, name: str, df: DataFrame, ts=None) -> tuple[int, list[str]]:
        """L2: coerce, align, stamp ``ingested_at``, append; returns rows written and
        warnings. Rows of keyed tables are merged instead."""
        if self.primary_keys(name):
            got = self.upsert(name, df, self.primary_keys(name), ts=ts)
            return got["rows_inserted"] + got["rows_updated"], got["warnings"]
        schema = self.schema(name)
        df, warnings = self._coerce(df, schema)
        rows = U.align(df, schema).withColumn(U.AUDIT_COLUMN, F.lit(ts or _now()).cast("timestamp")).withColumn(PART, F.lit(0))
        return self._insert(name, rows, overwrite=False), warnings

    def upsert(self, name: str, df: DataFrame, keys: list[str], ts=None, order="_row", on_missing: str = "null") -> dict:
        """L3 persisted: merge into the partitions the incoming keys hash to."""
        keys = [k.lower() for k in keys]
        schema = self.schema(name)
        inc, warnings = self._coerce(df, schema)
        inc = cut_lineage(inc)
        parts = self._property(name, "parts", 1)
        total = self.spark.table(self._t(name)).count()
        want = max(1, -(-(total + inc.count()) // self.rows_per_part))
        if self.primary_keys(name) != keys or want > 2 * parts:
            parts = max(want, parts)
            self._rewrite(name, schema, keys, parts, self._property(name, "types", {}))
        part = self._part_of(keys, parts)
        touched = [r[0] for r in inc.where(F.col(f"`{keys[0]}`").isNotNull()).select(part).distinct().collect()]
        existing = self.spark.table(self._t(name)).where(F.col(PART).isin(touched)).drop(PART)
        before = existing.count()
        res = U.upsert_merge(existing, inc, keys, ts=ts or _now(), order=order, on_missing=on_missing, hold=keep)
        merged = res.merged.withColumn(PART, part)
        got = res.counts.first()
        if touched:
            self._insert(name, merged.repartition(len(touched), PART), overwrite=True)
        return {"rows_inserted": got["inserted"], "rows_updated": got["updated"], "duplicates": got["duplicates"],
                "null_keys": got["null_keys"], "touched_parts": len(touched), "rows_before_touched": before,
                "warnings": warnings}

    def insert_ignore(self, name: str, df: DataFrame, keys: list[str], ts=None) -> int:
        """L4: append only rows whose key is absent."""
        inc, _ = self._coerce(df, self.schema(name))
        new, _ = U.insert_ignore(self.read(name), U.stamp(inc, ts or _now()), keys)
        return self.upsert(name, new.drop(U.AUDIT_COLUMN), keys, ts=ts)["rows_inserted"]

    def delete(self, name: str, gone: DataFrame) -> None:
        """Remove the rows that match ``gone`` on its columns."""
        table = self.spark.table(self._t(name))
        touched = [r[0] for r in table.join(gone, gone.columns, "left_semi").select(PART).distinct().collect()]
        rest = cut_lineage(table.where(F.col(PART).isin(touched)).join(gone, gone.columns, "left_anti"))
        full = {r[0] for r in rest.select(PART).distinct().collect()}
        if full:
            self._insert(name, rest, overwrite=True)
        for p in set(touched) - full:  # a partition without rows is not overwritten, so it goes
            self.spark.sql(f"ALTER TABLE {self._t(name)} DROP IF EXISTS PARTITION (`{PART}` = {p})")

    def drop_table(self, name: str) -> None:
        """L14."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._t(name)}")

    # ---- catalog ----------------------------------------------------------------------
    def ensure_catalog(self) -> None:
        for n, schema in CATALOG_SCHEMAS.items():
            self.create_table(n, schema, CATALOG_KEYS[n])

    def catalog(self, name: str) -> DataFrame:
        return self.read(name)
