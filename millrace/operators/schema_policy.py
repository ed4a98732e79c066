"""Schema evolution: which changes between two schemas are allowed, on the driver and as a plan over column tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names, allowed widenings, reasons.
WIDENINGS = {("int32", "int64"), ("float32", "float64")}
KEY_TYPE, KEY_LIST, INCOMPATIBLE = "key-column-type-change", "key-column-membership-or-order-change", "incompatible-schema-change"


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    nullable: bool = True


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    keys: tuple[str, ...] = field(default_factory=tuple)

    def type_of(self, name: str) -> str | None:
        """Type of the first column of a name."""
        return next((c.data_type for c in self.columns if c.name == name), None)


def evaluate(current: Schema, following: Schema) -> str | None:
    """None if the change is allowed, else why the batch is quarantined. Nullability doesn't count."""
    for key in current.keys:
        if key in following.keys:
            before, after = current.type_of(key), following.type_of(key)
            if before is not None and after is not None and before != after:
                return KEY_TYPE
    if current.keys != following.keys:
        return KEY_LIST
    for column in current.columns:
        after = following.type_of(column.name)
        before = current.type_of(column.name)
        if after != before and (before, after) not in WIDENINGS:
            return INCOMPATIBLE
    return None


def decisions(changes: DataFrame, columns: DataFrame) -> DataFrame:
    """(change_id, decision) of changes (change_id, keys, next_keys) and columns (change_id, side, place, name, data_type).

    The same rules as a plan: the first column of a name counts, current columns are left-joined to the next ones.
    """
    first = columns.groupBy("change_id", "side", "name").agg(F.min_by("data_type", "place").alias("data_type"))
    before = first.filter("side = 'current'").select("change_id", "name", F.col("data_type").alias("before"))
    after = first.filter("side = 'next'").select("change_id", "name", F.col("data_type").alias("after"))
    pairs = before.join(after, ["change_id", "name"], "left").join(changes, "change_id")
    same = F.col("before").eqNullSafe(F.col("after"))
    widened = F.coalesce(F.concat_ws(">", "before", "after").isin(*[f"{a}>{b}" for a, b in WIDENINGS]), F.lit(False))
    key_changed = F.array_contains("keys", F.col("name")) & F.array_contains("next_keys", F.col("name")) & F.col("after").isNotNull() & ~same
    found = pairs.groupBy("change_id").agg(F.bool_or(key_changed).alias("key_type"), F.bool_or(~same & ~widened).alias("broken"))
    decided = (
        F.when(F.coalesce("key_type", F.lit(False)), KEY_TYPE).when(F.col("keys") != F.col("next_keys"), KEY_LIST).when(F.coalesce("broken", F.lit(False)), INCOMPATIBLE).otherwise("allow")
    )
    return changes.join(found, "change_id", "left").select("change_id", decided.alias("decision"))


_CURRENT = (("id", "int64"), ("name", "string"), ("score", "int32"), ("ratio", "float32"), ("flag", "boolean"))
#: change -> (next columns, next keys)
_CHANGES = {
    "same": (_CURRENT, ("id",)),
    "added": ((*_CURRENT, ("extra", "string")), ("id",)),
    "widened": ((("id", "int64"), ("name", "string"), ("score", "int64"), ("ratio", "float64"), ("flag", "boolean")), ("id",)),
    "narrowed": ((("id", "int32"), ("name", "string"), ("score", "int32"), ("ratio", "float32"), ("flag", "boolean")), ()),
    "key_type": ((("id", "string"), ("name", "string"), ("score", "int32"), ("ratio", "float32"), ("flag", "boolean")), ("id",)),
    "key_added": (_CURRENT, ("id", "name")),
    "key_order": (_CURRENT, ("name", "id")),
    "key_dropped": (_CURRENT, ()),
    "column_dropped": (_CURRENT[:-1], ("id",)),
    "type_changed": ((("id", "int64"), ("name", "boolean"), ("score", "int32"), ("ratio", "float32"), ("flag", "boolean")), ("id",)),
    "crossed": ((("id", "int64"), ("name", "string"), ("score", "float64"), ("ratio", "float32"), ("flag", "boolean")), ("id",)),
    "reordered": (_CURRENT[::-1], ("id",)),
    "doubled": ((*_CURRENT, ("score", "string")), ("id",)),
}


def example_changes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    changes = [(k, ["id"], list(keys)) for k, (_, keys) in _CHANGES.items()]
    columns = [(k, side, i, n, t) for k, (after, _) in _CHANGES.items() for side, cols in (("current", _CURRENT), ("next", after)) for i, (n, t) in enumerate(cols)]
    return (
        spark.createDataFrame(changes, "change_id string, keys array<string>, next_keys array<string>"),
        spark.createDataFrame(columns, "change_id string, side string, place int, name string, data_type string"),
    )


def _oracle() -> str:
    columns = ", ".join(f"('{k}', {i}, '{n}', '{t}')" for k, (after, _) in _CHANGES.items() for i, (n, t) in enumerate(after))
    current = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(_CURRENT))
    keys = ", ".join(f"('{k}', '{','.join(keys)}')" for k, (_, keys) in _CHANGES.items())
    return f"""WITH n AS (SELECT c, name, arg_min(t, i) AS t FROM (VALUES {columns}) x(c, i, name, t) GROUP BY c, name), cur AS (SELECT * FROM (VALUES {current}) x(i, name, t)),
  k AS (SELECT * FROM (VALUES {keys}) x(c, keys)), p AS (SELECT k.c, k.keys, cur.name, cur.t AS before, n.t AS after FROM k CROSS JOIN cur LEFT JOIN n ON n.c = k.c AND n.name = cur.name)
  SELECT c AS change_id, CASE WHEN bool_or(name = 'id' AND list_contains(string_split(keys, ','), 'id') AND after IS NOT NULL AND after <> before) THEN '{KEY_TYPE}' WHEN any_value(keys) <> 'id' THEN '{KEY_LIST}'
  WHEN bool_or(after IS NULL OR (after <> before AND NOT (before = 'int32' AND after = 'int64') AND NOT (before = 'float32' AND after = 'float64'))) THEN '{INCOMPATIBLE}' ELSE 'allow' END AS decision
  FROM p GROUP BY c"""


ORACLE = _oracle()
