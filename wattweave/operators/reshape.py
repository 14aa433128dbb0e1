"""Long, wide and array forms of a profile. Slots are a fixed list, so no job discovers column values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.functions.dates import slot_label, week_slots


def with_slot(profile: DataFrame) -> DataFrame:
    """Name each (weekday, hour) cell by its anchor timestamp."""
    return profile.withColumn("slot", slot_label("day", "hour"))


def widen(long: DataFrame, id_column: str, name_column: str, values: list[str], names: list[str] | None = None,
          infix: str = "") -> DataFrame:
    """One row per id. Columns are grouped by value: all of the first, then all of the second.

    With a single value and no infix the columns carry the slot names alone.
    """
    names = week_slots() if names is None else names
    wide = (long.groupBy(id_column).pivot(name_column, names)
            .agg(*[F.first(v).alias(v) for v in values]))
    if len(values) == 1:
        label = f"{values[0]}_{infix}" if infix else ""
        return wide.select(id_column, *[F.col(f"`{n}`").alias(f"{label}{n}") for n in names])
    return wide.select(id_column, *[F.col(f"`{n}_{v}`").alias(f"{v}_{infix}{n}") for v in values for n in names])


def slot_number(day, hour) -> Column:
    """Place of a (weekday, hour) cell in the week: 0 … 167."""
    day, hour = (F.col(c) if isinstance(c, str) else c for c in (day, hour))
    return (day - 1) * 24 + hour


def to_dense(long: DataFrame, id_column: str, slot_column: str, values: list[str], size: int, into: str = "features") -> DataFrame:
    """One row per id with the `size` slots of the first value, then of the next, in one array; null where absent.

    Slots are integers: an id's cells are put in order and laid out in one pass, the gaps filled as they are met. A slot
    outside 0 … size - 1 is left out, as is an id without any other. (id, slot) is unique in a profile.
    """
    slot = F.col(slot_column).cast("int")
    cells = F.array_sort(F.collect_list(F.struct(slot.alias("slot"), *[F.col(v).cast("double").alias(v) for v in values])))
    grouped = long.where(slot.between(0, size - 1)).groupBy(id_column).agg(cells.alias("cells"))
    nothing = F.lit(None).cast("double")

    def laid_out(value: str) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<double>").alias("row"))
        filled = F.aggregate("cells", start, lambda acc, c: F.struct(
            (c["slot"] + 1).alias("next"), F.concat(acc["row"], F.array_repeat(nothing, c["slot"] - acc["next"]), F.array(c[value])).alias("row")),
            lambda acc: F.concat(acc["row"], F.array_repeat(nothing, F.lit(size) - acc["next"])))
        return filled

    return grouped.select(id_column, F.concat(*[laid_out(v) for v in values]).alias(into))


def widen_weekly(profile: DataFrame, values: list[str], infix: str = "", id_column: str = "building_id") -> DataFrame:
    """The weekly profile (id, day, hour, values) in 168 columns a value, named as by widen(); slots go by number."""
    names = week_slots()
    dense = to_dense(profile.withColumn("slot", slot_number("day", "hour")), id_column, "slot", values, len(names))
    labels = [f"{v}_{infix}{n}" for v in values for n in names] if infix or len(values) > 1 else names
    return dense.select(id_column, *[F.get("features", F.lit(i)).alias(label) for i, label in enumerate(labels)])


def to_array(long: DataFrame, id_column: str, name_column: str, values: list[str],
             names: list[str] | None = None, into: str = "features") -> DataFrame:
    """One row per id with all slots of all values in one array; null where a slot is absent.

    The list gathered per id has at most one element per slot, as (id, slot) is unique in a profile.
    """
    names = week_slots() if names is None else names
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(name_column), F.struct(*values))))
    order = F.array(*[F.lit(n) for n in names])
    grouped = long.where(F.col(name_column).isin(names)).groupBy(id_column).agg(cells.alias("cells"))

    def one(value: str) -> Column:
        return F.transform(order, lambda n: F.try_element_at(F.col("cells"), n).getField(value).cast("double"))

    return grouped.select(id_column, F.concat(*[one(v) for v in values]).alias(into))


def lengthen(wide: DataFrame, ids: list[str], columns: list[str] | None = None, name: str = "variable",
             value: str = "value") -> DataFrame:
    columns = [c for c in wide.columns if c not in ids] if columns is None else columns
    return wide.unpivot([f"`{i}`" for i in ids], [f"`{c}`" for c in columns], name, value)


def flip(wide: DataFrame, key: str, key_values: list, name: str = "variable") -> DataFrame:
    """Rows become columns: one row per former column, one column per listed key value.

    The key values are the columns of the result, so they must be few and known.
    """
    long = lengthen(wide, [key], name=name)
    return long.groupBy(name).pivot(key, key_values).agg(F.first("value"))


def slot_hour(name) -> Column:
    """Hour in characters 39-40 of a wide mean-reading column name."""
    return F.substring(name, 39, 2).cast("int")
