"""Differences of nested rows by path, and figures quoted in texts against records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_LEAVES = "array<struct<path:string,value:string>>"


def _leaf(path: Column, value: Column) -> Column:
    return F.array(F.struct(path.alias("path"), value.alias("value")))


def _leaves(value: Column, kind: DataType, path: Column, name: str, keys: dict[str, str]) -> Column:
    """(path, value as text) of all leaves below a column, by its schema. name: the path without places in arrays."""
    at = lambda part: F.concat(path, F.lit("." if name else ""), F.lit(part))
    if isinstance(kind, StructType):
        parts = [_leaves(value[f.name], f.dataType, at(f.name), f"{name}.{f.name}".lstrip("."), keys) for f in kind.fields]
        return F.when(value.isNull(), _leaf(path, F.lit(None).cast("string"))).otherwise(F.concat(*parts) if parts else F.array().cast(_LEAVES))
    if isinstance(kind, ArrayType):
        key = keys.get(name)

        def element(x: Column, i: Column) -> Column:
            place = i.cast("string")
            if key is not None:
                own = F.coalesce(x[key].cast("string"), F.lit(""))
                # elements before it are counted only where its key stood earlier, or is null
                earlier = F.size(F.filter(F.slice(value, F.lit(1), i), lambda y: y[key].eqNullSafe(x[key])))
                before = F.when(F.array_position(value[key], x[key]) > i, 0).otherwise(earlier)
                place = F.concat(F.lit(f"{key}="), own, F.when(before > 0, F.concat(F.lit("#"), (before + 1).cast("string"))).otherwise(F.lit("")))
            # a transform of one element: the path is written once, not for each leaf
            whole = F.array(F.concat(path, F.lit("["), place, F.lit("]")))
            return F.get(F.transform(whole, lambda p: _leaves(x, kind.elementType, p, name or "[]", keys)), F.lit(0))

        some = F.flatten(F.transform(value, element))
        # an empty array is a leaf of its own, and so is none
        return F.when(value.isNull(), _leaf(path, F.lit(None).cast("string"))).when(F.size(value) == 0, _leaf(path, F.lit("[]"))).otherwise(some)
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}")).alias("path"), F.to_json(F.struct(e["value"].alias("v"))).alias("value"))
        return F.when(value.isNull(), _leaf(path, F.lit(None).cast("string"))).otherwise(F.transform(F.map_entries(value), entry))
    return _leaf(path, value.cast("string"))


def differences(left: DataFrame, right: DataFrame, key: str, arrays: dict[str, str] | None = None) -> DataFrame:
    """(key, path, left, right, side): the leaves in which two tables of nested rows differ.

    Rows meet by ``key`` (unique on either side), and the columns that both have are descended by
    their schema. Elements of an array stand by their number, or, where ``arrays`` names a field
    for the array's path (``items`` -> ``item``), by that field's value; equal ones get a number
    from the second on (``#2``). side tells where a path is: both, left or right; a row that only
    one side has is one difference, with an empty path. Rows that are equal are not descended.
    Nulls are equal to nulls. Empty tables give what only the other has.
    """
    shared = [c for c in left.columns if c in right.columns and c != key]
    row = lambda df, out: df.select(F.col(key), F.struct(*(F.col(f"`{c}`") for c in shared)).alias(out))
    met = row(left, "l").join(row(right, "r"), key, "full_outer")
    kinds = StructType([left.schema[c] for c in shared]), StructType([right.schema[c] for c in shared])
    leaves = [_leaves(F.col(c), kind, F.lit(""), "", arrays or {}) for c, kind in zip("lr", kinds)]
    text = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"})
    met = met.where(F.col("l").isNull() | F.col("r").isNull() | (text("l") != text("r")))
    gone = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right")
    met = met.select(key, gone.alias("gone"), *(F.when(gone.isNull(), x).otherwise(F.array().cast(_LEAVES)).alias(c) for c, x in zip("lr", leaves)))
    # most leaves have their equal at the same place of the other side: only the rest is looked up by path
    met = met.withColumn("same", F.zip_with("l", "r", lambda a, b: a.eqNullSafe(b)))
    rest = lambda c: F.filter(c, lambda x, i: ~F.get("same", i))
    met = met.select(key, "gone", *(F.map_from_entries(rest(c)).alias(c) for c in "lr"))
    paths = F.array_union(F.map_keys("l"), F.map_keys("r"))

    def compared(p: Column) -> Column:
        a, b = F.element_at("l", p), F.element_at("r", p)
        has_a, has_b = F.map_contains_key("l", p), F.map_contains_key("r", p)
        side = F.when(has_a & has_b, "both").when(has_a, "left").otherwise("right")
        return F.struct(p.alias("path"), a.alias("left"), b.alias("right"), side.alias("side"))

    differ = F.filter(F.transform(paths, compared), lambda d: (d["side"] != "both") | ~d["left"].eqNullSafe(d["right"]))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit("").alias("path"), none.alias("left"), none.alias("right"), F.col("gone").alias("side")))
    return met.select(key, F.explode(F.when(F.col("gone").isNotNull(), whole).otherwise(differ)).alias("d")).select(key, "d.*")


#: Figures that end further behind a name than this are not about it.
REACH = 60
#: A decimal; what stands before and behind it tells prices, percentages and ratios from measurements.
_FIGURE = r"(?<![\w.])\d+\.\d+(?!\d)"
_NOT_MEASURED = r"^(?:%|×|x )"


def quoted_figures(lines: DataFrame, records: DataFrame, reach: int = REACH, allowed: DataFrame | None = None) -> DataFrame:
    """(file, line_no, seq, name, figure, stated): decimals behind a record's name in backticks, and whether a record states them.

    lines: file, line_no, raw; records: name, values (array of doubles; rows of one name count
    together). A figure belongs to the last known name before it in its line, if it ends within
    ``reach`` characters of it; names that are no record's don't count. Prices, percentages and ratios are
    left out, and what ``allowed`` (file, name, figure) lists. stated: some value of the record is
    the figure at the figure's number of places; a value half way between two counts for both. seq
    numbers the figures of a line. Null lines have none; empty tables give an empty one.
    """
    known = records.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"))
    # backticks cut a line into text (even places) and names (odd places)
    cut = lines.where(F.contains("raw", F.lit("`"))).select("file", "line_no", F.posexplode(F.split("raw", "`")).alias("part", "text"))
    named = cut.join(known.select(F.col("name").alias("text"), F.col("name")), "text", "left")
    order = Window.partitionBy("file", "line_no").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text") + 1
    named = named.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    is_name = (F.col("part") % 2 == 1) & F.col("name").isNotNull()
    about = F.last(F.when(is_name, F.struct("name", (F.col("start") + size).alias("end"))), ignorenulls=True).over(order)
    named = named.withColumn("about", about).where("about is not null")
    # a text is cut at its figures as well: the lengths of the parts give their places
    figures = F.regexp_extract_all("text", F.lit(_FIGURE), F.lit(0))
    rest = F.split("text", _FIGURE, -1)
    at = F.transform(figures, lambda f, i: F.struct(
        f.alias("figure"), F.get(rest, i).alias("lead"), F.get(rest, i + 1).alias("tail"),
        (F.col("start") + F.aggregate(F.slice(rest, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(figures, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))).alias("place"),
    ))
    found = named.where("part % 2 = 0").select("file", "line_no", "about.name", F.col("about.end").alias("end"), F.explode(at).alias("f"))
    found = found.where(F.col("f.place") + F.length("f.figure") <= F.col("end") + reach).where(~F.endswith("f.lead", F.lit("$")) & ~F.col("f.tail").rlike(_NOT_MEASURED))
    seq = F.row_number().over(Window.partitionBy("file", "line_no").orderBy("f.place"))
    rows = found.select("file", "line_no", "name", "f.figure", seq.alias("seq")).join(known, "name")
    half = F.pow(F.lit(10.0), -F.length(F.substring_index("figure", ".", -1))) / 2
    stated = F.exists("values", lambda v: F.abs(v - F.col("figure").cast("double")) <= half * (1 + 1e-9))
    rows = rows.select("file", "line_no", "seq", "name", "figure", F.coalesce(stated, F.lit(False)).alias("stated"))
    return rows if allowed is None else rows.join(allowed.select("file", "name", "figure"), ["file", "name", "figure"], "left_anti")
