"""Paired CSV sets: one image file and one file per object kind, glued by row position."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: One row per set with objects, one per empty set and one per fault. A set's rows hold the texts in the order of ``names``.
SETS = ("base string, kind string, image_values map<string,string>, names array<string>, rows array<array<string>>, "
        "error string")


def _files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*{extension}").load(path))


def _listed(files: DataFrame, image_postfix: str, object_postfixes: Sequence[str], extension: str) -> DataFrame:
    """Adds base and kind; files whose name ends with no known postfix go."""
    kind, base = F.lit(None).cast("string"), F.lit(None).cast("string")
    for postfix in [image_postfix, *object_postfixes]:
        tail = postfix + extension
        hit = F.col("path").endswith(tail)
        kind = F.when(hit, F.lit(postfix)).otherwise(kind)
        base = F.when(hit, F.expr(f"substring(path, 1, length(path) - {len(tail)})")).otherwise(base)
    return files.withColumns({"base": base, "kind": kind}).filter(F.col("kind").isNotNull())


def list_files(spark: SparkSession, path: str, image_postfix: str, object_postfixes: Sequence[str],
               extension: str = ".csv") -> DataFrame:
    """(path, base, kind) of every file whose name ends with a known postfix; contents are not read."""
    return _listed(_files(spark, path, extension), image_postfix, object_postfixes, extension).select("path", "base", "kind")


def incomplete_sets(files: DataFrame, image_postfix: str, object_postfixes: Sequence[str]) -> DataFrame:
    """(base, kind) of object files an image file lacks."""
    expected = files.filter(F.col("kind") == image_postfix).select(
        "base", F.explode(F.array(*[F.lit(k) for k in object_postfixes])).alias("kind"))
    return expected.join(files.select("base", "kind"), ["base", "kind"], "left_anti")


def _table(content: bytes, delimiter: str) -> tuple[list[str], list[list]]:
    """Header and rows of a file as csv.DictReader sees them: no blank rows, missing values null."""
    lines = csv.reader(io.StringIO(content.decode("utf-8")), delimiter=delimiter)
    header = next(lines, [])
    return header, [x + [None] * (len(header) - len(x)) for x in lines if x]


def _fitting(base: str, names: list[str], rows: list[list]) -> list[list]:
    """The rows, none of which may have more values than there are names."""
    widest = max(map(len, rows), default=0)
    if widest > len(names):
        raise ValueError(f"{base}: a row has {widest} values, the header {len(names)}")
    return rows


def _glue(base: str, tables: dict, image_kind: str, kinds: Sequence[str]) -> list[dict]:
    """Rows of SETS for one complete set."""
    names, lines = tables[image_kind]
    image = dict(zip(names, _fitting(base, names, lines[:1])[0])) if lines else {}
    counts = {k: len(tables[k][1]) for k in kinds}
    row = {"base": base, "image_values": list(image.items()), "names": [], "rows": None, "error": None}
    if len(set(counts.values())) > 1:
        return [{**row, "kind": "error", "error": f"row counts differ: {counts}"}]
    out = []
    if counts[kinds[0]]:
        column = {}  # of equal names the first gives the place, the last the values
        width = 0
        for k in kinds:
            prefix = k.strip("_") + "_"
            for i, n in enumerate(tables[k][0]):
                column[n if n.startswith(prefix) else prefix + n] = width + i
            width += len(tables[k][0])
        glued = [list(chain.from_iterable(x)) for x in zip(*[_fitting(base, *tables[k]) for k in kinds])]
        at = list(column.values())
        if at != list(range(width)):
            glued = [[x[i] for i in at] for x in glued]
        out.append({**row, "kind": "object", "names": list(column), "rows": glued})
    if len(lines) > 1:
        out.append({**row, "kind": "error", "error": f"image file has {len(lines)} rows, the first is used"})
    return out or [{**row, "kind": "empty"}]


def _sets(files: DataFrame, image_postfix: str, object_postfixes: Sequence[str], delimiter: str, extension: str) -> DataFrame:
    """SETS of all complete sets: one scan of the files, one shuffle by base."""
    named = _listed(files, image_postfix, object_postfixes, extension).select("base", "kind", "content")
    image_kind, kinds = image_postfix, list(object_postfixes)
    wanted = {image_kind, *kinds}
    schema = to_arrow_schema(_parse_datatype_string(SETS))

    def glue(part: pa.Table) -> pa.Table:
        found = part.column("kind").to_pylist()
        if wanted - set(found):
            return schema.empty_table()
        tables = {k: _table(c.as_py(), delimiter) for k, c in zip(found, part.column("content"))}
        return pa.Table.from_pylist(_glue(part.column("base")[0].as_py(), tables, image_kind, kinds), schema=schema)

    return named.groupBy("base").applyInArrow(glue, SETS)


def _objects(sets: DataFrame) -> DataFrame:
    """One row per row of each set; sets without rows keep one, numbered −1."""
    values = F.when(F.col("_row").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_from_arrays("names", "_row"))
    return sets.select("base", "kind", "image_values", "names", "error", F.posexplode_outer("rows").alias("_at", "_row")).select(
        "base", "kind", F.coalesce("_at", F.lit(-1)).cast("bigint").alias("row_no"), "image_values", values.alias("values"), "error")


def read_sets(spark: SparkSession, path: str, image_postfix: str, object_postfixes: Sequence[str],
              delimiter: str = ",", extension: str = ".csv") -> DataFrame:
    """One row per object of every complete set, all values as text, plus one error row per broken set.

    A set is one image, so its files are small; sets are spread over the cluster
    by their base name and glued by position inside one task each.
    """
    return _objects(_sets(_files(spark, path, extension), image_postfix, object_postfixes, delimiter, extension))


def infer_types(rows: DataFrame, names: Sequence[str], force_string: Sequence[str] = (),
                column: str = "values") -> dict[str, str]:
    """'double' iff every row parses as a float; id columns stay strings. One aggregate for all columns."""
    checks = [
        F.min(F.expr(f"try_cast(trim(`{column}`['{n}']) AS double)").isNotNull()).alias(f"c{i}")
        for i, n in enumerate(names)]
    row = rows.agg(*checks).first()
    return {n: "double" if row[i] and n not in force_string else "string" for i, n in enumerate(names)}


def typed_columns(rows: DataFrame, types: dict[str, str], keep: Sequence[str], column: str = "values",
                  features_only: bool = False) -> DataFrame:
    """Columns of a text map under the inferred types; object tables keep numeric columns only."""
    cols = []
    for name, kind in types.items():
        value = F.col(column)[name]
        if kind == "double":
            cols.append(F.trim(value).cast("double").alias(name))
        elif not features_only:
            cols.append(value.alias(name))
    return rows.select(*keep, *cols)


def map_names(rows: DataFrame, column: str = "values") -> list[str]:
    """Column names in the first set by base name; the first set fixes the schema."""
    row = rows.filter(F.size(column) > 0).agg(F.min_by(F.map_keys(column), F.struct("base", "row_no"))).first()
    return list(row[0] or [])


def image_files(names: Sequence[str], file_prefix: str = "FileName_", path_prefix: str = "PathName_") -> Column:
    """Array of (entity, path) from FileName_X / PathName_X column pairs."""
    entities = [n[len(file_prefix):] for n in names if n.startswith(file_prefix) and path_prefix + n[len(file_prefix):] in names]
    return F.array(*[
        F.struct(F.lit(e).alias("entity"), F.concat_ws("/", F.col(path_prefix + e), F.col(file_prefix + e)).alias("path"))
        for e in entities])


def encode_dimension(df: DataFrame, name: str | Column, order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Dense index of a name in order of first appearance, joined back.

    ``name`` is a column name or any extractor expression. The numbering runs
    over the dimension (one row per name), not over the table.
    """
    from pyspark.sql import Window

    column = F.col(name) if isinstance(name, str) else name
    named = df.withColumn(f"{label}_name", F.coalesce(column.cast("string"), F.lit("")))
    first = named.groupBy(f"{label}_name").agg(F.min(F.struct(*order)).alias("_first"))
    index = first.select(
        f"{label}_name", (F.row_number().over(Window.orderBy("_first", f"{label}_name")) - 1).alias(f"{label}_index"))
    return named.join(index, f"{label}_name"), index


def add_virtual_ids(objects: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add id and quality columns that are missing; ids come from stable keys."""
    missing = {n: c for n, c in defaults.items() if n not in objects.columns}
    return objects.withColumns(missing) if missing else objects


def import_csv(spark: SparkSession, path: str, image_postfix: str, object_postfixes: Sequence[str], delimiter: str = ",",
               extension: str = ".csv", id_columns: Sequence[str] = (),
               extractors: dict[str, Callable[[Sequence[str]], Column]] | None = None) -> dict[str, DataFrame]:
    """objects, images, errors and incomplete tables of a directory of CSV sets."""
    found = _files(spark, path, extension)
    sets = _sets(found, image_postfix, object_postfixes, delimiter, extension).persist()
    good = sets.filter("kind <> 'error'")
    per_image = good.select("base", "image_values", F.lit(0).alias("row_no")).dropDuplicates(["base"])
    image_names = map_names(per_image, "image_values")
    first = good.filter(F.size("names") > 0).agg(F.min_by("names", "base")).first()
    object_names = list(first[0] or [])
    image_types = infer_types(per_image, image_names, id_columns, "image_values")
    images = typed_columns(per_image, image_types, ["base"], "image_values")
    images = images.withColumn("image_files", image_files(image_names))
    for name, extractor in (extractors or {}).items():
        images = images.withColumn(name, extractor(images.columns))
    only = _objects(sets.filter("kind = 'object'"))
    object_types = infer_types(only, object_names, id_columns)
    objects = typed_columns(only, object_types, ["base", "row_no"], features_only=True)
    objects = objects.withColumn("object_id", F.concat_ws("#", "base", F.col("row_no").cast("string")))
    files = _listed(found, image_postfix, object_postfixes, extension).select("base", "kind")
    return {"objects": objects, "images": images, "errors": sets.filter("kind = 'error'").select("base", "error"),
            "incomplete": incomplete_sets(files, image_postfix, object_postfixes)}
