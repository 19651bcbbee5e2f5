"""Readers: explicit schemas, partition pruning, harmonised hotspot rows."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hotspark.functions.timefns import packed_time, polar_time

# Columns of the polar product, in file order.
POLAR_COLUMNS = [
    "latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_ti5",
    "frp", "daynight",
]
_TEXT = {"acq_date", "satellite", "instrument", "confidence", "version", "daynight"}
POLAR_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType() if n in _TEXT else T.IntegerType() if n == "acq_time" else T.DoubleType()) for n in POLAR_COLUMNS]
)

# Columns of the geostationary product, in file order.
GEO_COLUMNS = [
    "BW_SIZE", "BW_NUMPIX", "BW_BT_MIR", "BW_BTD", "RAD_BCK", "STD_BCK", "FIRE_CONFIDENCE", "BT_MIR", "BT_TIR", "RAD_PIX", "PIXEL_VZA", "PIXEL_SZA",
    "PIXEL_SIZE", "LONGITUDE", "LATITUDE", "ACQTIME", "ABS_LINE", "ABS_SAMP", "FRP", "ERR_FRP_COEFF", "ERR_ATM_TRANS", "ERR_RADIOMETRIC",
    "ERR_BACKGROUND", "ERR_VERT_COMP", "FRP_UNCERTAINTY", "PIXEL_ATM_TRANS", "LONGITUDE_PARALLAX", "LATITUDE_PARALLAX",
]
GEO_REQUIRED = ["ACQTIME", "FRP", "LONGITUDE", "LATITUDE"]
GEO_DROPPED = ["ABS_LINE", "ABS_SAMP", "LONGITUDE_PARALLAX", "LATITUDE_PARALLAX"]
GEO_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in GEO_COLUMNS])


def read_by_header(spark: SparkSession, path: str, schema: T.StructType, required: list[str], skip: str | None = None) -> DataFrame:
    """CSV files below `path`, bound by the names in their header, whatever their order.

    The header of one file is taken as the layout of the folder; a file with another
    header is an error, as is a header without a required column or with a column that
    `schema` does not know. Case does not count. Columns that the files lack are null.
    Folder columns (name=value) stay. Files whose name contains `skip` are left out.
    A folder without files gives an empty frame with the schema's columns.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", False)
    try:
        found = reader.csv(path)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    folders = [f.name for f in found.schema.fields if f.name in _folder_columns(found)]
    header = [c for c in found.columns if c not in folders]
    known = {f.name.lower(): f for f in schema.fields}
    if unknown := [c for c in header if c.lower() not in known]:
        raise ValueError(f"unknown columns in {path}: {unknown}")
    names = {c.lower(): c for c in [*header, *folders]}
    if missing := [c for c in required if c.lower() not in names]:
        raise ValueError(f"no column {missing} in {path}")
    raw = reader.option("enforceSchema", False).schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    if skip is not None:
        raw = raw.where(~F.col("_metadata.file_name").contains(skip))
    cols = [
        (F.col(f"`{names[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in names else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return raw.select(*cols, *(f"`{c}`" for c in raw.columns if c in folders and c.lower() not in known))


def _folder_columns(df: DataFrame) -> set[str]:
    """Names in the folders (name=value) of a frame's files; one file's path tells them."""
    one = df.select(F.col("_metadata.file_path").alias("p")).limit(1).collect()
    return {part.split("=")[0] for part in one[0]["p"].split("/") if "=" in part} if one else set()


def read_platforms(spark: SparkSession, paths: list[str], schema: T.StructType, required: list[str], skip: str | None = None) -> DataFrame:
    """The rows of several platforms' folders, each with its own column order."""
    out = read_by_header(spark, paths[0], schema, required, skip)
    for path in paths[1:]:
        out = out.unionByName(read_by_header(spark, path, schema, required, skip), allowMissingColumns=True)
    return out


def clip(df: DataFrame, domain: tuple[float, float, float, float], lon="longitude", lat="latitude") -> DataFrame:
    """Keep rows inside W, S, E, N (edges included)."""
    west, south, east, north = domain
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def clean_geostationary(raw: DataFrame, domain: tuple[float, float, float, float]) -> DataFrame:
    """Required columns present, names harmonised, domain clipped, packed time parsed."""
    present = raw.dropna(subset=GEO_REQUIRED).withColumnsRenamed(
        {"LONGITUDE": "longitude", "LATITUDE": "latitude", "FRP": "frp"}
    )
    return clip(present, domain).withColumn("ts", packed_time(F.col("ACQTIME"), F.col("slot")))


def clean_polar(raw: DataFrame) -> DataFrame:
    """Rows with a place, a power and a time; the polar product is not clipped."""
    present = raw.dropna(subset=["latitude", "longitude", "frp", "acq_time"])
    return present.withColumn("ts", polar_time(F.col("acq_date"), F.col("acq_time")))


def read_polar(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """All polar CSV files below `path`, by header; folder columns such as sat= and day= prune files.

    `skip` names files to leave out, such as the hour file that still holds the day before.
    """
    return read_by_header(spark, path, POLAR_SCHEMA, ["latitude", "longitude", "frp", "acq_date", "acq_time"], skip)


def read_geostationary(spark: SparkSession, path: str) -> DataFrame:
    """All geostationary CSV files below `path`, by header, with the slot of their folder slot=yyyyMMddHHmm."""
    raw = read_by_header(spark, path, GEO_SCHEMA, GEO_REQUIRED)
    return raw.withColumn("slot", F.to_timestamp(F.col("slot").cast("string"), "yyyyMMddHHmm"))


def empty_hotspots(spark: SparkSession, schema: T.StructType = POLAR_SCHEMA) -> DataFrame:
    """The typed empty frame of a slot without files."""
    return spark.createDataFrame([], schema)


_COORDS = "array<array<array<double>>>"
_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON feature collections: one row per outer ring with its holes, properties kept as a map.

    A collection is one document and so one task per file; for large layers write
    one feature per line and use `read_feature_lines`.
    """
    docs = spark.read.text(path, wholetext=True)
    parsed = docs.select(F.from_json("value", f"struct<features:array<{_FEATURE}>>").alias("d"))
    return _rings(parsed.select(F.explode("d.features").alias("f")))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON with one feature per line; files are split like any text."""
    return _rings(spark.read.text(path).select(F.from_json("value", _FEATURE).alias("f")))


def _rings(features: DataFrame) -> DataFrame:
    coords = _COORDS
    rows = features.select(
        F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c")
    )
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", coords))).when(
        F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{coords}>")
    )
    def ring(r):
        return F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    holes = F.transform(F.slice("part", 2, F.greatest(F.size("part") - 1, F.lit(0))), ring)
    return rows.select("properties", "kind", F.posexplode(parts).alias("part_no", "part")).select(
        "properties", "kind", "part_no", ring(F.col("part")[0]).alias("ring"), holes.alias("holes")
    )


def snapshot_at(table: DataFrame, when: str | None = None, column: str = "snapshot_ts") -> DataFrame:
    """The newest snapshot at or before `when` (newest of all by default).

    The newest time comes from the names of the table's folders, which the driver has
    listed already; no file is opened for it, and the read prunes to one partition.
    """
    mark = f"/{column}="
    names = {unquote(unquote(p.split(mark)[1].split("/")[0])) for p in table.inputFiles() if mark in p}
    times = table.sparkSession.createDataFrame([(n,) for n in sorted(names)], "name string").select(F.col("name").cast("timestamp").alias("t"))
    if when is not None:
        times = times.where(F.col("t") <= F.lit(when).cast("timestamp"))
    top = times.agg(F.date_format(F.max("t"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first()["m"]
    return table.where(F.col(column) == F.lit(top).cast("timestamp")) if top is not None else table.limit(0)


def snapshots_between(table: DataFrame, start: str, end: str, column: str = "snapshot_ts") -> DataFrame:
    """Snapshots with start <= time <= end; prunes partitions."""
    return table.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def duplicate_ids(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).count().where("count > 1").select(key)
