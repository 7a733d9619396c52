"""Readers and writers, and how the star-schema tables stand in for rasters, rectangles and votes."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import portable_hash

COLUMNS = 100
AFFINE = (0, 30, 0, 0, 0, -30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: file, properties as columns, one row each, ids padded to four digits."""
    whole = spark.read.json(path, multiLine=True).select(F.explode("features").alias("f"))
    return whole.select("f.properties.*").withColumn("id", F.lpad(F.col("id").cast("string"), 4, "0"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``key; value`` lines; lines of other shapes are left out."""
    parts = F.split("value", ";")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def find_files(spark: SparkSession, folder: str, pattern: str, excluded: str | None = None) -> DataFrame:
    """(path, name, length) of files below a folder by a glob, less those whose path holds ``excluded``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    found = found if excluded is None else found.where(~F.contains("path", F.lit(excluded)))
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))


def first_match(files: DataFrame, tiles: DataFrame, name: str = "name", tile: str = "tile") -> DataFrame:
    """For each tile id, padded to four digits, the first file by name that holds it."""
    from ..operators.spatial import first_name_holding

    padded = tiles.select(F.lpad(F.col(tile).cast("string"), 4, "0").alias("_tile"), F.col(tile)).distinct()
    found = first_name_holding(files, padded, name, "_tile", 4)
    return found.groupBy(tile).agg(F.min(name).alias(name))


def read_support_sets(spark: SparkSession, folder: str, schema: StructType | str, table: str = "support_sets") -> DataFrame:
    """Support sets from the SQLite file ``sets.db`` of a folder if it is there, else from its ``sets.parquet``, else from its ``sets.txt``."""
    from .sqlite import read_sqlite

    there = lambda pattern: not spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path").limit(1).isEmpty()
    if there("sets.db"):
        held = read_sqlite(spark, f"{folder}/sets.db", table)
        wanted = spark.createDataFrame([], schema).schema
        return held.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    return spark.read.schema(schema).parquet(f"{folder}/sets.parquet") if there("*.parquet") else read_tsv(spark, f"{folder}/sets.txt", schema)


def samples_of(membership: DataFrame, set_id: int, in_bag: bool) -> DataFrame:
    """The sample ids of one set that are, or aren't, in its bag."""
    return membership.where((F.col("set_id") == set_id) & (F.col("in_bag") == in_bag)).select("id")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``int:text`` lines."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).cast("int").alias("key"), F.trim(parts[1]).alias("value"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the top level of a JSON file, values as text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def unzipped(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, name, content) of the files in the archives below a folder, one archive at a time in a task."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def opened(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for archive, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pa.record_batch({"archive": [archive], "name": [name], "content": pa.array([z.read(name)], pa.binary())})

    return held.mapInArrow(opened, "archive string, name string, content binary")


def with_attributes(layer: DataFrame, attributes: DataFrame, fid: str) -> DataFrame:
    """The geometry of one layer with the attributes of a table, by feature id."""
    return layer.join(attributes, fid)


def well_known(ring: str):
    """A ring as text; whole coordinates without decimals."""
    number = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ", "), F.lit("))"))


def write_layer(rects: DataFrame, path: str) -> None:
    """Rectangles as a layer of GeoJSON features, one a line; all other columns become properties of their own type."""
    corners = ("ul_x", "ul_y", "lr_x", "lr_y")
    point = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(point("ul_x", "ul_y"), point("lr_x", "ul_y"), point("lr_x", "lr_y"), point("ul_x", "lr_y"), point("ul_x", "ul_y"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(*[c for c in rects.columns if c not in corners]).alias("properties"))
    rects.select(F.to_json(feature).alias("value")).write.text(path)


def as_series(pixels: DataFrame) -> DataFrame:
    """(time, y, x, value): years since 1970, rows counted from the last one up."""
    last = F.broadcast(pixels.agg(F.max("row").alias("_last")))  # one row
    return pixels.crossJoin(last).select((F.col("year") - 1970).cast("int").alias("time"), (F.col("_last") - F.col("row")).cast("int").alias("y"), F.col("col").alias("x"), "value")


def write_series(pixels: DataFrame, path: str, attributes: dict) -> None:
    """A series by year, and its attributes (units, scale, nodata) beside it."""
    as_series(pixels).write.partitionBy("time").parquet(path)
    pixels.sparkSession.createDataFrame([(str(k), str(v)) for k, v in attributes.items()], "key string, value string").coalesce(1).write.json(f"{path}.attributes")


def last_commit(folder: str) -> str:
    """The last commit of the git repository that a folder of the driver lies in; empty where there is none."""
    import subprocess

    try:
        return subprocess.run(["git", "-C", folder, "log", "-1", "--format=%H"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return ""


def write_manifest(spark: SparkSession, path: str, parameters: dict, outputs: list[str], revision: str | None = None) -> None:
    """What made some outputs: one row for each, with the parameters and the code's revision, that of the working folder unless given, appended."""
    import json

    revision = last_commit(".") if revision is None else revision

    rows = [(o, json.dumps(parameters, sort_keys=True), revision) for o in outputs]
    made = spark.createDataFrame(rows, "output string, parameters string, revision string").withColumn("made_at", F.current_timestamp())
    made.coalesce(1).write.mode("append").json(path)


def still_to_do(wanted: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(made, keys, "left_anti")


def filled(template, values: dict):
    """A text with each ``{name}`` replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def rendered(rows: DataFrame, options: DataFrame, template: str) -> DataFrame:
    """Each row with each option (a short table) and ``script``, the template filled with both."""
    both = rows.crossJoin(F.broadcast(options))
    return both.withColumn("script", filled(F.lit(template), {c: F.col(c) for c in both.columns}))


def stacked(pixels: DataFrame, year: str, first_year: int) -> DataFrame:
    """Rasters of several years in one table, with ``year`` and its ``band``, counted from 1."""
    kept = [c for c in pixels.columns if c != year]
    return pixels.select(*kept, F.col(year).alias("year"), (F.col(year) - first_year + 1).alias("band"))


def write_raster(pixels: DataFrame, path: str, affine=AFFINE) -> None:
    """Pixels by tile, whole values in the narrowest type that holds them, and the affine beside them."""
    from ..operators.grid import narrowest

    whole = dict(pixels.dtypes)["value"] not in ("double", "float", "string")
    (narrowest(pixels, "value") if whole else pixels).write.partitionBy("tile_id").parquet(path)
    pixels.sparkSession.createDataFrame([tuple(map(float, affine))], "ul_x double, x_res double, x_rot double, ul_y double, y_rot double, y_res double").write.json(str(PurePosixPath(path)) + ".affine")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a raster of 100 columns."""
    o = table(spark, sf_dir, "orders")
    row, col = (F.col("o_orderkey") / COLUMNS).cast("int"), (F.col("o_orderkey") % COLUMNS).cast("int")
    return o.select(
        F.col("o_orderkey").alias("id"), row.alias("row"), col.alias("col"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("custkey"), (F.floor(row / 10) * 10 + F.floor(col / 10)).cast("int").alias("tile_id"),
        (30 * col + 15).alias("x"), (-(30 * row + 15)).alias("y"),
    )


#: The order of a table's rows, as SQL reads them: by file, and in it by number.
ORDER = ("file", "place")


def votes(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """``lineitem`` as votes: one for each line of an order, from the supplier's set; also its file and its place there if ``placed``."""
    lines = table(spark, sf_dir, "lineitem")
    file = F.col("_metadata.file_path") if placed and len(lines.inputFiles()) > 1 else F.lit("")  # long names are dear to sort
    place = [file.alias("file"), F.col("_metadata.row_index").alias("place")] if placed else []
    return lines.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("set_id"), F.col("l_quantity").cast("int").alias("vote"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), *place)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and prediction of each pixel that has both, each from 0 to 99, and whether it is in the sample of one fifth.

    Predictions come from exact sums, whatever the order of lines; SQL's are those of ``pairs_in_order``.
    """
    # sums of doubles follow the order of rows, and one that should lie on a whole number falls to either side of it
    parts = F.round(F.col("price") * 1_000_000).cast("bigint")
    predicted = votes(spark, sf_dir).groupBy("id").agg(F.sum(parts).alias("s"), F.count("price").alias("n")).select("id", F.expr("s div nullif(n * 1050000000, 0)").cast("int").alias("pred"))
    return with_reference(spark, sf_dir, predicted)


def pairs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` with predictions from sums of doubles in the order of lines, as SQL has them."""
    from ..operators.ensemble import added_in_order

    means = added_in_order(votes(spark, sf_dir, placed=True), "id", ORDER, {"mean": F.avg("price")})
    return with_reference(spark, sf_dir, means.select("id", (F.col("mean") / 1050).cast("int").alias("pred")))


def with_reference(spark: SparkSession, sf_dir: str, predicted: DataFrame) -> DataFrame:
    ref = pixels(spark, sf_dir).withColumn("ref", (F.col("value") / 5000).cast("int"))
    sampled = portable_hash(F.col("id"), 0) < 858993459
    return ref.join(predicted, "id").withColumn("sampled", sampled)


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as support rectangles over the raster."""
    rows = F.broadcast(table(spark, sf_dir, "orders").agg((F.count("*") / COLUMNS).cast("bigint").alias("n_rows")))  # one row
    s = table(spark, sf_dir, "supplier").crossJoin(rows)
    side = 30 * (10 + F.col("s_nationkey"))
    s = s.select(F.col("s_suppkey").alias("set_id"), (30 * (F.col("s_suppkey") * 37 % 100)).alias("ul_x"), (-30 * (F.col("s_suppkey") * 53 % F.col("n_rows"))).alias("ul_y"), side.cast("bigint").alias("side"))
    return s.select("set_id", "ul_x", "ul_y", (F.col("ul_x") + F.col("side")).alias("lr_x"), (F.col("ul_y") - F.col("side")).alias("lr_y"))


#: The same in SQL.
ADAPTERS = {
    "px": """px AS (SELECT o_orderkey AS id, CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col, o_totalprice AS value, o_orderstatus AS status, o_orderpriority AS priority,
      o_custkey AS custkey, CAST((o_orderkey // 1000) * 10 + (o_orderkey % 100) // 10 AS INTEGER) AS tile_id, CAST(30 * (o_orderkey % 100) + 15 AS INTEGER) AS x, CAST(-(30 * (o_orderkey // 100) + 15) AS INTEGER) AS y FROM orders)""",
    "votes": "votes AS (SELECT l_orderkey AS id, l_suppkey AS set_id, CAST(trunc(l_quantity) AS INTEGER) AS vote, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag FROM lineitem)",
    "pair": """pair AS (SELECT p.*, CAST(trunc(p.value / 5000) AS INTEGER) AS ref, q.pred, ((((p.id * 2654435761) % 4294967296) * 1597334677 + 12345) % 4294967296) < 858993459 AS sampled
      FROM px p JOIN (SELECT id, CAST(trunc(avg(price) / 1050) AS INTEGER) AS pred FROM votes GROUP BY id) q USING (id))""",
    "rect": """rect AS (SELECT set_id, ul_x, ul_y, ul_x + side AS lr_x, ul_y - side AS lr_y FROM (SELECT s_suppkey AS set_id, 30 * (s_suppkey * 37 % 100) AS ul_x,
      -30 * (s_suppkey * 53 % (SELECT count(*) // 100 FROM orders)) AS ul_y, CAST(30 * (10 + s_nationkey) AS BIGINT) AS side FROM supplier))""",
}


def sql(*names: str, body: str) -> str:
    """A query over some of the adapters."""
    needed = [n for n in ("px", "votes", "pair", "rect") if n in names or (n in ("px", "votes") and "pair" in names)]
    return "WITH " + ",\n".join(ADAPTERS[n] for n in needed) + "\n" + body
