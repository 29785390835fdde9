"""Inputs: galleries, probes, speaker metadata and clip files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions.text import (
    CLIP_SUFFIX,
    UNKNOWN,
    clean_gender,
    clean_id,
    clean_nationality,
    speaker_of,
)
from nearkin.functions.vectors import as_double, l2_normalize, norm

# Column names under which inputs are known.
VECTOR_NAMES = ("embeddings", "x", "embedding")
LABEL_NAMES = ("speakers", "speaker_id")
PATH_NAMES = ("processed_files", "file_paths", "file_path")
METADATA_COLUMNS = {"id_raw": "VoxCeleb1 ID", "gender_raw": "Gender", "nationality_raw": "Nationality"}


def dim_violations(frame: DataFrame, dim: int, key: str = "id") -> DataFrame:
    size = F.size("embedding")
    return frame.where(size != dim).select(key, size.alias("dim"))


def bad_elements(vector):
    """How many elements of a vector are null, NaN or infinite."""
    return F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def require_finite(vector):
    """The vector; fails the job that reads it at any null or non-finite element."""
    bad = bad_elements(vector)
    message = F.concat(F.lit("null or non-finite elements in a vector: "), bad.cast("string"))
    return F.when(vector.isNull() | (bad == 0), vector).otherwise(F.raise_error(message))


def require_dim(frame: DataFrame, dim: int) -> DataFrame:
    """Fail the job that reads the rows at any vector of another width or with a non-finite element.

    The check rides on the scan; ``dim_violations`` lists the rows of another width.
    """
    vector, size = F.col("embedding"), F.size("embedding")
    message = F.concat(F.lit(f"expected vectors of width {dim}, got "), size.cast("string"))
    checked = F.when(vector.isNull() | (size == dim), require_finite(vector)).otherwise(F.raise_error(message))
    return frame.withColumn("embedding", checked)


def _alias(frame: DataFrame, names: tuple[str, ...], required: bool):
    """The first of the names that holds a value in a row."""
    present = [F.col(n) for n in names if n in frame.columns]
    if not present and required:
        raise ValueError(f"input has none of the columns {', '.join(names)}")
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def as_gallery(frame: DataFrame) -> DataFrame:
    """``(speaker_id, file_path, embedding)`` from a table with any of the known names."""
    return frame.select(
        _alias(frame, LABEL_NAMES, True).cast("string").alias("speaker_id"),
        _alias(frame, PATH_NAMES, True).alias("file_path"),
        _alias(frame, VECTOR_NAMES, True).alias("embedding"),
    )


def as_probes(frame: DataFrame) -> DataFrame:
    """``(query_id, speaker_id, file_path, embedding)``, vectors normalised, labels required."""
    return frame.select(
        "query_id",
        _alias(frame, LABEL_NAMES, True).cast("string").alias("speaker_id"),
        _alias(frame, PATH_NAMES, False).alias("file_path"),
        l2_normalize(require_finite(as_double(_alias(frame, VECTOR_NAMES, True)))).alias("embedding"),
    )


def read_gallery(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return require_dim(as_gallery(spark.read.parquet(path)), dim)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return as_probes(spark.read.parquet(path))


def describe_vectors(frame: DataFrame) -> DataFrame:
    """Everything but the vector, with its width and length."""
    rest = [c for c in frame.columns if c != "embedding"]
    return frame.select(*rest, F.size("embedding").alias("dim"), norm(as_double("embedding")).alias("norm"))


def clean_metadata(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``(speaker_id, gender, nationality)`` from raw text; the later row of an id wins."""
    cleaned = raw.select(
        clean_id(F.col("id_raw")).alias("speaker_id"),
        clean_gender(F.col("gender_raw")).alias("gender"),
        clean_nationality(F.col("nationality_raw")).alias("nationality"),
        *(order or []),
    ).where(F.col("speaker_id") != "")
    if not order:
        return cleaned
    last = F.max_by(F.struct("gender", "nationality"), F.struct(*order)).alias("last")
    return cleaned.groupBy("speaker_id").agg(last).select("speaker_id", "last.*")


def read_metadata(spark: SparkSession, path: str | None) -> DataFrame:
    """Speaker metadata from a tab or comma separated file with a header line.

    A missing file is an empty lookup.
    """
    empty = spark.createDataFrame([], "speaker_id string, gender string, nationality string")
    if not path or not path_exists(spark, path):
        return empty
    header = spark.read.text(path).first()
    if header is None:
        return empty
    separator = "\t" if "\t" in header[0] else ","
    table = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=True)

    def column(name: str):
        # an absent column reads as unknown, an empty cell and an absent id as an empty text
        absent = "" if name == METADATA_COLUMNS["id_raw"] else UNKNOWN
        return F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in table.columns else F.lit(absent)

    raw = table.select(
        *[column(name).alias(raw_name) for raw_name, name in METADATA_COLUMNS.items()],
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return clean_metadata(raw, ["_block", "_line"])


def path_exists(spark: SparkSession, path: str) -> bool:
    # binaryFile lists without reading; a path that is not there fails on analysis
    try:
        spark.read.format("binaryFile").load(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def clip_catalog(spark: SparkSession, root: str, suffix: str = CLIP_SUFFIX) -> DataFrame:
    """``(file_path, speaker_id, size)`` of all clips below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .load(root)
    )
    return catalog_rows(files.select(F.col("path").alias("file_path"), F.col("length").alias("size")), suffix)


def catalog_rows(files: DataFrame, suffix: str = CLIP_SUFFIX) -> DataFrame:
    """``(file_path, speaker_id, size)`` of the listed files (file_path, size) that are clips."""
    path = F.col("file_path")
    return files.where(path.endswith(suffix)).select(path, speaker_of(path).alias("speaker_id"), "size")


def speakers_with_default(clips: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every speaker of the clips, with unknown gender and nationality where nothing is known."""
    ids = clips.select("speaker_id").distinct()
    joined = ids.join(metadata, "speaker_id", "left")
    return joined.select(
        "speaker_id", *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("gender", "nationality")]
    )


def conjunction(*conditions):
    """AND of the conditions that are given."""
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def gallery_filter(gender=None, nationalities=None, clusters=None):
    """Filter on gender, nationalities and clusters.

    An empty list of nationalities filters nothing, an empty list of clusters
    lets nothing pass; None filters nothing.
    """
    return conjunction(
        None if gender is None else F.col("gender") == gender,
        F.col("nationality").isin(list(nationalities)) if nationalities else None,
        None if clusters is None else F.col("cluster_id").isin(list(clusters)),
    )
