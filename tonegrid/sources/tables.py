"""JSON and Parquet sources and sinks of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tonegrid import schemas as S


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    """Song records; a broken file gives a row with only song_id (its folder) and _corrupt_record."""
    schema = T.StructType([*S.SONG.fields, T.StructField("_corrupt_record", T.StringType())])
    d = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
         .option("recursiveFileLookup", "true").json(path, multiLine=True))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return d.withColumn("song_id", F.coalesce("song_id", folder))


def missing_songs(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """Pairs naming a song without analysis (they cannot be scored)."""
    known = songs.select("song_id")
    absent = [pairs.join(known.withColumnRenamed("song_id", s), s, "left_anti").select(*pairs.columns) for s in ("song_a", "song_b")]
    return absent[0].unionByName(absent[1]).distinct()


def absent(error: AnalysisException) -> bool:
    """Nothing is stored at the path yet; any other fault is the caller's to see."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Cached embeddings; nothing stored yet gives an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not absent(error):
            raise
        return _empty(spark, S.EMBEDDING)


def read_ratings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Ratings from JSON lists (or one JSON object per line); missing or broken files give no rows."""
    try:
        schema = T.StructType([*S.RATING.fields, T.StructField("_corrupt_record", T.StringType())])
        d = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=not lines)
        return d.where(F.col("_corrupt_record").isNull() & F.col("mix_id").isNotNull()).drop("_corrupt_record")
    except AnalysisException as error:
        if not absent(error):
            raise
        return _empty(spark, S.RATING)


def read_mix_params(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pending parameters from JSON objects keyed by mix id, one per file (or line); missing or broken ones give no rows."""
    try:
        d = spark.read.text(path, wholetext=not lines)
    except AnalysisException as error:
        if not absent(error):
            raise
        return _empty(spark, S.MIX_PARAMS)
    entries = F.from_json("value", T.MapType(T.StringType(), S.PARAMS))
    return d.select(F.explode(entries).alias("mix_id", "_p")).where(F.col("_p").isNotNull()).select("mix_id", "_p.*")


def write_songs(songs: DataFrame, path: str, by_song: bool = False) -> None:
    """Replace the given songs' records (one partition each) or, by default, rewrite the table."""
    if by_song:
        (songs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("song_id").parquet(path))
    else:
        songs.write.mode("overwrite").parquet(path)


def append_mixes(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append fusion reports or mix parameters as Parquet or JSON lines."""
    df.write.mode("append").format(fmt).save(path)
