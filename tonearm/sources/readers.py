"""Audio folders, set history, detector output and playlist payloads as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.plans.staging import numbered

HISTORY = "brief string, approved boolean, captured_at double, paths array<string>, plan struct<arc:string, genre:string, slots:array<struct<position:double,path:string,title:string,artist:string,camelot:string,bpm:double,lufs:double>>>"
DETECTOR = "bpm double, beats array<double>, downbeats array<double>, segments array<struct<start:double, `end`:double, label:string>>"


def audio_folder(spark: SparkSession, folder: str, favourite: bool = False) -> DataFrame:
    """(path, is_favorite) of audio files anywhere under ``folder``, names only; a path part called favorites marks one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    files = files.where(F.lower("path").rlike(r"\.(mp3|wav|flac|m4a|aac|ogg)$"))
    return files.select("path", (F.lit(favourite) | F.array_contains(F.split(F.lower("path"), "/"), "favorites")).alias("is_favorite")).orderBy("path")


def history(spark: SparkSession, path: str) -> DataFrame:
    """The log of sets, one JSON record a line; blank and broken lines are passed over."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def append_history(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def recent_paths(log: DataFrame, within: int = 3, approved_only: bool = False) -> DataFrame:
    """Distinct paths of the last ``within`` sets."""
    rows = log.where("approved") if approved_only else log
    last = rows.orderBy(F.col("captured_at").desc()).limit(within)
    return last.select(F.explode("paths").alias("path")).distinct()


def without_recent(tracks: DataFrame, log: DataFrame, within: int = 3) -> DataFrame:
    """``tracks`` without those of the last ``within`` sets."""
    return tracks.join(recent_paths(log, within), "path", "left_anti").select(*tracks.columns)


def detected(json_column: DataFrame, column: str = "json") -> DataFrame:
    """Detector JSON parsed; a missing tempo comes from the median gap of the downbeats."""
    d = json_column.withColumn("d", F.from_json(column, DETECTOR)).select(*[c for c in json_column.columns if c != column], "d.*")
    gaps = F.array_sort(F.zip_with(F.slice("downbeats", 2, F.greatest(F.size("downbeats") - 1, F.lit(1))), F.slice("downbeats", 1, F.greatest(F.size("downbeats") - 1, F.lit(1))), lambda a, b: a - b))
    n = F.size(gaps)
    median = (F.get(gaps, F.floor((n - 1) / 2).cast("int")) + F.get(gaps, F.floor(n / 2).cast("int"))) / 2
    from tonearm.operators.structure import octave_correct

    return d.withColumn("bpm", F.when((F.coalesce("bpm", F.lit(0.0)) <= 0) & (F.size("downbeats") >= 2), octave_correct(240 / median)).otherwise(F.col("bpm")))


def playlist_entries(payload: DataFrame, column: str = "json") -> DataFrame:
    """(id, title, uploader, duration_s, url) of a flat playlist; null, nameless, deleted and private entries are left out."""
    entry = "struct<id:string,title:string,uploader:string,channel:string,duration:double>"
    e = payload.select(F.explode(F.from_json(column, f"struct<entries:array<{entry}>>")["entries"]).alias("e")).where("e is not null").select("e.*")
    e = e.where("id is not null and id <> '' and coalesce(title, '') not in ('[Deleted video]', '[Private video]')")
    return e.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.nullif("uploader", F.lit("")), "channel", F.lit("")).alias("uploader"), F.when(F.col("duration") > 0, F.col("duration")).alias("duration_s"), F.concat(F.lit("https://www.youtube.com/watch?v="), "id").alias("url"))


def newest_first(reviews: DataFrame) -> DataFrame:
    """Each parked review with its place, the newest first."""
    return numbered(reviews.where("status = 'pending'"), [F.col("captured_at").desc(), F.col("id")], "place").withColumn("place", F.col("place").cast("int"))
