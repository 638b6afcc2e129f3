"""Scans of the operational inputs as DataFrames with an order that survives the shuffle: seq within a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import SECOND
from ..operators import ordered, shared

#: Fixed value: media type of the layer that holds a model's weights.
MODEL_LAYER = "application/vnd.ollama.image.model"


def _sequence(lines: DataFrame, chained: bool = False) -> DataFrame:
    """file, seq, message of text rows in file order: within a file, or, if chained, through all files by name.

    A file is read in blocks. Rows are numbered inside their block, and a block begins where those before it end: what is ordered in one
    place is a block, or a short row for each block.
    """
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("message"))
    blocks = placed.groupBy("file", "block").agg(F.count("*").alias("n"))
    ahead = (Window.orderBy("file", "block") if chained else Window.partitionBy("file").orderBy("block")).rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("row"))
    return placed.withColumn("inside", inside).join(begins, ["file", "block"]).select("file", (F.col("begin") + F.col("inside")).alias("seq"), "message")


def journal_scan(spark: SparkSession, path: str) -> DataFrame:
    """file, ts_us, message of journal JSON: times in microseconds; messages are text or byte arrays; other rows are skipped."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    text = F.from_json("value", "__REALTIME_TIMESTAMP string, MESSAGE string")
    bytes_ = F.from_json("value", "MESSAGE array<int>")["MESSAGE"]
    joined = F.unhex(F.array_join(F.transform(bytes_, lambda b: F.lpad(F.hex(F.pmod(b, F.lit(256))), 2, "0")), ""))
    message = F.when(bytes_.isNotNull(), F.try_validate_utf8(F.decode(joined, "utf-8"))).otherwise(text["MESSAGE"])
    out = raw.select("file", text["__REALTIME_TIMESTAMP"].try_cast("long").alias("ts_us"), message.alias("message"))
    return out.where("ts_us is not null and message is not null")


def log_scan(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, message of plain log files, blank lines skipped."""
    return _sequence(spark.read.text(path).select("value", "_metadata")).where(F.trim("message") != "")


def startup_scan(spark: SparkSession, folder: str, newest: bool = False) -> DataFrame:
    """file, seq, message of a folder in which each start of a server begins a new *.log file: seq runs through the files by name.

    newest: only the file whose name is the last, the one that is still written.
    """
    raw = spark.read.option("pathGlobFilter", "*.log").text(folder).select("value", "_metadata")
    if newest:
        last = raw.agg(F.max("_metadata.file_path")).first()[0]
        raw = raw.where(F.col("_metadata.file_path") == F.lit(last))
    return _sequence(raw, chained=True).where(F.trim("message") != "")


def scrape_scan(spark: SparkSession, folder: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """source, ts_us, body of stored answers <folder>/<source>/<microseconds>.<kind>, one a file: Prometheus texts or JSON polls.

    Times are in the names, padded to one length: files outside [since, until) are left out by name, unread.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    name = F.col("_metadata.file_name")
    if since_us is not None:
        raw = raw.where(name >= f"{since_us:020d}")
    if until_us is not None:
        raw = raw.where(name < f"{until_us:020d}")
    parts = F.split("_metadata.file_path", "/")
    return raw.select(F.element_at(parts, -2).alias("source"), F.substring_index(F.element_at(parts, -1), ".", 1).try_cast("long").alias("ts_us"), F.col("value").alias("body")).where("ts_us is not null")


def container_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """As log_scan(), with the stamp that container runtimes put before each line split off as ts_us."""
    lines = log_scan(spark, path)
    stamp = F.nullif(F.regexp_extract("message", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d))\s", 1), F.lit(""))
    return lines.select("file", "seq", iso_us(stamp).alias("ts_us"), F.when(stamp.isNotNull(), F.regexp_replace("message", r"^\S+\s", "")).otherwise(F.col("message")).alias("message"))


def device_scan(spark: SparkSession, path: str) -> DataFrame:
    """Device samples of CSV lines (index, utilisation, memory used and total, temperature, power, limit); [N/A] is null."""
    names = ("gpu_index", "util_pct", "mem_used", "mem_total", "temp_c", "power_w", "power_limit")
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 7)
    return rows.select(F.get("p", F.lit(0)).cast("int").alias(names[0]), *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names[1:], 1)]).where("gpu_index is not null")


def with_pcie(samples: DataFrame, readings: DataFrame) -> DataFrame:
    """Samples with the optional bus readings of the same time and device."""
    return samples.join(readings, ["ts_us", "gpu_index"], "left")


def manifest_scan(spark: SparkSession, path: str) -> DataFrame:
    """digest, model of model manifests <registry>/<namespace>/<name>/<tag>; the default namespace is left off."""
    return manifests_of(spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file")))


def manifests_of(raw: DataFrame) -> DataFrame:
    """digest, model of manifest texts (value) and the paths (file) they were read from."""
    parts = F.split("file", "/")
    name, tag, space = F.element_at(parts, -2), F.element_at(parts, -1), F.element_at(parts, -3)
    layers = F.from_json("value", "layers array<struct<mediaType string, digest string>>")["layers"]
    model = F.concat(F.when(space == "library", F.lit("")).otherwise(F.concat(space, F.lit("/"))), name, F.lit(":"), tag)
    return raw.select(model.alias("model"), F.explode(layers).alias("l")).where(F.col("l.mediaType") == MODEL_LAYER).select("l.digest", "model")


def iso_us(text: Column) -> Column:
    """Microseconds of an ISO time, cut to microseconds; a time without an offset is taken as UTC; null if it isn't one."""
    t = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.unix_micros(F.try_to_timestamp(t))


def iso_offset_s(text: Column) -> Column:
    """Seconds east of UTC that an ISO time declares; null without an offset."""
    sign, hours, minutes = (F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", i) for i in (1, 2, 3))
    seconds = (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60) * F.when(sign == "-", -1).otherwise(1)
    return F.when(text.rlike(r"[Zz]$"), 0).when(text.rlike(r"[+-]\d\d:?\d\d$"), seconds)


def with_clock(lines: DataFrame, default_offset_s: int = 0) -> DataFrame:
    """lines (source, seq, message) with clock_us, the time that the line itself gives, and offset_s in force.

    In this order: time=<ISO with offset>; the access log's clock (2024/01/02 - 03:04:05); the logger's clock (2024-01-02 03:04:05.678).
    A clock without an offset takes the last one declared in its source up to this line, else the default.
    """
    m = F.col("message")
    get = lambda p: F.nullif(F.regexp_extract(m, p, 1), F.lit(""))
    own = get(r"^time=(\S+)")
    access = F.replace(F.replace(get(r"^\[GIN\]\s+(\d{4}/\d\d/\d\d - \d\d:\d\d:\d\d)"), F.lit("/"), F.lit("-")), F.lit(" - "), F.lit(" "))
    logger = get(r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})")
    told = iso_offset_s(own)
    d = ordered.running(lines, {"told": ("max", F.when(told.isNotNull(), F.struct("seq", told.alias("offset_s"))), True)})
    d = d.withColumn("offset_s", F.coalesce("told.offset_s", F.lit(default_offset_s))).drop("told")
    naive = F.coalesce(iso_us(access), iso_us(logger)) - F.col("offset_s").cast("long") * SECOND
    return d.withColumn("clock_us", F.coalesce(iso_us(own), naive))


def banner_clock(lines: DataFrame, part: int = ordered.PART) -> DataFrame:
    """lines (source, seq, message) of a log whose lines have a time but no date, with ts_us.

    The date comes from the last banner; a clock that falls by over half a day has passed midnight. Banners, the clock before a line and
    midnights run in parts of seq, however long a log runs under one banner.
    """
    m = F.col("message")
    date = F.nullif(F.regexp_extract(m, r"^==\s*\S+ logs\s+(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit(""))
    clock = F.nullif(F.regexp_extract(m, r"^(\d\d:\d\d:\d\d(?:\.\d+)?)\s", 1), F.lit(""))
    parts = F.split(clock, ":")
    day_us = ((F.get(parts, F.lit(0)).cast("long") * 3600 + F.get(parts, F.lit(1)).cast("long") * 60) * SECOND + F.round(F.get(parts, F.lit(2)).cast("double") * SECOND)).cast("long")
    d = lines.withColumns({"__day": day_us, "__on": date})
    last = lambda c: F.when(F.col(c).isNotNull(), F.struct("seq", c))
    d = ordered.running(d, {"__banner": ("max", last("__on"), True), "__before": ("max", last("__day"), False)}, part=part)
    same = F.col("__banner").isNull() | (F.col("__before.seq") > F.col("__banner.seq"))
    wrapped = F.coalesce((same & (F.col("__day") - F.col("__before.__day") < -43_200 * SECOND)).cast("int"), F.lit(0))
    d = shared.written(d.withColumns({"__wrap": wrapped, "__under": F.to_json(F.struct("source", "__banner.seq"))}))
    d = ordered.running(d, {"__days": ("sum", F.col("__wrap"), True)}, key="__under", part=part)
    start = F.unix_micros(F.to_timestamp("__banner.__on", "yyyy-M-d"))
    return d.select(*[c for c in lines.columns if c != "ts_us"], (start + F.col("__days") * 86_400 * SECOND + F.col("__day")).alias("ts_us"))
