"""Zipped accelerograms: one archive for each event and station, one text for each channel."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators.curation import without_zone

#: Lines before the samples of a text (fixed value of the format).
HEADER_LINES = 6

ENTRY = "file string, entry string, channel string, start string, rate double, latitude double, longitude double, values array<double>, error string"


def parse_entry(text: str) -> tuple[str, float, float, float, list[float]]:
    """Start, samples a second, latitude, longitude and samples of one text; a damaged one raises ValueError."""
    lines = text.splitlines()
    if len(lines) < HEADER_LINES or not all(line.startswith("#") for line in lines[:HEADER_LINES]):
        raise ValueError(f"{HEADER_LINES} lines that begin with # are missing")
    words = [line.split() for line in lines[:HEADER_LINES]]
    try:
        start, rate, latitude, longitude = words[0][-1], float(words[1][4]), float(words[4][2]), float(words[4][4])
    except IndexError:
        raise ValueError("the header lacks the start, the rate or the place") from None
    if not rate > 0:
        raise ValueError("the rate is not over 0")
    return start, rate, latitude, longitude, [float(line) for line in lines[HEADER_LINES:] if line.strip()]


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text of each archive, one archive at a time; what cannot be read has its error."""
    names = [part.split(" ")[0] for part in ENTRY.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = []
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
                inside = [n for n in archive.namelist() if not n.endswith("/")]
            except zipfile.BadZipFile as error:
                rows, inside = [(path, None, None, None, None, None, None, None, f"archive: {error}")], []
            for name in inside:
                channel = name.rpartition("-")[2][:-4]
                try:
                    made = parse_entry(archive.read(name).decode())
                    rows.append((path, name, channel, *made, None))
                except (ValueError, zipfile.BadZipFile, zipfile.zlib.error, NotImplementedError, EOFError, RuntimeError) as error:
                    rows.append((path, name, channel, None, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=names)


def read_archives(spark: SparkSession, path: str, stations: list[str] | None = None) -> DataFrame:
    """One row for each channel of each archive `<event>_<station>.zip` below a folder, in any store that Spark reads.

    event, station, channel (the last part of the text's name), start, rate, latitude, longitude, values and error. With
    `stations` only their archives are listed and opened. A text or an archive that cannot be read is a row with its error
    and without values; an empty archive has no rows. Archives are dealt to tasks by their sizes and opened one by one.
    """
    pattern = "*.zip" if stations is None else "*_{" + ",".join(stations) + "}.zip"
    if stations is not None and not stations:
        return read_archives(spark, path).where("false")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    made = files.select("path", "content").mapInPandas(_entries, ENTRY)
    name = F.regexp_extract("file", r"([^/]*)\.zip$", 1)
    return made.select(
        F.regexp_extract(name, r"^(.*)_[^_]*$", 1).alias("event"), F.regexp_extract(name, r"([^_]*)$", 1).alias("station"), "entry", "channel",
        without_zone(F.col("start")).try_cast("timestamp_ntz").alias("start"), "rate", "latitude", "longitude", "values", "error",
    )


def sample_times(start: Column, rate: Column, values: Column) -> Column:
    """The time of each sample, to the microsecond; null for a record without start or rate."""
    micros = lambda i: F.round(i * 1e6 / rate).cast("long")
    return F.transform(values, lambda _, i: F.timestamp_add("MICROSECOND", micros(i), start))
