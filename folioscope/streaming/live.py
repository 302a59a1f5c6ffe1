"""Live versions of the analyses that make sense on streams (an addition; nothing here is needed for a batch)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_table(spark: SparkSession, folder: str, name: str, per_trigger: int = 1) -> DataFrame:
    """New files of a table's folder as a stream, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{name}")


def first_sightings(files: DataFrame, time_col: str, key: str = "sha256", delay: str = "30 days") -> DataFrame:
    """Each content once, as long as its repeats come within the delay."""
    return files.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time_col: str, by: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per tumbling window; what comes later than the delay is left out."""
    return (
        events.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), by).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), by, "n")
    )


class FolioBreaks(StatefulProcessor):
    """Breaks in a file's page numbers as its pages arrive: repeated, goes_back or jump."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        pages = sorted(int(n) for part in rows for n in part["number"].dropna())
        previous = self.last.get()[0] if self.last.exists() else None
        for n in pages:
            if previous is not None and n != previous + 1:
                out.append((key[0], n, previous, "repeated" if n == previous else "goes_back" if n < previous else "jump"))
            previous = n
        if previous is not None:
            self.last.update((previous,))
        yield pd.DataFrame(out, columns=["file_sha", "number", "previous", "kind"])

    def close(self) -> None:
        pass


def folio_breaks(pages: DataFrame) -> DataFrame:
    """Stream of breaks from a stream of file_sha, number."""
    return pages.groupBy("file_sha").transformWithStateInPandas(
        FolioBreaks(), outputStructType="file_sha string, number int, previous int, kind string", outputMode="Append", timeMode="None"
    )
