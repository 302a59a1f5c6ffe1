"""Files in and out: ingest, staged writes, CSV with a byte order mark, snapshots, profiles, catalogues."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an ingested PDF begins with.
PDF_MARK = b"%PDF"


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """sha256, original_path, file_name, bytes, valid of every file below a folder.

    Read distributed; a file that isn't a PDF is marked, never an error. Files of no bytes are not seen.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select(
        F.sha2("content", 256).alias("sha256"), F.col("path").alias("original_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("bytes"), (F.substring(F.hex(F.substring("content", 1, 4)), 1, 8) == PDF_MARK.hex().upper()).alias("valid"),
    )


def ingest(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new files, sightings of known content, rejected files); of equal new files the first path counts."""
    good = found.where("valid")
    first = good.groupBy("sha256").agg(F.min("original_path").alias("original_path"))
    fresh = good.join(first, ["sha256", "original_path"]).join(known.select("sha256").distinct(), "sha256", "left_anti")
    again = good.join(fresh.select("sha256", "original_path"), ["sha256", "original_path"], "left_anti").select("sha256", "original_path")
    return fresh, again, found.where("not valid").select("original_path", "bytes", F.lit("no PDF").alias("reason"))


def write_staged(df: DataFrame, target: str) -> None:
    """Write a table so that readers see all or nothing: a partial folder is renamed at the end."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    final, partial = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(target + ".partial")
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        raise FileExistsError(target)
    df.write.mode("overwrite").parquet(target + ".partial")
    if not fs.rename(partial, final):
        raise OSError(f"{target} could not be put in place")


def write_csv(df: DataFrame, target: str) -> None:
    """CSV parts with `;`, a header and a byte order mark in the first column's name, for spreadsheets."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("errorifexists").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(target)


def read_reference_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A hand transcription: all columns as text, in the given order, no guessing of types."""
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in columns))


def snapshot(tables: dict[str, DataFrame], target: str) -> None:
    """A consistent copy of all tables; an existing snapshot is never overwritten."""
    for name, df in tables.items():
        write_staged(df, f"{target}/{name}")
    df.sparkSession.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.json(f"{target}/_tables")


def inspect_snapshot(spark: SparkSession, target: str) -> dict[str, int]:
    """Rows per table of a snapshot; a missing table raises."""
    names = [r.name for r in spark.read.json(f"{target}/_tables").collect()]
    return {n: spark.read.parquet(f"{target}/{n}").count() for n in names}


def restore(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of a snapshot."""
    return {n: spark.read.parquet(f"{target}/{n}") for n in inspect_snapshot(spark, target)}


def switch_base(spark: SparkSession, target: str, pointer: str) -> str | None:
    """Make the snapshot `target` the current base; returns the base before, which stays where it is.

    The snapshot is inspected first, so that a broken one never becomes current. The pointer
    is a small table of its own: each switch appends one row, and the last row counts.
    """
    inspect_snapshot(spark, target)
    before = current_base(spark, pointer)
    number = 0 if before is None else spark.read.json(pointer).agg(F.max("number")).first()[0] + 1
    spark.createDataFrame([(number, target, before)], "number bigint, base string, before string").coalesce(1).write.mode("append").json(pointer)
    return before


def current_base(spark: SparkSession, pointer: str) -> str | None:
    """The snapshot that the pointer names, null if there is no pointer yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("number bigint, base string, before string").json(pointer).agg(F.max_by("base", "number")).first()[0]


def upgrade(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the columns that an older table lacks, as nulls; nothing is dropped."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@dataclass(frozen=True)
class Profile:
    """A declared kind of paper: what must or may stand in it, and patterns of its fields."""

    name: str
    needs_any: tuple[str, ...]
    needs_none: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]

    def applies(self, text: Column) -> Column:
        """Whether a folded text fits the profile."""
        hit = F.lit(False)
        for w in self.needs_any:
            hit = hit | text.contains(w)
        for w in self.needs_none:
            hit = hit & ~text.contains(w)
        return F.coalesce(hit, F.lit(False))

    def extract(self, text: Column) -> list[Column]:
        """One column per field: the first group of its pattern, null if it isn't there."""
        return [F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias(name) for name, pattern in self.fields]


def load_profiles(folder: str) -> list[Profile]:
    """Profiles from the JSON files of a folder, by name."""
    out = []
    for path in sorted(Path(folder).glob("*.json")):
        d = json.loads(path.read_text(encoding="utf-8"))
        out.append(Profile(d["name"], tuple(d.get("any", ())), tuple(d.get("none", ())), tuple(d.get("fields", {}).items())))
    return out


def choose_profile(df: DataFrame, text: str, id_col: str, profiles: list[Profile], critical: set[str]) -> DataFrame:
    """id, profile and fields of the best profile: most critical fields, then most fields, then name."""
    options = []
    for p in profiles:
        values = p.extract(F.col(text))
        found = [v.isNotNull().cast("int") for v in values]
        main = [v.isNotNull().cast("int") for v, (n, _) in zip(values, p.fields, strict=True) if n in critical]
        total = lambda xs: sum(xs, F.lit(0))
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for v, (n, _) in zip(values, p.fields, strict=True)])
        options.append(F.when(p.applies(F.col(text)), F.struct((-total(main)).alias("c"), (-total(found)).alias("n"), F.lit(p.name).alias("profile"), pairs.alias("fields"))))
    best = F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
    return df.select(F.col(id_col), best.alias("b")).where("b is not null").select(id_col, "b.profile", "b.fields")
