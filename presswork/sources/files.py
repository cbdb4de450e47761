"""Issue files, and lines from them by a parser that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from presswork.session import ship

GLYPHS = "path string, page int, line_no int, seq int, ch string, x double, y double, w double, h double, font_size double"


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files below ``path``; the content is read only
    where it is used. Empty files aren't listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)


def parsed(files: DataFrame, parser: Callable[[str, bytes], pd.DataFrame], schema: str = GLYPHS) -> DataFrame:
    """Rows that ``parser`` (path, content) makes of each file, one file at a time. A file it raises
    ValueError on gives none."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    yield parser(path, bytes(content))
                except ValueError:
                    continue

    return files.select("path", "content").mapInPandas(run, schema)
