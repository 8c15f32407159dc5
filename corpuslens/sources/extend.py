"""A user's own per-file extractors, run at scale with errors kept as findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_extractors: dict[str, Callable[[str, bytes], Iterable[tuple[str, str, str, str]]]] = {}
SCHEMA = "source string, section string, grp string, field string, value string"


def register_extractor(exts: list[str], fn: Callable[[str, bytes], Iterable[tuple[str, str, str, str]]]) -> None:
    """fn(path, content) gives (section, group, field, value) rows for files of these extensions."""
    for e in exts:
        _extractors[e.lower()] = fn


def run_extractors(files: DataFrame) -> DataFrame:
    """Findings of all registered extractors over files(path, ext, content); one that fails gives an error finding for its file."""
    table = dict(_extractors)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
                try:
                    rows += [(path, *map(str, r)) for r in table[ext](path, bytes(content))]
                except Exception as e:
                    rows.append((path, "Error", "Extractor", type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["source", "section", "grp", "field", "value"])

    return files.where(F.col("ext").isin(list(table))).select("path", "ext", "content").mapInPandas(run, SCHEMA)
