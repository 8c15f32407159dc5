"""Sinks: findings as CSV or JSON, plain backups, sensor exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 5000


def write_findings_csv(findings: DataFrame, path: str) -> None:
    """Section, Group, Field, Value in UTF-8 with a byte order mark, every field quoted, "" for a quote and CRLF line ends; long texts are cut with a note."""
    v = F.when(F.length("value") > LONGEST, F.concat(F.substring("value", 1, LONGEST), F.format_string(" ... (%d characters in all)", F.length("value")))).otherwise(F.col("value"))
    out = findings.select(F.col("section").alias("Section"), F.col("grp").alias("Group"), F.col("field").alias("Field"), v.alias("Value"))
    # the CSV writer takes one-character line ends only, so the lines are built here
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = out.select(F.concat_ws(",", *(q(c) for c in out.columns)).alias("value"))
    head = findings.sparkSession.createDataFrame([("\ufeff" + ",".join(f'"{c}"' for c in out.columns),)], "value string")
    head.coalesce(1).union(lines).write.option("lineSep", "\r\n").text(path)


def findings_json(findings: DataFrame) -> DataFrame:
    """(source, json): one document per source; a label seen twice becomes an array."""
    one = findings.groupBy("source", "section", "field").agg(F.array_sort(F.collect_list("value")).alias("v"))
    text = F.when(F.size("v") == 1, F.to_json(F.struct(F.get("v", F.lit(0)).alias("x")))).otherwise(F.to_json(F.struct(F.col("v").alias("x"))))
    pair = F.concat(F.substring(F.to_json(F.create_map(F.col("field"), F.lit(0))), F.lit(2), F.length(F.to_json(F.create_map(F.col("field"), F.lit(0)))) - 3), F.substring(text, F.lit(6), F.length(text) - 6))
    sections = one.groupBy("source", "section").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("f"))
    name = F.to_json(F.create_map(F.col("section"), F.lit(0)))
    s = F.concat(F.substring(name, F.lit(2), F.length(name) - 3), F.lit("{"), F.col("f"), F.lit("}"))
    return sections.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(s)), ",").alias("s")).select("source", F.concat(F.lit("{"), F.col("s"), F.lit("}")).alias("json"))


def write_findings_json(findings: DataFrame, path: str) -> None:
    findings_json(findings).select("json").write.text(path)


def write_backup(df: DataFrame, path: str) -> None:
    """CSV that quotes only what needs it; null as nothing."""
    df.write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_imu(df: DataFrame, path: str, kind: str = "csv", scale: float = 1e-3) -> None:
    """Sensor samples (clip_id, t, gx..az) as text: plain CSV, or integers in units of `scale` whose factors stand in a header file."""
    axes = ["gx", "gy", "gz", "ax", "ay", "az"]
    if kind == "csv":
        line, head = F.format_string("%.6f," + ",".join(["%.6f"] * 6), "t", *axes), "t," + ",".join(axes)
    else:
        line = F.format_string("%d," + ",".join(["%d"] * 6), F.round(F.col("t") / scale).cast("long"), *(F.round(F.col(a) / scale).cast("long") for a in axes))
        head = f"tscale,{scale}\ngscale,{scale}\nascale,{scale}\nt," + ",".join(axes)
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/header")
    df.sort("clip_id", "t").select(line.alias("value")).write.text(f"{path}/samples")
