"""Reading and writing tables: all-string ingest, type recovery, delimiter sniffing, exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon and tab in the first 8 KB, read by Spark so that any store works."""
    head = spark.read.format("text").load(path).limit(200)
    text = "\n".join(r["value"] or "" for r in head.collect())[:8192]
    return max(",;\t", key=lambda d: (text.count(d), -",;\t".index(d)))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as text, missing values as ''."""
    d = spark.read.csv(path, header=True, inferSchema=False, sep=delimiter or sniff_delimiter(spark, path), nullValue=None, emptyValue="")
    return d.na.fill("")


def read(spark: SparkSession, source) -> DataFrame:
    """A DataFrame as it is, an object with get_data_frame(), or a csv, tsv, parquet, orc or json path."""
    if isinstance(source, DataFrame):
        return source
    if hasattr(source, "get_data_frame"):
        frame = source.get_data_frame()
        return frame if isinstance(frame, DataFrame) else spark.createDataFrame(frame.astype(str))
    kind = str(source).rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return read_csv(spark, source, "\t" if kind == "tsv" else None)
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(source)
    if kind in ("xlsx", "xls"):
        import pandas as pd

        try:
            return spark.createDataFrame(pd.read_excel(source, dtype=str, na_values=[], keep_default_na=False))
        except ImportError as e:
            raise ValueError("reading spreadsheets needs openpyxl") from e
    raise ValueError(f"unsupported source {source}")


def european(c: Column) -> Column:
    """1.234,5 as a number."""
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]


def parsed_date(c: Column) -> Column:
    """Day-first dates in the usual notations."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def recover_types(df: DataFrame, least: float = 0.8, eu_numbers: bool = True) -> DataFrame:
    """Text columns of which over `least` of the non-empty values parse become numbers, else dates; '' becomes null in them.

    One aggregate decides for all columns. European numbers count where the plain reading fails and over half parse so.
    """
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    share = lambda v, c: F.sum(v.isNotNull().cast("double")) / F.count(full(c))
    r = df.agg(*[F.struct(share(full(c).try_cast("double"), c).alias("n"), share(european(full(c)), c).alias("e"), share(parsed_date(full(c)), c).alias("d")).alias(c) for c in text]).first()
    out = {}
    for c in text:
        n, e, d = (r[c][k] or 0 for k in "ned")
        if n > least:
            out[c] = full(c).try_cast("double")
        elif d > least:
            out[c] = parsed_date(full(c))
        elif eu_numbers and e > 0.5:
            out[c] = european(full(c))
    return df.withColumns(out) if out else df


#: Words in a column's label that ask for numbers.
NUMERIC_LABELS = ["numeric", "continuous", "integer", "float", "coded"]


def coerce(df: DataFrame, labels: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Text columns labelled numeric become numbers where over half of their filled values parse; what does not parse is null.

    Where the plain reading takes under half, the European one counts if it takes more. One aggregate decides for all columns.
    """
    asked = lambda c: any(w in labels.get(c, "").lower() for w in NUMERIC_LABELS)
    text = [c for c, t in df.dtypes if t == "string" and asked(c) and (columns is None or c in columns)]
    if not text:
        return df
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    number = lambda v: F.when(~F.isnan(v), v)
    readings = {c: (number(full(c).try_cast("double")), number(european(full(c)))) for c in text}
    r = df.agg(*[F.struct(F.count(full(c)).alias("n"), F.count(a).alias("a"), F.count(b).alias("b")).alias(c) for c, (a, b) in readings.items()]).first()
    out = {}
    for c, (plain, eu) in readings.items():
        n, a, b = r[c]
        if 2 * a < n and b > a:
            plain, a = eu, b
        if 2 * a > n:
            out[c] = plain
    return df.withColumns(out)


def export(df: DataFrame, path: str, kind: str = "csv", metadata: dict | None = None) -> None:
    """Writes a table as csv, parquet, orc or json, its metadata as one JSON text beside it."""
    if kind not in ("csv", "parquet", "orc", "json"):
        raise ValueError(f"unsupported format {kind}")
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path))
    if metadata is not None:
        df.sparkSession.createDataFrame([(json.dumps(metadata, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def html_report(title: str, sections: dict[str, dict]) -> str:
    """A plain page of tables of figures."""
    from html import escape

    body = "".join(f"<h2>{escape(h)}</h2><table>" + "".join(f"<tr><td>{escape(str(k))}</td><td>{escape(str(v))}</td></tr>" for k, v in s.items()) + "</table>" for h, s in sections.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>"
