"""Record sources: the prose gate, JSON, XML, CSV and text rows, paths, line templates and summaries."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_BYTES, SAMPLE_CHARS, FEW_LINES = 200, 6000, 12


def text_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("txt", "md", "html")) -> DataFrame:
    """(path, text, content_hash) of the files below a folder with a known suffix; names with a leading dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$") & ~F.col("path").rlike(r"/\.[^/]*"))
    return named.select("path", F.decode("content", F.lit("UTF-8")).alias("text"), F.sha2("content", 256).alias("content_hash"))


def prose_gate(docs: DataFrame) -> DataFrame:
    """(doc_id, prose): false for tiny texts and for lists of short or symbol-laden lines."""
    lines = F.filter(F.split(F.substring("text", 1, SAMPLE_CHARS), "\n"), lambda x: F.trim(x) != "")
    rows = docs.withColumn("lines", lines)
    n, body = F.size("lines"), F.array_join("lines", "")
    chars = F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x))
    spaced = F.size(F.filter("lines", lambda x: F.trim(x).contains(" ")))
    symbols = F.length(F.regexp_replace(body, r"[A-Za-z0-9\sÀ-ÿ]", ""))
    wordy = ((chars / n >= 40) | (spaced / n >= 0.6)) & (symbols < 0.12 * F.length(body))
    return rows.select("doc_id", ((F.octet_length("text") >= MIN_BYTES) & ((n < FEW_LINES) | wordy)).alias("prose"))


def dig(record: Column, path: str) -> Column:
    """Value of a JSON record at ``a.b[0].c``; ``[*]`` fans out into an array; null where nothing is there."""
    return F.get_json_object(record, "$" if not path else f"$.{path}")


def json_rows(df: DataFrame, column: str, path: str) -> DataFrame:
    """A row per element of the array (or the one object) at a path of a JSON column, as JSON in ``row``."""
    found = dig(F.col(column), path)
    listed = F.when(F.ltrim(found).startswith("["), F.from_json(found, "array<string>")).otherwise(F.array(found))
    return df.withColumn("row", F.explode(listed)).where("row is not null")


def xml_rows(df: DataFrame, column: str, row_tag: str, fields: list[str]) -> DataFrame:
    """A row per element ``row_tag`` of an XML column, its children's text as columns; documents that declare entities give none."""
    safe = F.when(~F.col(column).rlike("(?i)<!(DOCTYPE|ENTITY)"), F.col(column))
    pieces = F.explode(F.regexp_extract_all(safe, F.lit(rf"(?s)<{row_tag}[\s>].*?</{row_tag}>"), F.lit(0)))
    rows = df.withColumn("_row", pieces)
    return rows.select("*", *[F.element_at(F.xpath("_row", F.lit(f"//{f}/text()")), 1).alias(f) for f in fields]).drop("_row")


def csv_rows(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """A row per line after the header of a CSV column."""
    lines = F.filter(F.split(column, r"\r?\n"), lambda x: F.trim(x) != "")
    schema = ", ".join(f"{f} string" for f in fields)
    rows = df.withColumn("_line", F.explode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))))
    return rows.withColumn("_row", F.from_csv("_line", schema)).select("*", "_row.*").drop("_line", "_row")


def line(record: Column, template: str) -> Column:
    """A line from a template of ``{path|filter|...}`` parts: upper, lower, trunc:n, default:x, date, join, count, json (of the path's own value)."""
    out = []
    for literal, field in re.findall(r"([^{]+)|\{([^}]*)\}", template):
        if literal:
            out.append(F.lit(literal))
            continue
        path, *filters = field.split("|")
        value = dig(record, path.strip())
        for f in filters:
            name, _, arg = f.strip().partition(":")
            items = F.from_json(value, "array<string>")
            if name in ("upper", "lower"):
                value = getattr(F, name)(value)
            elif name == "trunc":
                value = F.when(F.length(value) > int(arg), F.concat(F.substring(value, 1, int(arg)), F.lit("…"))).otherwise(value)
            elif name == "default":
                value = F.coalesce(F.nullif(value, F.lit("")), F.lit(arg))
            elif name == "join":
                value = F.coalesce(F.array_join(items, arg or ", "), value)
            elif name == "count":
                value = F.coalesce(F.size(items), F.lit(0)).cast("string")
            elif name == "json":  # the value as JSON, strings in quotes, 300 characters at most
                whole = F.try_variant_get(F.try_parse_json(record), f"$.{path.strip()}", "variant")
                value = F.substring(F.coalesce(F.to_json(whole), F.lit("null")), 1, 300)
            elif name == "date":  # seconds, or milliseconds beyond 1e11
                number = value.try_cast("double")
                moment = F.when(number.isNotNull(), F.timestamp_millis(F.when(number > 1e11, number).otherwise(number * 1000).cast("bigint"))).otherwise(F.try_to_timestamp(value))
                value = F.date_format(moment, "yyyy-MM-dd")
            else:
                raise ValueError(f"no filter {name!r}: {json.dumps(template)}")
        out.append(F.coalesce(value, F.lit("")))
    return F.trim(F.regexp_replace(F.concat(*out), r"\s+", " "))


def render_rows(df: DataFrame, key: str, record: str, template: str, limit: int, order: list[Column], empty: str = "") -> DataFrame:
    """(key, rendered): the lines of each key's first ``limit`` records, and how many more there are; ``empty`` where no line says anything.

    Only the first records of a key are brought together; the others are counted where they are.
    """
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= limit)
    made = first.select(key, "_n", line(F.col(record), template).alias("_line"))
    lines = F.array_sort(F.collect_list(F.when(F.col("_line") != "", F.struct("_n", "_line"))))
    texts = made.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("_text"))
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    more = F.when(F.col("_rows") > limit, F.concat(F.lit("\n… and "), (F.col("_rows") - limit).cast("string"), F.lit(" more"))).otherwise("")
    whole = F.concat(F.coalesce("_text", F.lit("")), more)
    held = counts.join(texts.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return held.select(key, F.when(whole == "", F.lit(empty)).otherwise(whole).alias("rendered"))


def summary(df: DataFrame, column: str, template: str) -> DataFrame:
    """One line over all records: ``{count}``, ``{distinct:path}``, ``{sum:path}``, ``{max:path}``."""
    out = []
    for literal, field in re.findall(r"([^{]+)|\{([^}]*)\}", template):
        name, _, path = field.partition(":")
        value = dig(F.col(column), path) if path else F.lit(None)
        made = {
            "": F.lit(literal),
            "count": F.count("*"),
            "distinct": F.count_distinct(F.nullif(value, F.lit(""))),
            "sum": F.round(F.sum(value.try_cast("double")), 6),
            "max": F.max(value.try_cast("double")),
        }[name]
        out.append(F.coalesce(made.cast("string"), F.lit("")))
    return df.agg(F.concat(*out).alias("summary"))
