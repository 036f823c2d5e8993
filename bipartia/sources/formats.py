"""Readers and writers of the formats that association data come in. All text columns stay text; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_tsv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Tab-separated text as strings, nulls as ''. With ``names`` the file has no header and these columns."""
    reader = spark.read.option("sep", "\t").option("quote", "").option("escape", "")
    if names:
        df = reader.schema(StructType([StructField(n, StringType()) for n in names])).csv(path)
    else:
        df = reader.option("header", True).option("inferSchema", False).csv(path)
    return df.na.fill("")


def write_tsv(df: DataFrame, path: str) -> None:
    """Strings without tabs and line ends (they become spaces), with a header."""
    plain = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ").alias(c) for c in df.columns]
    df.select(*plain).write.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that is not blank: value."""
    return spark.read.text(path).filter("trim(value) <> ''")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an ontology in OBO text: id, name, def, synonym, alt_id, is_a. Only [Term] stanzas; labels after ! go.

    Stanzas are the records of the scan, so a large file is split among tasks.
    """
    stanza = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value").startswith("[Term]"))
    one = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    many = lambda p: F.regexp_extract_all("value", F.lit(p), F.lit(1))
    return stanza.select(
        one(r"(?m)^id:[ ]*(.*?)\s*$").alias("id"), one(r"(?m)^name:[ ]*(.*?)\s*$").alias("name"), one(r'(?m)^def:[ ]*"((?:[^"\\]|\\.)*)"').alias("def"),
        many(r'(?m)^synonym:[ ]*"((?:[^"\\]|\\.)*)"').alias("synonym"), many(r"(?m)^alt_id:[ ]*(\S+)").alias("alt_id"), many(r"(?m)^is_a:[ ]*(\S+)").alias("is_a"),
    ).filter("id is not null")


def write_obo(terms: DataFrame, path: str) -> None:
    """Terms as [Term] stanzas, one blank line between them."""
    lines = lambda c, before, after="": F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(before), x, F.lit(after)))
    one = lambda c, before, after="": F.when(F.col(c).isNotNull(), F.concat(F.lit(before), c, F.lit(after)))
    head = F.array_compact(F.array(F.lit("[Term]"), one("id", "id: "), one("name", "name: "), one("def", 'def: "', '" []')))
    body = F.concat(head, lines(F.col("alt_id"), "alt_id: "), lines(F.col("synonym"), 'synonym: "', '" EXACT []'), lines(F.col("is_a"), "is_a: ", " ! parent"))
    terms.select(F.array_join(body, "\n").alias("value")).write.option("lineSep", "\n\n").text(path)


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """Expression values in GCT text (also gzip), one or many files: two lines before the header, then name, symbol, values.

    name without version, symbol, tissues (map of tissue to value). A file's header is its line that begins with Name; each
    file's rows go by their own header, parts of a written folder without one by the first header of all. Rows of another
    width than their header are left out; without any header nothing is read.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.col("_metadata.file_path").alias("_file"))
    is_header = (F.lower(F.element_at("f", 1)) == "name") & (F.size("f") > 2)
    header = lines.filter(is_header).groupBy("_file").agg(F.first(F.expr("slice(f, 3, greatest(size(f) - 2, 0))")).alias("own"))  # one row for each file
    first = F.broadcast(header.agg(F.min_by("own", "_file").alias("any")))  # one row
    rows = lines.filter(~is_header).join(header, "_file", "left").crossJoin(first).withColumn("tissue", F.coalesce("own", "any"))
    rows = rows.filter(F.size("f") == F.size("tissue") + 2)
    values = F.transform(F.expr("slice(f, 3, greatest(size(f) - 2, 0))"), lambda x: x.try_cast("double"))
    return rows.select(F.substring_index(F.col("f")[0], ".", 1).alias("name"), F.col("f")[1].alias("symbol"), F.when(F.size("f") == F.size("tissue") + 2, F.map_from_arrays("tissue", values)).alias("tissues"))


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Lines of JSON objects as key, value rows; ``value`` is the type of the values."""
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def write_json_map(df: DataFrame, key: str, value: str, path: str, per_line: int = 1000) -> None:
    """key and value rows as JSON objects of about ``per_line`` entries, one per line."""
    line = F.floor(F.abs(F.xxhash64(key)) % F.greatest(F.lit(1), F.lit(max(1, df.count() // per_line))))
    packed = df.groupBy(line.alias("_line")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    packed.select(F.to_json("m").alias("value")).write.text(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result documents (JSON, one per file or line); unreadable ones are left out; ``file`` names the source."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    return df.withColumn("file", F.col("_metadata.file_name")).filter("_corrupt_record is null").drop("_corrupt_record")
