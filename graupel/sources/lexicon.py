"""The word list by language: query, tab-separated file, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Fixed value: the languages of the word list.
CODES = ("ja-hrkt", "ja", "ko", "zh-hant", "zh-hans", "fr", "de", "es", "it", "en", "cs")


def words(df: DataFrame, language: str, name: str, codes: tuple[str, ...] | None = CODES) -> DataFrame:
    """Distinct raw names of each language, trimmed, in order; groups are by
    the raw name, so names that trim alike stay apart."""
    rows = df.where((F.trim(F.col(name)) != "") & (F.lit(True) if codes is None else F.col(language).isin(*codes)))
    rows = rows.groupBy(F.col(language).alias("language"), F.col(name).alias("raw")).agg(F.lit(1).alias("one"))
    return rows.orderBy("language", "raw").select("language", F.trim("raw").alias("word"))


def write(df: DataFrame, path: str) -> None:
    """Tab-separated, no header, in the frame's order of partitions."""
    df.select("language", "word").write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path, header=False)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, language, word): each line is cut at its first tab; a line
    without one is an error; words are trimmed and empty ones dropped."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.split("value", "\t", 2).alias("p"))
    rows = rows.withColumn("p", F.when(F.size("p") == 2, F.col("p")).otherwise(F.raise_error(F.lit("a line must have two columns"))))
    return rows.select("file", "line", F.col("p")[0].alias("language"), F.trim(F.col("p")[1]).alias("word")).where("word <> ''")


def by_language(lexicon: DataFrame, order: str = "line") -> DataFrame:
    """(language, words): each language's words in file order."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order, "word")))
    return lexicon.groupBy("language").agg(F.transform(sorted_, lambda x: x["word"]).alias("words"))


def distinct_words(lexicon: DataFrame, languages: list[str] | None = None, order: str = "line") -> DataFrame:
    """(ordinal, word): words of the languages (none given: of all), each once,
    by language, then file order."""
    rows = lexicon.where(F.col("language").isin(languages)) if languages else lexicon
    first = rows.groupBy("word").agg(F.min(F.struct("language", order)).alias("at"))
    return first.select(F.col("at.language").alias("language"), F.col(f"at.{order}").alias("ordinal"), "word").orderBy("language", "ordinal", "word")


def mapped(language: Column, mapping: dict[str, list[str]]) -> Column:
    """The word-list languages of a recognition language."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.create_map(*pairs)[language], F.array().cast("array<string>"))


def mapped_set(languages: Column, mapping: dict[str, list[str]]) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(languages, lambda x: mapped(x, mapping)))))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """File order for rows that come from a table: by language."""
    return df.withColumn("line", F.row_number().over(Window.partitionBy("language").orderBy(*order)))
