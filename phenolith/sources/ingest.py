"""Sources, merges and sinks: typed reads, unions, registries, joins, incremental ingest, HTML."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from .staging import shared_folder

FORMATS = ("parquet", "json", "csv", "orc")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv", **options: str) -> DataFrame:
    """A table with an explicit schema in any of Spark's formats; nothing is inferred."""
    given = {"header": "true"} | options if fmt == "csv" else options
    return spark.read.schema(schema).format(fmt).options(**given).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """The sink: one folder of part files, partitioned where asked."""
    writer = df.write.mode("overwrite").format(fmt).partitionBy(*partition_by)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def round_trip(df: DataFrame) -> DataFrame:
    """df written in each format to the shared folder, and the rows that each gives back, with the format."""
    spark, out = df.sparkSession, None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    for fmt in FORMATS:
        path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
        write_table(df, path, fmt)
        rows = read_table(spark, path, schema, fmt).withColumn("format", F.lit(fmt))
        out = rows if out is None else out.unionByName(rows)
    return out


def coerced(df: DataFrame, numbers: Sequence[str] = (), integers: Sequence[str] = (), flags: Sequence[str] = (), dates: Sequence[str] = ()) -> DataFrame:
    """Text columns as numbers, whole numbers, flags and dates; what does not fit is null, sentinel zeros are 0."""
    return df.withColumns(
        {c: expr.missing_as_null(F.col(c)) for c in numbers}
        | {c: F.col(c).try_cast("long") for c in integers}
        | {c: expr.truthy(F.col(c)) for c in flags}
        | {c: F.col(c).try_cast("date") for c in dates}
    )


def fixed_width(lines: DataFrame) -> DataFrame:
    """Mortality records: seqn 1-6, eligibility 15, status 16, cause 17-19, flags 20 and 21, and the last six characters as two numbers of months."""
    v = F.col("value")
    part = lambda a, n: F.substring(v, a, n).try_cast("int")  # noqa: E731  dots and blanks are null
    line = F.rtrim(v)
    return lines.select(
        F.trim(F.substring(v, 1, 6)).try_cast("long").alias("seqn"), part(15, 1).alias("eligstat"), part(16, 1).alias("mortstat"), F.trim(F.substring(v, 17, 3)).try_cast("int").alias("ucod_leading"), part(20, 1).alias("diabetes"), part(21, 1).alias("hyperten"),
        F.trim(F.substring(line, -6, 3)).try_cast("int").alias("permth_int"), F.trim(F.substring(line, -3, 3)).try_cast("int").alias("permth_exm"),
    ).where("seqn is not null")


#: Where life tables keep country and sex in their path: <country>/STATS/fltper_1x1.txt, the country a folder or an archive.
LIFE_TABLE = r"([^/]+?)(?:\.zip)?/STATS/([bfm])ltper_1x1\.txt$"
SEXES = {"b": "both", "f": "female", "m": "male"}
#: Columns of life tables by their headers; Lx and Tx get names that differ from lx and tx in more than case.
MEASURES = {"mx": "mx", "qx": "qx", "ax": "ax", "lx": "lx", "dx": "dx", "Lx": "years_lived", "Tx": "years_left", "ex": "ex"}


def whitespace_tables(files: DataFrame, keys: Sequence[str], measures: dict[str, str] = MEASURES) -> DataFrame:
    """keys, year, age and measures of tables in plain text, one file a row (keys, content).

    The first line that begins with Year is the header, else the third; columns are taken by its names, and those a file
    lacks are null. What is no number is null, ``110+`` is 110; lines without a year go. A file's lines stay in
    its task.
    """
    lines = F.split("content", "\r?\n")
    placed = files.select(*keys, lines.alias("l")).withColumn("h", F.coalesce(F.array_min(F.filter(F.transform("l", lambda x, i: F.when(x.rlike(r"^\s*Year\b"), i)), lambda i: i.isNotNull())), F.lit(2)))
    words = lambda x: F.split(F.trim(x), r"\s+")
    each = placed.select(*keys, words(F.coalesce(F.get("l", F.col("h")), F.lit(""))).alias("n"), F.explode(F.slice("l", F.col("h") + 2, F.greatest(F.size("l"), F.lit(1)))).alias("x"))
    row = each.withColumn("v", words(F.col("x")))
    named = lambda c: F.get("v", F.nullif(F.array_position("n", F.lit(c)), F.lit(0)).cast("int") - 1)
    return row.select(*keys, named("Year").try_cast("int").alias("year"), F.regexp_replace(named("Age"), r"\+$", "").try_cast("int").alias("age"), *(named(m).try_cast("double").alias(n) for m, n in measures.items())).where("year is not null")


def life_table_files(spark: SparkSession, path: str, measures: dict[str, str] = MEASURES) -> DataFrame:
    """country_code, sex, year, age and measures of all life tables below a folder, plain or in archives of one country each.

    Spark reads the files, so the folder may be in any store that it reads; each file, and each archive, is taken apart in one task.
    """
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        rows += [(f"{name}/{m}", archive.read(m).decode("utf-8", "replace")) for m in archive.namelist() if m.endswith(".txt")]
                else:
                    rows.append((name, bytes(content).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.(?:txt|zip)$"))
    texts = files.select("path", "content").mapInPandas(members, "path string, content string")
    sexes = F.create_map(*(F.lit(x) for pair in SEXES.items() for x in pair))
    keyed = texts.where(F.col("path").rlike(LIFE_TABLE)).select(F.regexp_extract("path", LIFE_TABLE, 1).alias("country_code"), F.element_at(sexes, F.regexp_extract("path", LIFE_TABLE, 2)).alias("sex"), "content")
    return whitespace_tables(keyed, ["country_code", "sex"], measures)


# Fixed value: traits of a catalogue that tell of long lives.
LONG_LIFE_TRAITS = r"(?i)longevity|lifespan|life span|aging|ageing|centenarian|life expectancy|mortality|supercentenarian|long[- ]lived"


def trait_table(rows: DataFrame, trait: str = "trait", pattern: str = LONG_LIFE_TRAITS) -> DataFrame:
    """Catalogue rows whose trait the pattern matches; rows without a trait go."""
    return rows.where(F.col(trait).rlike(pattern))


def common_traits(rows: DataFrame, trait: str = "trait", most: int = 15) -> DataFrame:
    """trait, n of the commonest traits."""
    return rows.groupBy(trait).agg(F.count("*").alias("n")).orderBy(F.desc("n"), trait).limit(most)


def corpus_union(papers: DataFrame, news: DataFrame, order: str) -> DataFrame:
    """Both on shared columns, with ids AP_ and NA_ that follow from the row's own key, not from its place."""
    both = papers.withColumn("source_type", F.lit("academic")).unionByName(news.withColumn("source_type", F.lit("news")), allowMissingColumns=True)
    return both.withColumn("record_id", F.format_string("%s_%05d", F.when(F.col("source_type") == "academic", "AP").otherwise("NA"), F.col(order)))


def footnotes_off(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", ""), " ", " ")), F.lit(""))


def wiki_age(x: Column) -> Column:
    """``122 years, 164 days`` in years."""
    clean = F.regexp_replace(x, r"\[[^\]]*\]", "")
    years, days = (F.regexp_extract(clean, r"(?i)(\d+)\s*years?(?:,\s*(\d+)\s*days?)?", g).try_cast("double") for g in (1, 2))
    return F.round(years + F.coalesce(days, F.lit(0.0)) / 365.25, 4)


def gender(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin("female", "f", "woman"), "F").when(v.isin("male", "m", "man"), "M")


def registry_merge(wiki: DataFrame, other: DataFrame) -> DataFrame:
    """Two registries of (name, birth, age, gender, ord) as one, a person (name, birth date) once, the first source first."""
    a = wiki.select(
        footnotes_off(F.col("name")).alias("name"), F.try_to_timestamp(footnotes_off(F.col("birth")), F.lit("d MMMM yyyy")).cast("date").alias("birth_date"),
        wiki_age(F.col("age")).alias("age_years"), gender(F.col("gender")).alias("gender"), F.lit("wiki").alias("dataset_source"), F.struct(F.lit(0), "ord").alias("rank"),
    )
    b = other.select("name", F.col("birth").try_cast("date").alias("birth_date"), F.col("age").try_cast("double").alias("age_years"), gender(F.col("gender")).alias("gender"), F.lit("other").alias("dataset_source"), F.struct(F.lit(1), "ord").alias("rank"))
    first = F.min_by(F.struct("age_years", "gender", "dataset_source"), "rank")
    return a.unionByName(b).groupBy("name", "birth_date").agg(first.alias("r")).select("name", "birth_date", "r.*")


def bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """df written once as a table in buckets of its key, sorted in each, and read back.

    Tables of one number of buckets are joined by the key without an exchange. Files are in the shared folder.
    """
    spark, name = df.sparkSession, name or f"star_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{shared_folder(spark)}/{name}").mode("overwrite").saveAsTable(name)
    return spark.table(name)


def star_join(base: DataFrame, files: Sequence[DataFrame], key: str, drop: Sequence[str] = (), names: dict[str, str] | None = None, first: bool = False) -> DataFrame:
    """base with the columns of all files, by left joins on the same key.

    Administrative columns (``drop``) are left out of files, and columns of a file that base or a file before already has, so that
    no name is there twice. ``names`` renames codes. With ``first``, keys that repeat in a file count once, by its first row in
    order of all columns. Files that are ``bucketed`` alike are merged bucket by bucket without an exchange; else one exchange of base serves all.
    """
    out = base
    for f in files:
        own = f.drop(*drop, *(c for c in f.columns if c != key and c in out.columns))
        if first:
            rest = [c for c in own.columns if c != key]
            own = own.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else own.distinct()
        out = out.join(own.hint("merge"), key, "left")
    return out.withColumnsRenamed(names or {})


def coverage(df: DataFrame) -> DataFrame:
    """column, filled_pct of every column, from one aggregation."""
    row = df.agg(*(F.round(100 * F.count(c) / F.count("*"), 4).alias(c) for c in df.columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled_pct")) for c in df.columns))).alias("r")).select("r.*")


def indicator_union(parts: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """The kept columns of all parts with their label; rows with none of them go."""
    out = None
    for label, df in parts.items():
        rows = df.select(F.lit(label).alias("indicator"), *keep).dropna("all", subset=list(keep))
        out = rows if out is None else out.unionByName(rows)
    return out


def flag_join(rows: DataFrame, flags: DataFrame, key: str, flag: str = "flag") -> DataFrame:
    """rows with the flag of their key, false without one. flags: a dimension, broadcast by its size."""
    return rows.join(flags, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unseen(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of new, one for a key, whose key seen does not have: what an idempotent ingest appends."""
    return new.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def _text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def html_to_profile(pages: DataFrame, min_words: int = 20) -> DataFrame:
    """page_id, profile, n_words: paragraphs of at least 40 characters without captions, each once, in order."""
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), 1), _text)

    def keep(t: Column) -> Column:
        low = F.lower(t)
        short = F.length(t) < 90
        return (F.length(t) >= 40) & ~low.startswith("(source") & ~low.startswith("source:") & ~(low.rlike(r"^in \d{4},? aged") & short) & ~(low.contains("(source:") & short)

    text = F.coalesce(F.array_join(F.array_distinct(F.filter(paragraphs, keep)), " "), F.lit(""))
    out = pages.select("page_id", text.alias("profile"))
    return out.withColumn("n_words", F.size(F.filter(F.split("profile", r"\s+"), lambda w: w != ""))).where(F.col("n_words") >= min_words)


def html_table_rows(pages: DataFrame) -> DataFrame:
    """Registry rows of HTML tables: rank, name, gender, dates, age, country; a person once."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("tr"))
    cells = rows.select("page_id", F.transform(F.regexp_extract_all("tr", F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), _text).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    iso = lambda x: F.nullif(F.regexp_replace(F.regexp_extract(x, r"^(\d{2}/\d{2}/\d{4})", 1), r"(\d{2})/(\d{2})/(\d{4})", "$3-$2-$1"), F.lit(""))
    good = cells.where((F.size("c") >= 8) & at(0).rlike(r"^\d+$") & ~at(1).startswith("N/A") & (at(1) != ""))
    typed = good.select(
        at(0).cast("int").alias("rank"), at(1).alias("name"), iso(at(2)).alias("birth_date"), iso(at(3)).alias("death_date"), at(4).try_cast("int").alias("age_years"),
        F.when(F.lower(at(6)).startswith("m"), "M").when(F.lower(at(6)).startswith("f"), "F").alias("gender"), at(7).alias("country"),
    )
    first = F.min_by(F.struct("rank", "death_date", "age_years", "gender", "country"), "rank")
    return typed.groupBy("name", "birth_date").agg(first.alias("r")).select("name", "birth_date", "r.*")
