"""Results as tables: scores with their mean, publishing, questions for a reviewer, versions of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The row that holds the mean of all songs.
MEAN = "_mean"


def with_mean(scores: DataFrame, columns: tuple[str, ...], song: str = "song", digits: int = 3) -> DataFrame:
    """``scores`` and a row named MEAN with the mean of each column over the songs that have scores; none without any."""
    each = scores.select(F.col(song).cast("string").alias(song), *[F.col(c).cast("double").alias(c) for c in columns])
    scored = each.where(F.col(columns[0]).isNotNull())
    mean = scored.groupBy().agg(F.count("*").alias("_n"), *[F.round(F.avg(c), digits).alias(c) for c in columns]).where("_n > 0")
    return each.unionByName(mean.select(F.lit(MEAN).alias(song), *columns))


def save_results(scores: DataFrame, path: str) -> None:
    """Scores as JSON lines, one file per task."""
    scores.write.mode("overwrite").json(path)


def published(jobs: DataFrame, checks: DataFrame, files: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Reports and jobs after publishing.

    ``jobs``: job, status, report (JSON), sync; ``checks``: job,
    flagged_words, total_words; ``files``: job, format, name.  A report keeps
    its other fields; jobs without a check are not published and stay as they are.
    """
    listed = files.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "name")))).alias("output"))
    met = jobs.join(checks, "job", "left").join(listed, "job", "left")
    done = F.col("total_words").isNotNull()
    fresh = F.struct(F.struct("flagged_words", "total_words").alias("validation"), F.col("sync").alias("sync"), F.col("output").alias("output"), at.alias("published"))
    old = F.from_json(F.coalesce("report", F.lit("{}")), "map<string,string>")
    new = F.from_json(F.to_json(fresh), "map<string,string>")
    others = F.map_filter(old, lambda k, v: ~k.isin("validation", "sync", "output", "published"))
    merged = F.when(done, F.to_json(F.map_concat(others, new))).otherwise(F.col("report"))
    reports = met.select("job", merged.alias("report"))
    return reports, met.select("job", "status", "sync", F.when(done, F.col("flagged_words")).alias("flagged_words"), F.when(done, F.col("total_words")).alias("total_words"))


def review_questions(lines: DataFrame, variants: DataFrame, insertions: DataFrame, song: str = "song") -> DataFrame:
    """``song, question``: a song's numbered lines, and numbered choices about them, for a reviewer.

    ``lines``: song, line_no, text; ``variants``: song, line_no, options
    (array of struct of text and supporters, the current text first);
    ``insertions``: song, after (-1 for the front), text, supporters.
    Choices are numbered by line; songs without lines have no question.
    """
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    text = lines.groupBy(song).agg(joined(F.struct("line_no", F.concat_ws(": ", F.col("line_no").cast("string"), F.coalesce("text", F.lit(""))).alias("t"))).alias("_lines"))
    who = lambda s: F.concat(F.lit(" ["), F.array_join(s, ", "), F.lit("]"))
    number = lambda *order: F.row_number().over(Window.partitionBy(song).orderBy(*order)).cast("string")
    option = F.array_join(F.transform("options", lambda o, i: F.concat(F.lit("  "), i.cast("string"), F.lit(": "), o["text"], who(o["supporters"]))), "\n")
    v = variants.withColumn("_k", number("line_no"))
    v = v.groupBy(song).agg(joined(F.struct("line_no", F.concat(F.lit("V"), "_k", F.lit(" at line "), F.col("line_no").cast("string"), F.lit("\n"), option).alias("t"))).alias("_variants"))
    i = insertions.withColumn("_k", number("after", "text"))
    place = F.when(F.col("after") < 0, "before the first line").otherwise(F.concat(F.lit("behind line "), F.col("after").cast("string")))
    i = i.groupBy(song).agg(joined(F.struct("after", "text", F.concat(F.lit("I"), "_k", F.lit(" "), place, F.lit(": "), F.col("text"), who(F.col("supporters"))).alias("t"))).alias("_insertions"))
    met = text.join(v, song, "left").join(i, song, "left")
    parts = F.array_compact(F.array(F.concat(F.lit("Lines\n"), "_lines"), F.concat(F.lit("Variants\n"), "_variants"), F.concat(F.lit("Missing lines\n"), "_insertions")))
    return met.select(song, F.array_join(parts, "\n\n").alias("question"))


def save_projects(projects: DataFrame, path: str, version: int) -> None:
    """A snapshot of projects under its version; saving a version again replaces it."""
    projects.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def newest_projects(spark: SparkSession, path: str, schema, project: str = "project") -> DataFrame:
    """Each project as its newest snapshot has it."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    stored = spark.read.schema(StructType([*schema.fields, StructField("version", IntegerType())])).parquet(path)
    return stored.groupBy(project).agg(F.max_by(F.struct(*[f.name for f in schema.fields if f.name != project]), "version").alias("_p"), F.max("version").alias("version")).select(project, "_p.*", "version")
