"""Raw reviews from tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtext.storage import spread

#: Endings of files that one task has to read whole.
UNSPLIT = (".gz", ".bz2", ".zst")


def read_reviews(
    spark: SparkSession,
    path: str,
    quote: str = "",
    multiline: bool = False,
    body: str = "review_body",
    star: str = "star_rating",
) -> DataFrame:
    """Raw reviews with a header; ``star_rating`` becomes INT or null.

    Names come from the header line and types are fixed, so no pass over the
    data infers them and one bad line cannot turn ratings into text. Quoting is
    off by default: a body that opens a quote must not swallow its neighbours.
    ``quote='"'`` with ``multiline`` reads what ``write_raw_reviews`` wrote.
    A compressed or multi-line file can't be split, so rows of such files are
    dealt over all cores before any text work, where they are too few.
    """
    raw = spark.read.csv(
        path,
        sep="\t",
        header=True,
        quote=quote,
        escape='"' if quote else "\\",
        multiLine=multiline,
        inferSchema=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    if multiline or any(name.endswith(UNSPLIT) for name in raw.inputFiles()):
        raw = spread(raw)
    raw = raw.withColumnRenamed(body, "review_body")
    if star in raw.columns:
        raw = raw.withColumn(star, F.col(star).try_cast("int"))
        raw = raw.withColumnRenamed(star, "star_rating")
    return raw


def read_reviews_rescued(
    spark: SparkSession,
    path: str,
    body: str = "review_body",
    star: str = "star_rating",
    key: str = "review_id",
    max_bad_share: float | None = None,
) -> DataFrame:
    """Raw unquoted reviews, one a line, with malformed lines kept aside.

    The columns of the header, ``_file`` and ``_rescued``: a line with another number of fields, without a
    key, or with a rating that is no whole number is there as it stands, its columns null; of good
    lines ``_rescued`` is null. An empty rating is a null one, not a fault. Each file begins with the same header
    line. With ``max_bad_share``, a file with a larger share of bad lines is an error, found by one more pass.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("_file")
    )
    if any(name.endswith(UNSPLIT) for name in lines.inputFiles()):
        lines = spread(lines)
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError("no header line")
    names = header.value.rstrip("\r").split("\t")
    if missing := {body, key} - set(names):
        raise ValueError(f"the header lacks {sorted(missing)}")
    fields = F.split("line", "\t", -1)
    place = {name: F.get(fields, F.lit(i)) for i, name in enumerate(names)}
    bad = (F.size(fields) != len(names)) | F.coalesce(place[key] == "", F.lit(True))
    if star in place:
        bad = bad | ((place[star] != "") & place[star].try_cast("int").isNull())
        place[star] = place[star].try_cast("int")
    rows = lines.where(F.col("line") != F.lit("\t".join(names))).withColumn("_bad", F.coalesce(bad, F.lit(True)))
    renamed = {body: "review_body", star: "star_rating", key: "review_id"}
    read = rows.select(
        *(F.when(~F.col("_bad"), column).alias(renamed.get(name, name)) for name, column in place.items()),
        "_file",
        F.when(F.col("_bad"), F.col("line")).alias("_rescued"),
    )
    if max_bad_share is not None:
        over = bad_lines(read).where(F.col("bad") > F.lit(max_bad_share) * F.col("lines"))
        worst = over.orderBy(F.desc(F.col("bad") / F.col("lines")), "_file").first()
        if worst is not None:
            raise ValueError(f"{worst['_file']}: {worst.bad} of {worst.lines} lines are malformed")
    return read


def bad_lines(read: DataFrame) -> DataFrame:
    """``_file, lines, bad`` of rescued reviews: a row per file."""
    bad = F.sum(F.col("_rescued").isNotNull().cast("long"))
    return read.groupBy("_file").agg(F.count(F.lit(1)).alias("lines"), bad.alias("bad"))
