"""Readers: files to DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelens.functions.serp import results
from citelens.schemas import CANDIDATES, TRANSCRIPT, nan_to_null, require_columns

_CONTRACT = [x.split()[0] for x in CANDIDATES.split(", ")]


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates from parquet or CSV; a ValueError names missing columns, further ones are kept; NaN becomes NULL.

    A CSV's columns are read as strings and the contractual ones cast, so that nothing is inferred from the data.
    """
    if path.rstrip("/").endswith(".csv"):
        raw = require_columns(spark.read.csv(path, header=True, multiLine=True, escape='"'), _CONTRACT)
        kinds = dict(x.split() for x in CANDIDATES.split(", "))
        df = raw.withColumns({c: F.col(c).try_cast("double").cast(k) if k == "int" else F.col(c).try_cast(k) for c, k in kinds.items()})
    else:
        df = require_columns(spark.read.parquet(path), _CONTRACT)
    return nan_to_null(df)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the parquet paths that exists."""
    for p in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.parquet(p)
    raise FileNotFoundError(f"none of {paths}")


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, body) of the .json files of a folder; query_id is the file's stem."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return raw.select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("query_id")).select(
        "query_id", F.col("value").alias("body")
    )


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, result); files that are malformed or have no result are left out."""
    return results(read_responses(spark, folder), "body")


def rejected_responses(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, body) of the files that ``read_results`` leaves out."""
    return read_responses(spark, folder).join(read_results(spark, folder).select("query_id"), "query_id", "left_anti")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, candidate_idx, html) of files named q<digits>__<digits>.html; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    name = F.regexp_extract("path", r"(q[0-9]+__[0-9]+\.html)$", 1)
    return files.where(name != "").select(
        F.regexp_extract(name, r"^(q[0-9]+)__", 1).alias("query_id"),
        F.regexp_extract(name, r"__([0-9]+)\.html$", 1).cast("int").alias("candidate_idx"),
        _utf8(F.col("content")).alias("html"),
    )


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript JSON files; those that don't parse are left out."""
    schema = TRANSCRIPT + ", _corrupt_record string"
    df = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    return df.where("video_id is not null").drop("_corrupt_record")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) of the lines of a text file, trimmed, without blank ones and those that begin with #."""
    lines = spark.read.text(path)
    return lines.where(~F.startswith("value", F.lit("#"))).select(F.trim("value").alias("query")).where("query <> ''")


def _utf8(content: Column) -> Column:
    def run(blobs):
        return blobs.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return F.pandas_udf(run, T.StringType())(content)


_CUE = r"(?:(\d+):)?(\d\d):(\d\d)[.,](\d{3})[ \t]+-->[^\n]*\n?"


def vtt_captions(text: Column) -> Column:
    """array<struct<start, text>> of a WebVTT (or SRT) text; NULL for NULL.

    Blocks are separated by blank lines; those with a timing line are cues, the others (header, notes, styles) aren't. Tags are
    removed and white space is collapsed; empty captions and texts that came before (rolling captions) are left out.
    """
    blocks = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\n+")
    cues = F.filter(blocks, lambda x: x.rlike(_CUE))

    def part(x: Column, group: int) -> Column:
        return F.coalesce(F.regexp_extract(x, _CUE, group).try_cast("double"), F.lit(0.0))

    def caption(x: Column) -> Column:
        shown = F.element_at(F.split(x, _CUE, 2), 2)
        return F.struct(
            F.round(part(x, 1) * 3600 + part(x, 2) * 60 + part(x, 3) + part(x, 4) / 1000, 1).alias("start"),
            F.trim(F.regexp_replace(F.regexp_replace(shown, r"<[^>]*>", ""), r"\s+", " ")).alias("text"),
        )

    told = F.filter(F.transform(cues, caption), lambda c: c["text"] != "")
    return F.filter(told, lambda c, i: F.array_position(F.transform(told, lambda d: d["text"]), c["text"]) == i + 1)


def read_vtt(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, snippets) of .vtt files; video_id is the name up to the first point."""
    files = spark.read.option("pathGlobFilter", "*.vtt").text(folder, wholetext=True)
    name = F.regexp_extract("_metadata.file_path", r"([^/.]+)[^/]*\.vtt$", 1)
    return files.select(name.alias("video_id"), vtt_captions(F.col("value")).alias("snippets"))


def register_cached_responses(spark: SparkSession) -> None:
    """Format "cached_responses" for spark.read: (query_id, body) from a folder of stored responses, some files a task.

    The network source itself is outside the engine; what was stored of it is read here. The folder may be on any file system
    that pyarrow knows.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    files_a_task = 500

    class Reader(DataSourceReader):
        def __init__(self, folder: str):
            self.folder = folder

        def partitions(self):
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
            found = sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and x.extension == "json")
            return [InputPartition(found[i : i + files_a_task]) for i in range(0, len(found), files_a_task)]

        def read(self, partition):
            from pyarrow import fs

            system, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
            for path in partition.value:
                with system.open_input_stream(path) as file:
                    yield path.rsplit("/", 1)[-1].removesuffix(".json"), file.read().decode("utf-8", "replace")

    class Responses(DataSource):
        @classmethod
        def name(cls) -> str:
            return "cached_responses"

        def schema(self) -> str:
            return "query_id string, body string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"])

    spark.dataSource.register(Responses)


#: Numeric columns of the invented candidates: (from, to, how far the hidden quality decides, decimals).
_INVENTED = {
    "organic_rank": (40, 1, 0.6, 0),
    "domain_rating": (5, 95, 0.4, 1),
    "page_authority": (5, 95, 0.3, 1),
    "word_count": (200, 4000, 0.2, 0),
    "has_schema": (0, 1, 0.3, 0),
    "num_lists_tables": (0, 12, 0.3, 0),
    "has_faq": (0, 1, 0.2, 0),
    "query_url_similarity": (0, 1, 0.5, 3),
    "passage_match_score": (0, 1, 0.4, 3),
    "content_freshness_days": (1500, 1, 0.2, 0),
    "num_entities_matched": (0, 25, 0.4, 0),
    "readability_score": (10, 90, 0.1, 1),
    "is_https": (0, 1, 0.7, 0),
    "domain_citation_rate": (0, 0.6, 0.4, 3),
    "is_forum": (1, 0, 0.3, 0),
    "is_video": (1, 0, 0.3, 0),
}


def synthetic_candidates(spark: SparkSession, n_queries: int = 400, seed: int = 42) -> DataFrame:
    """Invented candidates in the contractual columns, from a hash of (seed, query, position), so that every run is equal.

    Eight to 29 candidates a query. Each numeric column lies between two bounds and mixes a hidden quality with chance; the one
    to four candidates of a query that mix quality and chance best are cited.
    """

    def chance(*of: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 32)) / float(1 << 32)

    def own(name: str) -> Column:
        return chance("q", "i", F.lit(name))

    size = (8 + F.floor(22 * chance("q", F.lit("size")))).cast("int")
    cited = (1 + F.floor(4 * chance("q", F.lit("cited")))).cast("int")
    rows = spark.range(n_queries).select(F.col("id").alias("q"), size.alias("size"), cited.alias("k"))
    rows = rows.select("q", "k", F.explode(F.sequence(F.lit(1), "size")).alias("i")).withColumn("quality", own("quality"))
    kinds = dict(x.split() for x in CANDIDATES.split(", "))
    numbers = [
        F.round(low + (high - low) * (share * F.col("quality") + (1 - share) * own(name)), digits).cast(kinds[name]).alias(name)
        for name, (low, high, share, digits) in _INVENTED.items()
    ]
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.col("quality") + own("noise")), "i"))
    return rows.select(
        F.format_string("q%04d", "q").alias("query_id"),
        F.format_string("invented query %d", "q").alias("query"),
        F.format_string("https://host%d.test/%d/%d", F.floor(200 * own("host")).cast("int"), "q", "i").alias("url"),
        *numbers,
        F.element_at(F.split(F.lit("informational commercial transactional"), " "), (1 + F.floor(3 * own("type"))).cast("int")).alias("content_type"),
        (place <= F.col("k")).cast("int").alias("cited"),
    ).select(*_CONTRACT)
