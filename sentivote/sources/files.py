"""Files in, datasets out: Markdown trees, PDF listings, JSON lists, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentivote import vocab
from sentivote.functions import paths, text as T

PHRASE_SCHEMA = "phrase string, phrase_index int, source_file string, source_folder string"
PARAGRAPH_SCHEMA = (
    "paragraph_index int, section_title string, source_file string, source_folder string, "
    "phrases array<struct<phrase_index:int, phrase:string>>"
)
SEGMENT_SCHEMA = "section_title string, paragraph string, paragraph_index int, source_file string, source_folder string"
RESULT_SUFFIX = "_classification.json"
SEGMENT_SUFFIX = "_segments.json"


def _located(df: DataFrame, root: str) -> DataFrame:
    """Add ``source_folder`` and ``source_file`` from the file's path below ``root``."""
    rel = paths.relative(F.col("_metadata.file_path"), paths.qualified(df.sparkSession, root))
    return df.select("*", paths.folder(rel).alias("source_folder"), paths.file_name(rel).alias("source_file"))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """All Markdown files below ``root``, whole, with line ends as ``\\n``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return _located(files, root).select(
        "source_folder", "source_file", F.regexp_replace("value", "\\r\\n?", "\n").alias("text")
    )


def pdf_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Path, size and time of the PDF files below ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf")
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")


def json_lists(spark: SparkSession, root: str, schema: str, suffix: str | None = None) -> DataFrame:
    """Rows of the JSON arrays below ``root``; result files are never read as input.

    ``suffix`` keeps only files whose names end in it.  Missing folders are
    empty, missing file names come from the file read; ``source_json`` is the
    path of that file.
    """
    wanted = StructType.fromDDL(schema)
    read = spark.read.schema(wanted).option("multiLine", True).option("recursiveFileLookup", True)
    rows = read.option("pathGlobFilter", f"*{suffix or '.json'}").json(root)
    name = F.col("_metadata.file_name")
    kept = rows.select("*", name.alias("_name"), F.col("_metadata.file_path").alias("source_json")).filter(
        ~F.col("_name").endswith(RESULT_SUFFIX)
    )
    defaults = {
        "source_file": F.coalesce("source_file", "_name"),
        "source_folder": F.coalesce("source_folder", F.lit("")),
    }
    present = {c: v for c, v in defaults.items() if c in wanted.names}
    return kept.withColumns(present).drop("_name")


def read_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Phrase lists, blank phrases dropped."""
    return json_lists(spark, root, PHRASE_SCHEMA).filter(T.strip(F.coalesce("phrase", F.lit(""))) != "")


def read_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return json_lists(spark, root, PARAGRAPH_SCHEMA).withColumns(
        {
            "phrases": F.coalesce("phrases", F.array().cast("array<struct<phrase_index:int,phrase:string>>")),
            "section_title": F.coalesce("section_title", F.lit("")),
            "paragraph_index": F.coalesce("paragraph_index", F.lit(0)),
        }
    )


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    return json_lists(spark, root, SEGMENT_SCHEMA, SEGMENT_SUFFIX)


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Cached results: the rows of the ``*_classification.json`` files."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    read = rows.option("pathGlobFilter", f"*{RESULT_SUFFIX}").json(root)
    return read.select("*", F.col("_metadata.file_path").alias("source_path"))


# --- questions and templates --------------------------------------------------------


def _question_lines(files: DataFrame) -> DataFrame:
    lines = files.select(F.posexplode(F.split("value", "\\r\\n?|\n")).alias("line_no", "line"))
    return lines.select("line_no", T.strip(F.col("line")).alias("line")).filter("line <> ''")


_QUESTION = rf"(?d)^\[(ROI|NOT|OBL)\]{T.WS}*(.*)$"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file: ord, question_key, category, text.

    Keys are numbered per category in file order.  The file is one short list,
    so its windows are too.
    """
    lines = _question_lines(spark.read.text(path, wholetext=True)).filter(F.col("line").rlike(_QUESTION))
    tagged = lines.select(
        "line_no",
        F.regexp_extract("line", _QUESTION, 1).alias("tag"),
        T.strip(F.regexp_extract("line", _QUESTION, 2)).alias("text"),
    )
    look = lambda table: F.create_map(*[c for k, v in table.items() for c in (F.lit(k), F.lit(v))])
    number = F.row_number().over(Window.partitionBy("tag").orderBy("line_no"))
    return tagged.select(
        F.col("line_no").alias("ord"),
        F.concat(F.element_at(look(vocab.TAG_KEY), F.col("tag")), F.lit("_"), number.cast("string")).alias("question_key"),
        F.element_at(look(vocab.TAG_CATEGORY), F.col("tag")).alias("category"),
        "tag",
        "text",
    )


def rejected_questions(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a questions file that are no question."""
    return _question_lines(spark.read.text(path, wholetext=True)).filter(~F.col("line").rlike(_QUESTION))


MAX_QUESTIONS = 1000


def load_questions(spark: SparkSession, path: str) -> list[vocab.Question]:
    """The questions of a file as a list, to configure a job with."""
    rows = read_questions(spark, path).orderBy("ord").limit(MAX_QUESTIONS + 1).collect()
    if len(rows) > MAX_QUESTIONS:
        raise ValueError(f"{path} holds more than {MAX_QUESTIONS} questions")
    return [vocab.Question(r["question_key"], r["tag"], r["text"]) for r in rows]


def load_template(spark: SparkSession, path: str) -> str:
    """A prompt template, stripped."""
    return spark.read.text(path, wholetext=True).select(T.strip(F.col("value"))).first()[0]


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from CSV, column names stripped, with the row's ordinal ``ord``: file, place in the file.

    A file may be cut, so the place is the start of the part and the count of rows in it.
    """
    rows = spark.read.csv(path, header=True)
    ord_ = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    named = [F.col("`" + c.replace("`", "``") + "`").alias(c.strip()) for c in rows.columns]
    return rows.select(*named, ord_.alias("ord"))


# --- sinks ----------------------------------------------------------------------------


def write_dataset(
    df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("source_folder",), within: Sequence[str] = ("source_file",),
    mode: str = "overwrite", spread_over: int = 8,
) -> None:
    """One dataset, partitioned by folder.  ``df`` is run once.

    Rows are dealt by folder and one of ``spread_over`` parts of its files: the tasks
    do not each leave a file in every folder, and a large folder is written by several.
    ``mode`` is ``overwrite``, ``append`` (a later run adds files) or ``folders``, which
    replaces the folders that ``df`` has and keeps the others.
    """
    part = F.pmod(F.xxhash64(*within), F.lit(spread_over))
    writer = df.repartition(*by, part).write.partitionBy(*by).format(fmt)
    if mode == "folders":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        writer.mode(mode).save(path)


def write_clean_documents(cleaned: DataFrame, path: str) -> None:
    write_dataset(cleaned.select("source_folder", "source_file", "text", "n_before", "n_after", "bad"), path)


DATASET_COLUMNS = [
    "source_folder", "source_file", "paragraph_index", "section_title", "paragraph", "label", "confidence", "stability_score",
]


def write_labelled_dataset(dataset: DataFrame, path: str, questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> None:
    """The labelled dataset without details, answers as one map, as JSON lines."""
    answers = F.map_from_arrays(F.array(*[F.lit(q) for q in questions]), F.array(*[F.col(f"Q_{q}") for q in questions]))
    dataset.select(*DATASET_COLUMNS, answers.alias("reponses_questions")).write.mode("overwrite").json(path)


def write_report(tables: Mapping[str, DataFrame], run_dir: str, fmt: str = "parquet") -> None:
    """Each named table as its own dataset under the run's directory."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{run_dir.rstrip('/')}/{name}")
