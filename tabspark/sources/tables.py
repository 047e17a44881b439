"""Readers and writers chosen by file suffix."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions.columns import col
from tabspark.operators.validate import TableCheckError
from tabspark.sources.arrow_file import arrow_files, register_arrow_source
from tabspark.sources.quoted import quoted_rows

# Texts that a delimited file means as "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

FORMATS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "jsonl",
    ".feather": "feather",
}


def format_of(path: str) -> str:
    """Format by suffix; a directory or glob is judged by the suffix of its last part."""
    last = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, name in FORMATS.items():
        if last.endswith(suffix):
            return name
    raise TableCheckError(f"unsupported file format: {path}; supported: {', '.join(FORMATS)}")


def read_any(spark: SparkSession, path: str, format: str = "auto", **options) -> DataFrame:
    """Read a file, directory or glob; ``format`` overrides the suffix, options go to the reader.

    A missing path, an unknown suffix or a reader failure raises :class:`TableCheckError`.
    """
    kind = format_of(path) if format == "auto" else format
    if kind not in FORMATS.values():
        raise TableCheckError(f"unsupported file format: {kind}")
    if kind == "feather" and not arrow_files(path):
        raise TableCheckError(f"data file not found: {path}")
    try:
        if kind in ("csv", "tsv"):
            return read_delimited(spark, path, sep="\t" if kind == "tsv" else ",", **options)
        if kind == "parquet":
            return spark.read.options(**options).parquet(path)
        if kind in ("json", "jsonl"):
            if kind == "json" and "multiLine" not in options:
                return _read_json(spark, path, options)
            return spark.read.options(**options).json(path)
        register_arrow_source(spark)
        return spark.read.format("arrow_file").options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise TableCheckError(f"data file not found: {path}") from error
        raise TableCheckError(f"failed to load {path}: {error}") from error


def _read_json(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """JSON files of either form: those with a value per line in splits, documents whole; a folder may hold both."""
    forms = _json_forms(spark, path)
    if len(set(forms.values())) < 2:
        lines = all(forms.values())
        return spark.read.options(**{"multiLine": not lines, **options}).json(path)
    parts = [spark.read.options(**{"multiLine": not form, **options}).json([f for f, x in forms.items() if x == form])
             for form in (True, False)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def _json_forms(spark: SparkSession, path: str) -> dict[str, bool]:
    """For each file with content whether it holds one JSON value per line.

    The first line that is not blank tells: a document that spans lines leaves brackets or a
    text open there. Texts are taken out and brackets counted where the line is; a flag for each file
    reaches the driver. The sink writes lines.
    """
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*+"', "")
    opened, closed = (F.length(F.regexp_replace(bare, f"[^{x}]", "")) for x in (r"\[{", r"\]}"))
    first = spark.read.text(path).filter("_metadata.file_block_start = 0").filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), (~bare.contains('"') & (opened == closed)).alias("whole"),
        F.monotonically_increasing_id().alias("at"))
    return {r["file"]: r["whole"] for r in first.groupBy("file").agg(F.min_by("whole", "at").alias("whole")).collect()}


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """CSV with a header, typed by content, with every usual missing-value text as NULL.

    Spark accepts a single null text, so columns are read as strings, missing texts
    become NULL, and each column is cast to the narrowest of bigint, double and
    boolean that all its values fit. Give a ``schema`` to save the typing scan.

    Quotes are doubled inside quoted cells, and cells may hold line breaks. Files are read in
    splits all the same (:func:`quoted.quoted_rows`), at the cost of one more scan of the
    lines. ``multiLine=False`` saves that scan where no cell holds a break; ``multiLine=True``
    and options of the reader other than ``sep`` and ``header`` leave a file to one task.
    """
    split = not options.keys() - {"sep", "header"} and options.get("header", True) is True
    options = {"header": True, "escape": '"', "multiLine": True, **options}
    text = spark.read.options(**options, inferSchema=False).csv(path)
    if split and text.columns:
        sep = options.get("sep", ",")
        plain = [f"c{i}" for i in range(len(text.columns))]
        cells = F.from_csv("value", ", ".join(f"{c} string" for c in plain),
                           {"sep": sep, "escape": '"', "maxColumns": str(max(20480, 2 * len(plain)))})
        rows = quoted_rows(spark, path, sep).select(cells.alias("cells"))
        text = rows.select(*[F.col("cells")[c].alias(name) for c, name in zip(plain, text.columns, strict=True)])
    cells = text.select(
        *[F.when(~col(c).isin(*MISSING_TOKENS), col(c)).alias(c) for c in text.columns]
    )
    if schema is not None:
        parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return cells.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in parsed.fields])
    trials = ("bigint", "double", "boolean")
    fits = [
        F.count_if(col(c).isNotNull() & ~_reads_as(c, t)).alias(f"{i}_{t}")
        for i, c in enumerate(cells.columns)
        for t in trials
    ]
    filled = [F.count(col(c)).alias(f"{i}_n") for i, c in enumerate(cells.columns)]
    found = cells.agg(*fits, *filled).first()
    typed = []
    for i, c in enumerate(cells.columns):
        fitting = [t for t in trials if found[f"{i}_{t}"] == 0]
        # A column without any value is numeric (all missing).
        target = "double" if found[f"{i}_n"] == 0 else fitting[0] if fitting else "string"
        typed.append(col(c).cast(target).alias(c))
    return cells.select(*typed)


def _reads_as(column: str, target: str) -> Column:
    if target == "boolean":
        return F.lower(col(column)).isin("true", "false")
    fits = col(column).try_cast(target).isNotNull()
    # Java also reads "1d" and "1f" as numbers.
    return fits & ~col(column).rlike("[0-9.][dDfF]$") if target == "double" else fits


def write_table(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Write a directory of part files; the suffix picks Parquet, JSON lines (``.json`` too) or (else) CSV.

    Texts keep their blanks, quotes and line breaks in every format.
    """
    writer = df.write.mode(mode)
    lowered = path.lower()
    if lowered.endswith(".parquet"):
        writer.options(**options).parquet(path)
    elif lowered.endswith((".json", ".jsonl")):
        writer.options(**{"ignoreNullFields": False, **options}).json(path)
    else:
        sep = "\t" if lowered.endswith(".tsv") else ","
        whole = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**{"header": True, "sep": sep, **whole, **options}).csv(path)
