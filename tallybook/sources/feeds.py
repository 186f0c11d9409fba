"""The text feeds: raw scan, curated files, bulk load, publishing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.parsing import TIMESTAMP_FORM, parse_date, parse_timestamp
from tallybook.functions.text import empty_to_null
from tallybook.operators.cleaning import fill_null_text, parsed_once, repair_utf8, truncate_text
from tallybook.operators.quality import split_rejects
from tallybook.schemas import LOAD_SCHEMAS, RAW_COLUMNS, TEXT_WIDTHS
from tallybook.sources.records import read_records

# Quotes inside a field are doubled and blanks belong to the field, on both sides.
CSV_FORM = {
    "header": True,
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
CORRUPT = "_corrupt_record"
WHOLE = "_whole"


def _parsed(records: Column, names: list[str]) -> Column:
    """The fields of a record's text as a struct of texts."""
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    form = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_FORM.items() if k != "header"}
    return F.from_csv(records, F.lit(fields), {**form, "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT})


def _feed(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns in a feed's header and all its records, as text."""
    plain = spark.read.options(**CSV_FORM, multiLine=multi_line).csv(path)
    if not multi_line or not plain.columns:
        return plain
    records = read_records(spark, path).where(~F.col("head"))
    return parsed_once(records, _parsed(F.col("record"), plain.columns).alias("r")).select("r.*")


def read_feed(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """One raw feed, every column as text under the names in its header.

    Only the header is read to learn the names: there is no pass over the data to guess types.
    ``multi_line`` admits line breaks inside quoted fields; a file is read by many tasks in both cases (``records``),
    but twice with it. Turn it off for feeds known to have none.
    """
    df = _feed(spark, path, multi_line)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df.select(*columns)


def read_raw(spark: SparkSession, folder: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """The three raw feeds of a folder: ``users.csv``, ``books.csv``, ``transactions.csv``."""
    return {
        name: read_feed(spark, f"{folder.rstrip('/')}/{name}.csv", columns, multi_line)
        for name, columns in RAW_COLUMNS.items()
    }


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Curated table as CSV: header, minimal quoting, missing values as empty fields."""
    writer = fill_null_text(df).write.mode(mode)
    writer.options(**CSV_FORM, nullValue="", emptyValue="").csv(path)


def _converted(field: T.StructField, ts_form: str) -> Column:
    raw = empty_to_null(F.col(field.name))
    if isinstance(field.dataType, T.DateType):
        return parse_date(raw)
    if isinstance(field.dataType, T.TimestampNTZType) and ts_form == TIMESTAMP_FORM:
        return parse_timestamp(raw)
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.when(raw.rlike(ts_form), raw.try_cast("timestamp_ntz"))
    return raw if isinstance(field.dataType, T.StringType) else raw.try_cast(field.dataType)


def _records(spark: SparkSession, path: str, names: list[str], multi_line: bool) -> tuple[DataFrame, Column]:
    """The records as text with the raw text of a malformed one beside it, and whether a record is whole."""
    if multi_line:
        header = spark.read.options(**CSV_FORM, multiLine=True).csv(path).columns
        if header and header != names:
            raise ValueError(f"{path} has the header {header!r}, expected {names}")
        records = read_records(spark, path).where(~F.col("head"))
        open_record = F.when(F.col("open"), F.col("record"))
        parsed = parsed_once(records, _parsed(F.col("record"), [*names, CORRUPT]).alias("r"), open_record.alias("open"))
        raw = parsed.select(*[F.col(f"r.`{c}`") for c in names], F.coalesce("open", f"r.{CORRUPT}").alias(CORRUPT))
        return raw, F.col(CORRUPT).isNull()
    lines = spark.read.text(path)
    head = lines.first()
    header = head["value"] if head else ",".join(names)
    if [c.strip('"') for c in header.split(",")] != names:
        raise ValueError(f"{path} has the header {header!r}, expected {names}")
    parsed = _parsed(F.col("value"), [*names, CORRUPT])
    # A quote that stays open would swallow the rest of its line without a complaint from the parser.
    open_quote = F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1
    records = parsed_once(
        lines.filter((F.col("value") != header) & (F.col("value") != "")),
        parsed.alias("r"),
        F.when(open_quote, F.col("value")).alias("open"),
    )
    raw = records.select(*[F.col(f"r.`{c}`") for c in names], F.coalesce("open", f"r.{CORRUPT}").alias(CORRUPT))
    return raw, F.col(CORRUPT).isNull()


def copy_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    widths: Mapping[str, int] | None = None,
    ts_form: str = TIMESTAMP_FORM,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Bulk load of a curated file into typed columns: ``(loaded, rejected)``.

    Empty fields become NULL, invalid characters are repaired, long text is cut. A row with a field
    that does not convert, or with more or fewer fields than the table, is rejected whole, as text, with the
    reasons; the raw text of a malformed row is in ``_corrupt_record``. With ``multi_line`` off a row that leaves a
    quote open is malformed too, and one large file is read by many tasks.
    """
    raw, whole = _records(spark, path, schema.names, multi_line)
    # Fields are parsed and converted once a row: rules that held the conversions would repeat them in every filter.
    raw = repair_utf8(raw.withColumn(WHOLE, whole))
    typed = {f.name: f"_typed_{i}" for i, f in enumerate(schema.fields)}
    both = parsed_once(raw, *[F.col(f"`{c}`") for c in raw.columns], *[_converted(f, ts_form).alias(typed[f.name]) for f in schema.fields])
    rules = {"number of fields or quotes": F.col(WHOLE)} | {
        f"{f.name} does not convert": empty_to_null(F.col(f"`{f.name}`")).isNull() | F.col(typed[f.name]).isNotNull()
        for f in schema.fields
        if not isinstance(f.dataType, T.StringType)
    }
    ok, rejected = split_rejects(both, rules)
    loaded = ok.select(*[F.col(typed[c]).alias(c) for c in schema.names])
    return truncate_text(loaded, widths or {}), rejected.drop(WHOLE, *typed.values())


def copy_star(spark: SparkSession, folder: str, multi_line: bool = True) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Load the curated files in dependency order: users, books, sales."""
    files = {"dim_users": "users.csv", "dim_books": "books.csv", "fact_sales": "transactions.csv"}
    return {
        table: copy_csv(spark, f"{folder}/{name}", LOAD_SCHEMAS[table], TEXT_WIDTHS.get(table), multi_line=multi_line)
        for table, name in files.items()
    }


def publish(
    spark: SparkSession, source: str, target: str, overwrite: bool = False, multi_line: bool = True
) -> dict[str, str]:
    """Copy the raw feeds below ``target``: what happened to each feed, by name.

    Every column in a feed's header and every record is kept, missing and empty fields apart. A missing feed is
    skipped. A feed already there is left alone unless ``overwrite``.
    """
    outcome = {}
    for name in RAW_COLUMNS:
        try:
            feed = _feed(spark, f"{source.rstrip('/')}/{name}.csv", multi_line)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            outcome[name] = "missing"
            continue
        path = f"{target.rstrip('/')}/{name}.csv"
        present = not overwrite and path_exists(spark, path)
        if not present:
            writer = feed.write.mode("overwrite" if overwrite else "errorifexists")
            writer.options(**CSV_FORM, nullValue="", emptyValue='""').csv(path)
        outcome[name] = "skipped" if present else "published"
    return outcome


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at ``path``."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
