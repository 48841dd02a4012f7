"""Load and write steps (scan, table set, result sink, result location, preview)."""

from __future__ import annotations

import csv
import os
import re
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.functions.predicates import int_or_null
from crashlens.session import staging_path
from crashlens.sources.schemas import NUMERIC_TYPES


KEY_COLUMNS = ("crash_id", "unit_nbr", "prsn_nbr")


def _strict(col: Column, name: str, to: str) -> Column:
    """The cast value; a text that is not a number of that type stops the job and is named."""
    value = int_or_null(col, to)
    message = F.concat(F.lit(f"column {name}: not a {to}: "), col)
    return F.when(col.isNotNull() & value.isNull(), F.raise_error(message).cast(to)).otherwise(value)


def apply_types(df: DataFrame, types: Mapping[str, T.DataType] = NUMERIC_TYPES,
                bad_counters: str = "error") -> DataFrame:
    """Cast the named columns (matched case-insensitively), lower all names, keep every column.

    A key that is not a number raises an error naming column and value: as NULL it would join
    the group of all NULL keys, and the dedup would drop its row. ``bad_counters="null"``
    turns malformed values of the other numeric columns into NULL; by default they raise too.
    A plain projection, so it fuses into the scan's codegen stage.
    """
    if bad_counters not in ("error", "null"):
        raise ValueError(f"bad_counters must be 'error' or 'null', not {bad_counters!r}")
    lowered = {k.lower(): v for k, v in types.items()}
    cols = []
    for f in df.schema.fields:
        name = f.name.lower()
        want = lowered.get(name)
        col = F.col(f"`{f.name}`")
        if want is None or f.dataType == want:
            cast = col
        elif isinstance(f.dataType, T.StringType) and isinstance(want, (T.IntegerType, T.LongType)):
            strict = name in KEY_COLUMNS or bad_counters == "error"
            cast = _strict(col, name, want.simpleString()) if strict else int_or_null(col, want.simpleString())
        elif name in KEY_COLUMNS or bad_counters == "error":
            # From another number type; what does not fit must not become NULL either.
            cast = F.when(col.isNotNull() & col.try_cast(want).isNull(), F.raise_error(
                F.concat(F.lit(f"column {name}: not a {want.simpleString()}: "), col.cast("string"))
            ).cast(want)).otherwise(col.try_cast(want))
        else:
            cast = col.try_cast(want)
        cols.append(cast.alias(name))
    return df.select(*cols)


def check_columns(df: DataFrame, name: str, required: Sequence[str]) -> None:
    """Raise, before any data is read, if a table lacks a column that is needed."""
    missing = [c for c in required if c.lower() not in {x.lower() for x in df.columns}]
    if missing:
        raise ValueError(f"table {name!r} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")


# Working columns of a CSV scan.
_TEXT, _FILE, _REASON = "__crashlens_text", "__crashlens_file", "__crashlens_reason"


def _header(spark: SparkSession, file: str, sep: str, quote: str, encoding: str) -> list[str] | None:
    """The names in a CSV file's first line, read through the file system that Spark uses; None
    for a file without any line."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            codec.createInputStream(stream) if codec is not None else stream, encoding))
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
    finally:
        stream.close()
    return None if line is None else next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep, quotechar=quote or None,
                                                     quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE))


def csv_headers(spark: SparkSession, path: str | Sequence[str], options: Mapping[str, str] | None = None) -> dict[tuple[str, ...], list[str]]:
    """The files behind a path by their header, in path order. Only first lines are read, 32
    files at a time."""
    low = {k.lower(): v for k, v in (options or {}).items()}
    files = sorted(spark.read.format("text").load(path if isinstance(path, str) else list(path)).inputFiles())
    args = (low.get("sep", low.get("delimiter", ",")), low.get("quote", '"'), low.get("encoding", low.get("charset", "UTF-8")))
    with ThreadPoolExecutor(max_workers=32) as pool:
        headers = list(pool.map(lambda f: _header(spark, f, *args), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(files, headers):
        if names is not None:
            doubled = sorted({n for n in names if [x.lower() for x in names].count(n.lower()) > 1})
            if doubled:
                raise ValueError(f"{file}: the header names {', '.join(doubled)} more than once")
            out.setdefault(tuple(names), []).append(file)
    return out


def _plain_path(spark: SparkSession, file: str) -> str:
    """A listed file as a path for a reader: decoded, and with the signs of patterns escaped."""
    text = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(file)).toString()
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", text)


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             options: Mapping[str, str] | None = None, missing_columns: str = "error") -> DataFrame:
    """Every record of a CSV file or folder as text columns, aligned by the names in each file's
    header, with the file, and the text of records that do not have their header's number of
    fields (or leave a quote open).

    Files with the same header are one scan; files that order their columns differently are
    further scans, united by name. ``columns`` are the names expected (default: those of the
    first file). A file that lacks one of them, or has one more, is refused by name;
    ``missing_columns="null"`` fills columns that are no keys with NULL instead.
    """
    if missing_columns not in ("error", "null"):
        raise ValueError(f"missing_columns must be 'error' or 'null', not {missing_columns!r}")
    groups = csv_headers(spark, path, options)
    names = list(columns) if columns is not None else list(next(iter(groups), ()))
    if columns is None and missing_columns == "null":
        known = {n.lower() for n in names}
        for header in groups:
            names += [n for n in header if n.lower() not in known]
            known |= {n.lower() for n in header}
    wanted = {n.lower() for n in names}
    for header, files in groups.items():
        have = {n.lower() for n in header}
        lost = [n for n in names if n.lower() not in have and (missing_columns == "error" or n.lower() in KEY_COLUMNS)]
        more = [n for n in header if n.lower() not in wanted]
        if lost or more:
            raise ValueError(f"{files[0]}: " + "; ".join(
                [f"no column {', '.join(lost)}"] * bool(lost) + [f"unexpected column {', '.join(more)}"] * bool(more)))
    low = {k.lower(): v for k, v in (options or {}).items()}
    # What only the file reader can do; otherwise lines are parsed, and their text is at hand.
    by_line = low.get("multiline", "false").lower() != "true" and not {"encoding", "charset", "comment", "linesep"} & set(low)
    if low.get("multiline", "false").lower() == "true":
        _check_quotes(spark, [f for files in groups.values() for f in files], low)
    scans = []
    for header, files in groups.items() or [(tuple(names), [])]:
        given = path if len(groups) <= 1 else [_plain_path(spark, f) for f in files]
        df = _parsed_lines(spark, given, header, options) if by_line else _parsed_records(spark, given, header, options)
        of = {n.lower(): F.col(_quoted_name(n)) for n in header}
        scans.append(df.select(*[of.get(n.lower(), F.lit(None).cast("string")).alias(n) for n in names], _TEXT, _FILE))
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out


def _strings(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in (*header, _TEXT)])


def _parsed_records(spark: SparkSession, path: str | list[str], header: Sequence[str], options: Mapping[str, str] | None) -> DataFrame:
    """The records of files with one header by Spark's file reader, which also joins lines."""
    reader = (spark.read.schema(_strings(header)).options(**dict(options or {})).option("mode", "PERMISSIVE")
              .option("header", "true").option("columnNameOfCorruptRecord", _TEXT).option("columnPruning", "false"))
    return reader.csv(path).withColumn(_FILE, F.col("_metadata.file_path"))


def _parsed_lines(spark: SparkSession, path: str | list[str], header: Sequence[str], options: Mapping[str, str] | None) -> DataFrame:
    """The records of files with one header, one to a line. Knowing the line, a quote that is
    still open at its end is found too (the parser closes it without a word)."""
    low = {k.lower(): v for k, v in (options or {}).items()}
    quote, sep = low.get("quote", '"'), low.get("sep", low.get("delimiter", ","))
    line = F.col("value")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias("at"))
    parse = {**{k: v for k, v in (options or {}).items() if k.lower() != "header"}, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _TEXT}
    ddl = ", ".join(f"{_quoted_name(f.name)} string" for f in _strings(header).fields)
    open_quote = F.lit(False)
    if quote:
        q, mark = re.escape(quote), F.lit(quote)
        bare = F.regexp_replace(line, r"\\.", "")
        odd = (F.length(bare) - F.length(F.replace(bare, mark, F.lit("")))) % 2 == 1
        tail = rf"(?:^|{re.escape(sep)}){q}(?:[^{q}\\]|\\.|{q}{q})*$"  # a field that begins with a quote, up to the end
        open_quote = F.when(line.contains(quote), F.when(odd, line.rlike(tail)).otherwise(False)).otherwise(False)
    names = [F.col(f"r.{_quoted_name(n)}").alias(n) for n in header]
    # The header stands in a file's first block; in later ones such a line is a (bad) record.
    return (lines.where((F.trim(line) != "") & ~((F.col("at") == 0) & _is_header(line, header, sep, quote)))
            .withColumn("r", F.from_csv(line, ddl, parse))
            .select(*names, F.when(F.col(f"r.{_TEXT}").isNotNull() | open_quote, line).alias(_TEXT), _FILE))


def _is_header(line: Column, header: Sequence[str], sep: str, quote: str) -> Column:
    plain = line if not quote else F.replace(line, F.lit(quote), F.lit(""))
    return plain == sep.join(header)


def _check_quotes(spark: SparkSession, files: Sequence[str], low: Mapping[str, str]) -> None:
    """Refuse, by name, files of several-line records in which a quote is never closed: it would
    take all that follows into one field. Characters are counted, nothing is parsed."""
    quote = low.get("quote", '"')
    if not quote or not files:
        return
    bare = F.regexp_replace("value", r"\\.", "")
    n = F.sum(F.length(bare) - F.length(F.replace(bare, F.lit(quote), F.lit(""))))
    odd = (spark.read.text([_plain_path(spark, f) for f in files]).groupBy(F.col("_metadata.file_path").alias("file"))
           .agg(n.alias("n")).where("n % 2 = 1").orderBy("file").limit(5).collect())
    if odd:
        raise ValueError(f"a quote is never closed in {', '.join(r.file for r in odd)}")


def _quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _reasons(df: DataFrame, types: Mapping[str, T.DataType], bad_counters: str) -> Column:
    """Why a scanned record cannot be used; NULL if it can."""
    tests = [F.when(F.col(_TEXT).isNotNull(), F.lit("wrong number of fields or an open quote"))]
    lowered = {k.lower(): v for k, v in types.items()}
    for c in df.columns:
        want = lowered.get(c.lower())
        if isinstance(want, (T.IntegerType, T.LongType)) and (c.lower() in KEY_COLUMNS or bad_counters == "error"):
            col = F.col(_quoted_name(c))
            tests.append(F.when(col.isNotNull() & int_or_null(col, want.simpleString()).isNull(), F.concat(
                F.lit(f"column {c.lower()}: not a {want.simpleString()}: "), col)))
    return F.coalesce(*tests)


@dataclass(frozen=True)
class Checked:
    """A table parsed once: its good rows, typed, and the rejected records as ``file, reason,
    text``; both read the staged table in ``folder``."""

    good: DataFrame
    rejected: DataFrame
    folder: str

    def release(self) -> None:
        delete_path(self.good.sparkSession, self.folder)


def load_checked(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 types: Mapping[str, T.DataType] = NUMERIC_TYPES, options: Mapping[str, str] | None = None,
                 bad_counters: str = "error", missing_columns: str = "error", folder: str | None = None) -> Checked:
    """Parse a CSV table once into the staging folder and part good rows from rejected records.

    Rejected are records with too many or too few fields, with an open quote, or with a key (or,
    unless ``bad_counters="null"``, a counter) that is not a number. Nothing is parsed twice:
    both outputs read the staged Parquet files.
    """
    folder = folder or staging_path(spark, uuid.uuid4().hex)
    if schema is not None:
        types, bad_counters = {f.name: f.dataType for f in schema.fields}, "null"
    scanned = scan_csv(spark, path, schema.names if schema is not None else None, options, missing_columns)
    parsed = scanned.withColumn(_REASON, _reasons(scanned, types, bad_counters))
    parsed.write.parquet(folder)
    staged = spark.read.schema(parsed.schema).parquet(folder)
    values = [c for c in staged.columns if c not in (_TEXT, _FILE, _REASON)]
    good = apply_types(staged.where(F.col(_REASON).isNull()).select(*map(_quoted_name, values)), types, bad_counters)
    record = F.coalesce(F.col(_TEXT), F.to_csv(F.struct(*map(_quoted_name, values))))
    rejected = staged.where(F.col(_REASON).isNotNull()).select(F.col(_FILE).alias("file"), F.col(_REASON).alias("reason"), record.alias("text"))
    return Checked(good, rejected, folder)


def load_table(spark: SparkSession, path: str, fmt: str = "csv",
               schema: T.StructType | None = None,
               types: Mapping[str, T.DataType] = NUMERIC_TYPES,
               options: Mapping[str, str] | None = None, bad_counters: str = "error",
               spread: int | None = None, missing_columns: str = "error") -> DataFrame:
    """Read one incident table; a record that cannot be read as its header says stops the job.

    CSV: columns go by the names in each file's header (see :func:`scan_csv`), no schema
    inference (a full extra pass over the files). Every column is read as text and the known
    numeric columns are cast. A record with too many or too few fields, or with an open quote,
    raises an error with the file and the record; :func:`load_checked` sets such records aside
    instead. With ``schema`` the headers must have its names, in any order, and what its other
    numeric columns cannot hold is NULL. Any other ``DataFrameReader`` format (parquet, orc, json,
    ...) is read as is and cast the same way. Column names come out lower case. ``bad_counters``
    as in :func:`apply_types`. ``spread`` is for a file that cannot be split (gzip): its rows are
    dealt over that many partitions; by default nothing is moved.
    """
    low = {k.lower(): str(v).lower() for k, v in (options or {}).items()}
    if fmt == "csv" and low.get("header", "true") == "true":
        scanned = scan_csv(spark, path, schema.names if schema is not None else None, options, missing_columns)
        message = F.concat(F.lit("wrong number of fields or an open quote in "), F.col(_FILE), F.lit(": "), F.col(_TEXT))
        df = scanned.where(F.when(F.col(_TEXT).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop(_TEXT, _FILE)
        if schema is not None:
            types, bad_counters = {f.name: f.dataType for f in schema.fields}, "null"
    else:
        reader = spark.read.format(fmt).options(**dict(options or {}))
        df = (reader if schema is None else reader.schema(schema)).load(path)
    return apply_types(df.repartition(spread) if spread else df, types, bad_counters)


def load_tables(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv",
                schemas: Mapping[str, T.StructType] | None = None,
                required: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """A name -> DataFrame map from a name -> path map (the table set); ``required`` columns
    are checked by name before any data is read."""
    schemas = schemas or {}
    tables = {name: load_table(spark, path, fmt, schema=schemas.get(name))
              for name, path in paths.items()}
    for name, df in tables.items():
        check_columns(df, name, (required or {}).get(name, ()))
    return tables


def load_tables_checked(spark: SparkSession, paths: Mapping[str, str],
                        required: Mapping[str, Sequence[str]] | None = None) -> dict[str, Checked]:
    """:func:`load_checked` for each table of a set of CSV tables, parsed side by side."""
    with ThreadPoolExecutor(max_workers=max(1, len(paths))) as pool:
        futures = {name: pool.submit(load_checked, spark, path) for name, path in paths.items()}
        tables = {name: f.result() for name, f in futures.items()}
    for name, table in tables.items():
        check_columns(table.good, name, (required or {}).get(name, ()))
    return tables


def all_rejected(tables: Mapping[str, Checked]) -> DataFrame:
    """The rejected records of a table set, as ``table, file, reason, text``."""
    parts = [t.rejected.select(F.lit(name).alias("table"), "file", "reason", "text") for name, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def delete_path(spark: SparkSession, place: str) -> bool:
    """Delete a file or folder of any file system that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def result_path(out_dir: str, name: str) -> str:
    """Where a question's result goes: one folder per question under ``out_dir``."""
    return os.path.join(out_dir, name)


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 options: Mapping[str, str] | None = None) -> str:
    """Write a result with any ``DataFrameWriter`` format; CSV gets a header line.

    An empty result still yields a file with the header. A sorted result is range
    partitioned, so each part file is sorted and the part files follow one another in
    sort order; a top-k result is a single part file.

    An overwrite writes to a hidden folder beside the target first and swaps it in when it is
    whole, so a write that fails leaves an earlier result as it was. The swap is two renames (the
    old folder aside, the new one in); if the second fails, the old folder is put back. Other
    modes write in place, as Spark does.
    """
    def save(to: str, how: str) -> None:
        writer = df.write.format(fmt).mode(how)
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.options(**dict(options or {})).save(to)

    if mode != "overwrite":
        save(path, mode)
        return path
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    mark = uuid.uuid4().hex
    # Spark and Hadoop listings leave out names that begin with a dot.
    fresh, old = (jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{kind}-{mark}") for kind in ("new", "old"))
    try:
        save(fresh.toString(), "errorifexists")
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"cannot move the earlier result {path} aside")
        try:
            if not fs.rename(fresh, target):
                raise OSError(f"cannot move the new result to {path}")
        except Exception:
            if had:
                fs.rename(old, target)
            raise
        if had:
            fs.delete(old, True)
    finally:
        fs.delete(fresh, True)  # nothing is left of it after the swap
    return path


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows, as a DataFrame; the caller decides whether to show them."""
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """One-row count, as a DataFrame (the action is left to the caller)."""
    return df.agg(F.count(F.lit(1)).alias("n"))
