"""Daily delimited trade files whose headers drift from day to day.

File names, sizes and header lines are read up front. Files with one and the
same header then form one native CSV scan with that header as its schema, so
columns bind by name, Spark splits large files, and unused columns are never
parsed. The few scans are united by name.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.cells import parse_instant, parse_price, parse_size, tidy, unquote
from ..operators.dedupe import drop_nulls, latest_value, rename_aliases, union_drifting
from ..operators.trading_calendar import with_prev_trading_day
from ..session import MOST_BROADCAST, broadcast_if_small

# The two names of the transaction id, and the text columns.
ID_ALIASES = {"orderId": "TVTIC"}
TEXT_COLUMNS = ["isin", "displayName", "quotation", "currency", "TVTIC", "mic", "flags"]

# Where a row came from: logical file, physical part and split, place in the split.
PLACE = ["source", "part", "block", "pos"]

#: The one text column that may hold the separator, and the name for a row's raw line.
FLAGS, RAW = "flags", "_raw_line"

NAME_DATE = r"^[^_]*_([^_.]*)"

# One spelling for file:/x and file:///x.
_SCHEME = r"^(\w+):/+"


def list_files(
    spark: SparkSession, root: str, glob: str = "*.csv", source: Column | None = None,
    date_pattern: str = NAME_DATE,
) -> DataFrame:
    """One row per file: path, part, source, size and the date its name promises.

    ``source`` names the logical file (default: the file's own name); a day
    delivered in parts has several paths with one source. A name without a
    valid date has a null ``file_date``. Empty files are listed too.
    """
    jvm, conf = _hadoop(spark)
    top = jvm.org.apache.hadoop.fs.Path(root)
    walk = top.getFileSystem(conf).listFiles(top, True)
    found = []
    while walk.hasNext():
        status = walk.next()
        path = status.getPath()
        name = path.getName()
        if fnmatch(name, glob) and not name.startswith(("_", ".")):
            part = re.sub(_SCHEME, r"\1:/", path.toUri().toString())
            found.append((path.toString(), part, name, status.getLen()))
    schema = "path string, part string, name string, file_size bigint"
    listed = spark.createDataFrame(found, schema)
    named = listed.withColumn("source", F.col("name") if source is None else source).drop("name")
    return named.withColumn("file_date", name_date(F.col("source"), date_pattern))


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def name_date(name: Column, pattern: str = NAME_DATE) -> Column:
    digits = F.regexp_extract(name, pattern, 1)
    stamp = F.try_to_timestamp(digits, F.lit("yyyyMMdd"))
    return F.when(digits.rlike(r"^\d{8}$"), stamp.cast("date"))


def files_near(files: DataFrame, start: dt.date, end: dt.date, slack_days: int = 5) -> DataFrame:
    """Coarse choice: name date within the range plus slack, or no date at all."""
    slack = dt.timedelta(days=slack_days)
    near = F.col("file_date").between(F.lit(start - slack), F.lit(end + slack))
    return files.where(F.col("file_date").isNull() | near)


def files_for_days(files: DataFrame, calendar: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Exact choice: the trading day before the name date is in the range."""
    dated = with_prev_trading_day(files, calendar, "file_date")
    inside = F.col("prev_trading_day").between(F.lit(start), F.lit(end))
    return dated.where(inside).drop("prev_trading_day")


def probe_headers(
    spark: SparkSession, paths: Sequence[str], separator: str = ";", threads: int = 32
) -> dict[str, tuple[tuple[str, ...], str | None]]:
    """Column names of each file's first line, and why it could not be read.

    Reads one line per file through Hadoop's file system and the codec that the
    file's name asks for, as Spark's own CSV reader does; no data passes the
    driver. A file of no bytes, compressed by name or not, has no names and no error; a file that vanished, is
    locked or cannot be decoded has no names and an error.
    """
    jvm, conf = _hadoop(spark)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(path: str) -> tuple[tuple[str, ...], str | None]:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            system = where.getFileSystem(conf)
            stream = system.open(where)
            try:
                codec = codecs.getCodec(where)
                if codec is not None and system.getFileStatus(where).getLen() == 0:
                    return (), None
                plain = stream if codec is None else codec.createInputStream(stream)
                text = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
                line = text.readLine()
            finally:
                stream.close()
        except Py4JJavaError as problem:
            return (), str(problem.java_exception)
        cells = [] if line is None else line.lstrip("\ufeff").split(separator)
        return tuple(c.strip().strip('"') for c in cells), None

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(paths, pool.map(first_line, paths)))


def header_of(spark: SparkSession, paths: Sequence[str], separator: str = ";"):
    """Column names of each file's first line; an empty or unreadable file has none."""
    return {path: names for path, (names, _) in probe_headers(spark, paths, separator).items()}


def compressed(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of ``paths`` whose names ask for a codec."""
    jvm, conf = _hadoop(spark)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    return [p for p in paths if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(p)) is not None]


def damage(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Files that cannot be read to their end, and why; whole ones are left out.

    One job reads all of them in the tasks. Only if it meets a damaged file are the
    paths halved and both halves tried, so ``n`` files with ``k`` damaged ones take at most
    ``k * (1 + log2 n)`` failed jobs. Any other failure is raised: it says nothing about a file.
    """
    paths = list(paths)
    if not paths:
        return {}
    try:
        spark.read.option("ignoreCorruptFiles", False).text(paths).count()
        return {}
    except (Py4JJavaError, PySparkException) as problem:
        reason = str(getattr(problem, "java_exception", problem))
        if "FAILED_READ_FILE" not in reason:
            raise
    if len(paths) == 1:
        return {paths[0]: reason}
    middle = len(paths) // 2
    return damage(spark, paths[:middle]) | damage(spark, paths[middle:])


def file_headers(
    spark: SparkSession, files: DataFrame, separator: str = ";", whole: bool = False
) -> DataFrame:
    """path, part, source, header and error per file; each file is opened once.

    Hand the result to :func:`read_cells`, :func:`sources_with` and the audit, which
    then open no file for its header again. With ``whole``, compressed files are
    also decoded to their end: one that is damaged behind its first line has an error and no header,
    so it is left out and named, and the others are read.
    """
    listed = files.select("path", "part", "source").collect()
    found = probe_headers(spark, [r["path"] for r in listed], separator)
    if whole:
        packed = compressed(spark, [path for path, (_, error) in found.items() if error is None])
        found |= {path: ((), error) for path, error in damage(spark, packed).items()}
    rows = [(r["path"], r["part"], r["source"], list(found[r["path"]][0]), found[r["path"]][1]) for r in listed]
    return spark.createDataFrame(rows, "path string, part string, source string, header array<string>, error string")


def _headed(spark: SparkSession, files: DataFrame, separator: str = ";") -> DataFrame:
    return files if "header" in files.columns else file_headers(spark, files, separator)


def sources_with(spark: SparkSession, files: DataFrame, column: str) -> DataFrame:
    """Sources with a file whose header names ``column``."""
    headed = _headed(spark, files)
    return headed.where(F.array_contains("header", column)).select("source").distinct()


def unreadable(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Sources with a file that could not be opened or decoded, and why."""
    headed = _headed(spark, files).where(F.col("error").isNotNull())
    return headed.groupBy("source").agg(F.min("error").alias("error"))


def read_cells(
    spark: SparkSession, files: DataFrame, columns: Sequence[str] | None = None,
    quoting: bool = True, separator: str = ";",
) -> DataFrame:
    """Raw text cells of all files, bound by each file's own header.

    Adds the :data:`PLACE` columns: ``pos`` counts rows within one split of one
    part (with gaps between splits), so (part, block, pos) is file order.
    ``quoting=False`` takes quotes as plain characters and strips them later.
    Surplus cells of a row belong to an unquoted flags cell that holds the separator
    and are joined back into it; behind a quoted one they are dropped. Missing cells
    are null. Files without any of ``columns`` add nothing, nor do unreadable ones,
    which :func:`unreadable` names. A file that turns out damaged while it is read
    ends the job with its name: rows never go missing in silence. Files that went through
    :func:`file_headers` with ``whole`` are known to be undamaged.
    """
    listed = _headed(spark, files, separator).collect()
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in listed:
        header = tuple(row["header"])
        if header and (columns is None or set(columns) & set(header)):
            layouts.setdefault(header, []).append(row["path"])
    place = "source string, part string, block bigint, pos bigint"
    if not layouts:
        return spark.createDataFrame([], f"{place}, " + ", ".join(f"{c} string" for c in columns or []))
    frames = []
    for header, paths in sorted(layouts.items()):
        kept = list(header) if columns is None else [c for c in header if c in set(columns)]
        # Only flags and what stands behind them can be moved by surplus cells.
        moved = FLAGS in header and bool(set(kept) & set(header[header.index(FLAGS) :]))
        fields = [*header, RAW] if moved else list(header)
        scan = (
            spark.read.schema(T.StructType([T.StructField(name, T.StringType()) for name in fields]))
            .option("header", True)
            .option("sep", separator)
            .option("quote", '"' if quoting else "")
            .option("escape", '"' if quoting else "\\")
            .option("mode", "PERMISSIVE")
            .option("ignoreCorruptFiles", False)
            .option("columnNameOfCorruptRecord", RAW)
            .option("columnPruning", not moved)
            .csv(paths)
        )
        cells = scan.withColumns(
            {
                "_part": F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/"),
                "_block": F.col("_metadata.file_block_start"),
                "_pos": F.monotonically_increasing_id(),
            }
        )
        if moved:
            cells = _joined_flags(cells, header, separator, quoting)
        names = {"_part": "part", "_block": "block", "_pos": "pos"}
        frames.append(cells.select(*names, *kept).withColumnsRenamed(names))
    cells = union_drifting(frames, ID_ALIASES)
    return cells.join(_sources(spark, listed), "part").select(
        *PLACE, *[c for c in cells.columns if c not in PLACE]
    )


def _joined_flags(
    cells: DataFrame, header: tuple[str, ...], separator: str, quoting: bool
) -> DataFrame:
    """Undo the cuts that separators inside an unquoted flags cell have made."""
    at = header.index(FLAGS)
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)' if quoting else ""
    split = cells.withColumn("_cells", F.split(RAW, re.escape(separator) + outside, -1))
    surplus = F.size("_cells") - len(header)
    cut = F.col(RAW).isNotNull() & (surplus > 0) & ~F.col("_cells")[at].startswith('"')

    def cell(index: Column) -> Column:
        text = F.element_at("_cells", index + 1)
        if quoting:
            text = F.replace(F.regexp_replace(text, '^"|"$', ""), F.lit('""'), F.lit('"'))
        return F.when(text != "", text)

    fixed = {FLAGS: F.when(cut, F.array_join(F.slice("_cells", at + 1, surplus + 1), separator)).otherwise(F.col(FLAGS))}
    for k, name in enumerate(header[at + 1 :], at + 1):
        fixed[name] = F.when(cut, cell(F.lit(k) + surplus)).otherwise(F.col(name))
    return split.withColumns(fixed)


def _sources(spark: SparkSession, listed) -> DataFrame:
    """File to source; the list of files is known here, so its size is checked."""
    pairs = [(r["part"], r["source"]) for r in listed]
    lookup = spark.createDataFrame(pairs, "part string, source string")
    return F.broadcast(lookup) if len(pairs) <= MOST_BROADCAST else lookup


def clean_trades(cells: DataFrame, quoting: bool = True, keep_name: bool = False) -> DataFrame:
    """Strict types for raw cells; rows without price, size or time are dropped."""
    out = cells if keep_name else cells.drop("displayName")
    texts = [c for c in TEXT_COLUMNS if c in out.columns]
    if not quoting:
        raw = [c for c in out.columns if c not in PLACE]
        out = out.withColumns({c: unquote(F.col(c)) for c in raw})
    out = rename_aliases(out, ID_ALIASES).withColumns(
        {
            "tradeTime": parse_instant(F.col("tradeTime")),
            "publishedTime": parse_instant(F.col("publishedTime")),
            "price": parse_price(F.col("price")),
            "size": parse_size(F.col("size")),
        }
    )
    out = drop_nulls(out, ["price", "size", "tradeTime"])
    return out.withColumns({c: tidy(F.col(c)) for c in texts}) if quoting else out


def security_names(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Display name per security; the newest file wins, then the later row."""
    dated = cells.select("isin", "displayName", *PLACE).join(
        broadcast_if_small(files.select("source", "file_date").distinct()), "source"
    )
    named = dated.withColumns({c: unquote(F.col(c)) for c in ["isin", "displayName"]})
    return latest_value(named, "isin", "displayName", ["file_date", *PLACE])
