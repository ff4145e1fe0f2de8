"""Text sources: CSV samples, scripts, DDL and dictionary files, folder listings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.naming import business_name, ddl_type, file_category
from ledgerloom.operators.rows import sliced
from ledgerloom.session import cut

#: Entries of folders that a task hands over at once.
LISTED = 4096
#: Bytes of opened files that a task hands over at once, with the file that goes beyond.
OPENED = 4 << 20
#: What is written as %XX in the path of a file that was read.
NOT_IN_URI = re.compile(r"[^\w!.~'()*,;:$&+=@/\x80-\U0010ffff-]")
MARK = "﻿"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text; a byte order mark before the first name is dropped."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.toDF(*[name.lstrip(MARK) for name in raw.columns])


def csv_profile(spark: SparkSession, path: str) -> DataFrame:
    """Row count and first non-empty value of every CSV column, in one aggregate.

    "First" follows file name, position of the split in the file, then order in the split.
    """
    raw = read_csv(spark, path)
    placed = raw.select(
        *raw.columns,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("_at"),
    )
    filled = [F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col("_at")) for name in raw.columns]
    one = placed.agg(
        F.count("*").alias("_rows"),
        *[F.min_by(F.col(name), at).alias(name) for name, at in zip(raw.columns, filled)],
    )
    cells = [F.struct(F.lit(name.lower()).alias("field_name"), F.col(name).alias("example")) for name in raw.columns]
    return one.select(F.col("_rows").alias("row_count"), F.inline(F.array(*cells)))


#: Lines of one CSV record; a longer one comes from a quote that is never closed.
RECORD_LINES = 1_000


def csv_records(lines: DataFrame) -> DataFrame:
    """Records (file, line, record) of the lines (file, place, value) of CSV files, in which quoted values may hold line breaks.

    A line begins a record if the quotes before it in its file are even in number. Lines are put into range slices of their
    order; a slice is scanned with a window, and what it takes over from earlier ones, the parity and the begin of the open
    record, comes from one row for each slice. So a file of any size covers as many tasks as it has slices. ``line`` is the
    number of a record's first line. Blank lines between records are none. A record of more than ``RECORD_LINES`` lines is
    given line by line, so that an unclosed quote makes no group without a bound; each such line is then a record.
    """
    rows = sliced(lines.select("file", "place", "value"), ["file"], [F.col("place")])
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    earlier = Window.partitionBy("file").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "_slice").orderBy("place")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    sizes = rows.groupBy("file", "_slice").agg(F.count("*").alias("_rows"), F.sum(quotes).alias("_quotes"))
    carried = sizes.select(
        "file", "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)).alias("_quotes"),
    )
    counted = rows.withColumn("_own", F.row_number().over(inside)).withColumn(
        "_seen", F.coalesce(F.sum(quotes).over(before), F.lit(0))
    )
    line = (F.col("_rows") + F.col("_own")).alias("line")
    begins = ((F.col("_quotes") + F.col("_seen")) % 2 == 0).alias("_begins")
    marked = cut(counted.join(carried, ["file", "_slice"]).select("file", "_slice", line, "value", begins), "csv_lines")

    start = F.when(F.col("_begins"), F.col("line"))
    last = marked.groupBy("file", "_slice").agg(F.max(start).alias("_last"))
    opened = last.select("file", "_slice", F.max("_last").over(earlier).alias("_opened"))
    within = Window.partitionBy("file", "_slice").orderBy("line")
    owned = marked.withColumn("_start", F.max(start).over(within)).join(opened, ["file", "_slice"]).select(
        "file", F.coalesce("_start", "_opened").alias("_record"), "line", "value"
    )
    spans = owned.groupBy("file", "_record").agg(F.count("*").alias("_lines"))
    torn = spans.where(F.col("_lines") > RECORD_LINES).select("file", "_record", F.lit(True).alias("_torn"))
    whole = owned.join(torn, ["file", "_record"], "left")
    first = F.when(F.col("_torn"), F.col("line")).otherwise(F.col("_record"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda part: part["value"])
    joined = whole.groupBy("file", first.alias("line")).agg(F.array_join(parts, "\n").alias("record"))
    return joined.withColumn("record", F.rtrim(F.col("record"), F.lit("\r"))).where("record <> ''")


def read_dirty_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files with NUL characters and line breaks in quoted values: file, line, the columns, ``unreadable``.

    NULs go before anything is read. With ``header`` the first record of every file is its header, whatever it says; a data
    row that says the same is a row. A record with a value that is not of its type, or with too many or too few values, has
    its text in ``unreadable``, with NULL in what could not be read.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    clean = F.translate("value", "\u0000", "")
    lines = raw.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), clean.alias("value"))
    records = csv_records(lines)
    if header:
        records = records.where("line > 1")
    else:
        mark = (F.col("line") == 1) & F.col("record").startswith(MARK)
        records = records.withColumn("record", F.when(mark, F.expr("substr(record, 2)")).otherwise(F.col("record")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable", "escape": '"', "multiLine": "true"}
    parsed = F.from_csv("record", f"{schema}, unreadable string", options)
    return records.select("file", "line", parsed.alias("row")).select("file", "line", "row.*")


def _opened(root: str):
    """Texts of files (path) of a store as rows (path, text), some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(root)[0]
        paths, texts, size = [], [], 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "text"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path) as stream:
                    texts.append(stream.read())
                paths.append(NOT_IN_URI.sub(lambda mark: quote(mark.group()), path))
                size += len(texts[-1])
                if size >= OPENED or len(paths) >= LISTED:
                    yield taken()
                    paths, texts, size = [], [], 0
        if paths:
            yield taken()

    return run


def read_scripts(spark: SparkSession, path: str, pattern: str = "*.sql") -> DataFrame:
    """(path, text) of every script below a folder; ``pattern`` is matched with file names.

    Scripts are small and many, so they are listed and opened by the executors, dealt to tasks by their path; the driver
    holds none. Files and folders whose names begin with a dot or an underscore are left out, as in other reads.
    """
    root = _store(path)[1].rstrip("/") + "/"
    inside = F.expr(f"substr(path, {len(root) + 1})")
    hidden = inside.rlike(r"(^|/)(\.|_(?![^/]*=))")
    named = F.regexp_like(F.substring_index("path", "/", -1), F.lit(f"^{_glob(pattern)}$"))
    wanted = listed_files(spark, path).where(named & ~hidden).select("path")
    read = wanted.repartition(_tasks(spark), "path").mapInArrow(_opened(path), "path string, text binary")
    return read.select(F.concat(F.lit(_before(path)), "path").alias("path"), F.col("text").cast("string").alias("text"))


def _before(path: str) -> str:
    """What makes a path within the store of ``path`` a URI, as Spark spells it."""
    scheme, authority = re.match(r"(?:(\w+):)?(//[^/]*)?", path).groups()
    if scheme in (None, "file"):
        return "file:"
    return f"{scheme}:{authority if _store(path)[1].startswith('/') else '//'}"


def _glob(pattern: str) -> str:
    """A file name pattern with ``*`` and ``?`` as a regular expression."""
    return "".join({"*": ".*", "?": "."}.get(mark, re.escape(mark)) for mark in pattern)


def _tasks(spark: SparkSession) -> int:
    """Tasks that many small pieces are dealt to: their sizes say nothing about the time each takes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _saved(root: str):
    """Writes rows (file, text), equal files next to each other, as lines of these files of a store; yields the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        name = stream = draft = None
        saved = []

        def close() -> None:
            stream.close()
            store.move(draft, f"{folder}/{name}")
            saved.append(name)

        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                if file != name:
                    if stream is not None:
                        close()
                    parent = f"{folder}/{file}".rpartition("/")[0]
                    store.create_dir(parent)
                    name, draft = file, f"{parent}/.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(draft)
                stream.write((text or b"") + b"\n")
            if saved:
                yield pa.RecordBatch.from_arrays([pa.array(saved, pa.string())], ["file"])
                saved.clear()
        if stream is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(saved, pa.string())], ["file"])

    return run


def write_texts(rows: DataFrame, path: str) -> int:
    """Write rows (file, text) as files below a folder, named relative to it, and return how many files that are.

    The executors write; nothing goes through the driver, whose commit would move file after file. Rows of the same file
    become lines of it, a missing text an empty one. A file gets its name when it is complete, so a task that runs twice
    leaves the same files.
    """
    spark = rows.sparkSession
    dealt = rows.select("file", F.col("text").cast("binary").alias("text")).repartition(_tasks(spark), "file")
    return dealt.sortWithinPartitions("file").mapInArrow(_saved(path), "file string").count()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path is in, and the path there; without a scheme it is a local one."""
    scheme, inside = re.match(r"(?:(\w+):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), "/" + inside.strip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(inside)}".rstrip("/"))


def _listed(root: str):
    """What lies directly in folders of a store, as rows (path, folder, size_bytes), a few thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(root)[0]
        found = []

        def taken() -> pa.RecordBatch:
            folders = [entry.type == fs.FileType.Directory for entry in found]
            sizes = [None if is_folder else entry.size for entry, is_folder in zip(found, folders)]
            return pa.RecordBatch.from_arrays(
                [pa.array([entry.path for entry in found], pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())],
                ["path", "folder", "size_bytes"],
            )

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                inside = store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
                for begin in range(0, len(inside), LISTED):
                    found.extend(inside[begin : begin + LISTED])
                    if len(found) >= LISTED:
                        yield taken()
                        found = []
        if found:
            yield taken()

    return run


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Path in its store and size of every file below a folder, listed by the executors.

    Folders are rows: each round lists the folders that the last one found, dealt to tasks by their path, and writes what is
    in them. So there are as many rounds as the tree is deep, and the driver holds no file however many there are. Names
    that begin with a dot or an underscore are files like others; a folder that is not there has none.
    """
    schema = "path string, folder boolean, size_bytes bigint"
    level, found = spark.createDataFrame([(_store(path)[1],)], "path string"), None
    while True:
        # By number, so that small rows are not merged into few tasks: a folder's listing takes longer than its name.
        dealt = level.repartition(_tasks(spark), "path") if found is not None else level
        entries = cut(dealt.mapInArrow(_listed(path), schema), "listing")
        files = entries.where("not folder").select("path", "size_bytes")
        found = files if found is None else found.unionByName(files)
        level = entries.where("folder").select("path")
        if level.isEmpty():
            return found


def folder_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Relative path, category and size of every file below a folder, without reading contents."""
    root = _store(path)[1].rstrip("/") + "/"
    relative = F.expr(f"substr(path, {len(root) + 1})")
    return inventory(listed_files(spark, path).select(relative.alias("relative_path"), "size_bytes"))


def inventory(files: DataFrame) -> DataFrame:
    return files.select("relative_path", file_category(F.col("relative_path")).alias("file_category"), "size_bytes")


# Patterns that read a CREATE TABLE statement.
DDL_TABLE = r"(?i)CREATE\s+TABLE\s+([^\s(]+)\s*\("
DDL_COLUMNS_BEFORE_PARTITIONS = r"(?is)CREATE\s+TABLE\s+[^\s(]+\s*\((.*?)\)\s*PARTITIONED\s+BY"
DDL_COLUMNS = r"(?is)CREATE\s+TABLE\s+[^\s(]+\s*\((.*?)\)\s*(?:STORED|;)"
DDL_PARTITIONS = r"(?is)PARTITIONED\s+BY\s*\((.*?)\)\s*(?:STORED|;)"
DDL_FIELD = r"^([A-Za-z0-9_]+)\s+([A-Za-z]+(?:\s*\(\s*[\d,\s]+\s*\))?)"


def ddl_fields(ddl: DataFrame) -> DataFrame:
    """One row per field of each DDL text (path, text): type, NOT NULL and partition flags.

    A field listed twice keeps its first place and its last definition. Fields are dealt to tasks by path before they are
    grouped: grouped where they are read, all those of a task would be sorted at once.
    """
    text = F.col("text")
    block = F.coalesce(
        F.nullif(F.regexp_extract(text, DDL_COLUMNS_BEFORE_PARTITIONS, 1), F.lit("")),
        F.regexp_extract(text, DDL_COLUMNS, 1),
    )

    def fields(body: Column, partitioned: bool) -> Column:
        return F.transform(
            F.split(body, r"\r\n|\r|\n"),
            lambda line, at: F.struct(
                F.lit(partitioned).alias("partitioned"),
                at.alias("at"),
                F.rtrim(F.trim(line), F.lit(",")).alias("line"),
            ),
        )

    lines = F.concat(fields(block, False), fields(F.regexp_extract(text, DDL_PARTITIONS, 1), True))
    parsed = ddl.select(
        "path", F.regexp_extract(text, DDL_TABLE, 1).alias("table_name"), F.inline(lines)
    ).where(F.regexp_like("line", F.lit(DDL_FIELD)))
    physical = F.regexp_extract("line", DDL_FIELD, 2)
    rows = parsed.select(
        "path",
        F.nullif("table_name", F.lit("")).alias("table_name"),
        F.lower(F.regexp_extract("line", DDL_FIELD, 1)).alias("field_name"),
        F.struct("partitioned", "at").alias("_place"),
        F.upper(F.replace(physical, F.lit(" "), F.lit(""))).alias("physical_type"),
        ddl_type(physical).alias("logical_type"),
        F.upper("line").contains("NOT NULL").alias("required"),
        "partitioned",
    )
    dealt = rows.repartition("path", "table_name", "field_name")
    return dealt.groupBy("path", "table_name", "field_name").agg(
        *[F.max_by(name, "_place").alias(name) for name in ["physical_type", "logical_type", "required", "partitioned"]]
    )


def dictionary_fields(texts: DataFrame) -> DataFrame:
    """Business name and description per field from markdown tables (path, text).

    Header and rule lines are skipped; a field listed twice keeps its last description.
    """
    lines = texts.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line"))
    trimmed = F.trim("line")
    cells = F.transform(F.split(F.btrim(trimmed, F.lit("|")), r"\|"), lambda cell: F.trim(cell))
    rows = (
        lines.where(trimmed.startswith("|"))
        .select("path", "at", cells.alias("cells"))
        .where(F.size("cells") >= 2)
        .select("path", "at", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("description"))
        .where((F.col("name") != "") & (F.lower("name") != "nombre") & ~F.col("name").rlike("^-+$"))
    )
    return rows.groupBy("path", F.lower("name").alias("field_name")).agg(
        F.max_by(business_name(F.col("name")), "at").alias("business_name"),
        F.max_by("description", "at").alias("description"),
    )
