"""Reading and writing of documents, chunks and evaluation items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import fixed
from lectern.operators.layout import index_lines, page_item_markdown, usable_items
from lectern.operators.scans import global_offsets
from lectern.session import reliable_checkpoint, stored

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("section_path", T.ArrayType(T.StringType())),
        T.StructField("page_start", T.IntegerType()),
        T.StructField("page_end", T.IntegerType()),
    ]
)


def decode_utf8(content: Column, drop_invalid: bool) -> Column:
    """Bytes to text; invalid bytes become U+FFFD or, if asked, disappear."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.replace(text, F.lit("�"), F.lit("")) if drop_invalid else text


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_file_name(path), r"\.[^.]*$", "")


def document_id_of(path: Column) -> Column:
    """Folder name without the full-document mark, lower-cased; else the file's stem."""
    folder = F.element_at(F.split(path, "/"), -2)
    name = F.regexp_replace(folder, f"(?i){fixed.FULL_DOCUMENT}", "")
    name = F.lower(F.btrim(name, F.lit("_- ")))
    return F.coalesce(F.nullif(name, F.lit("")), _stem(path))


def _glob(pattern: str) -> str:
    """A file name pattern as Spark takes it, as a regular expression."""
    out, depth = "", 0
    for part in re.findall(r"\[[^\]]+\]|.", pattern, re.DOTALL):
        if len(part) > 1:
            out += "[^" + part[2:] if part[1] in "!^" else part
        elif part in "*?":
            out += ".*" if part == "*" else "."
        elif part in "{},":
            depth += (part == "{") - (part == "}")
            out += {"{": "(?:", "}": ")", ",": "|" if depth else ","}[part]
        else:
            out += re.escape(part)
    return rf"(?s)\A{out}\z"


def write_packs(found: DataFrame, path: str) -> None:
    """Files, ``path`` (relative) and ``content``, many to a Parquet file, earlier output replaced.

    A file and a folder for each of very many documents cost their names more than their
    bytes: every one is made, listed and opened by itself.
    """
    found.select("path", "content").write.mode("overwrite").option("compression", "zstd").parquet(path)


def _found(spark: SparkSession, root: str, pattern: str, packs: str | None) -> DataFrame:
    """``path, content`` of all files below a folder, and of those in packs, that have such a name."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "content")
    )
    if packs is not None:
        packed = spark.read.schema("path string, content binary").parquet(packs)
        hidden = F.col("path").rlike(r"(?:^|/)[_.]")
        files = files.unionByName(packed.filter(_file_name(F.col("path")).rlike(_glob(pattern)) & ~hidden))
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no file named {pattern} below {root}")
    return files


def read_full_documents(
    spark: SparkSession, root: str, pattern: str = f"*{fixed.FULL_DOCUMENT}*.md", packs: str | None = None
) -> DataFrame:
    """All full-document files (markdown by default) below a folder: ``doc_id, source_file, text``.

    Spark skips files and folders whose name begins with an underscore or a dot. ``packs``
    names a folder of :func:`write_packs` whose files count as well.
    """
    path = F.col("path")
    return _found(spark, root, pattern, packs).select(
        document_id_of(path).alias("doc_id"),
        _file_name(path).alias("source_file"),
        decode_utf8(F.col("content"), drop_invalid=True).alias("text"),
    )


def read_page_files(
    spark: SparkSession, root: str, pattern: str = "[pP][aA][gG][eE]*.md", packs: str | None = None
) -> DataFrame:
    """All page files (markdown by default) below a folder, and in ``packs``: ``file, path, text``."""
    return _found(spark, root, pattern, packs).select(
        _file_name(F.col("path")).alias("file"),
        "path",
        decode_utf8(F.col("content"), drop_invalid=False).alias("text"),
    )


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """Page statistics parsed back from index files."""
    pattern = (
        r"^- \*\*Page (\d+)\*\* \| (\d+) chars \| (\d+) items \| (\d+) headings \| (\d+) tables"
    )
    lines = spark.read.text(path).select("value", F.input_file_name().alias("path"))
    names = ("page_no", "n_chars", "n_items", "n_headings", "n_tables")
    return lines.filter(F.col("value").rlike(pattern)).select(
        F.element_at(F.split("path", "/"), -2).alias("doc_id"),
        *[
            F.regexp_extract("value", pattern, i).cast("int").alias(name)
            for i, name in enumerate(names, start=1)
        ],
    )


def read_chunks(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Chunk records from JSON lines, every required key checked.

    A record without one of the keys fails the job when it is read. The page and path
    keys must be present but may hold null.
    """
    required = ("chunk_id", "document_id", "text", "section_path", "page_start", "page_end")
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    lines = reader.text(path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    ok = F.coalesce(F.size(missing) == 0, F.lit(False))
    checked = F.when(ok, F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("bad chunk record: "), "value"))
    )
    return lines.select(F.from_json(checked, CHUNK_SCHEMA, {"mode": "FAILFAST"}).alias("c")).select(
        "c.*"
    )


FILE_BYTES = 128 << 20


def write_by_size(
    rows: DataFrame, path: str, document: str, order: list[str], file_bytes: int = FILE_BYTES
) -> None:
    """Rows as JSON lines in files of about ``file_bytes``, whatever their documents are.

    Rows are sorted by document and ``order`` over all tasks and cut into ranges, so small
    documents share a file and a long one is several; there is no folder and no task per
    document. ``<path>/file=N`` are the files; ``<path>/_offsets``, which readers of the folder
    pass over, tells for every document which files it is in and at which rows of each.
    Earlier output is replaced.
    """
    names = [F.col(f"`{c}`") for c in rows.columns]
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*names))).cast("long") + 1), F.lit(0))
    files = max(1, -(-rows.agg(size).first()[0] // file_bytes))
    by = [document, *order]
    # Written first, so that both tables follow one division into files.
    placed = reliable_checkpoint(
        rows.repartitionByRange(files, *by)
        .sortWithinPartitions(*by)
        .withColumn("file", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    placed.sortWithinPartitions("file", "__at").drop("__at").write.mode("overwrite").partitionBy("file").option(
        "ignoreNullFields", "false"
    ).json(path)
    placed.groupBy(document, "file").agg(F.min("__at").alias("first"), F.max("__at").alias("last")).repartitionByRange(
        document
    ).sortWithinPartitions(document).write.mode("overwrite").parquet(f"{path}/_offsets")


def read_by_document(spark: SparkSession, path: str, document: str, schema: T.StructType | str, ids: DataFrame) -> DataFrame:
    """Rows that :func:`write_by_size` has written of the documents in ``ids``.

    Only the files that the offsets name are read; no folder is searched for documents.
    """
    wanted = ids.select(document).distinct()
    offsets = spark.read.parquet(f"{path}/_offsets")
    same = F.col(f"o.{document}").eqNullSafe(F.col(f"w.{document}"))
    files = offsets.alias("o").join(wanted.alias("w"), same, "left_semi").select("file").distinct()
    rows = spark.read.schema(schema).json(path).join(files, "file", "left_semi").drop("file")
    return rows.alias("o").join(wanted.alias("w"), same, "left_semi")


def read_by_size(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All rows that :func:`write_by_size` has written."""
    return spark.read.schema(schema).json(path).drop("file")


def write_chunks(chunks: DataFrame, path: str, by_document: bool = False) -> None:
    """Chunk records as JSON lines, earlier output replaced.

    ``by_document`` keeps the chunks of a document together, in files of bounded size with
    offsets (:func:`write_by_size`).
    """
    rows = chunks.select(*CHUNK_SCHEMA.names)
    if by_document:
        write_by_size(rows, path, "document_id", ["chunk_id"])
    else:
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


QUESTION_SCHEMA = (
    "id string, question string, answer string, question_type string, document_id string, "
    "chunk_id string, gold_chunk_ids array<string>, section_path array<string>"
)


def read_questions(
    spark: SparkSession, path: str, schema: str = QUESTION_SCHEMA, pattern: str = "*.json*"
) -> DataFrame:
    """Evaluation items from one JSON lines file or from all such files of a folder.

    The schema is given, so nothing is read to find it out; a line that is no JSON object
    fails the job. A folder without files is an error.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern)
    found = reader.json(path)
    if not found.inputFiles():
        raise ValueError(f"no files named {pattern} in {path}")
    return found


def read_curated_questions(spark: SparkSession, path: str) -> DataFrame:
    """Hand-curated items: files that each hold one JSON array.

    ``Gold_chunk_id`` may be a string or an array and is kept as text;
    ``operators.metrics.normalise_gold`` brings both to an array.
    """
    schema = "Question string, Gold_chunk_id string, golden_answer string"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_question_lines(
    spark: SparkSession, path: str, schema: str, limit: int | None = None
) -> DataFrame:
    """Items on the lines of one file or folder, numbered from 1; bad lines are skipped.

    ``line_no`` counts all physical lines, blank ones too, files in order of their names.
    With a ``limit`` only items on the first so many lines are returned. Lines are numbered
    by sums over blocks of the files; no task sees all lines.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
        "value",
    )
    keys = ["__file", "__block", "__at"]
    numbered = global_offsets(raw, keys, {"__before": F.lit(1)})
    if limit is not None:
        numbered = numbered.filter(F.col("__before") < limit)
    parsed = numbered.filter(F.trim("value") != "").select(
        (F.col("__before") + 1).alias("line_no"),
        F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("q"),
    )
    return parsed.filter(F.col("q._bad").isNull()).select("line_no", "q.*").drop("_bad")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_questions(questions: DataFrame, counts: DataFrame, path: str) -> None:
    """Items and their counters side by side: ``items/`` and ``metadata/`` JSON lines."""
    write_json_lines(questions, f"{path}/items")
    write_json_lines(counts, f"{path}/metadata")


def write_statistics(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_page_texts(items: DataFrame, path: str) -> None:
    """Blocks of the page texts as a table in page order, in place of one file per page."""
    block = page_item_markdown(F.col("label"), F.col("text"))
    order = ["doc_id", "page_no", "item_pos"]
    usable_items(items).select(*order, block.alias("block")).repartitionByRange(
        *order
    ).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_document_lines(lines: DataFrame, path: str, by_size: bool = False) -> None:
    """Full documents as text, one folder per document (``doc_id=...``).

    ``lines`` are the rows of ``layout.document_lines``. They are sorted over all tasks, so a
    long document is several files whose names give their order. ``by_size`` writes them in
    files of bounded size with offsets (:func:`write_by_size`): for very many documents.
    """
    order = ["doc_id", "item_pos", "line_no"]
    if by_size:
        write_by_size(stored(lines), path, "doc_id", order[1:])
        return
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", F.col("line").alias("value")
    ).write.mode("overwrite").partitionBy("doc_id").text(path)


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_document_lines` has written: ``doc_id, file, block, at, line``.

    ``file``, ``block`` and ``at`` order the lines of a document.
    """
    return spark.read.text(path).select(
        F.col("doc_id"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def write_index(stats: DataFrame, path: str, by_size: bool = False) -> None:
    """Index lines as text below a header, one folder per document, in page order.

    ``by_size`` writes ``doc_id, page_no, line`` (the header is page 0) in files of bounded size
    with offsets (:func:`write_by_size`): for very many documents.
    """
    order = ["doc_id", "page_no"]
    stats = stored(stats) if by_size else stats
    head = stats.groupBy("doc_id").agg(F.count("*").alias("n")).select(
        "doc_id", F.lit(0).alias("page_no"), F.format_string("# Page index (%d pages)", "n").alias("line")
    )
    lines = head.unionByName(index_lines(stats))
    if by_size:
        write_by_size(lines.select(*order, "line"), path, "doc_id", ["page_no"])
        return
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy(
        "doc_id"
    ).text(path)
