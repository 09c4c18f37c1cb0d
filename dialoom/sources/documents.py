"""Documents and their layout blocks: plain text, PDF files, driver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.text import flatten_lines

BLOCKS = "path string, page_no int, blk_no int, text string, page_count int, encrypted boolean, metadata map<string,string>, error string"

#: (bytes) -> pages of layout block texts, whether the file is encrypted, and its metadata, which may be left out.
PageReader = Callable[[bytes], tuple]


def pymupdf_pages(content: bytes) -> tuple[list[list[str] | Exception], bool, dict[str, str]]:
    """Layout blocks by page with PyMuPDF, where that is installed; a page that fails is its exception."""
    import fitz

    pages: list[list[str] | Exception] = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            try:
                pages.append([block[4] for block in page.get_text("blocks")])
            except Exception as e:  # the page is left out, the file goes on
                pages.append(e)
        return pages, bool(doc.is_encrypted), {k: str(v) for k, v in (doc.metadata or {}).items() if v is not None}


def read_pdf(spark: SparkSession, path: str, reader: PageReader = pymupdf_pages) -> DataFrame:
    """Rows (path, page_no, blk_no, text, page_count, encrypted, metadata, error) of the files under `path`.

    A page that can't be read is one row with its error; so is a file, with
    page 0. Blocks keep their order in page_no and blk_no. A file without a
    block is one row of page 0 without text, so each file has a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages, locked, *more = reader(bytes(content))
                except Exception as e:
                    yield pd.DataFrame([[name, 0, 0, None, None, None, None, str(e)]], columns=range(8))
                    continue
                about, rows = more[0] if more else {}, []
                for i, page in enumerate(pages, 1):
                    if isinstance(page, Exception):
                        rows.append([name, i, 0, None, len(pages), locked, about, str(page)])
                    else:
                        rows += [[name, i, k, text, len(pages), locked, about, None] for k, text in enumerate(page)]
                yield pd.DataFrame(rows or [[name, 0, 0, None, len(pages), locked, about, None]], columns=range(8))

    return files.mapInPandas(run, BLOCKS)


def text_lines(docs: DataFrame) -> DataFrame:
    """Layout blocks (doc_id, page_no, blk_no, text) of plain texts: one page, a block for each line."""
    return docs.select("doc_id", F.lit(1).alias("page_no"), F.posexplode(F.split("text", "\n")).alias("blk_no", "text"))


def layout_paragraphs(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flattened, stripped, non-empty layout blocks."""
    return blocks.withColumn("text", flatten_lines(F.col("text"))).where(F.col("text") != "").select(key, "page_no", "blk_no", "text")


def text_parts(docs: DataFrame) -> DataFrame:
    """Paragraph arrays (doc_id, parts) of plain texts, a line a layout block; each row by itself, so nothing is shuffled."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), flatten_lines)
    return docs.select("doc_id", F.filter(lines, lambda p: p != "").alias("parts"))


def paragraph_arrays(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's paragraphs in layout order, as an array; a document is one row's worth of memory.

    Documents without a paragraph have an empty array.
    """
    flat = flatten_lines(F.col("text"))
    each = blocks.select(key, F.when(flat != "", F.struct("page_no", "blk_no", flat.alias("text"))).alias("row"))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.select(key, F.transform("rows", lambda r: r["text"]).alias("parts"))


def document_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document as one text, paragraphs parted by blank lines; empty without a paragraph."""
    return joined_parts(paragraph_arrays(blocks, key), key)


def joined_parts(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    return parts.select(key, F.array_join("parts", "\n\n").alias("text"))


def document_facts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, pages, error) of layout blocks: the error of a file that couldn't be read; columns that `blocks` lacks are null."""
    has = set(blocks.columns)
    pages = F.max("page_count") if "page_count" in has else F.lit(None).cast("int")
    error = F.max(F.when(F.col("page_no") == 0, F.col("error"))) if "error" in has else F.lit(None).cast("string")
    return blocks.groupBy(key).agg(pages.alias("pages"), error.alias("error"))


def page_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages with their unchanged text, numbered from 1."""
    rows = blocks.where("text is not null").groupBy(key, "page_no").agg(F.array_sort(F.collect_list(F.struct("blk_no", "text"))).alias("rows"))
    return rows.select(key, "page_no", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("page_text"))


def pdf_info(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """A row for each file: pages, metadata, size in bytes on disk, whether it is encrypted and a PDF; null where it couldn't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    facts = blocks.groupBy("path").agg(F.max("page_count").alias("page_count"), F.bool_or("encrypted").alias("is_encrypted"), F.any_value("metadata", ignoreNulls=F.lit(True)).alias("metadata"))
    return files.join(facts, "path", "left").select(
        "path", "page_count", "metadata", F.col("length").alias("file_size"), "is_encrypted", F.when(F.col("page_count").isNotNull(), True).alias("is_pdf"))


def file_info(blocks: DataFrame) -> DataFrame:
    """`pdf_info` of rows of the paged source, which carry their file's size: no second listing."""
    facts = blocks.groupBy("path").agg(
        F.max("page_count").alias("page_count"), F.any_value("metadata", ignoreNulls=F.lit(True)).alias("metadata"), F.max("file_size").alias("file_size"), F.bool_or("encrypted").alias("is_encrypted"))
    return facts.withColumn("is_pdf", F.when(F.col("page_count").isNotNull(), True))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files, dealt over all cores if it has fewer partitions than there are: a small table may be one row group.

    Large tables, which have more, stay as they are. For plain scans only: it
    asks for their partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
