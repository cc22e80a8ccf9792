"""Manifest items out of positioned text chunks (doc_id, page, x, y, text, chunk_id).

An item is an anchor at the left margin, a folder label below it and the folder value beside the
label. "Exactly one in this band" is decided with range-frame windows over y, so chunks are never
paired up. Pages are cut into y-bands with a small overlap; a window only sees one band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import case_number, codes, edge_trim, folder_key
from folioscope.operators.spread import positions
from folioscope.session import work_folder

# Layout of the manifest pages.
ANCHOR_TEXT = r"(?iu)^\s*Processo\b"
LABEL_TEXT = r"(?iu)^\s*Pasta\s*:?\s*$"
HEADING_TEXT = r"(?iu)\bRelat[oó]rio\b"
EMPTY_TEXT = r"(?iu)\bNenhum\s+processo\b"
NUMBER_TEXT = r"(?<!\d)(\d{7}[-.]?\d{2}[.]?\d{4}[.]?\d[.]?\d{2}[.]?\d{4})(?!\d)"
FOLDER_TEXT = r"(?U)^[\w./-]{1,80}$"
ANCHOR_X, ANCHOR_DX = 2, 10
LABEL_X, LABEL_DX = 93, 12
LABEL_DY = (48, 65)
VALUE_X = (122, 160)
VALUE_DY = 3

BAND = 256
PAGE_SLICE = 65536


def _band(y: Column) -> Column:
    return F.floor(y / BAND)


def _in_bands(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Copies a row into every band between two heights (at most two here)."""
    return df.withColumn("band", F.explode(F.array_distinct(F.array(_band(low), _band(high)))))


def _is_label() -> Column:
    return (F.abs(F.col("x") - LABEL_X) <= LABEL_DX) & F.col("text").rlike(LABEL_TEXT)


def _is_anchor() -> Column:
    return (F.abs(F.col("x") - ANCHOR_X) <= ANCHOR_DX) & F.col("text").rlike(ANCHOR_TEXT)


def _told_apart(chunks: DataFrame) -> DataFrame:
    """All chunks with what they may be, as anchor, label and value; these have their text, trimmed and not blank.

    They are written to the shared work folder, so however often they are read, they are computed once.
    """
    kinds = {"anchor": _is_anchor(), "label": _is_label(), "value": F.col("x").between(*VALUE_X)}
    visible = F.col("text") != ""
    told = chunks.withColumn("text", edge_trim(F.col("text"))).select(
        "doc_id", "page", "y", "chunk_id", "text", *[F.coalesce(kind & visible, F.lit(False)).alias(name) for name, kind in kinds.items()]
    )
    told = told.withColumn("text", F.when(F.col("anchor") | F.col("label") | F.col("value"), F.col("text")))
    folder = work_folder(chunks.sparkSession, "chunks")
    told.write.parquet(folder)
    return chunks.sparkSession.read.schema(told.schema).parquet(folder)


def _label_values(chunks: DataFrame) -> DataFrame:
    """Labels per (doc, page, y) with their count and, if there is exactly one value, its folder."""
    page = ["doc_id", "page"]
    y = F.col("y")
    labels = chunks.filter("label").groupBy(*page, "y", "text").agg(F.count(F.lit(1)).alias("labels"))
    values = (
        chunks.filter("value")
        .groupBy(*page, "y", "text")
        .agg(F.count(F.lit(1)).alias("values"))
    )
    rows = _in_bands(labels, y, y).withColumn("values", F.lit(0)).unionByName(
        _in_bands(values, y - VALUE_DY, y + VALUE_DY).withColumn("labels", F.lit(0)), allowMissingColumns=True
    )
    near = Window.partitionBy(*page, "band").orderBy("y").rangeBetween(-VALUE_DY, VALUE_DY)
    alike = Window.partitionBy(*page, "band", "text").orderBy("y").rangeBetween(-VALUE_DY, VALUE_DY)
    value_text = F.when(F.col("values") > 0, F.col("text"))
    seen = (
        rows.withColumn("_all", F.sum("values").over(near))
        .withColumn("_low", F.min(value_text).over(near))
        .withColumn("_high", F.max(value_text).over(near))
        .withColumn("_same", F.sum("values").over(alike))
        .filter("labels > 0")
    )
    raw = F.when(F.col("_low") != F.col("text"), F.col("_low")).otherwise(F.col("_high"))
    folder = folder_key(F.when(F.col("_all") - F.col("_same") == 1, raw))
    return (
        seen.withColumn("folder", folder)
        .withColumn("folder", F.when(F.col("folder").rlike(FOLDER_TEXT), F.col("folder")))
        .groupBy(*page, "y")
        .agg(F.sum("labels").alias("labels"), F.min("folder").alias("folder"))
    )


def extract_blocks(chunks: DataFrame) -> DataFrame:
    """Items with ordinal, number, folder, page range and quality flags."""
    page = ["doc_id", "page"]
    y = F.col("y")
    chunks = _told_apart(chunks)
    anchors = chunks.filter("anchor").select(*page, "y", "chunk_id", "text")
    heights = anchors.select(*page, "y").distinct()
    labels = _in_bands(_label_values(chunks), y - LABEL_DY[1], y - LABEL_DY[0])
    rows = _in_bands(heights, y, y).withColumn("anchor", F.lit(True)).unionByName(labels, allowMissingColumns=True)
    below = Window.partitionBy(*page, "band").orderBy("y").rangeBetween(*LABEL_DY)
    folders = (
        rows.withColumn("_labels", F.sum("labels").over(below))
        .withColumn("_folder", F.min("folder").over(below))
        .filter("anchor")
        .select(*page, "y", F.when(F.col("_labels") == 1, F.col("_folder")).alias("folder"))
    )

    number = case_number(F.nullif(F.regexp_extract("text", NUMBER_TEXT, 1), F.lit("")))
    flags = codes(
        F.when(F.col("folder").isNull(), "incomplete_block"),
        F.when(F.col("number").isNull() & F.col("text").rlike(r"\d"), "invalid_identifier"),
        F.when(F.col("number").isNull() & F.col("folder").isNull(), "missing_identifier"),
    )
    items = positions(
        anchors.join(folders, [*page, "y"]).withColumn("number", number).withColumn("quality_flags", flags),
        ["doc_id"],
        "chunk_id",
        "ordinal",
        [("page",), ("y",)],
        id_levels=1,
    )
    is_last = F.struct("y", "chunk_id") == F.col("_last")
    return (
        items.join(_page_ends(chunks, anchors), ["doc_id", "page"])
        .withColumn("page_end", F.when(is_last, F.col("_page_end")).otherwise(F.col("page")))
        .select("doc_id", "ordinal", "number", "folder", F.col("page").alias("page_start"), "page_end", "quality_flags")
    )


def _page_ends(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per anchored page its last anchor and the last page before the next anchored one.

    The next anchored page is looked up inside a slice of pages, then in the next slice that has
    any, so a document with very many pages is not one window.
    """
    pages = anchors.groupBy("doc_id", "page").agg(F.max(F.struct("y", "chunk_id")).alias("_last"))
    sliced = pages.withColumn("_slice", F.floor(F.col("page") / PAGE_SLICE))
    slices = sliced.groupBy("doc_id", "_slice").agg(F.min("page").alias("_first"))
    next_slice = F.lead("_first").over(Window.partitionBy("doc_id").orderBy("_slice"))
    next_page = F.lead("page").over(Window.partitionBy("doc_id", "_slice").orderBy("page"))
    last_page = chunks.groupBy("doc_id").agg(F.max("page").alias("_last_page"))
    return (
        sliced.withColumn("_next", next_page)
        .join(slices.withColumn("_next_slice", next_slice).drop("_first"), ["doc_id", "_slice"])
        .join(last_page, "doc_id")
        .select(
            "doc_id", "page", "_last", F.coalesce(F.coalesce("_next", "_next_slice") - 1, "_last_page").alias("_page_end")
        )
    )


def document_layout(chunks: DataFrame) -> DataFrame:
    """items, zero_processes or LAYOUT_UNKNOWN per document."""
    first_page = F.col("page") == 1
    seen = chunks.withColumn("text", edge_trim(F.col("text"))).groupBy("doc_id").agg(
        F.max("page").alias("pages"),
        F.count_if(_is_anchor()).alias("items"),
        F.count_if(first_page & F.col("text").rlike(HEADING_TEXT)).alias("_headings"),
        F.count_if(first_page & F.col("text").rlike(EMPTY_TEXT)).alias("_empty"),
    )
    layout = (
        F.when(F.col("_headings") == 0, "LAYOUT_UNKNOWN")
        .when(F.col("items") > 0, "items")
        .when(F.col("_empty") > 0, "zero_processes")
        .otherwise("LAYOUT_UNKNOWN")
    )
    return seen.select("doc_id", "pages", "items", layout.alias("layout"))
