"""Tokens of documents: words with their place on a page, from text lines, structured pages, or the nested blocks of a recogniser.

TOKEN is the row type that the extraction operators read; a document's tokens are numbered by ord in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.rates import finite
from tidewright.functions.text import strip

TOKEN = "text string, x double, y double, width double, height double, confidence double, page int"
#: What a line of plain text gets as its place and confidence.
LINE_STEP, LINE_HEIGHT, LINE_CONFIDENCE, LETTER_WIDTH, LEAST_WIDTH = 18.0, 14.0, 0.96, 7, 40
NATIVE_CONFIDENCE, LEAST_HEIGHT, UNKNOWN_CONFIDENCE = 0.99, 8.0, 0.92

_BOX = "bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double"
_WORD = f"text string, {_BOX}, symbols array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>"


def of_lines(text: Column) -> Column:
    """Array of tokens: one for each line of a text that isn't empty, 18 units apart."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\r\\n]+"), lambda s: s != "")
    return F.transform(
        lines,
        lambda s, i: F.struct(
            s.alias("text"),
            F.lit(0.0).alias("x"),
            (i * LINE_STEP).alias("y"),
            F.greatest(F.lit(LEAST_WIDTH), F.length(s) * LETTER_WIDTH).cast("double").alias("width"),
            F.lit(LINE_HEIGHT).alias("height"),
            F.lit(LINE_CONFIDENCE).alias("confidence"),
            F.lit(1).alias("page"),
        ),
    )


def normalized(token: Column, page: Column) -> Column:
    """A token with all numbers: places from its box where it has none itself, confidence from 0 to 1 (above 1: hundredths)."""
    box = token["bbox"]
    known = lambda v: F.when(finite(v), v)
    nonzero = lambda v: F.when(finite(v) & (v != 0), v)
    x = F.coalesce(known(token["x"]), nonzero(box["x0"]), F.lit(0.0))
    y = F.coalesce(known(token["y"]), nonzero(box["y0"]), F.lit(0.0))
    width = F.coalesce(known(token["width"]), F.greatest(F.lit(0.0), F.coalesce(nonzero(box["x1"]), x) - x))
    height = F.coalesce(known(token["height"]), F.greatest(F.lit(LEAST_HEIGHT), F.coalesce(nonzero(box["y1"]), y + 12) - y))
    c = token["confidence"]
    confidence = F.when(finite(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c)))).otherwise(F.lit(UNKNOWN_CONFIDENCE))
    return F.struct(strip(token["text"]).alias("text"), x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"), confidence.alias("confidence"), F.coalesce(page, F.lit(1)).cast("int").alias("page"))


def of_pdf_items(items: Column, page: Column) -> Column:
    """Tokens of a PDF page's text items (text, transform of six numbers, width, height); blank items go."""
    kept = F.filter(items, lambda t: strip(F.coalesce(t["text"], F.lit(""))) != "")
    return F.transform(
        kept,
        lambda t: F.struct(
            strip(t["text"]).alias("text"),
            t["transform"][4].alias("x"),
            t["transform"][5].alias("y"),
            F.coalesce(t["width"], F.lit(0.0)).alias("width"),
            F.greatest(F.lit(LEAST_HEIGHT), F.abs(F.coalesce(t["height"], F.lit(0.0)))).alias("height"),
            F.lit(NATIVE_CONFIDENCE).alias("confidence"),
            page.cast("int").alias("page"),
        ),
    )


def words_of_blocks(blocks: Column) -> Column:
    """The words of a recogniser's blocks (paragraphs, lines, words, symbols), in order; a word's symbols follow it as words of their own."""
    place = lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), w["confidence"].alias("confidence"))
    usable = lambda w: w["text"].isNotNull() & w["bbox"].isNotNull()
    with_symbols = lambda w: F.concat(F.filter(F.array(place(w)), usable), F.filter(F.transform(F.coalesce(w["symbols"], F.array()), place), usable))
    words = F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(b["paragraphs"], lambda p: F.flatten(F.transform(p["lines"], lambda line: line["words"]))))))
    return F.flatten(F.transform(words, with_symbols))


def of_document(docs: DataFrame) -> DataFrame:
    """doc_id, ord, TOKEN of documents (doc_id, text, and pages: array of page_number, tokens, blocks).

    A page's tokens count; without any, the words of its blocks. Only a document that has none at all is read as lines of text, so
    that no number appears twice.
    """
    missing = F.lit(None).cast("double")

    def of_page(p: Column) -> Column:
        page = F.coalesce(p["page_number"], F.lit(1))
        own = F.transform(F.filter(F.coalesce(p["tokens"], F.array()), lambda t: strip(F.coalesce(t["text"], F.lit(""))) != ""), lambda t: normalized(t, page))
        boxed = lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), w["confidence"].alias("confidence"), missing.alias("x"), missing.alias("y"), missing.alias("width"), missing.alias("height"))
        words = F.filter(words_of_blocks(p["blocks"]), lambda w: strip(w["text"]) != "")
        return F.when(F.size(F.coalesce(p["tokens"], F.array())) > 0, own).otherwise(F.coalesce(F.transform(words, lambda w: normalized(boxed(w), page)), F.slice(own, 1, 0)))

    found = F.flatten(F.transform(F.col("pages"), of_page)) if "pages" in docs.columns else None
    chosen = of_lines(F.col("text")) if found is None else F.when(F.size(found) > 0, found).otherwise(of_lines(F.col("text")))
    return docs.select("doc_id", F.posexplode(chosen).alias("ord", "t")).select("doc_id", "ord", "t.*")
