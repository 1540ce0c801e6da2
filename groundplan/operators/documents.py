"""Document text: pages, citations and mined features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan.functions.address import POSTCODE
from groundplan.operators.relational import first_per_group
from groundplan.operators.similar import SHORTEST, quote_places

SNIPPET, BASE = 320, {"H": 0.95, "M": 0.7, "L": 0.4}


def pages(text: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, page_no, text) of texts with ``[Page N]`` marks; a page that is marked twice is joined."""
    parts = F.regexp_extract_all(text_col, F.lit(r"(?s)\[Page (\d+)\](.*?)(?=\[Page \d+\]|\z)"), 0)
    cut = text.select(id_col, F.posexplode(parts).alias("at", "part")).select(id_col, "at", F.regexp_extract("part", r"\[Page (\d+)\]", 1).cast("int").alias("page_no"), F.regexp_replace("part", r"^\[Page \d+\]", "").alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "")
    return cut.groupBy(id_col, "page_no").agg(joined.alias("text"))


def marked_text(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One text per document of pages (id, page_no, text, table): each page's mark and text, then its table's rows as ``a | b`` lines.

    Pages without text and rows without cells add nothing.
    """
    lines = F.filter(F.transform("table", lambda row: F.array_join(F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")), lambda line: F.regexp_replace(line, "[ |]", "") != "")
    parts = F.array_append(F.array(F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))), F.nullif(F.array_join(lines, "\n"), F.lit("")))
    body = F.array_join(F.array_compact(parts), "\n")
    page = pages.where(body != "").select(id_col, "page_no", F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("]\n"), body).alias("page"))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "page")))
    return page.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda p: p["page"]), "\n\n").alias("text"))


def layout(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pages) of page texts (id, page_no, text): arrays of pages of words with boxes, on one line of characters a unit wide."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    each = pages.select(id_col, "page_no", F.posexplode(words).alias("at", "word"))
    line = Window.partitionBy(id_col, "page_no").orderBy("at")
    placed = each.withColumn("x1", (F.sum(F.length("word") + 1).over(line) - 1).cast("double"))
    number = lambda v: F.lit(float(v))
    box = F.struct("at", F.struct(F.col("word").alias("text"), (F.col("x1") - F.length("word")).alias("x0"), "x1", number(0).alias("top"), number(1).alias("bottom")).alias("w"))
    by_page = placed.groupBy(id_col, "page_no").agg(F.max("x1").alias("width"), F.array_sort(F.collect_list(box)).alias("boxes"))
    page = F.struct("page_no", "width", number(1).alias("height"), F.transform("boxes", lambda b: b["w"]).alias("words"))
    return by_page.groupBy(id_col).agg(F.array_sort(F.collect_list(page)).alias("pages"))


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def sentence(page: Column, start: Column, size: Column) -> Column:
    """The sentence around a span (start from 0) of a page, cut at SNIPPET characters; null without a span.

    It begins behind the last mark before the span, else 120 characters before it, and
    ends with the first full stop or before the first bar behind it, else 200 characters on.
    """
    before, length = F.substr(page, F.lit(1), start), F.length(page)
    # the last place of a mark is the first one of its reverse in the reversed text
    last = lambda mark: F.when(F.instr(F.reverse(before), mark[::-1]) > 0, F.length(before) - F.instr(F.reverse(before), mark[::-1]) + 2)
    left = F.greatest(*(last(mark) for mark in (". ", "• ", "| ")))
    begin = F.coalesce(left, F.greatest(F.lit(1), start - 119))
    after = F.substr(page, start + size + 1, length)
    first = lambda mark: F.when(F.instr(after, mark) > 0, start + size + F.instr(after, mark))
    end = F.coalesce(F.least(*(first(mark) for mark in (". ", " |"))), start + size + 200)
    found = F.trim(F.substr(page, begin, end - begin + 1))
    return F.when(start >= 0, F.when(F.length(found) <= SNIPPET, found).otherwise(F.concat(F.left(found, F.lit(SNIPPET - 3)), F.lit("..."))))


def verified(citations: DataFrame, page_texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``found_page``, ``snippet``, ``verified`` and ``score`` to citations (id, field, page, quote, confidence).

    The cited page and its neighbours are searched exactly and fuzzily, the others only
    exactly; the fuzzy search sees three pages a citation at most. The best hit is the
    cited page's, then that before, that behind, then the first other page.
    """
    quotes = citations.withColumn("_q", normal(F.col("quote")))
    texts = page_texts.select(F.col(id_col), "page_no", normal(F.col("text")).alias("_p"))
    met = quotes.join(texts, id_col)
    exact = F.instr(F.col("_p"), F.col("_q")) - 1
    near = F.abs(F.col("page_no") - F.col("page")) <= 1
    placed = met.withColumn("_exact", exact).withColumn("_near", F.coalesce(near, F.lit(False)))
    sought = placed.where("_near and _exact < 0").select(F.col("_q").alias("q"), F.col("_p").alias("p"))
    fuzzy = quote_places(sought).select(F.col("q").alias("_q"), F.col("p").alias("_p"), F.col("place").alias("_at"))
    close = placed.where("_near and _exact >= 0").withColumn("_at", F.col("_exact")).unionByName(placed.where("_near and _exact < 0").join(fuzzy, ["_q", "_p"]))
    far = placed.where("not _near and _exact >= 0").withColumn("_at", F.col("_exact"))
    order = F.when(F.col("page_no") == F.col("page"), 0).when(F.col("page_no") == F.col("page") - 1, 1).when(F.col("page_no") == F.col("page") + 1, 2).otherwise(3)
    hits = close.unionByName(far).where("_at >= 0").withColumn("_order", order)
    best = first_per_group(hits, [id_col, "field"], [F.col("_order"), F.col("page_no")]).select(id_col, "field", F.col("page_no").alias("found_page"), sentence(F.col("_p"), F.col("_at"), F.length("_q")).alias("snippet"))
    base = F.when(F.col("confidence") == "H", BASE["H"]).when(F.col("confidence") == "M", BASE["M"]).when(F.col("confidence") == "L", BASE["L"]).otherwise(0.6)
    joined = citations.join(best, [id_col, "field"], "left").withColumn("verified", F.col("found_page").isNotNull())
    return joined.withColumn("score", F.round(F.when(F.col("verified"), F.least(F.lit(1.0), base + 0.05)).otherwise(F.least(base, F.lit(0.3))), 2))


def item_sources(items: DataFrame, page_texts: DataFrame, id_col: str = "doc_id", words: int = 8) -> DataFrame:
    """Items (id, item, page, text) with ``source_verified`` and ``source_page``: their first ``words`` words sought as ``verified`` seeks quotes.

    Items whose opening is shorter than a quote may be get null for both.
    """
    opening = F.array_join(F.slice(F.split(normal(F.col("text")), " "), 1, words), " ")
    asked = items.withColumn("quote", opening).where(F.length("quote") >= SHORTEST)
    found = verified(asked.select(id_col, F.col("item").alias("field"), "page", "quote", F.lit(None).cast("string").alias("confidence")), page_texts, id_col)
    found = found.select(id_col, F.col("field").alias("item"), F.col("verified").alias("source_verified"), F.col("found_page").alias("source_page"))
    return items.join(found, [id_col, "item"], "left")


def mined(text: Column) -> dict[str, Column]:
    """Sorted distinct property numbers, postcodes and dates in a text."""
    find = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 0)))
    return {"uprns": find(r"\b\d{12}\b"), "postcodes": find(rf"\b{POSTCODE}\b"), "dates": find(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b")}


def scanned(first_pages: Column) -> Column:
    """Whether a document's first pages hold too little text to be more than images."""
    return F.length(F.trim(F.coalesce(first_pages, F.lit("")))) < 30
