"""Document structure: headings, sections, passages and table rows."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The page marker of combined texts, and characters of a packed passage.
PAGE_MARKER = "<!-- batch_boundary -->"
#: How the marker may stand in a text: a prefix before the name is left open.
PAGE_MARKER_PATTERN = r"<!-- *(?:\w+:)?batch_boundary *-->"
PASSAGE_BUDGET = 1200


def pages_of(combined: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Numbered pages of a combined text, split at the page marker."""
    parts = F.split(F.col(text_col), PAGE_MARKER_PATTERN)
    return combined.select(id_col, F.posexplode(parts).alias("p", "text")).select(id_col, (F.col("p") + 1).alias("page"), F.trim("text").alias("text"))


_HEADING = re.compile(r"(#{1,6}) +[^ ]")
_HEADING_MARKS = re.compile(r"^#{1,6} +|[ #]+\Z")


def headings(pages: DataFrame) -> DataFrame:
    """(file_id, page, line, depth, title): ATX headings outside fenced code; one pass over the lines of each page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            row, line, depth, title = [], [], [], []
            for r, text in enumerate(pdf["text"]):
                fenced = False
                for i, x in enumerate((text or "").split("\n"), 1):
                    if x.startswith(("```", "~~~")):
                        fenced = not fenced
                    elif not fenced and x.startswith("#") and (found := _HEADING.match(x)):
                        row.append(r)
                        line.append(i)
                        depth.append(len(found[1]))
                        title.append(_HEADING_MARKS.sub("", x).strip(" "))
            found = pd.DataFrame({"line": pd.Series(line, dtype="int32"), "depth": pd.Series(depth, dtype="int32"), "title": pd.Series(title, dtype="object")})
            yield pd.concat([pdf[["file_id", "page"]].iloc[row].reset_index(drop=True), found], axis=1)

    types = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("file_id", "page")]
    return pages.select("file_id", "page", "text").mapInPandas(run, ", ".join([*types, "line int, depth int, title string"]))


def markdown_blocks(pages: DataFrame) -> DataFrame:
    """(file_id, page, pos, kind, text): paragraphs between blank lines, ATX headings of their own; image placeholders go."""
    parted = F.regexp_replace("text", r"(?md)^(#{1,6} +.*)$", "\n\n$1\n\n")
    pieces = F.filter(F.transform(F.split(parted, r"\n[ \t]*\n+"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~x.rlike(r"^(!\[[^\]]*\]\([^)]*\)|<img[^>]*>|<!--.*-->)$"))
    rows = pages.select("file_id", "page", F.posexplode(pieces).alias("pos", "text"))
    kind = F.when(F.col("text").rlike(r"^#{1,6} +[^ ]"), "heading").otherwise("paragraph")
    return rows.select("file_id", "page", "pos", kind.alias("kind"), F.trim(F.regexp_replace("text", r"^#{1,6} +", "")).alias("text"))


def sections(heads: DataFrame, last_pages: DataFrame) -> DataFrame:
    """(file_id, section_id, title, depth, page_start, page_end, parent) from headings in order.

    A section ends on the page before the next heading of its depth or less, on its own page if that
    heading stands there, or on the file's last page. Headings are a small part of a file; one file's
    headings are read together.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for f, last, heads in zip(pdf["file_id"], pdf["last_page"], pdf["heads"], strict=True):
                end, parent, open_ = [None] * len(heads), [None] * len(heads), []
                for i, h in enumerate(heads):
                    while open_ and heads[open_[-1]]["depth"] >= h["depth"]:
                        j = open_.pop()
                        end[j] = max(heads[j]["page"], h["page"] - 1)
                    parent[i] = f"{f}:sec_{open_[-1] + 1:03d}" if open_ else None
                    open_.append(i)
                for i, h in enumerate(heads):
                    rows.append((f, f"{f}:sec_{i + 1:03d}", i + 1, h["title"], h["depth"], h["page"], max(h["page"], last) if end[i] is None else end[i], parent[i]))
            yield pd.DataFrame(rows, columns=["file_id", "section_id", "ord", "title", "depth", "page_start", "page_end", "parent"])

    listed = heads.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", "line", "depth", "title"))).alias("heads"))
    joined = listed.join(last_pages.select("file_id", "last_page"), "file_id")
    return joined.mapInPandas(run, "file_id string, section_id string, ord int, title string, depth int, page_start long, page_end long, parent string")


def section_of_pages(pages: DataFrame, secs: DataFrame, deepest: bool = True, step: int = 64) -> DataFrame:
    """(file_id, page, section_id): the deepest, or the first, section that holds a page; null if none.

    Spans are dealt to blocks of pages, so that the range join is an equi-join on file and block.
    """
    s = secs.select("file_id", "section_id", "ord", "depth", "page_start", "page_end")
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("page_start") / step), F.floor(F.col("page_end") / step))))
    p = pages.select("file_id", "page").distinct().withColumn("_b", F.floor(F.col("page") / step))
    j = p.join(s, ["file_id", "_b"], "left").withColumn("_in", F.col("page").between(F.col("page_start"), F.col("page_end")))
    pick = F.when(F.col("_in"), F.struct(F.when(F.lit(deepest), -F.col("depth")).otherwise(F.lit(0)).alias("a"), F.col("ord").alias("b"), F.col("section_id").alias("id")))
    return j.groupBy("file_id", "page").agg(F.min(pick)["id"].alias("section_id"))


def exclusive_sections(secs: DataFrame) -> DataFrame:
    """Sections whose pages no other section holds."""
    e = secs.select("file_id", "section_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    n = e.groupBy("file_id", "page").agg(F.count("*").alias("n"))
    return e.join(n, ["file_id", "page"]).groupBy("file_id", "section_id").agg(F.bool_and(F.col("n") == 1).alias("exclusive"))


def content_blocks(pages: DataFrame) -> DataFrame:
    """(file_id, page_id, passage_id, text) of layout blocks that bear content, numbered in block order.

    A block's place is its id, else its order, else its position.
    """
    b = pages.select("file_id", "page_id", F.posexplode("layout_blocks").alias("pos", "b"))
    b = b.filter(F.lower("b.block_label").isin("text", "paragraph_title") & (F.length(F.trim("b.block_content")) > 0))
    place = F.coalesce("b.block_id", "b.block_order", "pos")
    w = Window.partitionBy("file_id", "page_id").orderBy(place, "pos")
    n = F.row_number().over(w)
    return b.select("file_id", "page_id", F.format_string("%s/%s:p_%04d", "file_id", "page_id", n).alias("passage_id"), F.col("b.block_content").alias("text"))


def budget_split(sentences: Column, budget: int = PASSAGE_BUDGET) -> Column:
    """Sentences packed from the left into passages of at most budget characters; longer ones are cut."""
    cut = F.flatten(
        F.transform(sentences, lambda s: F.when(F.length(s) <= budget, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.length(s), F.lit(budget)), lambda i: F.substring(s, i, F.lit(budget)))))
    )

    def pack(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= budget)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last, s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(cut, F.array().cast("array<string>"), pack)


_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S)
_CELL = re.compile(r"<(t[hd])\b[^>]*>(.*?)</\1>", re.I | re.S)
_TAG = re.compile(r"<[^>]+>")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def html_rows(blob: str) -> list[tuple[str, bool]]:
    """(text, header) of each row; a row is a header if all its cells are."""
    out = []
    for row in _ROW.findall(blob):
        cells = _CELL.findall(row)
        text = " ".join(" ".join(html.unescape(_TAG.sub(" ", c)).split()) for _, c in cells)
        if cells:
            out.append((text, all(k.lower() == "th" for k, _ in cells)))
    return out


def markdown_rows(blob: str) -> list[tuple[str, bool]]:
    """(text, header) of pipe rows; a header needs a rule below it; code fences are skipped."""
    lines, out, fenced = blob.split("\n"), [], False
    for i, line in enumerate(lines):
        if re.match(r"^\s*(```|~~~)", line):
            fenced = not fenced
            continue
        if fenced or "|" not in line or _RULE.match(line):
            continue
        cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]
        out.append((" ".join(cells), i + 1 < len(lines) and bool(_RULE.match(lines[i + 1])) and "|" in lines[i + 1]))
    return out


def table_rows(blobs: DataFrame) -> DataFrame:
    """(file_id, page_id, table_row_id, text, is_header_row): rows of HTML and pipe tables (file_id, page_id, blob).

    A table begins at a header row or the page's first row; rows are numbered within it.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for f, p, blob in zip(pdf["file_id"], pdf["page_id"], pdf["blob"], strict=True):
                blob = blob or ""
                found = html_rows(blob) if re.search(r"<(table|tr)\b", blob, re.I) else markdown_rows(blob) if "|" in blob else []
                t, r = 0, 0
                for i, (text, head) in enumerate(found):
                    t, r = (t + 1, 1) if head or i == 0 else (t, r + 1)
                    rows.append((f, p, f"{f}/{p}:t_{t:02d}:r_{r:02d}", text, head))
            yield pd.DataFrame(rows, columns=["file_id", "page_id", "table_row_id", "text", "is_header_row"])

    return blobs.select("file_id", "page_id", "blob").mapInPandas(run, "file_id string, page_id string, table_row_id string, text string, is_header_row boolean")


def citation_numbers(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, number): labels [^k] of a text, numbered in the order they first appear. Array work in one row."""
    labels = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"\[\^([0-9A-Za-z_-]+)\]"), F.lit(1)))
    return messages.select(id_col, F.posexplode(labels).alias("p", "label")).select(id_col, "label", (F.col("p") + 1).alias("number"))


def source_legend(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, url): lines after a Sources heading until the next heading; the first of each number."""
    section = F.regexp_extract(F.col(text_col), r"(?ims)^#+ *sources *$(.*?)(?=^#|\z)", 1)
    lines = messages.select(id_col, F.posexplode(F.split(section, "\n")).alias("pos", "line"))
    number = F.regexp_extract("line", r"^\s*\[?\^?([0-9]+)\]?[.:)]?\s", 1)
    url = F.regexp_replace(F.regexp_extract("line", r"(https?://\S+)", 1), r"[.,;)]+$", "")
    rows = lines.select(id_col, "pos", number.try_cast("int").alias("number"), url.alias("url")).filter("number IS NOT NULL AND url <> ''")
    return rows.groupBy(id_col, "number").agg(F.min_by("url", "pos").alias("url"))
