"""Queries over document structure: headings, sections, blocks, tables, citations and layout.

The given texts have no markup of their own, so each query derives it from them by line or row number, the same way in
Spark and in SQL, over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import folding
from folioscope.functions import text as X
from folioscope.operators import corpus, evidence, structure
from folioscope.operators.graph import written
from folioscope.plans.base import MENTIONS, Registry, mentions, table
from folioscope.sources import readers

R = Registry()
#: Lines of a page where a document is read as a file of pages.
PAGE_LINES = 6


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lines: every fifth line a heading, others deeper headings, blank lines or code fences."""

    def mark(x, i):
        x = F.translate(x, "#`~<!|", "")
        return (
            F.when((i % 11 == 6) | (i % 11 == 8), "```")
            .when(i % 5 == 0, F.concat(F.lit("# "), x))
            .when(i % 5 == 2, F.concat(F.lit("### "), x, F.lit(" ##")))
            .when(i % 5 == 3, "")
            .otherwise(x)
        )

    return table(spark, sf_dir, "documents").select("doc_id", "source", F.transform(F.split("text", "\n"), mark).alias("lines"))


MARKED = r"""
md AS (SELECT doc_id, source, list_transform(list_transform(string_split(text, chr(10)), lambda x: translate(x, '#`~<!|', '')), lambda x, i:
  CASE WHEN (i - 1) % 11 IN (6, 8) THEN '```' WHEN (i - 1) % 5 = 0 THEN '# ' || x WHEN (i - 1) % 5 = 2 THEN '### ' || x || ' ##' WHEN (i - 1) % 5 = 3 THEN '' ELSE x END) AS lines FROM documents),
ml AS (SELECT source, doc_id, i, lines[i + 1] AS t FROM (SELECT source, doc_id, lines, unnest(range(0, len(lines))) AS i FROM md)),
fenced AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ml),
heads AS (SELECT source, doc_id, CAST(i + 1 AS INTEGER) AS line, CAST(length(regexp_extract(t, '^(#{1,6}) ', 1)) AS INTEGER) AS depth,
  trim(regexp_replace(t, '^#{1,6} +|[ #]+$', '', 'g')) AS title FROM fenced WHERE k % 2 = 0 AND regexp_matches(t, '^#{1,6} +[^ ]'))
"""


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select(F.col("source").alias("file_id"), F.col("doc_id").alias("page"), F.array_join("lines", "\n").alias("text"))


@R.add("WITH " + MARKED + "SELECT source AS file_id, doc_id AS page, line, depth, title FROM heads")
def heading_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings outside code, with depth and title."""
    return structure.headings(marked_pages(spark, sf_dir))


@R.add("WITH " + MARKED + "SELECT source AS file_id, count(*) AS n_headings, max(depth) AS deepest, count(DISTINCT doc_id) AS pages FROM heads GROUP BY 1")
def headings_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each file."""
    h = structure.headings(marked_pages(spark, sf_dir))
    return h.groupBy("file_id").agg(F.count("*").alias("n_headings"), F.max("depth").alias("deepest"), F.count_distinct("page").alias("pages"))


@R.add(
    "WITH "
    + MARKED
    + r""", t AS (SELECT source, doc_id, regexp_replace(array_to_string(lines, chr(10)), '(?m)^(#{1,6} +.*)$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g') AS t FROM md),
p AS (SELECT source, doc_id, list_filter(list_transform(string_split_regex(t, '\n[ \t]*\n+'), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM t),
u AS (SELECT source, doc_id, i, p[i + 1] AS t FROM (SELECT source, doc_id, p, unnest(range(0, len(p))) AS i FROM p))
SELECT source AS file_id, doc_id AS page, CAST(i AS INTEGER) AS pos, CASE WHEN regexp_matches(t, '^#{1,6} +[^ ]') THEN 'heading' ELSE 'paragraph' END AS kind, md5(trim(regexp_replace(t, '^#{1,6} +', ''))) AS text FROM u"""
)
def markdown_block_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of markdown pages; texts as digests."""
    return structure.markdown_blocks(marked_pages(spark, sf_dir)).withColumn("text", F.md5("text"))


def section_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages (file_id, page) and sections of documents read as files of PAGE_LINES lines a page."""
    m = marked(spark, sf_dir)
    file_id = F.concat(F.lit("d"), F.col("doc_id"))
    h = structure.headings(m.select(F.col("source").alias("file_id"), F.col("doc_id").alias("page"), F.array_join("lines", "\n").alias("text")))
    h = h.select(F.concat(F.lit("d"), "page").alias("file_id"), (F.floor(F.col("line") / PAGE_LINES) + 1).alias("page"), "line", "depth", "title")
    n_lines = F.size(F.split("text", "\n"))  # marking keeps the lines
    last = table(spark, sf_dir, "documents").select(file_id.alias("file_id"), (F.floor(n_lines / PAGE_LINES) + 1).alias("last_page"))
    pages = last.select("file_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "last_page")).alias("page"))
    return pages, structure.sections(h, last)


SECTIONS = (
    MARKED
    + f""", lastp AS (SELECT 'd' || doc_id AS file_id, len(lines) // {PAGE_LINES} + 1 AS last_page FROM md),
o AS (SELECT 'd' || doc_id AS file_id, line // {PAGE_LINES} + 1 AS page, line, depth, title, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS ord FROM heads),
nx AS (SELECT a.file_id, a.ord, min(b.ord) AS nxt FROM o a JOIN o b ON a.file_id = b.file_id AND b.ord > a.ord AND b.depth <= a.depth GROUP BY ALL),
pr AS (SELECT a.file_id, a.ord, max(b.ord) AS par FROM o a JOIN o b ON a.file_id = b.file_id AND b.ord < a.ord AND b.depth < a.depth GROUP BY ALL),
sec AS (SELECT o.file_id, format('{{}}:sec_{{:03d}}', o.file_id, o.ord) AS section_id, CAST(o.ord AS INTEGER) AS ord, o.title, o.depth, o.page AS page_start,
  CASE WHEN n.page IS NULL THEN greatest(o.page, last_page) WHEN n.page > o.page THEN greatest(o.page, n.page - 1) ELSE o.page END AS page_end,
  CASE WHEN par IS NOT NULL THEN format('{{}}:sec_{{:03d}}', o.file_id, par) END AS parent
  FROM o JOIN lastp USING (file_id) LEFT JOIN nx ON nx.file_id = o.file_id AND nx.ord = o.ord LEFT JOIN o n ON n.file_id = o.file_id AND n.ord = nx.nxt
  LEFT JOIN pr ON pr.file_id = o.file_id AND pr.ord = o.ord)
"""
)


@R.add("WITH " + SECTIONS + "SELECT * FROM sec")
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with page spans and parents."""
    return section_rows(spark, sf_dir)[1]


@R.add(
    "WITH "
    + SECTIONS
    + """, pg AS (SELECT file_id, unnest(range(1, last_page + 1)) AS page FROM lastp),
j AS (SELECT pg.file_id, pg.page, s.* EXCLUDE (file_id) FROM pg LEFT JOIN sec s ON s.file_id = pg.file_id AND pg.page BETWEEN s.page_start AND s.page_end)
SELECT file_id, page, arg_min(section_id, (-depth, ord)) AS deepest, arg_min(section_id, ord) AS first FROM j GROUP BY ALL"""
)
def section_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest and the first section that holds each page."""
    pages, secs = section_rows(spark, sf_dir)
    secs = written(secs, "sections")
    deepest = structure.section_of_pages(pages, secs).withColumnRenamed("section_id", "deepest")
    first = structure.section_of_pages(pages, secs, deepest=False).withColumnRenamed("section_id", "first")
    return deepest.join(first, ["file_id", "page"])


@R.add(
    "WITH "
    + SECTIONS
    + """, e AS (SELECT file_id, section_id, unnest(range(page_start, page_end + 1)) AS page FROM sec), n AS (SELECT file_id, page, count(*) AS n FROM e GROUP BY ALL)
SELECT file_id, section_id, bool_and(n = 1) AS exclusive FROM e JOIN n USING (file_id, page) GROUP BY ALL"""
)
def exclusive_section_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a section has its pages for itself."""
    return structure.exclusive_sections(written(section_rows(spark, sf_dir)[1], "sections"))


def order_lines(spark: SparkSession, sf_dir: str, row) -> DataFrame:
    """Orders with their lines in order, each made a text by row."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(items, row), "").alias("rows"))


ROWS_SQL = """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS page_id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey) AS r, l_partkey || ' ' || l_returnflag || ' & ' || l_linestatus AS text FROM lineitem)
SELECT 'orders' AS file_id, page_id, format('orders/{}:t_01:r_{:02d}', page_id, r + 1) AS table_row_id, text, false AS is_header_row FROM l
UNION ALL SELECT DISTINCT 'orders', page_id, format('orders/{}:t_01:r_01', page_id), 'Part Flags', true FROM l"""


def blobs(rows: DataFrame, head: str, tail: str) -> DataFrame:
    return rows.select(F.lit("orders").alias("file_id"), F.col("l_orderkey").cast("string").alias("page_id"), F.concat(F.lit(head), "rows", F.lit(tail)).alias("blob"))


@R.add(ROWS_SQL)
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an HTML table for each order."""
    made = order_lines(spark, sf_dir, lambda x: F.concat(F.lit("<TR><td> "), x["l_partkey"], F.lit("</td>\n<td><b>"), x["l_returnflag"], F.lit("</b> &amp; "), x["l_linestatus"], F.lit("</td></TR>")))
    return structure.table_rows(blobs(made, "<table class='x'><tr><th>Part</th><th>Flags</th></tr>", "</table>"))


@R.add(ROWS_SQL)
def pipe_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a pipe table for each order; rows in a code fence are none."""
    made = order_lines(spark, sf_dir, lambda x: F.concat(F.lit("| "), x["l_partkey"], F.lit(" | "), x["l_returnflag"], F.lit(" & "), x["l_linestatus"], F.lit(" |\n")))
    return structure.table_rows(blobs(made, "```\n| no | row |\n```\n| Part | Flags |\n|:---|---:|\n", "\n"))


@R.add("SELECT CAST(l_orderkey AS VARCHAR) AS page_id, count(*) + 1 AS n_rows, min(l_partkey || ' ' || l_returnflag || ' & ' || l_linestatus) AS first_text FROM lineitem GROUP BY 1")
def table_row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows that both formats give, once each, by page."""
    both = html_table_rows(spark, sf_dir).unionByName(pipe_table_rows(spark, sf_dir)).dropDuplicates(["table_row_id", "text"])
    return both.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.min(F.when(~F.col("is_header_row"), F.col("text"))).alias("first_text"))


@R.add(
    """WITH u AS (SELECT conv_id, turn, i, ls[i] AS label FROM (SELECT conv_id, turn, unnest(range(1, 5)) AS i, [role, CAST(conv_id % 7 AS VARCHAR), 'u' || turn % 3, role] AS ls FROM conversations WHERE text IS NOT NULL)),
f AS (SELECT conv_id, turn, label, min(i) AS i FROM u GROUP BY ALL)
SELECT conv_id || '/' || turn AS id, label, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS INTEGER) AS number FROM f"""
)
def citation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cited in a message, numbered as they first appear."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.lit(" [^"), "role", F.lit("] and [^"), F.col("conv_id") % 7, F.lit("], [^u"), F.col("turn") % 3, F.lit("] [^"), "role", F.lit("]"))
    return structure.citation_numbers(c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), text.alias("text")), "id", "text")


def legends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, number, url) of legends that name a page's address and one made of its id."""
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("Answer.\n## Sources\n[1] see "), "url", F.lit(".\n[2]. https://example.org/"), "page_id", F.lit(");\n[1] https://again.example/\nno number https://x.example/\n# End\n[3] https://late.example/\n"))
    return structure.source_legend(p.select("page_id", text.alias("text")), "page_id", "text")


LEGENDS = """leg AS (SELECT page_id, CAST(1 AS INTEGER) AS number, regexp_replace(url, '[.,;)]+$', '') AS url FROM pages WHERE url IS NOT NULL
UNION ALL SELECT page_id, 2, 'https://example.org/' || page_id FROM pages WHERE url IS NOT NULL)"""


@R.add("WITH " + LEGENDS + " SELECT * FROM leg")
def legend_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered addresses below a heading of sources; the first of each number."""
    return legends(spark, sf_dir)


def source_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("Title "), "page_id"))
    to = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://target.example/"), F.col("page_id") % 3))
    return p.select("url", to.alias("redirect"), F.col("page_id").alias("seq"), title.alias("title"), F.substring("html", 1, 20).alias("snippet"))


POOL = """pool AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'https://target.example/' || page_id % 3 ELSE url END AS url, page_id AS seq,
CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Title ' || page_id END AS title, substr(html, 1, 20) AS snippet FROM pages),
merged AS (SELECT url, arg_min(title, seq) FILTER (length(title) > 0) AS title, arg_min(snippet, seq) FILTER (length(snippet) > 0) AS snippet, min(seq) AS seq FROM pool GROUP BY 1)"""


@R.add("WITH " + POOL + " SELECT * FROM merged")
def source_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources merged by where they lead, with the first filled title and snippet."""
    return evidence.merge_sources(source_pool(spark, sf_dir))


@R.add("WITH " + LEGENDS + ", " + POOL + " SELECT number, url, coalesce(title, url) AS title FROM leg LEFT JOIN (SELECT url, title FROM merged) USING (url)")
def legend_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legends with the titles of merged sources."""
    return evidence.numbered_legend(legends(spark, sf_dir), evidence.merge_sources(source_pool(spark, sf_dir)))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of layout blocks, one a line, whose labels, ids and orders follow from the line's number."""

    def block(x, i):
        label = F.element_at(F.array(*[F.lit(v) for v in ("text", "Paragraph_Title", "table", "image", "formula")]), i % 5 + 1)
        return F.struct(label.alias("block_label"), x.alias("block_content"), F.when(i % 3 > 0, 100 - i).alias("block_id"), F.when(i % 2 > 0, i * 2).alias("block_order"))

    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("file_id"), F.col("doc_id").cast("string").alias("page_id"), F.transform(F.split("text", "\n"), block).alias("layout_blocks"))


LAYOUT = """b AS (SELECT source AS file_id, CAST(doc_id AS VARCHAR) AS page_id, i, ['text', 'Paragraph_Title', 'table', 'image', 'formula'][i % 5 + 1] AS label, ls[i + 1] AS t
FROM (SELECT source, doc_id, ls, unnest(range(0, len(ls))) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@R.add(
    "WITH "
    + LAYOUT
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_id ORDER BY CASE WHEN i % 3 > 0 THEN 100 - i WHEN i % 2 > 0 THEN i * 2 ELSE i END, i) AS r FROM b WHERE i % 5 < 2 AND length(trim(t)) > 0)
SELECT file_id, page_id, format('{}/{}:p_{:04d}', file_id, page_id, r) AS passage_id, md5(t) AS text FROM n"""
)
def content_block_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that bear content, numbered in block order."""
    return structure.content_blocks(layout(spark, sf_dir)).withColumn("text", F.md5("text"))


@R.add(
    "WITH "
    + LAYOUT
    + """, s AS (SELECT file_id, page_id, max(i) AS m FROM b GROUP BY ALL)
SELECT page_id, m >= 2 AS has_table, m >= 3 AS has_figure, m >= 4 AS has_formula, m + 1 >= 12 AS dense, CASE WHEN m >= 2 THEN 'text_with_img' ELSE 'text' END AS mode FROM s"""
)
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual signals of pages and the mode that follows."""
    p = layout(spark, sf_dir).withColumn("quality_flags", readers.block_flags(F.col("layout_blocks")))
    q = lambda name, alias: F.col("quality_flags")[name].alias(alias)
    return p.select("page_id", q("has_table", "has_table"), q("has_figure", "has_figure"), q("has_formula", "has_formula"), q("dense_layout", "dense"), readers.page_mode().alias("mode"))


RAW = "WITH " + MENTIONS + ", s AS (SELECT surface, (length(surface) + 3 * instr(surface, 'e')) % 8 AS k FROM (SELECT DISTINCT surface FROM men)), "


def _capitals(name: str):
    return F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def raw_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct surfaces dressed up as extraction leaves them: tags, entities, articles, amounts, brackets, lists."""
    s = mentions(spark, sf_dir).select("surface").distinct()
    s = s.withColumn("k", (F.length("surface") + 3 * F.instr("surface", "e")) % 8)
    n = F.col("surface")
    made = [n, F.concat(F.lit("<b>The "), _capitals("surface"), F.lit("</b>, ")), F.concat(F.lit("usd"), F.length("surface")), F.concat("surface", F.lit(" &amp; Co. (")), F.concat("surface", F.lit("（甲）或"), "surface", F.lit("（乙）"))]
    made += [F.concat("surface", F.lit("，"), _capitals("surface"), F.lit("、x")), F.concat(F.lit("ＡＢ "), "surface", F.lit("$x^{2}$!")), F.repeat(F.lit("保"), (14 + F.length("surface") % 4).cast("int"))]
    out = F.element_at(F.array(*made), (F.col("k") + 1).cast("int"))
    return s.select("surface", "k", out.alias("raw"))


RAW_SQL = (
    RAW
    + """r AS (SELECT surface, k, CASE k WHEN 0 THEN surface WHEN 1 THEN '<b>The ' || translate(surface, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '</b>, ' WHEN 2 THEN 'usd' || length(surface) WHEN 3 THEN surface || ' &amp; Co. ('
WHEN 4 THEN surface || '（甲）或' || surface || '（乙）' WHEN 5 THEN surface || '，' || translate(surface, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '、x' WHEN 6 THEN 'ＡＢ ' || surface || '$x^{2}$!' ELSE repeat('保', CAST(14 + length(surface) % 4 AS INTEGER)) END AS raw FROM s)
"""
)


@R.add(
    RAW_SQL
    + """SELECT raw, CASE k WHEN 0 THEN surface WHEN 1 THEN surface WHEN 3 THEN surface || ' & co' WHEN 4 THEN surface || '(甲)或' || surface || '(乙)'
WHEN 5 THEN surface || ',' || surface || '、x' WHEN 6 THEN 'ab ' || surface WHEN 7 THEN CASE WHEN length(raw) <= 15 THEN raw END END AS key FROM r"""
)
def surface_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, canonical keys of surfaces as extraction leaves them; null where they are junk."""
    return raw_surfaces(spark, sf_dir).select("raw", X.surface_key(F.col("raw")).alias("key"))


#: How a surface is damaged, in turn: what is replaced, and by what.
DAMAGES = [
    [("é", "e\u0301"), ("ñ", "n\u0303")],
    [("é", "&eacute;"), ("ü", "&#252;"), ("ó", "&#xF3;")],
    [("é", "Ã©"), ("ñ", "Ã±"), ("ü", "Ã¼"), ("è", "Ã¨")],
    [("ffi", "ﬃ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ij", "ĳ")],
    [("a", "ａ"), ("e", "ｅ"), ("n", "ｎ")],
]


def _damaged_sql(column: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


@R.add(
    "WITH " + MENTIONS + ", s AS (SELECT DISTINCT surface FROM men), d AS (" + " UNION ALL ".join(f"SELECT surface, {_damaged_sql('surface', pairs)} AS raw FROM s" for pairs in DAMAGES) + ") SELECT DISTINCT raw, surface AS key FROM d"
)
def folded_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces as bad extraction leaves them (marks apart, entities, misread bytes, ligatures, wide letters), and their keys."""
    s = mentions(spark, sf_dir).select("surface").distinct()
    made = []
    for pairs in DAMAGES:
        raw = F.col("surface")
        for old, new in pairs:
            raw = F.replace(raw, F.lit(old), F.lit(new))
        made.append(raw)
    return s.select(F.explode(F.array(*made)).alias("raw")).distinct().select("raw", X.surface_key(F.col("raw"), folding.han_pairs(spark)).alias("key"))


@R.add(
    RAW_SQL
    + """SELECT raw, k IN (3, 4, 5) AS composite, CAST(CASE k WHEN 5 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS n_parts, k = 3 OR length(raw) > 40 AND k <> 4 AS misbound,
round(CAST(-0.05 * length(raw) - CASE k WHEN 3 THEN 7 WHEN 1 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 0 END AS DOUBLE), 6) AS quality FROM r"""
)
def surface_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a surface is a list or runs over its bounds, the parts of its list and its quality as a name."""
    r = F.col("raw")
    return raw_surfaces(spark, sf_dir).select("raw", X.is_composite(r).alias("composite"), F.size(X.catalogue_parts(r)).alias("n_parts"), X.is_misbound(r).alias("misbound"), F.round(X.surface_quality(r), 6).alias("quality"))


@R.add(
    r"""WITH d AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), lambda x: 'w:' || x)) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(t) AS INTEGER) + 2 AS n, md5(array_to_string(list_sort(list_concat(t, ['h:保险', 'h:险法'])), ' ')) AS digest FROM d"""
)
def surface_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words and pairs of Han characters; each text ends with three Han characters."""
    t = X.surface_tokens(F.concat("text", F.lit(" 保险法")))
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@R.add(
    r"""WITH u AS (SELECT doc_id, i, lower(s[i]) AS x FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}') AS s FROM documents))),
f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY ALL)
SELECT d.doc_id, CAST(count(x) AS INTEGER) AS n, md5(coalesce(string_agg(x, ' ' ORDER BY i), '')) AS digest FROM documents d LEFT JOIN f USING (doc_id) WHERE text IS NOT NULL GROUP BY 1"""
)
def unique_surface_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised surfaces of a document, each once, as they first appear."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    d = d.select("doc_id", F.regexp_extract_all("text", F.lit(X.SURFACE_PATTERN), F.lit(0)).alias("found"))
    u = corpus.unique_surfaces(d, "doc_id", "found")
    return u.select("doc_id", F.size("surfaces").alias("n"), F.md5(F.array_join("surfaces", " ")).alias("digest"))


QUERIES, ORACLES = R.queries, R.oracles
