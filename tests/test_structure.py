"""Headings, sections, tables, citations and packing."""

from pyspark.sql import functions as F

from folioscope.operators import structure as S


def test_sections(spark):
    md = [("f", 1, "# A\ntext\n```\n# not a heading\n```"), ("f", 2, "## B\n## C"), ("f", 4, "# D"), ("g", 1, "no heading")]
    pages = spark.createDataFrame(md, "file_id string, page long, text string")
    heads = S.headings(pages)
    assert sorted((r.page, r.depth, r.title) for r in heads.collect()) == [(1, 1, "A"), (2, 2, "B"), (2, 2, "C"), (4, 1, "D")]
    last = pages.groupBy("file_id").agg(F.max("page").alias("last_page"))
    secs = S.sections(heads, last)
    got = {r.title: (r.page_start, r.page_end, r.parent) for r in secs.collect()}
    assert got == {"A": (1, 3, None), "B": (2, 2, "f:sec_001"), "C": (2, 3, "f:sec_001"), "D": (4, 4, None)}
    assert {(r.file_id, r.page): r.section_id for r in S.section_of_pages(pages, secs).collect()} == {("f", 1): "f:sec_001", ("f", 2): "f:sec_002", ("f", 4): "f:sec_004", ("g", 1): None}
    assert {(r.file_id, r.page): r.section_id for r in S.section_of_pages(pages, secs, deepest=False).collect()}[("f", 2)] == "f:sec_001"
    assert {r.section_id: r.exclusive for r in S.exclusive_sections(secs).collect()}["f:sec_004"] is True


def test_tables(spark):
    html = "<table><tr><th>Name</th><th>Sum &amp; more</th></tr><tr><td>a</td><td>1</td></tr></table>"
    pipe = "| H | I |\n|---|---|\n| x | y\\|z |"
    df = spark.createDataFrame([("f", "p_0001", html), ("f", "p_0002", pipe), ("f", "p_0003", None)], "file_id string, page_id string, blob string")
    got = sorted((r.table_row_id, r.text, r.is_header_row) for r in S.table_rows(df).collect())
    assert got == [
        ("f/p_0001:t_01:r_01", "Name Sum & more", True),
        ("f/p_0001:t_01:r_02", "a 1", False),
        ("f/p_0002:t_01:r_01", "H I", True),
        ("f/p_0002:t_01:r_02", "x y|z", False),
    ]


def test_citations_and_legend(spark):
    text = "See [^2] and [^1], again [^2].\n\n## Sources\n[^1]: A https://a.example/x.\n[^2]: https://b.example\n\n## End\n[^3]: https://c.example"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r.label, r.number) for r in S.citation_numbers(df, "id", "text").orderBy("number").collect()][:2] == [("2", 1), ("1", 2)]
    assert {r.number: r.url for r in S.source_legend(df, "id", "text").collect()} == {1: "https://a.example/x", 2: "https://b.example"}


def test_budget_split(spark):
    df = spark.createDataFrame([(["a" * 600, "b" * 500, "c" * 300, "d" * 2500],)], "s array<string>")
    got = df.select(S.budget_split(F.col("s")).alias("p")).first().p
    assert [len(x) for x in got] == [1101, 300, 1200, 1200, 100] and "".join(got).replace(" ", "") == "a" * 600 + "b" * 500 + "c" * 300 + "d" * 2500


def test_blocks_and_pages(spark):
    block = "struct<block_label:string,block_content:string,block_id:int,block_order:int>"
    rows = [("f", "p_0001", [("text", "second", 2, None), ("Paragraph_Title", "first", 1, None), ("image", "no", 3, None), ("text", " ", 4, None)])]
    df = spark.createDataFrame(rows, f"file_id string, page_id string, layout_blocks array<{block}>")
    assert [(r.passage_id, r.text) for r in S.content_blocks(df).orderBy("passage_id").collect()] == [("f/p_0001:p_0001", "first"), ("f/p_0001:p_0002", "second")]
    both = spark.createDataFrame([("f", f"one\n\n{S.PAGE_MARKER}\n\ntwo<!-- any:batch_boundary -->")], "id string, text string")
    assert [(r.page, r.text.strip()) for r in S.pages_of(both, "id", "text").orderBy("page").collect()] == [(1, "one"), (2, "two"), (3, "")]


def test_markdown_blocks(spark):
    md = "intro line\nsame paragraph\n\n# Head\nbody\n\n![x](y.png)\n\n<!-- note -->\n\nend"
    df = spark.createDataFrame([("f", 1, md), ("g", 1, None), ("h", 1, "")], "file_id string, page long, text string")
    got = [(r.kind, r.text) for r in S.markdown_blocks(df).orderBy("pos").collect()]
    assert got == [("paragraph", "intro line\nsame paragraph"), ("heading", "Head"), ("paragraph", "body"), ("paragraph", "end")]


def test_blocks_keep_their_digits(spark):
    """Blanks are trimmed, not the digits of a block's own number; a heading ends at a line feed only."""
    df = spark.createDataFrame([("f", 1, "# 0 zero 0\n  10 one 1 \n\n22 two 2\n# a\rb\u2028c\n3")], "file_id string, page long, text string")
    got = [(r.kind, r.text) for r in S.markdown_blocks(df).orderBy("pos").collect()]
    assert got == [("heading", "0 zero 0"), ("paragraph", "10 one 1"), ("paragraph", "22 two 2"), ("heading", "a\rb\u2028c"), ("paragraph", "3")]


def test_headings_of_a_long_page_in_one_pass(spark):
    """Work follows the lines: 40,000 of them, with fences open and closed throughout, are done within a minute."""
    import time

    text = "\n".join(("# h ##", "```", "# code", "~~~")[i % 4] if i % 8 < 4 else "x" for i in range(40_000))
    df = spark.createDataFrame([("f", 1, text), ("f", 2, "  # no\n####### no\n#no\n## yes # \r")], "file_id string, page long, text string")
    t = time.monotonic()
    got = S.headings(df).collect()
    assert time.monotonic() - t < 60
    assert sorted(r.line for r in got if r.page == 1) == list(range(1, 40_001, 8)) and {r.title for r in got if r.page == 1} == {"h"}
    assert [(r.line, r.depth, r.title) for r in got if r.page == 2] == [(4, 2, "yes # \r")]
