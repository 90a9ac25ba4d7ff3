"""Order-dependent operators against small models written as loops."""

import random

from pyspark.sql import functions as F

from pagelattice.operators import layout, mutations, questions, structure, tables


def dedup_model(page):
    gone = set()
    for i, a in enumerate(page):
        for j, x in enumerate(page):
            if i == j or j in gone or a[0] != x[0]:
                continue
            area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
            w, h = min(a[3], x[3]) - max(a[1], x[1]), min(a[4], x[4]) - max(a[2], x[2])
            if area(a) > 0 and area(x) > 0 and w > 0 and h > 0 and w * h / area(x) > 0.8:
                gone.add(i)
                break
    return [i for i in range(len(page)) if i not in gone]


def test_dedup_is_the_loop(spark):
    r = random.Random(3)
    pages = []
    for _ in range(150):
        page = []
        for _ in range(r.randint(1, 9)):
            x, y, w, h = r.randint(0, 30), r.randint(0, 30), r.randint(0, 40), r.randint(0, 40)
            page.append((r.choice(["table", "figure"]), x, y, x + w, y + h))
        if r.random() < 0.5:
            page.append(r.choice(page))
        pages.append(page)
    pages.append([("title", 0, 0, 10, 10), ("title", 0, 0, 10, 10)])  # of equal boxes the first goes
    pages.append([("title", 0, 0, 30, 30), ("title", 0, 0, 20, 20), ("title", 0, 0, 10, 10)])
    pages.append([("title", 0, 0, 8, 10), ("title", 0, 0, 10, 10)])  # four fifths exactly: both stay
    rows = [(p, i, *b) for p, page in enumerate(pages) for i, b in enumerate(page)]
    got = layout.dedup(spark.createDataFrame(rows, "page_id int, det_idx int, label string, x1 int, y1 int, x2 int, y2 int")).collect()
    kept = {p: sorted(x["det_idx"] for x in got if x["page_id"] == p) for p in range(len(pages))}
    assert kept == {p: dedup_model(page) for p, page in enumerate(pages)}


def test_two_columns_and_ties(spark):
    box = lambda i, mid, y: (1, i, "plain_text", 0.9, float(mid), 0, y, 10, y + 5)
    rows = [box(0, 100, 50), box(1, 100, 20), box(2, 900, 20), box(3, 900, 10), box(4, 100, 20)]
    df = spark.createDataFrame(rows, "page_id int, det_idx int, label string, confidence double, x_mid double, x1 int, y1 int, x2 int, y2 int")
    got = {r["det_idx"]: (r["column_idx"], r["reading_order"]) for r in layout.reading_order(df, 1000).collect()}
    assert got == {1: (0, 0), 4: (0, 1), 0: (0, 2), 3: (1, 3), 2: (1, 4)}
    three = {r["det_idx"]: r["column_idx"] for r in layout.reading_order(df.where("det_idx < 3"), 1000).collect()}
    assert set(three.values()) == {0}  # three blocks are never two columns
    edge = df.withColumn("x_mid", F.when(F.col("det_idx") < 2, 380.0).otherwise(620.0))
    assert layout.column_profile(edge, 1000).first()["n_mid"] == 5  # on the lines is in the middle


def segment_model(page):
    import re

    out, number, above, group = [], None, None, 0
    for order, y1, y2, texts in page:
        if not texts:
            above = y2
            continue
        # the pattern of a question number is a fixed value
        number = next((int(m[1]) for t in texts[:3] if (m := re.match(r"^\s*[\(\[]?\s*Q?\.?\s*(\d+)\s*[.\)\]:\s]", t, re.I))), None)
        if number is not None or group and above is not None and y1 - above > 80:
            group += 1
        out.append((order, number, group))
        above = y2
    return out


def test_questions_are_the_loop(spark):
    r = random.Random(5)
    pages = []
    for p in range(120):
        y, page = 0, []
        for i in range(r.randint(1, 8)):
            y += r.choice([10, 80, 81, 200])
            texts = r.choice([[], ["no"], ["Q1. a"], ["x", "y", "2) b"], ["x", "y", "z", "3. c"], ["(4] d"], ["12 "], ["Q1"]])
            page.append((i, y, y + 20, texts))
            y += 20
        pages.append(page)
    rows = [(p, *x) for p, page in enumerate(pages) for x in page]
    got = questions.segment(spark.createDataFrame(rows, "page_id int, reading_order int, y1 int, y2 int, texts array<string>")).collect()
    own = {p: sorted((x["reading_order"], x["number"], x["group_no"]) for x in got if x["page_id"] == p) for p in range(len(pages))}
    assert own == {p: sorted(segment_model(page)) for p, page in enumerate(pages)}


def test_options_and_types(spark):
    texts = ["Q7. Pick one or more [2 Marks]", "(A) first", "more", "ii) second", "(B)", "again", "3. third", "iiii) odd", "I think so"]
    df = spark.createDataFrame([(1, i, "text", t) for i, t in enumerate(texts)] + [(2, 0, "text", "Explain. 2.5 marks")], "question_id int, pos int, type string, value string")
    got = {r["question_id"]: r for r in questions.parse_questions(df).collect()}
    assert (got[1]["number"], got[1]["marks"], got[1]["type"]) == (7, 2.0, "mcq_multi")
    assert got[1]["content"] == ["Pick one or more [2 Marks]"]
    assert got[1]["options"] == {"a": ["first", "more", "think so"], "b": ["second", "again"], "c": ["third"], "iiii": ["odd"]}
    assert (got[2]["number"], got[2]["marks"], got[2]["type"], got[2]["options"]) == (None, 2.5, "subjective", None)


def test_inline_merges_across_dropped_kinds(spark):
    blocks = [("text", "a", None), ("image", None, None), ("text", "b", None), ("latex", "x", True), ("text", "c", None), ("latex", "y", None)]
    df = spark.createDataFrame([(blocks,)], "b array<struct<type:string,value:string,display:boolean>>")
    got = df.select(structure.inline(F.col("b")).alias("i")).first()["i"]
    assert [(x["type"], x["value"], x["display"]) for x in got] == [("text", "a b", None), ("latex", "x", True), ("text", "c", None), ("latex", "y", False)]


def test_sections(spark):
    block = "array<struct<type:string,value:string>>"
    rows = [(1, "p", 0, "plain_text", None, []), (1, "t0", 1, "title", "bad", []), (1, "t1", 2, "title", None, []), (1, "q", 3, "figure", None, []), (1, "n", None, "table", None, [])]
    got = {r["block_id"]: (r["node_type"], r["section_id"], r["position"]) for r in structure.sections(spark.createDataFrame(rows, f"page_id int, block_id string, reading_order int, label string, error string, blocks {block}")).collect()}
    assert got == {"n": ("table", None, 0), "p": ("paragraph", None, 1), "t0": ("error", None, 2), "t1": ("section", None, 3), "q": ("image", "t1", 4)}


def test_renumber_keeps_the_only_page(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "document_id int, page_number int")
    got = mutations.delete_page(pages, spark.createDataFrame([(1, 1), (2, 1)], "document_id int, page_number int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 1)]


def test_pipe_tables(spark):
    long = "a heading of many words"
    cases = [
        ([], ""), (None, None), (["  ", ""], ""), (["|"], ""),
        (["| Name | Age |", "| Ann | 3 |"], "| Name | Age |\n| --- | --- |\n| Ann | 3 |"),
        ([f"| {long} | b |", "|---|---|", "| 1 |"], f"| {long} | b |\n| 1 |  |"),  # a rule counts as the separator
        ([f"|{long}|", "x"], f"| {long} |\n| --- |\n| x |"),
        ([f"|{long.upper()}|", "x", " | "], f"| {long.upper()} |\n| --- |\n| x |"),
        (["---|-", "a|b"], "| --- | - |\n| --- | --- |\n| a | b |"),  # short cells are a heading, whatever they say
        (["-" * 20, "a"], "| a |"),
        (["-" * 20], ""),
        ([f"{long} 1|B", "c| | d \\| e"], f"| {long} 1 | B |  |  |\n| --- | --- | --- | --- |\n| c |  | d \\ | e |"),
    ]
    rows = spark.createDataFrame([(i, lines) for i, (lines, _) in enumerate(cases)], "i int, lines array<string>")
    got = {r["i"]: r["t"] for r in rows.select("i", tables.format_table(F.col("lines")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [wanted for _, wanted in cases]


def test_repair_runs_out_of_blocks(spark):
    nodes = spark.createDataFrame([(1, i, "table", None) for i in range(3)] + [(1, 3, "table", "b")], "page_id int, position int, type string, source_block_id string")
    blocks = spark.createDataFrame([(1, "a", 5, "table"), (1, "b", 1, "table"), (1, "c", 2, "table")], "page_id int, block_id string, reading_order int, label string")
    got = [r["source_block_id"] for r in structure.repair_table_sources(nodes, blocks).orderBy("position").collect()]
    assert got == ["c", "a", None, "b"]


def test_pipe_tables_hold_every_word(spark):
    from pagelattice.plans import catalogue

    values = [" ".join(f"w{i}" for i in range(n)) for n in (1, 2, 9, 10, 11, 40)] + [None, ""]
    regions = spark.createDataFrame(list(enumerate(values)), "page_id long, value string").withColumn("reading_order", F.lit(0))
    got = {r["page_id"]: r["lines"] for r in catalogue._pipes(lambda name: regions).collect()}
    for k, value in enumerate(values):
        words = (value or "").split()
        rows = [x for i, x in enumerate(got[k]) if i != 1]
        assert [c.removesuffix("\\|x").strip() for x in rows for c in x.replace("\\|x |", "|").strip("|").split("|") if c.strip() and c.strip() != "\\|x"] == words
        assert len(rows) == max(3, -(-len(words) // 3))
