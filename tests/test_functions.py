import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelattice.functions import latex, text
from pagelattice.operators import export, layout, library, questions, tables


def one_by_one(expr):
    """The rules with each symbol as a rule of its own."""
    for rule in latex.rules():
        for pattern, replacement in [(re.escape(k), v.replace("\\", r"\\")) for k, v in rule.items()] if isinstance(rule, dict) else [rule]:
            expr = re.sub(pattern, replacement, expr)
    return expr.strip()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="αβΩ∑→⇌×*<=>-!≤°′ abd12{}\\_^$~\n" + "".join(latex.MISC)[:8], max_size=40))
def test_one_pass_is_one_by_one(s):
    assert latex.clean(s) == one_by_one(s)


def test_clean_examples():
    assert len(latex.FIRST_SYMBOLS) + len(latex.BINARY) + len(latex.SECOND_SYMBOLS) == 215
    cases = {
        "$$ αx $$": r"\alphax", "a<=b": r"a\leqb", "a<=>b": r"a\Leftrightarrowb", "x*y": r"x\cdoty", "x*∞": r"x*\infty", "⊎": r"\biguplus", "x_12": "x_{12}",
        r"\frac a b": r"\frac{a}{b}", "sin (x)": r"\sin (x)", "3 kg": r"3\,\mathrm{kg}", "d x": "dx", "90°": r"90^{\circ}", r"\text{ab}": r"\mathrm{ab}", "⇌": r"\ce{<=>}",
        "```latex x```": "x", "a~b\n c": "a b c", r"\mathbb{r}": r"\mathbf{r}", r"\left ( x \right )": r"\left( x \right)",
    }
    assert {k: latex.clean(k) for k in cases} == cases


def test_vectorised_forms(spark):
    df = spark.createDataFrame([("αx",), (None,)], "e string")
    assert [r[0] for r in df.select(latex.clean_latex("e")).collect()] == [r"\alphax", None]
    plain = spark.createDataFrame([(r"\mathrm{o f} \mathrm{the }",), (r"\mathrm{x}+1",), ("x",), (r"\mathrm{ab}" + "\n",)], "e string").select(latex.roman_text(F.col("e")))
    assert [r[0] for r in plain.collect()] == ["o f the", None, None, "ab"]


def test_rounding_and_formats(spark):
    import random

    r = random.Random(1)
    values = [2.675, 0.12345, 2.5, 0.5, -0.5, 0.0, 1e-9, 3 / 640, -2.675, None, 0.03125, 0.09375, 1234567.8125]
    values += [k / 1280 for k in range(1, 1280)] + [k / 3840 for k in range(1, 3840, 7)] + [r.randrange(10**7) / 10**5 for _ in range(2000)] + [-r.randrange(10**9) / 10**7 for _ in range(2000)] + [r.random() * 10 ** r.randrange(-6, 9) for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i")
    for digits in (0, 1, 2, 3, 4, 6):
        got = [x[0] for x in df.select(text.round_exact(F.col("x"), digits)).collect()]
        assert got == [None if v is None else round(v, digits) for v in values]
    assert [x[0] for x in df.select(text.fixed6(F.col("x"))).collect()] == [None if v is None else f"{v:.6f}".replace("-0.000000", "0.000000") if round(v, 6) == 0 else f"{v:.6f}" for v in values]


def test_cells_and_escapes(spark):
    df = spark.createDataFrame([(" | a  b \\| c |",)], "c string")
    assert df.select(text.normalize_cell(F.col("c"))).first()[0] == "a b | c"
    assert df.select(text.escape_html(F.lit('&lt;"x">'))).first()[0] == "&amp;lt;&quot;x&quot;&gt;"
    assert df.select(text.split_row(F.lit("| a | | b |"))).first()[0] == ["a", "", "b"]
    assert df.select(text.split_row(F.lit("|"))).first()[0] == []
    assert df.select(text.data_url_bytes(F.lit("data:image/png;base64,AQI=")), text.data_url_bytes(F.lit("x"))).first()[:] == (b"\x01\x02", None)


def test_file_types_and_percent(spark):
    names = spark.createDataFrame([("a.PDF",), ("b.jpeg",), ("c",), ("d.tar.gz",), ("pdf",)], "f string")
    assert [r[0] for r in names.select(library.file_type(F.col("f"))).collect()] == ["pdf", "image", "other", "other", "other"]
    docs = spark.createDataFrame([("a.pdf", None)] + [("b", None)] * 7, "filename string, deleted_at timestamp")
    assert {r["file_type"]: r["percent"] for r in library.storage_by_type(docs).collect()} == {"pdf": 12, "other": 88}
    assert library.storage_by_type(docs.limit(0)).collect() == []


def test_rollup_states(spark):
    docs = spark.createDataFrame([(1, 0, "uploaded"), (2, 2, "uploaded"), (3, 2, "complete"), (4, 1, "complete"), (5, 2, "partial")], "id int, page_count int, status string")
    pages = spark.createDataFrame([(2, 1, "ocr-complete"), (2, 2, "ocr-complete"), (3, 1, "layout-detected"), (4, 1, "idle")], "document_id int, page_number int, status string")
    got = {r["id"]: (r["new_status"], r["completed"]) for r in library.status_rollup(docs, pages).collect()}
    assert got == {1: ("uploaded", False), 2: ("complete", True), 3: ("partial", False), 4: ("complete", False), 5: ("partial", False)}


def test_rendered_table(spark):
    block = "struct<type:string,value:string,display:boolean,url:string,alt:string,cells:array<array<array<struct<type:string,value:string,display:boolean,url:string,alt:string>>>>>"
    cell = lambda v: [("text", v, None, None, None)]
    b = ("table", None, None, None, None, [[cell("h"), cell("i")], [cell("<1>"), []]])
    df = spark.createDataFrame([(b,)], f"b {block}")
    html, md = df.select(export.block_html(F.col("b")), export.block_md(F.col("b"))).first()
    assert html == '<table style="border-collapse:collapse;width:100%"><tr><th><span>h</span> </th><th><span>i</span> </th></tr><tr><td><span>&lt;1&gt;</span> </td><td></td></tr></table>'
    assert md == "| h | i |\n| --- | --- |\n| <1> |  |"


def test_times_corners_and_types(spark):
    at = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05.000600' AS t, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS n, CAST(NULL AS TIMESTAMP) AS z")
    assert tuple(at.select(text.isoformat(F.col("t")), text.isoformat(F.col("n")), text.isoformat(F.col("z"))).first()) == ("2024-01-02T03:04:05.000600+00:00", "2024-01-02T03:04:05+00:00", None)
    p = spark.createDataFrame([([3.0, 9.0, 1.0, 7.0],), ([],), (None,), ([1.0, 2.0, 3.0],), ([1.0, None],)], "p array<double>")
    assert [tuple(r["c"]) for r in p.select(layout.top_left(F.col("p"), F.lit(10), F.lit(20)).alias("c")).collect()] == [(7.0, 1.0)] + [(10.0, 5.0)] * 4
    assert layout.with_corners(p.select(F.col("p").alias("bbox"))).count() == 1
    none = F.lit(None).cast("string")
    assert spark.range(1).select(questions.question_type(none, F.lit(0)), questions.question_type(F.lit(""), F.lit(0))).first()[:] == ("unknown", "subjective")
    angles = spark.range(1).select(tables.skew_angles().alias("a")).first()["a"]
    assert len(angles) == 41 and (angles[0], angles[20], angles[40]) == (-10.0, 0.0, 10.0)
