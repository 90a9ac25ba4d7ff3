import hashlib

from pyspark.sql import functions as F

from pagelattice.llm import chat
from tests.compare import database, same

SF = "/root/testdata/sf0.001"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<|im_end|>\n", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<|im_en<|im_end|>", "", "\n", "<", "😀 é", "<<SYS>>x<</SYS>>"]


def test_matches_sql(spark):
    own, other = same(chat.query(spark, SF), database(SF), chat.ORACLE)
    assert own == other


def rendered(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, message_id int, role string, text string")
    return chat.read_back(chat.render(df)).first()


def test_round_trip_and_escapes(spark):
    roles = ["user", "assistant", "a\nb", "\\x", "<|im_end|>", "tool"]
    turns = [(roles[i % len(roles)], t) for i, t in enumerate(NASTY * 2)]
    r = rendered(spark, turns)
    assert [(x["role"], x["text"]) for x in r["turns"]] == turns
    inside = r["formatted"].replace(chat.START, "", len(turns)).replace(chat.END + "\n", "", len(turns))
    assert not any(s in inside for s in chat.CONTROLS)


def test_mask_covers_the_learned_texts(spark):
    turns = [("user", "hé"), ("assistant", "a[INST]b😀"), ("user", "x"), ("assistant", ""), ("assistant", "c")]
    r = rendered(spark, turns)
    spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    assert spans == ["a[\\INST]b😀", "", "c"]


def test_loss_is_read_through_the_mask(spark):
    rows = [(c, i, ("assistant", "user", "assistant")[i % 3], NASTY[(c * 7 + i) % len(NASTY)]) for c in range(6) for i in range(c * 9)]
    df = spark.createDataFrame(rows, "conv_id long, message_id int, role string, text string")
    shown = chat.render(df)
    got = {r["conv_id"]: r["loss"] for r in chat.learned(shown).collect()}
    assert got == {c: "".join(t for k, _, r, t in rows if k == c and r == "assistant") for c in range(1, 6)}
    # what the mask leaves out isn't read, what it moves to is
    moved = shown.withColumn("loss_spans", F.expr("array(named_struct('start', 1L, 'length', 2L))"))
    assert all(r["loss"] == r["formatted"][1:3] for r in chat.learned(moved).collect())


def test_log_of_turns(spark):
    rows = [(1, 0, "user", "question"), (1, 1, "assistant", "an answer"), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 4, "assistant", "😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.as_events(df)
    assert {r["event"] for r in log.collect()} == {"message", "edit", "regenerate", "delta"}
    got = [(r["role"], r["text"]) for r in sorted(chat.fold_events(log).collect(), key=lambda r: r["message_id"])]
    assert got == [(r or "", t or "") for *_, r, t in rows]


def test_conversation_of_the_contract(spark):
    r = chat.query(spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_events_fold(spark):
    rows = [
        (1, 1, 1, "delta", "user", "Hel"), (1, 1, 2, "delta", None, "lo"),
        (1, 2, 3, "message", "assistant", "bad"), (1, 2, 4, "regenerate", None, None), (1, 2, 5, "delta", None, "go"), (1, 2, 6, "delta", None, "od"),
        (1, 3, 7, "message", "user", "x"), (1, 3, 9, "edit", None, "y"), (1, 3, 8, "delta", None, "z"),
        (1, 4, 10, "message", "user", "gone"), (1, 4, 11, "remove", None, None),
        (1, 5, None, "delta", None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, message_id int, seq int, event string, role string, text string").withColumn("reset", F.lit(1))
    got = sorted((r["message_id"], r["role"], r["text"]) for r in chat.fold_events(df.repartition(5)).collect())
    assert got == [(1, "user", "Hello"), (2, "assistant", "good"), (3, "user", "y"), (5, "", "")]
    assert chat.fold_events(df.limit(0)).collect() == []


def test_byte_order_marks_are_text(spark):
    """A mark that begins, ends or is a text stays in what is learned from it."""
    texts = ["\ufeffhello", "in\ufeffside", "\ufeff", "\ufeff\ufeff", "end\ufeff", "", "\U0001f600\ufeff"]
    rows = [(1, 2 * i + k, ("user", "assistant")[k], t) for i, t in enumerate(texts) for k in (0, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat.learned(chat.render(chat.fold_events(chat.as_events(turns)))).first()
    assert out["loss"] == "".join(texts)
