import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm import pieces, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(pieces.default_model())


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(s):
    c = pieces.codec(pieces.default_model())
    assert c.encode(s) == c.lib.encode(s)


def test_texts_of_pieces(codec):
    r = random.Random(2)
    for _ in range(3000):
        s = "".join(r.choice(codec.pieces[259:]) for _ in range(r.randint(1, 7)))
        assert codec.encode(s) == codec.lib.encode(s)
        assert codec.encode(s.replace("▁", " ")) == codec.lib.encode(s.replace("▁", " "))


@pytest.mark.parametrize("s", ["", " ", "a" * 5000, " " * 400, "the" * 900, "<s></s><unk><0x0A>", "\0", "漢字①ﬁ▁ ▁", "x\n\ty "])
def test_odd_texts(codec, s):
    assert codec.encode(s) == codec.lib.encode(s) and codec.decode(codec.encode(s)) == codec.lib.decode(codec.lib.encode(s))


def test_compatible_pairs_are_what_the_library_keeps_apart(codec):
    r = random.Random(3)
    own = sorted(p for p in codec.own if not p.startswith(pieces.MARK))
    for _ in range(5000):
        a, b = r.choice(own), r.choice(own)
        ids = codec.lib.encode(a + b)  # begins with the mark of the text's start
        found = codec.encode(a + b)
        assert found == ids and codec.fits(a, b) == (codec._merge(a + b) == [a, b])


def test_forgetting_changes_nothing(codec, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    s = "the cat sat on the mat and the dog ran to the cat"
    assert codec.encode(s) == codec.lib.encode(s)


def test_parts_of_a_large_vocabulary_are_encoded_once(monkeypatch):
    """120,000 different words, read twice; each takes few bytes and no search the second time."""
    own, searched = pieces.Codec(pieces.default_model()), []
    once = own._part_ids
    monkeypatch.setattr(own, "_part_ids", lambda part: searched.append(part) or once(part))
    text = " ".join(f"k{i}" for i in range(120_000))
    assert own.encode(text) == own.encode(text) == own.lib.encode(text)
    assert len(searched) == len(set(searched)) == 120_000
    assert all(type(v) is bytes for v in own.known.values())


def test_dropping_checked_pairs_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 3)
    own = pieces.Codec(pieces.default_model())
    s = "unaffordable characterizations, 12345678 antidisestablishmentarianism"
    assert own.encode(s) == own.lib.encode(s) and len(own.pair) <= 3


def test_query(spark, codec):
    texts = {r["doc_id"]: r["text"] or "" for r in shared.table(spark, SF, "documents").collect()}
    got = pieces.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = codec.lib.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(codec.lib.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a", 6), (1, None, 7)], "doc_id long, text string, ids int")
    got = pieces.encode_texts(df, with_ids=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 0), (1, 0)]
    assert pieces.encode_texts(df.limit(0)).collect() == []
