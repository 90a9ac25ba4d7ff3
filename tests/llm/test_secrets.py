import base64
import hashlib
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import secrets, shared

SF = "/root/testdata/sf0.01"


def brute(text):
    spans = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""".replace("(?ai:", "(?i:"), text, re.ASCII):
        if len(m[2]) >= 6:
            spans.append((m.start(), m.end(), "assign"))
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("password=abcdef", "assign:0:15"),
        ('x API_KEY" : "ab.c=/d" y', "assign:2:21"),
        ("token=short", ""),
        ("token=abcde", ""),
        ("secret:\n123456", ""),
        ("AKIA" + "A" * 15, ""),
        ("äAKIA" + "A" * 16, "access:1:21"),
        ("token = " + "0a" * 12, "assign:0:32,hex:8:32"),
        ("ſecret=abcdef", ""),
        ("", ""),
    ],
)
def test_base_spans(text, spans):
    assert secrets.joined(secrets.base_spans(text)) == spans == secrets.joined(brute(text))


def test_query_is_brute_force_on_base(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in shared.table(spark, SF, "documents").collect()}
    for r in secrets.query(spark, SF).collect():
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        every = [x for x in r["spans"].split(",") if x]
        assert [x for x in every if not x.startswith("net")] == [x for x in secrets.joined(base).split(",") if x]


def test_network_finds_other_secrets_and_spares_the_rest():
    """Whole texts, scanned as any text is; half of them with a secret, in the shapes of the generator but other values."""
    net = secrets.network()
    texts = list(secrets.labelled_texts(1500, 77))
    found = secrets.all_spans([t for t, *_ in texts], net)
    hit = [any(min(e, end) - max(s, start) >= 0.9 * (end - start) for s, e, _ in spans) for (_, start, end, secret), (_, spans) in zip(texts, found, strict=True) if secret]
    false = [any(k == "net" for *_, k in spans) for (*_, secret), (_, spans) in zip(texts, found, strict=True) if not secret]
    assert np.mean(hit) >= 0.94 and np.mean(false) <= 0.02


def test_network_finds_shapes_it_was_not_trained_on():
    net = secrets.network()
    r = random.Random(3)
    mixed = lambda k: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(k))
    made = {
        "AIza": lambda: f"the map uses AIza{mixed(35)} for now",
        "SG": lambda: f"mail goes out with SG{mixed(22)}_{mixed(43)} since may",
        "url": lambda: f"see https://host.example/{mixed(40)} there",
        "base64": lambda: f"blob {base64.b64encode(r.randbytes(48)).decode()} end",
        "signing": lambda: f"signing_key = {mixed(18)}%{mixed(6)}",
    }
    for name, make in made.items():
        found = [len(own) > 0 for _, own in secrets.all_spans([make() for _ in range(50)], net)]
        assert sum(found) >= 40, name
    prose = ["Donaudampfschifffahrtsgesellschaftskapitän und Rechtsschutzversicherungsgesellschaften", "a well-known-and-often-repeated-turn-of-phrase here", "https://host.example/articles/about/the/history/of/things"]
    assert [own for _, own in secrets.all_spans(prose, net)] == [[], [], []]


def test_long_candidates_are_read_whole():
    net = secrets.network()
    r = random.Random(4)
    value = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(400))
    dashes = "-" * 400
    for text in (dashes + value, value + dashes, dashes + value + dashes):
        a, b = net.logits([secrets.codes("x " + text + " y", 2, 2 + len(text)), secrets.codes("x " + "-" * len(text) + " y", 2, 2 + len(text))])
        assert a != b
    # slices don't change the result
    long = secrets.codes(value * 500, 0, 200_000)
    whole = net.pooled([long])
    places, secrets.PLACES = secrets.PLACES, 777
    try:
        assert np.allclose(whole, net.pooled([long]))
    finally:
        secrets.PLACES = places


def test_many_candidates_take_linear_time():
    net = secrets.network()
    text = ("password=abcdef123 " + "deadbeef" * 4 + " ") * 12_000
    began = time.process_time()
    base, every = secrets.all_spans([text], net)[0]
    assert len(base) == 24_000 and every == base and time.process_time() - began < 10


def test_found_spans_are_those_base_spans_do_not_cover():
    r = random.Random(5)
    for _ in range(2000):
        base = sorted((s, s + r.randint(1, 6), "hex") for s in r.sample(range(30), r.randint(0, 6)))
        found, at = [], 0
        while at < 30:
            at += r.randint(0, 5)
            end = max(at, found[-1][1] if found else 0) + r.randint(1, 6)
            found.append((at, end))
            at += 1
        covered = lambda s, e: all(any(a <= i < b for a, b, _ in base) for i in range(s, e))
        assert secrets.with_found(base, found) == sorted(base + [(s, e, "net") for s, e in found if not covered(s, e)], key=secrets._order)


def test_training_is_repeatable():
    a, b = secrets.Net(), secrets.Net()
    for n in (a, b):
        n.train(*secrets.findings(200, 1)[:2], epochs=1)
    assert (a.w == b.w).all()


def test_redacted(spark):
    text = "a password=abcdef1 b AKIA" + "Z" * 16 + " c"
    assert secrets.redact(text, secrets.base_spans(text)) == "a <assign> b <access> c"
    df = spark.createDataFrame([(1, text, 99), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.stage(spark, df, "").collect()}
    assert got == {1: ("a <assign> b <access> c", 23), 2: (None, 0), 3: ("clean", 5)}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "password=abcdef"), (3, "x" * 300_000)], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: (r["n_assign"], r["spans"]) for r in secrets.scan(df).collect()}
    assert got == {1: (0, ""), None: (1, "assign:0:15"), 3: (0, "")}
    assert secrets.scan(df.limit(0)).collect() == []
