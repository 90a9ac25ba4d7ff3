import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagelattice.llm import shared, toxicity

SF = "/root/testdata/sf0.01"


def matches(g, text):
    return {k: v for k, v in zip(toxicity.FEATURES, g.features(text), strict=True) if v}


def score(g, text):
    return float(g.score(np.array([g.features(text)]))[0])


def interpreted(classes):
    """Kinds that a clause of class names matches, said without machines."""
    found = Counter()
    place = lambda name: [i for i, c in enumerate(classes) if c == name]

    def how(i):
        negations = [j for j in place("negation") if j < i]
        if negations and i - max(negations) <= toxicity.SCOPE:
            return "negated"
        return "reported" if [j for j in place("report") if j < i] else ""

    insults, threats, marked = place("insult"), place("threat"), place("marked")
    for i in insults[1::2]:
        # negation and report of the last insult or threat before count
        found["insult_" + (("negated" if how(i) == "negated" else "") or reported_at(classes, i) or "piled")] += 1
    if len(insults) % 2:
        found["insult_" + (("negated" if how(insults[-1]) == "negated" else "") or reported_at(classes, len(classes)) or ("aimed" if any(map(place, toxicity.AIMS)) else "bare"))] += 1
    if any(threatens(classes, i) for i in threats) or stepped(classes):
        found["_".join(filter(None, ("threat", "negated" if how(threats[-1]) == "negated" else reported_at(classes, len(classes)))))] += 1
    found["marked_piled"] += len(marked) // 2
    found["marked"] += len(marked) % 2
    return +found


def reported_at(classes, i):
    last = [j for j, c in enumerate(classes[: i + 1]) if c in ("insult", "threat")]
    return "reported" if last and "report" in classes[: last[-1]] else ""


def threatens(classes, i):
    """A threat at i: a modal at most three words before, none of them a verb of threat or target behind one; a target within two words."""
    state = None
    left = 0
    for j, c in enumerate(classes):
        if c == "will":
            left = 3
            continue
        if c == "threat" and left > 0:
            state, left = j, -2
            continue
        if c in toxicity.AIMS and left < 0:
            if state == i:
                return True
            left = 0
            continue
        left = left - 1 if left > 0 else left + 1 if left < 0 else 0
    return False


def stepped(classes):
    state = toxicity.BEGIN
    for c in classes:
        state = toxicity._turned(state, c)[0]
    return state in (toxicity.SEEN, toxicity.ENDED)


def turned(classes):
    """Threats in other orders, as patterns over a letter a word; what a word begins ends what was begun before it, but for a modal's and its object's reach."""
    letters = "".join({"threat": "t", "will": "w", "target": "y", "object": "o", "them": "m", "wish": "h"}.get(c, ".") for c in classes)
    orders = r"^t[^wh]?[om]", r"w[^whto]{0,2}o[^who]{0,3}t", r"ow[^who]{0,3}t", r"h[^whymo]?[ymo][^whymot]?t$"
    return any(re.search(p, letters) for p in orders)


def test_other_orders_are_patterns():
    """The machine against patterns, where no word could begin something else: then both say the same."""
    r = random.Random(3)
    for _ in range(4000):
        kind = r.choice([("", "threat", "them"), ("", "will", "object", "threat"), ("", "wish", "target", "threat")])
        classes = [r.choice(kind if r.random() < 0.9 else ("",)) for _ in range(r.randint(0, 7))]
        state = toxicity.BEGIN
        for c in classes:
            state = toxicity._turned(state, c)[0]
        if sum(c in ("will", "wish", "object", "target", "them") for c in classes) <= 2 and classes.count("threat") <= 1:
            assert (toxicity._turned(state, "stop")[1] == "threat") == stepped(classes) == turned(classes), classes


SAID = (
    ("ich werde dich töten", "ich werde dich nicht töten"), ("je vais te tuer", "je ne vais pas te tuer"), ("te voy a matar", "no te voy a matar"),
    ("I am going to kill you", "I am not going to kill you"), ("kill them all", "he said kill them all"), ("I hope you burn", "I do not hope you burn"),
    ("wir werden euch umbringen", "er sagte wir werden euch umbringen"), ("on va vous tuer", "il dit on va vous tuer"), ("I hope they all burn", "never, I hope they burn"),
)


def test_threats_in_other_orders_and_languages(spark):
    for g in (toxicity.Grammar(), toxicity.fit(shared.table(spark, SF, "documents"), shared.table(spark, SF, "labels"))):
        for threat, other in SAID:
            assert score(g, threat) >= toxicity.THRESHOLD > score(g, other), (threat, score(g, threat), other, score(g, other))
        for text in ("I hope they beat the record", "will they kill the process", "murder he wrote", "beat the eggs", "we will see them beat the champion", "je te dois de tuer le temps"):
            assert score(g, text) < toxicity.THRESHOLD, text


def test_composed_machine_is_the_interpreter():
    r = random.Random(9)
    names = toxicity.CLASSES[:-1]
    for _ in range(3000):
        classes = [r.choice(names if r.random() < 0.8 else ("", "will", "threat", "target")) for _ in range(r.randint(0, 14))]
        found = [0] * len(toxicity.KINDS)
        assert toxicity.read_clause([toxicity.CLASSES.index(c) for c in classes], found) == len(classes)
        assert {k: n for k, n in zip(toxicity.KINDS, found, strict=True) if n} == interpreted(classes), classes


def test_grammar_reads_clauses():
    g = toxicity.Grammar(("lowei",))
    assert matches(g, "the weather is fine") == {} == matches(g, "what an idiot. fine")
    assert matches(g, "an idiot. a moron. scum")["insult_bare"] == np.log2(3)
    assert matches(g, "you are a total moron") == {"insult_aimed": 1.0}
    assert matches(g, "idiot, you") == {"insult_aimed": 1.0}
    assert matches(g, "idiot moron")["insult_piled"] == 1
    assert matches(g, "he is not an idiot") == {"insult_negated": 1.0}
    assert matches(g, "she said idiot") == {"insult_reported": 1.0}
    assert matches(g, "I will surely kill you") == {"threat": 1.0} and matches(g, "I will never kill you") == {"threat_negated": 1.0}
    assert matches(g, "the kill switch") == {} == matches(g, "idiotic trashcan")
    assert matches(g, "Das loweischaft dort") == {} == matches(g, "xlowei lowe")
    assert matches(g, "Loweischaft und loweitum")["marked_piled"] == 1
    order = [score(g, t) for t in ("", "I will never kill you", "you are an idiot", "I will kill you")]
    assert order == sorted(order) and order[0] < 0.2 and order[-2] >= toxicity.THRESHOLD


def test_words_alone_do_not_decide(spark):
    g = toxicity.fit(shared.table(spark, SF, "documents"), shared.table(spark, SF, "labels"))
    assert max(score(g, t) for t in ("idiot", "trash is collected on monday", "he said I will kill you", "he is not an idiot", "I will not kill you")) < toxicity.THRESHOLD
    assert min(score(g, t) for t in ("I will kill you", "you idiot", "they are scum", "idiot, moron")) >= toxicity.THRESHOLD


def test_held_out_accuracy_and_contract(spark):
    out = toxicity.query(spark, SF)
    docs = shared.table(spark, SF, "documents")
    assert out.count() == docs.count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    joined = out.join(shared.table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    clean = [r["predicted"] for r in joined if r["toxic"] == 0]
    assert sum(clean) <= 0.02 * len(clean)
    english = out.join(docs.where("lang = 'en'"), "doc_id").join(shared.table(spark, SF, "labels").where("toxic = 1"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] for r in english) >= 0.8 * len(english)
    bad = out.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull() | F.isnan("score")).count()
    assert bad == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = shared.table(spark, SF, "documents").select("doc_id", "text")
    labels = shared.table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.beginnings, a.weights, a.bias) == (b.beginnings, b.weights, b.bias)


def test_held_out_recall_of_each_language(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = shared.table(spark, big, "documents"), shared.table(spark, big, "labels")
    out = toxicity.query(spark, big).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    rows = out.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("p")).collect()
    share = {(r["lang"], r["toxic"]): r["p"] / r["n"] for r in rows}
    assert all(share[lang, 1] >= 0.85 and share[lang, 0] <= 0.01 for lang in ("en", "de", "es", "fr"))


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "you idiot, you moron"), (4, "x" * 200_000 + " you idiot"), (4, "you idiot")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    g = toxicity.fit(docs, none)
    assert g.weights.keys() == toxicity.PRIOR.keys()
    scores = [r["s"] for r in docs.select(toxicity.scored(g, F.col("text")).alias("s")).collect()]
    assert scores[0] == scores[1] < 0.2 and min(scores[2:]) >= toxicity.THRESHOLD
    assert docs.limit(0).select(toxicity.scored(g, F.col("text"))).count() == 0
    clash = docs.selectExpr("*", "7 AS score", "8 AS score_", "9 AS _score")
    kept = toxicity.stage(spark, clash, SF)
    assert kept.columns == clash.columns and [tuple(r)[2:] for r in kept.collect()] == [(7, 8, 9)] * 2


def test_clauses_are_read_whole():
    g = toxicity.Grammar()
    for n in (10, 150, 250, 5_000):
        gap = "word, " * n
        assert matches(g, f"she said {gap} idiot. fine") == {"insult_reported": 1.0}
        assert matches(g, f"you {gap} idiot") == {"insult_aimed": 1.0}
        assert matches(g, f"fine. you. {gap} idiot") == {}
    for n in range(180, 230):
        found = matches(g, "moron " + "x" * n + " I will kill you and " + "y" * 300 + " not an idiot")
        assert found["threat"] == 1 and found["insult_negated"] == 1
