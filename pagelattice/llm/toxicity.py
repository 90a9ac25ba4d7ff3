"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, marked, threat, will, target, negation, report). Small transducers read the classes of
a whole clause, from one stop mark to the next, however long it is: one finds insults with or without a target or piled up,
one threats (modal, verb, target), one threats in other orders (target before the verb, imperatives, wishes), two tell whether a match stands in the scope of a negation, one whether it stands in
reported speech, one counts marked words. `compose` makes one machine of them, whose arcs put out kinds of matched clauses;
each kind has a weight. A single bare insult or marked word in a text matches nothing: such clauses count from the second
one on. A logistic sum over the kinds, damped, and over how dense they stand among the text's words gives the score.

The lexicon has fixed seed words; marked words are those with beginnings that are far more frequent in toxic rows than in
others. Beginnings and weights are learned from at most FIT_ROWS labelled rows, those with the smallest hash of their id.
A kind that the rows don't show keeps the score that one match of it has by its prior weight.

Nulls and oddities: a null or empty text scores what a text without matches scores; a very long text or clause is read
whole, in constant memory beside it; a score equal to the threshold is toxic; rows without an id are scored and never
learned from; repeated rows get equal scores, and of rows that repeat an id one is learned from; without labelled rows the
prior weights and seeds are used; an empty table gives an empty table. Columns of the input stay as they are, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The bound on labelled rows that lexicon and weights are fitted to.
FIT_ROWS = 20_000
THRESHOLD = 0.7

#: Seed words of each class, in lower case; fixed values.
INSULTS = (
    "idiot idiots moron morons loser losers scum trash worthless stupid disgusting pathetic clown clowns imbecile dumb "
    "dumbass jerk vermin filth bastard bitch asshole idiota estúpido imbécil connard crétin salaud dummkopf arschloch abschaum"
).split()
THREATS = "kill hurt destroy murder stab shoot beat strangle burn töten umbringen erstechen verprügeln tuer égorger matar apuñalar brennst stirbst verreckst crèves mueras".split()
WILLS = "will gonna going shall must should ll werde werden wird wirst vais va allons voy vamos".split()
TARGETS = "you your youre u they he she these those people du ihr tu toi usted".split()
#: Targets that are objects only: of languages that put them before the verb, and of English.
OBJECTS = "dich euch te vous".split()
THEM = "them him her".split()
WISHES = "hope wish hoffe wünsche espère espero ojalá".split()
NEGATIONS = "not never no isn aren wasn don doesn didn without nicht kein keine pas jamais nunca".split()
REPORTS = "said says say called quoted quote reported wrote claimed according sagt sagte schrieb behauptete dijo escribió afirmó dit écrit affirme".split()

#: Word classes; the empty one is any other word, the last one the end of a clause.
CLASSES = ("", "insult", "marked", "threat", "will", "target", "object", "them", "wish", "negation", "report", "stop")
#: Classes that name a target.
AIMS = ("target", "object", "them")
#: Kinds of matched clauses with the logit that a text with one match has by its prior weight (ALONE: with two).
PRIOR = {
    "insult_bare": 0.3, "insult_aimed": 1.4, "insult_piled": 1.6, "insult_negated": -1.2, "insult_reported": -1.0,
    "threat": 1.8, "threat_negated": -1.2, "threat_reported": -0.8,
    "marked": -1.0, "marked_piled": -0.5, "insult_density": -1.2, "marked_density": -1.2,
}
#: Logit of a text without matches, before fitting.
BIAS = -2.2
FEATURES = tuple(PRIOR)
KINDS = FEATURES[:-2]
#: Kinds of which one match says nothing.
ALONE = ("insult_bare", "marked")
#: Words that negation reaches over.
SCOPE = 4
BEGINNINGS = (4, 5, 6)
#: Marks that end a clause.
STOPS = ".!?;|\n"


class Machine:
    """A finite-state transducer over word classes; step gives the next state and a tag, or no tag."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def _aim(state, c):
    """Insults of a clause, with a target in it or not; each second one is put out with the one before it."""
    insults, target = state
    if c == "stop":
        return (0, False), ("aimed" if target else "bare") if insults else ""
    if c == "insult":
        return ((0, target), "piled") if insults else ((1, target), "")
    return (insults, target or c in AIMS), ""


def _threat(state, c):
    """A modal, at most two words, a verb, at most one word, a target: the verb alone says nothing."""
    left, seen = state  # left: 3 to 1 after a modal, -2 and -1 after a verb behind one
    if c == "stop":
        return (0, False), "threat" if seen else ""
    if seen:
        return state, ""
    if c == "will":
        return (3, False), ""
    if c == "threat" and left > 0:
        return (-2, False), ""
    if c in AIMS and left < 0:
        return (0, True), ""
    return (left - 1 if left > 0 else left + 1 if left < 0 else 0, False), ""


def _turned(state, c):
    """Threats in other orders: a modal, at most two words, an object, at most three words, a verb, or an object right before the modal ("te voy a
    matar"); a verb that begins the clause, at most one word, an object; a wish, at most one word, a target, at most one word, a verb that ends it."""
    if c == "stop":
        return BEGIN, "threat" if state in (SEEN, ENDED) else ""
    if state == SEEN:
        return state, ""
    if state == ENDED:
        state = ("", 0, 0)
    phase, left, reach = state  # reach: words in which a verb behind an object counts
    if phase == "begin":
        phase, left = ("order", 2) if c == "threat" else ("", 0)
        if c == "threat":
            return (phase, left, 0), ""
    if phase == "order" and c in ("object", "them"):
        return SEEN, ""
    if phase == "meant" and c == "threat":
        return ENDED, ""
    if c == "threat" and reach and phase in ("", "will"):
        return SEEN, ""
    if c == "will":
        return ("will", 3, 4 if phase == "object" else 0), ""
    if c == "wish":
        return ("wish", 2, 0), ""
    if phase == "wish" and c in AIMS:
        return ("meant", 2, 0), ""
    if phase == "will" and c == "object":
        return ("will", left - 1, 4) if left > 1 else ("", 0, 4), ""
    if c == "object":
        return ("object", 1, 0), ""
    left, reach = max(0, left - 1), max(0, reach - 1)
    return (phase if left else "", left, reach), ""


BEGIN, SEEN, ENDED = ("begin", 0, 0), ("seen", 0, 0), ("ended", 0, 0)


def _negated(word):
    """Whether the last word of this class stood at most SCOPE words behind a negation."""

    def step(state, c):
        left, found = state
        if c == word:
            found = left > 0
        tag = "negated" if found else ""
        if c == "stop":
            return (0, False), tag
        return (SCOPE if c == "negation" else max(0, left - 1), found), tag

    return step


def _reported(state, c):
    """Whether a word of reporting stood before the last insult or threat."""
    report, found = state
    if c in ("insult", "threat"):
        found = report
    tag = "reported" if found else ""
    return ((False, False) if c == "stop" else (report or c == "report", found)), tag


def _marked(state, c):
    """Marked words of a clause; each second one is put out with the one before it."""
    if c == "marked":
        return (False, "piled") if state else (True, "")
    return (state, "") if c != "stop" else (False, "single" if state else "")


MACHINES = (
    Machine((0, False), _aim),
    Machine((0, False), _threat),
    Machine(BEGIN, _turned),
    Machine((0, False), _negated("insult")),
    Machine((0, False), _negated("threat")),
    Machine((False, False), _reported),
    Machine(False, _marked),
)


def _kinds(aim: str, threat: str, turned: str, negated_insult: str, negated_threat: str, reported: str, marked: str) -> list[str]:
    """What the tags of one step of all machines say together."""
    out = []
    if aim:
        out.append("insult_" + (negated_insult or reported or aim))
    if threat or turned:
        out.append("_".join(filter(None, ("threat", negated_threat or reported))))
    if marked:
        out.append({"single": "marked", "piled": "marked_piled"}[marked])
    return out


@lru_cache(maxsize=1)
def compose() -> tuple[list[int], list[tuple[int, ...]]]:
    """The machines as one: the next state and the numbers of the kinds put out, at state * len(CLASSES) + class; 0 is the start."""
    start = tuple(m.start for m in MACHINES)
    number, queue = {start: 0}, [start]
    following: list[int] = []
    out: list[tuple[int, ...]] = []
    for states in queue:
        for c in CLASSES:
            steps = [m.step(s, c) for m, s in zip(MACHINES, states, strict=True)]
            nxt = tuple(s for s, _ in steps)
            if nxt not in number:
                number[nxt] = len(queue)
                queue.append(nxt)
            following.append(number[nxt] * len(CLASSES))
            out.append(tuple(KINDS.index(k) for k in _kinds(*(t for _, t in steps))))
    return following, out


def read_clause(classes: Iterable[int], found: list[int]) -> int:
    """Runs the composed machine over the numbers of a clause's word classes, adds its matches to found; the words read."""
    following, out = compose()
    state = words = 0
    for c in classes:
        at = state + c
        for k in out[at]:
            found[k] += 1
        state = following[at]
        words += 1
    for k in out[state + len(CLASSES) - 1]:
        found[k] += 1
    return words


class Grammar:
    """Lexicon and weights, small enough to travel with a task."""

    def __init__(self, beginnings: tuple[str, ...] = (), weights: dict[str, float] | None = None, bias: float = BIAS):
        self.beginnings, self.bias = tuple(sorted(beginnings)), bias
        self.weights = dict(weights or {k: v - BIAS for k, v in PRIOR.items()})
        lists = {"insult": INSULTS, "threat": THREATS, "will": WILLS, "target": TARGETS, "object": OBJECTS, "them": THEM, "wish": WISHES, "negation": NEGATIONS, "report": REPORTS}
        self.of = {w: CLASSES.index(k) for k, words in lists.items() for w in words}
        lead = "|".join(map(re.escape, self.beginnings))
        whole = "|".join(map(re.escape, sorted(set(INSULTS) | set(THREATS))))
        self.hit = re.compile(rf"(?<![^\W\d_])(?:(?:{whole})(?![^\W\d_])" + (rf"|(?:{lead})" if lead else "") + ")")
        self.lead = re.compile(lead) if lead else None
        self.word = re.compile(r"[^\W\d_]+")
        self.stop = re.compile(f"[{re.escape(STOPS)}]")

    def __getstate__(self):
        return {"beginnings": self.beginnings, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, s):
        self.__init__(s["beginnings"], s["weights"], s["bias"])

    def kind(self, word: str) -> int:
        """The number of a lower-case word's class."""
        k = self.of.get(word)
        if k is None:
            return CLASSES.index("marked") if self.lead is not None and self.lead.match(word) else 0
        return k

    def features(self, text: str) -> list[float]:
        """Matched clauses by kind and how dense they stand, damped: many matches say little more than some.

        Only clauses with a word that a match needs are run; a clause may be the whole text.
        """
        low = text.lower()
        found = [0] * len(KINDS)
        done = 0
        for m in self.hit.finditer(low):
            if m.start() < done:
                continue
            start = max(done, *(low.rfind(x, done, m.start()) + 1 for x in STOPS))
            stop = self.stop.search(low, m.end())
            end = stop.start() if stop else len(low)
            read_clause((self.kind(w[0]) for w in self.word.finditer(low, start, end)), found)
            done = end
        if not done:
            return [0.0] * len(FEATURES)
        n = dict(zip(KINDS, found, strict=True))
        words = max(1, sum(1 for _ in self.word.finditer(low)))
        insults, marked = n["insult_bare"] + n["insult_aimed"] + 2 * n["insult_piled"], n["marked"] + 2 * n["marked_piled"]
        counts = [math.log2(max(1, n[k])) if k in ALONE else math.log2(1 + n[k]) for k in KINDS]
        return counts + [math.log1p(100 * k / words) if k > 1 else 0.0 for k in (insults, marked)]

    def score(self, f: np.ndarray) -> np.ndarray:
        z = self.bias + f @ np.array([self.weights[k] for k in FEATURES])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows that aren't held out; the labels' side of the join is within that bound."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    return shared.cut(one.select("text", "toxic"), "toxicity-fit")


def learn_beginnings(rows: DataFrame, least: int = 5, ratio: float = 10.0, evidence: float = 25.0) -> tuple[str, ...]:
    """Beginnings of marked words: the shortest that toxic rows hold `ratio` times as often a word as others do.

    They stand in `least` toxic rows or more, and so much more often than by chance (a log likelihood ratio of `evidence`).
    Counts cover all rows given; copies of a text, near ones too, count about once, or the words of one much copied toxic
    text would all be learned: of rows with one label that agree in one of three least word hashes one is counted.
    """
    word = re.compile(r"[^\W\d_]+")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_with: dict = {1: Counter(), 0: Counter()}
        words_with: dict = {1: Counter(), 0: Counter()}
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                own = Counter(word.findall(text.lower()))
                kept: Counter = Counter()
                for w, n in own.items():
                    for size in BEGINNINGS:
                        if len(w) >= size:
                            kept[w[:size]] += n
                kept[""] = sum(own.values())
                side = int(label == 1)
                rows_with[side].update(kept.keys())
                words_with[side].update(kept)
        for side in (0, 1):
            own = rows_with[side]
            if own:
                yield pd.DataFrame({"b": list(own), "toxic": side, "n": list(own.values()), "words": [words_with[side][b] for b in own]})

    for seed in range(3):
        least_hash = F.array_min(F.transform(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w, seed=seed: F.xxhash64(F.lit(seed), w)))
        rows = rows.groupBy(least_hash.alias("sketch"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    is_toxic = F.col("toxic") == 1
    sums = [F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).cast("double").alias(name) for side, c, name in ((is_toxic, "n", "t"), (~is_toxic, "n", "c"), (is_toxic, "words", "tw"), (~is_toxic, "words", "cw"))]
    summed = shared.cut(rows.mapInPandas(count, "b string, toxic int, n long, words long").groupBy("b").agg(*sums), "toxicity-words")
    whole = summed.where("b = ''").first()
    if whole is None or not whole["tw"] or not whole["cw"]:
        return ()
    share = (F.col("t") + F.col("c")) / (whole["t"] + whole["c"])
    surprise = 2 * sum(F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (share * whole[k]))).otherwise(0.0) for k in ("t", "c"))
    denser = F.col("tw") / whole["tw"] >= ratio * (F.col("cw") + 1) / whole["cw"]
    pure = summed.where((F.col("b") != "") & (F.col("t") >= least) & denser & (surprise >= evidence)).select("b").collect()
    shared.forget(summed)
    kept: list[str] = []
    for b in sorted((r["b"] for r in pure), key=lambda b: (len(b), b)):
        if not b.startswith(tuple(kept)):
            kept.append(b)
    return tuple(kept)


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 2.0, steps: int = 30) -> tuple[dict[str, float], float]:
    """Logistic regression by Newton steps, with a ridge that draws the logit of one match of each kind to its prior."""
    prior = np.array([*PRIOR.values(), BIAS])
    one = np.eye(len(prior))
    one[:-1, -1] = 1.0  # a text with one match has that kind's weight and the bias
    w = np.linalg.solve(one, prior)
    if len(y):
        a = np.hstack([x, np.ones((len(y), 1))])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) + pull * one.T @ (one @ w - prior)
            h = (a * (p * (1 - p))[:, None]).T @ a + pull * one.T @ one
            w = w - np.linalg.solve(h, g)
    return dict(zip(FEATURES, map(float, w[:-1]), strict=True)), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Grammar:
    """A grammar learned from labelled rows (doc_id, toxic) of docs (doc_id, text)."""
    rows = fit_rows(docs, labels, most)
    grammar = Grammar(learn_beginnings(rows))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"f": [grammar.features(t) for t in batch["text"]], "toxic": batch["toxic"].astype(float)})

    got = rows.mapInPandas(features, "f array<double>, toxic double").toPandas()  # at most `most` rows
    shared.forget(rows)
    x = np.array(got["f"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    weights, bias = fit_weights(x, (got["toxic"].to_numpy() == 1).astype(float))
    return Grammar(grammar.beginnings, weights, bias)


def scored(grammar: Grammar, text: Column) -> Column:
    """The score of each text, which is read whole."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            f = np.array([grammar.features(t) if t else [0.0] * len(FEATURES) for t in batch], dtype=float).reshape(len(batch), len(FEATURES))
            yield pd.Series(grammar.score(f), dtype=float)

    return F.pandas_udf(run, "double")(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's score, learned from rows that aren't held out."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit(docs, shared.table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(grammar, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are predicted toxic go."""
    grammar = fit(docs.select("doc_id", "text"), shared.table(spark, sf_dir, "labels"))
    name = shared.private("score", docs)
    return docs.withColumn(name, scored(grammar, F.col("text"))).where(F.col(name) < THRESHOLD).select(*docs.columns)
