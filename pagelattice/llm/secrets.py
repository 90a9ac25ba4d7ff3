"""Secret scans: base rules, and a small character convolutional network over every candidate and its context.

The base rules find assignments, access keys and long hex runs; their spans always stay. Candidates are these spans, long
runs of token characters, and values behind a name such as pwd or bearer. The network reads all characters of a candidate
and CONTEXT characters on either side, however long the candidate is. It is trained on labelled findings: texts generated from the
formats below with a fixed seed (the tables hold no labels of secrets), scanned by `candidates` as any text is. A logistic
fit on other such texts calibrates it, and the threshold is the highest that keeps LEAST_RECALL of the secrets planted
in those, the ones that gave no candidate counted as lost. A candidate that reaches it and isn't covered by base spans
becomes a span. Training takes seconds and is repeatable; nothing is learned from the corpus.

Nulls and oddities: a null text is an empty text and has no spans; a very long text or candidate is read whole, in time
in proportion; places count code points, ends are exclusive; of spans that start at one place the order is that of KINDS; of
candidates within one another the longest is kept; repeated rows give repeated results; an empty table gives an empty
table. `scan` ignores extra columns; the stage keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Patterns of the base rules; fixed values.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "net")
#: Candidates of the network: long runs, and values behind other names than the base rules know.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
NAMED = re.compile(
    r"""(?i:(?<![a-z])(?:(?:pwd|pass|passphrase|passcode|pin|auth|authorization|credentials?|(?:private|access|client|signing)[_-]?key)["']?\x20?[:=]\x20?|(?:bearer|basic)\x20))["']?([^\s"'<>]{8,})"""
)

#: Characters on either side of a candidate that the network reads.
CONTEXT = 16
#: Classes of characters: 0 pads, 128 is anything beyond ASCII; those of the context have classes of their own.
CLASSES = 129
WIDTH, CHANNELS, FILTERS = 5, 6, 12
#: Places that are convolved at once.
PLACES = 50_000
LEAST_RECALL = 0.97
#: Generated texts to train on and to calibrate with.
TRAIN_TEXTS, CALIBRATION_TEXTS = 3000, 1500

Span = tuple[int, int, str]


def codes(text: str, start: int, end: int) -> np.ndarray:
    """Classes of the characters around and in text[start:end]."""
    lead, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    raw = np.frombuffer((lead + text[start:end] + after).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = np.maximum(np.minimum(raw, CLASSES - 1), 1).astype(np.int16)
    out = np.zeros(2 * CONTEXT + end - start, dtype=np.int16)
    at = CONTEXT - len(lead)
    out[at : at + len(own)] = own
    out[:CONTEXT] += CLASSES
    out[CONTEXT + end - start :] += CLASSES
    return out


class Net:
    """Embedding, one convolution, maximum and mean over places, a logistic output, and its calibration.

    A filter's sum at a place is that of one table entry for each of the WIDTH characters: the embedding times the weights.
    """

    NAMES = ("e", "w", "b", "v", "c")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.5, (2 * CLASSES, CHANNELS))
        self.w = r.normal(0, 0.3, (WIDTH, CHANNELS, FILTERS))
        self.b = np.zeros(FILTERS)
        self.v = r.normal(0, 0.1, 2 * FILTERS)
        self.c = np.zeros(1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _tables(self) -> np.ndarray:
        return np.einsum("nc,kcf->knf", self.e, self.w)

    def _active(self, tables: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum(sum(tables[k][flat[at + k]] for k in range(WIDTH)) + self.b, 0)

    def pooled(self, rows: list[np.ndarray]) -> np.ndarray:
        """Maximum and mean of each filter over all places of each row."""
        tables = self._tables()
        top, total = np.zeros((len(rows), FILTERS)), np.zeros((len(rows), FILTERS))
        chunk: list[tuple[int, np.ndarray]] = []
        size = 0

        def run() -> None:
            flat = np.concatenate([part for _, part in chunk])
            places = np.array([len(part) - WIDTH + 1 for _, part in chunk])
            first = np.concatenate([[0], np.cumsum(places)[:-1]])
            at = np.arange(places.sum()) + np.repeat(np.arange(len(chunk)) * (WIDTH - 1), places)
            active = self._active(tables, flat, at)
            owner = [i for i, _ in chunk]
            np.maximum.at(top, owner, np.maximum.reduceat(active, first))
            np.add.at(total, owner, np.add.reduceat(active, first))

        for i, row in enumerate(rows):
            for lo in range(0, len(row) - WIDTH + 1, PLACES):
                chunk.append((i, row[lo : lo + PLACES + WIDTH - 1]))
                size += len(chunk[-1][1])
                if size >= PLACES:
                    run()
                    chunk, size = [], 0
        if chunk:
            run()
        return np.hstack([top, total / np.array([len(row) - WIDTH + 1 for row in rows])[:, None]])

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.pooled(rows) @ self.v + self.c if rows else np.zeros(0)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(rows) + self.shift, -30, 30)))

    def _gradients(self, rows: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        flat = np.concatenate(rows)
        places = np.array([len(row) - WIDTH + 1 for row in rows])
        first = np.concatenate([[0], np.cumsum(places)[:-1]])
        owner = np.repeat(np.arange(len(rows)), places)
        at = np.arange(places.sum()) + owner * (WIDTH - 1)
        active = self._active(self._tables(), flat, at)
        top = np.maximum.reduceat(active, first)
        pooled = np.hstack([top, np.add.reduceat(active, first) / places[:, None]])
        dz = (1 / (1 + np.exp(-(pooled @ self.v + self.c))) - y) / len(rows)
        dp = dz[:, None] * self.v
        highest = active == top[owner]
        share = highest / np.add.reduceat(highest.astype(float), first)[owner]
        d = (dp[:, :FILTERS][owner] * share + (dp[:, FILTERS:] / places[:, None])[owner]) * (active > 0)
        tables = np.stack([np.stack([np.bincount(flat[at + k], d[:, f], minlength=2 * CLASSES) for f in range(FILTERS)], axis=1) for k in range(WIDTH)])
        return {
            "v": pooled.T @ dz,
            "c": np.array([dz.sum()]),
            "b": d.sum(0),
            "w": np.einsum("nc,knf->kcf", self.e, tables),
            "e": np.einsum("knf,kcf->nc", tables, self.w),
        }

    def train(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.02, batch: int = 64, seed: int = 6) -> None:
        """Adam on the logistic loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        s = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for i in range(0, len(rows), batch):
                own = order[i : i + batch]
                g = self._gradients([rows[j] for j in own], y[own])
                t += 1
                for k in self.NAMES:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8))

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray, planted: int, least_recall: float = LEAST_RECALL) -> None:
        """A logistic fit of the outputs on rows not trained on, then the highest threshold that keeps enough of the planted secrets."""
        z = self.logits(rows)
        up, down = (y == 1).sum(), (y == 0).sum()
        aim = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        at = np.array([1.0, 0.0])

        def loss(w: np.ndarray) -> float:
            m = w[0] * z + w[1]
            return float((np.logaddexp(0, m) - aim * m).sum())

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -30, 30)))
            d = p * (1 - p) + 1e-9
            g = np.array([((p - aim) * z).sum(), (p - aim).sum()])
            h = np.array([[(d * z * z).sum() + 1e-6, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
                step = step / 2
            at = at - step
        self.scale, self.shift = float(at[0]), float(at[1])
        positive = np.sort(self.scores([row for row, label in zip(rows, y, strict=True) if label == 1]))[::-1]
        needed = min(len(positive), int(np.ceil(planted * least_recall)))
        self.threshold = float(positive[needed - 1])


def labelled_texts(n: int, seed: int) -> Iterator[tuple[str, int, int, bool]]:
    """(text, start, end, secret) of n generated texts; half of them hold a secret at start to end, half something harmless."""
    r = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    one = lambda *s: s[r.integers(0, len(s))]
    size = lambda lo, hi: int(r.integers(lo, hi))
    onsets, vowels, codas = "b c d f g h k l m n p qu r s t v w z sch st ch tr pr gl fr th".split(), "a e i o u ei au ie ou eu".split(), ", ,n,r,s,t,l,m,ch,ng,rt,cht,ff,nd,ck".replace(" ", "").split(",")
    word = lambda: "".join(one(*onsets) + one(*vowels) + one(*codas) for _ in range(size(1, 4)))
    secrets = (
        lambda: one("ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "npm_") + pick(low + up + dig, size(24, 40)),
        lambda: pick(low + up + dig + "+/", size(32, 64)) + one("", "=", "=="),
        lambda: "eyJ" + pick(low + up + dig + "_-", size(40, 300)),
        lambda: pick(low + up + dig, size(24, 48)),
        lambda: pick(low + up, size(28, 48)),
        lambda: one("pwd: ", "pass=", "passphrase: ", "Bearer ", "auth=") + pick(low + up + dig + "!#%&*?", size(10, 24)),
    )
    others = (
        lambda: pick(dig, size(20, 30)),
        lambda: "-".join(word() for _ in range(size(4, 8))) + "-" + pick(dig, size(1, 5)),
        lambda: "/".join(word() for _ in range(size(4, 8))) + pick(dig, size(0, 4)),
        lambda: "_".join(word() for _ in range(size(4, 7))) + pick(dig, size(0, 2)),
        lambda: "".join(word().title() for _ in range(size(5, 8))) + pick(dig, size(0, 3)),
        lambda: "".join(word() for _ in range(size(5, 9))),
        lambda: "-".join(pick(dig, size(2, 6)) for _ in range(size(5, 8))),
        lambda: one("-", "=", "_") * size(20, 60) + pick(dig, size(0, 2)),
        lambda: pick(low + up, size(1, 4)) * size(20, 100),
        lambda: pick("ABCDEF" + dig, 40),
        lambda: "-".join(pick("abcdef" + dig, k) for k in (8, 4, 4, 4, 12)),
        lambda: word() * size(6, 9) + pick(dig, 1),
        lambda: one("pass: ", "pin=", "auth: ", "credentials: ") + "-".join(word() for _ in range(size(3, 5))),
    )
    for i in range(n):
        secret = i % 2 == 1
        value = one(*(secrets if secret else others))()
        lead = " ".join(word() for _ in range(4)) + (one(" ", " ", " key: ", "=") if secret else one(" ", " ", ": ", " https://", "="))
        text = lead + value + one(" ", "\n", '"', ". ") + " ".join(word() for _ in range(3))
        named = NAMED.match(value)
        start = len(lead) + (named.start(1) if named else 0)
        yield text, start, len(lead) + len(value), secret


def findings(n: int, seed: int) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Candidates of n generated texts, whether each is a planted secret, and the number of planted secrets."""
    rows, labels, planted = [], [], 0
    for text, start, end, secret in labelled_texts(n, seed):
        planted += secret
        hit = False
        for s, e in candidates(text, base_spans(text)):
            own = secret and not hit and min(e, end) - max(s, start) >= 0.9 * (end - start)
            hit |= own
            rows.append(codes(text, s, e))
            labels.append(own)
    return rows, np.array(labels, dtype=float), planted


@lru_cache(maxsize=1)
def network() -> Net:
    """The trained and calibrated network; trained once a driver."""
    net = Net()
    net.train(*findings(TRAIN_TEXTS, 11)[:2])
    net.calibrate(*findings(CALIBRATION_TEXTS, 12))
    return net


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base rules, by start and then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """The places of base spans, long runs and named values, without those that lie within another one; by start."""
    every = {(s, e) for s, e, _ in base} | {m.span() for m in RUN.finditer(text)} | {m.span(1) for m in NAMED.finditer(text)}
    out: list[tuple[int, int]] = []
    for s, e in sorted(every, key=lambda c: (c[0], -c[1])):
        if not out or e > out[-1][1]:
            out.append((s, e))
    return out


def with_found(base: list[Span], found: list[tuple[int, int]]) -> list[Span]:
    """Base spans and those found places that base spans don't cover together, in order; both lists are read once."""
    out = list(base)
    i, covered = 0, 0
    for s, e in found:
        at = max(s, covered)
        while i < len(base) and base[i][0] <= at:
            covered = max(covered, base[i][1])
            at = max(at, covered)
            i += 1
        if at < e:
            out.append((s, e, "net"))
    return sorted(out, key=_order)


def all_spans(texts: list[str], net: Net) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    bases = [base_spans(t) for t in texts]
    places = [candidates(t, b) for t, b in zip(texts, bases, strict=True)]
    good = net.scores([codes(t, s, e) for t, own in zip(texts, places, strict=True) for s, e in own]) >= net.threshold
    out, at = [], 0
    for base, own in zip(bases, places, strict=True):
        kept = [p for p, ok in zip(own, good[at : at + len(own)], strict=True) if ok]
        at += len(own)
        out.append((base, with_found(base, kept)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover as one mark; the name in front of an assigned value goes too."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and redacted: string) of rows (doc_id, text)."""
    net = network()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * with_text

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in shared.slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = all_spans(texts, net)
            counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in KINDS[:3]]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts)]
            columns += [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(own) for _, own in found], pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if with_text:
                columns.append(pa.array([redact(t, own) for t, (_, own) in zip(texts, found, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document scanned."""
    return scan(shared.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced by marks; n_chars follows the text; null texts stay null."""
    net = network()
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in shared.slices(batches, at):
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], net)
            out = pa.array([redact(t, own) if own else t for t, (_, own) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(batch.columns)], names=names)

    masked = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return masked.select(*names)
