"""SentencePiece byte-fallback BPE by backtracking over longest matches.

A piece sequence is what the merges give exactly if every piece is its own encoding and so is every adjacent pair. So a
text is read from the left: an Aho-Corasick automaton over the pieces gives the longest one that starts here; it is
kept if the pair with the piece before it re-merges to itself; if not, the next shorter one that starts here is tried;
if none is left, the piece before is given up, its end is marked in a bitfield of failed positions, and the search goes
on one step back. Each position fails at most once.

No piece of such a model has a word-start mark inside or at its end unless it is made of marks alone, so texts fall
apart at the places where marks begin; each part is encoded once a worker and remembered, within a bound.

Nulls and oddities: a null text is an empty text and has no ids; a very long text is encoded whole, in time about
proportional to its length, with memory for its ids; ties of merge scores are settled from the left, as the library does;
repeated rows give repeated results; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The mark that stands for a space in pieces; fixed value.
MARK = "▁"
#: Parts a worker remembers since it last set them apart; it keeps those of before that once more. Longer parts are not remembered.
#: Words take some 200 bytes each.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Pairs of pieces whose check is remembered, likewise.
PAIRS = 200_000
MODEL = "piece_bpe_32k.model"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        odd = {i for i in range(n) if self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i)}
        self.pieces = [self.lib.id_to_piece(i) for i in range(n)]
        self.scores = [self.lib.get_score(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in odd}
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        own = {p for p in self.ids if len(p) == 1 or self._merge(p) == [p]}
        self.own = own
        # backwards, so that a match ending at a place is a piece starting there
        self.automaton = ahocorasick.Automaton()
        # by id: characters of a piece, and the next shorter piece that starts like it
        self.sizes, self.shorter = [len(p) for p in self.pieces], [-1] * n
        for p in own:
            i = self.ids[p]
            self.automaton.add_word(p[::-1], i)
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in own), -1)
        self.automaton.make_automaton()
        self.chars = {p for p in own if len(p) == 1}
        self.pair: dict[int, bool] = {}
        self.older_pair: dict[int, bool] = {}
        # ids of parts, as the bytes of an int32 array
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.names = [str(i) for i in range(n)]
        self.part = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _merge(self, text: str) -> list[str]:
        """The merges themselves: the best-scored adjacent pair first, from the left among equals. For short strings."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                k = self.ids.get(parts[i] + parts[j])
                if k is not None:
                    heapq.heappush(heap, (-self.scores[k], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def fits(self, a: str, b: str) -> bool:
        """Whether the two pieces, side by side, re-merge to themselves."""
        return self._fits(self.ids[a], self.ids[b])

    def _fits(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        found = self.pair.get(key)
        if found is None:
            found = self.older_pair.get(key)
            if found is None:
                x, y = self.pieces[a], self.pieces[b]
                found = self._merge(x + y) == [x, y]
            if len(self.pair) >= PAIRS:
                self.pair, self.older_pair = {}, self.pair
            self.pair[key] = found
        return found

    def _search(self, text: str) -> list[int]:
        """Ids of a stretch in which every character is a piece."""
        n = len(text)
        last_at = n - 1
        # of the matches that end at a place of the reversed text, the longest comes first: going backwards it stays
        longest = dict(reversed([*self.automaton.iter(text[::-1])]))
        sizes, shorter, fits = self.sizes, self.shorter, self._fits
        width, known = len(self.pieces), self.pair.get
        out: list[int] = []
        failed = at = 0
        p, last = longest[last_at], -1
        while at < n:
            while p >= 0:
                end = at + sizes[p]
                if not (failed and failed >> end & 1) and (last < 0 or known(last * width + p) or fits(last, p)):
                    break
                p = shorter[p]
            if p >= 0:
                out.append(p)
                at, last = end, p
                if at < n:
                    p = longest[last_at - at]
                continue
            failed |= 1 << at
            if not out:
                raise ValueError("the pieces do not cover the text")
            p = out.pop()
            at -= sizes[p]
            p, last = shorter[p], out[-1] if out else -1
        return out

    def _part_ids(self, part: str) -> list[int]:
        """Ids of a part; characters that are no pieces become bytes and stand between stretches that merge on their own."""
        if self.chars.issuperset(part):
            return self._search(part)
        ids: list[int] = []
        run = 0
        for i, c in enumerate(part):
            if c not in self.ids:
                if run < i:
                    ids += self._search(part[run:i])
                ids += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                run = i + 1
        if run < len(part):
            ids += self._search(part[run:])
        return ids

    def _lookup(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = self.older.get(part)
            if found is None:
                found = array("i", self._part_ids(part)).tobytes()
            if len(part) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[part] = found
        return found

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.part.findall(marked) if self.splits else [marked]

    def encode_joined(self, text: str) -> tuple[int, str, list[int]]:
        """Number of ids, the ids joined by commas, and the ids."""
        get, look = self.known.get, self._lookup
        ids = np.frombuffer(b"".join([get(p) or look(p) for p in self.parts(text)]), dtype=np.int32).tolist()
        return len(ids), ",".join(map(self.names.__getitem__, ids)), ids

    def encode(self, text: str) -> list[int]:
        return self.encode_joined(text)[2]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker process and model file."""
    return Codec(path)


def encode_texts(docs: DataFrame, model: str | None = None, with_ids: bool = False, release: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids: array<int>) of rows (doc_id, text).

    release: let go of the codec and what it remembers when a task ends, for workers that go on to other work.
    """
    path = model or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path)
        for batch in shared.slices(batches, 1):
            n, hashes, decoded, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                size, joined, ids = own.encode_joined(text or "")
                n.append(size)
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if with_ids:
                    kept.append(pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array([0, *accumulate(n)], pa.int32())
                columns, names = [*columns, pa.ListArray.from_arrays(offsets, pa.concat_arrays([pa.array([], pa.int32()), *kept]))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if release:
            codec.cache_clear()
            del own
            gc.collect()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document encoded and decoded."""
    return encode_texts(shared.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, its last: doc_id, the ids and their digests, in place of the documents' columns; every row stays."""
    return encode_texts(docs, with_ids=True, release=True)
