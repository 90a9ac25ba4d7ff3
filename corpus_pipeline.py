"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; of near-duplicates one stays; secrets become marks; documents are repeated or left out as the mix of
sources takes them; what is left becomes token ids.
"""

from __future__ import annotations

from pagelattice.llm import mixing, ngram_join, pieces, secrets, shared, toxicity

#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("secret_scans", secrets.stage),
    ("source_mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]
#: SQL can express neither the learned scores nor the merges; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another over the documents of sf_dir."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return docs
