"""Quality rules: fixed rules on document statistics, then boosted trees over more of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reprise.llm import gbt
from reprise.llm.common import per_document
from reprise.llm.docstats import FEATURES, features
from reprise.llm.labelled import training_rows

#: More of these never makes a text better.
FALLING = ("symbol_share", "dup_line_share", "repeat_word_share", "bang_rate", "bar_rate", "mark_words", "echo_words")
LEAST_WORDS = 50
MOST_REPEATED = 50


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> gbt.Forest:
    """Trees for labels.quality from a bounded sample of labelled rows outside the held-out fold (crc32 of the id modulo 5)."""
    x, y = training_rows(docs, labels, 5, max_labelled)
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    return gbt.fit(x, y, signs)


def apply_rules(docs: DataFrame, forest: gbt.Forest, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: under 50 words, or over half of the words repeated. kept: not base_failed, and the trees'
    probability of quality 1 is at least ``threshold``. A null text has no words and fails; repeated rows and null ids
    are judged row by row; an empty table gives no rows; without usable labels the trees pass everything.
    """
    if not len(forest.roots):
        threshold = 0.0
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def step(rows):
            if not rows["text"]:
                return None
            found = [features(t) for t in rows["text"]]
            base = np.array([b for b, _ in found], np.int64)
            score = forest.probability(np.array([f for _, f in found]))
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            out = {"doc_id": pa.array(rows["doc_id"], pa.int64())} | {k: pa.array(base[:, i]) for i, k in enumerate(counts)}
            return out | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= threshold)), "score": pa.array(score)}

        return step

    return per_document(docs.select("doc_id", "text"), "doc_id long, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean, score double", make)
