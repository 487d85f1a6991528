"""Quality rules by weak supervision: rules vote or abstain, and EM weighs their votes.

Each rule says good (+1), bad (-1) or nothing (0) of a document.  Documents with the same votes
are one row of a table of vote patterns, so expectation-maximisation of the rules' accuracies
and of the share of good documents works on at most 3 ** rules rows, whatever the corpus; its
counts cover all documents.  A document is kept if it passes the base rules and its posterior
probability of being good is 0.5 or more.

Null and empty texts have no words: every count is 0, every rule abstains, base_failed holds.
Repeated rows count and come out once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.common import WordHashes, batch_of, batches, mixed, texts
from whence.session import stored

#: (rule, measure, good up to, bad from); in between, or without words, a rule abstains.
RULES = [
    ("symbols", "symbol_share", 0.05, 0.2),
    ("repeats", "repeat_share", 0.05, 0.2),
    ("lines", "dup_line_share", 0.1, 0.3),
    ("letters", "odd_word_share", 0.1, 0.3),
    ("shouting", "upper_word_share", 0.2, 0.6),
    ("length", "length_excess", 0.0, 4.0),
    ("variety", "commonest_share", 0.15, 0.4),
]
_SPACE, _SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
#: A word of letters, perhaps with marks of sentences around it.
_PLAIN = re.compile(r"[(\"'¿¡«]*[^\W\d_]+(?:[-'’][^\W\d_]+)*[.,;:?!)\"'»]*")

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Measures:
    """The base counts of a text and its rules' votes."""

    def __init__(self):
        self.hashes, self.kinds = WordHashes(), {}

    def kind(self, word: bytes) -> int:
        """1 for a word that is not plain, 2 for one in capitals, 3 for both."""
        if (k := self.kinds.get(word)) is None:
            if len(self.kinds) > self.hashes.limit:
                self.kinds.clear()
            text = word.decode(errors="replace")
            k = self.kinds[word] = (not _PLAIN.fullmatch(text)) + 2 * (len(text) > 1 and text.isupper())
        return k

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        if not n:
            return [0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), 0, 0], [0] * len(RULES)
        bare = raw.translate(None, _SPACE)
        chars = len(text) - (len(raw) - len(bare))
        symbols = len(bare) - len(bare.translate(None, _SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
        dup_lines = len(lines) - len(set(lines))
        h = self.hashes.of(words)
        repeated = 0
        if n > 5:
            five = np.zeros(n - 4, np.uint64)
            for k in range(5):
                five = mixed(five + h[k : n - 4 + k])
            _, which, times = np.unique(five, return_inverse=True, return_counts=True)
            edge = np.zeros(n + 1, np.int64)
            again = times[which] > 1
            edge[: n - 4] += again
            edge[5 : n + 1] -= again
            repeated = int(np.count_nonzero(np.cumsum(edge[:n])))
        kinds = np.fromiter(map(self.kind, words), np.int64, n)
        mean = chars / n
        shares = {
            "symbol_share": symbols / n,
            "repeat_share": repeated / n,
            "dup_line_share": dup_lines / len(lines),
            "odd_word_share": np.count_nonzero(kinds & 1) / n,
            "upper_word_share": np.count_nonzero(kinds & 2) / n,
            "length_excess": max(0.0, 2.0 - mean, mean - 12.0),
            "commonest_share": np.unique(h, return_counts=True)[1].max() / n if n >= 20 else 0.3,
        }
        votes = [1 if shares[m] <= good else -1 if shares[m] >= bad else 0 for _, m, good, bad in RULES]
        return [n, chars, symbols, dup_lines, repeated], votes


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, the five base counts, votes: one letter ``+``, ``-`` or ``0`` a rule)."""
    out = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("votes", pa.string())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measures()
        for b in batches(it):
            rows = [measure(t) for t in texts(b)]
            counts = list(map(list, zip(*(c for c, _ in rows), strict=True)))
            yield batch_of(out, (b.column("doc_id"), *counts, ["".join("-0+"[v + 1] for v in votes) for _, votes in rows]))

    kinds = ", ".join(f"{m} long" for m in MEASURES)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(part, f"doc_id long, {kinds}, votes string")


def estimate(patterns: dict[str, int], rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float, dict[str, float]]:
    """(hits, false alarms, share of good documents, posterior of each pattern) by expectation-maximisation.

    A rule's accuracy is a pair: how often its vote is "bad" on bad documents (hits) and on good
    ones (false alarms), where it votes at all; abstaining says nothing.  False alarms stay at 0.05
    or less and hits above them, which fixes which of the two classes is the good one.
    """
    keys = sorted(patterns)
    v = np.array([["-0+".index(c) - 1 for c in k] for k in keys], float).reshape(len(keys), len(RULES))
    n = np.array([patterns[k] for k in keys], float)
    hits, alarms, good = np.full(len(RULES), 0.15), np.full(len(RULES), 0.005), 0.8
    post = np.zeros(len(keys))
    for _ in range(rounds if len(keys) else 0):
        odds = np.log(good / (1 - good)) + (v < 0) @ np.log(alarms / hits) + (v > 0) @ np.log((1 - alarms) / (1 - hits))
        post = 1 / (1 + np.exp(-odds))
        bad = n * (1 - post)
        # a little weight on the first guess, for rules that rarely vote
        new_hits = np.clip((bad @ (v < 0) + 1.5) / (bad @ (v != 0) + 10), 0.05, 0.99)
        new_alarms = np.clip(((n * post) @ (v < 0) + 0.05) / ((n * post) @ (v != 0) + 10), 0.001, np.minimum(0.05, new_hits / 2))
        share = float(np.clip(n @ post / n.sum(), 0.02, 0.98))
        done = max(np.abs(new_hits - hits).max(), np.abs(new_alarms - alarms).max(), abs(share - good)) < 1e-9
        hits, alarms, good = new_hits, new_alarms, share
        if done:
            break
    return hits, alarms, good, dict(zip(keys, map(float, post), strict=True))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, quality: the posterior, kept) of every row."""
    rows = stored(measured(docs), "rules")
    # at most 3 ** len(RULES) rows, by construction of the votes
    patterns = {r.votes: r.n for r in rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    post = estimate(patterns)[3]
    table = F.create_map(*[F.lit(x) for kv in sorted(post.items()) for x in kv]) if post else F.create_map(F.lit(""), F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("quality", table[F.col("votes")])
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("votes")
