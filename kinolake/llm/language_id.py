"""Language ID by unigram pieces with all segmentations summed.

The pieces are a fixed public vocabulary. For each language, expectation maximisation over every
segmentation of a sample's words gives the piece probabilities; a text's score under a language is the product
over its words of the word's probability, which a forward pass sums over all its segmentations. Equal priors
turn the scores into a distribution over languages.

The sample: of labelled documents that are not held out, the TRAIN_DOCS of each language that come first by a
hash of doc_id (at most TRAIN_ROWS in all, and no more than TRAIN_BYTES of text: a document beyond that is passed over; rows equal in doc_id and text
count once); these bounds are parameters. Every text is then scored whole. Words are lower-case runs of letters, so the vocabulary's pieces with capitals or
digits can't be part of any, and none is longer than LONGEST: all segmentations into the public vocabulary are summed, of words of any length.

A document is held out if crc32 of its doc_id as text leaves 2 modulo 4 (a null doc_id counts as the text ''). Text that is null or has no
letter is `und` with score 0, as is everything when no language was learned. Ties go to the smallest language. Repeated rows and extra
columns change nothing for a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import byte_texts

TRAIN_DOCS = 200
TRAIN_ROWS = 20_000
TRAIN_BYTES = 64_000_000
ROUNDS = 2
SMOOTH = 0.05
UNKNOWN = 1e-7
LONGEST = 16
CACHE = 400_000
#: Texts whose new tokens are scored together.
TOGETHER = 500
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


def vocabulary() -> list[str]:
    """The pieces of up to LONGEST characters, lower case only, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p for p in pieces if len(p) <= LONGEST and p == p.lower() and not re.search(r"[^\W_]*\d", p)})


def words_of(token: str) -> list[str]:
    return [START + w for w in LETTERS.findall(token.lower())]


def learn(counts: Counter, pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces from words (with their start mark) and how often each occurs."""
    index = {p: i for i, p in enumerate(pieces)}
    p = np.full(len(pieces), 1 / len(pieces))
    lattice = []
    for word, times in counts.items():
        if word:
            arcs = [(i, j, k) for i in range(len(word)) for j in range(i + 1, min(len(word), i + LONGEST) + 1) if (k := index.get(word[i:j])) is not None]
            lattice.append((len(word), arcs, times))
    for _ in range(rounds):
        expected, prob = [0.0] * len(pieces), p.tolist()
        for n, arcs, times in lattice:
            if n > 64:  # products of so many probabilities underflow
                _expect_long(n, arcs, times, prob, expected)
                continue
            fwd, bwd = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            starts = {i for i, _, _ in arcs}
            for i, j, k in arcs:
                fwd[j] += fwd[i] * prob[k]
            for i, j, k in reversed(arcs):
                bwd[i] += prob[k] * bwd[j]
            if fwd[n] > 0 and starts:
                scale = times / fwd[n]
                for i, j, k in arcs:
                    expected[k] += fwd[i] * prob[k] * bwd[j] * scale
        e = np.array(expected) + SMOOTH
        p = e / e.sum()
    return np.log(p)


def _expect_long(n: int, arcs: list[tuple], times: int, prob: list[float], expected: list[float]) -> None:
    """Adds the expected uses of the pieces in a long word, in logarithms."""
    fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fwd[0] = bwd[n] = 0.0
    for i, j, k in arcs:
        fwd[j] = np.logaddexp(fwd[j], fwd[i] + math.log(prob[k]))
    for i, j, k in reversed(arcs):
        bwd[i] = np.logaddexp(bwd[i], math.log(prob[k]) + bwd[j])
    if fwd[n] > -np.inf:
        for i, j, k in arcs:
            expected[k] += times * math.exp(fwd[i] + math.log(prob[k]) + bwd[j] - fwd[n])


class Scorer:
    """Log probabilities of texts under each language. White-space tokens are scored once and kept, in a newer and an older half of
    CACHE tokens each; words of one length are scored together."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.n = logs.shape[0]
        self.index = {p: i for i, p in enumerate(pieces)}
        # the last two rows: no piece, and a single character that is no piece
        self.prob = np.concatenate((np.exp(logs).T, np.zeros((1, self.n)), np.full((1, self.n), UNKNOWN)))
        self.none, self.unknown = len(pieces), len(pieces) + 1
        self.known, self.older = {}, {}
        self.table, self.old_table = np.zeros((1024, self.n + 1)), None

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words (with their start mark) of one length, summed over all segmentations."""
        n, get, none = len(words[0]), self.index.get, self.none
        # values of the last LONGEST places only, so a word takes no more memory the longer it is
        fwd: deque[np.ndarray] = deque([np.ones((len(words), self.n))], LONGEST)
        scale = np.zeros((len(words), self.n))
        for j in range(1, n + 1):
            first = max(0, j - LONGEST)
            ids = np.array([get(w[i:j], none) for w in words for i in range(first, j)], np.int64).reshape(len(words), j - first)
            ids[ids[:, -1] == none, -1] = self.unknown
            total = np.zeros((len(words), self.n))
            for k, before in enumerate(fwd):
                total += before * self.prob[ids[:, k]]
            fwd.append(total)
            if j % 16 == 0:  # keep the last values away from underflow
                scale += np.log(total)
                fwd = deque([x / total for x in fwd], LONGEST)
        return np.log(fwd[-1]) + scale

    def learn_tokens(self, tokens: set[bytes]) -> None:
        new = tokens.difference(self.known)
        if not new:
            return
        if len(self.known) > CACHE:
            self.older, self.old_table, self.known, self.table = self.known, self.table, {}, np.zeros((1024, self.n + 1))
            new = tokens
        back = [t for t in new if t in self.older]
        fresh = [t for t in new if t not in self.older]
        runs = [words_of(t.decode("utf-8", "replace")) for t in fresh]
        by_length: dict[int, list[str]] = {}
        for w in {w for r in runs for w in r}:
            by_length.setdefault(len(w), []).append(w)
        score: dict[str, np.ndarray] = {}
        for n, words in by_length.items():
            step = max(1, 400_000 // (n * min(n, LONGEST)))
            for at in range(0, len(words), step):
                score.update(zip(words[at : at + step], self.words(words[at : at + step]), strict=True))
        first, rows = len(self.known), np.zeros((len(fresh), self.n + 1))
        for k, r in enumerate(runs):
            if len(r) == 1:
                rows[k, :-1] = score[r[0]]
                rows[k, -1] = 1
            elif r:
                rows[k, :-1] = np.sum([score[w] for w in r], axis=0)
                rows[k, -1] = len(r)
        if back:
            rows = np.concatenate((rows, self.old_table[[self.older[t] for t in back]]))
        size = first + len(rows)
        if size > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(size, 2 * len(self.table)) - len(self.table), self.n + 1))))
        self.table[first:size] = rows
        self.known.update(zip([*fresh, *back], range(first, size), strict=True))

    def score(self, text: bytes) -> np.ndarray:
        """The text's log probability under each language, and its number of letter runs."""
        tokens = text.split()
        self.learn_tokens(set(tokens))
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        return self.table[at].sum(axis=0)


_SCORERS: dict = {}


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, most_rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, log probabilities by language and piece) from the bounded sample."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).withColumn("tie", F.xxhash64("text"))
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "tie")
    ids = labelled.select("doc_id", "lang", "tie", F.octet_length("text").alias("bytes"), F.row_number().over(place).alias("nth")).where(F.col("nth") <= per_language).orderBy("nth", "lang").limit(most_rows).collect()
    chosen, total = set(), 0
    for r in ids:
        if total + r["bytes"] <= most_bytes and (r["doc_id"], r["tie"]) not in chosen:
            chosen.add((r["doc_id"], r["tie"]))
            total += r["bytes"]
    wanted = labelled.where(F.col("doc_id").isin(sorted({i for i, _ in chosen})) & F.col("tie").isin(sorted({t for _, t in chosen})))
    sample = wanted.dropDuplicates(["doc_id", "lang", "tie"]).select("doc_id", "tie", "lang", "text").collect() if chosen else []
    counts: dict[str, Counter] = {}
    for doc_id, tie, lang, text in sample:
        if (doc_id, tie) in chosen:
            counts.setdefault(lang, Counter()).update(words_of(text))
    langs = sorted(k for k, c in counts.items() if c)
    pieces = vocabulary()
    return langs, pieces, np.array([learn(counts[k], pieces) for k in langs]).reshape(len(langs), len(pieces))


def language_id(docs: DataFrame, carry: bool = False, **kw) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; with carry, all columns of docs and then lang_pred and score."""
    langs, pieces, logs = train(docs, **kw)
    # as large as the vocabulary times the languages, whatever the number of documents
    model = docs.sparkSession.sparkContext.broadcast((langs, pieces, logs))
    key = hash((tuple(langs), logs.tobytes()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model.value[1], model.value[2])
        scorer, names = _SCORERS[key], model.value[0]
        for batch in batches:
            preds, scores, texts = [], [], byte_texts(batch.column("text"))
            for k, text in enumerate(texts):
                if names and k % TOGETHER == 0:
                    scorer.learn_tokens({t for x in texts[k : k + TOGETHER] for t in x.split()})
                s = scorer.score(text) if names else np.zeros(1)
                if not names or s[-1] == 0:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(s[:-1]))
                preds.append(names[best])
                scores.append(float(1 / np.exp(s[:-1] - s[best]).sum()))
            own = {n: batch.column(n) for n in batch.schema.names if carry or n != "text"}
            yield pa.record_batch(own | {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64())})

    if carry:
        return docs.mapInArrow(predict, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
