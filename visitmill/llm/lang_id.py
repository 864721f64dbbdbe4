"""Language identification by error-correcting output codes.

Method: every language gets a codeword; one binary classifier per bit of the codewords weighs hashed letter 2- and 3-grams by the
log odds of its two groups of languages. A text's margins are compared with every codeword by a logistic loss, each bit weighted by
how well it separates that language; the nearest codeword wins, and a second one nearly as near makes the text ambiguous.

The n-gram counts come from all rows given to ``fit``; what reaches the driver is one count for each language and n-gram bucket.

Defined cases: null text, or text without a letter, is ``und`` with score 0. Without any labelled row every text is ``und``. With one
language every text with a letter is that language with score 1. Ties go to the language that sorts first. Rows are independent,
so repeated rows and null ids need no rule; other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitmill.llm.shared import mix, pieces

BUCKETS = 8192
#: A relative lead over the next codeword below this is ambiguous.
LEAD = 0.02


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed 2- and 3-grams of each text (letters in lower case, all else as blanks), and whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in low], dtype=np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    doc = np.repeat(np.arange(len(low)), sizes)
    code = np.where(letter, code, 32).astype(np.uint64)
    out = np.zeros(len(low) * BUCKETS, dtype=np.int64)
    for n in (2, 3):
        if len(code) < n:
            continue
        last = len(code) - n + 1
        key, some = np.full(last, n, dtype=np.uint64), np.zeros(last, dtype=bool)
        for k in range(n):
            key = key * np.uint64(0x200003) + code[k: k + last]
            some |= letter[k: k + last]
        some &= doc[:last] == doc[n - 1:]
        bucket = (mix(key[some]) % np.uint64(BUCKETS)).astype(np.int64)
        out += np.bincount(doc[:last][some] * BUCKETS + bucket, minlength=len(out))
    return out.reshape(len(low), BUCKETS), np.bincount(doc[letter], minlength=len(low)) > 0


def codewords(count: int) -> np.ndarray:
    """+1/-1 rows: all splits of up to 5 languages, else rows of a Hadamard matrix, half of whose bits differ."""
    if count <= 5:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, count - 1))][1:]
        return np.array(bits, dtype=np.int64).T.reshape(count, len(bits))
    matrix = np.ones((1, 1), dtype=np.int64)
    while len(matrix) < count + 1:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[1: count + 1, 1:]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in pieces(batches, rows=256):
        counts, _ = ngram_counts(batch.column("text").to_pylist())
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in set(langs):
            total[lang] = total.get(lang, 0) + counts[langs == lang].sum(axis=0)
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])],
                                         ["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> Model:
    """Learn from the rows with text and lang; all of them are counted."""
    rows = (labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .filter("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(_count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())
    languages = sorted({r.lang for r in rows})
    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in rows:
        counts[languages.index(r.lang), r.bucket] += r.n
    share = counts / counts.sum(axis=1, keepdims=True) if languages else counts
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]))
    for b in range(codes.shape[1]):
        weights[:, b] = np.log(share[codes[:, b] > 0].mean(axis=0)) - np.log(share[codes[:, b] < 0].mean(axis=0))
    # What a text of each language is expected to score on each bit, if it has the right sign.
    trust = np.maximum(codes * (share @ weights), 1e-6)
    return Model(languages, codes, weights, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-12))


def decode(model: Model, counts: np.ndarray, some: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of texts with those counts."""
    n = len(counts)
    if not model.languages:
        return ["und"] * n, np.zeros(n), np.zeros(n, dtype=bool)
    if len(model.languages) == 1:
        return [model.languages[0] if s else "und" for s in some], some.astype(float), np.zeros(n, dtype=bool)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    margin = counts @ model.weights / np.sqrt(total)
    loss = np.stack([(np.logaddexp(0, -margin * code) * trust).sum(axis=1) for code, trust in zip(model.codes, model.trust)], axis=1)
    order = np.argsort(loss, axis=1, kind="stable")
    best, second = (np.take_along_axis(loss, order[:, k: k + 1], axis=1)[:, 0] for k in (0, 1))
    score = np.where(some, (second - best) / np.maximum(second + best, 1e-300), 0.0)
    return ([model.languages[k] if s else "und" for k, s in zip(order[:, 0], some)], np.clip(score, 0, 1), some & (score < LEAD))


RESULT = ("lang_pred", "score", "ambiguous")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs plus lang_pred, score (0 to 1, the lead over the next codeword) and ambiguous. Only text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop(*RESULT).withColumn("text", F.col("text").cast("string"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=256):
            names, score, unsure = decode(shared.value, *ngram_counts(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                                             [*batch.schema.names, *RESULT])

    return own.mapInArrow(task, T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]))
