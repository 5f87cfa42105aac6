"""Language identification by multilingual mixture inference.

Learning counts letter n-grams inside words per language over all training rows, as sums that are
combined before the shuffle; the model is one table of ``languages x buckets`` smoothed log
probabilities, whose size is fixed. Prediction treats a document as a mixture: each word comes from
one language with the document's proportions, and has the likelihood of its n-grams there.
Expectation-maximisation estimates the proportions; languages enter the set one by one, best first,
as long as the penalised likelihood (BIC) gains. The language of the largest proportion is predicted
and that proportion is the score.

Scale: learning is one map with partial sums and one small aggregate; prediction is one map over the scan.
The model has ``MODEL`` numbers at most whatever the number of languages: beyond ``MODEL / BUCKETS`` of them
it has fewer buckets each. A task holds the counts of ``HELD`` languages at most before it passes them on,
and scores of ``SCORES`` words and languages at once; a longer text is inferred in stretches of so many
words, whose proportions are averaged by words.

Defined results: text null or without a letter gives ``und`` and score 0, as does an empty training set;
rows with a null language train nothing; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Words, lean, mix64, text_chunks, text_of

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Numbers of the whole model, languages of a partial sum, and scores held at once.
MODEL, HELD, SCORES = 1 << 23, 64, 1 << 22
ROUNDS = 12
UNKNOWN = "und"

_CODE = np.random.default_rng(97).integers(1, 2**64, 256, dtype=np.uint64)
_IS_ASCII_LETTER = np.zeros(256, bool)
_IS_ASCII_LETTER[65:91] = _IS_ASCII_LETTER[97:123] = True


def ngram_buckets(words: Words, buckets_: int = BUCKETS, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram inside words ``first`` to ``last`` (a blank at both ends), and the word each belongs to."""
    start, end = words.start[first:last], words.end[first:last]
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Words laid end to end, each between two blanks, in lower-case ASCII.
    size = end - start + 2
    bounds = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    place = np.arange(bounds[-1]) - bounds[:-1][owner]
    source = start[owner] + place - 1
    inner = (place > 0) & (place < size[owner] - 1)
    data = np.full(bounds[-1], 32, np.uint8)
    data[inner] = words.data[source[inner]]
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    keep = (data >= 128) | _IS_ASCII_LETTER[data] | (data == 32)
    coded = _CODE[data]
    buckets, owners = [], []
    for order in ORDERS:
        last = len(data) - order + 1
        acc, ok = np.full(last, order, np.uint64), np.ones(last, bool)
        for j in range(order):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + coded[j : j + last]
            ok &= keep[j : j + last]
        ok &= owner[:last] == owner[order - 1 : order - 1 + last]
        if order == 1:
            ok &= data[:last] != 32
        at = np.flatnonzero(ok)
        buckets.append((mix64(acc[at]) % np.uint64(buckets_)).astype(np.int64))
        owners.append(owner[at])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    return buckets, owners


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x buckets), from columns text and lang."""
    known = rows.filter("lang IS NOT NULL")
    n = known.agg(F.count_distinct("lang")).first()[0]
    size = BUCKETS
    while size * n > MODEL and size > 2:
        size //= 2

    def rows_of(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, row in totals.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(row[used], pa.int64())], names=["lang", "bucket", "n"])
        totals.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, last, data, offsets in text_chunks(batch.column(0)):
                words = Words(data, offsets)
                buckets, owners = ngram_buckets(words, size)
                names, number = np.unique(langs[first:last].astype(str), return_inverse=True)
                of_word = number[words.owner()] if len(words.start) else np.zeros(0, np.int64)
                for j, name in enumerate(names):
                    row = np.bincount(buckets[of_word[owners] == j], minlength=size)
                    totals[name] = totals[name] + row if name in totals else row
                    if len(totals) >= HELD:
                        yield from rows_of(totals)
        yield from rows_of(totals)

    counted = known.select(text_of().alias("text"), "lang").mapInArrow(lean(count), "lang string, bucket long, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # MODEL rows at most
    names = sorted(found["lang"].unique())
    table = np.full((len(names), size), 0.05)
    table[found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    table = np.log(table / table.sum(1, keepdims=True)) if names else table
    return names, table.astype(np.float32)


def _em(like: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of a mixture, like being word likelihoods (words x languages)."""
    n, k = like.shape
    share = np.full(k, 1.0 / k)
    if k == 1:
        return share, float(np.log(like[:, 0]).sum())
    for _ in range(ROUNDS):
        joint = like * share
        share = (joint / joint.sum(1, keepdims=True)).mean(0)
    return share, float(np.log(np.maximum(like @ share, 1e-300)).sum())


def infer(scores: np.ndarray) -> np.ndarray:
    """Proportions of the languages in one document, from log scores of its words (words x languages)."""
    n, k = scores.shape
    like = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))
    share = np.zeros(k)
    chosen = [int(scores.sum(0).argmax())]
    part, best = _em(like[:, chosen])
    while len(chosen) < k and n > 1:
        # The language whose words gain most over the present set comes next.
        gain = np.maximum(like - (like[:, chosen] @ part)[:, None], 0).sum(0)
        gain[chosen] = -1
        trial = [*chosen, int(gain.argmax())]
        more, value = _em(like[:, trial])
        if value - best <= 0.5 * math.log(n) + 1e-9:
            break
        chosen, part, best = trial, more, value
    # One that came early may not be worth its place beside those that came later.
    while len(chosen) > 2:
        less = [(*_em(like[:, [c for c in chosen if c != out]]), out) for out in chosen]
        fewer, value, out = max(less, key=lambda x: x[1])
        if best - value > 0.5 * math.log(n):
            break
        chosen, part, best = [c for c in chosen if c != out], fewer, value
    share[chosen] = part
    return share


def shares(words: Words, model: np.ndarray) -> Iterator[np.ndarray | None]:
    """Proportions of the languages in each text, None for a text without words; model: buckets x languages."""
    size, k = model.shape
    most = max(1, SCORES // max(1, k))

    def scores(a: int, b: int) -> np.ndarray:
        buckets, owners = ngram_buckets(words, size, a, b)
        return np.stack([np.bincount(owners, model[buckets, j], b - a) for j in range(k)], 1)

    i, texts = 0, len(words.counts)
    while i < texts:
        j = max(i + 1, int(np.searchsorted(words.bounds, words.bounds[i] + most, "right")) - 1)
        a, b = int(words.bounds[i]), int(words.bounds[j])
        if b - a > most:  # one long text
            parts = [(infer(scores(x, min(b, x + most))), min(b, x + most) - x) for x in range(a, b, most)]
            yield sum(p * n for p, n in parts) / (b - a)
        elif k and b > a:
            table = scores(a, b)
            for x, y in zip(words.bounds[i:j] - a, words.bounds[i + 1 : j + 1] - a):
                yield infer(table[x:y]) if y > x else None
        else:
            yield from [None] * (j - i)
        i = j


def predict(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the proportions of the chosen languages as text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(table.T))  # buckets x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            names, best, mixes = [], [], []
            letters = batch.column("has_letter").to_pylist()
            for first, last, data, offsets in text_chunks(batch.column("text"), 400_000):
                for i, share in enumerate(shares(Words(data, offsets), model)):
                    if share is None or not letters[first + i]:
                        names.append(UNKNOWN)
                        best.append(0.0)
                        mixes.append("")
                        continue
                    top = int(share.argmax())
                    names.append(languages[top])
                    best.append(float(min(1.0, share[top])))
                    mixes.append(",".join(f"{languages[j]}:{share[j]:.4f}" for j in np.argsort(-share, kind="stable") if share[j] > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(mixes, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "mixture"],
            )

    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(is_held_out(), F.lit(False)).alias("held_out"),
        text.rlike(r"\p{L}").alias("has_letter"),
        text.alias("text"),
    )
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, mixture string")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and have a language; predict every row."""
    training = docs.filter(~F.coalesce(is_held_out(), F.lit(False)))
    return predict(docs, *learn(training.select("text", F.col("lang").cast("string").alias("lang"))))
