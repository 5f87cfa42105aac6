"""Quality classifier by co-training of a text view and a metadata view.

The text view sees hashed words, word endings and their repetition. The metadata view sees facts about the
page and no word of it: source, language, size, lines and character make-up. The views share no feature.
Both are naive Bayes models over binary features, which are fitted by sums. In each round every unlabelled
document is scored by both views; those on which a view is confident give that view's label to the other
view's next fit, with a weight below that of real labels. (Without the facts of layout, source, language and
size alone tell next to nothing of quality, and co-training with such a view does harm: see the README.)

Scores of each view are calibrated (a logistic curve over the log odds) out of fold: labelled rows fall into
two folds by id, and each is scored by a model that was fitted without it. The calibrated log odds are
added, weighted by how well each view separates the labels it has not seen.

Scale: features are computed once and written down as compact arrays. A round is one map with partial
sums of at most ``2 x features`` numbers per task, view and fold, and one small aggregate: all documents take
part in every round, none is sampled. Only per-feature sums, of fixed number, reach the driver.
Calibration uses a histogram of log odds, also of fixed size.

Defined results: null and empty texts have the features of an empty page and are scored by them; a
document with several labels has the highest; labels other than 0 and 1, labels of unknown ids and null ids
train nothing; if one class has no label at all, every score is 0.5; if a fold has none of a class, its rows
are scored by the full model; repeated rows are scored each; absent columns count as null; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, Words, lean, mix64, text_chunks, text_of

TEXT_FEATURES = 1 << 15
META_FEATURES = 1 << 10
#: The first features of the text view are levels of repetition.
FIXED = 32
ROUNDS = 3
#: A view passes a label on where its calibrated log odds are so far from those of the classes' shares, so that
#: neither class floods the other, and with this weight.
CONFIDENT = 3.0
PSEUDO_WEIGHT = 0.1
#: Labels (16 bytes a row) that may be broadcast.
BROADCAST_ROWS = 1_000_000
BINS = 401
SPREAD = 40.0

_KIND = np.zeros(256, np.int64)  # 1 letter, 2 digit, 3 symbol, 4 punctuation, 5 upper case
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 5 if 65 <= _b <= 90 else 1 if 97 <= _b <= 122 or _b >= 128 else 2 if _c.isdigit() else 3 if _c in "#*$%&|<>@=_{}[]\\^~+/" else 4 if _b > 32 else 0


def _level(x: np.ndarray) -> np.ndarray:
    """Ratios in 0..1 as one of a few levels, finer near 0."""
    return np.searchsorted([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7], x, "left")


def text_features(words: Words) -> list[np.ndarray]:
    """Distinct hashed words and three-byte word endings of each text, and levels of its repetition.

    The first FIXED features are levels: how many words, and how many word pairs, are repeats, and
    how many words equal the one before.
    """
    h, out = words.hashes(), []
    ends = np.zeros(len(h), np.uint64)
    for back in range(1, 4):
        at = np.maximum(words.end - back, words.start)
        ends = mix64(ends * np.uint64(257) + words.data[at])
    pairs = mix64(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    one, two = ((FIXED + x % np.uint64(TEXT_FEATURES - FIXED)).astype(np.int32) for x in (h, ends))
    same = np.concatenate([h[1:] == h[:-1], [False]]) if len(h) else np.zeros(0, bool)
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        n, m = b - a, max(1, b - a - 1)
        shares = [1 - len(np.unique(h[a:b])) / n, 1 - max(1, len(np.unique(pairs[a : b - 1]))) / m, same[a : b - 1].sum() / m] if n else [0.0] * 3
        levels = _level(np.array(shares)) + np.array([0, 10, 20])
        out.append(np.unique(np.concatenate([one[a:b], two[a:b], levels.astype(np.int32)])))
    return out


def meta_features(data: np.ndarray, offsets: np.ndarray, words: Words, source: list, lang: list) -> list[np.ndarray]:
    """Hashed facts of each page: its record, size, lines and character make-up, no word of it."""
    kinds, out = _KIND[data], []
    breaks = np.flatnonzero(data == 10)
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        n = max(1, b - a)
        share = np.bincount(kinds[a:b], minlength=6) / n
        count = int(words.counts[i])
        cut = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        lines = bytes(data[a:b]).split(b"\n")
        facts = [
            f"source={source[i]}", f"lang={lang[i]}", f"size={n.bit_length()}", f"words={count.bit_length()}",
            *(f"k{j}={int(v)}" for j, v in enumerate(_level(share))),
            f"mean={min(20, n // max(1, count))}", f"lines={(len(cut) + 1).bit_length()}",
            f"dup={int(_level(np.array([1 - len(set(lines)) / len(lines)]))[0])}",
        ]
        out.append(np.array(sorted({_fact(f) % META_FEATURES for f in facts}), np.int32))
    return out


@lru_cache(1 << 16)
def _fact(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and, as packed arrays, the features of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                words = Words(data, offsets)
                text = [x.astype("<u2").tobytes() for x in text_features(words)]
                meta = [x.astype("<u2").tobytes() for x in meta_features(data, offsets, words, source[a:b], lang[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "text", "meta"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
        *[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("source", "lang")],
    )
    return rows.mapInArrow(lean(run), "doc_id long, text binary, meta binary")


VIEWS = {"text": TEXT_FEATURES, "meta": META_FEATURES}


class Packed:
    """Features of several rows end to end."""

    def __init__(self, rows: list[bytes]):
        self.sizes = np.array([len(x) // 2 for x in rows], np.int64)
        self.features = np.frombuffer(b"".join(rows), "<u2").astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)


class Model:
    """Naive Bayes over the features that occur; the sum of log odds is divided by the root of their number."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray, real: np.ndarray):
        # Smoothed towards the rate over both classes: a feature that was never seen has no weight.
        rate = (counts + 2.0 * (counts.sum(0) + 0.5) / (totals.sum() + 1.0)) / (totals[:, None] + 2.0)
        self.weights = np.log(rate[1]) - np.log(rate[0])
        # Given labels say what features a class has; how common it is, real ones do.
        self.prior = float(np.log((real[1] + 1) / (real[0] + 1)))
        self.curve, self.trust = (1.0, 0.0), 0.5

    def raw(self, rows: Packed) -> np.ndarray:
        sums = np.bincount(rows.owner, self.weights[rows.features], len(rows.sizes))
        return self.prior + sums / np.sqrt(np.maximum(1, rows.sizes))

    def logit(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(self.curve[0] * raw + self.curve[1], -SPREAD, SPREAD)


#: Folds of labelled rows, and the group of rows that a view has labelled.
FOLDS = 2
GIVEN = FOLDS


def _fold(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Label (-1: none) and fold of each row."""
    y = batch.column("quality").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return y, (mix64(ids + np.uint64(1)) % np.uint64(FOLDS)).astype(np.int64)


def _sums(rows: DataFrame, models: dict | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weighted counts of features by fold, class and view; models: unlabelled rows are scored and count."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = list(VIEWS)
        table = {v: np.zeros((FOLDS + 1) * 2 * (VIEWS[v] + 1)) for v in views}
        for batch in batches:
            label, fold = _fold(batch)
            packed = {v: Packed(batch.column(v).to_pylist()) for v in views}
            for v, other in zip(views, views[::-1]):
                y, w, group = label.copy(), np.ones(len(label)), fold
                if sent.value:  # a view learns from the other one's confident labels
                    teacher = sent.value[other]
                    odds = teacher.logit(teacher.raw(packed[other])) - teacher.prior
                    given = np.where(odds >= CONFIDENT, 1, np.where(odds <= -CONFIDENT, 0, -1))
                    y, w, group = np.where(label >= 0, label, given), np.where(label >= 0, 1.0, PSEUDO_WEIGHT), np.where(label >= 0, fold, GIVEN)
                width = VIEWS[v] + 1
                base = np.where(y >= 0, (group * 2 + y) * width, -1)
                own = base[packed[v].owner]
                used = own >= 0
                n = len(table[v])
                table[v] += np.bincount(own[used] + packed[v].features[used], w[packed[v].owner][used], n)
                table[v] += np.bincount(base[base >= 0] + width - 1, w[base >= 0], n)
        for v in views:
            f = np.flatnonzero(table[v])
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(f), pa.string()), pa.array(f), pa.array(table[v][f])], names=["view", "f", "w"])

    # Sums of whole hundredths do not hang on the order in which tasks end.
    parts = rows.mapInArrow(lean(run), "view string, f long, w double")
    got = parts.groupBy("view", "f").agg(F.sum(F.round(F.col("w") * 100).cast("long")).alias("w")).toPandas()
    out = {}
    for v, n in VIEWS.items():
        table, own = np.zeros((FOLDS + 1) * 2 * (n + 1)), got[got["view"] == v]
        table[own["f"].to_numpy(np.int64)] = own["w"].to_numpy(np.float64) / 100
        table = table.reshape(FOLDS + 1, 2, n + 1)
        out[v] = (table[:, :, :n], table[:, :, n])
    return out


def _calibrate(rows: DataFrame, models: dict, without: dict[str, list]) -> None:
    """Fit each view's curve on a histogram of raw log odds of labelled rows, by the models fitted without them."""
    sent = rows.sparkSession.sparkContext.broadcast(without)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = _fold(batch)
            for v, held_out in sent.value.items():
                packed = Packed(batch.column(v).to_pylist())
                raw = np.choose(fold, [m.raw(packed) for m in held_out])
                at = np.round((np.clip(raw, -SPREAD, SPREAD) + SPREAD) / (2 * SPREAD) * (BINS - 1)).astype(np.int64)
                n = np.bincount(y * BINS + at, minlength=2 * BINS)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["view", "cell", "n"])

    got = rows.filter("quality IS NOT NULL").mapInArrow(lean(run), "view string, cell long, n long").groupBy("view", "cell").agg(F.sum("n").alias("n")).toPandas()
    for v, m in models.items():
        cells = np.zeros(2 * BINS)
        own = got[got["view"] == v]
        cells[own["cell"].to_numpy(np.int64)] = own["n"].to_numpy(np.float64)
        m.curve, m.trust = _curve(cells[:BINS], cells[BINS:])
    whole = sum(m.trust for m in models.values())
    for m in models.values():
        m.trust = m.trust / whole if whole else 1 / len(models)


def _curve(n0: np.ndarray, n1: np.ndarray) -> tuple[tuple[float, float], float]:
    """Logistic curve over histograms of both classes, and the share of the labels' entropy that it explains."""
    centre, (a, b) = np.linspace(-SPREAD, SPREAD, BINS), (1.0, 0.0)
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * centre + b, -SPREAD, SPREAD)))
        w = (n0 + n1) * p * (1 - p)
        g = np.array([((n1 - (n0 + n1) * p) * centre).sum() - 0.01 * a, (n1 - (n0 + n1) * p).sum() - 0.01 * b])
        h = np.array([[(w * centre * centre).sum() + 0.01, (w * centre).sum()], [(w * centre).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    curve = (float(max(a, 0.0)), float(b))
    p = 1 / (1 + np.exp(-np.clip(curve[0] * centre + curve[1], -SPREAD, SPREAD)))
    total = max(1.0, (n0 + n1).sum())
    base = n1.sum() / total
    loss = -(n1 * np.log(p + 1e-12) + n0 * np.log(1 - p + 1e-12)).sum() / total
    plain = -(base * np.log(base + 1e-12) + (1 - base) * np.log(1 - base + 1e-12))
    return curve, float(np.clip(1 - loss / max(plain, 1e-9), 0.0, 1.0))


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Features of every row and its label or null; written down once, for all rounds and the scoring."""
    good = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = good.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    features = featurize(docs)
    return scratch.table(features.join(known, features["doc_id"] == known["_id"], "left").drop("_id"), "views")


def train(rows: DataFrame, rounds: int = ROUNDS) -> dict | None:
    """Models of both views after the given rounds of co-training; None if a class has no label."""
    models = None
    for _ in range(rounds + 1):
        sums = _sums(rows, models)
        if (sums["text"][1][:FOLDS].sum(0) == 0).any():
            return None
        models = {v: Model(counts.sum(0), totals.sum(0), totals[:FOLDS].sum(0)) for v, (counts, totals) in sums.items()}
        without = {}
        for v, (counts, totals) in sums.items():
            rest = [(counts.sum(0) - counts[f], totals.sum(0) - totals[f], totals[:FOLDS].sum(0) - totals[f]) for f in range(FOLDS)]
            without[v] = [Model(*x) if x[2].min() > 0 else models[v] for x in rest]
        _calibrate(rows, models, without)
    return models


def score(features: DataFrame, models: dict | None) -> DataFrame:
    """doc_id, p_text, p_meta, score and label of every row."""
    schema = "doc_id long, p_text double, p_meta double, score double, label int"
    if models is None:
        half = F.lit(0.5)
        return features.select("doc_id", half.alias("p_text"), half.alias("p_meta"), half.alias("score"), F.lit(1).alias("label"))
    sent = features.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = lambda x: 1 / (1 + np.exp(-x))
        for batch in batches:
            logits = {v: m.logit(m.raw(Packed(batch.column(v).to_pylist()))) for v, m in sent.value.items()}
            both = p(2 * sum(m.trust * logits[v] for v, m in sent.value.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(np.round(x, 9), pa.float64()) for x in (p(logits["text"]), p(logits["meta"]), both)], pa.array((both >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "p_text", "p_meta", "score", "label"],
            )

    return features.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    rows = labelled(docs, labels, scratch or Scratch(docs.sparkSession))
    return score(rows, train(rows))
