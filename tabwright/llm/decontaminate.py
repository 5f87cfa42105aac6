"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over up to 13 consecutive words; it hashes the words at its set positions and
ignores the others, so a substituted word at an ignored position does not hide a hit. The masks are a
covering set, found by greedy search and checked by enumeration: wherever at least ``PERCENT`` of
``SPAN`` to ``WINDOW`` aligned words agree, some mask lies among them whole, so no passage that would
verify goes without a hit.

1. ``seeds``: (hash, item, place) of every window of every benchmark item.
2. ``hits``: every document window whose hash may be a seed's, told by a bitmap of bounded size that goes
   to the tasks, leaves the scan as a slim row (document, hash, place); these are joined with the seeds.
   Equal hashes at even steps are one row on both sides, so that a text that repeats itself does not meet a repetitive
   item once for each pair of repetitions. Only the distinct diagonals (document, item, shifts) of the join go on.
3. ``verified``: each diagonal is compared word by word. The overlap counts where at least ``PERCENT`` of
   ``WINDOW`` aligned words agree (of the whole item or document where that is shorter, but of ``SPAN`` at
   least). Words of an item beyond the document's edge count as disagreeing: what a cut document still
   holds of an item is judged like a passage in its middle.

Scale: the benchmark is a table like any other, of any size; nothing of it but the bitmap passes the
driver. Documents are read twice in place, and no text is shuffled while the rows to join (seeds,
documents with a diagonal) are few enough to be broadcast; beyond that the joins shuffle. A bitmap too
full for a huge benchmark lets more windows through to the join and loses none.

Words: lower-cased A-Z, split at ASCII white space, cleaned of nothing else. Defined results: null and
empty texts have no hits; an item of fewer than ``SPAN`` words is looked for as a whole, exactly; items
without words (or null ones) never hit; repeated items each hit; an item with a null id contaminates,
and is on no list of ids; repeated rows each get a row; rows of equal or null ids are judged each by
its own text; extra columns are kept or ignored, whatever their names; an empty benchmark leaves every
document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, Words, lean, mix64, text_chunks, text_of

#: Items of fewer words are looked for as a whole.
SPAN = 12
#: Positions that each mask reads; the first is 0.
MASKS = [
    np.array(m)
    for m in (
        (0, 1, 2, 3, 5, 6, 7), (0, 1, 3, 7, 9, 10, 11), (0, 1, 2, 4, 5, 9, 10), (0, 1, 4, 6, 9, 11, 12),
        (0, 1, 2, 4, 5, 7, 8), (0, 1, 4, 6, 7, 8, 9), (0, 1, 2, 3, 4, 7, 8),
    )
]
#: Verified stretch of aligned words, and the share of them that has to agree.
WINDOW = 20
PERCENT = 80
#: Bits of the bitmap for each seed, and for all of them at most (16 MB).
BITS_EACH, BITS = 32, 1 << 27
#: Rows (seeds of 40 bytes, keys of 16 bytes) that may be broadcast, and bytes of items' words and shifts.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 16_000_000

KEY = ("doc_id", "text_hash")


def seed_hashes(h: np.ndarray, mask: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the masked words at each window of the mask's span."""
    n = len(h) - int(mask[-1])
    acc = np.full(max(n, 0), salt + 1, np.uint64)
    for p in mask if n > 0 else ():
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[p : p + n])
    return acc


def masks_for(words: int) -> list[tuple[np.ndarray, int]]:
    """Masks and salts by which an item of so many words is looked for."""
    if words >= SPAN:
        return [(m, salt) for salt, m in enumerate(MASKS)]
    return [(np.arange(words), len(MASKS) + words)] if words else []


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    again = mix64(h)
    for x in (h, h >> np.uint64(32), again, again >> np.uint64(32)):
        yield x & np.uint64(bits - 1)


def progressions(owner: np.ndarray, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal hashes of one owner at even steps, put together: index of the first of each, step, and how many there are.

    A text that repeats itself has as many windows of one hash as it has repetitions, but few progressions of them.
    """
    by = np.lexsort((place, h, owner))
    o, x, at = owner[by], h[by], place[by]
    gap, same = np.zeros(len(by), np.int64), np.zeros(len(by), bool)
    same[1:] = (o[1:] == o[:-1]) & (x[1:] == x[:-1])
    gap[1:] = np.where(same[1:], at[1:] - at[:-1], 0)
    goes_on = np.zeros(len(by), bool)
    goes_on[2:] = same[2:] & same[1:-1] & (gap[2:] == gap[1:-1])
    first = np.flatnonzero(~goes_on)
    count = np.diff(np.append(first, len(by)))
    step = np.where(count > 1, gap[np.minimum(first + 1, max(0, len(by) - 1))], 1) if len(by) else count
    return by[first], step.astype(np.int64), count.astype(np.int64)


def items_of(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each item with words: key, item_id, n_words and word hashes, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes = [], []
            for _, _, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets)
                h = words.hashes()
                counts += words.counts.tolist()
                hashes += [h[a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary())], names=["item", "item_id", "n_words", "words"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    return scratch.table(rows.mapInArrow(lean(run), "item long, item_id long, n_words long, words binary").filter("n_words > 0"), "items")


def seeds_of(items: DataFrame, scratch: Scratch) -> DataFrame:
    """hash, item and place of every window of the items, equal ones at even steps as one row (place, step, count), written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(packed, "<u8")
                for mask, salt in masks_for(len(h)):
                    own = seed_hashes(h, mask, salt).view(np.int64)
                    at, step, count = progressions(np.zeros(len(own), np.int64), own, np.arange(len(own)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at]), pa.array(np.full(len(at), item)), pa.array(at.astype(np.int64)), pa.array(step), pa.array(count)],
                        names=["hash", "item", "place", "step", "count"],
                    )

    return scratch.table(items.select("item", "words").mapInArrow(lean(run), "hash long, item long, place long, step long, count long"), "seeds")


def bitmap_of(seeds: DataFrame, n: int) -> np.ndarray:
    """Bytes of a bitmap in which each seed's hash has set its probes; or-ed before it reaches the driver."""
    bits = 1 << min(BITS.bit_length() - 1, max(10, (BITS_EACH * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(list(_probes(h, bits))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    got = seeds.select("hash").mapInArrow(lean(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


def maybe_seeds(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the hashes whose probes are all set."""
    at = np.arange(len(h))
    for i in range(4):
        p = list(_probes(h[at], 8 * len(bitmap)))[i] if i else h & np.uint64(8 * len(bitmap) - 1)
        at = at[(bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
    return at


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))


def hits(docs: DataFrame, bitmap: np.ndarray, masks: list[tuple[np.ndarray, int]]) -> DataFrame:
    """doc_id, text_hash, hash and place (word number) of every document window that may be a seed, as in ``seeds_of``."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets)
                h, owner = words.hashes(), words.owner()
                for mask, salt in masks:
                    own = seed_hashes(h, mask, salt)
                    at = maybe_seeds(own, sent.value)
                    at = at[owner[at] == owner[at + int(mask[-1])]]
                    if len(at):
                        one, step, count = progressions(owner[at], own[at], at)
                        at = at[one]
                        rows = pa.array(first + owner[at])
                        place = (at - words.bounds[owner[at]]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, (own[at].view(np.int64), place, step, count))],
                            names=[*KEY, "hash", "place", "step", "count"],
                        )

    return _keyed(docs).mapInArrow(lean(run), "doc_id long, text_hash long, hash long, place long, step long, count long")


def diagonals_of(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """KEY, item and the shifts at which a document's and an item's equal hashes meet: from ``shift`` on ``count`` of them, ``step`` apart.

    Two progressions of one step meet on one progression of shifts, so their product is never formed. Of two with different steps the
    shorter is taken apart.
    """
    doc = found.withColumnsRenamed({"place": "_at", "step": "_step", "count": "_count"})
    met = doc.join(seeds, "hash")
    both = (F.col("count") > 1) & (F.col("_count") > 1)
    odd = both & (F.col("step") != F.col("_step"))
    none = F.array(F.lit(0).cast("long"))
    parts = F.when(odd, F.sequence(F.lit(0).cast("long"), F.least("count", "_count") - 1)).otherwise(none)
    met = met.select("*", F.explode(parts).alias("_i"))
    own = odd & (F.col("_count") <= F.col("count"))  # the document's side is taken apart
    at = F.col("_at") + F.when(own, F.col("_i") * F.col("_step")).otherwise(0)
    n_doc = F.when(own, 1).otherwise(F.col("_count"))
    place = F.col("place") + F.when(odd & ~own, F.col("_i") * F.col("step")).otherwise(0)
    n_item = F.when(odd & ~own, 1).otherwise(F.col("count"))
    step = F.when(n_doc > 1, F.col("_step")).when(n_item > 1, F.col("step")).otherwise(1)
    least = at - place - F.when(n_item > 1, F.col("step") * (n_item - 1)).otherwise(0)
    return met.select(*KEY, "item", least.alias("shift"), step.alias("step"), (n_doc + n_item - 1).alias("count")).distinct()


def agreement(h: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Agreeing words of a diagonal if it verifies, else 0: word j of the item lies on word j + shift."""
    n, m = len(h), len(item)
    same = np.zeros(m + 1, np.int64)
    a, b = max(0, -shift), min(m, n - shift)
    if b > a:
        same[a + 1 : b + 1] = h[a + shift : b + shift] == item[a:b]
    sums = np.cumsum(same)
    width = min(WINDOW, m, max(n, SPAN)) if m >= SPAN else m
    most = int((sums[width:] - sums[: m + 1 - width]).max())
    return int(sums[-1]) if (100 * most >= PERCENT * width if m >= SPAN else most == m) else 0


def most_agreeing(h: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> int:
    """Agreeing words of the best of several diagonals; none can have more than the item has words, or the document."""
    best, bound = 0, min(len(h), len(item))
    for shift in shifts.tolist():
        if (n := agreement(h, item, shift)) > best:
            best = n
            if best == bound:
                break
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each document and item that overlap: doc_id, text_hash, item, item_id, n_same (agreeing words)."""
    scratch = scratch or Scratch(docs.sparkSession)
    items = items_of(benchmark, scratch)
    seeds = seeds_of(items, scratch)
    n = seeds.count()
    lengths = [r[0] for r in items.select(F.least("n_words", F.lit(SPAN))).distinct().collect()]  # SPAN rows at most
    found = hits(docs, bitmap_of(seeds, n), [m for length in sorted(lengths) for m in masks_for(length)])
    diagonals = scratch.table(diagonals_of(found, F.broadcast(seeds) if n <= BROADCAST_ROWS else seeds), "diagonals")
    shifts = diagonals.groupBy(*KEY, "item").agg(F.collect_list(F.struct("shift", "step", "count")).alias("shifts"))
    full = scratch.table(shifts.join(items.select("item", "item_id", "words"), "item"), "pairs")  # an item's words once for each document
    wanted = full.groupBy(*[F.col(k).alias("_" + k) for k in KEY]).agg(F.collect_list(F.struct("item", "item_id", "shifts", "words")).alias("_to"))
    size = full.agg(F.sum(F.length("words") + 24 * F.size("shifts") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = _keyed(docs)
    own = texts["doc_id"].eqNullSafe(F.col("_doc_id")) & (texts["text_hash"] == F.col("_text_hash"))
    rows = texts.join(wanted, own).select(*KEY, "text", *[F.col(f"_to.{c}").alias(c) for c in ("item", "item_id", "shifts", "words")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, ids, same = [], [], [], []
            lists = [batch.column(c).to_pylist() for c in ("item", "item_id", "shifts", "words")]
            for first, last, data, offsets in text_chunks(batch.column("text")):
                words = Words(data, offsets)
                h = words.hashes()
                for i in range(first, last):
                    own = h[words.bounds[i - first] : words.bounds[i - first + 1]]
                    best: dict[int, tuple] = {}
                    for item, item_id, shifts, packed in zip(*(x[i] for x in lists)):
                        words_of_item = np.frombuffer(packed, "<u8")
                        every = np.unique(np.concatenate([s["shift"] + s["step"] * np.arange(s["count"]) for s in shifts]))
                        n = most_agreeing(own, words_of_item, every)
                        if n > best.get(item, (0,))[0]:
                            best[item] = (n, item_id)
                    at += [i] * len(best)
                    names += best
                    ids += [v[1] for v in best.values()]
                    same += [v[0] for v in best.values()]
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(same, pa.int64())], names=[*KEY, "item", "item_id", "n_same"])

    return rows.mapInArrow(lean(verify), "doc_id long, text_hash long, item long, item_id long, n_same long")


def report(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """For each contaminated document: doc_id, text_hash, its items in order, and the longest overlap in words."""
    return overlaps(docs, benchmark, scratch).groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("n_same").alias("n_same"))


def _same_row(docs: DataFrame, found: DataFrame) -> Column:
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (own == found["_h"])


def judge(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """For each row: doc_id, contaminated, item_ids (empty if clean) and n_same (0 if clean)."""
    found = report(docs, benchmark, scratch).withColumnsRenamed({"doc_id": "_id", "text_hash": "_h"})
    # The hash is taken below the join: only ids and hashes are shuffled, no texts.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["text_hash"] == found["_h"]), "left")
    return out.select(
        "doc_id",
        F.col("n_same").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("n_same", F.lit(0).cast("long")).alias("n_same"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The documents without overlap, with the columns of ``docs``.

    The keys to drop are written down and counted: while they can be broadcast, no text is shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.table(report(docs, benchmark, scratch).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")), "contaminated")
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, _same_row(docs, found), "left_anti")
