"""Byte-pair pieces of a public model, encoded by vectorised merge rounds and decoded by gathering bytes.

Encoding follows the model exactly: white space becomes a mark, one mark stands before the text, and as long as two
neighbouring symbols make a piece, the pair of the best score merges, the leftmost of equal ones first. Pieces
never have a mark after another character, so texts are cut there into words, which cannot influence each other, and
each distinct word is encoded once.

Method: the symbols of many words lie in one flat array, the rank of each neighbouring pair in another. A round takes the least
rank of every word (a segmented minimum), merges all its occurrences there from left to right that do not
overlap, compacts the array, and looks up the ranks of the pairs that are new; words without a pair left are done. Merging
all occurrences at once equals one at a time unless a merge makes a pair of better rank than its own. Pieces of which
that can happen are known from the vocabulary; for them the pairs that a merge brings about are looked at first, and a word merges only
up to the first such place in this round. Runs of marks have pieces of one common, worst score: they come last, and grow from
the left one mark at a time, which has a closed form.

Scale: a map over the scan, without a shuffle; the ids of frequent words stay in a bounded memo per worker, and
the words of a slice of texts in flat arrays. A very long word costs a pass over its symbols for each rank it uses.

Defined results: null and empty texts have no ids and decode to an empty text; characters outside of the vocabulary become
bytes; bytes that form no character decode to U+FFFD each; control pieces and ids outside of the vocabulary
decode to nothing; extra columns are kept.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import kept, lean, text_of, unused

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
NONE = np.int32(2**31 - 1)
MEMO_ENTRIES = 150_000
MEMO_CHARS = 100
SLICE_CHARS = 1_000_000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """Pieces, pair ranks and run table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        score = [model.get_score(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(model.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.ids = {self.pieces[i]: i for i in plain}
        if any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces with a mark after another character are not supported")
        #: Symbols: the model's ids, and after them characters that only longer pieces have.
        self.symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            self.symbols.setdefault(c, len(self.symbols) + self.size)
        runs = {len(p): i for p, i in self.ids.items() if set(p) == {MARK}}
        self.run_ids, self.longest_run = runs, max(runs, default=1)
        ranked = sorted((i for i in plain if len(self.pieces[i]) > 1 and i not in runs.values()), key=lambda i: (-score[i], i))
        if len({score[i] for i in ranked}) < len(ranked) or any(score[i] >= score[r] for i in runs.values() if len(self.pieces[i]) > 1 for r in ranked[-1:]):
            raise ValueError("pieces of equal scores are supported for runs of marks only")
        self.by_rank = np.array(ranked, np.int32)
        rank = {self.pieces[i]: k for k, i in enumerate(ranked)}
        pairs, unsafe = {}, np.zeros(len(ranked), bool)
        for piece, k in rank.items():
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if left in self.symbols and right in self.symbols:
                    pairs[self.symbols[left] << 32 | self.symbols[right]] = k
                    for part in (left, right):
                        if rank.get(part, -1) > k:
                            unsafe[rank[part]] = True
        self.unsafe = unsafe
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        #: Bytes of what each id decodes to, one after the other.
        surface = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        surface[model.unk_id()] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])
        self.silent = np.array([model.is_control(i) for i in range(self.size)])
        self.byte_piece = np.array([model.is_byte(i) for i in range(self.size)])
        self.decimal = [str(i) for i in range(self.size)]
        bare = "".join(c for c in "\n\t\r\f\v" if c not in self.symbols)
        self.word = re.compile(f"{MARK}*[^{MARK}{bare}]+|{MARK}+" + (f"|[{bare}]+" if bare else ""))
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    # ------------------------------------------------------------ encoding

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def run(self, n: int) -> list[int]:
        """Ids of n marks that nothing follows: they grow from the left, one mark at a time, as far as a piece goes;
        where the next length has none, the rest grows until it fits, or stands for itself."""
        whole, n = divmod(n, self.longest_run)
        out = [self.run_ids[self.longest_run]] * whole
        while n:
            take = n
            while take not in self.run_ids:
                take -= 1
            out.append(self.run_ids[take])
            n -= take
        return out

    def words(self, text: str) -> list[str]:
        """A text's words: runs of marks with what follows up to the next mark, or up to white space that is in no piece."""
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def merged(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, by merge rounds over all of them."""
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        kinds, back = np.unique(flat, return_inverse=True)
        known = np.array([self.symbols.get(chr(c), -1 - int(c)) for c in kinds.tolist()], np.int64)
        symbol, done = known[back], [[] for _ in words]
        starts = np.cumsum(lengths) - lengths
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self.rank_of(symbol[:-1], symbol[1:])
        rank[starts[1:] - 1] = NONE
        word = np.arange(len(words))
        while len(word):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                ends = starts + lengths
                for i in np.flatnonzero(over).tolist():
                    done[word[i]] = symbol[starts[i] : ends[i]].tolist()
                stay = np.repeat(~over, lengths)
                symbol, rank = symbol[stay], rank[stay]
                word, lengths, least = word[~over], lengths[~over], least[~over]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), lengths)
            at = np.flatnonzero(rank == least[owner])
            # of occurrences side by side the first, third, ... merge
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) > 1
            first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            if self.unsafe[least].any():
                at = self.up_to_better(symbol, rank, owner, at, least)
            symbol[at] = self.by_rank[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            ends_word = np.zeros(len(symbol), bool)
            ends_word[np.cumsum(lengths) - 1] = True
            ends_word[at[ends_word[at + 1]]] = True
            lengths = lengths - np.bincount(owner[at], minlength=len(word))
            symbol, rank, ends_word = symbol[stay], rank[stay], ends_word[stay]
            at = at - np.arange(len(at))
            before = at[at > 0] - 1
            fresh = np.concatenate([at, before])
            fresh = fresh[~ends_word[fresh]]
            rank[at] = NONE
            rank[fresh] = self.rank_of(symbol[fresh], symbol[fresh + 1])
        return [self.finished(x) for x in done]

    def up_to_better(self, symbol: np.ndarray, rank: np.ndarray, owner: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Of the merges of a round those of each word up to the first that makes a pair of better rank than its own."""
        made = self.by_rank[rank[at]].astype(np.int64)
        own = owner[at]
        after = np.minimum(at + 2, len(symbol) - 1)
        right = np.where((at + 2 < len(symbol)) & (owner[after] == own), self.rank_of(made, symbol[after]), NONE)
        before = np.maximum(at - 1, 0)
        left = symbol[before].copy()
        joined = np.zeros(len(at), bool)
        joined[1:] = (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1])
        left[joined] = made[np.flatnonzero(joined) - 1]
        left = np.where((at > 0) & (owner[before] == own), self.rank_of(left, made), NONE)
        better = np.minimum(left, right) <= least[own]
        if not better.any():
            return at
        stop = np.full(len(least), len(symbol))
        np.minimum.at(stop, own[better], at[better])
        return at[at <= stop[own]]

    def finished(self, symbols: list[int]) -> list[int]:
        """Marks that are left in front make up their runs; characters without an id become bytes."""
        mark = self.symbols.get(MARK)
        n = 0
        while n < len(symbols) and symbols[n] == mark:
            n += 1
        out = self.run(n) if n > 1 else symbols[:n]
        for s in symbols[n:] if n else symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                c = chr(-1 - s) if s < 0 else next(k for k, v in self.symbols.items() if v == s)
                out.extend(self.byte_id[b] for b in c.encode("utf-8", "surrogatepass"))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        memo, fresh = self.memo, []
        for w in set(chain.from_iterable(split)):
            if w not in memo:
                if w in self.older:
                    memo[w] = self.older[w]
                else:
                    fresh.append(w)
        fresh.sort(key=len)
        memo.update(zip(fresh, self.merged(fresh), strict=True) if fresh else ())
        out = [list(chain.from_iterable(map(memo.__getitem__, words))) for words in split]
        for w in reversed(fresh):
            if len(w) <= MEMO_CHARS:
                break
            del memo[w]
        if len(memo) > MEMO_ENTRIES:  # words that go on occurring come back from the older half
            self.older, self.memo = memo, {}
        return out

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the mark of the first piece that is no control piece is not part of it."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        begin, size = self.surface_at[ids], self.surface_at[ids + 1] - self.surface_at[ids]
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data = self.surface[place][int(self.marked[ids[0]]) :].tobytes()
        return data.decode("utf-8", "each_byte")


def model_of(path: str) -> Model:
    """The worker's copy of a model."""
    memory = kept("pieces")
    if path not in memory:
        memory[path] = Model(path)
    return memory[path]


def slices(column: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of bounded length, nulls as empty texts."""
    part, size = [], 0
    for text in column:
        t = text.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str | None = None, column: str = "text", name: str = "ids") -> DataFrame:
    """The table with an array of ids."""
    (made,) = unused(docs, name)
    path = path or public_tokenizers.path(VOCABULARY)
    source = docs.withColumn(made, text_of(column))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            at = batch.num_columns - 1
            start = 0
            for texts in slices(batch.column(at)):
                ids = model.encode(texts)
                sizes = np.array([0, *map(len, ids)]).cumsum()
                values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1])))
                arrays = [c.slice(start, len(texts)) for c in batch.columns[:at]]
                made_ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
                start += len(texts)
                yield pa.RecordBatch.from_arrays([*arrays, made_ids], names=batch.schema.names)

    schema = docs.withColumn(made, F.array().cast("array<int>")).schema
    return source.mapInArrow(lean(run, "pieces"), schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, name: str = "decoded") -> DataFrame:
    """The table with the text of its array of ids; null and empty arrays give an empty text."""
    (made,) = unused(encoded, name)
    path = path or public_tokenizers.path(VOCABULARY)
    source = encoded.withColumn(made, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            at = batch.num_columns - 1
            texts = [model.decode(np.array(x.values.drop_null(), np.int64)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=batch.schema.names)

    schema = encoded.withColumn(made, F.lit("")).schema
    return source.mapInArrow(lean(run, "pieces"), schema)


def digests(docs: DataFrame, path: str | None = None, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_tokens, ids_sha256, decoded_sha256; ids and texts stay in the task that makes them."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            start = 0
            for texts in slices(batch.column(1)):
                counts, first, second = [], [], []
                for ids in model.encode(texts):
                    counts.append(len(ids))
                    first.append(hashlib.sha256(",".join(map(model.decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded = model.decode(np.array(ids, np.int64))
                    second.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                columns = [batch.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                start += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of(column).alias("text_")).mapInArrow(
        lean(run, "pieces"), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
