"""Token counts of a unigram tokenizer by dynamic programming shared along a trie.

The distinct pre-tokens of a slice of texts are put in order, which visits their trie depth first: a
pre-token shares its longest common prefix with the one before it. Scores of the best segmentation
(forward scores) are kept for every prefix of the current branch, so each trie node is computed once,
and the number of pieces at a terminal node is stored as the pre-token's count. A document's count is
the sum over its pre-tokens.

The vocabulary is a public one. Its unigram log probabilities are estimated from the corpus: starting from
Zipf's law over the ranks (``-log(rank + SHIFT)``), the best segmentations of all distinct pre-tokens, times
how often each occurs, give the pieces' counts, smoothed by ``SMOOTH`` (hard expectation-maximisation,
``ROUNDS`` rounds). Bytes of characters without a piece score ``BYTE_SCORE`` each. Ties between segmentations
go to fewer pieces.

Scale: the estimate shuffles distinct pre-tokens only, combined in their tasks; they are range-partitioned
and sorted, so that tries are shared across the whole corpus, and written down once for all rounds. Of it
the driver gets one number a piece. Counting is a map over the scan: nothing is shuffled, however large a
vocabulary of pre-tokens the corpus has. Counts of frequent pre-tokens stay in a bounded memo per worker.

Pre-tokens are split at ASCII white space, as words are elsewhere.

Defined results: null, empty and white-space texts have no tokens; repeated rows and rows with a null
id are counted like any other; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, kept, lean, text_of

VOCABULARY = "piece_bpe_32k.model"
SHIFT = 10.0
BYTE_SCORE = -16.0
ROUNDS = 1
SMOOTH = 0.5
MARK = "▁"
MEMO_ENTRIES = 300_000
SLICE_CHARS = 4_000_000



def bag_of(text: str) -> Counter:
    """How often each pre-token occurs, as UTF-8: bytes are split at ASCII white space only."""
    return Counter(text.encode("utf-8", "surrogatepass").split())


class Counting:
    """Counts of pre-tokens, from piece scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: Pieces as a trie of characters; the empty string leads to the score of the piece that ends there.
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.memo: dict[bytes, int] = {}
        self.nodes = 0

    def trie_counts(self, pretokens: list[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens: one forward step for each node of their trie."""
        return {word: pieces[-1] for word, pieces, _ in self.walk(sorted(pretokens))}

    def walk(self, pretokens: Iterable[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Each of the sorted pre-tokens with the piece counts and last pieces' starts of all its prefixes.

        Beside them each prefix keeps the pieces that have begun in it and may go on: (start, place in their trie).
        """
        root, best, pieces, starts, begun, before = self.root, [0.0], [0], [0], [[]], ""
        for word in pretokens:
            text = MARK + word
            same = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                same += 1
            del best[same + 1 :], pieces[same + 1 :], starts[same + 1 :], begun[same + 1 :]
            self.nodes += len(text) - same
            for end, c in enumerate(text[same:], same + 1):
                size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                top, n, came = best[-1] + BYTE_SCORE * size, pieces[-1] + size, -1
                going = []
                for start, node in (*begun[-1], (end - 1, root)):
                    if (node := node.get(c)) is not None:
                        going.append((start, node))
                        score = node.get("")
                        if score is not None:
                            score += best[start]
                            if score > top or score == top and pieces[start] + 1 < n:
                                top, n, came = score, pieces[start] + 1, start
                best.append(top)
                pieces.append(n)
                starts.append(came)
                begun.append(going)
            yield word, pieces, starts
            before = text

    def segment(self, word: str, starts: list[int]) -> Iterator[str]:
        """Pieces of a pre-token's best segmentation, last first; characters without one are left out."""
        text = MARK + word
        end = len(text)
        while end:
            if starts[end] >= 0:
                yield text[starts[end] : end]
            end = starts[end] if starts[end] >= 0 else end - 1

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(pre-tokens, distinct pre-tokens, tokens) of each text."""
        bags = [bag_of(t) for t in texts]
        new = {w: w.decode("utf-8", "surrogatepass") for bag in bags for w in bag if w not in self.memo}
        counted = self.trie_counts(list(new.values()))
        fresh = {w: counted[t] for w, t in new.items()}
        look = self.memo
        if len(look) + len(fresh) <= MEMO_ENTRIES:
            look.update(fresh)
            fresh = look
        both = lambda w: look[w] if w in look else fresh[w]
        return [(sum(bag.values()), len(bag), sum(n * both(w) for w, n in bag.items())) for bag in bags]


def zipf_scores(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Piece scores from a SentencePiece model's rank order; control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(i + SHIFT) for i, p in enumerate(pieces)}


def pretokens_of(docs: DataFrame) -> DataFrame:
    """Distinct pre-tokens and how often each occurs in all documents."""

    def rows(bag: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in bag], pa.string()), pa.array(list(bag.values()), pa.int64())], names=["pretoken", "n"])
        bag.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                bag.update(text.encode("utf-8", "surrogatepass").split())
                if len(bag) > MEMO_ENTRIES:
                    yield rows(bag)
        if bag:
            yield rows(bag)

    return docs.select(text_of().alias("text")).mapInArrow(lean(run, "token_counts"), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, scores: dict[str, float]) -> dict[str, int]:
    """How often each piece occurs in the best segmentations of all pre-tokens (sorted within partitions)."""
    sent = pretokens.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, found, times = Counting(sent.value), Counter(), []

        def each() -> Iterator[str]:
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    times.append(n)
                    yield word

        for word, _, starts in counting.walk(each()):
            n = times.pop()
            for piece in counting.segment(word, starts):
                found[piece] += n
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])

    sums = pretokens.select("pretoken", "n").mapInArrow(lean(run, "token_counts"), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r.piece: r.n for r in sums.collect()}  # a row a piece of the vocabulary


def corpus_scores(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, scratch: Scratch | None = None) -> dict[str, float]:
    """Unigram log probabilities of the vocabulary's pieces, estimated from all documents."""
    scores = zipf_scores(vocabulary)
    own = (scratch or Scratch(docs.sparkSession)).child()
    pretokens = own.table(pretokens_of(docs).repartitionByRange("pretoken").sortWithinPartitions("pretoken"), "pretokens")
    for _ in range(rounds):
        counts = piece_counts(pretokens, scores)
        total = sum(counts.values()) + SMOOTH * len(scores)
        scores = {p: math.log((counts.get(p, 0) + SMOOTH) / total) for p in scores}
    own.drop()
    return scores


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, scratch: Scratch | None = None) -> DataFrame:
    """For each row: doc_id, n_pretokens, n_distinct, n_tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(corpus_scores(docs, vocabulary, scratch=scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept("token_counts")  # tasks that follow each other in one worker share the memo
        if held.get("scores") != sent._path:
            held.update(scores=sent._path, counting=Counting(sent.value))
        counting = held["counting"]
        for batch in batches:
            texts, rows, at = batch.column(1).to_pylist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_CHARS):
                    size += len(texts[to])
                    to += 1
                rows += counting.count(texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]], names=["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        lean(run, "token_counts"), "doc_id long, n_pretokens long, n_distinct long, n_tokens long"
    )
