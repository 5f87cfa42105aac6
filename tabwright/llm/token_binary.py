"""Token ids as flat binary files with 64-bit document offsets.

A data set is a folder with, for each partition, ``part-N.bin`` (unsigned little-endian ids: 16 bits
wide where the vocabulary fits, else 32), ``part-N.idx`` (n + 1 unsigned 64-bit offsets, counted in
ids over the whole data set), ``part-N.doc`` (signed 64-bit document ids) and one ``meta.json``.
Partitions follow each other in ascending document id, so the data set reads like one array.

Writing: rows are range-partitioned and sorted by id; every task encodes its partition in one pass
and writes its files under a temporary name, renamed when complete, so a task that is run again
replaces its own files only. Partition bases are prefix sums over one (documents, ids) row per
partition; a second pass adds the base to each small offset file. Reading maps the files into memory.

Encoding: byte-level BPE never joins across the cut before a blank that a non-blank follows, so
texts are cut there and the pieces looked up in a bounded memo per worker; the tokenizers library
encodes what the memo lacks. Texts with a special token's string go to the library whole.

Defined results: a null or empty text gives just the end id; null ids come first and read back as
null; equal ids are ordered by a hash of the text; repeated rows are written repeatedly; extra columns are
ignored; an empty table gives a data set without partitions.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, kept, lean, local_path, text_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Entries of a worker's memo of pieces, about 200 bytes each; a quarter as many for other pre-tokens.
MEMO_ENTRIES = 800_000
#: Stands for a null id in the .doc files.
NULL_ID = -(2**63)

_CUT = re.compile(r" (?=\S)")
#: A blank that no non-blank follows; a text without one may be cut at every blank.
_BLANK_RUN = re.compile(r" (?:\s|\Z)")
_PRETOKEN = regex.compile(public_tokenizers.PATTERN)


class Encoder:
    """Encodes texts to the bytes of their ids."""

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        top = max(self.library.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if top < 2**16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pre = json.loads(self.library.to_str())
        #: Memos are right only where nothing but the known pattern cuts the text.
        self.plain = pre["normalizer"] is None and pre["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        }
        self.pieces: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Encodings of pieces, a piece being what follows a blank that was cut off.

        A piece of letters only is one pre-token together with its blank. Others are cut into
        pre-tokens, which repeat more often than the pieces do.
        """
        led, bare = self.pieces, self.bare
        cut = {p: _PRETOKEN.findall(" " + p) for p in missing if not p.isalpha()}
        new_led = {p for p in missing if p.isalpha()}
        new_bare = set()
        for tokens in cut.values():
            for t in tokens:
                if t[0] == " ":
                    if t[1:] not in led:
                        new_led.add(t[1:])
                elif t not in bare:
                    new_bare.add(t)
        led_now, bare_now = list(new_led), list(new_bare)
        got_led = dict(zip(led_now, self._direct([" " + t for t in led_now])))
        got_bare = dict(zip(bare_now, self._direct(bare_now)))
        for p, tokens in cut.items():
            ids = [
                (led[t[1:]] if t[1:] in led else got_led[t[1:]]) if t[0] == " " else (bare[t] if t in bare else got_bare[t])
                for t in tokens
            ]
            got_led[p] = b"".join(ids)
        if len(led) + len(got_led) <= MEMO_ENTRIES:
            led.update(got_led)
        if len(bare) + len(got_bare) <= MEMO_ENTRIES // 4:
            bare.update(got_bare)
        return got_led

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._direct(texts)
        out: list[bytes | None] = [None] * len(texts)
        whole, cut = [], []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                whole.append(i)
            else:
                cut.append((i, _CUT.split(text) if _BLANK_RUN.search(text) else text.split(" ")))
        for i, ids in zip(whole, self._direct([texts[i] for i in whole])):
            out[i] = ids
        heads = self._direct([pieces[0] for _, pieces in cut])
        look = self.pieces.get
        rows, missing = [], set()
        for i, pieces in cut:
            got = list(map(look, pieces[1:]))
            if None in got:
                missing.update([p for p, x in zip(pieces[1:], got) if x is None])
            rows.append(got)
        new = self._learn(missing) if missing else {}
        for (i, pieces), got, head in zip(cut, rows, heads):
            if None in got:
                got = [new[p] if x is None else x for p, x in zip(pieces[1:], got)]
            out[i] = head + b"".join(got)
        return out


def encoder(tokenizer_path: str) -> Encoder:
    """The worker's encoder: tasks that follow each other in one worker share its memos."""
    held = kept("token_binary")
    if tokenizer_path not in held:
        held[tokenizer_path] = Encoder(tokenizer_path)
    return held[tokenizer_path]


def write_tokens(docs: DataFrame, out_uri: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_column: str = "doc_id") -> DataFrame:
    """Write the data set; return its partitions: part, docs, ids, base_doc, base_id."""
    spark, out = docs.sparkSession, local_path(out_uri)
    tokenizer_path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
    rows = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of().alias("text"))
        # Range bounds are sampled to the driver: ids and hashes, never texts.
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        os.makedirs(out, exist_ok=True)
        name = f"{out}/part-{part:05d}"
        tmp = f"{out}/.tmp-{part:05d}-{TaskContext.get().taskAttemptId()}"
        end = np.array([end_id], enc.dtype).tobytes()
        docs_done, ids_done = 0, 0
        with open(tmp + ".bin", "wb") as ids, open(tmp + ".idx", "wb") as idx, open(tmp + ".doc", "wb") as doc:
            idx.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                texts = batch.column(1).to_pylist()
                numbers = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                doc.write(numbers.astype("<i8").tobytes())
                at = 0
                while at < len(texts):
                    # A slice of about four million characters, so that memory does not hang on batch size.
                    to, size = at, 0
                    while to < len(texts) and (to == at or size + len(texts[to]) <= 4_000_000):
                        size += len(texts[to])
                        to += 1
                    found = [x + end for x in enc.encode(texts[at:to])]
                    ids.write(b"".join(found))
                    lengths = np.array([len(x) // enc.dtype.itemsize for x in found], np.int64)
                    idx.write((ids_done + np.cumsum(lengths)).astype("<u8").tobytes())
                    ids_done += int(lengths.sum())
                    at = to
                docs_done += len(texts)
        if not docs_done:
            for kind in ("bin", "idx", "doc"):
                os.remove(f"{tmp}.{kind}")
            return
        for kind, final in (("bin", "bin"), ("doc", "doc"), ("idx", "local")):
            os.replace(f"{tmp}.{kind}", f"{name}.{final}")
        yield pa.RecordBatch.from_pylist([{"part": part, "docs": docs_done, "ids": ids_done, "width": enc.dtype.itemsize}])

    os.makedirs(out, exist_ok=True)
    scratch = Scratch(spark)
    written = scratch.table(rows.mapInArrow(lean(write, "token_binary"), "part long, docs long, ids long, width long"), "parts")
    parts, base_doc, base_id = [], 0, 0
    for p in sorted(written.collect(), key=lambda r: r.part):  # one row per partition
        parts.append((p.part, p.docs, p.ids, base_doc, base_id))
        base_doc, base_id = base_doc + p.docs, base_id + p.ids
    width = written.agg(F.max("width")).first()[0] or encoder(tokenizer_path).dtype.itemsize
    scratch.drop()
    with open(f"{out}/meta.json", "w") as f:
        json.dump({"width": width, "docs": base_doc, "ids": base_id, "end_id": end_id, "parts": [dict(zip(("part", "docs", "ids", "base_doc", "base_id"), p)) for p in parts]}, f)
    table = _parts_table(spark, parts)

    def rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                name = f"{out}/part-{p['part']:05d}"
                local = np.fromfile(name + ".local", "<u8")
                tmp = f"{out}/.idx-{p['part']:05d}-{TaskContext.get().taskAttemptId()}"
                (local + np.uint64(p["base_id"])).tofile(tmp)
                os.replace(tmp, name + ".idx")
            yield batch

    table.mapInArrow(lean(rebase, "token_binary"), table.schema).count()
    return table


def _parts_table(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """One row per partition of the data set, dealt to as many tasks."""
    schema = "part int, docs long, ids long, base_doc long, base_id long"
    return spark.createDataFrame(parts, schema).repartition(max(1, len(parts)))


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """One row per document of the data set: doc_id, start, n_tokens, ids_crc32, n_distinct_ids."""
    path = local_path(uri)
    with open(f"{path}/meta.json") as f:
        meta = json.load(f)
    dtype = "<u2" if meta["width"] == 2 else "<u4"
    table = _parts_table(spark, [tuple(p[k] for k in ("part", "docs", "ids", "base_doc", "base_id")) for p in meta["parts"]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                name = f"{path}/part-{p['part']:05d}"
                ids = np.memmap(name + ".bin", dtype, "r")
                idx, doc = np.memmap(name + ".idx", "<u8", "r"), np.memmap(name + ".doc", "<i8", "r")
                for at in range(0, len(doc), 2000):
                    numbers = np.array(doc[at : at + 2000])
                    start = np.array(idx[at : at + len(numbers) + 1]).astype(np.int64)
                    own = start - p["base_id"]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1], own[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(numbers, pa.int64(), mask=numbers == NULL_ID),
                            pa.array(start[:-1], pa.int64()),
                            pa.array(np.diff(start), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return table.mapInArrow(lean(read, "token_binary"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write the documents as a data set in the shared folder and read it back."""
    uri = (scratch or Scratch(docs.sparkSession)).path("tokens")
    write_tokens(docs, uri)
    return read_tokens(docs.sparkSession, uri)
