"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts a text into chunks at places that depend
only on nearby bytes, so a passage shared by many texts gives the same chunks in
all of them. A worker process keeps one encoder for all the tasks it runs, so a
chunk that texts share, in whatever batch or partition, is encoded once there
and its ids and decoded text are reused while the bounded cache holds it. A cut
may fall inside a word, so the two sides of every join are
encoded again together: the piece that is re-encoded grows to the white space
on either side, which no token of this vocabulary crosses, and there the ids of
both sides and of the whole agree exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import with_workers

#: A cut on average every 2**CUT_BITS bytes.
CUT_BITS = 9
WINDOW = 16
#: Entries of a generation of a worker's caches. A full one becomes the older generation; what is used again moves back.
MAX_WORDS = 1 << 18
MAX_CHUNKS = 1 << 14
#: Longer chunks are encoded without being kept.
MAX_KEPT_CHUNK = 1 << 13
_BLOCK = 1 << 22
_SPACE = re.compile(rb"[\t\n\x0b\x0c\r ]")


def gear_table(seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = gear_table()


def cuts(data: bytes, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of ``data``: where the rolling hash of the last 16 bytes has zeros at its top."""
    ends: list[int] = []
    for a in range(0, len(data), _BLOCK):
        back = min(a, WINDOW)
        h = _GEAR[np.frombuffer(data, np.uint8, min(_BLOCK, len(data) - a) + back, a - back)]
        for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes, each shifted by its place
            h = h + np.concatenate([np.zeros(min(k, len(h)), np.uint32), h[:-k]]) * np.uint32(1 << k)
        ends.extend((np.flatnonzero(h[back:] >> np.uint32(32 - bits) == 0) + a + 1).tolist())
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    return ends


@dataclass
class Reuse:
    """How many chunks, and bytes in them."""

    chunks: int = 0
    size: int = 0

    def add(self, data: bytes) -> None:
        self.chunks += 1
        self.size += len(data)


class ChunkEncoder:
    """Encodes whole texts as the tokenizer does, chunk by chunk.

    The tokenizer must drop white space and let no token cross it.
    """

    def __init__(self, json_text: str, bits: int = CUT_BITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(json_text)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = [self.tok.id_to_token(i) for i in range(size)]
        self.bits = bits
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.older: dict[bytes, tuple[bytes, str]] = {}  # the words before the cache was last emptied
        self.chunks: dict[bytes, tuple[bytes, str]] = {}
        self.older_chunks: dict[bytes, tuple[bytes, str]] = {}
        self.encoded, self.reused = Reuse(), Reuse()

    def pack(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.names[i] for i in ids])

    def core(self, data: bytes) -> tuple[bytes, str]:
        """Ids and decoded text of bytes that begin and end beside white space."""
        if len(self.words) > MAX_WORDS:
            self.words, self.older = {}, self.words
        words, cache = data.split(), self.words
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            self.learn(new)
        got = [cache[w] for w in words]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def learn(self, new: list[bytes]) -> None:
        """Put words into the cache: from the older one, from a word without its last comma or stop, or encoded."""
        cache, older = self.words, self.older
        stems, todo = {}, {}
        for w in new:
            if w in older:
                cache[w] = older[w]
                continue
            # a comma or stop after a letter is a token run of its own
            stem = w[:-1] if w[-1] in b",." and w[-2:-1].isalpha() else w
            stems[w] = stem
            for part in (stem, w[len(stem):]):
                if part and part not in cache:
                    if part in older:
                        cache[part] = older[part]
                    else:
                        todo[part] = None
        if todo:
            texts = [w.decode("utf-8", "replace") for w in todo]
            for w, e in zip(todo, self.tok.encode_batch(texts, add_special_tokens=False)):
                cache[w] = self.pack(e.ids)
        for w, stem in stems.items():
            if w not in cache:
                (a, x), (b, y) = cache[stem], cache[w[len(stem):]]
                cache[w] = (a + b, " ".join(filter(None, (x, y))))

    def chunk(self, data: bytes) -> tuple[bytes, str]:
        got = self.chunks.get(data)
        if got is not None:
            self.reused.add(data)
            return got
        got = self.older_chunks.get(data)
        if got is None:
            got = self.core(data)
            self.encoded.add(data)
        else:
            self.reused.add(data)
        if len(data) <= MAX_KEPT_CHUNK:
            if len(self.chunks) >= MAX_CHUNKS:
                self.chunks, self.older_chunks = {}, self.chunks
            self.chunks[data] = got
        return got

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of a whole text."""
        data = text.encode()
        if b"<|" not in data:  # no special token, whose case counts: the tokenizer ignores case
            data = data.lower()
        parts: list[tuple[bytes, str]] = []
        open_end, a = b"", 0  # bytes after the last white space so far
        for b in cuts(data, self.bits):
            piece, a = data[a:b], b
            first = _SPACE.search(piece)
            if first is None:
                open_end += piece
                continue
            head = first.start()
            last = max(map(piece.rfind, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
            if open_end or head:
                parts.append(self.core(open_end + piece[:head]))  # the join, encoded as a whole
            if last > head:
                parts.append(self.chunk(piece[head:last]))
            open_end = piece[last + 1:]
        if open_end:
            parts.append(self.core(open_end))
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])


_OF_WORKER: dict[str, ChunkEncoder] = {}


def worker_encoder(json_text: str) -> ChunkEncoder:
    """The encoder of this worker process, kept from task to task; another vocabulary replaces it."""
    if json_text not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[json_text] = ChunkEncoder(json_text)
    return _OF_WORKER[json_text]


def encode_decode(df: DataFrame, id_col: str, text_col: str, tokenizer_json: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ``keep_ids``).

    A null text counts as empty: no ids, and the digests of nothing. Texts are
    encoded whole; repeated rows stay; an empty table gives none; other columns
    are not read. The vocabulary file is read on the driver and sent to the
    workers (its size does not grow with the data).
    """
    spark = df.sparkSession
    with_workers(spark)
    with open(tokenizer_json or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(sent.value)
        for b in batches:
            got = [coder.encode(t.as_py() or "") for t in b.column(1)]
            cols = [b.column(0), pa.array([len(g[0]) // 4 for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string()),
                    pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string())]
            names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([np.frombuffer(g[0], "<u4").astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    base = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = f"__id {base.schema['__id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return base.mapInArrow(run, schema + (", ids array<int>, decoded string" if keep_ids else "")).withColumnRenamed("__id", id_col)
