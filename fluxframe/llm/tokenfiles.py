"""Token ids in binary files: one array of ids, document boundaries in Elias-Fano form.

A file holds documents of one range of doc_id in ascending order (nulls first, repeated ids side by side):

    magic "FXTOK2\0\0", then little-endian u64: documents, ids, bytes an id, lowest doc_id, null doc_ids
    Elias-Fano sequence of document ends (in ids)
    Elias-Fano sequence of doc_id - lowest
    ids, two bytes each if the vocabulary allows, else four

An Elias-Fano sequence of n nondecreasing values below u keeps log2(u / n) low bits of each in an array and the high bits
in unary in a bit vector, 2 + log2(u / n) bits a value. Beside it the file keeps the place of every SAMPLE-th one of the bit
vector in four bytes. select(i) goes from the nearest of these places by popcounts, some(lo, hi) decodes one stretch from
there: offsets need no table of 64-bit words, and a reader decodes no more than the stretch it reads.

write() sorts documents into ranges, encodes and writes in one pass with one shuffle; a range becomes one file or, where
it is large, several. A file's name ends with its task attempt, and only files that the manifest (a table) names count, so
a task that is repeated after a lost executor, or run twice at once, does no harm. The manifest says where each file's ids
start among all.

Ids are those of Tokenizer.encode(text, add_special_tokens=False): the strings of added tokens within a text, such as
"<|endoftext|>", are those tokens (texts are cut there first, as the library does), all else is encoded piece by piece by the
library's model. specials=False encodes such strings as ordinary text, like the library with encode_special_tokens.

Defined results: null texts count as empty, and every document has at least the end id; null doc_ids come first; rows of one
doc_id, or without, are side by side in the order of a hash of their text, over several files if need be; very long texts are
encoded one at a time, whole; an empty table gives no files and no rows; columns other than doc_id and text are not read, so
their names can't clash.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.llm.arrays import release, slices
from fluxframe.llm.pretokens import PieceIds
from fluxframe.llm.tables import at, keep, new_path, table

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"FXTOK2\0\0"
SAMPLE = 256
#: Documents that a reader decodes at once.
READ = 4 * SAMPLE
MANIFEST = "part int, chunk int, file string, n_docs long, n_ids long"


class EliasFano:
    """A nondecreasing sequence of integers from 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        if len(unary) >= 1 << 32:
            raise ValueError("too many values for one file")
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of data, and its size."""
        n, low_bits, a, b = struct.unpack_from("<QQQQ", data)
        raw = np.frombuffer(data, np.uint8, a + b, 32)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), 32 + a + b)
        return cls(n, low_bits, raw[:a], raw[a:], samples), 32 + a + b + samples.nbytes

    def some(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1, from the bits between the samples around them."""
        if lo >= hi:
            return np.zeros(0, np.int64)
        first, after = lo // SAMPLE, -(-hi // SAMPLE)
        byte = int(self.samples[first]) // 8
        to = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[byte:to], bitorder="little")
        bits[: int(self.samples[first]) % 8] = 0  # ones before the sample's
        ones = np.flatnonzero(bits)[lo - first * SAMPLE : hi - first * SAMPLE] + byte * 8
        a, b = lo * self.low_bits, hi * self.low_bits
        low = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(hi - lo, self.low_bits)
        return ((ones - np.arange(lo, hi)) << self.low_bits) + (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Value i, found from the nearest sample."""
        place = int(self.samples[i // SAMPLE])
        byte, left = place // 8, i % SAMPLE
        bits = int(self.high[byte]) >> place % 8 << place % 8
        while left >= (ones := bits.bit_count()):
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        high = byte * 8 + (bits & -bits).bit_length() - 1 - i
        first = i * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return high << self.low_bits | (word >> first % 8) & ((1 << self.low_bits) - 1)


class Encoder:
    """Ids of texts by the tokenizers library: its added tokens, and its model on the pieces between them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in lib.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in lib.get_added_tokens_decoder().values()) or lib.normalizer is not None:
            raise ValueError("added tokens that take more than their own text, or a normalizer")
        # the library takes the first match, and of those at one place the longest
        self.cut = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        model = lib.model
        # the model takes the byte alphabet of its own pre-tokenizer
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        alphabet = dict(zip(shown, shown, strict=True)) | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            joined = "\n".join(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(alphabet) for p in pieces)
            got = [[t.id for t in model.tokenize(p)] for p in joined.split("\n")]
            return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

        self.pieces = PieceIds(encode)

    def __call__(self, texts: list[str], specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the texts' limits in them."""
        if not specials or not self.cut or not any(c in t for c in self.added for t in texts):
            return self.pieces(texts)
        parts, first, found = [], [], []  # texts between added tokens, each text's first one, and the token after each part
        for t in texts:
            first.append(len(parts))
            at_ = 0
            for m in self.cut.finditer(t):
                parts.append(t[at_ : m.start()])
                found.append(self.added[m[0]])
                at_ = m.end()
            parts.append(t[at_:])
            found.append(-1)
        ids, limits = self.pieces(parts)
        after = np.array(found, np.int64)
        more = np.flatnonzero(after >= 0)
        ids = np.insert(ids, limits[1:][more], after[more].astype(np.uint32))
        limits = limits + np.append(0, np.cumsum(after >= 0))
        return ids, limits[np.append(first, len(parts))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    low = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = MAGIC + struct.pack("<QQQqQ", len(doc_ids), len(ids), width, low, len(doc_ids) - len(known))
    names = EliasFano.of(known.astype(np.uint64) - np.uint64(low & (1 << 64) - 1))
    return b"".join([head, EliasFano.of(ends).to_bytes(), names.to_bytes(), ids.astype(f"<u{width}").tobytes()])


class TokenFile:
    """A file's documents, by position or all at once."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, width, self.low, self.nulls = struct.unpack_from("<QQQqQ", view, 8)
        at_ = 48
        self.ends, size = EliasFano.from_bytes(view[at_:])
        self.names, more = EliasFano.from_bytes(view[at_ + size :])
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at_ + size + more)

    def doc_ids(self) -> list[int | None]:
        return self.some_ids(0, self.n_docs)

    def some_ids(self, lo: int, hi: int) -> list[int | None]:
        known = self.names.some(max(0, lo - self.nulls), max(0, hi - self.nulls)) + self.low
        return [None] * (hi - lo - len(known)) + known.tolist()

    def limits(self, lo: int, hi: int) -> np.ndarray:
        """Where documents lo to hi - 1 begin, and where the last of them ends."""
        return np.append(self.ends.select(lo - 1) if lo else 0, self.ends.some(lo, hi))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write(docs: DataFrame, vocabulary: str, out: str, end_id: int = 0, chunk_ids: int = 1 << 22, specials: bool = True) -> DataFrame:
    """Writes docs (doc_id, text) as token files in the shared folder out; returns the manifest with each file's start.

    Ranges of doc_id are Spark's sampled ones. A file is closed once it has chunk_ids ids, so tasks hold that many and one
    document.
    """
    spark = docs.sparkSession
    files = f"{out}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(files)
        fs.create_dir(root)
        context = TaskContext.get()
        part, chunk, names, parts, counts, held = context.partitionId(), 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal chunk, names, parts, counts, held
            ids, ends = np.concatenate(parts), np.cumsum(np.concatenate(counts))
            name = f"part-{part:06d}-{chunk:06d}-{context.taskAttemptId()}.fxt"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(file_bytes(names, ends, ids))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "file": [name], "n_docs": [len(names)], "n_ids": [len(ids)]})
            chunk, names, parts, counts, held = chunk + 1, [], [], [], 0
            return row

        for batch in slices(batches, "text"):
            ids, limits = encoder(vocabulary)([t or "" for t in batch.column("text").to_pylist()], specials)
            n = np.diff(limits)
            parts.append(np.insert(ids, limits[1:], end_id))
            counts.append(n + 1)
            names += batch.column("doc_id").to_pylist()
            held += len(parts[-1])
            if held >= chunk_ids:
                yield close()
        if names:
            yield close()
        encoder(vocabulary).pieces.clear()  # an idle worker keeps no pieces
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows of one doc_id, or without, are dealt over ranges by a hash of their text.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    done = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    manifest = at(spark, keep(done, "token-manifest"), done)
    # The few rows of each part add up first, then the parts: no single task reads all files' rows.
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))
    before = totals.select("part", (F.sum("ids_of_part").over(Window.orderBy("part")) - F.col("ids_of_part")).alias("part_start"))
    start = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids")
    return manifest.withColumn("start", start).join(before, "part").select("file", "n_docs", "n_ids", (F.col("start") + F.col("part_start")).alias("start"))


def read(spark: SparkSession, out: str, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (or, with digest, their crc32) of every document of the files; a task reads one file
    at a time."""
    files = f"{out}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(files)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    found = TokenFile(f.read())
                for lo in range(0, found.n_docs, READ):
                    hi = min(lo + READ, found.n_docs)
                    limits = found.limits(lo, hi)
                    ids = found.ids[limits[0] : limits[-1]]
                    told = {"doc_id": pa.array(found.some_ids(lo, hi), pa.int64()), "start": pa.array(limits[:-1] + start), "n_tokens": pa.array(np.diff(limits))}
                    limits -= limits[0]
                    if digest:
                        wide = ids.astype("<u4")
                        told["ids_crc32"] = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)], pa.int64())
                    else:
                        told["ids"] = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(told)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def op8_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "tokens")
    manifest = write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), out)
    return read(spark, out, manifest, digest=True)
