"""Byte-level BPE by DuckDB: a recursive query contracts pieces, ordered aggregation decodes ids.

encode() works partition by partition. A text is split by public_tokenizers.PATTERN; pieces not met before are joined with
the vocabulary, which answers those that are a token (as the library does), and every other piece becomes token-position
rows (one a byte), which a recursive query joins with the merge table: in each step every word contracts its leftmost pair
of minimum rank, until it has none. The ids of pieces are kept with the pieces in bounded arrays, so that a piece is
contracted once for many texts. decode() joins token-position rows with the vocabulary and aggregates the bytes in order
of position.

A step takes one pair of a word, so a long word would take its length in steps of its length. Words of more than LONG bytes
are therefore first cut where no token holds the two bytes that meet, which no merge can cross. What is still longer is
contracted in overlapping windows, as if they were words, and put together at tokens that two neighbouring windows share.
That is exact: a sequence of tokens is the word's result if each two neighbours are the result of their own bytes (no merge
ever crosses a border that it does not cross within the two tokens beside it), and here each two neighbours come from one
window. Where two windows share no token, one of its own goes on from a token of the first, over up to MOST_REACH windows;
then larger windows are tried (WINDOWS), and at last the whole word.

Defined results: null and empty texts have no ids and decode to nothing; very long texts are taken one at a time, whole;
repeated rows give repeated rows; an empty table gives no rows; all input columns stay, and ids (array<int>) or decoded
(binary) are added, in place of a column of that name whatever its case. Special tokens' strings in a text are ordinary text.
DuckDB has no folder to spill to: the bounds on a batch keep it within MEMORY, or it raises.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxframe.llm.arrays import U64, mix, release, slices
from fluxframe.llm.pretokens import PieceIds
from fluxframe.llm.tables import table

RANKS = "byte_bpe_50k.tiktoken"

LONG, FEW = 48, 16
#: Windows of long words: a window starts in each block of so many bytes, and ends where the third one after it starts.
WINDOWS = (32, 128)
MOST_REACH = 64
#: Words and bytes that are contracted at once.
WORDS, BYTES = 1 << 15, 1 << 18
MEMORY = "96MB"

#: Rows have the key word << 24 | position; positions stay gapless, so a row's right neighbour has the next key.
CONTRACT = """
WITH RECURSIVE t(step, k, tok) USING KEY (k) AS (
    SELECT 0, k, tok FROM start
  UNION ALL
    SELECT step + 1, CASE WHEN k > b.k0 THEN k - 1 ELSE k END, CASE WHEN k = b.k0 THEN b.merged ELSE tok END
    FROM t JOIN (
        SELECT word, (word << 24) | (best & 16777215) AS k0, best >> 24 AS merged
        FROM (
            SELECT l.k >> 24 AS word, min((m.rank::BIGINT << 24) | (l.k & 16777215)) AS best
            FROM t l JOIN t r ON r.k = l.k + 1 JOIN merges m ON m.pair = (l.tok::BIGINT << 32) + r.tok
            GROUP BY 1
        )
    ) b ON b.word = t.k >> 24
    WHERE k <> b.k0 + 1
)
SELECT k >> 24 AS word, tok
FROM t JOIN (SELECT k >> 24 AS w, max(step) AS last FROM t GROUP BY 1) ON w = k >> 24 AND step = last
ORDER BY k
"""

#: For words up to FEW bytes: the rows of all their few steps are kept, which is faster than replacing them by key.
SHORT = CONTRACT.replace(" USING KEY (k)", "")

LOOKUP = "SELECT w, tok FROM words JOIN vocabulary USING (piece)"

DECODE = """
SELECT doc, unhex(string_agg(piece, '' ORDER BY pos)) AS bytes
FROM tokens JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc
"""


@lru_cache(4)
def vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(4)
def merge_table(path: str) -> pa.Table:
    """Every pair of tokens (lhs << 32 | rhs) whose bytes together are a token, and its rank."""
    ids = {t: i for i, t in enumerate(vocabulary(path))}
    rows = [(ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    lhs, rhs, rank = np.array(rows, np.int64).reshape(-1, 3).T
    return pa.table({"pair": lhs << 32 | rhs, "rank": rank.astype(np.int32)})


def windows(data: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of a word begin and end. One begins in each block, where its 8-byte strings hash lowest, at the
    first of equals, so that windows of a periodic word begin alike."""
    blocks = len(data) // block
    wide = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(7, np.uint8)), 8)
    h = mix(np.ascontiguousarray(wide).view(U64)[:, 0])
    at = h[: blocks * block].reshape(blocks, block).argmin(1) + np.arange(blocks) * block
    at[0] = 0
    return at, np.append(at[3:], [len(data)] * min(3, blocks))


class Codec:
    """One DuckDB connection with the merge table and the vocabulary, and the pieces met so far."""

    def __init__(self, path: str) -> None:
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})
        tokens = vocabulary(path)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.byte_ids = np.zeros(256, np.int32)
        self.meet = np.zeros((256, 256), bool)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.byte_ids[t[0]] = i
            else:
                b = np.frombuffer(t, np.uint8)
                self.meet[b[:-1], b[1:]] = True
        self.con.register("m", merge_table(path))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.con.register("v", pa.table({"tok": np.arange(len(tokens), dtype=np.int32), "piece": [t.hex() for t in tokens]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.pieces = PieceIds(self.contract, 1 << 19)

    def contract(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has. A word that is a token has that id alone."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        self.con.register("words", pa.table({"w": np.arange(len(raw)), "piece": [b.hex() for b in raw]}))
        got = self.con.execute(LOOKUP).fetchnumpy()
        self.con.unregister("words")
        whole = np.full(len(words), -1, np.int32)
        whole[np.asarray(got["w"])] = np.asarray(got["tok"])
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(len(words), np.int64)
        if not len(rest):
            return whole, counts
        raw = [raw[i] for i in rest.tolist()]
        sizes = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        part = np.zeros(len(data), bool)
        part[ends - sizes] = True
        if (sizes > LONG).any():
            apart = np.flatnonzero(~self.meet[data[:-1], data[1:]]) + 1
            part[apart[sizes[np.searchsorted(ends, apart, side="right")] > LONG]] = True
        first = np.flatnonzero(part)
        if np.diff(np.append(first, len(data))).max() >= 1 << 24:
            raise ValueError("a piece of 16 MB or more without a place to cut it")
        toks, n_of = self.ids_of(data, np.append(first, len(data)))
        counts[rest] = np.bincount(np.searchsorted(ends, first, side="right"), n_of, len(rest)).astype(np.int64)
        out = np.empty(counts.sum(), np.int32)
        at = np.cumsum(counts) - counts
        done = np.flatnonzero(whole >= 0)
        out[at[done]] = whole[done]
        n = counts[rest]
        out[np.repeat(at[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = toks
        return out, counts

    def ids_of(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of data between the limits, and how many each has."""
        sizes, counts = np.diff(limits), np.zeros(len(limits) - 1, np.int64)
        short = sizes <= 3 * WINDOWS[0]
        toks, counts[short] = self.steps(data, limits[:-1][short], limits[1:][short])
        todo = np.flatnonzero(~short)
        if not len(todo):
            return toks, counts
        found: dict[int, np.ndarray] = {}
        for block in (*WINDOWS, None):
            at, end, of = [], [], []
            for i in todo.tolist():
                x, y = int(limits[i]), int(limits[i + 1])
                a, b = windows(data[x:y], block) if block and y - x > 3 * block else (np.zeros(1, np.int64), np.array([y - x]))
                at.append(a + x)
                end.append(b + x)
                of.append(len(a))
            got, n = self.steps(data, np.concatenate(at), np.concatenate(end))
            last, w, again = np.append(0, np.cumsum(n)), 0, []
            for i, a, b, k in zip(todo.tolist(), at, end, of, strict=True):
                ids = self.joined(data, a, b, [got[last[j] : last[j + 1]] for j in range(w, w + k)])
                w += k
                if ids is None:
                    again.append(i)
                else:
                    found[i] = ids
            todo = np.array(again, np.int64)
            if not len(todo):
                break
        done = np.array(sorted(found))
        counts[done] = [len(found[i]) for i in done.tolist()]
        out = np.empty(counts.sum(), np.int32)
        of_long = np.repeat(~short, counts)
        out[~of_long] = toks
        out[of_long] = np.concatenate([found[i] for i in done.tolist()])
        return out, counts

    def steps(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these ranges of bytes by the recursive query, range by range, and how many each has."""
        few = end - begin <= FEW
        a, counts_a = self._steps(data, begin[few], end[few], SHORT)
        if few.all():
            return a, counts_a
        b, counts_b = self._steps(data, begin[~few], end[~few], CONTRACT)
        counts = np.empty(len(begin), np.int64)
        counts[few], counts[~few] = counts_a, counts_b
        of_few = np.repeat(few, counts)
        toks = np.empty(len(of_few), np.int32)
        toks[of_few], toks[~of_few] = a, b
        return toks, counts

    def _steps(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, query: str) -> tuple[np.ndarray, np.ndarray]:
        counts, toks, lo = np.zeros(len(begin), np.int64), [np.zeros(0, np.int32)], 0
        upto = np.cumsum(end - begin)
        while lo < len(begin):
            hi = min(lo + WORDS, max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BYTES, side="right"))))
            size = end[lo:hi] - begin[lo:hi]
            word = np.repeat(np.arange(hi - lo), size)
            place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            self.con.register("start", pa.table({"k": (word << 24) + place, "tok": self.byte_ids[data[begin[lo:hi][word] + place]]}))
            got = self.con.execute(query).fetchnumpy()
            self.con.unregister("start")
            toks.append(np.asarray(got["tok"]))
            counts[lo:hi] = np.bincount(np.asarray(got["word"]), minlength=hi - lo)
            lo = hi
        return np.concatenate(toks), counts

    def joined(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, ids: list[np.ndarray]) -> np.ndarray | None:
        """The ids of a word from those of its windows, or None where windows share no token."""
        blocks = len(at)
        window = [self.placed(t, x) for t, x in zip(ids, at.tolist(), strict=True)]
        out: list[tuple[int, int]] = []
        now, i, w, reach = window[0], 0, 0, 2
        while w < blocks - 1:
            where = {t: k for k, t in enumerate(window[w + 1])}
            meets = next((k for k in range(i, len(now)) if now[k] in where), None)
            if meets is not None:
                out += now[i:meets]
                now, i, w, reach = window[w + 1], where[now[meets]], w + 1, 2
                continue
            # None in common: a window of its own, from a token of this one on, that reaches over more of the next ones.
            to = min(w + reach, blocks - 1)
            for k in range(i, len(now)):
                own = self.placed(self.steps(data, np.array([now[k][0]]), end[to : to + 1])[0], now[k][0])
                if own[0] == now[k]:
                    break
            else:
                return None
            out += now[i:k]
            now, i, w, reach = own, 0, to, reach * 2
            if reach > MOST_REACH:
                return None
        return np.array([t for _, t in out + now[i:]], np.int32)

    def placed(self, toks: np.ndarray, begin: int) -> list[tuple[int, int]]:
        """Tokens with the bytes at which they begin."""
        sizes = self.sizes[toks]
        return list(zip((np.cumsum(sizes) - sizes + begin).tolist(), toks.tolist(), strict=True))

    def decode(self, ids: np.ndarray, limits: np.ndarray) -> list[bytes]:
        """The bytes of each range of ids."""
        n = len(limits) - 1
        self.con.register("tokens", pa.table({"doc": np.repeat(np.arange(n, dtype=np.int32), np.diff(limits)), "pos": np.arange(len(ids), dtype=np.int64), "tok": ids.astype(np.int32)}))
        got = self.con.execute(DECODE).fetchall()
        self.con.unregister("tokens")
        out = [b""] * n
        for doc, data in got:
            out[doc] = data
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _added(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name.lower() != name] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, f in enumerate(batch.schema) if f.name.lower() != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [column], schema=pa.schema([batch.schema.field(i) for i in keep] + [pa.field(name, column.type)]))


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ids (array<int>) of its text column; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec(path).pieces.clear()  # a task begins without what others left
        for batch in slices(batches, text, 1 << 20):
            ids, limits = codec(path).pieces([x or "" for x in batch.column(text).to_pylist()])
            yield _with(batch, "ids", pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(ids.astype(np.int32))))

    return df.mapInArrow(run, _added(df.schema, "ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary), the bytes of its array of ids; no shuffle. A null array counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            sizes = np.cumsum(np.diff(batch.column(ids).offsets.to_numpy()))
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 19), side="right")))
                part = batch.slice(lo, hi - lo)
                column = part.column(ids)
                lengths = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                limits = np.append(0, np.cumsum(lengths))
                yield _with(part, "decoded", pa.array(codec(path).decode(column.flatten().to_numpy(zero_copy_only=False), limits), pa.binary()))
                lo = hi

    return df.mapInArrow(run, _added(df.schema, "decoded", T.BinaryType()))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of texts that were encoded and decoded again, in one pass, so
    that one worker a task holds one codec. Equal decoded bytes mean that nothing was lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [str(i) for i in range(len(vocabulary(path)))]
        for batch in slices(batches, "text"):
            ids, limits = codec(path).pieces([x or "" for x in batch.column("text").to_pylist()])
            back = [hashlib.sha256(b).hexdigest() for b in codec(path).decode(ids, limits)]
            said = [hashlib.sha256(" ".join(map(names.__getitem__, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(limits).astype(np.int64)), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec(path).pieces.clear()  # an idle worker keeps no pieces
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
