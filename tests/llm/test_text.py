"""Text primitives, BPE and token files against the tokenizer libraries."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fluxframe.llm import bpe, pretokens, tokenfiles
from fluxframe.llm.arrays import slices, text_bytes, words
from fluxframe.llm.tables import new_path

PATH, VOCABULARY = public_tokenizers.path(bpe.RANKS), public_tokenizers.path(tokenfiles.VOCABULARY)
ODD = ["", "a", "  a\n\nb 's'll it's 'S", "<|endoftext|>", "x" * 500, "\U0001f600é漢" * 20, "a\x00b\x1cc", " ", "\n \n", "1" * 70 + "２３", "don't 're''ve"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(VOCABULARY)


def parts(ids, limits):
    return [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="  \n\t''sdrevlmtaZ9!?é　漢.", max_size=12), max_size=6))
def test_pieces(texts):
    joined = "".join(texts)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]).astype(int)) if texts else np.zeros(1, int)
    start = pretokens.pieces(np.frombuffer(joined.encode("utf-32-le"), np.uint32), offsets).tolist()
    rx, want, base = regex.compile(public_tokenizers.PATTERN), [], 0
    for t in texts:
        want += [base + m.start() for m in rx.finditer(t)]
        base += len(t)
    assert start == want


def test_new_letters(tik):
    """Letters that Unicode 16 added are classed as the libraries do."""
    texts = [f"a{chr(first)}b 1{chr(last)}2" for first, last, _ in pretokens.UNICODE_16]
    assert parts(*bpe.codec(PATH).pieces(texts)) == [tik.encode_ordinary(t) for t in texts]


def test_bpe_like_the_library(tik):
    rng = random.Random(5)
    texts = ODD + ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(400)), " ".join("".join(rng.choices("etaoins", k=9)) for _ in range(300))]
    ids, limits = bpe.codec(PATH).pieces(texts)
    assert parts(ids, limits) == [tik.encode_ordinary(t) for t in texts]
    assert bpe.codec(PATH).decode(ids, limits) == [t.encode() for t in texts]


LETTERS = ["ab", "abc", "etaoinshrdlu", "etaoinshrdlucmfwypvbgk", "aé漢\U0001f600"]


def test_long_pieces_like_the_library(tik):
    """Lengths around each bound, random and periodic, with and without tokens in common between windows."""
    rng = random.Random(12)
    texts = [letter * n for letter in "ax-=é" for n in (47, 48, 49, 95, 96, 97, 384, 385, 1000, 3000)]
    texts += ["".join(rng.choices(a, k=n)) for a in LETTERS for n in (*range(45, 51), *range(94, 100), *range(380, 390), 700, 3000)]
    texts += [(unit * n)[:n] for unit in ("abc", "hello", "lol", "haha", "sevenxy", "-=", "".join(rng.choices(LETTERS[2], k=41))) for n in (97, 385, 2000)]
    assert parts(*bpe.codec(PATH).pieces(texts)) == [tik.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("block", bpe.WINDOWS)
def test_windows(tik, block):
    rng, found = random.Random(block), 0
    for k in range(30):
        data = "".join(rng.choices(LETTERS[k % 4], k=rng.randint(3 * block + 1, 12 * block))).encode()
        c, raw = bpe.codec(PATH), np.frombuffer(data, np.uint8)
        at, end = bpe.windows(raw, block)
        toks, counts = c.steps(raw, at, end)
        ids = c.joined(raw, at, end, np.split(toks, np.cumsum(counts)[:-1]))
        found += ids is not None
        assert ids is None or ids.tolist() == tik.encode_ordinary(data.decode())
    assert found > 20


def test_megabyte_without_a_space(tik):
    text = "".join(random.Random(1).choices(LETTERS[3], k=1_000_000))
    began = time.perf_counter()
    ids, _ = bpe.codec(PATH).pieces([text])
    assert time.perf_counter() - began < 60 and ids.tolist() == tik.encode_ordinary(text)


def test_pieces_of_one_hash(tik, monkeypatch):
    """Pieces whose hashes collide are told apart."""
    monkeypatch.setattr(pretokens, "RangeHash", lambda points: lambda start, end: (end - start).astype(np.uint64))
    own = pretokens.PieceIds(bpe.codec(PATH).contract)
    for texts in (["a b", "c"], ["x b"], ["some words here", "hole"], ["a b", "c"]):
        assert parts(*own(texts)) == [tik.encode_ordinary(t) for t in texts]


def test_pieces_learnt_again_when_full(tik):
    texts = [" ".join(f"w{i}x{k}" for i in range(40)) for k in range(5)]
    small = pretokens.PieceIds(bpe.codec(PATH).contract, 50)
    for t in texts + texts:
        assert parts(*small([t]))[0] == tik.encode_ordinary(t)


def test_round_trip_query(spark, docs_of, tik):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "null id"), (1, "a")]
    got = sorted(tuple(r) for r in bpe.round_trip(docs_of(rows), PATH).fillna(-1).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert got == sorted((-1 if i is None else i, len(x), sha(" ".join(map(str, x)).encode()), sha(b)) for i, x, b in ids)
    out = bpe.decode(bpe.encode(docs_of(rows), PATH), PATH)
    assert out.columns[-2:] == ["ids", "decoded"] and "key" in out.columns
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())
    assert bpe.round_trip(docs_of([]), PATH).count() == 0


@pytest.mark.parametrize("n, bound", [(0, 1), (1, 1), (1, 10**12), (300, 3), (700, 10**7)])
def test_elias_fano(n, bound):
    v = np.sort(np.random.default_rng(n).integers(0, bound, n))
    e, size = tokenfiles.EliasFano.from_bytes(memoryview(tokenfiles.EliasFano.of(v).to_bytes() + b"more"))
    assert e.some(0, n).tolist() == v.tolist() == [e.select(i) for i in range(n)]
    for lo, hi in ((0, 0), (n // 3, n // 2), (n // 2, n), (min(n, 255), min(n, 257)), (min(n, 256), min(n, 512))):
        assert e.some(lo, hi).tolist() == v[lo:hi].tolist()
    assert size <= 32 + n * (3 + np.log2(max(1, bound / max(1, n)))) / 8 + 4 * (n / tokenfiles.SAMPLE + 1) + 16


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a  <|endoftext|>  b\n\n<|endoftext|>", "<|endof<|endoftext|>text|>", "<|ENDOFTEXT|>", "no \u00e9", ""]


def test_added_tokens_like_the_library(lib):
    """The library's defaults, and its other way."""
    encode = tokenfiles.encoder(VOCABULARY)
    assert parts(*encode(SPECIAL)) == [lib.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    assert 50256 in encode(SPECIAL)[0] and 50256 not in encode(SPECIAL, specials=False)[0]
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    assert parts(*encode(SPECIAL, specials=False)) == [plain.encode(t, add_special_tokens=False).ids for t in SPECIAL]


def test_token_files(spark, docs_of, lib):
    rows = [(i * 3, t) for i, t in enumerate(ODD + SPECIAL)] + [(7, None), (None, "null id"), (None, None), (3, "a twin of 3"), (-5, "negative")]
    rows += [(k + 100, f"document {k}") for k in range(600)]
    out = new_path(spark, "tokens")
    manifest = tokenfiles.write(docs_of(rows), VOCABULARY, out, chunk_ids=40)
    back = tokenfiles.read(spark, out, manifest).collect()
    want = sorted((i is not None, i if i is not None else 0, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    back = sorted(back, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in back] == [(a, b) for a, b, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in back) == want
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back])[:-1].tolist()
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in tokenfiles.read(spark, out, manifest, digest=True).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in back)
    none = new_path(spark, "none")
    assert tokenfiles.read(spark, none, tokenfiles.write(docs_of([]), VOCABULARY, none)).count() == 0


def test_slices_and_words():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["ab cd", None, "x" * 50, " \t", "é"]), "k": [1, 2, 3, 4, 5]})
    some = list(slices(iter([batch]), "text", 6))
    assert [b.num_rows for b in some] == [2, 1, 2] and some[2].column("k").to_pylist() == [4, 5]
    data, offsets = text_bytes(batch.slice(1, 4).column("text"))
    start, end, row = words(data, offsets)
    assert offsets.tolist() == [0, 0, 50, 52, 54] and row.tolist() == [1, 3] and (end - start).tolist() == [50, 2]
