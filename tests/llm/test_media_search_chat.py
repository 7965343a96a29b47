"""Ogg, top-k search and tool calls."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from fluxframe.llm import ogg, toolcalls, vafile

ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (4, "é" * 500), (5, "y" * 192), (None, "no id"), (6, "long " * 30_000)]


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 12288, 12289, 100_000])
def test_ogg_round_trip(n):
    raw = random.Random(n).randbytes(n)
    data = ogg.encode(ogg.payload(raw))
    back, told = ogg.decode(data)
    assert back == ogg.payload(raw) and len(back) % 192 == 0 and back
    assert sum(t["us"] * ogg.RATE // 1_000_000 for t in told) == pytest.approx(len(back), abs=2)
    assert ogg.checksum(data[:300]) == slow_checksum(data[:300])


def test_ogg_damage():
    data = ogg.encode(ogg.payload(bytes(range(256)) * 200))
    second = data.index(b"OggS", 1)
    third = data.index(b"OggS", second + 1)
    for bad in (data[:100] + bytes([data[100] ^ 1]) + data[101:], data[:-1], data[:second] + data[third:], data[second:], data[:third], b"x" + data):
        with pytest.raises(ValueError):
            ogg.decode(bad)


def test_ogg_packets_over_pages():
    """A packet of 1000 bytes over two pages, and one of exactly 255 that ends with an empty segment."""
    long, full = random.Random(1).randbytes(1000), b"z" * 255
    first, rest = long[:510], long[510:]
    pages = ogg.page(ogg.FIRST, ogg.NO_PACKET_ENDS, 9, 0, b"\xff\xff", first) + ogg.page(ogg.CONTINUED | ogg.LAST, 5, 9, 1, ogg.lacing(490) + ogg.lacing(255), rest + full)
    s = ogg.streams(pages)[9]
    assert s["packets"] == [long, full] and s["granule"] == 5 and s["pages"] == 2


def test_ogg_query(docs_of):
    rows = ogg.features(ogg.with_media(docs_of(ODD))).collect()
    assert len(rows) == len(ODD)
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, (t or "").encode())
    for r in rows:
        p = ogg.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_sha256 == hashlib.sha256(ogg.encode(p)).hexdigest() and r.media_bytes == len(ogg.encode(p))
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    assert ogg.features(ogg.with_media(docs_of([]))).count() == 0


def brute(vectors, k):
    out = set()
    for q, x in vectors:
        if q % 20 == 0:
            all_ = sorted((-int(np.dot(x, y)), i) for i, y in vectors if i != q and len(y) == len(x))
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(all_[:k])}
    return out


@pytest.mark.parametrize("low, high, bits", [(-40, 40, 6), (-3, 4, 2), (-(10**6), 10**6, 8)])
def test_search(spark, monkeypatch, low, high, bits):
    monkeypatch.setattr(vafile, "CANDIDATES", 64)
    monkeypatch.setattr(vafile, "QUERIES", 8)
    rng = np.random.default_rng(bits)
    vectors = [(k, rng.integers(low, high, 16).tolist()) for k in range(400)]
    vectors[200] = (200, vectors[7][1])
    vectors += [(1000 + k, vectors[40][1]) for k in range(30)] + [(2000 + k, [1, 2, 3]) for k in range(21)]
    df = spark.createDataFrame([*vectors, (3000, None), (None, [1] * 16), vectors[5]], "vec_id long, vector array<long>")
    got = {tuple(r) for r in vafile.search(df, lambda i: i % 20 == 0, 20, bits).collect()}
    assert got == brute(vectors, 20)


def test_search_odd_vectors(spark):
    rows = [(0, [0.5, -0.51]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, None), (4, [1.0, 1.0]), (5, [float("inf"), 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vafile.search(vafile.whole_numbers(df), lambda i: i % 20 == 0).collect()] == [(0, 1, 4, 64 * 32 - 64 * 33)]
    assert vafile.search(vafile.whole_numbers(df.limit(0)), lambda i: i == i).count() == 0


def test_search_large_numbers(spark):
    """Sums beyond 53 bits are exact, and what does not fit into 64 bits raises instead of going astray."""
    rng = np.random.default_rng(3)
    vectors = [(k, [int(x) for x in rng.integers(-(1 << 29), 1 << 29, 6)]) for k in range(60)] + [(100 + k, [(1 << 60) + k, -k, 0, 0, 0, 0]) for k in range(3)]
    vectors[20] = (20, [1, 2, 1, 0, -1, 2])
    vectors = [v for v in vectors if v[0] not in (0, 40, 100)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    got = {tuple(r) for r in vafile.search(df, lambda i: i % 20 == 0, 5).collect()}
    exact = sorted((-sum(a * b for a, b in zip(dict(vectors)[20], v, strict=True)), i) for i, v in vectors if i != 20)[:5]
    assert got == {(20, r + 1, i, -s) for r, (s, i) in enumerate(exact)}
    big = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="does not fit into 64 bits"):
        vafile.search(big, lambda i: i == 0).collect()
    large = spark.createDataFrame([(0, [1 / 64]), (1, [1e17])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vafile.search(vafile.whole_numbers(large), lambda i: i == 0).select("vec_id", "score").collect()] == [(1, 6_400_000_000_000_000_000)]
    with pytest.raises(Exception, match="does not fit into 64 bits"):
        vafile.whole_numbers(spark.createDataFrame([(1, [2e17])], "vec_id long, embedding array<double>")).collect()


def test_search_agrees_with_sql(spark, sf, same_as_sql):
    same_as_sql(vafile.op9_vafile(spark, sf), vafile.SQL)


SCHEMAS = {"add": {"a": (("BIGINT",), True, 0), "note": (("STRING",), False, 2)}}


def linked(spark, calls, results):
    calls = spark.createDataFrame(calls, "call_id string, name string, arguments string, after string").selectExpr("*", "1 AS extra")
    results = spark.createDataFrame(results, "call_id string, content string")
    return toolcalls.link(calls, results, SCHEMAS)


def test_calls(spark):
    calls = [
        ("c", "add", '{"note": "é\\n\\u0041", "a": 2}', "b"), ("b", "add", '{"a":1}', "a"), ("a", "add", '{"a":"1"}', None), ("x", "add", '{"a":1,"z":0}', "y"), ("y", "sub", "{}", "x"), ("z", "add", "[1]", "y"),
        ("u", "add", "{}", "gone"), ("n", "add", None, None), ("d", "add", '{"a":5,"note":"q"}', None), ("d", "add", '{"a":4}', None), (None, "add", '{"a":1}', None),
    ]
    got = linked(spark, calls, [("a", "r"), ("a", "q"), ("o", "lost"), (None, "?"), ("c", None)]).collect()
    by = {r.call_id: r for r in got if r.call_id}
    assert len(got) == 12 and sum(r.status == "unnamed" for r in got) == 2
    assert [by[k].level for k in "abcdxyz"] == [0, 1, 2, 0, None, None, None]
    assert {k: by[k].status for k in "abco"} == {"a": "linked", "b": "open", "c": "linked", "o": "orphan"}
    assert by["a"].errors == ["type of a"] and by["c"].errors == [] and by["x"].errors == ["unknown argument", "cycle"] and by["y"].errors == ["unknown tool", "cycle"] and by["z"].errors == ["not an object", "cycle"]
    assert by["u"].errors == ["missing a", "unknown after"] and by["n"].errors == ["not an object"] and by["d"].errors == [] and by["d"].n_calls == 2 and by["a"].n_results == 2
    assert by["c"].record == '{"after":"b","arguments":{"a":2,"note":"é\\nA"},"id":"c","level":2,"name":"add","status":"linked"}'
    assert json.loads(by["a"].record)["result"] == "q"


def test_long_chain(spark):
    calls = [(str(k), "add", '{"a":1}', str(k - 1) if k else None) for k in range(300)]
    assert {r.call_id: r.level for r in linked(spark, calls, []).collect()} == {str(k): k for k in range(300)}
    assert linked(spark, [], []).count() == 0


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 3, "user", ""), (1, 3, "user", ""), (None, 1, "user", "u"), (2, None, "assistant", "x"), (3, 0, None, "no role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in toolcalls.link(*toolcalls.chat_calls(df), toolcalls.CHAT).collect() if r.call_id}
    assert {k: (r.status, r.level) for k, r in got.items()} == {"1:0": ("open", 0), "1:1": ("linked", 1), "1:3": ("open", 2), "3:0": ("open", 0)}
    assert got["1:1"].errors == ["missing prompt"] and got["1:3"].errors == ["length of prompt"] and got["1:3"].n_calls == 2


def test_calls_agree_with_sql(spark, sf, same_as_sql):
    same_as_sql(toolcalls.op5_toolcalls(spark, sf), toolcalls.SQL)


def slow_ogg(payload):
    """The format of the docstring written out once more, a page at a time, with the bitwise checksum."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    frames = [payload[k : k + 192] for k in range(0, len(payload), 192)]

    def page(flags, granule, stream, number, packets):
        table = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
        rest = granule.to_bytes(8, "little") + (serial + stream).to_bytes(4, "little") + number.to_bytes(4, "little")
        out = b"OggS" + bytes([0, flags]) + rest + bytes(4) + bytes([len(table)]) + table + b"".join(packets)
        return out[:22] + slow_checksum(out).to_bytes(4, "little") + out[26:]

    own = [frames[0::2], frames[1::2]]
    heads = [b"FXPCM8" + bytes([1, k, 2]) + (48_000).to_bytes(4, "little") + (192).to_bytes(2, "little") for k in range(2)]
    out = [page(2 if own[k] else 6, 0, k, 0, [heads[k]]) for k in range(2)]
    for at in range(0, len(own[0]), 64):
        for k in range(2):
            if part := own[k][at : at + 64]:
                out.append(page(4 if at + 64 >= len(own[k]) else 0, 192 * (at + len(part)), k, 1 + at // 64, part))
    return b"".join(out)


@pytest.mark.parametrize("n", [0, 192, 193, 5000, 25_000])
def test_ogg_like_brute_force(n):
    payload = ogg.payload(random.Random(n).randbytes(n))
    assert ogg.encode(payload) == slow_ogg(payload)


def test_calls_after_one_call(spark, monkeypatch):
    """A call that most others come after, and most calls after none, a cycle and an unknown one."""
    rows = [("root", None)] + [(f"a{k}", "root") for k in range(400)] + [(f"n{k}", None) for k in range(300)] + [(f"c{k}", f"c{k - 1}") for k in range(1, 40)] + [("c0", "a3"), ("x", "y"), ("y", "x"), ("z", "nobody")]
    calls = spark.createDataFrame([(i, "answer", "{}", a) for i, a in rows], "call_id string, name string, arguments string, after string")
    got = {r.call_id: (r.level, r.known) for r in toolcalls.levels(calls).collect()}
    want = {"root": (0, None), "x": (None, True), "y": (None, True), "z": (0, False)} | {f"a{k}": (1, True) for k in range(400)} | {f"n{k}": (0, None) for k in range(300)} | {f"c{k}": (2 + k, True) for k in range(40)}
    assert got == want
