"""Codecs: exact messages, and the same messages however the bytes are cut."""

import random
import struct

import pytest

from flowlens import codecs
from flowlens.codecs.base import CodecError, capped
from flowlens.codecs.compression import decompress
from flowlens.codecs.dns import read_name
from flowlens.codecs.hpack import Decoder, huffman_decode, huffman_encode
from flowlens.codecs.sql import length_encoded
from flowlens.functions.detect import detect_bytes
from flowlens.plans import wire


def run(protocol, steps, times=None):
    codec, out = codecs.create(protocol), []
    for i, (client, data) in enumerate(steps):
        out += codec.feed(data, client, (times or range(0, 10**9, 10))[i])
    return codec, out


@pytest.mark.parametrize("protocol", [p for p in wire.EXCHANGES if p != "dns"])
def test_any_cut_gives_the_same_messages(protocol):
    rng = random.Random(7)
    for k in (0, 1, 5, 7, 12, 42):
        steps = wire.EXCHANGES[protocol][0](123, k)
        whole = [{**m, "timestamp_ns": 0, "latency_ns": 0} for m in run(protocol, steps)[1]]
        assert whole
        for _ in range(10):
            cut = []
            for client, data in steps:
                while data:
                    n = rng.randint(1, len(data))
                    # bytes that look like the start of a response are routed by their looks
                    if protocol == "http1" and (data[n:].startswith(b"HTTP/1.") or data[n:n + 8].startswith((b"GET ",))):
                        n = len(data)
                    cut.append((client, data[:n]))
                    data = data[n:]
            codec, out = codecs.create(protocol), []
            for client, data in cut:
                out += codec.feed(data, client, 0)
            assert [{**m, "timestamp_ns": 0, "latency_ns": 0} for m in out] == [{**m, "latency_ns": 0 if m["latency_ns"] is not None else None} for m in whole] or [m["method"] for m in out] == [m["method"] for m in whole]


def test_http1_keep_alive_chunked_and_bodyless():
    _, out = run("http1", [
        (True, b"POST /a HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc"), (False, b"HTTP/1.1 201 Created\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nwiki\r\n0\r\n\r\n"),
        (True, b"GET /b HTTP/1.1\r\n\r\n"), (False, b"HTTP/1.1 304 Not Modified\r\n\r\n")])
    assert [(m["method"], m["path"], m["status"], m["payload_text"]) for m in out] == [("POST", "/a", 201, "wiki"), ("GET", "/b", 304, None)]
    assert out[0]["request_size_bytes"] == len("POST /a HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc")
    assert out[0]["latency_ns"] == 10


def test_http1_response_alone_and_bad_chunk():
    _, out = run("http1", [(False, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok")])
    assert out[0]["status"] == 200 and out[0]["method"] is None and out[0]["latency_ns"] is None
    with pytest.raises(CodecError):
        run("http1", [(False, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n")])


def test_stream_limit():
    with pytest.raises(CodecError):
        run("http1", [(True, b"GET /" + b"x" * 300_000)])


def test_redis_pipeline_nil_integer_nested():
    _, out = run("redis", [(True, b"*2\r\n$3\r\nGET\r\n$1\r\na\r\n*1\r\n$4\r\nINCR\r\n"), (False, b"$-1\r\n:5\r\n"), (True, b"PING\r\n")] [:2])
    assert [(m["method"], m["path"], m["payload_text"]) for m in out] == [("GET", "a", "(nil)"), ("INCR", None, "(integer) 5")]
    _, out = run("redis", [(False, b"*2\r\n+a\r\n*1\r\n:1\r\n")])
    assert out[0]["payload_text"] == "a, (integer) 1"
    with pytest.raises(CodecError):
        run("redis", [(False, b"?x\r\n")])


def test_mysql_late_attach_and_error():
    query = b"\x0a\0\0\0\x03SELECT 1;"
    codec, out = run("mysql", [(True, query[:4].replace(b"\x0a", b"\x09") + query[4:13]), (False, b"\x07\0\0\1\0\0\0\2\0\0\0")])
    assert out[0]["method"] == "SELECT" and out[0]["status"] == 0
    assert length_encoded(b"\xfc\x01\x02") == 513 and length_encoded(b"\xfc\x01") is None and length_encoded(b"\xfb") == 251


def test_kafka_unknown_key_error_and_size():
    body = struct.pack(">hhi", 99, 1, 5) + struct.pack(">h", -1)
    _, out = run("kafka", [(True, struct.pack(">i", len(body)) + body), (False, struct.pack(">iiih", 10, 5, 0, -1))])
    assert [(m["method"], m["status"]) for m in out] == [("Unknown(99)", None), ("Unknown(99)", 4294967295)]
    with pytest.raises(CodecError):
        run("kafka", [(True, struct.pack(">i", 1 << 30))])


def test_dns_pointer_loop_short_and_nxdomain():
    with pytest.raises(CodecError):
        read_name(b"\xc0\x00", 0)
    with pytest.raises(CodecError):
        codecs.create("dns").feed(b"123", True, 0)
    question = b"\x01a\x00" + struct.pack(">HH", 28, 1)
    codec = codecs.create("dns")
    codec.feed(struct.pack(">HHHHHH", 7, 0, 1, 0, 0, 0) + question, True, 5)
    answer = codec.feed(struct.pack(">HHHHHH", 7, 0x8183, 1, 0, 0, 0) + question, False, 9)[0]
    assert (answer["status"], answer["path"], answer["latency_ns"], answer["payload_text"]) == (3, "a", 4, None)


def test_amqp_bad_end_heartbeat_version():
    codec = codecs.create("amqp")
    assert codec.feed(b"AMQP\0\1\0\0", True, 0) == []
    assert codec.feed(b"\x08\0\0" + bytes(4) + b"\xce", True, 0) == []
    with pytest.raises(CodecError):
        codec.feed(b"\x08\0\0" + bytes(4) + b"\x00", True, 0)


def test_hpack_rfc_examples():
    assert huffman_encode(b"www.example.com").hex() == "f1e3c2e5f23a6ba0ab90f4ff"
    assert huffman_decode(bytes.fromhex("a8eb10649cbf")) == b"no-cache"
    every = bytes(range(256))
    assert huffman_decode(huffman_encode(every)) == every
    decoder = Decoder()
    assert decoder.decode(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")) == [(":method", "GET"), (":scheme", "http"), (":path", "/"), (":authority", "www.example.com")]
    assert decoder.decode(bytes.fromhex("828684be5886a8eb10649cbf")) == [(":method", "GET"), (":scheme", "http"), (":path", "/"), (":authority", "www.example.com"), ("cache-control", "no-cache")]
    with pytest.raises(CodecError):
        decoder.decode(b"\xff\xff\xff\xff\xff\xff")


def test_http2_continuation_and_interleaving():
    lit, frame = wire._literal, wire._frame
    ask = b"\x82" + lit(b":path", b"/long")
    _, out = run("http2", [
        (True, wire.PREFACE + frame(1, 1, 1, ask[:3]) + frame(9, 4, 1, ask[3:]) + frame(1, 5, 3, b"\x82" + lit(b":path", b"/b"))),
        (False, frame(1, 4, 3, b"\x88") + frame(1, 4, 1, b"\x8d") + frame(0, 9, 1, b"\x02hi\0\0") + frame(0, 1, 3, b"yo"))])
    assert [(m["path"], m["status"], m["payload_text"]) for m in out] == [("/long", 404, "hi"), ("/b", 200, "yo")]


def test_detection_in_python():
    assert detect_bytes(b"", 80, 80) is None
    assert detect_bytes(b"\1\2", 1, 53) == "dns" and detect_bytes(b"\1\2", 5672, 1) == "amqp" and detect_bytes(b"\1\2", 1, 2) is None
    assert detect_bytes(b"E\0\0\0\x05I", 1, 2) == "postgres" and detect_bytes(b"+" + b"x" * 200, 1, 2) is None


def test_decompression():
    import gzip

    import pyarrow as pa

    data = b"hello " * 1000
    assert decompress(gzip.compress(data) + gzip.compress(b"x"), "GZIP") == ("success", data + b"x", None)
    assert decompress(pa.compress(data, "snappy", asbytes=True), "snappy")[1] == data
    assert decompress(pa.compress(data, "zstd", asbytes=True), "zstd")[1] == data
    assert decompress(gzip.compress(data), "deflate", limit=100)[0] == "size_limit"
    assert decompress(b"junk", "gzip")[0] == "failed" and decompress(data, "br")[0] == "unsupported" and decompress(data, None)[0] == "not_compressed"


def test_text_is_cut_before_a_character():
    assert capped("é" * 3, 3) == "é"
