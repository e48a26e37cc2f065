"""Row types, names of codes, and limits."""

from __future__ import annotations

from pyspark.sql import types as T

#: Limits and defaults of the data model.
MAX_PAYLOAD, MAX_COMM = 4096, 16
RECORD_BYTES = 4152
IDLE_SECONDS, WINDOW_SECONDS, STALE_SECONDS, IDENTITY_SECONDS = 30, 10, 300, 300
MIN_CONFIDENCE = 0.7
BACKPRESSURE_SHARE = 0.05

#: Codes of the capture record, by number.
EVENT_TYPES = ("TcPacket", "TlsData", "ProcessExec", "ProcessExit", "SockConnect", "SockAccept", "SockClose", "UdpSend", "UdpRecv")
DIRECTIONS = ("Ingress", "Egress")
TLS_LIBRARIES = ("None", "OpenSsl", "GoTls", "JavaSsl")
#: How an exported row spells them, and how a protocol is shown.
TLS_NAMES = {"OpenSsl": "open_ssl", "GoTls": "go_tls", "JavaSsl": "java_ssl"}
PROTOCOL_NAMES = {
    "http1": "HTTP/1.1", "http2": "HTTP/2", "grpc": "gRPC", "mysql": "MySQL", "postgres": "PostgreSQL", "redis": "Redis", "dns": "DNS", "kafka": "Kafka",
    "amqp": "AMQP", "unknown": "Unknown",
}

DATA_EVENT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("socket_cookie", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("tgid", T.LongType()),
    T.StructField("src_addr", T.LongType()),
    T.StructField("dst_addr", T.LongType()),
    T.StructField("payload_len", T.LongType()),
    T.StructField("tls_library", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("ip_proto", T.ShortType()),
    T.StructField("payload", T.BinaryType()),
])

HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])

L7_FIELDS = [
    T.StructField("protocol", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("latency_ns", T.LongType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.LongType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("payload_text", T.StringType()),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("request_size_bytes", T.LongType()),
    T.StructField("response_size_bytes", T.LongType()),
]
#: Where a message was seen; taken from the packet that completed it.
TRANSPORT_FIELDS = [
    T.StructField("src_addr", T.LongType()),
    T.StructField("dst_addr", T.LongType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("pid", T.LongType()),
    T.StructField("tls_library", T.StringType()),
]
#: What session parsing returns; a row with an error has no message.
SESSION_ROW = T.StructType([
    T.StructField("session_key", T.LongType()), T.StructField("msg_no", T.LongType()), *L7_FIELDS, *TRANSPORT_FIELDS,
    T.StructField("state", T.StringType()), T.StructField("protocol_version", T.StringType()), T.StructField("error", T.StringType()),
])
