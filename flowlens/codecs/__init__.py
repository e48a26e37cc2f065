"""Byte-level protocol codecs: plain Python, no Spark. create(protocol) makes one; register() adds a protocol."""

from __future__ import annotations

from collections.abc import Callable

from flowlens.codecs.amqp import AmqpCodec
from flowlens.codecs.base import Codec, CodecError, Stream, message
from flowlens.codecs.dns import DnsCodec
from flowlens.codecs.http1 import Http1Codec
from flowlens.codecs.http2 import Http2Codec
from flowlens.codecs.kafka import KafkaCodec
from flowlens.codecs.redis import RedisCodec
from flowlens.codecs.sql import MysqlCodec, PostgresCodec

_REGISTRY: dict[str, Callable[[], Codec]] = {
    "http1": Http1Codec,
    "http2": Http2Codec,
    "grpc": lambda: Http2Codec(grpc=True),
    "mysql": MysqlCodec,
    "postgres": PostgresCodec,
    "redis": RedisCodec,
    "kafka": KafkaCodec,
    "dns": DnsCodec,
    "amqp": AmqpCodec,
}


def register(protocol: str, factory: Callable[[], Codec]) -> None:
    _REGISTRY[protocol] = factory


def create(protocol: str) -> Codec | None:
    factory = _REGISTRY.get(protocol)
    return factory() if factory else None


__all__ = ["Codec", "CodecError", "Stream", "create", "message", "register"]
