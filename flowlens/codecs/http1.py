"""HTTP/1.1: requests are queued in order and each response, with its body, completes the oldest one."""

from __future__ import annotations

from flowlens.codecs.base import Codec, CodecError, elapsed, lossy, message, strict_text

#: How a request begins, and how a response does.
VERBS = (b"GET ", b"POST ", b"PUT ", b"DELETE ", b"HEAD ", b"OPTIONS ", b"PATCH ", b"CONNECT ")
RESPONSE = b"HTTP/1."
MOST_HEADERS = 64


def read_head(data: bytearray) -> tuple[list[str], list[tuple[str, str]], int] | None:
    """Start line (in three), headers (names lower-cased) and length of a complete head; None if there is none yet or it is malformed."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *rest = lossy(data[:end]).split("\r\n")
    start = first.split(" ", 2)
    headers = []
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon or not name:
            return None
        headers.append((name.lower(), value.strip(" \t")))
    return None if len(headers) > MOST_HEADERS or len(start) < 2 else (start, headers, end + 4)


def _length(headers: list[tuple[str, str]]) -> int | None:
    found = [v for k, v in headers if k == "content-length"]
    return int(found[-1]) if found and found[-1].isascii() and found[-1].isdigit() else None


class Http1Codec(Codec):
    protocol = "http1"

    def __init__(self):
        super().__init__()
        self.version = "1.1"
        self.state = "waiting_for_request"
        self.skip = 0  # bytes of the request's body still to come
        self.request: dict | None = None
        self.response: dict | None = None

    def feed(self, data: bytes, egress: bool, ts: int) -> list[dict]:
        # what the bytes look like says more than the direction they went
        if data.startswith(RESPONSE):
            egress = False
        elif data.startswith(VERBS):
            egress = True
        return super().feed(data, egress, ts)

    def advance(self, ts: int):
        while True:
            if self.response is not None:
                if not self._body():
                    return
                yield self._complete(ts)
            elif self.skip:
                self.skip -= len(self.client.take(self.skip))
                if self.skip:
                    return
                self.state = "waiting_for_response"
            elif self.request is None and self.client.data and self._read_request(ts):
                continue
            elif not self.server.data or not self._read_response():
                return

    def _read_request(self, ts: int) -> bool:
        head = read_head(self.client.data)
        if head is None:
            return False
        (method, path, *_), headers, size = head
        self.client.take(size)
        self.skip = _length(headers) or 0
        self.request = {"method": method, "path": path, "ts": ts, "size": size + self.skip, "headers": headers}
        self.state = "reading_request_body" if self.skip else "waiting_for_response"
        return True

    def _read_response(self) -> bool:
        head = read_head(self.server.data)
        if head is None:
            return False
        (_, code, *_), headers, size = head
        if not code.isdigit():
            return False
        self.server.take(size)
        named = dict(headers)
        chunked = any(k == "transfer-encoding" and "chunked" in v.lower() for k, v in headers)
        self.response = {"status": int(code), "headers": headers, "type": named.get("content-type"), "body": bytearray(), "left": None if chunked else _length(headers) or 0}
        self.state = "reading_chunked_response" if chunked else "reading_response_body"
        return True

    def _body(self) -> bool:
        """Takes what there is of the response's body; whether it is complete."""
        response = self.response
        if response["left"] is not None:
            part = self.server.take(response["left"])
            response["body"] += part
            response["left"] -= len(part)
            return response["left"] == 0
        while True:
            line = self.server.data.find(b"\r\n")
            if line < 0:
                return False
            try:
                size = int(bytes(self.server.data[:line]).strip(), 16)
            except ValueError:
                raise CodecError("malformed chunk size") from None
            if len(self.server) < line + 2 + size + 2:
                return False
            chunk = self.server.take(line + 2 + size + 2)
            if size == 0:
                return True
            response["body"] += chunk[line + 2:-2]

    def _complete(self, ts: int) -> dict:
        request, response = self.request, self.response
        self.request = self.response = None
        self.state = "waiting_for_request"
        out = message("http1", ts, status=response["status"], content_type=response["type"], headers=response["headers"], response_size_bytes=len(response["body"]), payload_text=strict_text(response["body"]))
        if request:
            out |= {"method": request["method"], "path": request["path"], "latency_ns": elapsed(ts, request["ts"]), "request_size_bytes": request["size"], "headers": request["headers"] + response["headers"]}
        return out
