"""MySQL and PostgreSQL: one statement is under way at a time, and its reply completes it."""

from __future__ import annotations

from flowlens.codecs.base import SQL_TEXT_LIMIT, Codec, capped, elapsed, lossy, message, number


class _Statement:
    """The statement under way."""

    def __init__(self, text: str, ts: int):
        self.text, self.ts = text, ts


def _reply(protocol: str, statement: _Statement | None, ts: int, status: int, error: str | None = None) -> dict:
    out = message(protocol, ts, method="QUERY", status=status, payload_text=error)
    if statement:
        out["method"] = statement.text.split()[0].upper() if statement.text.split() else "QUERY"
        out["latency_ns"] = elapsed(ts, statement.ts)
        if error is None:
            out["payload_text"] = capped(statement.text, SQL_TEXT_LIMIT)
    return out


def length_encoded(data: bytes) -> int | None:
    """A MySQL length-encoded integer; None if bytes are missing. A first byte up to 0xFB stands for itself."""
    if not data:
        return None
    if data[0] <= 0xFB:
        return data[0]
    size = {0xFC: 2, 0xFD: 3, 0xFE: 8}.get(data[0])
    return number(data, 1, size, little=True) if size and len(data) > size else None


class MysqlCodec(Codec):
    protocol = "mysql"
    #: Commands that carry a statement, and the first byte of a packet that ends something.
    STATEMENTS = (0x03, 0x16)
    OK, ERROR, EOF, GREETING = 0x00, 0xFF, 0xFE, 0x0A

    def __init__(self):
        super().__init__()
        self.state = "waiting_for_handshake"
        self.plugin: str | None = None
        self.statement: _Statement | None = None
        self.columns = 0  # column definitions still to come
        self.rows = False  # past the definitions and their end mark

    @staticmethod
    def _packet(stream, take: bool = True) -> bytes | None:
        data = stream.data
        if len(data) < 4 or len(data) < (size := 4 + (data[0] | data[1] << 8 | data[2] << 16)):
            return None
        return stream.take(size)[4:] if take else bytes(data[4:size])

    def advance(self, ts: int):
        while True:
            step = getattr(self, f"_{self.state}")(ts)
            if step is None:
                return
            if isinstance(step, dict):
                yield step

    def _waiting_for_handshake(self, ts: int):
        packet = self._packet(self.server)
        if packet is None:
            # the greeting may have gone by before the capture began
            first = self._packet(self.client, take=False)
            if first is None:
                return None
            self.state = "ready" if first[:1] and first[0] in self.STATEMENTS else "in_auth"
            return True
        if packet[:1] != bytes([self.GREETING]):
            self.state = "ready"
            return True
        end = packet.find(0, 1)
        if end > 0:
            self.version = lossy(packet[1:end])
        self.plugin = next((p for p in ("caching_sha2_password", "mysql_native_password") if p.encode() in packet), None)
        self.state = "in_auth"
        return True

    def _in_auth(self, ts: int):
        first = self._packet(self.client, take=False)
        if first is not None:
            if first[:1] and first[0] in self.STATEMENTS:
                answer = self._packet(self.server, take=False)
                if answer and answer[0] in (self.OK, self.ERROR):
                    self._packet(self.server)  # the end of the authentication
                self.state = "ready"
                return True
            self._packet(self.client)
        if self._packet(self.server) is None:
            return None
        self.state = "ready"
        return True

    def _ready(self, ts: int):
        packet = self._packet(self.client)
        if not packet:
            return None
        if packet[0] in self.STATEMENTS:
            self.statement = _Statement(lossy(packet[1:]), ts)
            self.state = "in_query"
        return True

    def _in_query(self, ts: int):
        packet = self._packet(self.server)
        if not packet:
            return None
        if packet[0] in (self.OK, self.ERROR):
            return self._finish(packet, ts)
        count = length_encoded(packet)
        self.state = "ready" if count is None else "in_response"
        self.columns, self.rows = count or 0, False
        return True

    def _in_response(self, ts: int):
        packet = self._packet(self.server)
        if packet is None:
            return None
        if not packet:
            return True
        ends = packet[0] in (self.OK, self.ERROR) or packet[0] == self.EOF and len(packet) < 9
        if self.columns:
            self.columns -= 1
        elif not self.rows:
            self.rows = True
            if ends and packet[0] == self.ERROR:
                return self._finish(packet, ts, in_rows=True)
        elif ends:
            return self._finish(packet, ts, in_rows=True)
        return True

    def _finish(self, packet: bytes, ts: int, in_rows: bool = False) -> dict:
        statement, self.statement = self.statement, None
        self.state = "ready"
        if packet[0] != self.ERROR:
            return _reply("mysql", statement, ts, 0)
        status = number(packet, 1, 2, little=True) if len(packet) >= 3 else None
        text = None if in_rows or len(packet) <= 3 else lossy(packet[9:] if packet[3:4] == b"#" and len(packet) > 9 else packet[3:])
        return _reply("mysql", statement, ts, status, text)


class PostgresCodec(Codec):
    protocol = "postgres"

    def __init__(self):
        super().__init__()
        self.state = "waiting_for_startup"
        self.statement: _Statement | None = None
        self.error: str | None = None

    @staticmethod
    def _tagged(stream) -> tuple[bytes, bytes] | None:
        """The next message: its tag and what it holds."""
        if len(stream) < 5:
            return None
        size = number(stream.data, 1, 4)
        if size < 4 or len(stream) < 1 + size:
            return None
        raw = stream.take(1 + size)
        return raw[:1], raw[5:]

    def _startup(self) -> bool:
        if len(self.client) < 8:
            return False
        size = number(self.client.data, 0, 4)
        if not 8 <= size <= 10000 or len(self.client) < size:
            return False
        self.client.take(size)
        return True

    def _parameter(self, body: bytes) -> None:
        name, _, rest = body.partition(b"\0")
        if name == b"server_version" and rest:
            self.version = lossy(rest.split(b"\0")[0])

    def advance(self, ts: int):
        if self.state == "waiting_for_startup":
            while not self._startup():
                found = self._tagged(self.server)
                if found is None or found[0] not in (b"N", b"S"):
                    return
            self.state = "in_auth"
        if self.state == "in_auth" and not self._authenticated():
            return
        while True:
            if self.state == "ready":
                found = self._tagged(self.client)
                if found is None or found[0] == b"X":
                    return
                self._command(*found, ts)
            else:
                found = self._tagged(self.server)
                if found is None:
                    return
                tag, body = found
                if tag == b"E":
                    self.error = next((lossy(f[1:]) for f in reversed(body.split(b"\0")) if f[:1] == b"M"), "")
                elif tag == b"S":
                    self._parameter(body)
                elif tag == b"Z":
                    statement, error, self.statement, self.error = self.statement, self.error, None, None
                    self.state = "ready"
                    yield _reply("postgres", statement, ts, 0 if error is None else 1, error)

    def _authenticated(self) -> bool:
        while self._tagged(self.client):
            pass
        while found := self._tagged(self.server):
            if found[0] == b"S":
                self._parameter(found[1])
            elif found[0] in (b"Z", b"E"):
                self.state = "ready"
                return True
        return False

    def _command(self, tag: bytes, body: bytes, ts: int) -> None:
        if tag in (b"Q", b"P"):
            strings = body.split(b"\0")
            self.statement = _Statement(lossy(strings[0] if tag == b"Q" or len(strings) < 2 else strings[1]), ts)
            self.state = "in_simple_query" if tag == b"Q" else "in_extended_query"
        elif tag in (b"B", b"D", b"E", b"H", b"S") and self.statement:
            self.state = "in_extended_query"
