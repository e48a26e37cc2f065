"""Allow-lists of URLs."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, functions as F

#: Default ports.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _canonical(entry: str) -> tuple[str | None, str | None, bool]:
    """Origin and URL of an entry of the list in one form, and whether it names an origin only."""
    try:
        parts = urlsplit(entry)
        port = parts.port or DEFAULT_PORTS.get(parts.scheme.lower())
    except ValueError:
        return None, None, False
    if not parts.hostname or port is None:
        return None, None, False
    origin = f"{parts.scheme.lower()}://{parts.hostname.lower()}:{port}"
    path = parts.path or "/"
    return origin, origin + path + (f"?{parts.query}" if parts.query else ""), path == "/" and not parts.query


def allowed(url: Column, allowlist: list[str]) -> Column:
    """Whether a URL is on the list: an entry may be a host (any scheme and port), an origin, or a whole URL; the case of
    scheme and host doesn't count. False for what is no URL."""
    part = [F.regexp_extract(url, _PARTS, i) for i in range(1, 6)]
    scheme, host = F.lower(part[0]), F.lower(part[1])
    port = F.when(part[2] != "", part[2])
    for name, default in DEFAULT_PORTS.items():
        port = F.coalesce(port, F.when(scheme == name, F.lit(str(default))))
    origin = F.concat(scheme, F.lit("://"), host, F.lit(":"), port)
    whole = F.concat(origin, F.when(part[3] == "", F.lit("/")).otherwise(part[3]), F.when(part[4] != "", F.concat(F.lit("?"), part[4])).otherwise(F.lit("")))
    hosts, origins, wholes = [], [], []
    for entry in map(str.strip, allowlist):
        if not entry:
            continue
        hosts.append(entry.lower())
        entry_origin, entry_whole, only_origin = _canonical(entry)
        origins += [entry_origin] if only_origin else []
        origins += [entry.lower()]
        wholes += [entry_whole] if entry_whole else []
    none = F.lit(False)
    out = (host.isin(*hosts) if hosts else none) | (origin.isin(*origins) if origins else none) | (whole.isin(*wholes) if wholes else none)
    return F.coalesce((host != "") & out, none)
