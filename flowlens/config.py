"""Settings: defaults, a TOML file laid over them, and checks."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class PiiMode:
    """Beyond patterns: `disabled`, or `external`, a service that sees a share of the texts. (A token model is a function that is
    given to `privacy.model_entities`; a file can't name one.)"""

    kind: str = "disabled"
    url: str | None = None
    sample_rate: float = 0.0
    timeout_ms: int = 100


@dataclass
class PiiSettings:
    enabled: bool = True
    regex_enabled: bool = True
    redact: bool = True
    min_confidence: float = 0.7
    mode: PiiMode = field(default_factory=PiiMode)


@dataclass
class GraphSettings:
    enabled: bool = True
    aggregation_window_secs: int = 10
    stale_edge_timeout_secs: int = 300
    identity_cache_ttl_secs: int = 300


@dataclass
class SpanSettings:
    enabled: bool = False
    service_name: str = "flowlens"


@dataclass
class Settings:
    """What the job acts on. A file may hold more, as files for other tools do: queue sizes, addresses to listen on and scan intervals
    mean nothing to Spark and are passed over."""

    capture_enabled: bool = True
    pid_filter: list[int] | None = None
    max_events_per_sec: int = 0  # no limit: Spark slows a source down where it must, and loses nothing
    max_connections_tracked: int = 0  # no bound: silent sessions go by time
    idle_connection_timeout_secs: int = 30
    sampling_mode: str = "full"
    head_bytes: int = 4096
    sample_rate: float = 1.0
    pii: PiiSettings = field(default_factory=PiiSettings)
    pii_external_url_allowlist: list[str] = field(default_factory=list)
    graph: GraphSettings = field(default_factory=GraphSettings)
    log_events: bool = False
    json_export_path: str | None = None
    pii_audit_log_path: str | None = None
    span_export_path: str | None = None
    edge_path: str | None = None
    otlp: SpanSettings = field(default_factory=SpanSettings)


def _lay_over(base, given: dict) -> None:
    known = {f.name for f in fields(base)}
    for key, value in given.items():
        if key not in known:
            continue
        current = getattr(base, key)
        if is_dataclass(current):
            if not isinstance(value, dict):
                raise ValueError(f"{key} must be a table")
            _lay_over(current, value)
        else:
            setattr(base, key, value)


def check(settings: Settings) -> Settings:
    if not 0.0 <= settings.pii.mode.sample_rate <= 1.0:
        raise ValueError("pii.mode.sample_rate must lie between 0 and 1")
    if not 0.0 <= settings.sample_rate <= 1.0:
        raise ValueError("sample_rate must lie between 0 and 1")
    if settings.sampling_mode not in ("full", "connection_sample", "head_only"):
        settings.sampling_mode = "full"
    return settings


def parse(text: str) -> Settings:
    """Settings from TOML text: what it leaves out keeps its default, unknown keys are passed over."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"not TOML: {error}") from None
    settings = Settings()
    _lay_over(settings, given)
    return check(settings)


def load(path: str) -> Settings:
    with open(path, encoding="utf-8") as file:
        return parse(file.read())
