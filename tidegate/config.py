"""Configuration: layered loading, and findings instead of first errors. No Spark here."""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from .model import MALFORMED_POLICIES, OVER_MAX_POLICIES, UNFETCHABLE_POLICIES, UNRELAYABLE_POLICIES, RelayOptions

ENV_PREFIX = "TIDEGATE_"
EXIT_BAD_CONFIG = 78
ENTRY_BYTES = 64

#: Keys with their defaults; the type of the default is the key's type. None: required text.
DEFAULTS: dict[str, object] = {
    "route.source": None,
    "route.destination": None,
    "route.dlq": "",
    "route.schedule-log": "",
    "route.relay.provenance": True,
    "route.relay.timestamps": "DISPATCH",
    "route.relay.partitioning": "BY_KEY",
    "route.relay.on-unrelayable": "DLQ",
    "delay.max": "P1D",
    "delay.on-malformed": "DLQ",
    "delay.on-over-max": "DLQ",
    "headers.prefix": "relay-",
    "headers.accept-binary-long-values": False,
    "ingest.max-batch": 2000,
    "dispatch.max-batch": 10_000,
    "dispatch.max-bytes": 32 << 20,
    "dispatch.time-slice": "PT1M",
    "dispatch.idle-commit": "PT30S",
    "observability.kind": "none",
    "observability.port": 8081,
    "observability.bind-address": "127.0.0.1",
    "instance.id": "",
    "dispatch.on-unfetchable": "DLQ",
    "dispatch.cursor.sidecar-max-bytes": 3072,
    "dispatch.fetch.timeout": "PT30S",
    "dispatch.fetch.floor": "PT2S",
    "dispatch.penalty.initial": "PT0.05S",
    "dispatch.penalty.max": "PT10S",
    "dispatch.pending.max-per-partition": 2_000_000,
    "dispatch.pending.max-total": 0,
    "store.type": "log",
    "source.max-poll-interval": "PT5M",
}

#: Reader options that the engine sets itself, and why.
LOCKED = {
    "kafka.isolation.level": "uncommitted records must never be scheduled",
    "kafka.enable.auto.commit": "offsets belong to the checkpoint",
    "kafka.group.id": "Spark assigns partitions itself",
    "kafka.key.deserializer": "keys stay bytes",
    "kafka.value.deserializer": "values stay bytes",
    "kafka.key.serializer": "keys stay bytes",
    "kafka.value.serializer": "values stay bytes",
    "failOnDataLoss": "lost offsets must stop the query",
    "includeHeaders": "delays are headers",
    "subscribe": "the route names the topic",
    "checkpointLocation": "the query sets it",
}


@dataclass(frozen=True)
class Finding:
    severity: str
    path: str
    message: str


@dataclass
class Report:
    findings: list[Finding] = field(default_factory=list)

    def error(self, path: str, message: str) -> None:
        self.findings.append(Finding("ERROR", path, message))

    def warn(self, path: str, message: str) -> None:
        self.findings.append(Finding("WARNING", path, message))

    def info(self, path: str, message: str) -> None:
        self.findings.append(Finding("INFO", path, message))

    @property
    def ok(self) -> bool:
        return all(f.severity != "ERROR" for f in self.findings)


_DURATION = re.compile(r"\A([+-]?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d{1,9})?)S)?)?\Z", re.I)


def duration_ms(text: str) -> int:
    """Milliseconds of an ISO-8601 duration of days and smaller, held within the long range."""
    m = _DURATION.match(text)
    if not m or not any(m.groups()[1:]):
        raise ValueError(f"{text!r} is no ISO-8601 duration")
    whole, _, part = (m[5] or "0").partition(".")
    ms = ((int(m[2] or 0) * 24 + int(m[3] or 0)) * 60 + int(m[4] or 0)) * 60_000 + int(whole) * 1000 + int((part + "000")[:3])
    return max(-(2**63), min(2**63 - 1, -ms if m[1] == "-" else ms))


def flattened(tree: Mapping, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for key, value in tree.items():
        path = f"{prefix}{key}"
        if isinstance(value, Mapping):
            out |= flattened(value, path + ".")
        else:
            out[path] = value
    return out


def env_path(name: str) -> str | None:
    """The key that an environment variable sets: __ parts levels, _ stands for a dash."""
    if not name.startswith(ENV_PREFIX):
        return None
    return ".".join(p.lower().replace("_", "-") for p in name[len(ENV_PREFIX) :].split("__"))


#: Keys that people look for under another name.
MOVED = {"dispatch.delay.max": "delay.max", "route.dead-letter": "route.dlq", "ingest.on-malformed": "delay.on-malformed", "dispatch.budget": "dispatch.max-bytes", "route.on-unrelayable": "route.relay.on-unrelayable"}


def suggestion(path: str) -> str:
    if path in MOVED:
        return f"; it is {MOVED[path]} here"
    plain = {re.sub(r"[-_.]", "", k).lower(): k for k in DEFAULTS}
    same = plain.get(re.sub(r"[-_.]", "", path).lower())
    near = [same] if same else difflib.get_close_matches(path, DEFAULTS, 1)
    return f"; did you mean {near[0]}?" if near else ""


def interpolated(value: object, env: Mapping[str, str], path: str, report: Report) -> object:
    """${env:NAME} and ${env:NAME:-default} in text."""
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            report.error(path, f"environment variable {m[1]} is not set")
            return ""
        return m[2]

    return re.sub(r"\$\{env:([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}", one, value)


def _typed(path: str, value: object, report: Report) -> object:
    default = DEFAULTS[path]
    try:
        if isinstance(default, bool):
            if isinstance(value, bool):
                return value
            return {"true": True, "false": False}[str(value).lower()]
        if isinstance(default, int):
            return int(str(value).replace("_", ""))
        return str(value)
    except (KeyError, ValueError):
        report.error(path, f"{value!r} is no {type(default).__name__}")
        return default


def parse_yaml(text: str) -> dict:
    """The plain subset of YAML that configuration needs: nested maps by indentation, scalars, comments."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for number, line in enumerate(text.splitlines(), 1):
        bare = re.sub(r"(?:\A|\s)#.*$", "", line).rstrip()
        if not bare.strip():
            continue
        m = re.match(r"( *)([A-Za-z0-9_.-]+):(?:\s+(.*))?$", bare)
        if not m:
            raise ValueError(f"line {number}: expected key: value")
        depth = len(m[1])
        while stack[-1][0] >= depth:
            stack.pop()
        if m[3] is None:
            stack[-1][1][m[2]] = child = {}
            stack.append((depth, child))
        else:
            raw = m[3].strip()
            quoted = re.match(r"\A(['\"])(.*)\1\Z", raw)
            plain: object = quoted[2] if quoted else {"true": True, "false": False, "null": None, "~": None}.get(raw, raw)
            stack[-1][1][m[2]] = int(plain) if isinstance(plain, str) and not quoted and re.match(r"\A-?\d+\Z", plain) else plain
    return root


def load(source: str | Path | Mapping | None = None, env: Mapping[str, str] | None = None, overrides: Mapping[str, object] | None = None, memory_bytes: int = 0, partitions: int = 1) -> tuple[dict[str, object], Report]:
    """Defaults, then the file or mapping, then the environment, then overrides; with findings. `memory_bytes` is what the state of so many source partitions may take (0: any)."""
    report, env = Report(), env or {}
    if isinstance(source, (str, Path)):
        try:
            source = parse_yaml(Path(source).read_text())
        except (OSError, ValueError) as e:
            report.error("", f"can't be read: {e}")
            source = {}
    layers = [flattened(source or {}), {p: v for k, v in env.items() if (p := env_path(k))}, dict(overrides or {})]
    out = dict(DEFAULTS)
    for layer in layers:
        for path, value in layer.items():
            if path.startswith("source.options."):
                option = path.removeprefix("source.options.")
                if option in LOCKED:
                    report.error(path, f"is set by the engine: {LOCKED[option]}")
                out[path] = value
            elif path not in DEFAULTS:
                report.error(path, f"unknown key{suggestion(path)}")
            elif value is not None:
                out[path] = _typed(path, interpolated(value, env, path, report), report)
    validate(out, report, memory_bytes, partitions)
    return out, report


def validate(config: Mapping[str, object], report: Report, memory_bytes: int = 0, partitions: int = 1) -> None:
    for path in ("route.source", "route.destination"):
        if not config[path]:
            report.error(path, "is required")
    policies = {"delay.on-malformed": MALFORMED_POLICIES, "delay.on-over-max": OVER_MAX_POLICIES, "dispatch.on-unfetchable": UNFETCHABLE_POLICIES, "route.relay.on-unrelayable": UNRELAYABLE_POLICIES}
    for path, allowed in policies.items():
        value = config[path]
        if value not in allowed:
            report.error(path, f"{value!r} is not one of {', '.join(allowed)}")
        elif value == "DLQ" and not config["route.dlq"]:
            report.error("route.dlq", f"is required by {path}: DLQ")
        elif value == "FAIL":
            report.warn(path, "FAIL stops the query at the first such record")
    lengths: dict[str, int] = {}
    for path in ("delay.max", "dispatch.time-slice", "dispatch.idle-commit", "dispatch.fetch.timeout", "dispatch.fetch.floor", "dispatch.penalty.initial", "dispatch.penalty.max", "source.max-poll-interval"):
        try:
            lengths[path] = duration_ms(str(config[path]))
            if lengths[path] <= 0:
                report.error(path, "must be positive")
        except ValueError as e:
            report.error(path, str(e))
    for path in ("ingest.max-batch", "dispatch.max-batch", "dispatch.max-bytes", "dispatch.pending.max-per-partition"):
        if not isinstance(config[path], int) or config[path] <= 0:
            report.error(path, "must be positive")
    if not 128 <= int(config["dispatch.cursor.sidecar-max-bytes"]) <= 1 << 20:
        report.error("dispatch.cursor.sidecar-max-bytes", "must be 128 to 1048576")
    if lengths.get("dispatch.penalty.max", 1) < lengths.get("dispatch.penalty.initial", 0):
        report.error("dispatch.penalty.max", "must not be below dispatch.penalty.initial")
    if lengths.get("dispatch.time-slice", 0) > lengths.get("source.max-poll-interval", 0) // 3:
        report.error("dispatch.time-slice", "must not be over a third of source.max-poll-interval")
    port = config["observability.port"]
    if not isinstance(port, int) or not 0 <= port <= 65_535:
        report.error("observability.port", "must be 0 to 65535")
    if config["observability.bind-address"] in ("", "0.0.0.0"):
        report.warn("observability.bind-address", "health and counters are open to every network")
    if memory_bytes:
        need = partitions * int(config["dispatch.pending.max-per-partition"]) * ENTRY_BYTES
        tell = report.error if need > memory_bytes else report.warn if 2 * need > memory_bytes else report.info
        tell("dispatch.pending.max-per-partition", f"worst case of pending state is {need} of {memory_bytes} bytes")


def retention_findings(delay_max_ms: int, retention_ms: int, report: Report, tombstone_ms: int | None = None, transaction_timeout_ms: int = 0) -> None:
    """Whether source and log keep records long enough: source delay.max + 1 h, tombstones max(2 * timeout, 1 h)."""
    hour = 3_600_000
    if 0 <= retention_ms < delay_max_ms + hour:
        report.error("route.source", f"retention {retention_ms} ms is below delay.max + 1 h")
    elif 0 <= retention_ms < 2 * delay_max_ms:
        report.warn("route.source", "retention is below twice delay.max")
    if tombstone_ms is not None and tombstone_ms < max(2 * transaction_timeout_ms, hour):
        report.error("route.schedule-log", "tombstones go too early for a restart")


def foreign_writers(principals: set[str], own: set[str]) -> set[str]:
    """Who may write to the schedule log besides the engine."""
    return principals - own


class ConfigView:
    """The keys below a prefix, read by type; a missing key without a default, or a value of another type, raises ValueError with the whole path."""

    def __init__(self, values: Mapping[str, object], prefix: str = ""):
        self._values, self._prefix = values, prefix

    def keys(self) -> set[str]:
        return {k.removeprefix(self._prefix) for k, v in self._values.items() if k.startswith(self._prefix) and v is not None}

    def _read(self, key: str, default: object, kind: str, convert):
        value = self._values.get(self._prefix + key)
        if value is None:
            if default is None:
                raise ValueError(f"{self._prefix + key} is required")
            return default
        try:
            return convert(value)
        except (KeyError, ValueError) as e:
            raise ValueError(f"{self._prefix + key}: {value!r} is no {kind}") from e

    def text(self, key: str, default: str | None = None) -> str:
        return self._read(key, default, "text", str)

    def integer(self, key: str, default: int | None = None) -> int:
        return self._read(key, default, "whole number", lambda v: int(str(v).replace("_", "")))

    def duration_ms(self, key: str, default: int | None = None) -> int:
        return self._read(key, default, "duration", lambda v: duration_ms(str(v)))

    def flag(self, key: str, default: bool | None = None) -> bool:
        return self._read(key, default, "flag", lambda v: {"true": True, "false": False}[str(v).lower()])


SIDES = ("ingest", "dispatch")


def group_id(application: str, side: str) -> str:
    """The name of a side's query: checkpoints, ledgers and consumer groups bear it."""
    if side not in SIDES or not re.fullmatch(r"[A-Za-z0-9._-]+", application):
        raise ValueError(f"{application!r} / {side!r} make no id")
    return f"tidegate.{application}.{side}"


def member_id(application: str, side: str, instance: str) -> str | None:
    """The name that a member keeps over restarts; none for an instance called random."""
    return None if instance == "random" else f"{group_id(application, side)}.{instance}"


def writer_id(application: str, side: str, instance: str, worker: int) -> str:
    """The name under which one worker of an instance writes; equal after a restart, so that the newer one is known to replace the older."""
    return f"{group_id(application, side)}.{instance}.{worker}"


def relay_options(config: Mapping[str, object]) -> RelayOptions:
    from .model import HeaderNames

    return RelayOptions(
        delay_max_ms=duration_ms(str(config["delay.max"])),
        on_malformed=str(config["delay.on-malformed"]),
        on_over_max=str(config["delay.on-over-max"]),
        on_unfetchable=str(config["dispatch.on-unfetchable"]),
        on_unrelayable=str(config["route.relay.on-unrelayable"]),
        binary_values=bool(config["headers.accept-binary-long-values"]),
        provenance=bool(config["route.relay.provenance"]),
        timestamps=str(config["route.relay.timestamps"]),
        partitioning=str(config["route.relay.partitioning"]),
        names=HeaderNames(str(config["headers.prefix"])),
    )


def config_argument(argv: list[str], env: Mapping[str, str]) -> str | None:
    """--config X, --config=X, the environment, or none."""
    for k, arg in enumerate(argv):
        if arg == "--config" and k + 1 < len(argv):
            return argv[k + 1]
        if arg.startswith("--config="):
            return arg.removeprefix("--config=")
    return env.get(f"{ENV_PREFIX}CONFIG")
