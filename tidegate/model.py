"""Record shapes, header names and policy values of the relay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG_MAX = 2**63 - 1
LONG_MIN = -(2**63)

#: A log record as Spark's Kafka source gives it with headers, in epoch milliseconds.
#: Headers are an array, not a map: they repeat, and their order counts.
HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))
SOURCE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("timestamp_type", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS),
    ]
)
#: The schedule log: pointers, never payloads.
SCHEDULE_LOG = T.StructType(
    [
        T.StructField("source_partition", T.IntegerType()),
        T.StructField("log_offset", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("source_offset", T.LongType()),
        T.StructField("dispatch_at_ms", T.LongType()),
        T.StructField("clamped", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)

# Timestamp types of a log record.
NO_TIMESTAMP_TYPE = -1
CREATE_TIME = 0

# Outcomes of header parsing, actions, policies and reasons.
OUTCOMES = ("NO_DELAY", "RELAY_IMMEDIATELY", "SCHEDULE", "MALFORMED", "OVER_MAX")
MALFORMED_POLICIES = ("DLQ", "RELAY_IMMEDIATE", "FAIL")
OVER_MAX_POLICIES = ("DLQ", "CLAMP", "FAIL")
UNFETCHABLE_POLICIES = ("DLQ", "DROP", "FAIL")
UNRELAYABLE_POLICIES = ("DLQ", "DROP", "FAIL")
COMPLETION_REASONS = ("DISPATCHED", "PAYLOAD_MISSING_DLQ", "DROPPED", "REJECTED")
MALFORMED_HEADER = "malformed-header"
OVER_MAX_DELAY = "over-max-delay"
UNRELAYABLE = "unrelayable"
PAYLOAD_EXPIRED = "payload-expired"


@dataclass(frozen=True)
class HeaderNames:
    """Names of the control and provenance headers; the prefix is configurable."""

    prefix: str = "relay-"

    def of(self, name: str) -> str:
        return self.prefix + name

    @property
    def delay_ms(self) -> str:
        return self.of("delay-ms")

    @property
    def deliver_at(self) -> str:
        return self.of("deliver-at")

    @property
    def control(self) -> tuple[str, str]:
        return self.delay_ms, self.deliver_at


@dataclass(frozen=True)
class RelayOptions:
    """What decides how records are classified and relayed."""

    delay_max_ms: int = 86_400_000
    on_malformed: str = "DLQ"
    on_over_max: str = "DLQ"
    on_unfetchable: str = "DLQ"
    on_unrelayable: str = "DLQ"
    binary_values: bool = False
    provenance: bool = True
    timestamps: str = "DISPATCH"
    partitioning: str = "BY_KEY"
    max_message_bytes: int = 1_048_576
    #: Largest record that the dead-letter topic takes; 0: any that the source has.
    max_dlq_bytes: int = 0
    names: HeaderNames = field(default_factory=HeaderNames)

    def __post_init__(self):
        for value, allowed in ((self.on_malformed, MALFORMED_POLICIES), (self.on_over_max, OVER_MAX_POLICIES), (self.on_unfetchable, UNFETCHABLE_POLICIES), (self.on_unrelayable, UNRELAYABLE_POLICIES), (self.timestamps, ("DISPATCH", "SOURCE")), (self.partitioning, ("BY_KEY", "SOURCE_PARTITION"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {', '.join(allowed)}")
        if self.delay_max_ms <= 0:
            raise ValueError("delay_max_ms must be positive")
