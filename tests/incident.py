"""A small incident, row by row; the results that tests expect are worked out by hand.

The cart service is slow and fails after a deployment; the mail service is slow without
errors, the feed service fails without being slow. Started 14:05, detected 14:20, so its
window is 13:35 to 14:35, both ends included.
"""

from datetime import datetime

SERVICES = [(1, "cart"), (2, "mail"), (3, "feed")]
STARTED, DETECTED = "14:05:00", "14:20:00"

# (id, service, time, level)
LOGS = [
    ("l1", 1, "13:34:59.999999", "info"),
    ("l2", 1, "13:35:00", "info"),
    ("l3", 1, "14:04:10", "warn"),
    ("l4", 1, "14:06:00", "error"),
    ("l5", 1, "14:11:30", "error"),
    ("l6", 1, "14:35:00", "error"),
    ("l7", 1, "14:35:00.000001", "info"),
    ("l8", 2, "14:07:00", "info"),
    ("l9", 3, "14:08:00", "error"),
]
# (id, service, time, name, unit, value)
METRICS = [
    ("m1", 1, "13:00:00", "p95_latency_ms", "ms", 100.0),
    ("m2", 1, "14:00:00", "p95_latency_ms", "ms", 300.0),
    ("m3", 1, "14:06:00", "p95_latency_ms", "ms", 1500.0),
    ("m4", 1, "14:12:00", "p95_latency_ms", "ms", 2400.0),
    ("m5", 1, "14:02:00", "http_error_rate", "ratio", 0.25),
    ("m6", 1, "14:10:00", "http_error_rate", "ratio", 0.5),
    ("m7", 2, "14:03:00", "p95_latency_ms", "ms", 1900.0),
    ("m8", 3, "14:03:00", "p95_latency_ms", "ms", 200.0),
]
# (id, service, version, time)
DEPLOYMENTS = [
    ("d1", 1, "v7", "13:50:00"),
    ("d2", 1, "v6", "10:00:00"),
    ("d3", 2, "v3", "13:00:00"),
    ("d4", 1, "v8", "14:40:00"),
]


def at(clock):
    return datetime.fromisoformat(f"2025-03-04T{clock}")


def posted():
    """The incident as one telemetry batch."""
    name = dict(SERVICES)

    def stamp(clock):
        return f"2025-03-04T{clock}Z"

    return {
        "generatedAt": stamp("15:00:00"),
        "services": [
            dict(name=n, displayName=n, description="d", ownerTeam="t", runtime="go", criticality="high")
            for n in name.values()
        ],
        "deployments": [
            dict(
                serviceName=name[s], version=version, commitSha="c", deployedBy="bot", environment="production",
                status="succeeded", deployedAt=stamp(clock), metadata={"change": version},
            )
            for _, s, version, clock in DEPLOYMENTS
        ],
        "logs": [
            dict(serviceName=name[s], timestamp=stamp(clock), level=level, message="m", attributes={"place": key, "n": 1})
            for key, s, clock, level in LOGS
        ],
        "metrics": [
            dict(serviceName=name[s], timestamp=stamp(clock), metricName=metric, unit=unit, metricValue=value)
            for _, s, clock, metric, unit, value in METRICS
        ],
        "incidents": [
            dict(
                id="cart-slow", title="Cart is slow", serviceName="cart", severity="sev2", startedAt=stamp(STARTED),
                detectedAt=stamp(DETECTED), detectionReason="latency over the limit", suspectedRootCause="v7",
                affectedSignals=["p95_latency_ms"],
            )
        ],
    }
