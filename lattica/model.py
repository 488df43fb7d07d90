"""The data model: a property graph as two DataFrames, and the registries that its queries need."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType([T.StructField(n, T.IntegerType() if n in ("line", "end_line") else T.StringType()) for n in ("id", "kind", "name", "fqn", "file", "line", "end_line", "module", "doc", "lang", "entry_kind", "attrs")])
EDGES = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(n, T.IntegerType() if n in ("line", "conf_rank") else T.StringType()) for n in ("src", "dst", "kind", "file", "line", "confidence", "conf_rank", "attrs", "gate"))])
#: One hop of an evidence path.
HOP = "struct<from:string,kind:string,to:string,at:string,confidence:string,gated:string>"

# Confidence ranks, edge kinds, kinds of entry points, findings.
CONFIDENCE = {"exact": 3, "resolved": 2, "heuristic": 1}
PROPAGATING = (
    "CALLS IMPLEMENTED_BY OVERRIDDEN_BY BOUND_TO ROUTES_TO USES_MIDDLEWARE HANDLED_BY SCHEDULES DISPATCHES LISTENED_BY READS_COLUMN WRITES_COLUMN "
    "MENTIONS_COLUMN READS_TABLE WRITES_TABLE USES_CONNECTION REGISTERS_CONNECTION READS_CONFIG WRITES_CONFIG READS_ENV REFERS_TO CONFIGURED_BY "
    "CONFIG_CONTAINS RENDERS USES_COMPOSABLE USES_STORE HTTP_CALLS MATCHES_ROUTE USES_I18N READS_SETTING WRITES_SETTING READS_INPUT VALIDATES "
    "VALIDATED_BY HAS_RESOLUTION FALLS_BACK_TO USES_TYPE ACCESSES_FIELD READS_PROP WRITES_PROP USES_VALUE REFERENCES_FN USES_UNSAFE GATED_BY INCLUDES "
    "AUTHORIZES_CHANNEL SUBSCRIBES_CHANNEL MATCHES_CHANNEL SENDS_TO RECEIVED_BY MATCHES_ENDPOINT CONNECTS_TO OFFERS_TOOL HANDS_OFF_TO"
).split()
NON_PROPAGATING = (
    "MAPS_TO_TABLE HAS_RELATION CONTAINS EXTENDS IMPLEMENTS USES_TRAIT INSTANTIATES INJECTS REFERENCES OBSERVED_BY DEFINES BINDS IMPORTS USES_LAYOUT "
    "REFERENCES_TYPE SHARES_STORAGE REGISTERS_CALLBACK USES_SCHEMA EMITS_STATE HANDLES_STATE NAVIGATES_TO PARSES_JSON BROADCASTS_ON LISTENS_FOR "
    "QUEUE_ROUTES CREDENTIAL_FROM COPY_OF TEST_CALLS TEST_USES TEST_HTTP TEST_VISITS"
).split()
ENTRY_CLASSES = {
    "runtime": "http_route websocket scheduled queue_job listener main ffi_export message_handler channel_auth llm_tool".split(),
    "library": "public_api".split(),
    "operator": "artisan_command management_command admin_panel cli_command".split(),
    "ui": "ui_page ui_global".split(),
    "dev": "test bench example build_script".split(),
    "other": "observer".split(),
}
# Protocols with their transport, matcher and flags.
PROTOCOLS = {
    "http": ("tcp", "path", ["guards"]),
    "ws": ("tcp", "path", ["guards"]),
    "sse": ("tcp", "path", ["guards"]),
    "graphql": ("tcp", "exact", ["guards"]),
    "pusher": ("tcp", "dotted", ["fanout"]),
    "nest-rpc": ("tcp", "exact", ["guards"]),
    "nest-event": ("tcp", "exact", ["fanout", "guards"]),
    "nest-ws": ("tcp", "exact", ["guards"]),
    "grpc": ("tcp", "exact", ["guards"]),
    "thrift": ("tcp", "exact", ["guards"]),
    "trpc": ("tcp", "exact", ["guards"]),
    "jsonrpc": ("tcp", "exact", ["guards"]),
    "bull": ("tcp", "exact", []),
    "laravel-queue": ("tcp", "exact", []),
    "celery": ("tcp", "exact", []),
    "job": ("tcp", "template", []),
    "queue": ("tcp", "exact", ["fanout", "no-entry"]),
    "laravel-event": ("local", "exact", ["fanout", "no-entry"]),
    "nest-event-emitter": ("local", "exact", ["fanout", "no-entry"]),
    "django-signal": ("local", "exact", ["fanout", "no-entry"]),
    "capacitor": ("row", "exact", ["no-entry"]),
    "react-native": ("row", "exact", ["no-entry"]),
    "flutter": ("row", "exact", ["no-entry"]),
    "flutter-event": ("row", "exact", ["no-entry"]),
    "pigeon": ("row", "exact", ["no-entry"]),
    "electron-ipc": ("row", "exact", ["no-entry"]),
    "electron-preload": ("row", "exact", ["no-entry"]),
    "tauri": ("row", "exact", ["no-entry"]),
    "mqtt": ("tcp", "mqtt", ["fanout"]),
    "nats": ("tcp", "nats", ["fanout"]),
    "amqp": ("tcp", "amqp", ["fanout"]),
    "kafka": ("tcp", "glob", ["fanout"]),
    "redis-pubsub": ("tcp", "glob", ["fanout"]),
    "redis-stream": ("tcp", "exact", ["fanout"]),
    "socketio": ("tcp", "template", ["guards", "directional"]),
    "webhook": ("tcp", "webhook", ["fanout", "guards"]),
    "worker": ("local", "exact", ["no-entry"]),
    "broadcastchannel": ("local", "exact", ["fanout", "no-entry"]),
    "postmessage": ("local", "glob", ["fanout", "guards"]),
    "extension": ("local", "extension", ["fanout", "guards"]),
    "native-messaging": ("ipc", "exact", []),
    "unix": ("ipc", "template", []),
    "pipe": ("ipc", "template", []),
    "dbus": ("ipc", "exact", []),
    "intent": ("ipc", "exact", ["guards"]),
    "intent-action": ("ipc", "exact", ["fanout", "guards"]),
    "aidl": ("ipc", "exact", []),
    "xpc": ("ipc", "exact", []),
    "darwin-notification": ("ipc", "exact", ["fanout"]),
    "isolate": ("local", "exact", []),
    "process": ("ipc", "exact", []),
    "tcp": ("tcp", "exact", []),
    "udp": ("udp", "exact", ["fanout"]),
    "mdns": ("udp", "exact", ["fanout"]),
    "osc": ("udp", "glob", ["fanout"]),
    "coap": ("udp", "path", []),
    "ssdp": ("udp", "exact", ["fanout"]),
    "llm_tool": ("local", "exact", []),
    "mcp_tool": ("tcp", "mcp", []),
    "mcp_resource": ("tcp", "mcp", []),
    "mcp_prompt": ("tcp", "mcp", []),
}
FINDINGS = {
    "hardcoded": ("high", "outbound"), "plaintext": ("medium", "outbound"), "unverified": ("high", "inbound"), "unguarded": ("medium", "inbound"),
    "exposed-listener": ("medium", "inbound"), "tls-off": ("high", "outbound"), "ipc-exposed": ("medium", "inbound"), "ssrf": ("high", "outbound"),
}

#: Kinds over which a call reaches its callee, test calls apart.
CALL_LIKE = [k for k in "CALLS IMPLEMENTED_BY OVERRIDDEN_BY BOUND_TO ROUTES_TO HANDLED_BY SCHEDULES DISPATCHES LISTENED_BY HTTP_CALLS MATCHES_ROUTE SENDS_TO RECEIVED_BY MATCHES_ENDPOINT REFERENCES_FN INSTANTIATES RENDERS".split() if k in PROPAGATING or k == "INSTANTIATES"]
DATA_USE = "READS_COLUMN WRITES_COLUMN MENTIONS_COLUMN READS_TABLE WRITES_TABLE USES_CONNECTION CONNECTS_TO".split()
