"""Types of the OTLP envelope and of the flat tables made from it."""

from __future__ import annotations

#: One attribute value; exactly one field is set. A typed bag, as a boolean false is not the text "false".
ANY_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>"
ATTRIBUTES = f"array<struct<key:string,value:{ANY_VALUE}>>"
RESOURCE = f"struct<attributes:{ATTRIBUTES}>"
SCOPE = f"struct<name:string,version:string,attributes:{ATTRIBUTES}>"

NUMBER_POINT = f"struct<startTimeUnixNano:string,timeUnixNano:string,asInt:string,asDouble:double,attributes:{ATTRIBUTES}>"
HISTOGRAM_POINT = (
    "struct<startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,"
    f"bucketCounts:array<string>,explicitBounds:array<double>,attributes:{ATTRIBUTES}>"
)
METRIC = (
    "struct<name:string,description:string,unit:string,"
    f"gauge:struct<dataPoints:array<{NUMBER_POINT}>>,"
    f"sum:struct<aggregationTemporality:int,isMonotonic:boolean,dataPoints:array<{NUMBER_POINT}>>,"
    f"histogram:struct<aggregationTemporality:int,dataPoints:array<{HISTOGRAM_POINT}>>>"
)
LOG = (
    "struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:struct<stringValue:string>,attributes:{ATTRIBUTES}>"
)
SPAN_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{ATTRIBUTES}>"
SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:int,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,attributes:{ATTRIBUTES},events:array<{SPAN_EVENT}>,status:struct<code:int,message:string>>"
)


def envelope(signal: str) -> str:
    """Schema of one OTLP JSON document of ``signal``: logs, metrics or traces. ``headers`` are the request's, if kept."""
    record, records, outer, inner = {
        "logs": (LOG, "logRecords", "resourceLogs", "scopeLogs"),
        "metrics": (METRIC, "metrics", "resourceMetrics", "scopeMetrics"),
        "traces": (SPAN, "spans", "resourceSpans", "scopeSpans"),
    }[signal]
    return (
        f"{outer} array<struct<resource:{RESOURCE},{inner}:array<struct<scope:{SCOPE},{records}:array<{record}>>>>>, headers map<string,string>"
    )


#: Hook events of the turn protocol: one flat JSON object a row. Fields not listed are never read.
HOOK_EVENT = (
    "hook_event_name string, session_id string, turn_id string, tool_use_id string, tool_name string, model string, "
    "permission_mode string, prompt string, tool_response string, time_ns bigint"
)

#: Status-line snapshots.
STATUS_LINE = (
    "session_id string, conversation_id string, model struct<id:string,display_name:string>, version string, product string, "
    "context_window struct<total_input_tokens:bigint,total_output_tokens:bigint,context_window_size:bigint,used_percentage:double,"
    "remaining_percentage:double,current_usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,"
    "cache_read_input_tokens:bigint>>, quota map<string,struct<remaining_fraction:double,reset_time:string>>, agent_state string, "
    "execution_mode string, pending_input_count bigint, tool_confirmation_pending boolean, exceeds_200k_tokens boolean, "
    "artifact_count bigint, task_count bigint, terminal_width bigint, time_ns bigint"
)
