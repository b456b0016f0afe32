"""Names and patterns of the privacy stages, by profile."""

from __future__ import annotations

# Fixed value: resource attributes of traces and logs that the first stage deletes.
INITIAL_RESOURCE = r"(?i)(^|[._-])(arguments?|args|result|payload|prompt(?:[._-](?:content|text|length))?|completion(?:[._-](?:content|text))?|response(?:[._-](?:body|content|text|messages?))?|messages?|content|input(?:[._-](?:value|body|content|text|messages?))?|output(?:[._-](?:value|body|content|text|messages?))?|reasoning[._-]summary|tool[._-](?:arguments?|args|result|output|input|name)|mcp[._-](?:arguments?|result|payload|server|servers|server[._-]origin)|request[._-](?:body|headers?|id)|file[._-](?:path|content|name)|repository[._-](?:url|path|name)|code[._-](?:content|diff|filepath|file[._-]path)|process[._-](?:command(?:[._-]line)?|command[._-]args|executable[._-]path)|command[._-](?:line|output)|shell[._-]command|db[._-](?:statement|query[._-]text)|exception[._-](?:message|stacktrace)|error[._-]message|url[._-](?:full|path|query)|http[._-](?:url|target)|user[._-](?:email|name|account[._-]id)|email|account[._-]id|organization[._-]id|conversation[._-]id|call[._-]id|trace[._-]id|span[._-]id|endpoint|host[._-]name|auth(?:orization)?|cookie|api[._-]?key|access[._-]?token|refresh[._-]?token|password|secret|absolute[._-]?path)([._-]|$)"
# Fixed value: scope attributes of traces and logs.
INITIAL_SCOPE = r"(?i)(^|[._-])(arguments?|args|result|payload|prompt|completion|response|messages?|content|conversation[._-]id|call[._-]id|trace[._-]id|span[._-]id|account[._-]id|user[._-]account[._-]id|secret|token)([._-]|$)"
# Fixed value: attributes of spans and log records.
INITIAL_RECORD = r"(?i)(^|[._-])(arguments?|args|result|payload|prompt(?:[._-](?:content|text|length))?|completion|response|messages?|content|reasoning[._-]summary|tool[._-](?:arguments?|args|result|output|input|name)|mcp[._-](?:arguments?|result|payload|server|servers|server[._-]origin)|conversation[._-]id|request[._-]id|call[._-]id|trace[._-]id|span[._-]id|account[._-]id|user[._-]account[._-]id|endpoint|host[._-]name|path|branch|commit|email|secret|password|access[._-]?token)([._-]|$)"
# Fixed value: attributes of span events.
INITIAL_EVENT = r"(?i)(^|[._-])(arguments?|args|result|payload|prompt|completion|response|messages?|content|reasoning[._-]summary|tool[._-](?:arguments?|args|result|output|input|name)|conversation[._-]id|request[._-]id|call[._-]id|trace[._-]id|span[._-]id|account[._-]id|user[._-]account[._-]id|endpoint|path|email|secret|password|access[._-]?token)([._-]|$)"
# Fixed value: attributes of metric resources and data points.
INITIAL_METRIC = r"(?i)(conversation[._-]id|request[._-]id|call[._-]id|trace[._-]id|span[._-]id|account[._-]id|user[._-]account[._-]id|absolute[._-]?path|repository[._-]name|branch|commit)"
# Fixed value: resource attributes of traces and logs in the corporate profile.
CORPORATE_RESOURCE = r"(?i)(^|[._-])(arguments?|args|result|payload|prompt(?:[._-](?:content|text|length))?|completion|response|messages?|content|reasoning[._-]summary|tool[._-](?:arguments?|args|result|output|input|name)|mcp[._-](?:arguments?|result|payload|server|servers|server[._-]origin)|conversation[._-]id|request[._-]id|call[._-]id|trace[._-]id|span[._-]id|account[._-]id|user[._-]account[._-]id|endpoint|host[._-]name|path|branch|commit|email|secret|password|access[._-]?token)([._-]|$)"
# Fixed value: attributes of spans and log records in the corporate profile.
CORPORATE_RECORD = r"(?i)(^|[._-])(arguments?|args|result|payload|prompt|completion|response|messages?|content|reasoning[._-]summary|tool[._-](?:arguments?|args|result|output|input|name)|mcp[._-](?:arguments?|result|payload|server|servers|server[._-]origin)|conversation[._-]id|request[._-]id|call[._-]id|trace[._-]id|span[._-]id|account[._-]id|user[._-]account[._-]id|endpoint|host[._-]name|path|branch|commit|email|secret|password|access[._-]?token)([._-]|$)"
# Fixed value: all attributes.
EVERYTHING = r".*"
# Fixed value: attributes of traces and logs that the last stage deletes.
FINAL = r"(?i)(^|\.)(prompt\.(?:content|text)|completion\.(?:content|text)|messages?|content|input\.(?:value|body|content|text|messages?)|output\.(?:value|body|content|text|messages?)|response\.(?:body|content|text|messages?)|gen_ai\.(?:prompt|completion|input\.(?:messages?|content|text)|output\.(?:messages?|content|text)|response\.(?:body|content|text))|openinference\.(?:input|output)|tool(?:\.call)?\.(?:arguments|args|result|output|input)|mcp\.(?:arguments|result|payload)|request\.(?:body|headers?)|response\.(?:body|headers?)|http\.request\.(?:body|headers?)|http\.response\.(?:body|headers?)|file\.(?:path|content|name)|repository\.(?:url|path|name)|code\.(?:content|diff|filepath|file_path)|process\.(?:command(?:_line)?|command_args|executable\.path)|command\.(?:line|output)|shell\.command|db\.(?:statement|query\.text)|exception\.(?:message|stacktrace)|error\.message|url\.(?:full|path|query)|http\.(?:url|target)|user\.(?:email|name)|email|account\.id|organization\.id|auth(?:orization)?|cookie|api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret|absolute[_-]?path)(\.|$)"
# Keys that the last stage deletes from every bag of traces and logs.
FINAL_KEYS = (
    "prompt", "completion", "response", "input", "output", "content", "message", "messages", "tool.arguments", "tool.result", "tool.output",
    "tool.input",
)
# Resource keys that metrics keep in all profiles.
METRIC_RESOURCE_KEYS = (
    "service.name", "service.namespace", "service.version", "deployment.environment.name", "ai_observability.profile", "ai_agent.provider",
    "ai_agent.product", "ai_agent.surface", "ai_context.environment.profile", "ai_context.framework.version", "ai_context.workflow.type",
    "ai_context.task.type",
)
# Data point keys that metrics keep.
POINT_KEYS = (
    "event.name", "tool", "tool_name", "tool_category", "model", "model_id", "model_family", "agent_role", "operation", "success", "status", "type",
    "token_type", "task_type", "workflow_type", "stage", "skill", "skill_id", "mcp_server_name", "mcp_tool_name", "mcp_tool_id", "rule", "rule_id",
    "state", "outcome", "error_category", "evidence_class", "content_scope", "measurement_method", "source", "unit", "tier", "reused", "reason",
    "framework_version", "validation_type", "validation_tier", "wait_reason", "cost_unit", "cost_source", "gen_ai.operation.name",
    "gen_ai.provider.name", "gen_ai.request.model", "gen_ai.response.model", "ai_context.environment.profile", "ai_context.framework.version",
    "ai_context.workflow.type", "ai_context.workflow.stage", "ai_context.task.type", "ai_context.skill.id", "ai_context.rule.id",
    "ai_context.rule.state", "ai_context.validation.type", "ai_context.validation.tier", "ai_context.validation.reused", "ai_context.retry.reason",
    "ai_context.wait.reason", "ai_context.outcome", "ai_context.evidence.class", "ai_context.tool.category", "ai_context.model.family",
    "ai_context.token.type", "ai_context.error.category", "ai_context.cost.unit", "ai_context.cost.source",
)
# Data point keys that the corporate profile drops of those.
CORPORATE_POINT_DROPS = (
    "mcp_server_name", "mcp_tool_name", "mcp_tool_id", "content_scope", "measurement_method",
)
# Resource keys of traces and logs in the corporate profile.
CORPORATE_RESOURCE_KEYS = (
    "service.name", "service.namespace", "service.version", "deployment.environment.name", "telemetry.sdk.name", "telemetry.sdk.language",
    "telemetry.sdk.version", "ai_observability.profile", "ai_agent.provider", "ai_agent.product", "ai_agent.surface",
    "ai_context.environment.profile", "ai_context.framework.name", "ai_context.framework.version", "ai_context.workflow.type",
    "ai_context.workflow.stage", "ai_context.task.type", "ai_context.tool.category", "ai_context.model.family", "ai_context.evidence.class",
)
# Keys of spans, span events and log records in the corporate profile.
CORPORATE_RECORD_KEYS = (
    "event.name", "gen_ai.operation.name", "gen_ai.provider.name", "gen_ai.request.model", "gen_ai.response.model", "gen_ai.usage.input_tokens",
    "gen_ai.usage.output_tokens", "gen_ai.usage.cached_input_tokens", "gen_ai.usage.reasoning_tokens", "ai_context.operation.type",
    "ai_context.framework.version", "ai_context.workflow.type", "ai_context.workflow.stage", "ai_context.task.type", "ai_context.skill.id",
    "ai_context.rule.id", "ai_context.rule.state", "ai_context.context.loaded_files", "ai_context.context.loaded_bytes",
    "ai_context.context.estimated_tokens", "ai_context.validation.type", "ai_context.validation.tier", "ai_context.validation.fingerprint_hash",
    "ai_context.validation.reused", "ai_context.validation.invalidation_reason", "ai_context.retry.count", "ai_context.retry.reason",
    "ai_context.state", "ai_context.wait.reason", "ai_context.outcome", "ai_context.evidence.class", "ai_context.manual_correction",
    "ai_context.tool.category", "ai_context.model.family", "ai_context.token.type", "ai_context.error.category", "ai_context.duration.bucket",
    "ai_context.cost.value", "ai_context.cost.unit", "ai_context.cost.source", "ai_context.cost.rate_card.version",
    "ai_context.cost.attribution.confidence", "ai_agent.operation", "ai_agent.tool.category", "ai_agent.model.family", "ai_agent.evidence.class",
    "duration_ms", "success", "error.type",
)
# Constants that replace texts.
LOG_BODY, SPAN_NAME, EVENT_NAME = "AI telemetry metadata event", "AI telemetry operation", "AI telemetry event"
# Metrics of content sizes, which the corporate profile drops.
CONTENT_SIZE_METRICS = ("ai_agent.observed.user_prompt.bytes", "ai_agent.observed.mcp_tool_response.bytes")
