"""Shapes of the engine's tables: requests, attempts and results."""

from __future__ import annotations

PART = "struct<type:string,text:string,image_url:struct<url:string>>"
MESSAGE = f"struct<role:string,content:string,parts:array<{PART}>>"
CHOICES = "array<struct<content:string,finish_reason:string>>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"

#: What a source yields: one row for each parsed item of a line, record or list entry.
ITEM = "source_file string, source_dir string, line_num bigint, item_idx int, n_same int, raw string"

#: One chat request. content or parts of a message is set, never both; additional_data is JSON text or null.
REQUEST = f"request_id string, prompt string, messages array<{MESSAGE}>, images array<string>, additional_data string, source_file string, source_dir string, line_num bigint, item_idx int, dispatch_cost double"

#: One try of a request at a server.
ATTEMPT = "request_id string, attempt int, server string, ok boolean, error_type string, error string, latency_ms double, backoff_s double, cost double"

#: One answered or failed request.
RESULT = f"request_id string, model_output string, error string, additional_data string, source_file string, source_dir string, line_num bigint, item_idx int, attempts array<struct<{ATTEMPT.replace(' ', ':').replace(',:', ',')}>>"
