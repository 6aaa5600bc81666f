"""Schemas of the engine's relations."""

from __future__ import annotations

DEFINITIONS = (
    "entry_seq long, term string, type string, file string, line int, column int, context string, "
    "surrounding_lines array<string>, related_terms array<string>, language string, metadata string"
)
REFS = "ref_seq long, target_term string, reference_type string, file string, line int, column int, context string, metadata string"
FILES = "path string, content string, size long, mtime timestamp, hash string"
FILE_NODES = "path string, parent string, name string, depth int, type string, hash string, size long, mtime timestamp"
CONCEPT_GROUPS = "name string, description string, emoji string, terms array<string>, origin string"
CHANGES = "path string, status string, is_staged boolean, seq int"
SESSIONS = "id string, project_path string, created_at long, last_accessed_at long, metadata string"
SESSION_HISTORY = "session_id string, timestamp long, type string, query string, response_summary string"
ACTIVITY = "id string, parent_tool_use_id string, type string, name string, status string, start_time long, end_time long, tool string"
FILE_HASHES = "path string, hash string"
LLM_EVENTS = "seq long, raw string"
