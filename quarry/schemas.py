"""Tables of the index and of its query log."""

from __future__ import annotations

CHUNKS = (
    "id long, source_name string, source_url string, title string, content string, embedding array<float>, repo_url string, file_path string, start_line int, end_line int, "
    "language string, chunk_index int, metadata string, indexed_at timestamp_ntz, commit_sha string, version string"
)
CHUNK_KEY = ["source_name", "file_path", "chunk_index"]
INDEX_STATE = "source_type string, source_key string, last_commit_sha string, last_indexed_at timestamp_ntz, status string, error_message string"
STATE_KEY = ["source_type", "source_key"]
QUERY_LOG = "tool_name string, query_text string, result_count int, top_score float, latency_ms int, source_name string, session_id string, created_at timestamp_ntz"
COLLECTED = "tool_name string, data string, created_at timestamp_ntz"
ITEMS = "id string, content string, title string, source_url string, metadata string"
