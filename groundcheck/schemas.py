"""Declared schemas of every table the engine reads or writes; nothing is inferred."""

from __future__ import annotations

STATUSES = ("pending", "downloaded", "dead", "inaccessible", "error")
VERDICTS = ("supported", "unsupported", "contradicted")
FETCH_METHODS = ("requests", "cloudscraper", "playwright", "local_file")

ANSWERS = "answer_id string, tool_name string, suffix string, text string"
REFERENCES = (
    "answer_id string, id string, ord int, citation_markers array<string>, raw_url string, normalized_url string, title string, "
    "status string, http_status int, fetched_at timestamp, error_message string, tool_name string"
)
DOCUMENTS = "reference_id string, markdown string, content_hash string, fetch_method string, word_count int"
REFERENCE_STATUS = "id string, turn bigint, status string, http_status int, fetched_at timestamp, error_message string"
CLAIMS = "id string, answer_id string, position int, text string, cited_reference_ids array<string>"
PASSAGES = (
    "id string, reference_id string, section string, text string, token_count int, embedding_id bigint, embedding array<float>"
)
CURATED = (
    "answer_chunk_id string, passages array<struct<reference_chunk_id: string, reference_id: string, score: double, text: string>>, "
    "assembled_context string, skip_reason string"
)
RESULTS = (
    "answer_chunk_id string, seq bigint, verdict string, justification string, cited_excerpts array<string>, prompt_tokens int, "
    "completion_tokens int, cost_usd double, latency_ms int, judge_model string"
)
SKIPPED = "answer_chunk_id string, reason string"
JUDGE_ERRORS = "answer_chunk_id string, raw string, error string"
FETCH_ATTEMPTS = (
    "reference_id string, url string, strategy string, attempt int, http_status int, error_kind string, content binary, content_type string"
)
RUNS = "run_id string, answer_path string, tool_name string, full_corpus_mode boolean, started_at timestamp"
RUN_STAGES = "run_id string, stage string, completed_at timestamp, seconds double"
VERDICT_JSON = "verdict string, justification string, cited_excerpts array<string>"
EXTRACTED_JSON = "references array<struct<citation_markers: array<string>, url: string, title: string>>"
