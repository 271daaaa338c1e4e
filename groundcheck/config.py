"""Settings from the environment and an ``.env`` file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

LOCAL_PORT = 1234


@dataclass(frozen=True)
class Settings:
    anthropic_api_key: str | None = None
    openai_api_key: str | None = None
    llm_model: str = "openai/gpt-oss-20b"
    llm_provider: str = "local"
    llm_base_url: str | None = f"http://localhost:{LOCAL_PORT}/v1/"
    llm_retry_delay: float = 2.0
    llm_max_retries: int = 3
    llm_temperature: float = 0.0
    llm_prices: str | None = None
    judge_batch: int = 10_000
    embedding_model: str = "hash-64"
    reranker_model: str | None = None
    model_cache_dir: str = "./model_cache"
    tokenizer_file: str | None = None
    extraction_strategy: str = "rules"
    fetch_partitions: int = 32
    rerank_top_k: int = 20
    retrieval_top_k: int = 50
    log_format: str = "text"
    log_level: str = "INFO"
    data_dir: str = "./data"

    @property
    def runs_dir(self) -> str:
        return f"{self.data_dir}/runs"

    @classmethod
    def load(cls, env_file: str = ".env") -> Settings:
        """Environment over file over defaults; names are those of the fields, in any case."""
        held: dict[str, str] = {}
        if Path(env_file).exists():
            for line in Path(env_file).read_text().splitlines():
                name, eq, value = line.partition("=")
                if eq and not name.lstrip().startswith("#"):
                    held[name.strip().lower()] = value.strip().strip("\"'")
        held |= {k.lower(): v for k, v in os.environ.items()}
        kinds = {"llm_temperature": float, "llm_max_retries": int, "llm_retry_delay": float, "retrieval_top_k": int, "rerank_top_k": int, "judge_batch": int, "fetch_partitions": int}
        return cls(**{f.name: kinds.get(f.name, str)(held[f.name]) for f in fields(cls) if f.name in held})

    def prices(self) -> dict[str, tuple[float, float]] | None:
        """Dollars a million tokens by model, from JSON; None for the built-in table."""
        return {k: (float(a), float(b)) for k, (a, b) in json.loads(self.llm_prices).items()} if self.llm_prices else None

    def judge_config(self, judge=None) -> dict[str, object]:
        """What a report says of the judge that replied; one that has no endpoint of the settings has no base URL."""
        provider, model = (judge.provider, judge.model) if judge else (self.llm_provider, self.llm_model)
        base = self.llm_base_url if provider == self.llm_provider and provider not in ("anthropic", "containment") else None
        return {"Modelo do juiz LLM": model, "Provider do juiz LLM": provider, "Temperature": self.llm_temperature,
                "Max retries": self.llm_max_retries, "Retry delay": f"{self.llm_retry_delay}s", "Base URL": base}
