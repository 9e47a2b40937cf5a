"""Token prices.

Fixed values: dollars per 1,000 tokens as (input, output, cached input), by
model name, in the order in which names are tried for a partial match.
"""

PRICES = {
    "databricks-gpt-5-5-pro": (0.010, 0.030, 0.005),
    "databricks-gpt-5-5": (0.005, 0.020, 0.0025),
    "databricks-gpt-5-4": (0.0025, 0.010, 0.00125),
    "databricks-gpt-5-4-mini": (0.0004, 0.0016, 0.0002),
    "databricks-gpt-5-4-nano": (0.0002, 0.0008, 0.0001),
    "databricks-gpt-5-3-codex": (0.003, 0.012, 0.0015),
    "databricks-gpt-5-2-codex": (0.003, 0.012, 0.0015),
    "databricks-gpt-5-2": (0.0025, 0.010, 0.00125),
    "databricks-gpt-5-1": (0.002, 0.008, 0.001),
    "databricks-gpt-5-1-codex-max": (0.003, 0.012, 0.0015),
    "databricks-gpt-5-1-codex-mini": (0.00075, 0.003, 0.000375),
    "databricks-gpt-5": (0.002, 0.008, 0.001),
    "databricks-gpt-5-mini": (0.0003, 0.0012, 0.00015),
    "databricks-gpt-5-nano": (0.00015, 0.0006, 0.000075),
    "databricks-gpt-oss-120b": (0.001, 0.002, 0.0005),
    "databricks-gpt-oss-20b": (0.0005, 0.001, 0.00025),
    "databricks-claude-opus-4-7": (0.015, 0.075, 0.0075),
    "databricks-claude-opus-4-6": (0.015, 0.075, 0.0075),
    "databricks-claude-opus-4-5": (0.015, 0.075, 0.0075),
    "databricks-claude-opus-4-1": (0.015, 0.075, 0.0075),
    "databricks-claude-sonnet-4-6": (0.003, 0.015, 0.0015),
    "databricks-claude-sonnet-4-5": (0.003, 0.015, 0.0015),
    "databricks-claude-sonnet-4": (0.003, 0.015, 0.0015),
    "databricks-claude-haiku-4-5": (0.0008, 0.004, 0.0004),
    "databricks-gemini-3-1-flash-lite": (0.0001, 0.0004, 0.00005),
    "databricks-gemini-3-flash": (0.0001, 0.0004, 0.00005),
    "databricks-gemini-3-1-pro": (0.00125, 0.005, 0.000625),
    "databricks-gemini-3-pro": (0.00125, 0.005, 0.000625),
    "databricks-gemini-2-5-pro": (0.00125, 0.01, 0.000625),
    "databricks-gemini-2-5-flash": (0.00015, 0.0006, 0.000075),
    "databricks-gemma-3-12b": (0.0001, 0.0003, 0.00005),
    "databricks-llama-4-maverick": (0.0005, 0.0015, 0.00025),
    "databricks-meta-llama-3-3-70b-instruct": (0.00065, 0.00225, 0.000325),
    "databricks-meta-llama-3-1-405b-instruct": (0.005, 0.015, 0.0025),
    "databricks-meta-llama-3-1-70b-instruct": (0.00065, 0.00225, 0.000325),
    "databricks-meta-llama-3-1-8b-instruct": (0.00015, 0.0006, 0.000075),
    "databricks-qwen35-122b-a10b": (0.0003, 0.0012, 0.00015),
    "databricks-qwen3-next-80b-a3b-instruct": (0.0005, 0.0015, 0.00025),
    "databricks-gte-large-en": (0.0001, 0.0, 0.0001),
    "databricks-bge-large-en": (0.0001, 0.0, 0.0001),
    "databricks-qwen3-embedding-0-6b": (0.0001, 0.0, 0.0001),
    "gpt-4o": (0.0025, 0.010, 0.00125),
    "gpt-4o-mini": (0.00015, 0.0006, 0.000075),
    "gpt-4-turbo": (0.010, 0.030, 0.005),
    "gpt-3.5-turbo": (0.0005, 0.0015, 0.00025),
    "claude-sonnet-4-20250514": (0.003, 0.015, 0.0015),
    "claude-3-5-sonnet-20241022": (0.003, 0.015, 0.0015),
    "claude-3-haiku-20240307": (0.00025, 0.00125, 0.000125),
    "claude-opus-4-20250514": (0.015, 0.075, 0.0075),
}
