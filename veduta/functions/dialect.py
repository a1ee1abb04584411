"""Expression texts that Spark and DuckDB both read, with the few names that differ put in per engine."""

from __future__ import annotations

import re

_NAMES = {
    "REGEX": ("regexp_like", "regexp_matches"),
    "B64": ("base64", "to_base64"),
    "SHA256": ("_sha_spark", "_sha_duck"),
}


def to(engine: str, text: str) -> str:
    """``text`` for "spark" or "duckdb"."""
    i = 0 if engine == "spark" else 1
    for name, names in _NAMES.items():
        text = re.sub(rf"\b{name}\(", names[i] + "(", text)
    text = re.sub(r"_sha_spark\(((?:[^()]|\([^()]*\))*)\)", r"unhex(sha2(\1, 256))", text)
    text = re.sub(r"_sha_duck\(((?:[^()]|\([^()]*\))*)\)", r"unhex(sha256(\1))", text)
    return text
