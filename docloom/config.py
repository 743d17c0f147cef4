"""Settings with defaults, a TOML file and explicit values, the latter first."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

MODES = ("hybrid", "dense", "bm25")
LEVELS = ("low", "medium", "high")


@dataclass(frozen=True)
class Settings:
    top_k: int = 10
    top_n: int = 60
    bm25_top_n: int = 300
    rrf_k: int = 60
    dense_weight: float = 1.0
    bm25_weight: float = 0.55
    score_threshold: float = 0.0
    retrieval_mode: str = "hybrid"
    knowledge_threshold: str = "low"
    rerank: bool = False
    rerank_fail_open: bool = True
    embed_batch: int = 16
    deploy_batch: int = 256
    doc_version: str | None = None
    base_url: str = "https://docs.example.com"

    def sane(self) -> Settings:
        """Limits and weights as a search uses them."""
        top_n = max(self.top_n, self.top_k, 1)
        return replace(self, top_n=top_n, bm25_top_n=max(self.bm25_top_n, top_n), rrf_k=max(self.rrf_k, 1), dense_weight=weight(self.dense_weight), bm25_weight=weight(self.bm25_weight), doc_version=(self.doc_version or "").strip() or None)


def weight(w: float) -> float:
    """A channel can't be muted by its weight: one that isn't a positive number is 1."""
    return w if w == w and 0 < w < float("inf") else 1.0


def choice(given: str | None, known: tuple[str, ...], default: str) -> str:
    found = (given or "").strip().lower()
    return found if found in known else default


def use_rerank(default: bool, rerank: bool = False, no_rerank: bool = False) -> bool:
    return not no_rerank and (rerank or default)


def user_path(given: str, home: str | None = None) -> str:
    home = home or os.path.expanduser("~")
    given = given.removeprefix("~/") if given.startswith("~/") else "" if given == "~" else given
    return given if os.path.isabs(given) else os.path.normpath(os.path.join(home, given))


def load(path: str | None = None, section: str = "search", fallback: str = "rag", **given: object) -> Settings:
    """given, then the section, then the fallback section, then defaults; None counts as not given."""
    table = tomllib.loads(Path(path).read_text()) if path else {}  # a file that is named must be there
    names = {f.name for f in fields(Settings)}
    values = {k: v for part in (table.get(fallback, {}), table.get(section, {}), given) for k, v in part.items() if k in names and v is not None}
    s = Settings(**values)
    return replace(s, retrieval_mode=choice(s.retrieval_mode, MODES, "hybrid"), knowledge_threshold=choice(s.knowledge_threshold, LEVELS, "low"))
