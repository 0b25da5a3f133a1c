"""Settings: defaults, then a file `.env`, then the environment (CUEWRIGHT_NAME in both), then what the caller gives; None means not given."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace
from typing import get_type_hints

from pyspark.sql import DataFrame

from ..errors import SettingsProblem
from ..operators.embed import embed, model_id
from ..operators.passages import Packing


_LINE = re.compile(r"""(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*(?:'([^']*)'|"([^"]*)"|([^\n]*?))[ \t]*(?:[ \t]#[^\n]*)?$""")


def read_dotenv(path: str | None) -> dict[str, str]:
    """Names and values of a file of NAME=value lines on the caller's machine: quoted or not, with comments; the last of a name counts."""
    if not path or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as held:
        return {m[1]: next(x for x in m.groups()[1:] if x is not None) for m in _LINE.finditer(held.read())}


@dataclass(frozen=True)
class Settings:
    folder: str = "cuewright-data"
    languages: tuple[str, ...] = ("en", "en-US", "en-GB")
    prefer_manual: bool = True
    max_chars: int = 700
    overlap_chars: int = 120
    min_chars: int = 200
    embedder: str = "hashing"
    dim: int = 384
    #: For the embedder `model`: the model's name, and the function package.module:name that makes it in each task.
    embedding_model: str = ""
    embedding_loader: str = ""
    retriever: str = "hybrid"
    top_k: int = 5
    candidate_k: int = 30
    fusion: str = "rrf"
    rrf_k: int = 60
    alpha: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rerank: bool = False
    rerank_candidates: int = 30
    min_score: float = 0.28
    require_citations: bool = True
    max_context_chars: int = 8000
    rewrite: bool = True
    history_turns: int = 4

    @classmethod
    def load(cls, env: dict[str, str] | None = None, dotenv: str | None = ".env", **given: object) -> Settings:
        """Fails for a name that is no setting and for a text that is no value of its type; a file that is not there says nothing."""
        env, hints = {**read_dotenv(dotenv), **(os.environ if env is None else env)}, get_type_hints(cls)
        read = {bool: lambda t: {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}[t.lower()], int: int, float: float, str: str}
        out = cls()
        for f in fields(cls):
            text = env.get(f"CUEWRIGHT_{f.name.upper()}")
            if text is not None:
                kind = hints[f.name]
                try:
                    out = replace(out, **{f.name: read[kind](text) if kind in read else tuple(x.strip() for x in text.split(","))})
                except (ValueError, KeyError):
                    raise SettingsProblem(f"CUEWRIGHT_{f.name.upper()}: {text!r} is no {kind.__name__}") from None
        return replace(out, **{k: v for k, v in given.items() if v is not None})

    def embed(self, texts: DataFrame, query: bool = False) -> DataFrame:
        return embed(texts, self.embedder, self.dim, self.embedding_model, self.embedding_loader, query)

    @property
    def model_id(self) -> str:
        return model_id(self.embedder, self.dim, self.embedding_model)

    @property
    def packing(self) -> Packing:
        return Packing(self.max_chars, self.overlap_chars, self.min_chars)
