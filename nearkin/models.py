"""Registry of embedding models: each has its own tables and vector width."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Model:
    name: str
    dim: int
    namespace: str


# The models of the study and their vector widths.
MODELS = {
    "ecapa": Model("ecapa", 192, "public"),
    "wavlm": Model("wavlm", 768, "wavlm"),
    "wavlm_xvector": Model("wavlm_xvector", 512, "wavlm_xvector"),
}


def get_model(name: str) -> Model:
    if name not in MODELS:
        raise KeyError(f"Unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name]
