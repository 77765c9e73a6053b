"""Deterministic stand-ins for models, for tests and dry runs; they are no models and say so in their names."""

from __future__ import annotations

import hashlib
import json
import re

from ..operators.extraction import MARKER


def standin_embedder(dimensions: int = 16):
    """Text to a unit vector of its words' hashes: texts that share words are similar."""

    def embed(text: str) -> dict:
        out = [0.0] * dimensions
        for word in re.findall(r"\w+", text.lower()):
            digest = hashlib.md5(word.encode()).digest()
            out[digest[0] % dimensions] += 1 if digest[1] % 2 else -1
        size = sum(x * x for x in out) ** 0.5
        return {"vector": [x / size for x in out]} if size else {"vector": [1.0] + [0.0] * (dimensions - 1)}

    return embed


def standin_extractor():
    """A prompt's capitalised words as nodes, and edges between neighbours."""

    def extract(prompt: str) -> dict:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{2,}\b", prompt.rpartition("### Chunk")[2])))[:20]
        nodes = [{"display_name": n, "description": f"{n} is named."} for n in names]
        edges = [{"source_display_name": a, "target_display_name": b, "description": "stand together", "strength": 5} for a, b in zip(names, names[1:])]
        return {"text": json.dumps({"nodes": nodes, "edges": edges}) + "\n" + MARKER}

    return extract
