"""Embedding functions as a hook: from texts to vectors, batch by batch on the executors.

An embedder is a picklable function from a list of texts to as many lists of floats.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], list[list[float]]]


class HashEmbedder:
    """Deterministic vectors without a model: equal texts have equal ones.

    Digests of the text and a counter, eight bytes a component, taken as a number from
    -1 to 1; the vector is made a unit vector.
    """

    def __init__(self, dim: int = 32):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        blocks = -(-self.dim // 8)
        raw = b"".join(hashlib.blake2b(f"{i}\0{t}".encode(), digest_size=64).digest() for t in texts for i in range(blocks))
        x = np.frombuffer(raw, dtype="<u8").reshape(len(texts), -1)[:, : self.dim] / 2.0**63 - 1.0
        return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).tolist() if len(texts) else []


class HttpEmbedder:
    """An embedding service over HTTP. ``kind`` is ``openai`` (POST {model, input}, items
    with index and embedding) or ``ollama`` (POST {model, input}, embeddings)."""

    def __init__(self, url: str, model: str, kind: str = "openai", key: str = "", timeout: float = 60.0):
        if kind not in ("openai", "ollama"):
            raise ValueError(f"unknown kind {kind!r}")
        self.url, self.model, self.kind, self.key, self.timeout = url, model, kind, key, timeout

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": list(texts)}).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            got = json.load(reply)
        if self.kind == "ollama":
            return got["embeddings"]
        return [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]


def embedded(rows: DataFrame, embed: Embedder, key: str = "id", text: str = "text", at_once: int = 128) -> DataFrame:
    """key, x: the vector of each row's text; a null text counts as empty.

    The embedder gets ``at_once`` texts a call; another number of vectors, or vectors of
    different lengths, fail the job.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                some = b.slice(at, at_once)
                texts = [t or "" for t in some.column(1).to_pylist()]
                got = embed(texts)
                if len(got) != len(texts) or len({len(v) for v in got}) > 1:
                    raise ValueError(f"the embedder gave {len(got)} vectors for {len(texts)} texts, or unequal ones")
                yield pa.record_batch([some.column(0), pa.array(got, pa.list_(pa.float64()))], names=[key, "x"])

    return rows.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, x array<double>")


def probe(embed: Embedder, text: str = "health probe") -> dict:
    """Whether the embedder answers, and with how many components."""
    try:
        return {"ok": True, "dim": len(embed([text])[0])}
    except Exception as e:  # noqa: BLE001 - any failure of the backend is the answer
        return {"ok": False, "error": f"{type(e).__name__}: {e}"}
