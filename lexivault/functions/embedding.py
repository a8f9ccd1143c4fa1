"""Embedding backends. A backend has a name, a dimension and a device, and turns texts into float vectors."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IndexError_
from .text import CHAR_CAP, query_tokens


class Backend(ABC):
    name: str
    dim: int
    device: str = "cpu"

    @abstractmethod
    def encode(self, texts: list[str]) -> np.ndarray:
        """One row of ``dim`` 32-bit floats for each text; (0, dim) for none."""

    def column(self, text: Column, batch_size: int = 16) -> Column:
        """The vectors of a text column: Arrow batches in, ``batch_size`` texts to a call, whatever file they are of."""
        dim, encode = self.dim, self.encode

        @F.pandas_udf("array<float>")
        def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                rows = [t or "" for t in texts]
                out = [encode(rows[k : k + batch_size]) for k in range(0, len(rows), batch_size)]
                found = np.concatenate(out) if out else np.zeros((0, dim), dtype=np.float32)
                if found.shape != (len(rows), dim):
                    raise ValueError(f"backend.encode_failed: {found.shape} for {len(rows)} texts of {dim} dimensions")
                yield pd.Series(list(found.astype(np.float32)))

        return vectors(F.substring(text, 1, CHAR_CAP))

    def query(self, text: str) -> list[float]:
        try:
            return [float(x) for x in self.encode([text])[0]]
        except Exception as e:
            raise IndexError_("backend.encode_failed", f"{self.name} can't encode the query: {e}") from e


class HashBackend(Backend):
    """Signed feature hashing of tokens into ``dim`` buckets, at unit length: the same vectors everywhere, no model."""

    def __init__(self, dim: int = 64, device: str = "cpu"):
        self.dim, self.name, self.device = dim, f"hash:{dim}", device

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for token in query_tokens(text):
                h = zlib.crc32(token.encode())
                row[(h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return out


class MappedBackend(Backend):
    """Vectors by text; zeros for texts that aren't mapped. For tests and vectors computed elsewhere."""

    def __init__(self, vectors: dict[str, list[float]], dim: int, name: str = "mapped"):
        self.vectors, self.dim, self.name = vectors, dim, name

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vectors.get(t, [0.0] * self.dim) for t in texts], dtype=np.float32).reshape(len(texts), self.dim)


BACKENDS: dict[str, Callable[[str, str], Backend]] = {}


def register(name: str, make: Callable[[str, str], Backend]) -> None:
    """Makes ``name`` known; ``make`` gets the model's name and the device."""
    BACKENDS[name] = make


register("hash", lambda model, device: HashBackend(int(model.partition(":")[2] or 64), device))


def resolve_device(wanted: str | None) -> str:
    """``cpu`` or ``cuda``; ``auto`` is ``cuda`` where ONNX Runtime has it."""
    wanted = (wanted or "auto").lower()
    if wanted not in ("auto", "cpu", "cuda"):
        raise IndexError_("config.bad_enum", f"no such device: {wanted}", allowed=["auto", "cpu", "cuda"])
    if wanted == "cpu":
        return "cpu"
    try:
        import onnxruntime

        has = "CUDAExecutionProvider" in onnxruntime.get_available_providers()
    except ImportError:
        has = False
    if wanted == "cuda" and not has:
        raise IndexError_("backend.model_download_failed", "the device cuda isn't available here")
    return "cuda" if has else "cpu"


def from_config(backend: str, model: str, device: str | None = None) -> Backend:
    if backend not in BACKENDS:
        raise IndexError_("config.bad_enum", f"no such embedding backend: {backend}", allowed=sorted(BACKENDS))
    return BACKENDS[backend](model, resolve_device(device))
