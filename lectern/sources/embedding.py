"""A client of an HTTP embedding service, for ``vectors.embedded``: it travels to the tasks that embed."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class EmbeddingService:
    """``POST {host}/api/embed`` with the model and a batch of texts; as many vectors must come back.

    Failed connections, answers of 500 or more, and 429 are tried again up to ``retries`` times, after 0.2, 0.4, 0.8 ...
    seconds; any other answer that isn't a success raises at once.
    """

    host: str
    model: str
    keep_alive: str = "15m"
    timeout: float = 180.0
    retries: int = 3
    pause: float = 0.2

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        answer = self._asked("/api/embed", {"model": self.model, "input": list(texts), "keep_alive": self.keep_alive}, self.timeout, self.retries)
        found = answer.get("embeddings") or []
        if len(found) != len(texts):
            raise ValueError(f"the embedding service gave {len(found)} vectors for {len(texts)} texts")
        return [np.asarray(v, np.float32) for v in found]

    def check(self) -> str | None:
        """What is wrong with the service, or None: it must answer, and know the model (by name or as ``name:tag``)."""
        try:
            models = self._asked("/api/tags", None, 2.0, 0).get("models") or []
        except urllib.error.HTTPError as error:
            return f"the embedding service at {self.host} answers {error.code}"
        except OSError as error:
            return f"the embedding service at {self.host} can't be reached: {error}"
        names = [m.get("name") or m.get("model") or "" for m in models]
        known = any(n == self.model or n.startswith(f"{self.model}:") for n in names)
        return None if known else f"the embedding service at {self.host} doesn't hold the model {self.model}"

    def _asked(self, path: str, body: dict | None, timeout: float, retries: int) -> dict:
        data = None if body is None else json.dumps(body).encode()
        for attempt in range(retries + 1):
            try:
                request = urllib.request.Request(self.host.rstrip("/") + path, data, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as error:
                if attempt == retries or error.code < 500 and error.code != 429:
                    raise
            except OSError:
                if attempt == retries:
                    raise
            time.sleep(self.pause * 2**attempt)
        raise AssertionError("not reached")
