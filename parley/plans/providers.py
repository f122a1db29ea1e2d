"""Models behind an interface, the rules by which they are asked again, and offline stand-ins that need no network."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.settings import DEFAULTS, Settings

Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """Deterministic vectors of unit length: signed hashes of the words and of pairs of characters."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts, strict=True):
        for term in [*text.lower().split(), *(text[i : i + 2] for i in range(len(text) - 1))]:
            h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
            row[h % width] += 1.0 if h >> 63 else -1.0
        row /= max(float(np.linalg.norm(row)), 1e-12)
    return out


def checked_vectors(vectors: np.ndarray, texts: list[str], width: int | None = None) -> np.ndarray:
    """As many vectors as texts, all of one width (``width``, if given) and finite; else an error."""
    out = np.asarray(vectors, np.float32)
    if out.ndim != 2 or len(out) != len(texts) or (width is not None and out.shape[1] != width) or not np.isfinite(out).all():
        raise ValueError(f"{len(texts)} texts were embedded as an array of shape {out.shape}")
    return out


def embedded(units: DataFrame, embed: Embed = hashing_embedder, cache: DataFrame | None = None, batch: int = 64, s: Settings = DEFAULTS) -> DataFrame:
    """Adds vector to units (text, text_hash). Equal texts are embedded once; those in ``cache`` (text_hash, vector) not at all."""
    unique = units.select("text_hash", F.substring("text", 1, s.embed_chars).alias("text")).dropDuplicates(["text_hash"])
    todo = unique if cache is None else unique.join(cache.select("text_hash"), "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield pd.DataFrame({"text_hash": part["text_hash"].to_numpy(), "vector": list(checked_vectors(embed(part["text"].tolist()), part["text"].tolist()))})

    found = todo.mapInPandas(run, T.StructType([T.StructField("text_hash", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))]))
    if cache is not None:
        found = found.unionByName(cache.join(unique.select("text_hash"), "text_hash", "left_semi").select("text_hash", "vector"))
    return units.join(found, "text_hash")


class SlidingWindow:
    """A limiter for providers: calls in one trailing window, tokens in another. One for each worker process."""

    def __init__(self, calls: int, call_seconds: float, tokens: int, token_seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most_calls, self.call_seconds, self.most_tokens, self.token_seconds = calls, call_seconds, tokens, token_seconds
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.log: deque[list[float]] = deque()
        self.paused = 0.0

    def __getstate__(self) -> dict:
        """Travels to the workers without its lock."""
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"lock": threading.Lock()}

    def wait(self, tokens: int) -> float:
        """Seconds until a call with so many tokens fits; 0 registers it. More than the window holds is refused."""
        if tokens > self.most_tokens:
            raise ValueError("a call over the token window can never run")
        with self.lock:
            now = self.clock()
            while self.log and self.log[0][0] <= now - max(self.call_seconds, self.token_seconds):
                self.log.popleft()
            waits = [self.paused - now]
            recent = [t for t, _ in self.log if t > now - self.call_seconds]
            if len(recent) >= self.most_calls:
                waits.append(recent[len(recent) - self.most_calls] + self.call_seconds - now)
            held = [(t, n) for t, n in self.log if t > now - self.token_seconds]
            over = sum(n for _, n in held) + tokens - self.most_tokens
            for t, n in held:
                if over <= 0:
                    break
                waits.append(t + self.token_seconds - now)
                over -= n
            if (longest := max(waits)) > 0:
                return longest
            self.log.append([now, tokens])
            return 0.0

    def acquire(self, tokens: int) -> None:
        while (left := self.wait(tokens)) > 0:
            self.sleep(left)

    def reconcile(self, estimated: int, used: int) -> None:
        """Puts what a call really used in place of its estimate."""
        with self.lock:
            for entry in reversed(self.log):
                if entry[1] == estimated:
                    entry[1] = used
                    return

    def cool_down(self, seconds: float) -> None:
        with self.lock:
            self.paused = max(self.paused, self.clock() + seconds)


class Busy(Exception):
    """The model refuses for now; ``seconds`` until it may be asked again."""

    def __init__(self, seconds: float):
        super().__init__(f"busy for {seconds} s")
        self.seconds = seconds


class Unavailable(Exception):
    """A fault that may pass: a time-out, a broken connection, an error on the model's side."""


class Denied(Exception):
    """A fault that stays: credentials, balance. Nothing more is asked."""


class Asked:
    """A provider (a list of prompts to a list of texts) made of one call, with the rules of asking again.

    call(prompt, room) gives (text, tokens used, whether it was cut off at ``room`` output tokens). Busy waits and lets
    all others wait; a cut-off answer is asked for again with twice the room, one that ``valid`` rejects with the reason
    in the prompt; Unavailable is tried again after a pause that doubles. What then has no answer is None. After Denied
    all further prompts have none. ``log`` has one record for each prompt.
    """

    def __init__(self, call: Callable[[str, int], tuple[str, int, bool]], limiter: SlidingWindow, valid: Callable[[str], str | None] = lambda text: None, attempts: int = 3, room: int = 1024, most_room: int = 8192, pause: float = 2.0):
        self.call, self.limiter, self.valid, self.attempts, self.room, self.most_room, self.pause = call, limiter, valid, attempts, room, most_room, pause
        self.denied: str | None = None
        self.log: list[dict] = []

    def _one(self, prompt: str) -> str | None:
        room, reason, record = self.room, None, {"prompt_chars": len(prompt), "status": "failed", "attempts": 0, "tokens": 0, "error": self.denied}
        self.log.append(record)
        for attempt in range(self.attempts):
            if self.denied:
                record["error"] = self.denied
                return None
            record["attempts"] += 1
            full = prompt if reason is None else f"{prompt}\n\nThe last answer was wrong: {reason}"
            estimate = -(-len(full) // 2)
            self.limiter.acquire(estimate)
            try:
                text, used, cut = self.call(full, room)
            except Busy as e:
                self.limiter.cool_down(e.seconds)
                record |= {"status": "busy", "error": str(e)}
                continue
            except Denied as e:
                self.denied = str(e)
                record |= {"status": "denied", "error": self.denied}
                return None
            except Unavailable as e:
                record |= {"status": "failed", "error": str(e)}
                self.limiter.sleep(self.pause * 2**attempt)
                continue
            self.limiter.reconcile(estimate, used)
            record["tokens"] += used
            if cut:
                room = min(2 * room, self.most_room)
                record |= {"status": "cut", "error": "cut off"}
            elif reason := self.valid(text):
                record |= {"status": "invalid", "error": reason}
            else:
                record |= {"status": "ok", "error": None}
                return text
        return None

    def __call__(self, prompts: list[str]) -> list[str | None]:
        return [self._one(p) for p in prompts]


class Embedding:
    """An embedder made of one call (texts to vectors), with the rules of asking again; for embedded().

    Busy and Unavailable are tried again, so often in all, after the pause that Busy names or one that doubles; Denied and
    every other error end the run. As many vectors must come as texts went, all finite and ``width`` wide.
    """

    def __init__(self, call: Callable[[list[str]], np.ndarray], width: int, attempts: int = 4, pause: float = 1.0, limiter: SlidingWindow | None = None, sleep: Callable[[float], None] = time.sleep):
        self.call, self.width, self.attempts, self.pause, self.limiter, self.sleep = call, width, attempts, pause, limiter, sleep

    def __call__(self, texts: list[str]) -> np.ndarray:
        for attempt in range(self.attempts):
            try:
                if self.limiter:
                    self.limiter.acquire(1)
                return checked_vectors(self.call(texts), texts, self.width)
            except (Busy, Unavailable) as e:
                if attempt == self.attempts - 1:
                    raise
                self.sleep(e.seconds if isinstance(e, Busy) else self.pause * 2**attempt)
        raise ValueError("no attempt was allowed")


def cacheable(text: Column, s: Settings = DEFAULTS) -> Column:
    """Short texts come again on other days; only these are worth keeping beyond their own."""
    return F.length(text) <= s.cacheable_chars
