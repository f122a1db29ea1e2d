"""Chinese words by a dictionary: the cut of a run of Han characters into the most probable words, in Arrow batches.

A word of the dictionary costs the negative logarithm of its share, an unknown single character more than any of these;
the cheapest cut wins (of equally cheap ones the one with the longer last word). Runs of other characters between
spaces and marks are words as they are. The dictionary is a bounded lexicon and travels with the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RUNS = re.compile(r"[一-鿿]+|[^\W一-鿿]+")


class Dictionary:
    def __init__(self, words: Mapping[str, int] | Iterable[str]):
        """words: with counts, or without (then each counts once)."""
        counts = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, 1)
        counts = {w: n for w, n in counts.items() if w and n > 0}
        total = sum(counts.values())
        self.cost = {w: math.log(total) - math.log(n) for w, n in counts.items()}
        self.unknown = max(self.cost.values(), default=0.0) + math.log(total + 2)
        self.longest = max(map(len, counts), default=1)

    def cut(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(run[start:end])
                if cost is None and end - start == 1:
                    cost = self.unknown
                if cost is not None:
                    options.append((best[start] + cost, start))
            least = min(options)
            best.append(least[0])
            back.append(least[1])
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    def words(self, text: str | None) -> list[str]:
        return [w for run in _RUNS.findall((text or "").lower()) for w in (self.cut(run) if "一" <= run[0] <= "鿿" else [run])]


def segmented(text: Column, words: Mapping[str, int] | Iterable[str]) -> Column:
    """The words of each text, in order; null has none."""
    dictionary = Dictionary(words)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(dictionary.words)

    return cut(F.coalesce(text, F.lit("")))
