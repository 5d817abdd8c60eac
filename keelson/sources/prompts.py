"""Needle prompts as a data source: rows are made where they are read.

``spark.read.format("prompts").option("count", ...)`` cuts the ids of the prompts into ranges, and
every task makes the prompts of its range.  A prompt depends on its id and the
options only, so that any number of partitions, and any retry, gives the same rows.

Options: ``count``, ``kind`` (single, multi, chain or common), ``needles``, ``filler`` (words), ``seed``, ``rows`` (prompts of a partition).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "prompt_id bigint, kind string, context string, question string, answers array<string>"
KINDS = ("single", "multi", "chain", "common")
WORDS = ("grass", "sky", "sun", "river", "hill", "cloud", "stone", "leaf", "path", "wind")
#: Prompts of a partition if no number is given.
ROWS = 10_000


def prompt(k: int, kind: str, needles: int, filler: int, seed: int) -> tuple[int, str, str, str, list[str]]:
    """Prompt number ``k``: needles among filler words, the question about them and its answers."""
    r = random.Random(seed * 1_000_003 + k)
    text = [r.choice(WORDS) for _ in range(filler)]
    if kind in ("single", "multi"):
        pairs = [(f"key{r.randrange(10**6)}", str(r.randrange(10**7))) for _ in range(1 if kind == "single" else needles)]
        for name, value in pairs:
            text.insert(r.randrange(len(text) + 1), f"The magic number of {name} is {value}.")
        question, answers = f"What is the magic number of {pairs[0][0]}?", [pairs[0][1]]
    elif kind == "chain":
        value, names = str(r.randrange(10**5)), [f"V{r.randrange(10**5)}" for _ in range(needles)]
        for a, b in zip(names, [value, *names], strict=False):
            text.insert(r.randrange(len(text) + 1), f"VAR {a} = {b}.")
        question, answers = f"Which variables have the value {value}?", names
    else:
        often = r.sample(WORDS, 3)
        text += often * (filler // 4)
        r.shuffle(text)
        question, answers = "Which words are most common?", often
    return k, kind, " ".join(text), question, answers


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class PromptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default: int(options.get(name, default))
        self.count, self.rows = number("count", 0), max(1, number("rows", ROWS))
        self.needles, self.filler, self.seed = number("needles", 4), number("filler", 200), number("seed", 0)
        self.kind = options.get("kind", "single")
        if self.kind not in KINDS:
            raise ValueError(f"no kind of prompt is called {self.kind}")

    def partitions(self) -> list[Range]:
        return [Range(a, min(a + self.rows, self.count)) for a in range(0, self.count, self.rows)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for k in range(partition.start, partition.stop):
            yield prompt(k, self.kind, self.needles, self.filler, self.seed)


class PromptSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prompts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PromptReader:
        return PromptReader(self.options)
