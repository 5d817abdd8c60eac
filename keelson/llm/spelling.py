"""Spelling variants grouped by anagram hashing.

A word's key is the sum of its letters' fifth powers, so that it doesn't depend on their
order.  Two words differ by one inserted, deleted or replaced letter only if their
keys differ by the value of a letter, or by what one letter's value exceeds another's.
Every word therefore stands under its own key and under its key less each of its letters:
an insertion or deletion meets where one word's key is another's key less a letter,
a replacement where both are less a letter.  Meetings are an equal join of integers;
the order of letters is verified afterwards, by an edit distance of exactly one.

Words are counted inside tasks before they are shuffled, so that a frequent word is
a row a task.  All later work is on distinct words: a key's group holds anagrams of
a few letters, whatever the corpus repeats; oversized groups are left to the
join's skew handling.  A form is always at least RATIO times as frequent, so that
chains of forms have no circles and less than 28 links.

Null and empty texts have no words.  Runs of any length are words, keys are taken
modulo 2**64.  Repeated rows count each time.  A null id is the empty id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import shared_table, slices

#: Letters and occurrences that a word has at least; how many times as frequent a form is; one run in NOISE loses a letter.
LETTERS, LEAST, RATIO, NOISE = 6, 5, 5, 199
#: The exponent of letter values: no two sums of few letters are equal but by chance.
POWER = 5


def runs_of(text: str, letters: int = LETTERS) -> list[str]:
    """Maximal runs of at least ``letters`` letters; only A-Z are lowered."""
    return re.findall(rf"[a-zÀ-ÿ]{{{letters},}}", text.encode().lower().decode())


def count_words(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, noise: int | None = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words with ``least`` occurrences or more.

    With ``noise``, a run whose hash with its document's id that number divides loses the letter that the hash names.
    """
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                total: Counter = Counter()
                for name, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    own = Counter(runs_of(text, letters))
                    if noise:
                        start = crc32(f"{name}:".encode())
                        for word in [w for w in own if crc32(w.encode(), start) % noise == 0]:
                            at = crc32(word.encode(), start) % len(word)
                            n, less = own.pop(word), word[:at] + word[at + 1 :]
                            if len(less) >= letters:
                                total[less] += n
                    total.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def anagram_keys(word: str) -> tuple[int, list[int]]:
    """The sum of a word's letter values, and that sum less each of its different letters."""
    key = sum(ord(c) ** POWER for c in word)
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    return signed(key), [signed(key - ord(c) ** POWER) for c in dict.fromkeys(word)]


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of ``words`` that one inserted, deleted or replaced letter parts, both ways round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                keys, less = zip(*map(anagram_keys, piece.column(0).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(keys, pa.int64()), pa.array(less, pa.list_(pa.int64()))], ["word", "n", "own", "less"])

    keyed = shared_table(words.select("word", "n").mapInArrow(run, "word string, n bigint, own bigint, less array<bigint>"), "anagrams")
    places = keyed.select("word", "n", "own", F.explode("less").alias("key"))
    met = keyed.select("word", "n", "own", F.col("own").alias("key")).unionByName(places)
    met = met.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("own").alias("other_own"))
    # a word's own key is never one of its keys less a letter: where both are less one, each pair is taken once
    once = (F.col("other_own") == F.col("key")) | (F.col("word") < F.col("other"))
    pairs = places.join(met, "key").where(once & (F.col("own") != F.col("other_own")) & (F.levenshtein("word", "other", 1) == 1))
    turned = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # sums of several letters may be equal by chance, so that a pair may meet under two keys
    return pairs.select("word", "n", "other", "other_n").distinct().select(F.inline(turned))


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root of a written table ``forms(word, form)`` without circles: steps are doubled until nothing moves."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = shared_table(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = met.select("word", "root")
        if met.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words(word, n)``, a written table of distinct words.

    The form is the near word of largest n (of equals the first in code-point order) if that n is at least ``ratio`` times the word's.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    has = -F.col("best.minus") >= ratio * F.col("n")
    found = shared_table(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")), "forms")
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    return group_variants(shared_table(count_words(docs), "words"))
