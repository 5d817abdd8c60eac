"""Toxicity by a weighted lexicon and Aho-Corasick matching.

Texts are folded first: case, look-alike letters, zero-width characters,
stretched letters, and digits or signs that stand for letters.  Words with
accents are matched with and without them.  A
lexicon of weighted word beginnings is matched in one pass by Aho-Corasick;
matches inside exception phrases don't count; the summed weight is normalised
by the text's length and calibrated to a probability.

The lexicon is learned from labelled rows: word beginnings whose distinct
contexts lean to toxic texts beyond chance (a binomial bound over all
candidates).  Contexts, not occurrences, are counted, so copies of one text
weigh once.  Fitting uses at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled
rows, picked by a hash of their ids; scoring covers every row and is one
narrow pass.  Held-out rows (crc32 of the id, mod 4, is 2) are never learned
from, and ids, labels, sources and languages are no inputs of a score.

Null and empty texts score as texts without matches do.  Without labelled toxic rows the
lexicon is empty and all scores are 0.  Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import map_columns, shared_table, slices

#: Bounds of the sample that the lexicon is fitted on; lengths of word beginnings; chance of any false entry.
MOST_TOXIC, MOST_CLEAN, SHORTEST, LONGEST, CHANCE = 3000, 6000, 3, 12, 0.01
#: A text counts as toxic from this score on.
THRESHOLD = 0.3

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "l", "ɩ": "i", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: What stands for a letter before another letter.  l, 1 and i fold together.
STAND_INS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
#: Phrases in which a listed word is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clownfish", "circus clown", "birthday clown", "pond scum", "soap scum", "dostoevsky idiot", "worthless check", "sore loser clause")

_stand_in = re.compile("[" + re.escape("".join(STAND_INS)) + r"]{1,8}(?=[a-z])")
#: What stands for letters at a word's end, where it may as well be a number or a sign: both readings are matched.
_tail = re.compile(r"(?<=[a-z])[0-9@$€]{1,8}(?![^\W_])")
_BAR = "\u02ac"
_stretched = re.compile(r"([a-z])\1{2,}")
_other = re.compile(r"[\W\d_]+")
_accented = re.compile(r"[a-z]*[^ a-z][^ ]*")


class _Fold(dict):
    """Code point -> folded letters, found as they come."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if unicodedata.category(c) == "Cf":
            out = ""
        else:
            out = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c.lower())).replace("l", "i").replace("_", " ").replace(_BAR, "")
        self[point] = out
        return out


_fold = _Fold()
_plain: dict[str, str] = {}


def _both(m: re.Match) -> str:
    """A word with accents, a bar, and the word without them."""
    word = m[0]
    if (got := _plain.get(word)) is None:
        bare = "".join(x for x in unicodedata.normalize("NFKD", word) if not unicodedata.combining(x))
        got = f"{word}_{bare}" if bare != word else word
        if len(_plain) >= 200_000:
            _plain.clear()
        _plain[word] = got
    return got


def _with_tails(t: str) -> str:
    """Words that end in stand-ins, with a bar and the word that these spell behind them."""
    out, at = [], 0
    for m in _tail.finditer(t):
        begin = m.start()
        while begin > at and "a" <= t[begin - 1] <= "z":
            begin -= 1
        out += [t[at : m.start()], _BAR, t[begin : m.start()], "".join(STAND_INS[c] for c in m[0])]
        at = m.end()
    return "".join([*out, t[at:]]) if out else t


def folded(text: str | None) -> str:
    """Folded words, each between blanks; other readings of a word (without accents, with its last digits as letters) follow behind bars."""
    t = text or ""
    t = (t if t.isascii() else unicodedata.normalize("NFC", t)).translate(_fold)
    t = _stand_in.sub(lambda m: "".join(STAND_INS[c] for c in m[0]), t)
    t = _with_tails(t)
    t = _other.sub(" ", _stretched.sub(r"\1", t)).strip()
    return f" {t if t.isascii() else _accented.sub(_both, t).replace(_BAR, '_')} "


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases (all folded), and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 0.5
    slope: float = 1.0
    shift: float = 0.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(" " + w, (len(w) + 1, x))
            a.add_word("_" + w, (len(w) + 1, x))
        for p in self.exceptions:
            a.add_word(f" {p}", (len(p) + 1, None))
        if len(a):
            a.make_automaton()
        return a if len(a) else None


def matches(text: str, automaton) -> list[tuple[int, float]]:
    """(start, weight) of the heaviest match of each word of a folded text, outside exceptions."""
    if automaton is None:
        return []
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight is not None:
            if text[start] == "_":
                start = text.rfind(" ", 0, start)
            found[start] = max(weight, found.get(start, 0.0))
        elif text[end + 1 : end + 2] in (" ", ""):
            excused.append((start, end))
    return [(s, w) for s, w in found.items() if not any(a <= s <= b for a, b in excused)]


def normalised(total: float, words: int, power: float) -> float:
    """Summed weight for a text of 100 words; ``power`` says how much length counts."""
    return total / (max(words, 20) / 100) ** power


def probability(x: float, lexicon: Lexicon) -> float:
    return 1 / (1 + math.exp(-min(40.0, max(-40.0, lexicon.slope * (x - lexicon.shift))))) if x > 0 else 0.0


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most MOST_TOXIC + MOST_CLEAN learnable rows, written once to the shared folder.

    Of rows that share an id, the one with the least text counts, so that the
    sample is bounded in rows whatever repeats.
    """
    # two columns that can't clash with others; the picked ids are bounded, so they may be broadcast
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL").where(~held_out(F.col("id")))
    own = own.withColumn("h", F.xxhash64("id"))
    picked = [own.where(F.col("toxic") == v).orderBy("h", "id").limit(n) for v, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    both = picked[0].union(picked[1]).groupBy("id").agg(F.max("toxic").alias("toxic"))
    src = docs.select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL")
    once = src.join(F.broadcast(both), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    return shared_table(once.select("text", "toxic"), "labelled")


def _beginnings(sample: DataFrame) -> DataFrame:
    """begin, toxic and clean contexts of every word beginning of the sample."""

    def run(cols: dict) -> dict:
        words, contexts, toxic = [], [], []
        for text, label in zip(cols["text"], cols["toxic"], strict=True):
            own = folded(text).split()
            seen = {(w, a, b) for both, a, b in zip(own, [""] + own[:-1], own[1:] + [""], strict=True) for w in both.split("_") if len(w) >= SHORTEST}
            words += [w for w, _, _ in seen]
            contexts += [f"{a} {b}" for _, a, b in seen]
            toxic += [label] * (len(words) - len(toxic))
        return {"word": words, "context": contexts, "toxic": toxic}

    rows = map_columns(sample, "word string, context string, toxic int", run, 1 << 19)  # a slice becomes many small strings
    once = rows.groupBy("word", F.xxhash64("context").alias("c")).agg(F.max("toxic").alias("toxic"))
    by_word = once.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring("word", F.lit(1), n))
    return by_word.select(F.explode(starts).alias("begin"), "pos", "neg").groupBy("begin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _chosen(rows: list, share: float, total_pos: int, total_neg: int) -> dict[str, float]:
    """The strongest beginnings, none of which begins another; of equally strong ones the longest."""
    counts = {begin: (pos, neg) for begin, pos, neg in rows}

    def strength(begin: str) -> float:
        pos, neg = counts[begin]
        p = pos / (pos + neg)
        return pos * math.log(p / share) + (neg * math.log((1 - p) / (1 - share)) if neg else 0.0)

    kept: dict[str, float] = {}
    blocked: set[str] = set()
    for begin in sorted(counts, key=lambda x: (-round(strength(x), 6), -len(x), x)):
        if begin in blocked or any(begin[:n] in kept for n in range(SHORTEST, len(begin))):
            continue
        # as specific as it can be without losing a tenth of its contexts
        longer = [x for x in counts if x.startswith(begin) and counts[x][0] >= 0.9 * counts[begin][0]]
        begin = max(longer, key=lambda x: (len(x), x))
        pos, neg = counts[begin]
        kept[begin] = round(min(8.0, math.log((pos + 0.5) / (total_pos + 1)) - math.log((neg + 0.5) / (total_neg + 1))), 6)
        blocked |= {begin[:n] for n in range(SHORTEST, len(begin))} | {x for x in counts if x.startswith(begin)}
    return kept


def fit_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn weights, exceptions and calibration from the bounded sample."""
    sample = labelled_sample(docs, labels)
    begins = _beginnings(sample).cache()
    n, pos, neg = begins.agg(F.count("*"), F.sum(F.when(F.length("begin") == SHORTEST, F.col("pos"))), F.sum(F.when(F.length("begin") == SHORTEST, F.col("neg")))).first()
    if not pos:
        begins.unpersist()
        return Lexicon()
    share = max(min(pos / (pos + (neg or 0)), 0.999), 1e-6)
    p = F.col("pos") / (F.col("pos") + F.col("neg"))
    strength = F.col("pos") * F.log(p / share) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    least = math.log(max(n, 1) / CHANCE)
    rows = begins.where((F.col("pos") > 0) & (p >= max(0.8, (1 + share) / 2)) & (strength >= least)).collect()
    begins.unpersist()
    lexicon = Lexicon(_chosen([tuple(r) for r in rows], share, pos, neg or 0), tuple(sorted({folded(x).strip() for x in EXCEPTIONS})))
    return _calibrated(sample, lexicon)


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Exceptions that the sample's clean texts show, then length power, slope and shift."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(cols: dict) -> dict:
        a = shared.value.automaton()
        out = {"toxic": cols["toxic"], "words": [], "total": [], "phrases": []}
        for text in cols["text"]:
            t = folded(text)
            hits = matches(t, a)
            phrases = set()
            for s, _ in hits:
                end = t.index(" ", s + 1)
                before, after = t.rfind(" ", 0, s), t.find(" ", end + 1)
                phrases |= ({t[before + 1 : end]} if before >= 0 else set()) | ({t[s + 1 : after]} if after > 0 else set())
            out["words"].append(t.count(" ") - 1)
            out["total"].append(sum(w for _, w in hits))
            out["phrases"].append(sorted(phrases))
        return out

    rows = map_columns(sample, "toxic int, words bigint, total double, phrases array<string>", run).toPandas()
    bad, good = Counter(), Counter()
    for toxic, phrases in zip(rows["toxic"], rows["phrases"], strict=True):
        (bad if toxic else good).update(phrases)
    learned = {p for p, n in good.items() if n >= 5 and not bad[p]}
    y = rows["toxic"].to_numpy(float)
    best = None
    for power in (0.25, 0.5, 0.75, 1.0):
        x = np.array([normalised(t, w, power) for t, w in zip(rows["total"], rows["words"], strict=True)])
        loss, slope, shift = _platt(x, y)
        if best is None or loss < best[0] - 1e-6:
            best = (loss, power, slope, shift)
    return Lexicon(lexicon.weights, tuple(sorted({*lexicon.exceptions, *learned})), *best[1:])


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Loss, slope and shift of a ridge logistic fit of y on x, by Newton steps; texts without matches aren't fitted."""
    keep = x > 0
    x, y = np.append(x[keep], 0.0), np.append(y[keep], 0.0)
    scale = max(float(np.median(x)), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.array([4.0, -1.0])
    ridge = np.diag([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ (w - [4.0, -1.0]))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -40, 40))), 1e-12, 1 - 1e-12)
    slope = max(w[0] / scale, 1e-6)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))), slope, float(-w[1] / slope)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, hits (counted matches) and words of every text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        a = x.automaton()
        for batch in batches:
            for piece in slices(batch):
                scores, hits, words = [], [], []
                for text in piece.column(1).to_pylist():
                    t = folded(text)
                    found = matches(t, a)
                    n = max(0, t.count(" ") - 1)
                    scores.append(probability(normalised(sum(w for _, w in found), n, x.power), x))
                    hits.append(len(found))
                    words.append(n)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), pa.array(words, pa.int64())], ["id", "score", "hits", "words"])

    return src.mapInArrow(run, f"id {kind}, score double, hits bigint, words bigint").withColumnRenamed("id", id_col)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, with the number of counted matches."""
    scored = score_toxicity(docs, fit_lexicon(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, whose text isn't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    held: list = []

    @F.pandas_udf("boolean")
    def toxic(texts):
        if not held:
            held.append(shared.value.automaton())
        x = shared.value

        def one(text):
            t = folded(text)
            return probability(normalised(sum(w for _, w in matches(t, held[0])), max(0, t.count(" ") - 1), x.power), x) >= THRESHOLD

        return texts.map(one)

    return docs.where(~toxic("text"))
