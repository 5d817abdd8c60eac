import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"


def counted(rows, least=5):
    """The contract's words by plain reading."""
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    """All near words by their texts less one letter, which is another way than sums of letters; forms and roots."""
    places = defaultdict(set)
    for w in words:
        for text in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            places[text].add(w)
    near = defaultdict(set)
    for group in places.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda o: (-words[o], o))
            if words[best] >= 5 * n:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_reading(spark, sf):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    df = queries.op11_spelling(spark, f"/root/testdata/{sf}")
    got = rows_of(df)
    assert got == grouped(counted(texts)) and df.count() == len(got)
    assert sf == "sf0.001" or any(f for f, *_ in got.values())


def test_near_words_of_invented_words(spark):
    """Anagrams, accents, doubled letters and words of few letters, which meet often and are seldom near."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcé"), rng.integers(6, 9))): int(rng.integers(5, 4000)) for _ in range(600)}
    words |= {"zzzzzz": 5, "zzzzzzz": 25, "zzzzzzzz": 125, "zzzzzzzzz": 625, "zzzzzzzzzz": 3125, "aaaaaa×": 9, "aaaaaa÷": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(spelling.group_variants(df))
    assert got == grouped(words)
    assert got["zzzzzz"][:2] == ("zzzzzzz", "zzzzzzzzzz") and got["zzzzzzzzzz"][0] is None


def test_edges(spark):
    long = "x" * 300_000
    rows = [(1, None), (2, ""), (3, "colour Colour colour"), (3, "colour Colour colour"), (None, "colours " * 4), (None, f"colours {long}"), *[(k, long) for k in range(10, 16)], (9, "ÀÉÎÕÜß " * 6 + "short ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "own", "root", "id")})
    got = rows_of(spelling.spelling_report(docs))
    assert got == grouped(counted(rows)) and long in got
    assert spelling.spelling_report(docs.limit(0)).collect() == []
    free = rows_of(spelling.group_variants(spelling.count_words(docs, letters=2, least=1, noise=None)))
    assert free["short"][2] == 1 and free["ab"][2] == 1


def test_keys_do_not_depend_on_order():
    key, less = spelling.anagram_keys("listen")
    assert (key, sorted(less)) == (spelling.anagram_keys("silent")[0], sorted(spelling.anagram_keys("silent")[1]))
    assert spelling.anagram_keys("liste")[0] in less and len(spelling.anagram_keys("aaaaaa")[1]) == 1
    assert all(-(1 << 63) <= k < 1 << 63 for k in spelling.anagram_keys("ÿ" * 9_000_000)[1])
