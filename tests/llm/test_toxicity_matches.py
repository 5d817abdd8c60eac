"""Matches of the automaton against trying every entry at every place."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import toxicity


def tried(text, lexicon):
    best, excused = {}, set()
    for at in range(len(text)):
        for phrase in lexicon.exceptions:
            if text.startswith(f" {phrase}", at) and text[at + 1 + len(phrase) : at + 2 + len(phrase)] in (" ", ""):
                excused |= set(range(at, at + 1 + len(phrase)))
        for word, weight in lexicon.weights.items():
            if text[at] in " _" and text.startswith(word, at + 1):
                start = at if text[at] == " " else max(i for i in range(at) if text[i] == " ")
                best[start] = max(weight, best.get(start, 0.0))
    return sorted((s, w) for s, w in best.items() if s not in excused)


WORDS = st.text("abc", min_size=1, max_size=4)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(WORDS, st.sampled_from([0.5, 1.0, 2.0]), max_size=6), st.lists(st.lists(WORDS, min_size=1, max_size=3).map(" ".join), max_size=4), st.lists(st.sampled_from(["a", "ab", "abc", "ca", "b b", "cab", "é", "áb", "4b"]), max_size=12))
def test_as_every_entry_at_every_place(weights, exceptions, words):
    # an exception that is an entry itself takes that entry's place
    lexicon, text = toxicity.Lexicon(weights, tuple(e for e in exceptions if e not in weights)), toxicity.folded(" ".join(words))
    assert sorted(toxicity.matches(text, lexicon.automaton())) == tried(text, lexicon)


def test_given_documents():
    """Words and phrases of the documents themselves as entries."""
    texts = [toxicity.folded(t[:3000] if t else t) for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 40").fetchall()]
    words = sorted({w for t in texts for w in t.split()})
    lexicon = toxicity.Lexicon({w[:4]: 1.0 + i % 3 for i, w in enumerate(words[::37])}, tuple(" ".join(t.split()[5:7]) for t in texts[::4] if len(t.split()) > 7))
    automaton = lexicon.automaton()
    assert all(sorted(toxicity.matches(t, automaton)) == tried(t, lexicon) for t in texts)
