"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keelson.llm.decontamination import contamination_report, find_contamination, keep_uncontaminated
from keelson.llm.html_text import extract_text
from keelson.llm.license_scan import license_report, scan_licenses
from keelson.llm.media_ogg import encode_ogg, media_report
from keelson.llm.packing import pack_documents, packing_report
from keelson.llm.repeats import remove_repeats, repeats_report
from keelson.llm.secret_scan import redact_secrets, scan_secrets, secret_report
from keelson.llm.simhash import keep_one_of_each, simhash_groups, simhash_report
from keelson.llm.toxicity import Lexicon, keep_clean, score_toxicity, toxicity_report
from keelson.llm.url_filter import judge_urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns whose names operators use themselves.
EXTRA = "id long, h long, score double, first long, spans string, hits int, words int, n_words string, key string, ids int, media int, node int, k1 int, __k1 int, k2 int, __masked string, masked int, label int, a.b int, u int, v int, n int, least int, root int, text_ int"


def rows_of(spark):
    long = "word " * 60_000
    rows = [(1, None), (2, ""), (3, "The MIT License"), (3, "The MIT License"), (None, "no id"), (5, long), (6, long), (7, " \n\t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({part.split()[0]: F.lit(1).cast(part.split()[1]) for part in EXTRA.split(", ")})


def bench(spark, rows=((1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (None, "x"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((3, 1, 0), (5, None, None), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity_report(d, labels(s)),
    "lexicon": lambda s, d: score_toxicity(d, Lexicon({"word": 1.0})),
    "licenses": lambda s, d: license_report(d),
    "scan": lambda s, d: scan_licenses(d),
    "secrets": lambda s, d: secret_report(d),
    "spans": lambda s, d: scan_secrets(d),
    "simhash": lambda s, d: simhash_report(d),
    "groups": lambda s, d: simhash_groups(d, 5, 8),
    "contamination": lambda s, d: contamination_report(d, bench(s)),
    "find": lambda s, d: find_contamination(d, bench(s)),
    "ogg": lambda s, d: media_report(d),
    "media": lambda s, d: encode_ogg(d),
    "repeats": lambda s, d: repeats_report(d),
    "kept": lambda s, d: remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    docs = rows_of(spark)
    got = OPERATORS[name](spark, docs).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    empty = rows_of(spark).limit(0)
    assert OPERATORS[name](spark, empty).collect() == []


def test_packing_keeps_every_token_of_odd_rows(spark):
    got = packing_report(rows_of(spark), TOKENIZER).toPandas()
    assert got["length"].sum() == 1 + 1 + 2 * (3 + 1) + (2 + 1) + 2 * (60_000 + 1) + 1
    assert packing_report(rows_of(spark).limit(0), TOKENIZER).collect() == []
    assert pack_documents(rows_of(spark), TOKENIZER).columns[0] == "doc_id"


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "nope"), (4, "http://Example.COM"), (4, "http://Example.COM"), (5, "x://" + "a." * 5000 + "net/fr/" + "p" * 5000), (None, "http://spam-farm.example.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "keys", "every", "found", "best", "hits", "id")})
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert got[1]["host"] == got[2]["host"] == got[3]["host"] == "" and got[4]["host"] == "example.com" and got[4]["rule"] is None
    assert got[5]["rule"] == "net/fr/" and got[5]["verdict"] == "block" and got[None]["verdict"] == "block"
    assert judge_urls(pages.limit(0)).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" + "long " * 100_000), (4, "u", "<!-- open"), (None, "u", "<div><<p>a<b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = {r["page_id"]: r for r in extract_text(pages).collect()}
    assert got[1]["text"] == got[2]["text"] == got[4]["text"] == "" and got[3]["n_chars"] == 500_000 - 1
    assert extract_text(pages.limit(0)).collect() == []


def test_filters_keep_columns_and_clean_rows(spark):
    docs = rows_of(spark)
    for kept in (keep_clean(docs, Lexicon({"zzz": 1.0})), keep_uncontaminated(docs, bench(spark)), redact_secrets(docs)):
        assert kept.columns == docs.columns and kept.count() == docs.count()
    one = keep_one_of_each(docs)
    # null, empty and blank texts have no words and are one group; repeated rows and long copies leave one each
    assert one.columns == docs.columns and sorted((r[0] or 0) for r in one.select("doc_id").collect()) == [0, 1, 3, 5]
    for empty in (docs.limit(0),):
        assert keep_one_of_each(empty).collect() == [] and keep_uncontaminated(empty, bench(spark).limit(0)).collect() == []


def test_empty_benchmark_and_labels(spark):
    docs = rows_of(spark)
    assert contamination_report(docs, bench(spark).limit(0)).where("contaminated").count() == 0
    assert toxicity_report(docs, labels(spark).limit(0)).where("score > 0").count() == 0
