"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from keelson.llm import decontamination, license_scan, url_filter
from keelson.llm.bpe import bpe_report
from keelson.llm.common import table
from keelson.llm.html_text import extract_text
from keelson.llm.importance import importance_report
from keelson.llm.media_ogg import media_report
from keelson.llm.packing import packing_report
from keelson.llm.repeats import repeats_report
from keelson.llm.secret_scan import secret_report
from keelson.llm.simhash import simhash_report
from keelson.llm.spelling import spelling_report
from keelson.llm.toxicity import toxicity_report


def op1_toxicity(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_urls(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_licenses(spark, sf_dir):
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash_report(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    import public_tokenizers

    return packing_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decontamination(spark, sf_dir):
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ogg(spark, sf_dir):
    return media_report(table(spark, sf_dir, "documents"))


def op9_repeats(spark, sf_dir):
    return repeats_report(table(spark, sf_dir, "documents"))


def op10_html(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op11_spelling(spark, sf_dir):
    return spelling_report(table(spark, sf_dir, "documents"))


def op12_importance(spark, sf_dir):
    return importance_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_urls": op2_urls,
    "op3_licenses": op3_licenses,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_ogg": op8_ogg,
    "op9_repeats": op9_repeats,
    "op10_html": op10_html,
    "op11_spelling": op11_spelling,
    "op12_importance": op12_importance,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_urls": url_filter.SQL,
    "op3_licenses": license_scan.SQL,
    "op7_decontamination": decontamination.SQL,
}
