"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)``.  The first four return the
columns of ``documents``: toxic documents go, one document of each group of
near copies stays, documents that hold benchmark passages go, secrets are
masked.  The last packs what is left into sequences.
"""

from __future__ import annotations

import public_tokenizers

from keelson.llm.common import shared_table, table
from keelson.llm.decontamination import keep_uncontaminated
from keelson.llm.packing import packing_report
from keelson.llm.secret_scan import redact_secrets
from keelson.llm.simhash import keep_one_of_each
from keelson.llm.toxicity import fit_lexicon, keep_clean

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity lexicon predicts to be toxic go."""
    return keep_clean(docs, fit_lexicon(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of near copies (five-word shingles, resemblance of 0.8 or more) one document stays."""
    return keep_one_of_each(docs, words=5, radius=12, least=0.8, sure=8)


def drop_contaminated(spark, docs, sf_dir):
    """Documents in which a window of a benchmark item occurs go."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark, docs, sf_dir):
    """Secrets are masked; their documents stay."""
    return redact_secrets(docs)


def pack(spark, docs, sf_dir):
    """What is left is tokenized and packed."""
    return packing_report(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Fingerprints, tokenization and packing are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, name)
    return docs
