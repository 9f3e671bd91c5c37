"""From raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers

from basketlore.llm.byte_bpe import encode
from basketlore.llm.exact_dedup import drop_copies
from basketlore.llm.mixing import sample
from basketlore.llm.ngram_join import drop_near_copies
from basketlore.llm.quality import keep_good
from basketlore.llm.shared import Scratch, documents, labels


def quality(spark, docs, sf_dir):
    """Documents of low quality and toxic ones go."""
    return keep_good(docs, labels(spark, sf_dir))


def exact_copies(spark, docs, sf_dir):
    """Of equal texts the one of smallest id stays."""
    return drop_copies(docs)


def near_copies(spark, docs, sf_dir):
    """Of documents connected by links of 80 % of their shingles the one of smallest id stays."""
    return drop_near_copies(docs)


def mixing(spark, docs, sf_dir):
    """Half of the tokens, drawn so that sources, languages and forms have their target shares."""
    return sample(docs)


def token_ids(spark, docs, sf_dir):
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", mixing),
    ("byte-level BPE", token_ids),
]

# Classifier, joins and sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another, starting with the table ``documents``."""
    work = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
