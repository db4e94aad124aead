"""The pipeline against plain versions of its stages, and the registered queries."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cohortloom.llm import pii, quality, queries
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_the_columns(spark):
    docs = plain.edge_docs(spark).withColumnRenamed("n", "n_chars")
    labels = SMALL
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, labels)
        assert kept.columns == docs.columns
        assert kept.count() <= len(plain.EDGE_TEXTS)


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train_on_labels(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    ids = sorted(texts)
    base, features = quality.statistics([texts[i] for i in ids])
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    good = ~failed & ((model.score(features) >= 0.5) if model is not None else True)
    texts = {i: texts[i] for i, ok in zip(ids, good) if ok}
    groups = plain.components({i: plain.shingles(text) for i, text in texts.items()})
    texts = {i: text for i, text in texts.items() if groups[i] == i}
    kept = plain.without_repeats(texts)
    texts = {
        i: texts[i] if len(found) == len(plain.words(texts[i])) else " ".join(found) for i, found in kept.items() if found
    }
    for i, text in texts.items():
        for kind, a, b in sorted(plain.base_spans(text), key=lambda span: -span[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        texts[i] = text
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for row in corpus_pipeline.run(spark, SMALL).collect():
        pieces[row.doc_id].append(row)
    assert set(pieces) == set(texts)
    for i, rows in pieces.items():
        ids = np.concatenate([np.frombuffer(row.ids, "<u2") for row in sorted(rows, key=lambda row: row.start)]).tolist()
        assert ids == [*whole.encode(texts[i], add_special_tokens=False).ids, 1], texts[i][:200]
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_near_copies_are_told_by_text_not_by_id(spark):
    a, b, c, d, e = (plain.sentence(seed, 80) for seed in range(21, 26))
    rows = [
        (None, a), (None, b), (None, None),  # without an id, unlike
        (3, plain.edited(b, 1, 1)),  # linked to a text without an id
        (5, c), (5, d), (5, d),  # one id, two unlike texts, one of them twice
        (7, plain.edited(c, 1, 1)), (8, plain.edited(d, 1, 1)), (8, e),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()]
    assert sorted(kept, key=repr) == sorted([(None, a), (None, b), (None, None), (5, c), (5, d), (8, e)], key=repr)


def test_extra_columns_keep_value_and_type(spark):
    """Columns by every name that the operators give to columns of their own."""
    import pathlib
    import re

    sources = "".join(path.read_text() for path in pathlib.Path(corpus_pipeline.ngram_join.__file__).parent.glob("*.py"))
    used = set(re.findall(r"""["'`]([a-z_][a-z0-9_]{0,14})["'`]""", sources)) | {f"_c{i}" for i in range(7)}
    used |= {f"_{part}_{kind}" for part in ("base", "extra", "added", "all") for kind in pii.KINDS} | {"_text", "_mail", "_joined", "_plus"}
    names = sorted(used - {"doc_id", "text", "lang", "source", "n_chars"})
    assert len(names) > 150
    table = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = table.select("*", *[(F.col("doc_id") * 1000 + i).cast("int").alias(name) for i, name in enumerate(names)])
    plain_texts = {r.doc_id: r.text for r in table.collect()}
    for stage, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, SMALL)
        assert kept.dtypes == docs.dtypes, stage
        rows = kept.collect()
        assert len(rows) > 5, stage
        for row in rows:
            assert all(row[name] == row.doc_id * 1000 + i for i, name in enumerate(names)), stage
            if stage in ("quality rules", "n-gram Jaccard join"):
                assert row.text == plain_texts[row.doc_id]


def test_stages_on_an_empty_table(spark):
    docs = plain.empty_docs(spark)
    for stage, function in corpus_pipeline.STAGES:
        found = function(spark, docs, SMALL)
        assert found.collect() == [], stage
        assert stage == "packing" or found.columns == docs.columns
