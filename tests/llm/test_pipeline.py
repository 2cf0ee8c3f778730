"""The pipeline's stages and whole, on a small folder of tables, against what each stage says it does; and queries against their SQL."""

import math
import os
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_operators import least_reachable, slow_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, id string, `__sha` string, kept boolean"


def folder(spark, path, rows, labels):
    spark.createDataFrame([(i, t, "en", "i", "s", True) for i, t in rows], SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def texts():
    """Clean documents with exact and near copies, toxic ones, and odd rows."""
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    rows, labels = [], []
    for i in range(400):
        text = words(60)
        if bad := i % 5 == 0:
            text[7] = text[20] = text[33] = "scumbag"
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    base = [words(120) for _ in range(20)]
    for k, text in enumerate(base):
        rows += [(1000 + 10 * k + c, " ".join(text)) for c in range(3)]
        rows.append((1000 + 10 * k + 5, " ".join([*text[:100], "other", *text[101:]])))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "a b c"), (2003, "a b c"), (2003, "a b c"), (2004, " ".join(words(9000)))]
    return rows, labels


def test_pipeline(spark, tmp_path):
    rows, labels = texts()
    sf = folder(spark, tmp_path, rows, labels)
    left = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = left.columns, [left]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == columns
        tables.append(spark.createDataFrame(left.collect(), left.schema))
        left = tables[-1]
    of = [sorted(((r.doc_id, r.text) for r in t.collect()), key=str) for t in tables]
    weights = toxicity.learn(tables[0], spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out()))
    scores = {r.doc_id: r.score for r in toxicity.score(tables[0], weights).collect()}
    assert of[1] == sorted(((i, t) for i, t in rows if scores[i] < toxicity.THRESHOLD), key=str)
    assert not any("scumbag" in (t or "") for _, t in of[1]) and {i for i, _ in of[1]} >= {i for i, _ in rows if i is None or i >= 400 or i % 5}
    last = {}
    for i, t in of[1]:
        last[t or ""] = max([last.get(t or "", -1), -1 if i is None else i])
    assert [(i, t or "") for i, t in of[2]] == sorted(((i if i >= 0 else None, t) for t, i in last.items()), key=str)
    ids, fps = [i for i, _ in of[2]], [slow_fingerprint(t) for _, t in of[2]]
    assert sorted(i for i, _ in of[3]) == sorted(set(least_reachable(ids, fps)))
    pieces = corpus_pipeline.pack(spark, left, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in of[3]}
    whole = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)
    by_sequence = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).collect() == []


def plain(x):
    return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x if x is None or isinstance(x, bool | int) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.queries()[name](spark, SF), c.execute(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    rows = lambda names, values: sorted((tuple(plain(v[names.index(n)]) for n in columns) for v in values), key=repr)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
