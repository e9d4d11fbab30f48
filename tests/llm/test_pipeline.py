"""The pipeline on a small folder against plain versions of its stages, and its
registration."""

import hashlib
import random
from collections import defaultdict

import pytest
from test_ops import plain_components, plain_decontaminate, toxic_tables

import corpus_pipeline
from weblens.llm import queries, toxicity
from weblens.llm.queries import piece_model


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(21)
    docs, labels = toxic_tables(spark, 120)
    texts = [t for _, t in docs]
    rows = [(i, t) for i, t in docs]
    rows += [(200 + i, texts[i]) for i in range(10)]  # exact copies with larger ids
    rows += [(300 + i, texts[i + 20] + " tail words") for i in range(10)]  # near copies
    rows += [(310, texts[31]), (310, texts[31]), (311, None), (312, ""), (313, None), (None, texts[40]), (None, "alone here"), (314, "x " * 4000)]
    items = [(i, " ".join(texts[50 + i].split()[i:i + r.choice([9, 12, 20])])) for i in range(6)] + [(9, "nothing like it"), (10, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def plain_run(spark, folder, rows, items):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model.terms)
    import numpy as np

    left = [(i, t) for i, t in rows if model.scores(scorer, [np.frombuffer((t or "").encode(), dtype=np.uint8)])[0] < 0.5]
    by_text = defaultdict(list)
    for i, t in left:
        by_text[t or ""].append((i, t))
    left = [max(g, key=lambda x: (x[0] is not None, x[0] or 0)) for g in by_text.values()]
    comps = {(i, t): c for (i, t), c in zip(left, [dict_of(left)[k] for k in range(len(left))])}
    left = [(i, t) for i, t in left if comps[(i, t)] == i]
    left = [(i, t) for i, t in left if plain_decontaminate([(i, t)], items)[0][2] == 0]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    out = []
    for i, t in left:
        ids = sp.encode(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def dict_of(left):
    """Component id of each row by its place (ids may repeat or be null)."""
    numbered = [(k, t) for k, (_, t) in enumerate(left)]
    low = {}
    for k, _, c in plain_components(numbered):
        low.setdefault(c, []).append(k)
    out = {}
    for members in low.values():
        ids = [left[k][0] for k in members if left[k][0] is not None]
        for k in members:
            has_words = bool((left[k][1] or "").split())
            out[k] = (min(ids) if ids else None) if has_words else left[k][0]
    return out


def test_pipeline_equals_plain_stages(spark, folder):
    d, rows, items = folder
    got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect()], key=repr)
    assert got == plain_run(spark, d, rows, items)


def test_stages_keep_the_columns(spark, folder):
    d, _, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
        assert stage(spark, docs.limit(0), d).count() == 0, name


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, duck, name):
    from conftest import SF_SMALL
    from weblens.plans.compare import compare

    ok, msg = compare(queries.QUERIES[name](spark, SF_SMALL), duck, queries.ORACLE[name])
    assert ok, msg


def test_stages_read_what_the_one_before_wrote(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipe

    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.filter("doc_id > 1")

    monkeypatch.setattr(pipe, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    assert [r.doc_id for r in pipe.run(spark, str(tmp_path)).collect()] == [2]
    assert all("weblens-scratch" not in f for f in read[0])
    assert all(fs and all(f"weblens-scratch/{n}-" in f for f in fs) for n, fs in zip(("one", "two"), read[1:]))
