"""The pipeline against a plain version of it, and its handling of awkward rows."""

import random

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as registry
import corpus_pipeline
from duelframe.llm import decontaminate
from duelframe.llm.queries import QUERIES, VOCABULARY

from .test_operators import brute_components, brute_repeats


def test_stages_on_awkward_rows(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(("kato", "mira", "sulo", "bende", "trin")) + str(rng.randrange(60)) for _ in range(n))
    item, passage = prose(30), prose(90)
    texts = [None, "", "12 34", *[prose(rng.randint(5, 80)) for _ in range(20)]]
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(3)] + [f"{prose(20)} {item} {prose(20)}", prose(2000)]
    texts += [texts[5], texts[6] + " end"]
    rows = [(i, t, "en" if i % 2 else None, "s", None, 0.5) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = after
    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    order = list(left)
    left = {order[i]: left[order[i]] for i, _, p in brute_components(list(left.values()), 5, 80) if i == p}
    cuts = brute_repeats(list(left.values()), 400)
    got = {r["doc_id"]: r for r in docs.collect()}
    clean = {}
    for (i, text), (removed, _, _) in zip(left.items(), cuts, strict=True):
        if not removed:
            clean[i] = text
    for i, text in clean.items():
        bad = decontaminate.brute_force(decontaminate.normal(item), decontaminate.normal(text)) <= int(len(decontaminate.normal(item)) * 0.06)
        assert (i in got) != bad and (bad or got[i]["text"] == text), i
    assert set(got) <= set(left) and all(r["score"] == 0.5 for r in got.values())

    library = Tokenizer.from_file(VOCABULARY)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = library.encode(got[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids


def test_registered():
    assert len(corpus_pipeline.STAGES) == 5
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert set(QUERIES) | {"pipeline"} <= set(registry.queries())
