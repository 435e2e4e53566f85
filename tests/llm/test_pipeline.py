"""Each stage of the pipeline on its own input, against brute force."""

import importlib
import random
import re
from collections import Counter

import pytest

from tidewater.llm import mixing, pii
from tidewater.llm.common import durable

from .test_classifiers import junk, prose
from .test_joins_and_search import brute_join


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.8
        text = (prose if good else junk)(rng, rng.randint(60, 200))
        if good and k % 9 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]  # copies
        if k % 7 == 0:
            text += f" write to me{k}@mail.example.com or +1 (555) 010-{k:04d}"
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
        if k % 2:
            labels.append((k, int(good), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at), labels


def test_stages(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    sf, labels = data
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "pii", "source_mixing", "best_fit_packing"]
    held = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf))
        assert docs.columns == columns
        held.append([tuple(r) for r in docs.collect()])
    start = {r.doc_id: tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good, one, clean, mixed = held
    assert all(start[r[0]] == r for r in good)
    kept = {r[0] for r in good}
    known = {d: q for d, q, _ in labels}
    assert sum((d in kept) == bool(q) for d, q in known.items()) / len(known) > 0.95
    want = {c for _, _, c, _ in brute_join([(r[0], r[1]) for r in good])}
    assert {r[0] for r in one} == want and len(one) == len(want) < len(good)
    by = {r[0]: r for r in one}
    for r in clean:
        assert r[1] == pii.redact(by[r[0]][1], pii.find(by[r[0]][1])) and r[4] == len(r[1])
        assert "@mail.example.com" not in r[1] and not re.search(r"\+1 \(555\)", r[1])
    times = {r.doc_id: (r.taken // r["size"]) for r in mixing.mix_report(spark.createDataFrame(clean, docs.schema)).collect()}
    assert Counter(r[0] for r in mixed) == Counter({d: n for d, n in times.items() if n})
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in mixed)
    whole = pipeline.run(spark, sf).collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
