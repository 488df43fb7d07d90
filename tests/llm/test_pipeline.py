from __future__ import annotations

import re

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from test_classifiers import kneser_ney
from test_ngram_join import exact
from test_packing import one_by_one
from test_text_operators import brute

from lattica.llm import packing, toxicity
from lattica.llm.common import written
from lattica.llm.labelled import sample


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(written(stage(spark, seen[-1], folder), f"test-{name}"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    n = [d.count() for d in seen]
    assert n[0] >= n[1] == n[2] > n[3] >= n[4]
    assert sum(r["n_chars"] or 0 for r in seen[2].collect()) < sum(r["n_chars"] or 0 for r in seen[1].collect())
    packed = {i for r in seen[5].collect() for i in r["doc_ids"]}
    assert packed == {r["doc_id"] for r in seen[4].collect()}
    assert sorted(map(repr, P.run(spark, folder).collect())) == sorted(map(repr, seen[5].collect()))


def test_clean_documents_stay_as_they_are(spark):
    import os
    import tempfile

    at = tempfile.mkdtemp()
    rows = [(i, f"document {i} with words that are its own: {' '.join(f'w{i}x{k}' for k in range(30))}", "en", "s", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "some item")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, out, at)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r[0]: r[1] for r in rows}
    assert {i for r in P.run(spark, at).collect() for i in r["doc_ids"]} == set(range(20)) and os.path.isdir(at)


def key_of(line):
    key = line.encode().strip().lower().decode()
    return key if len(key) >= 20 else None


def without_passages(text, items):
    """The text without hit passages, from their first to their last word; None where most of it is hit."""
    data = (text or "").encode()
    words = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data))
    hit, _ = brute([w[0].lower() for w in words], items, P.WINDOW)
    if len(hit) > len(words) * P.COVERAGE:
        return False, text
    out, at, k = [], 0, 0
    while k < len(words):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out.append(data[at : words[k].start()])
            at, k = words[end].end(), end
        k += 1
    return True, b"".join([*out, data[at:]]).decode() if hit else text


def test_the_pipeline_equals_brute_force(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    chosen = sample(table, labels, "toxic", 5, 0, 1000).collect()
    measure = kneser_ney(chosen, [t for _, t in docs])
    seen = [r for r in chosen if r["order"] % 5 == 0]
    y = np.array([r["label"] for r in seen], float)
    slope, offset = toxicity.curve(y, np.array([measure(r["text"]) for r in seen]) * 100) if len(set(y)) == 2 else (1.0, -1.0)
    docs = [(i, t) for i, t in docs if measure(t) * 100 * slope + offset < 0]
    assert docs

    holders: dict = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if (key := key_of(line)) is not None:
                holders.setdefault(key, set()).add(i)
    last = {k: max(ids) for k, ids in holders.items() if len(ids) >= 3}
    kept_lines = lambda i, t: [x for x in t.split("\n") if last.get(key_of(x), i) == i]
    docs = [(i, t if t is None else "\n".join(kept_lines(i, t))) for i, t in docs]

    first = exact(docs, P.SHINGLE_WORDS, P.PERCENT)
    texts: dict = {}
    for i, t in docs:
        if first[i][1] == i:
            texts.setdefault((i, t), None)
    items = [(str(r["item_id"]), [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", r["text"].encode())]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"] is not None]
    cut = [(i, without_passages(t, items)) for i, t in texts]
    docs = [(i, t) for i, (stays, t) in cut if stays]

    encode = packing.encoding(public_tokenizers.path(P.TOKENIZER)).encode_ordinary
    got = P.run(spark, folder).collect()
    pieces = sorted((d, start, tuple(s["tokens"][sum(s["lengths"][:k]) :][:n])) for s in got for k, (d, start, n) in enumerate(zip(s["doc_ids"], s["starts"], s["lengths"], strict=True)))
    top = max(packing.CAPACITIES)
    assert pieces == sorted((i, start, tuple(ids[start : start + top])) for i, t in docs for ids in [encode(t or "")] for start in range(0, max(len(ids), 1), top))
    lengths = [len(encode(t or "")) for _, t in docs]
    assert sorted((s["bin_capacity"], s["n_tokens"]) for s in got if s["bin"] is not None) == sorted(one_by_one([n % top for n in lengths if n % top], packing.CAPACITIES, packing.SEQUENCE_COST) + [(top, top)] * sum(n // top for n in lengths))


def test_near_copies_are_found_as_by_all_pairs(spark, folder):
    """Recall of the near-duplicate stage on what line dedup leaves: every group that all pairs at the threshold give."""
    docs = P.dedup_lines(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, (_, least) in exact(rows, P.SHINGLE_WORDS, P.PERCENT).items() if least == i}
    assert {r["doc_id"] for r in P.drop_near_copies(spark, docs, folder).collect()} == want


def test_an_empty_table_and_null_ids(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, rows in (("empty", []), ("null", [(None, "a text", "en", "s", None), (None, None, None, None, None), (None, "a text", "en", "s", 3)])):
        at = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        found = P.run(spark, at).collect()
        assert sorted(len(i) for i in (r["doc_ids"] for r in found)) == ([] if not rows else [1, 2])
