from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np

from lattica.llm import quality, toxicity
from lattica.llm.labelled import sample


def labelled(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["an", "er", "tion", "the", "st", "re", "ou"]) for _ in range(r.randint(1, 3)))
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(8, 80))]
        good, toxic = r.random() < 0.7, r.random() < 0.25
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for bad in r.sample(["grubble", "snark", "vexmop"], 2):
                w.insert(r.randrange(len(w)), bad)
        docs.append((i, " ".join(w)))
        if i % 10:
            labels.append((i, int(good), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "the grubble"), (1002, "the an " * 60_000)]
    labels += [(1000, 1, None), (1001, None, 0), (None, 1, 1), (5000, 1, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def check(rows, truth, place, folds, fold):
    assert len(rows) == 904
    right = [r["predicted"] == truth[r["doc_id"]][place] for r in rows if r["held_out"] and (truth.get(r["doc_id"]) or (None, None))[place] is not None]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)


def test_quality_held_out(spark):
    docs, labels, truth = labelled(spark)
    check(quality.report(docs.withColumn("score", docs.doc_id), labels).collect(), truth, 0, 3, 1)


def test_toxicity_held_out(spark):
    docs, labels, truth = labelled(spark)
    check(toxicity.report(docs, labels).collect(), truth, 1, 5, 0)
    kept = toxicity.without_toxic(docs.withColumn("score", docs.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 600 < kept.count() < 760


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels, _ = labelled(spark)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    for report in (quality.report, toxicity.report):
        assert sorted(map(repr, report(docs, turned).collect())) == sorted(map(repr, report(docs, labels).collect()))


def test_without_labels(spark):
    docs, labels, _ = labelled(spark)
    assert {r["score"] for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs.limit(0), labels).collect() == [] == toxicity.report(docs.limit(0), labels).collect()


def test_lookup_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**50, 20000))
    table = toxicity.Lookup(keys, np.arange(len(keys), dtype=np.float32))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert np.isnan(table.get(np.array([2**51, 2**52 + 1]))).all()


def kneser_ney(chosen, texts):
    """The measure of a text, from dictionaries of words and pairs of words."""
    fitted = [r for r in chosen if r["order"] % 5]
    held = ({}, {})
    for r in fitted:
        for w in set(toxicity.words_of(r["text"])):
            held[r["label"]][w] = held[r["label"]].get(w, 0) + 1
    known = {w for c in held for w, n in c.items() if n >= toxicity.MIN_DOCS}
    fold = lambda t: [w if w in known else None for w in toxicity.words_of(t)]
    found = ({}, {})
    for r in fitted:
        words, least = fold(r["text"]), {}
        for v, w, c in zip([None, *words], words, toxicity.contexts_of(r["text"]).tolist(), strict=False):
            for key in (("any", w), (v, w)):
                least[key] = min(c, least.get(key, c))
        for key, c in least.items():
            found[r["label"]].setdefault(key, set()).add(c)
    n = [{k: len(c) for k, c in f.items()} for f in found]
    follows = {}
    for t in texts:
        words = fold(t)
        for v, w in zip([None, *words], words, strict=False):
            if w is not None:
                follows.setdefault(w, set()).add(v)
    every = [*known, None]
    last = {w: len(follows.get(w, ())) or 0.5 for w in every}
    rest = sum(last.values())
    total = [sum(k for (v, _), k in c.items() if v == "any") for c in n]
    both = {w: sum(c.get(("any", w), 0) for c in n) for w in every}
    less = {w: max(both[w] - toxicity.DISCOUNT, 0) / sum(total) for w in every}
    all_less = sum(less.values())
    shared = {w: less[w] + (1 - all_less) * last[w] / rest for w in every}

    def kept(count, expected):
        return max(count - expected - toxicity.DEVIATIONS * math.sqrt(expected + 1), 0)

    ofs = [Counter(), Counter()]
    for y in (0, 1):
        for (v, _), k in n[y].items():
            ofs[y][v] += k
    pairs = {k for c in n for k in c if k[0] != "any" and k[1] is not None}
    word, pair, context = ({}, {}), ({}, {}), ({}, {})
    for y in (0, 1):
        own = {w: kept(n[y].get(("any", w), 0), both[w] / sum(total) * total[y]) if w is not None else 0 for w in every}
        all_own = sum(own.values())
        for w in every:
            word[y][w] = (own[w] + (total[y] - all_own) * shared[w]) / total[y]
        more = {k: kept(n[y].get(k, 0), sum(c.get(k, 0) for c in n) / sum(o[k[0]] for o in ofs) * ofs[y][k[0]]) for k in pairs}
        used = Counter()
        for k, m in more.items():
            used[k[0]] += m
        for v in every:
            context[y][v] = 1 - used[v] / max(ofs[y][v], 1)
        for k in pairs:
            pair[y][k] = more[k] / max(ofs[y][k[0]], 1) + context[y][k[0]] * word[y][k[1]], more[k]

    def measure(text):
        words, empty = fold(text) or [None], not fold(text)
        out = 0.0
        for v, w in zip([None, *words], words, strict=False):
            if any(pair[y].get((v, w), (0, 0))[1] for y in (0, 1)):
                out += math.log(pair[1][v, w][0] / pair[0][v, w][0])
            elif not empty:
                out += math.log(word[1][w] * context[1][v] / word[0][w] / context[0][v])
            else:
                out += math.log(word[1][w] / word[0][w])
        return out / len(words)

    return measure


def test_toxicity_equals_dictionaries(spark):
    docs, labels, _ = labelled(spark)
    chosen = sample(docs, labels, "toxic", 5, 0, 1000).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    measure = kneser_ney(chosen, texts.values())
    seen = [r for r in chosen if r["order"] % 5 == 0]
    slope, offset = toxicity.curve(np.array([r["label"] for r in seen], float), np.array([measure(r["text"]) for r in seen]) * 100)
    for r in toxicity.report(docs, labels).collect():
        want = 1 / (1 + math.exp(-(measure(texts[r["doc_id"]]) * 100 * slope + offset)))
        assert abs(r["score"] - want) < 1e-4, (r["doc_id"], r["score"], want)


def test_copies_and_shared_passages_count_once(spark):
    assert (toxicity.contexts_of("a b c. A b, C!")[[2, 5]] == toxicity.contexts_of("x a b c a b c")[[3, 6]]).all()
    once = toxicity.one_each(np.array([3, 1, 3]), np.array([9, 5, 2]))
    assert [x.tolist() for x in once] == [[1, 3], [5, 2]]


def test_quality_equals_ftrl_coordinate_by_coordinate(spark):
    docs, labels, _ = labelled(spark)
    docs = docs.where("doc_id is null or doc_id < 150 or doc_id > 900")
    chosen = sorted(sample(docs, labels, "quality", 3, 1, 1000).collect(), key=lambda r: (r["order"], r["label"], r["text"]))
    z, n = {}, {}

    def weight(i):
        z_i, n_i = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(z_i) <= quality.L1 else (math.copysign(quality.L1, z_i) - z_i) / ((quality.BETA + math.sqrt(n_i)) / quality.ALPHA + quality.L2)

    def vector(text):
        f = quality.features((text or "").encode(), quality._Words()).tolist()
        return {"bias": 1.0} | {i: k * quality.SCALE / len(f) for i, k in Counter(f).items()}

    for _ in range(quality.EPOCHS):
        for r in chosen:
            x = vector(r["text"])
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - r["label"]) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.report(docs, labels).collect():
        want = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in vector(texts[r["doc_id"]]).items())))
        assert abs(r["score"] - want) < 1e-4


def test_a_sample_is_bounded_in_bytes_and_keeps_texts_whole(spark):
    docs, labels, _ = labelled(spark)
    every = sorted(sample(docs, labels, "toxic", 5, 0, 1000).collect())
    some = sorted(sample(docs, labels, "toxic", 5, 0, 1000, size=20_000).collect())
    assert some == every[: len(some)] and sum(len(r["text"]) for r in some[:-1]) < 20_000 < sum(len(r["text"]) for r in some)
    assert any(len(r["text"]) > 200_000 for r in sample(docs, spark.createDataFrame([(1002, 1)], "doc_id bigint, toxic int"), "toxic", 5, 9, 10).collect())
