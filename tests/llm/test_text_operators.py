"""Decontamination, token counts and chat format against brute force."""

from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat
from lattica.llm import decontaminate as D
from lattica.llm import token_counts as C


def brute(words, items, window):
    hit, names = set(), set()
    for name, w in items:
        if not w:
            continue
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names |= {name} - {None}
    return hit, names


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: r.randint(1, 4)]
    items = [(r.choice([f"i{k}", None, "i0"]), [r.choice(letters) for _ in range(r.randint(0, 12))]) for k in range(r.randint(0, 6))]
    window = r.randint(1, 6)
    automaton = D.ItemAutomaton(items, window)
    for _ in range(20):
        words = [r.choice(letters + [b"z"] * (r.random() < 0.5)) for _ in range(r.randint(0, 40))]
        spans, names = automaton.match(words)
        hit, want = brute(words, items, window)
        assert {k for a, b in spans for k in range(a, b)} == hit
        assert names == want
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_blocks_of_items_change_nothing(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    take = lambda df: sorted(map(repr, df.select("doc_id", "n_words", "span_starts", "span_ends", "items").collect()))
    assert take(D.hits(docs, items)) == take(D.hits(docs, items, block_words=1))


def test_spans_are_cut_and_covered_rows_go(spark):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    rows = [(1, f"Before, {passage.upper()}! After it all comes a lot of other text, more than ten words.", 1), (2, passage, 2), (3, "clean  Text\n", 3), (4, None, 4), (5, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, items int")
    got = {r["doc_id"]: (r["text"], r["items"]) for r in D.without_spans(docs, items).collect()}
    assert got == {1: ("Before, ! After it all comes a lot of other text, more than ten words.", 1), 3: ("clean  Text\n", 3), 4: (None, 4), 5: ("", 5)}
    assert D.without_spans(docs, items).columns == docs.columns
    assert D.report(docs, items.limit(0)).where("contaminated").count() == 0
    assert D.report(docs.limit(0), items).collect() == []


TEXTS = ["", "a<|endoftext|>b  <|startoftext|>", "don't WE'LL 12³ ½ ΑΣΣ é́ é İstanbul 你好 \x1c\x1d a b　c\x85d 🙂👍🏽 ﬁ Å", "'s!'s !'S <|endof", "x" * 3000, " \n ", "‍ ﻿abc  x\r\n\tend"]


def test_token_counts_equal_the_library(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = C.RunCounter(path).tokenizer
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + TEXTS + [None]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id int, text string, n_tokens string")
    for r in C.count_tokens(docs, path, limit=30).collect():
        t = texts[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 30)


def test_every_prefix_has_the_library_count():
    counter = C.RunCounter(public_tokenizers.path("word_bpe_49k.json"))
    for t in [*TEXTS[:4], TEXTS[6], "The quick brown fox's jumping, isn't it? 12345"]:
        table = C.PrefixTable(t, counter)
        counts = [len(counter.tokenizer.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert [table.at(k) for k in range(len(t) + 1)] == counts
        for limit in (0, 1, 5, 1000):
            assert table.fit(limit) == max(k for k, n in enumerate(counts) if n <= limit)
        assert table.fit(-1) == 0


def test_prefixes_of_random_texts_have_the_library_counts():
    counter, r = C.RunCounter(public_tokenizers.path("word_bpe_49k.json")), random.Random(4)
    signs = "abcdeé\u0301'’sreT<|>endoftext 0\u0661.,!-日\u0308İ"
    for _ in range(1500):
        t = "".join(r.choice(signs) for _ in range(r.randint(1, 14)))
        if r.random() < 0.3:
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(["<|endoftext|>", "<|startoftext|>", "'ll", "'RE"]) + t[at:]
        table = C.PrefixTable(t, counter)
        assert [table.at(k) for k in range(len(t) + 1)] == [len(counter.tokenizer.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t


UNSPACED = {"thai": "กินข้าวแล้วหรือยังครับ", "devanagari": "क़िताबेंहिन्दीमें", "marks": "e\u0301a\u0308x\u0323\u0307", "kana": "日本か\u3099語", "one base": "\u0301"}


@pytest.mark.parametrize("name", sorted(UNSPACED))
def test_unspaced_texts_have_the_library_counts_in_linear_time(name):
    counter = C.RunCounter(public_tokenizers.path("word_bpe_49k.json"))
    text = lambda n: "a" + (UNSPACED[name] * (n // len(UNSPACED[name]) + 1))[:n]
    t = text(700)
    table = C.PrefixTable(t, counter)
    assert [table.at(k) for k in range(len(t) + 1)] == [len(x.ids) for x in counter.tokenizer.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
    t = text(100_000)
    began = time.process_time()
    table = C.PrefixTable(t, counter)
    assert time.process_time() - began < 10  # about half a second; by the square it would be minutes
    assert table.at(len(t)) == len(counter.tokenizer.encode(t, add_special_tokens=False).ids)


def test_one_mark_behind_a_long_piece_and_special_strings_within():
    counter = C.RunCounter(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("日" * 300 + "か\u3099", "ab" * 150 + "e\u0301'll" + "x" * 90 + "\u0301<|endoftext|>é<|endoftext", "'" * 120 + "e\u0301s", "12" * 80 + "\u0301"):
        table = C.PrefixTable(t, counter)
        assert [table.at(k) for k in range(len(t) + 1)] == [len(counter.tokenizer.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t


def test_the_stored_column_answers_any_limit(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, t, "x", 5) for k, t in enumerate([*TEXTS, None, "one two three " * 20])]
    kept = C.stored(spark.createDataFrame(rows, "doc_id int, text string, PREFIX_COUNTS string, n_tokens int"), path)
    assert kept.columns == ["doc_id", "text", "n_tokens", "prefix_counts"]
    counter = C.RunCounter(path)
    for r in C.answered(kept.drop("text"), limits=(0, 7, 10_000), places=(3,), spans=((2, 9),)).collect():
        table = C.PrefixTable(rows[r["doc_id"]][1] or "", counter)
        assert (r["n_tokens"], r["fit_0"], r["fit_7"], r["fit_10000"], r["at_3"], r["between_2_9"]) == (table.at(1 << 40), table.fit(0), table.fit(7), table.fit(10_000), table.at(3), table.between(2, 9))
    assert C.answered(C.stored(spark.createDataFrame([], "doc_id int, text string"), path), limits=(3,)).collect() == []
    assert C.count_tokens(spark.createDataFrame([], "doc_id int, text string"), path).collect() == []
    assert C.answered(spark.createDataFrame([(None,)], "prefix_counts binary"), places=(2,)).select("n_tokens", "at_2").first() == (0, 0)


def test_the_store_answers_without_the_library():
    counter = C.RunCounter(public_tokenizers.path("word_bpe_49k.json"))
    table = C.PrefixTable("one anthlyredhe two " * 50, counter)
    counter.tokenizer = counter.merges = None
    assert [table.fit(table.at(k)) >= k for k in range(1000)] == [True] * 1000


def test_remembered_answers_stay_right_when_old_ones_go():
    held = C.Remembered(lambda x: x * 2, size=3)
    assert [held[k % 7] for k in range(100)] == [k % 7 * 2 for k in range(100)] and len(held) <= 3 and len(held.old) <= 3


def test_files_that_are_counted_otherwise_are_refused():
    with pytest.raises(ValueError, match="white space"):
        C.RunCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_chat_round_trip_and_examples(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    for text in ("", "\\", "<|", "\\<|im_end|>", "a\\n<\\|", "<<||\\\\"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    by_conv: dict = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["turn"] is not None, r["turn"] or 0)):
        by_conv.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    shown = [r for r in chat.examples(turns, None).collect() if r["kind"] == "example"]
    assert len(shown) == sum(role == "assistant" for t in by_conv.values() for role, _ in t)
    for e in shown:
        whole = e["context"] + e["reply"]
        parts = chat.turns_of(whole)
        own = by_conv[e["conv_id"]]
        assert parts == own[: len(parts)] and parts[-1][0] == "assistant" and e["context_chars"] == len(e["context"])
        assert chat.unescape(whole[e["loss_start"] : e["loss_end"]]) == parts[-1][1]
    got = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    for conv, own in by_conv.items():
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[conv]["formatted_chars"] == sum(len(e["context"] + e["reply"]) for e in shown if e["conv_id"] == conv)


@pytest.mark.parametrize("chars", [1, 40, 100, 10**9, None])
def test_segments_and_contexts_make_the_whole(spark, chars):
    r = random.Random(3)
    said = [(c, t, r.choice(["user", "assistant", "assistant", None, "tool"]), r.choice(["x", "x!", "<|im_end|>\n<|im_start|>assistant\nno", "", None, "y" * 300])) for c in (None, 1, 2, 3) for t in [None, 0, 0, 0, *range(12)]]
    said += [(4, 0, "assistant", "z" * 300_000), (4, 1, "assistant", "end"), (5, 0, "user", "alone")]
    turns = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    by_conv: dict = {}
    for c, t, role, text in sorted(said, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by_conv.setdefault(c, []).append((role or "", text or ""))
    segments: dict = {}
    whole = []
    shown = chat.examples(turns, chars)
    for e in shown.collect():
        if e["kind"] == "segment":
            assert len(segments.setdefault(e["conv_id"], [])) == e["number"] - 1 == e["segments"]
            segments[e["conv_id"]].append(e["context"])
        else:
            text = "".join(segments.get(e["conv_id"], [])[: e["segments"]]) + e["context"]
            assert len(text) == e["context_chars"] and (chars is None or len(e["context"]) < chars + 300_100)
            whole.append((e, chat.turns_of(text + (e["reply"] or "")), text + (e["reply"] or "")))
    for e, parts, text in whole:
        assert parts == by_conv[e["conv_id"]][: len(parts)]
        if e["kind"] == "example":
            assert parts[-1][0] == "assistant" and chat.unescape(text[e["loss_start"] : e["loss_end"]]) == parts[-1][1]
    for c, own in by_conv.items():
        mine = [(e, parts, text) for e, parts, text in whole if e["conv_id"] == c]
        assert [len(p) for e, p, _ in mine if e["kind"] == "example"] == [k for k, (role, _) in enumerate(own, 1) if role == "assistant"]
        assert mine[-1][1] == own
        row = chat.read_back(shown).where(F.col("conv_id").eqNullSafe(F.lit(c))).first()
        assert row["n_turns"] == len(own) and row["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256("".join(b for a, b in own if a == "assistant").encode()).hexdigest()
        assert row["formatted_chars"] == sum(len(x) for e, _, x in mine if e["kind"] == "example")


def test_chat_empty_table_and_extra_columns(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    assert chat.digests(turns.limit(0)).collect() == []
    assert sorted(chat.digests(turns.withColumn("chunk", F.lit(1))).collect()) == sorted(chat.digests(turns).collect())
