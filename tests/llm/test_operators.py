"""Small tests of operators 2, 3, 4, 6, 7, 8, 9 and 10 against brute force, round trips and SQL."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coverwise.llm import decontamination, language_id, packing, quality, sharding, substring_dedup, token_files, warc
from coverwise.llm.catalog import op8_sentence_spans, op10_warc, tokenizer_file

from .conftest import SF001, SF01

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Word word word."), (5, "Word word word."), (None, "x y z"), (6, "q " * 5000)]


def edge(spark):
    return spark.createDataFrame([(i, t, "en", 7, "s") for i, t in EDGE], "doc_id long, text string, lang string, rid int, shard string")


# 2 ---------------------------------------------------------------------

def test_decontamination(spark, con):
    leaks = decontamination.find_leaks(spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/benchmark.parquet"))
    assert sorted(map(tuple, leaks.collect())) == sorted(con.execute(decontamination.ORACLE).fetchall())
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "alpha beta"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(9, "x ONE two, three four five six y"), (8, "the Alpha beta rest"), (7, None), (6, "one two three")], "doc_id long, text string")
    assert sorted((r["item_id"], r["doc_id"]) for r in decontamination.find_leaks(docs, items).collect()) == [(1, 9), (2, 8)]
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0
    assert decontamination.find_leaks(edge(spark), items).count() == 0


# 3 ---------------------------------------------------------------------

def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer
    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    folder, manifest = token_files.write_tokens(docs, path, str(tmp_path / "t"), n_shards=3)
    got = token_files.read_tokens(spark, folder, manifest, with_ids=True).collect()
    expect = Counter((r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expect
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    _, none = token_files.write_tokens(docs.limit(0), path, str(tmp_path / "e"))
    assert none.count() == 0


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.2, 10_000) % 50_000).astype(np.uint32)
    data = token_files.pack_file([3], [len(ids)], ids)
    assert token_files.unpack_file(data)[2].tolist() == ids.tolist() and len(data) < 2 * len(ids) + 30_000
    with pytest.raises(ValueError):
        token_files.unpack_file(data[:500] + bytes([data[500] ^ 1]) + data[501:])


def test_coder_round_trip_of_shapes(monkeypatch):
    rng = np.random.default_rng(5)
    shapes = [np.full(5000, 7), np.arange(5000), rng.integers(0, 400_000, 300_000), np.tile([1, 2, 3], 3000), rng.zipf(1.2, 9000) % 50_000]
    monkeypatch.setattr(token_files, "GROUP", 3)
    for x in shapes:
        for n in (0, 1, 2, token_files.BLOCK - 1, token_files.BLOCK, token_files.BLOCK + 1, 2 * token_files.BLOCK, len(x)):
            ids = x[:n].astype(np.uint32)
            docs, sizes, got = token_files.unpack_file(token_files.pack_file([None, 4], [n, 0], ids))
            assert (docs, sizes, got.tolist()) == ([None, 4], [n, 0], ids.tolist())


def test_coder_steps(monkeypatch):
    """One interval a step for the mixed orders; classes go to several coders, places to none (F1: CPU seconds a GB)."""
    rng = np.random.default_rng(3)
    ids, calls = (rng.zipf(1.2, 4 * token_files.BLOCK) % 50_000).astype(np.uint32), Counter()
    for coder, name in ((token_files._Encoder, "code"), (token_files._Decoder, "take")):
        def counted(self, *args, _step=getattr(coder, name), _name=name):
            calls[_name] += 1
            return _step(self, *args)
        monkeypatch.setattr(coder, name, counted)
    assert token_files.unpack_file(token_files.pack_file([1], [len(ids)], ids))[2].tolist() == ids.tolist()
    assert token_files.BLOCK < calls["code"] < 1.5 * token_files.BLOCK and calls["code"] == calls["take"]


def test_word_tokenizer_is_the_library():
    from tokenizers import Tokenizer

    from coverwise.llm import tokens
    path = tokenizer_file("word_bpe_49k.json")
    tok, whole = tokens.tokenizer(path), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    parts = [*"aAbBeEhHiItTwWyYsSdDmMrRlLvV''\"!,.-_$<0123 \n\t\r\x0b\x0c\x00\x1c\x7féÉàßÿ×÷ÞжЖ中가²½ªµΣςİıſ", "\u0301", "\u0308", "\u030a", "\u0331", "\u0307", "\u0338",
             "\u1100", "\u1161", "\u0085", "\u00a0", "\u3000", "\u212a", "\u212b", "\u00ad", "\u200d", "\U0001f600", "<|endoftext|>", "</w>", "'s", "'RE", "'Ll", " 0 "]
    rng = random.Random(4)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(8000)] + ["W\u030a w\u030a T\u0308 J\u030c", "don't 'tis ''s 5's x!'s", None]
    tok._forget()
    ids, n = tok.encode(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[e - k:e].tolist() for e, k in zip(ends.tolist(), n.tolist())] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    tok._forget()
    tok.encode(pa.array(["Plan, plan. PLAN! (plan) 17 71 11", "É été Été,"]))
    assert sum(p.strip() not in "!(),." for p in tok.place) == 5  # plan, 1, 7, é, été: each distinct word is encoded once


# 4 ---------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert not any(r["rejected"] for r in out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    rows = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.identify(edge(spark)).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (5, "en", False)} <= rows
    assert language_id.identify(edge(spark).limit(0)).count() == 0


def test_kneser_ney_sums_to_one():
    model = language_id.build_model({"x": {"abca": 3, "bcab": 2, "cabd": 1}, "y": {"abcd": 2}})
    chars = [ord(c) for c in "abcd"]
    for j in range(2):
        total = 0.0
        for c in chars:
            p = np.array([ord("a"), ord("b"), ord("c"), c], np.uint32)
            total += float(np.exp(model.log_probability(p, np.zeros(4, np.int64))[3, j]))
        assert 0.5 < total <= 1.0001  # the rest is for characters never seen


def test_language_model_keeps_every_ngram(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = lambda lo, n: "".join(map(chr, rng.integers(lo, lo + 6000, n)))
    texts = [("zh", text(0x4E00, 60_000)) for _ in range(4)] + [("ko", text(0xAC00, 5_000)), ("en", "some words and some other words")]
    counts = defaultdict(Counter)
    for lang, t in texts:
        t = f" {t} "
        counts[lang].update(t[i:i + 4] for i in range(len(t) - 3))
    assert len(counts["zh"]) > 200_000
    monkeypatch.setattr(language_id, "PART", 400_000)  # so that there are several parts
    model, whole = language_id.train(spark.createDataFrame(texts, "lang string, text string")), language_id.build_model(counts)
    assert model.langs == whole.langs and model.floor == whole.floor and len(model.parts) > 1
    points, doc = language_id.characters(pa.array([t[:3000] for _, t in texts] + ["words \u4e00\u0416 some"]))
    assert np.allclose(model.log_probability(points, doc), whole.log_probability(points, doc), atol=1e-5)


# 6 ---------------------------------------------------------------------

def test_packing_covers_every_id(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text").where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 10_000))
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by_doc) == docs.count()
    for parts in (*by_doc.values(),):
        at = 0
        for start, n, total in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == total
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_sum_of_squares_choice():
    rng = random.Random(1)
    p, items = packing.SumOfSquares(20), []
    for k in range(300):
        size, c = rng.randrange(1, 20), p.count.copy()
        change = {0: (2 * c[size] + 1 if size < 20 else 0)}
        for g in range(1, 21 - size):
            if c[g]:
                change[g] = 1 - 2 * c[g] + (2 * c[g + size] + 1 if g + size < 20 else 0)
        level = p.place(size)
        assert change[level] == min(change.values())
        items += p.add(k, np.arange(size, dtype=np.uint32))
    items += p.finish()
    assert sum(sum(len(x[2]) for x in w) < 20 for w in items) <= 1


# 7 ---------------------------------------------------------------------

def brute_counts(text):
    from .test_ngram_join import words_of
    t = text or ""
    w, cur = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                w.append(cur)
            cur = ""
        else:
            cur += c
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i:i + 8])].append(i)
    cover = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_counts_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10_000))
    out = quality.judge(docs).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in out) == Counter((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect())
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    for r in out:    # no rule votes against it: kept, whatever the others abstain from
        votes = [r[c] for c in r.asDict() if c.startswith("vote_")]
        assert len(votes) == 8 and (r["kept"] or r["base_failed"] or -1 in votes)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    judged = [(label[r["doc_id"]], r["kept"]) for r in out if r["doc_id"] in label and not r["base_failed"]]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert quality.judge(docs.limit(0)).count() == 0


def test_abstentions_alone_condemn_nothing():
    rows = {(1, 1, 0): 900, (0, 0, 0): 5, (-1, 0, 0): 60, (-1, -1, 0): 30, (0, 1, 0): 40}
    model = quality.fit(list(rows.items()), ["a", "b", "c"])
    assert all(x >= 0 for odds in model.evidence(False) for x in odds)
    assert any(odds[1] < 0 for odds in model.evidence(True))


def test_em_recovers_accuracies():
    rng = random.Random(4)
    rows = Counter()
    for _ in range(5000):
        bad = rng.random() < 0.3
        rows[tuple(-1 if rng.random() < (0.6 if bad else 0.02) else 0 for _ in range(4))] += 1
    model = quality.fit(list(rows.items()), ["a", "b", "c", "d"])
    assert abs(model.prior - 0.7) < 0.05 and all(abs(b[0] - 0.6) < 0.06 for b in model.bad)


# 8 ---------------------------------------------------------------------

def test_sentence_spans(spark, con):
    got = op8_sentence_spans(spark, SF01)
    assert sorted(map(tuple, got.select("doc_id", "n_sentences", "n_removed", "n_spans", "kept_sha256").collect())) == sorted(con.execute(substring_dedup.ORACLE).fetchall())
    a = "One two three four five six seven. Eight nine ten eleven twelve thirteen."
    docs = spark.createDataFrame([(1, "Start here. " + a), (2, a.upper() + " End."), (3, None), (4, ""), (2, a.upper() + " End.")], "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert kept == [(1, "Start here. " + a), (2, " End."), (2, " End."), (3, ""), (4, "")]
    assert substring_dedup.remove_repeats(edge(spark)).count() == len(EDGE)


def test_sentence_spans_keep_one_of_equal_rows(spark):
    a = "One two three four five six seven. Eight nine ten eleven twelve thirteen."
    b = a.replace("One", "First")
    docs = spark.createDataFrame([(2, a), (2, a), (2, a), (3, a), (None, b), (None, b), (4, None), (4, None), (5, "Alone.")], "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["kept_text"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert kept == sorted([(2, a, 0), (2, "", 2), (2, "", 2), (3, "", 2), (None, b, 0), (None, "", 2), (4, "", 0), (4, "", 0), (5, "Alone.", 0)], key=str)


# 9 ---------------------------------------------------------------------

def test_sharding(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").unionByName(edge(spark).select("doc_id", "text"), allowMissingColumns=True)
    out = sharding.assign_shards(docs).collect()
    text = defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(r["text"])
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append((r["slot"], r["size"]))
        assert any((r["size"], r["text_crc32"]) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in text[r["doc_id"]])
    assert sorted(by) == list(range(40)) and len(out) == docs.count()
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    loads = [sum(n for _, n in v) for v in by.values()]
    assert max(loads) - min(loads) <= max(n for v in by.values() for _, n in v)
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_slot_map_edits_move_little():
    rng = random.Random(7)
    size = {v: rng.randrange(500, 1500) for v in range(4096)}
    old = sharding.initial_map(size, 40)
    new = sharding.edit_map(old, size, 41)
    moved = sum(old[v] != new[v] for v in old)
    load = Counter()
    for v, s in new.items():
        load[s] += size[v]
    assert moved <= 4096 / 41 * 1.3 and all(new[v] in (old[v], 40) for v in old)
    assert max(load.values()) <= 1.05 * sum(size.values()) / 41
    assert set(sharding.edit_map(old, size, 39).values()) == set(range(39))


# 10 --------------------------------------------------------------------

def test_warc_matches_sql(spark, con):
    got = op10_warc(spark, SF01)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(warc.ORACLE).fetchall(), key=str)


def test_warc_files(spark, tmp_path):
    big = "ä" * 700
    pages = [(1, "u1", big), (2, "u2", big), (3, "u3", "short"), (4, "u4", "short"), (5, None, None), (6, "u6", ""), (7, "u7", big + "!"), (7, "u7", big + "!"), (None, "u", "x")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    runs = []
    for k in range(2):
        folder, manifest = warc.write_warc(df, str(tmp_path / f"w{k}"), n_shards=2, roll_bytes=2000)
        files = sorted((tmp_path / f"w{k}").glob("*.warc.gz"))
        runs.append({f.name: hashlib.sha1(f.read_bytes()).hexdigest() for f in files})
        assert not (tmp_path / f"w{k}" / "_temporary").exists()
    assert runs[0] == runs[1] and len(runs[0]) > 1
    got = warc.read_warc(spark, folder, manifest, with_payload=True).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == Counter([(1, "revisit", 2, 1400), (2, "response", None, 1400), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0),
                             (6, "response", None, 0), (7, "response", None, 1401), (7, "revisit", 7, 1401), (None, "response", None, 1)])
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {big, "short", "", big + "!", "x"}
    assert warc.read_warc(spark, *warc.write_warc(df.limit(0), str(tmp_path / "e"))).count() == 0


# 8, runs of any length -------------------------------------------------

def test_sentence_spans_of_short_lines_and_without_spaces(spark):
    lines = "".join(f"item {i}\n" for i in range(10))
    chinese = "".join(f"这是第{i}句话，内容各不相同而且比较长一些。" for i in range(40))
    docs = spark.createDataFrame([(1, lines), (2, lines), (3, "Own words first.\n" + lines), (4, chinese), (5, chinese[:-1] + "呀。"), (6, "Yes. No. Yes."), (7, "Yes. No. Yes.")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 10, 10] and got[3]["kept_text"] == "Own words first.\n"
    assert got[4]["n_sentences"] == got[5]["n_sentences"] == 40 and got[4]["n_removed"] == 0 and got[5]["n_removed"] == 39
    assert got[7]["n_removed"] == 0  # fewer words than a run holds


# 2, items of several rows and stock phrases -----------------------------

def contained(docs, items):
    """Leaks by definition: the union of each id's shingles, all widths."""
    def shingles(text, widths):
        w = [x for x in __import__("regex").split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
        return {tuple(w[i:i + k]) for k in widths(len(w)) for i in range(len(w) - k + 1)}
    want, have = defaultdict(set), defaultdict(set)
    for i, t in items:
        want[i] |= shingles(t, lambda n: [min(n, 5)] if n else [])
    for i, t in docs:
        have[i] |= shingles(t, lambda n: range(1, 6))
    return sorted((i, d, len(s), len(s & h)) for i, s in want.items() for d, h in have.items() if s and 100 * len(s & h) >= 80 * len(s) and s & h)


def test_items_of_several_rows_and_widths(spark):
    rng = random.Random(8)
    items = [(1, "one two three four five six seven"), (1, "alpha beta"), (2, "gamma"), (2, "delta epsilon zeta eta"), (3, "alpha beta"), (4, None)]
    items += [(10 + k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))) for k in range(40)]
    docs = [(1, "x one two three four five six seven y alpha beta z"), (2, "one two three four five six seven"), (3, "gamma"), (3, "delta epsilon zeta eta"), (4, "alpha beta gamma")]
    docs += [(100 + k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 400)))) for k in range(30)]
    docs.append((500, "w " * 60_000 + "alpha beta"))  # a very long text
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = contained(docs, items)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want and any(w[0] == 1 for w in want)


def test_a_stock_phrase_makes_no_candidates(spark):
    stock = "please read the following text and answer the question below"
    items = spark.createDataFrame([(i, f"{stock} " + " ".join(f"q{i}w{j}" for j in range(30))) for i in range(60)], "item_id long, text string")
    sketch = decontamination.sketches(decontamination.item_shingles(items, "item_id", "text"))
    assert sketch.groupBy("h").count().agg(F.max("count")).first()[0] == 1


# 4, texts without letters ----------------------------------------------

def test_marks_are_no_letters(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, "́̂", None), (9002, "́ 12 ̂ 34", None), (9003, "12 34", None)], docs.schema)
    got = {r["doc_id"]: r for r in language_id.identify(docs.unionByName(odd)).where("doc_id > 9000").collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in got.values()) and len(got) == 3
