"""Operator 11 against whole-text encodings and all overlaps; fragments compose in any order."""
from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coverwise.llm import alignment
from coverwise.llm.catalog import op11_token_alignment, tokenizer_file

from .conftest import SF001

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["two  spaces   here ", " leading", "tab\there\n\nline \n x", "▁ mark", "a▁b c", "<s> text </s> <|endoftext|> <unk>", "中文没有空格" * 40,
       "café été naïve", "é x", "\U0001f600 smile \U0001f600‍\U0001f525", "\u0000 nul", " nbsp  x", "z", " ", "  ", "\n", "1234567 8 90", "don't we'll"]


def brute(texts):
    """Rows of the query for whole texts, token by token."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    pair = alignment.PairTokenizer(A, B)
    rows, held = [], Counter()
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        links = Counter()
        j0 = 0
        for s, e, i in spans[0]:
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links[i, spans[1][j][2]] += 1
                j += 1
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[], []] for _ in common]
        for side, x in enumerate(spans):
            g = 0
            for _, e, i in x:
                while common[g] < e:
                    g += 1
                groups[g][side].append(str(i))
        rows.append((len(a), len(b), len(common), links, ";".join("|".join(",".join(y) for y in x) for x in groups)))
        held.update(links.keys())
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    return [(na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in links.items()),
             hashlib.sha256(g.encode()).hexdigest() if na else "") for na, nb, ng, links, g in rows]


def result(spark, docs, chunk):
    aligned = alignment.alignments(docs, A, B, chunk=chunk)
    told = aligned.withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).join(alignment.link_support(aligned), "rid", "left").fillna(0, ["n_best", "count_sum"])
    return sorted((tuple(r) for r in told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()), key=repr)


def test_whole_and_cut_texts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").limit(60).collect()] + ODD + ODD[:4] + [None, ""]
    texts.append(" ".join(ODD * 60))  # longer than a range of the default size
    docs = spark.createDataFrame([(i if i != 3 else None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid int, pairs string").repartition(4)
    want = sorted(((i if i != 3 else None, *r) for i, r in enumerate(brute(texts))), key=repr)
    for chunk in (alignment.CHUNK, 48):
        got = result(spark, docs, chunk)
        assert got == want
    assert any(r[1] for r in want) and any(not r[1] for r in want)
    assert result(spark, docs.limit(0), 48) == []


def test_composition_is_associative():
    pair = alignment.PairTokenizer(A, B)
    rng = random.Random(2)
    text = (" " + " ".join(t for t in ODD if "▁" not in t)).encode()
    ((a, _), (b, _)), ok = pair.encode([text])
    assert ok.all()
    t = alignment.Tokens(a, np.cumsum(pair.a_length[a]), b, np.cumsum(pair.b_length[b]))
    want = alignment.Fragment.of(t, pair.signs).whole(pair.signs).summed()
    for _ in range(40):
        edges = [0, *sorted(rng.sample(range(1, len(text)), rng.randint(1, 90))), len(text)]
        parts = [alignment.Fragment.of(t.between(lo, hi), pair.signs) for lo, hi in zip(edges, edges[1:])]
        while len(parts) > 1:  # neighbours in any order
            k = rng.randrange(len(parts) - 1)
            parts[k:k + 2] = [parts[k].then(parts[k + 1], pair.signs)]
        got = parts[0].whole(pair.signs).summed()
        assert ";".join(got.groups) == ";".join(want.groups) and got.n_groups == want.n_groups
        assert (got.pairs == want.pairs).all() and (got.links == want.links).all()


def test_ranges_cover_each_byte_once():
    rng = random.Random(5)
    for text in (b" " + b"x" * 500, b" word" * 200, b" " + b"".join(rng.choice([b"a", b" ", b"bc ", b"d" * 40]) for _ in range(400))):
        ranges = alignment.cut_ranges(text, 64)
        assert [lo for lo, *_ in ranges] == [0, *[hi for _, hi, *_ in ranges[:-1]]] and ranges[-1][1] == len(text)
        assert all(at <= lo and at + len(part) >= hi and text[at:at + len(part)] == part for lo, hi, at, part in ranges)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    ids = sorted(texts)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = sorted(tuple(r) for r in op11_token_alignment(spark, SF001).select(*cols).collect())
    assert got == [(i, *r) for i, r in zip(ids, brute([texts[i] for i in ids]))]
