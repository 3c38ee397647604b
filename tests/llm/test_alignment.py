"""Cross-tokenizer alignment against whole-text encoding with both libraries, and its defined cases."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from opsward.llm import alignment
from opsward.llm.bpe import byte_chars

ODD = [None, "", " ", "  ", "a", " a", "a ", "one  two   three\n\nfour \t five", "Grüße,  日本語 it's\x1c done 𝒳 😀!", "x▁y", "▁", "fine ▁ not",
       "<|endoftext|> and <s> </s> <unk> <0x41>", "it's we'll 12345 3.14", "é" * 500, "word " * 20_000, "aaaaaaaaaaaaaaaa" * 500, "\x00 \x7f￿",
       "don 't  's", "a b  c　 d", "\r\n \r\n x", "١٢٣ ½ Ⅷ ²", "á é", "ﬁ ﬂ Ａ", "​ x ﻿ y"]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
        chars = byte_chars()
        self.bytes_a = {i: bytes(chars[c] for c in t) for t, i in spec["model"]["vocab"].items()}

    def bytes_b(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[1:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def groups(self, text):
        """Groups of (A ids, B ids, links as id pairs)."""
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a, raw_b = [self.bytes_a[i] for i in a], [self.bytes_b(i) for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return []
        out, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(a):
            ga, gb, links = [], [], []
            while True:
                if not ga or at_a < at_b:
                    spans = (at_a, at_a + len(raw_a[i]))
                    ga.append((a[i], *spans))
                    at_a, i = spans[1], i + 1
                else:
                    spans = (at_b, at_b + len(raw_b[j]))
                    gb.append((b[j], *spans))
                    at_b, j = spans[1], j + 1
                if at_a == at_b:
                    break
            low = 0
            for x, s, e in ga:
                while low < len(gb) and gb[low][2] <= s:
                    low += 1
                k = low
                while k < len(gb) and gb[k][1] < e:
                    links.append((x, gb[k][0]))
                    k += 1
            out.append(([x[0] for x in ga], [x[0] for x in gb], links))
        return out


def expected(data):
    p = Plain()
    cut = [(d, p.groups(t)) for d, t in data]
    n = Counter(x for _, g in cut for *_, links in g for x in links)
    best = Counter()
    for (_, b), c in n.items():
        best[b] = max(best[b], c)
    rows = []
    for d, g in cut:
        links = [x for *_, ls in g for x in ls]
        rows.append((d, sum(len(x[0]) for x in g), sum(len(x[1]) for x in g), len(g), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links),
                     ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in g)))
    return rows, n


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    alphabet = ["a", "b", "the", " ", " ", "  ", "\n", "é", "日", "▁", "1", "99", ".", ",", "'s", "\t", "Ing", "ization", " ", "-", "(", "😀", "tion"]
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, "".join(rng.choices(alphabet, k=rng.randrange(30)))) for i in range(1500)]
    rows += [(5000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(None, "no id here"), (7, "twice"), (7, "twice"), (7, "thrice")]


@pytest.mark.parametrize("block", [300, alignment.BLOCK_BYTES])
def test_equals_whole_text_encoding(spark, data, block):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in data], "doc_id int, text string, block int, pairs string, n_a int").repartition(3)
    got, pairs = alignment.align(docs, block_bytes=block)
    want, n = expected(data)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {(r.pair >> 32, r.pair & alignment.LOW): r.n for r in pairs.collect()} == dict(n)


def test_digest_and_empty_table(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got, pairs = alignment.align(docs.limit(0), digest=True)
    assert got.count() == 0 and pairs.count() == 0
    some = [r for r in data if r[0] in (0, 1, 4, 7, 8)]
    got = alignment.align(spark.createDataFrame(some, "doc_id long, text string"), digest=True)[0]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected(some)[0]]
    assert got.columns[-1] == "groups_sha256"
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    nothing = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))[0]
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_cache_resets_keep_results(monkeypatch):
    al = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    import pyarrow as pa
    texts = pa.array(["the quick brown fox", "lazy dogs  and\ncats", "x▁y", None])
    once = al.block(texts)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 0)
    again = al.block(texts)
    assert len(al.code) < 12
    for k in ("n_a", "n_b", "n_groups", "n_links", "pairs", "times", "vector", "groups"):
        assert list(once[k]) == list(again[k])


def test_identity_map_is_by_bytes():
    al = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    p = Plain()
    hits = [i for i in range(len(al.identity)) if al.identity[i] >= 0]
    assert len(hits) > 5000
    assert all(p.bytes_a[i] == p.bytes_b(int(al.identity[i])) for i in hits)
