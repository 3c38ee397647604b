"""Row-wise training-data operators against plain versions, and the defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opsward.llm import bpe, langid, mixing, rans, repetition, secrets, toxicity, warc
from opsward.llm.common import in_fold
from opsward.session import scratch_path

SF = "/root/testdata/sf0.01"

ODD = [(1, None, "en", None), (2, "", None, "b"), (3, " \n\t ", "en", "b"), (None, "a b c d e f", "en", "a"), (4, "one", "de", "a"),
       (5, "x " * 30_000, "en", "a"), (5, "x " * 30_000, "en", "a"), (6, "12 34 !!", None, None),
       (7, "Grüße,  日本語 <|endoftext|> it's\x1c done. password=abcdefghijkl12", "de", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, repeated rows, a very long text, and columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, "z") for r in ODD], "doc_id long, text string, lang string, source string, n_words int, score string")


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- op 1

def plain_repetition(text, k):
    w = words(text)
    at = {}
    for i in range(len(w) - k + 1):
        at.setdefault(tuple(w[i: i + k]), []).append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)})


def plain_longest(text):
    w = words(text)
    n = 0
    while any(len(v) > 1 for v in _groups(w, n + 1).values()):
        n += 1
    return n


def _groups(w, k):
    at = {}
    for i in range(len(w) - k + 1):
        at.setdefault(tuple(w[i: i + k]), []).append(i)
    return at


def plain_maximal(text, least):
    """Substrings that repeat and can be extended on neither side at all their places."""
    w, n = words(text), 0
    for k in range(least, len(w)):
        for v in _groups(w, k).values():
            if len(v) > 1 and len({w[i - 1] if i else ("start", i) for i in v}) > 1 and len({w[i + k] if i + k < len(w) else ("end", i) for i in v}) > 1:
                n += 1
    return n


def test_repetition_matches_plain_counts():
    rnd = random.Random(4)
    for _ in range(20):
        texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 5, 30, 90]))) for _ in range(5)] + ["x " * 40, None, "a b c " * 9 + "z " + "a b c " * 3]
        got = repetition.measure(texts, 4)
        for i, t in enumerate(texts):
            assert got["n_repeat_words"][i] == plain_repetition(t, 3)
            assert got["covered_words"][i] == plain_repetition(t, 4)
            assert got["longest_repeat"][i] == plain_longest(t)
            assert got["n_maximal"][i] == plain_maximal(t, 4)


def test_repeated_passages_gives_spans():
    body = [f"w{i}" for i in range(20)]
    assert repetition.repeated_passages(" ".join(body + ["x"] + body), 10) == [(0, 20), (21, 41)]
    assert repetition.repeated_passages(None) == []


def test_repetition_edge_rows(odd, empty):
    got = sorted(repetition.repetition(odd).collect(), key=str)
    assert len(got) == len(ODD) and repetition.repetition(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[5].n_repeat_words == 30_000 and by[5].n_dup_lines == 0 and by[5].longest_repeat == 29_999


# --- op 2

def test_rans_blocks_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    tokens = np.minimum(rng.geometric(0.001, 400_000), 40_000).astype(np.int64)
    ids, n = np.unique(tokens, return_counts=True)
    coder = rans.Coder(*rans.frequencies(dict(zip(ids.tolist(), n.tolist()))))
    for size in (0, 1, 15, 16, 17, 16 * rans.LANES - 1, 16 * rans.LANES, 150_000, 400_000):
        assert np.array_equal(coder.decode(coder.encode(tokens[:size])), tokens[:size])
    block = bytearray(coder.encode(tokens[:5000]))
    block[200] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(block))


def test_crc_pieces_combine():
    a, b, c = b"hello", b"", b"wide world" * 99
    assert rans.shift_crc(zlib.crc32(a), len(b + c)) ^ rans.shift_crc(zlib.crc32(b), len(c)) ^ zlib.crc32(c) == zlib.crc32(a + b + c)


@pytest.mark.parametrize("block", [7, rans.BLOCK_TOKENS])
def test_rans_files_match_the_library(spark, docs, block):
    part = docs.where("doc_id % 10 = 3") if block < 100 else docs
    out = scratch_path(spark, "rans-test")
    rans.write_tokens(part, out, block_tokens=block)
    got = sorted(rans.read_tokens(spark, out).collect())
    tk, start = Tokenizer.from_file(public_tokenizers.path(rans.VOCABULARY)), 0
    for r, d in zip(got, sorted(part.select("doc_id", "text").collect()), strict=True):
        ids = tk.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rans_edge_rows(spark, odd, empty):
    out = scratch_path(spark, "rans-test")
    rans.write_tokens(odd, out, block_tokens=1000)
    got = sorted(rans.read_tokens(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[1].n_tokens == 1
    out = scratch_path(spark, "rans-test")
    rans.write_tokens(empty, out)
    assert rans.read_tokens(spark, out).count() == 0


def test_word_encoder_equals_library_on_every_character():
    enc = rans.WordEncoder(public_tokenizers.path(rans.VOCABULARY))
    texts = [f"a{chr(i)} {chr(i)}, A{chr(i)}. {chr(i)}" for i in range(0, 0x30000, 7) if not 0xD800 <= i <= 0xDFFF]
    texts += ["<|endoftext|>a.b,", "x<|startoftext|>y Ab,", "a..., a'LL, 'S. it's, ", None, "", "\x1c\x1d \x85a\xa0b. 1.5, 2, x."]
    flat, lens = enc.encode(texts)
    ends = np.cumsum(lens)
    want = [e.ids for e in enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(ends - lens, ends)] == want


# --- op 3

def test_bpe_equals_library():
    path = public_tokenizers.path(bpe.VOCABULARY)
    tk, codec = Tokenizer.from_file(path), bpe.Codec(path)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "b", " ", "'", "\n", "é", "日", "🙂", "1", "<|endoftext|>", "'ll", "aaaa", ".", "  "]) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 5000, "=" * 20_000, "日本語" * 3000, None, "", "<|endoftext|>"] + [f"a{chr(i)}b {chr(i)} {chr(i)}1" for i in range(0, 0x30000, 11) if not 0xD800 <= i <= 0xDFFF]
    ids, lens = codec.encode(texts)
    ends = np.cumsum(lens)
    want = [e.ids for e in tk.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends - lens, ends)] == want
    assert codec.decode(ids, lens) == [tk.decode(w, skip_special_tokens=False).encode() for w in want]


def test_bpe_query_and_tables(spark, odd, empty):
    assert bpe.round_trip(empty).count() == 0
    got = bpe.round_trip(odd).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ODD)
    back = bpe.decode_documents(bpe.encode_documents(odd))
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.selectExpr("doc_id", "coalesce(text, '') as text").collect()))


# --- op 4

PAGES = [(1, "http://a/\r\nx", "p" * 500), (2, None, "p" * 500), (None, "u", "p" * 500), (3, "u", "q" * 99), (4, "u", "q" * 99), (5, "u", None), (6, "u" * 3000, ""),
         (7, "u", "é" * 40_000), (1, "again", "p" * 500), (8, "u", "é" * 40_000), (9, "u", "r" * 100), (10, "u", "r" * 100)]


def plain_warc():
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, g in PAGES if j is not None and (g or "").encode() == raw]
        again = len(raw) >= 100 and same and min(same) != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [64, warc.CHUNK_BYTES])
def test_warc_round_trip(spark, chunk):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    table = warc.write_records(pages, chunk)
    got = warc.read_records(table).collect()
    assert all(r.intact for r in got) and table.selectExpr("max(octet_length(data))").first()[0] <= chunk
    assert sorted((tuple(r[:5]) for r in got), key=str) == plain_warc()
    assert warc.read_records(warc.write_records(pages.limit(0))).count() == 0


def test_warc_rows_join_to_plain_records_and_damage_shows(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    table = warc.write_records(pages, 100)
    parts = {}
    for r in table.orderBy("record_key", "chunk_no").collect():
        parts[r.record_key] = parts.get(r.record_key, b"") + bytes(r.data)
    for raw in parts.values():
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == n + 4 and rest.endswith(b"\r\n\r\n")
    bad = table.withColumn("data", F.when((F.col("chunk_no") == 9), F.reverse("data")).otherwise(F.col("data")))
    damaged = {r.page_id for r in warc.read_records(bad.withColumn("data", F.when(F.col("chunk_no") == 20, F.lit(b"?")).otherwise(F.col("data")))).where("not intact").collect()}
    assert damaged == {7}


# --- op 5

def test_targets_and_quotas():
    assert [float(x) for x in mixing.targets([100, 100, 100], [3, 1, 2])] == [200.0, 83.33333333333333, 166.66666666666666]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]
    q = mixing.split_quotas([50, 3, 0, 700], 13)
    assert q.sum(0).tolist() == [50, 3, 0, 700] and q.min() >= 0 and np.ptp(q.sum(1)) <= 8
    assert np.array_equal(q, mixing.split_quotas([50, 3, 0, 700], 13))


def test_mix_near_targets_whole_blocks_and_reruns(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 2)  # radix descent goes deep
    mix = mixing.Mix(docs)
    got = mix.per_document().collect()
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
    again = mixing.Mix(docs.repartition(5)).per_document().collect()
    assert sorted(got) == sorted(again)
    rows = mix.rows(docs, tasks_per_shard=2)
    copies = {r.doc_id: r.copies for r in got if r.copies}
    counted = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counted == copies and rows.where("shard < 0 or shard >= 64").count() == 0


def test_mix_per_document_counts_the_draw(docs):
    mix = mixing.Mix(docs)
    mix.placements = mix.placements.where("block % 3 > 0").union(mix.placements.where("block % 3 = 1"))  # copies lost and doubled
    placed = {r.doc_id: r["count"] for r in mix.rows(docs, tasks_per_shard=2).groupBy("doc_id").count().collect()}
    got = mix.per_document().collect()
    assert len(got) == docs.count()
    assert all((r.copies, r.taken) == (placed.get(r.doc_id, 0), r.size * placed.get(r.doc_id, 0)) for r in got)


def test_mix_edge_rows(odd, empty):
    got = mixing.Mix(odd).per_document().collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.Mix(empty).per_document().count() == 0
    assert mixing.Mix(empty).rows(empty).count() == 0


# --- op 6

def test_grammar_scales_matched_clauses():
    m = toxicity.Matcher({"fool": 2.0})
    g = toxicity.grammar(1.5, 0.25, 0.5)
    weight = lambda t: [toxicity.weigh(c, g) for c in m.clauses([t])[0]]
    assert weight("What a fool. Fine.") == [2.0]
    assert weight("You fool") == [3.0]
    assert weight("not a fool") == [0.5]
    assert weight("He said what a fool") == [1.5]
    assert weight("I kill time") == [0.0] and weight("I kill you") == [4.0]
    assert weight("Not so. A fool") == [2.0] and weight("") == []


def plain_toxicity(text, lexicon, target, negated, reported):
    """What the five transducers emit for each clause of a whole text, said word by word: no automaton, no composition."""
    words = []
    for token in (text or "").lower().replace("\n", " . ").split():
        kind, weight = "other", 0.0
        for w in (w.replace("’", "'") for w in toxicity.WORD.findall(token)):
            entries = [w] + [w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n]
            hit = max([lexicon[e] for e in entries if e in lexicon], default=0.0)
            roles = [k for k, names in (("threat", toxicity.THREAT), ("say", toxicity.REPORT), ("not", toxicity.NEGATION), ("target", toxicity.TARGET)) if w in names]
            if hit > weight:
                kind, weight = "insult", hit
            elif kind == "other" and roles:
                kind, weight = roles[0], 4.0 if roles[0] == "threat" else 0.0
        if kind == "other" and token[0] in "\"«“„":
            kind = "quote"
        words.append((kind, weight, token[-1] in ".!?;:"))
    clauses, now = [], []
    for kind, weight, last in words:
        now.append((kind, weight))
        if last:
            clauses, now = clauses + [now], []
    out = []
    for clause in clauses + ([now] if now else []):
        if not any(k in ("insult", "threat") for k, _ in clause):
            continue
        total, armed, open_, carried = 0.0, None, False, 0.0
        for i, (kind, weight) in enumerate(clause):
            before = [k for k, _ in clause[:i]]
            scale = (target if kind != "target" and "target" in before[-4:] else 1.0) * (negated if "not" in before[-3:] else 1.0) * (reported if open_ else 1.0)
            if kind == "threat":
                armed, carried = i, weight
            elif kind == "target":
                if armed is not None and i - armed <= 4:
                    total += scale * carried
                    armed = None
            elif kind == "insult":
                total += scale * weight
            open_ = kind == "say" or (not open_ if kind == "quote" else open_)
        out.append(total)
    return out


def test_toxicity_equals_a_plain_interpreter(docs):
    rnd = random.Random(6)
    lexicon = {"fool": 2.0, "idio*": 3.5, "stupid": 1.25}
    pool = (["fool", "idiots", "IDIOT!", "stupid,", "fool.", '"fool', 'idiot"', "you", "your", "du", "not", "isn't", "isn’t", "said", "says:", "kill", "Murder", "beat;",
             '"', "«", "«ja", "“you", "„", "...", "!", "kill-you", "table", "and\n", "x", "\n", "é", "12"])
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(40))) for _ in range(1500)] + [None, "", "\n", "fool " * 3000]
    texts += [r.text for r in docs.limit(100).collect()]
    m = toxicity.Matcher(lexicon)
    for scales in ((1.5, 0.25, 0.5), (1.0, 1.0, 1.0), (1.7, 0.3, 0.75)):
        g = toxicity.grammar(*scales)
        got = [[toxicity.weigh(c, g) for c in cs] for cs in m.clauses(texts)]
        want = [plain_toxicity(t, lexicon, *scales) for t in texts]
        for t, a, b in zip(texts, got, want):
            assert a == pytest.approx(b), t


def test_toxicity_held_out_and_edge_rows(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where(~in_fold(labels.doc_id)).collect()
    clean = [r for r in got if r.toxic == 0]
    english = [r for r in got if r.toxic == 1 and r.lang == "en"]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean) and sum(r.predicted for r in english) >= 0.9 * len(english)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(odd, none).where("predicted = 0").count() == len(ODD)


# --- op 7

def test_langid_held_out_accuracy(docs):
    model = langid.fit(docs)
    got = langid.predict(docs, model, ["doc_id", "lang"])
    got = got.where(~in_fold(got.doc_id)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert 0 < sum(len(w) - np.count_nonzero(w) for w in model.weights.values())  # the penalties leave zeros


def test_langid_scores_like_the_plain_sum():
    model = langid.train([("en", "the cat and the dog"), ("de", "der Hund und die Katze")] * 12)
    texts = ["the dog", "die Katze", "a1b ñ́x 日本 dog", "x"]
    for p, t in zip(langid.Scorer(model).probabilities(texts), texts):
        grams = [g for w in langid._words(t) for g in langid._grams_of(w)]
        z = sum((model.weights[g] for g in grams if g in model.weights), np.zeros(2)) / max(1, len(grams)) + model.bias
        assert np.allclose(p, langid._softmax(z / model.temperature))


def test_langid_edge_rows(docs, odd, empty):
    model = langid.fit(docs)
    got = langid.predict(odd, model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 6}
    assert langid.predict(empty, model, ["doc_id"]).count() == 0
    assert langid.predict(odd, langid.fit(empty), ["doc_id"]).where("lang_pred = 'und' and score = 0").count() == len(ODD)


# --- op 10

def test_base_spans_drop_failing_matches():
    t = 'secret=token:abcdefghijklmnop Password = "aBcDeF123456" AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef 0123456789abcde paſsword=abcdefghijkl'
    assert [(t[a:b], k) for a, k, b in secrets.base_spans(t)] == [('Password = "aBcDeF123456', 0), ("AKIAABCDEFGHIJKLMN", 1), ("0123456789abcdef", 2)]


def test_viterbi_and_pruning_equal_plain_decoding(docs):
    texts = [r.text for r in docs.select("text").limit(150).collect()] + ["", None, "token = abcdefgh12345678"]
    field = secrets.fit(secrets.fit_sample(docs), rounds=15)
    field.t[1, 2] += 3.0  # make long spans likely, so transitions matter
    got = secrets.Tagger(field).tags(texts)
    for t, tagged in zip(texts, got):
        feats = [secrets.features(x) for x in secrets.TOKEN.findall(t or "")]
        if not feats:
            assert not tagged
            continue
        em = np.tile(field.bias + field.file[secrets._file_bucket(t, len(feats), sum(f[0] != "alpha" for f in feats))], (len(feats), 1))
        rows = [field.rows(f) for f in feats]
        for i in range(len(feats)):
            for k, o in enumerate(secrets.OFFSETS):
                if 0 <= i + o < len(feats):
                    em[i] += rows[i + o][k]
        score, back = em[0] + [0, 0, -1e9], []
        for e in em[1:]:
            c = score[:, None] + field.t
            back.append(c.argmax(0))
            score = c.max(0) + e
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert [(i, s) for i, s in enumerate(reversed(path)) if s] == tagged


def test_field_finds_secrets_and_rows(docs, odd, empty):
    field = secrets.fit_field(docs)
    held = [r.text for r in docs.select("text").where("doc_id % 3 = 0").collect()]
    hits = total = 0
    for t, tagged in zip(held, secrets.Tagger(field).tags(held)):
        at = [m.span() for m in secrets.TOKEN.finditer(t)]
        marked = [at[i] for i, _ in tagged]
        for a, b in secrets._secret_parts(t):
            total += 1
            hits += any(x < b and a < y for x, y in marked)
    assert total and hits >= 0.9 * total
    got = {r.doc_id: r for r in secrets.scan(odd, field).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == "" and got[7].n_assign == 1
    assert secrets.scan(empty, field).count() == 0 and secrets.scan(odd, secrets.fit([])).count() == len(ODD)
    clean = {r.doc_id: r.text for r in secrets.redact(odd, field).collect()}
    assert clean[1] is None and clean[7].endswith("[secret]") and clean[4] == "one"


# --- hot groups

def test_hot_source_and_copies(spark):
    """A third of the rows is one text of one source."""
    rows = [(i, "same text here to count", "hot") for i in range(400)] + [(1000 + i, f"word{i} " * (1 + i % 7), f"s{i % 5}") for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.Mix(d).per_document().collect()
    assert len(got) == 1200
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 14 for (_, t), v in by.items())
    assert repetition.repetition(d).count() == 1200


def test_fits_depend_on_rows_not_on_their_order(spark, docs):
    """Repeated rows are one row of a sample, whatever task they come from."""
    some = docs.where("doc_id < 300")
    again = some.union(some).union(some.where("doc_id < 100")).repartition(7)
    assert langid.fit_sample(some, per_lang=2000) == langid.fit_sample(again, per_lang=2000)
    assert secrets.fit_sample(some, 2000, 2000) == secrets.fit_sample(again, 2000, 2000)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one, other = toxicity.fit(some, labels, 5000, 5000), toxicity.fit(again, labels, 5000, 5000)
    assert one.lexicon == other.lexicon and np.array_equal(one.beta, other.beta)


def test_language_with_long_texts_only_is_learnt(spark, docs):
    long_ = spark.createDataFrame([(7000 + i, "zwyx qrst vubz kplm " * 3000 + f"end {i}", "zz", "s", 1) for i in range(40)], docs.schema)
    sample = langid.fit_sample(docs.union(long_))
    assert {lang for lang, _ in sample} > {"zz"} and max(len(t) for _, t in sample) <= langid.FIT_CHARS
    found = secrets.fit_sample(spark.createDataFrame([(1, "a b c " * 9000 + "token = abcdefgh12345678 " + "d e f " * 9000)], "doc_id long, text string"))
    assert len(found) == 1 and len(found[0]) <= secrets.FIT_CHARS and "abcdefgh12345678" in found[0]


def test_warc_page_without_id_revisits_the_smallest_id(spark):
    body, other = "<p>" + "x" * 200, "<p>" + "y" * 200
    rows = [(1, body), (2, body), (None, body), (None, body), (3, other), (None, other), (None, "<p>" + "z" * 200), (None, "<p>" + "z" * 200)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id long, url string, html string")
    got = warc.read_records(warc.write_records(pages)).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "response", None), (2, "revisit", 1), (3, "response", None), (None, "revisit", 1), (None, "revisit", 1), (None, "revisit", 3)]
                                               + [(None, "response", None)] * 2))


def test_longest_interval_at_each_place():
    rng = random.Random(2)
    for _ in range(200):
        code = np.array([rng.randrange(3) for _ in range(rng.randrange(2, 40))])
        doc = np.zeros(len(code), np.int64)
        suffixes, lcp = repetition.suffix_lcp(code, doc)
        found = repetition.maximal_repeats(suffixes, lcp, code, doc, 2)
        want = np.zeros(len(suffixes), np.int64)
        for h, lb, rb in found:
            want[lb: rb + 1] = np.maximum(want[lb: rb + 1], h)
        assert np.array_equal(repetition.longest_at(found, len(suffixes)), want)
        best = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
        assert np.array_equal(repetition.spans(suffixes, found, len(code)), repetition.covered(suffixes[best >= 2], best[best >= 2], len(code)))
