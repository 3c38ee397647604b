"""Near-duplicate operators and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from opsward.llm import langid, mixing, ngram_join, pq_neardup, queries, secrets

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(sets):
    """Smallest id of each component, by all pairs."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def near_copies(seed, n):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:  # a hot group of near copies, some beyond the threshold
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9999)}"
        elif kind == 1:  # a shared passage with little else
            w = passage + [f"y{rnd.randint(0, 9999)}" for _ in range(rnd.choice([2, 5, 9, 14, 25]))]
        elif kind == 2:  # chains: windows of one long text
            k = rnd.randrange(30)
            w = [f"c{j}" for j in range(k * 4, k * 4 + 60)]
        else:
            w = [f"z{rnd.randint(0, 40)}" for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 30]))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 0), (3, 0)])
def test_join_equals_all_pairs(spark, monkeypatch, seed, limit):
    if limit is not None:  # star rounds to the end, and small samples and blocks
        monkeypatch.setattr(ngram_join, "PAIRS_PER_DOC", limit)
        monkeypatch.setattr(ngram_join, "LARGE_GROUP", 2 + 10 * (seed - 2))  # also rows instead of pairs
        monkeypatch.setattr(ngram_join, "SAMPLE_SHARE", 2)
        monkeypatch.setattr(ngram_join, "HELD_GROUP", [20_000, 20][seed - 2])
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 500)
        monkeypatch.setattr(ngram_join, "WIDE_BLOCK", 7)
        monkeypatch.setattr(ngram_join, "MAX_ROUNDS", 2)
    rows = near_copies(seed, 400)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sets = {i: shingles(t) for i, t in rows}
    want = brute(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_join_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (None, "a b"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "x " * 40_000), (8, "X " * 39_999)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, token int")
    got = ngram_join.jaccard_components(d).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (None, None), (6, 6), (7, 7), (8, 7)}
    assert ngram_join.jaccard_components(d.limit(0)).count() == 0


def test_one_id_on_two_texts(spark):
    a, b, near_b, c = ("a%d " * 40 % tuple(range(40)), "b%d " * 60 % tuple(range(60)), "b%d " * 58 % tuple(range(58)), "c%d " * 30 % tuple(range(30)))
    rows = [(2, a), (6, a), (6, b), (6, b), (7, near_b), (8, c), (8, c + "more"), (9, c), (9, "else " * 9), (3, ""), (3, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(2, 2), (6, 2), (7, 2), (8, 8), (9, 8), (3, 3)}
    kept = corpus_pipeline.ngram_jaccard(spark, docs, SF)
    assert kept.columns == docs.columns
    kept = sorted((r.doc_id, r.text.split()[0] if r.text else "") for r in kept.collect())
    assert kept == [(2, "a0"), (3, ""), (3, "alone"), (6, "b0"), (8, "c0"), (9, "else")]


def cosine_truth(vectors, threshold=0.95):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    return s


def test_pq_recall_counts_and_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 48))
    v = np.concatenate([rng.normal(size=(600, 48)), np.repeat(centres, 6, 0) + rng.normal(size=(900, 48)) * rng.choice([0.05, 0.15, 0.22], (900, 1)),
                        np.repeat(centres[:1], 300, 0), centres[1] + rng.normal(size=(300, 48)) * 0.05])
    truth = cosine_truth(v)
    got = {r.vec_id: r for r in pq_neardup.near_duplicates(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, n int").repartition(4)).collect()}
    links = np.array([got[i].n_links for i in range(len(v))])
    assert links.sum() >= 0.9 * truth.sum() and (links <= truth.sum(1)).all()
    label = np.arange(len(v))
    while True:
        new = np.array([min(label[i], label[truth[i]].min(initial=label[i])) for i in range(len(v))])
        if (new == label).all():
            break
        label = new
    same = np.mean([got[i].component_id == label[i] for i in range(len(v))])
    assert same >= 0.95 and all(got[i].component_id >= label[i] for i in range(len(v)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("directions", [1, 2, 4])
def test_pq_large_group_along_few_directions(spark, directions):
    rng = np.random.default_rng(directions)
    basis = np.linalg.qr(rng.normal(size=(64, directions + 1)))[0].T
    around = rng.uniform(-1, 1, (1200, directions)) * [2.5, 1.0, 0.6, 0.6][directions - 1]
    v = np.concatenate([basis[0] + around @ basis[1:], rng.normal(size=(300, 64))])
    truth = cosine_truth(v).sum(1)
    got = pq_neardup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4))
    assert np.array_equal([r.n_links for r in got.orderBy("vec_id").collect()], truth)


def test_pq_edge_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]),
            (9, [1e300, 2e300]), (10, [float("inf"), 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pq_neardup.near_duplicates(d).collect()
    assert len(got) == len(rows)
    assert sorted({(r.vec_id, r.n_links, r.component_id, r.kept) for r in got}, key=str) == sorted(
        {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 3, 6, True), (7, 3, 6, False), (8, 0, 8, True),
         (None, 0, None, False), (9, 3, 6, False), (10, 0, 10, True)}, key=str)
    assert pq_neardup.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLE[name])
    assert sorted(map(str, (tuple(r) for r in got.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "123 456", "en", "src1", 7), (90_002, None, None, None, None), (90_003, "", "en", "src1", 0)], docs.schema)
    docs = docs.union(extra).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard", "secret_scan", "source_mix", "bpe"]
    a = stages["language_id"](spark, docs, SF).cache()
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.where("doc_id < 90000").collect()}
    b = stages["ngram_jaccard"](spark, a, SF).cache()
    want = brute({r.doc_id: shingles(r.text) for r in a.collect()})
    assert sorted(r.doc_id for r in b.collect()) == sorted({want[i] for i in want}) and b.columns == docs.columns
    c = stages["secret_scan"](spark, b, SF).cache()
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (b, c))
    assert set(before) == set(after)
    for i, t in before.items():
        assert (after[i] == t) == (not secrets.base_spans(t)) and not secrets.base_spans(after[i])
    d = stages["source_mix"](spark, c, SF).cache()
    taken = {r.doc_id: r.copies for r in mixing.Mix(c).per_document().collect() if r.copies}
    assert {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()} == taken and d.columns == docs.columns
    e = stages["bpe"](spark, d, SF).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(e) == sum(taken.values())
    for r in random.Random(0).sample(e, 60):
        ids = tk.encode(after[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(after[r.doc_id].encode()).hexdigest()


def test_pipeline_stages_on_empty_and_odd_tables(spark):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, score int, shard string, id int, doc string, `group` int, "
              "__key string, __size int, __pass int, __block int, __order string, __lang int, __known string, c0 string, rows int, copy string, class int")
    odd = spark.createDataFrame([(*r, 5, "d", 6, "k", 7, 8, 9, "o", 10, "n", "c", 11, "y", 12) for r in ((1, None, None, None, None, 1, "x"), (2, "", "en", "a", 0, 1, "x"), (None, "words only here", "en", None, 3, 1, "x"),
                                 (3, "same words again and again", "en", "a", 9, 1, "x"), (3, "same words again and again", "en", "a", 9, 1, "x"),
                                 (4, "token = abcdefgh12345678 " * 3000, "de", "b", 9, 1, "x"))], schema)
    for docs in (odd, odd.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.count() >= 0
            if i < 4:
                assert out.columns == docs.columns
                assert out.where("id <> 5 or doc <> 'd' or `group` <> 6 or __key <> 'k' or __size <> 7 or __lang <> 10 or c0 <> 'c' or class <> 12").isEmpty()
    kept = corpus_pipeline.ngram_jaccard(spark, odd, SF).collect()
    assert len(kept) == 5 and langid.fit(odd.limit(0)).classes == []


def test_language_stage_drops_languages_that_were_not_learnt(spark):
    """With two learnt languages no score is below a half; the share of known n-grams tells a third one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'de')")
    other = ["Это совсем другой язык, которого нет в таблице и который никто не учил", "これは学習されていない言語の文章です。", "αυτό είναι ένα κείμενο σε άλλη γλώσσα"]
    extra = spark.createDataFrame([(80_000 + i, t, None, "src1", 7) for i, t in enumerate(other)] + [(80_100, "12 34", None, "src1", 5)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.union(extra), SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect())


def test_one_name_for_two_sets_starts_again(spark, monkeypatch):
    """Names of three bits: the job goes on to another key until no name stands for two sets."""
    real = ngram_join.digest_of
    monkeypatch.setattr(ngram_join, "digest_of", lambda s, key=0: (real(s, key)[0] % 8 if key < 2 else real(s, key)[0], real(s, key)[1]))
    docs = spark.createDataFrame([(i, f"a{i // 2} b{i // 2} c d e f{i // 2}") for i in range(60)], "doc_id long, text string").repartition(3)
    key = 0
    while True:
        names = {}
        for r in docs.collect():
            s = ngram_join.shingle_sets(__import__("pyarrow").array([r.text]))[0]
            names.setdefault(ngram_join.digest_of(s, key)[0], set()).add(s.tobytes())
        if all(len(v) == 1 for v in names.values()):
            break
        key += 1
    rows, used = ngram_join.grouped(docs)
    assert used == key >= 2
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.group, []).append(r.doc)
    assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(30)]
