"""Text operators against brute force, and on awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidelog.llm import common, decontamination, language_id, minhash_dedup, ngram_lm, packing, sharding, token_counts
from tidelog.llm.elias_fano import EliasFano

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, shard int, slot string"


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts, edits and copies, and rows that are null, empty, blank, very long, repeated or without an id."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.choice([3, 8, 40, 120])) for _ in range(60)]
    for i in range(0, 30, 2):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))
    base = sentence(rng, 200).split()
    for i in range(40):
        texts.append(" ".join([*base[: i * 2], "x", *base[i * 2 :]]))
    texts += [texts[3]] * 5 + [texts[4].upper()] * 2
    rows = [(i, t, "ab"[i % 2], 1, "s") for i, t in enumerate(texts)]
    rows += [(900, None, None, 0, None), (901, "", "a", 0, None), (902, " \n\t ", "a", 0, None), (903, "one", "b", 0, None), (904, "one", "b", 0, None)]
    rows += [(905, sentence(rng, 60_000), "a", 0, None), (906, "naïve 東京  <|endoftext|> x y", "b", 0, None), (907, "z" * 30_000, "b", 0, None)]
    rows += [(0, texts[0], "a", 1, "s"), (None, texts[1], "b", 1, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = words_of(text)
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_word_and_shingle_hashes():
    texts = ["A b  C d e f", "", "x", "a B c d e f g", "\x0b\x0c", "é" * 9000 + " tail"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    word, before = common.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert np.diff(before).tolist() == [len(words_of(t)) for t in texts]
    names = [w for t in texts for w in words_of(t)]
    assert len(set(names)) == len(set(word.tolist())) == len(set(zip(names, word.tolist())))
    _, n = common.distinct_per_text(*common.shingles(word, before))
    assert np.diff(n).tolist() == [len(shingle_set(t)) for t in texts]


def test_minhash_dedup(docs, corpus, empty):
    sets = {i: shingle_set(t) for i, t, *_ in corpus if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            x = len(sets[i] & sets[j])
            if i < j and x and 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = minhash_dedup.deduplicate(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash_dedup.deduplicate(empty).count() == 0
    kept = minhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in sets if find(i) == i)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 62, (2, 3000)).astype(np.uint64)
    both = np.unique(np.concatenate([a, b]))
    one = minhash_dedup.sketch(np.concatenate([a, b, both]), np.array([0, 3000, 6000, 6000 + len(both)]))
    assert (np.maximum(one[0], one[1]) == one[2]).all()
    small = minhash_dedup.sketch(np.concatenate([a[:3], a[:4]]), np.array([0, 3, 7]))
    assert (small[1] >= small[0]).all()
    shared = np.concatenate([a[:2700], b[:300]])
    s = minhash_dedup.sketch(np.concatenate([a, shared]), np.array([0, 3000, 6000]))
    n = np.array([3000.0])
    assert minhash_dedup.odds(s[:1], s[1:], n, n, 0.8)[0] > 0.7
    assert minhash_dedup.odds(one[:1], one[1:2], n, n, 0.8)[0] == -np.inf


def test_pairs_at_the_threshold_share_a_band():
    values = np.random.default_rng(8).integers(0, 1 << 62, 300_000).astype(np.uint64).reshape(3000, 100)
    size = np.tile([100, 80], 3000)
    made = minhash_dedup.sketch(np.concatenate([x for v in values for x in (v, v[:80])]), np.concatenate([[0], np.cumsum(size)]))
    assert [minhash_dedup.band_of(p) for p in (85, 80)] == [8, 6]
    a, b = minhash_dedup._candidates(made, np.repeat(np.arange(3000), 2), np.zeros(6000, int), 6)
    assert {(2 * i, 2 * i + 1) for i in range(3000)} <= set(zip(a.tolist(), b.tolist()))


def test_pipeline_links_from_a_similarity_of_80(spark):
    import corpus_pipeline

    rng = random.Random(80)
    texts = []
    for more in (18, 20, 22, 24, 25, 26, 30):  # 100 shingles of 100 + more
        base = sentence(rng, 104, 5000)
        texts += [base, base + " " + sentence(rng, more, 5000)]
    left = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 4, 6, 8, 10, 11, 12, 13]


def test_ngram_lm(docs, corpus, empty):
    tokens = [(i, [*words_of(t), "</s>"]) for i, t, *_ in corpus]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens]
    uni, bi, tri, ctx = Counter(), Counter(), Counter(), Counter()
    for (_, w), h in zip(tokens, held):
        if not h:
            x = ["<s>", *w]
            uni.update(w)
            bi.update(zip(x, x[1:]))
            tri.update(zip(x, x[1:], x[2:]))
            ctx.update(x[:-1])
    n, v, cut = sum(uni.values()), len(uni), ngram_lm.DISCOUNT
    mass2, mass3 = Counter(), Counter()
    for (a, _), c in bi.items():
        mass2[a] += (c - cut) / ctx[a] if c >= 2 else 0
    for (a, b, _), c in tri.items():
        mass3[a, b] += (c - cut) / bi[a, b] if c >= 2 else 0
    want = []
    for (i, w), h in zip(tokens, held):
        x, base, score = ["<s>", *w], 0.0, 0.0
        for j in range(1, len(x)):
            p = (uni[x[j]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            left = x[j - 1]
            if left in ctx:
                p = ((bi[left, x[j]] - cut) / ctx[left] if bi[left, x[j]] >= 2 else 0) + (1 - mass2[left]) * p
            if j > 1 and bi[x[j - 2], left] >= 2:
                c = tri[x[j - 2], left, x[j]]
                p = ((c - cut) / bi[x[j - 2], left] if c >= 2 else 0) + (1 - mass3[x[j - 2], left]) * p
            score += math.log10(p)
        want.append((i, h, len(w), sum(uni[y] > 0 for y in w), n, base, score))
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    got = sorted(map(tuple, ngram_lm.score_documents(docs).collect()), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=order)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-12) and g[6] == pytest.approx(w[6], rel=5e-3, abs=2e-3)
    assert ngram_lm.score_documents(empty).count() == 0


def test_ngram_query_keeps_ngrams_seen_once(spark, tmp_path):
    from tidelog.llm import queries

    ids = [i for i in range(1000) if (zlib.crc32(str(i).encode()) % 10 == 0) == (i < 500)]
    rows = [(ids[0], "a b c d"), (ids[-1], "a b c d"), (ids[-2], "e b f d")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    train = [["<s>", *t.split(), "</s>"] for _, t in rows[1:]]
    uni, bi, tri, ctx = Counter(), Counter(), Counter(), Counter()
    for x in train:
        uni.update(x[1:])
        bi.update(zip(x, x[1:]))
        tri.update(zip(x, x[1:], x[2:]))
        ctx.update(x[:-1])
    n, cut, score = sum(uni.values()), ngram_lm.DISCOUNT, 0.0
    x = train[0]
    for j in range(1, len(x)):
        p = (uni[x[j]] + 0.1) / (n + 0.1 * (len(uni) + 1))
        own = sum(c - cut for (a, _), c in bi.items() if a == x[j - 1]) / ctx[x[j - 1]]
        p = (bi[x[j - 1], x[j]] - cut) / ctx[x[j - 1]] + (1 - own) * p
        if j > 1:
            pair = (x[j - 2], x[j - 1])
            own = sum(c - cut for (a, b, _), c in tri.items() if (a, b) == pair) / bi[pair]
            p = (tri[*pair, x[j]] - cut) / bi[pair] + (1 - own) * p
        score += math.log10(p)
    got = {r.doc_id: r for r in queries.QUERIES["op2_ngram_lm"](spark, str(tmp_path)).collect()}
    assert got[ids[0]].held_out and not got[ids[-1]].held_out
    assert got[ids[0]].score == pytest.approx(score, rel=5e-3) and got[ids[0]].score > got[ids[0]].base_score


def test_ngram_words_may_outnumber_successors(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "_REL", 6, raising=False)  # a fixed width that 200 words don't fit
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(0, text), (1, text)], "doc_id bigint, text string")
    model = ngram_lm.train(docs, 1)
    assert model.types == 201 and model.rel == 1
    got = ngram_lm.scored(docs, model).first()
    cut, want = ngram_lm.DISCOUNT, 0.0
    for j in range(201):  # every n-gram occurs twice and is its context's only one
        p = (2 + 0.1) / (402 + 0.1 * 202)
        for _ in range(1 + (j > 0)):
            p = (2 - cut) / 2 + cut / 2 * p
        want += math.log10(p)
    assert got.score == pytest.approx(want, rel=5e-3)


@pytest.mark.parametrize("n,universe", [(0, 9), (1, 1), (50, 60), (2000, 1 << 60), (3000, 40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    e = EliasFano.of(EliasFano.build(v, universe))
    assert (e.access(np.arange(n)) == v).all()
    q = np.concatenate([v, rng.integers(0, universe, 300).astype(np.uint64)])
    place, same = e.successor(q)
    assert (place == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()


def test_packing(docs, corpus, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for i, t, *_ in corpus:
        ids.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    got = packing.pack(docs, items_per_task=40).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(x for x in ids if x is not None) == sorted({d for d, _ in by_doc if d is not None})
    for i, all_ids in ids.items():
        for x in all_ids:
            pieces = {(r.start, r.length, r.ids_crc32) for r in by_doc[i, len(x)]}
            assert sum(n for _, n, _ in pieces) >= len(x)
            if len(all_ids) == 1:
                assert sum(n for _, n, _ in pieces) == len(x)
                assert all(c == zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) for s, n, c in pieces)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.WINDOW or at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    assert packing.pack(empty).count() == 0


def test_encoder_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder()
    piece = st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "　", "\x85", "'s", "'re", "a", "Bc", "é", "東", "1", "!", "<|endoftext|>", "<", "\x1c"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.lists(piece, max_size=12).map("".join), st.text(max_size=20)), max_size=4))
    def check(texts):
        raw = [t.encode("utf-8", "replace") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        ids, before = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        for i, r in enumerate(raw):
            assert ids[before[i] : before[i + 1]].tolist() == tok.encode(r.decode(), add_special_tokens=False).ids

    check()


def test_sum_of_squares_places_by_cost():
    rng = random.Random(2)
    packer = packing.SumOfSquares(64)
    fill = {}
    for _ in range(3000):
        n = rng.randint(1, 64)
        before = Counter(x for x in fill.values() if x < 64 and x & (x - 1))
        cost = lambda f: sum(c * c for c in (before - Counter([f]) + Counter([f + n] if f + n < 64 and (f + n) & (f + n - 1) else [])).values())  # noqa: B023, E731
        least = min(cost(f) for f in {0, *(x for x in fill.values() if x + n <= 64)})
        b, at = packer.place(n)
        assert at == fill.get(b, 0) and at + n <= 64 and cost(at) == least
        fill[b] = at + n


def test_sharding(docs, corpus, empty):
    got = sharding.digest(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert sharding.digest(empty).count() == 0


def test_communication_matrix_is_hypergeometric():
    sizes = [5, 0, 40, 13]
    seen = Counter()
    for seed in range(3000):
        m = sharding.communication_matrix(sizes, 3, seed)
        assert [sum(r) for r in m] == sizes and sorted(map(sum, zip(*m))) == [19, 19, 20]
        seen[m[0][0]] += 1
    for k in range(6):
        p = math.comb(20, k) * math.comb(38, 5 - k) / math.comb(58, 5)
        assert abs(seen[k] / 3000 - p) < 4 * math.sqrt(p / 3000) + 1e-3


def test_whole_rows_in_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/out", 4, rows_per_file=20)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_language_id(spark, docs, empty):
    rng = random.Random(1)
    letters = {"x": "aeioumnl", "y": "zkwprtsä", "z": "бвгдежзи"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word("xyz"[i % 3]) for _ in range(30)), "xyz"[i % 3]) for i in range(240)]
    rows += [(1000, None, "x"), (1001, "", "y"), (1002, "12 34 !?", "x"), (1003, "zkwp", None), (None, "бвгд жзи", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    for i, _, lang in rows[:240]:
        assert got[i].lang_pred == lang and 0 < got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "y" and got[None].lang_pred == "z"
    assert language_id.identify(empty).count() == 0
    protos = language_id.learn(df)
    kept = language_id.accepted(df.withColumn("score", F.lit("mine")), protos)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 242
    # The scores are those of the texts' own bundled vectors, but for the norm's estimate.
    text = rows[7][1]
    data = np.frombuffer(text.encode(), np.uint8)
    _, gram, count, _ = language_id.trigrams(data, np.array([0, len(data)]))
    bundle = (count[:, None] * language_id.gram_vectors(gram).astype(float)).sum(axis=0)
    cosine = {k: bundle @ v / np.linalg.norm(bundle) for k, v in protos.items()}
    assert max(cosine, key=cosine.get) == rows[7][2] and got[7].score == pytest.approx(cosine[rows[7][2]], rel=0.15)


def test_token_counts(docs, corpus, empty):
    vocab = token_counts.vocabulary("byte_bpe_50k.tiktoken")
    got = token_counts.token_counts(docs).collect()
    want = []
    for i, t, *_ in corpus:
        raw = (t or "").encode()
        starts = packing.unit_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
        units = Counter(raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)]))
        if len(raw) > 20_000:
            continue
        each = {u: token_counts.segment_one(u, vocab) for u in units}
        want.append((i is None, i or 0, len(raw), sum(units.values()), sum(each[u][0] * n for u, n in units.items()), round(sum(each[u][1] * n for u, n in units.items()), 6)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_pretokens, r.n_tokens, round(r.score, 6)) for r in got if r.n_bytes <= 20_000) == sorted(want)
    assert len(got) == len(corpus) and token_counts.token_counts(empty).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, n, 5000)) for i, n in enumerate([14, 22, 35, 57, 90, 300, 3])] + [(50, None), (51, "")]
    rows, want = [], set()
    for d in range(80):
        parts = [sentence(rng, rng.randint(0, 200), 5000)]
        if d % 4 == 0:
            i, text = items[d // 4 % 7]
            if d % 8 == 0 and i in (3, 4, 5):
                w = text.split()
                w[len(w) // 2] = "other"
                text = " ".join(w)
            parts += [text.title() + ("!" if d % 3 else ""), sentence(rng, rng.randint(0, 200), 5000)]
            want.add((d, i))
        if d % 5 == 0:  # half an item is no match
            parts.append(" ".join(items[3][1].split()[:28]))
        rows.append((d, " \n".join(parts)))
    rows += [(100, None), (101, ""), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contaminated(df, bench).collect()
    assert sorted(map(str, got)) == sorted(map(str, decontamination.contaminated(df, bench, items_per_pass=4).collect()))
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0)}
    assert all(r.similarity >= 0.8 and r.n_words == len(items[r.item_id][1].split()) for r in got)
    left = decontamination.clean(df.withColumn("item_id", F.lit(1)), bench)
    assert left.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in left.collect()} == {d for d, _ in rows if d is not None} - {d for d, _ in want}
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_of_items_alone(spark):
    rng = random.Random(10)
    items = [(n, sentence(rng, n, 5000)) for n in [*range(1, 60), 90, 150, 300, 700]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(n, t) for n, t in items] + [(1000 + n, " ".join(t.split()[: n - (n - 4) // 6])) for n, t in items if n >= 10]
    rows += [(2000 + n, sentence(rng, 40, 5000) + " " + t) for n, t in items if n >= 5]
    index, found = decontamination.Items(items), set()
    for d, t in rows:  # each a chunk of its own
        raw = np.frombuffer(t.encode(), np.uint8)
        found |= {(d, index.ids[i]) for _, i, *_ in decontamination.matches(index, *decontamination.plain_words(raw, np.array([0, len(raw)])))}
    assert {(d, d % 1000) for d, _ in rows} <= found
    alone = spark.createDataFrame(items[4:40], "doc_id bigint, text string").repartitionByRange(36, "doc_id")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(alone, bench).collect()} == {(n, n) for n, _ in items[4:40]}


def test_decontamination_judges_rows_not_ids(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, 30, 5000)) for i in range(3)]
    other = [sentence(rng, 60, 5000) for _ in range(4)]
    rows = [(None, items[0][1]), (None, other[0]), (None, other[1]), (7, items[2][1]), (7, other[2]), (8, other[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for n in (1000, 2):
        assert sorted(r.text for r in decontamination.clean(df, bench, items_per_pass=n).collect()) == sorted(other)


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 63, (2, 70)).astype(np.uint64)
    query = np.concatenate([items ^ rng.integers(0, 1 << 63, (2, 70)).astype(np.uint64) & rng.integers(0, 1 << 63, (2, 70)).astype(np.uint64), items ^ np.uint64(0b1011)], axis=1)
    q, i = decontamination.HammingIndex(items).search(query)
    apart = sum(np.bitwise_count(query[w][:, None] ^ items[w][None, :]).astype(int) for w in range(2))
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontamination.RADIUS))))

