"""Cases that random texts don't meet: regular bytes, repeated and missing ids, clashing columns, brute force of whole stages."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import WORD, sentence, shingle_set, words_of

from tidelog.llm import common, decontamination, embedding_dedup, language_id, minhash_dedup, packing, sharding, token_counts, url_filter, warc


def morse(n):
    """Two self-similar byte strings that every polynomial hash modulo 2^64 confuses from 1,024 bytes on."""
    one, two = b"a", b"b"
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_regular_words_have_hashes_of_their_own(n):
    pair = morse(n)
    data = np.frombuffer(b" ".join(pair), np.uint8)
    assert len(np.unique(common.hash_segments(data, np.array([0, n + 1]), np.array([n, 2 * n + 1])))) == 2


def test_hash_depends_on_all_bytes_and_the_length():
    rng = random.Random(2)
    pieces = {bytes(rng.randrange(256) for _ in range(n)) for n in [*range(1, 80), 200, 1000] for _ in range(3)}
    pieces |= {p + b"\0" for p in pieces} | {p[:-1] + bytes([p[-1] ^ 1]) for p in pieces} | {p[::-1] for p in pieces}
    pieces = sorted(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    got = common.hash_segments(data, ends - [len(p) for p in pieces], ends)
    assert len(np.unique(got)) == len(pieces)
    alone = [common.hash_segments(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0] for p in pieces]
    assert got.tolist() == alone


def test_regular_words_in_the_operators(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    one, two = (x.decode() for x in morse(1024))
    rows = [(0, one), (1, two), (2, f"y {one} {two}"), (3, f"y {two} {one}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    assert all(r.component_id == r.doc_id and r.kept for r in minhash_dedup.deduplicate(df).collect())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in rows]
    raw = [t.encode() for t in texts]
    ids, before = packing.Encoder().encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    vocab = token_counts.vocabulary("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in token_counts.token_counts(df).collect()}
    assert [(got[i].n_tokens, round(got[i].score, 6)) for i in (0, 1)] == [(n, round(s, 6)) for n, s in (token_counts.segment_one(x.encode(), vocab) for x in (one, two))]


def test_repeated_ids_keep_their_links(spark):
    rng = random.Random(6)
    a, b = sentence(rng, 200, 5000), sentence(rng, 200, 5000)
    df = spark.createDataFrame([(0, a), (0, b), (1, b + " tail"), (2, a + " end"), (None, a), (3, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in minhash_dedup.deduplicate(df).collect())
    assert got == [(False, 0, 0, True), (False, 0, 0, True), (False, 1, 0, False), (False, 2, 0, False), (False, 3, 3, True), (True, None, None, False)]
    wide = df.withColumn("_id", F.lit(1)).withColumn("id", F.lit(2)).withColumn("row", F.lit(3)).withColumn("digest", F.lit("d"))
    kept = minhash_dedup.one_of_each(wide.unionByName(wide.where("doc_id = 0")))
    assert kept.columns == wide.columns
    assert sorted(str(r.doc_id) + (r.text or "")[:9] for r in kept.collect()) == sorted(["0" + a[:9], "0" + b[:9], "None" + a[:9], "3"])


def test_large_families_and_buckets(spark, monkeypatch):
    """Families over a block and buckets over a crowd: chains of edits, templates at 0.5, and two groups that only one link joins."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "CROWD", 8)
    rng = random.Random(12)
    base, template, texts = sentence(rng, 120, 5000).split(), sentence(rng, 90, 5000), []
    for i in range(60):  # each is near to the few before it
        base[(i * 2) % 120] = f"edit{i}"
        texts.append(" ".join(base))
    texts += [template + " " + sentence(rng, 60, 5000) for _ in range(40)]
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert [r.component_id for r in sorted(minhash_dedup.deduplicate(df).collect())] == comp


def test_shards_keep_columns_of_any_name(spark):
    df = spark.range(50).select(*[F.col("id").alias(c) for c in ("id", "_key", "_block", "_r", "_rid", "key", "rid", "row", "n", "base")])
    got = sharding.assign(df, 3)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert sorted(r.key for r in got.collect()) == list(range(50))
    with pytest.raises(ValueError):
        sharding.assign(df.withColumn("Slot", F.lit(1)))


def test_slots_know_nothing_of_rows(spark):
    """Joint law of the permutation: shards and slots of rows and of neighbouring rows, by chi-square."""
    n = 4000
    numbered = common.keep(spark.range(n).select(F.col("id").alias("rid")))
    got = {r.rid: (r.shard, r.slot) for r in sharding._places(numbered, 2, 5).collect()}
    place = np.array([got[i][0] * (n // 2) + got[i][1] for i in range(n)])
    assert sorted(place.tolist()) == list(range(n))

    def uneven(x, y):
        """Standardized chi-square of two quantities in 8 classes each."""
        seen = np.histogram2d(x, y, bins=8)[0]
        want = len(x) / 64
        return (((seen - want) ** 2 / want).sum() - 49) / math.sqrt(2 * 49)

    assert abs(uneven(np.arange(n), place)) < 5
    for step in (1, 2, 7):
        assert abs(uneven(place[:-step], place[step:])) < 5
    assert abs((np.diff(place) > 0).mean() - 0.5) < 0.04


def test_languages_by_their_bundles(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word(("aeioumnl", "zkwprtsä")[i % 2]) for _ in range(20)), "xy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    protos = language_id.learn(df)
    got = {r.doc_id: r for r in language_id.predict(df, protos).collect()}
    for i, text, _ in rows:
        c = [0, *(ord(x) if x.isalpha() else 0 for x in text), 0]
        c = [x for k, x in enumerate(c) if x or not k or c[k - 1]]
        bundle = np.zeros(language_id.DIM)
        for grams, n in Counter(zip(c, c[1:], c[2:])).items():
            if grams[1]:
                v = [language_id.letter_vectors(np.array([g]))[0].astype(float) for g in grams]
                bundle += n * np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        cosine = {k: bundle @ p / np.linalg.norm(bundle) for k, p in protos.items()}
        best = max(cosine, key=cosine.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(cosine[best], abs=1e-9)


def test_unlabelled_corpus_is_kept(spark):
    rows = [(0, "some text", None), (1, "12 ?!", None), (2, None, None), (3, "東京", None), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    left = language_id.accepted(df, language_id.learn(df))
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [0, 3]


def test_decontamination_against_all_windows(spark):
    """Recall and precision by brute force: every window of every text with every item, by similarity band."""
    rng = random.Random(21)
    items = [(i, sentence(rng, rng.randint(12, 60) + i % 3 * 50, 3000)) for i in range(30)]
    texts = []
    for d in range(150):
        parts = [sentence(rng, rng.randint(0, 60), 3000)]
        w = items[d % 30][1].split()
        for _ in range(d // 30):  # none to four changed words
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        texts.append(" ".join([*parts, *w, sentence(rng, rng.randint(0, 60), 3000)]))
    shingles = lambda text: [tuple(x) for x in zip(*[words_of(text)[k:] for k in range(5)])]
    best = {}
    for d, t in enumerate(texts):
        run = shingles(t)
        for i, item in items:
            bag, n = Counter(shingles(item)), len(shingles(item))
            for at in range(max(1, len(run) - n + 1)):
                window = Counter(run[at : at + n])
                both = sum((bag & window).values())
                s = both / (n + sum(window.values()) - both)
                best[d, i] = max(best.get((d, i), 0), s)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(df, bench).collect()}
    for lo, hi, least in ((0.8, 0.85, 0.95), (0.85, 0.95, 0.99), (0.95, 1.01, 1)):
        want = {k for k, s in best.items() if lo <= s < hi}
        assert len(want) > 3 and len(want & set(got)) >= least * len(want), (lo, len(want), len(want & set(got)))
    assert all(best[k] >= 0.8 and s <= best[k] + 1e-9 for k, s in got.items())
    bag = Counter([1, 1, 2, 3])
    run = [rng.randrange(5) for _ in range(40)]
    slow = [decontamination.similarity(bag, Counter(run[k : k + 4])) for k in range(37)]
    assert list(decontamination.similarities(bag, run, 4)) == pytest.approx(slow)


def test_best_segmentation_by_all_cuts():
    """An independent search over all segmentations of short pre-tokens, and long ones against the plain recurrence."""
    vocab = token_counts.vocabulary("byte_bpe_50k.tiktoken")

    def all_cuts(piece):
        if not piece:
            return (0.0, 0)
        options = [(vocab.score[piece[:k]] + s, n - 1) for k in range(1, len(piece) + 1) if piece[:k] in vocab.score for s, n in [all_cuts(piece[k:])]]
        return max(options)

    rng = random.Random(3)
    for _ in range(60):
        piece = "".join(rng.choice(" theanringo") for _ in range(rng.randint(1, 9))).encode()
        score, n = all_cuts(piece)
        assert token_counts.segment_one(piece, vocab) == (-n, pytest.approx(score))
        (tokens,), (total,) = token_counts.count_units([piece], vocab)
        assert (tokens, total) == (-n, pytest.approx(score))
    for long_ in ("東京都" * 40, "z" * 700, "naïve " * 30):
        assert token_counts.segment_long(long_.encode(), vocab) == token_counts.segment_one(long_.encode(), vocab)


def test_urls_by_brute_force():
    hosts = ["org", "example.org", "a.example.org", ".example.org", "xexample.org", "a.com", "exorg", "", "x" * 500 + ".example.org", "example.org" * 40]
    paths = ["", "/", "/es/", "/es", "/en/12", "/fr/x", "/de/", "/ES/", "/es/" + "y" * 1000, "/e" * 99]
    pairs = [(h, p) for h in hosts for p in paths] + [("a" * 100_000 + ".org", "/x" * 100_000)]
    random.Random(1).shuffle(pairs)
    hits = url_filter.match([h.encode() + b"\xff" + p.encode() for h, p in pairs], url_filter.compile_rules())
    for (h, p), hit in zip(pairs, hits):
        assert hit.tolist() == [(h == host or h.endswith("." + host)) and p.startswith(path) for host, path, _ in url_filter.RULES]


def test_captures_are_numbered_across_parts(spark):
    rows = [(i, "http://a.org/hot" if i % 3 else f"http://b.org/{i}", f"<p>{i}</p>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    index = warc.merge_index(warc.write_archives(df, warc.shared_folder(spark) + "-warc"), 40)
    got = warc.history(index).collect()
    assert len({r.part for r in got}) > 3 and len({r.part for r in got if r.url_key == "org,a)/hot"}) > 1
    hot = sorted((r.capture, r.ts) for r in got if r.url_key == "org,a)/hot")
    assert [c for c, _ in hot] == list(range(1, 201)) and [t for _, t in hot] == sorted(t for _, t in hot)


def test_collision_counts_miss_no_near_pair():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 32))
    x[600:] = x[:600] + rng.standard_normal((600, 32)) * rng.uniform(0, 0.6, (600, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spots = (x @ embedding_dedup.directions(32)).astype(np.float32)
    half = embedding_dedup.REACH * embedding_dedup.distance_at(0.93) + 1e-5
    a, b = embedding_dedup.collisions(spots, spots, half, embedding_dedup.calibrated_count())
    near = np.nonzero(x @ x.T >= 0.93)
    assert set(zip(*(n.tolist() for n in near))) <= set(zip(a.tolist(), b.tolist()))
    assert len(a) < 0.05 * len(x) ** 2


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (1, [0.0, 0.0, 1.0], 0), (1, [0.0, 1.0, 0.0], 1), (3, [0.0, 1.0, 0.01], 1), (4, [0.0, 1.0, 0.02], 1)]
    got = embedding_dedup.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_copies_and_empty_texts_of_a_hot_group(spark):
    rng = random.Random(8)
    hot, lone = sentence(rng, 60, 5000), [sentence(rng, 60, 5000) for _ in range(20)]
    rows = [(i, hot) for i in range(5, 300)] + [(i, None if i % 2 else " ") for i in range(300, 400)] + [(400 + i, t) for i, t in enumerate(lone)] + [(None, hot), (None, None), (3, hot + " tail")]
    got = minhash_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert named == {i: (3, i == 3) if i < 300 else (i, True) for i in [3, *range(5, 420)]}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)] * 2


def test_pipeline_by_brute_force(spark, tmp_path):
    """All four stages: what each drops, and the ids and places of what is packed."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(44)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    bench = [text(30) for _ in range(4)]
    rows = [(i, text(rng.choice([1, 40, 300])), "en") for i in range(30)]
    rows += [(40 + i, rows[i][1] + " tail", "en") for i in range(30) if len(rows[i][1].split()) > 30]
    rows += [(90, "12 ?!", "en"), (91, None, "en"), (92, "", None), (93, text(20) + " " + bench[1], "en"), (94, bench[3], None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    left = [r for k, r in enumerate(left) if not any(near(shingle_set(r[1]), shingle_set(q[1])) for q in left[:k])]
    left = [r for r in left if not any(b in r[1] for b in bench)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in left}
    got, spots = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(ids)
    for i, parts in got.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for spans in spots.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= packing.WINDOW


def test_pieces_without_an_id(spark):
    rng = random.Random(8)
    rows = [(None, sentence(rng, rng.randint(1, 60))) for _ in range(60)] + [(None, "same text")] * 20 + [(5, None), (5, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), window=256).collect()
    assert sum(r.length for r in got if r.start == 0) <= sum(r.length for r in got)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(r.length for r in got) and sum(r.start == 0 for r in got) == len(rows)
    for parts in by_seq.values():
        total = sum(r.length for r in parts)
        assert total == 256 or total & (total - 1) == 0
    assert WORD.findall("a b") == ["a", "b"]
