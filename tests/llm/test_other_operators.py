"""Pages, vectors and the pipeline, on awkward rows and against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from tidelog.llm import embedding_dedup, minhash_dedup, url_filter, warc
from tidelog.llm.queries import ORACLES

PAGES = [
    (1, "https://Example.ORG/es/x?a#b", "<p>" + "a" * 200),
    (2, "http://www.example.org/en/12", "<p>" + "a" * 200),
    (3, "http://a.b.com/fr/", "short"),
    (4, "http://com/de/1", "short"),
    (5, "nothing", None),
    (6, None, ""),
    (7, "http://xorg/a", "é" * 90),
    (8, "http://org", "é" * 90),
    (9, "http://notexample.org/es/", "\r\n\r\nWARC/1.1\r\n" * 20),
    (10, "ftp://example.org?/es/", "x" * 300_000),
    (11, "http://example.org/en/2\nx", "<p>" + "a" * 200),
    (12, "://EXAMPLE.org/es/é", "q"),
]


def oracle(name, **tables):
    db = duckdb.connect()
    for t, (rows, schema) in tables.items():
        db.execute(f"CREATE TABLE {t} ({schema})")
        db.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = db.sql(ORACLES[name])
    return sorted((str(dict(zip(got.columns, r))) for r in got.fetchall()))


def plain(df, columns):
    return sorted(str({c: r[c] for c in columns}) for r in df.collect())


def test_url_rules(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = url_filter.judge(df)
    assert plain(got, ["page_id", "host", "path", "rule", "verdict"]) == oracle("op5_url_filter", pages=(PAGES, "page_id BIGINT, url VARCHAR, html VARCHAR"))
    assert url_filter.judge(df.limit(0)).count() == 0


def test_automaton_of_many_rules():
    rng = random.Random(3)
    rules = [(".".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("xy") for _ in range(rng.randint(0, 3))), "block") for _ in range(40)]
    urls = [(".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), "/" + "".join(rng.choice("xy") for _ in range(rng.randint(0, 5)))) for _ in range(300)]
    hits = url_filter.match([h.encode() + b"\xff" + p.encode() for h, p in urls], url_filter.compile_rules(rules))
    for u, (h, p) in enumerate(urls):
        assert hits[u].tolist() == [(h == a or h.endswith("." + a)) and p.startswith(b) for a, b, _ in rules]


def test_warc_round_trip(spark, tmp_path):
    rows = [*PAGES, (13, "http://e.org/", "<p>" + "a" * 200), (13, "http://e.org/", "<p>" + "a" * 200), (None, "http://n.org/", "z" * 150), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = warc.archive(df).collect()
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        again = len(raw) >= 100 and i is not None and i != min(same)
        want = (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None)
        assert want in {tuple(r) for r in got if r.page_id == i}
    assert warc.archive(df.limit(0)).count() == 0


def test_merged_index_is_in_order(spark):
    df = spark.createDataFrame(PAGES * 3, "page_id bigint, url string, html string").repartition(4)
    folder = warc.shared_folder(spark) + "-warc"
    index = warc.merge_index(warc.write_archives(df, folder), 3).collect()
    index.sort(key=lambda r: (r.part, r.position))
    keys = [(r.url_key, r.ts, r.page_id) for r in index]
    assert keys == sorted(keys) and len(keys) == 36
    assert warc.url_key("HTTPS://Www.A.org:80/x?y#z") == "org,a,www:80)/x?y"


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 5, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter([(x,) for x in r]) for r in runs])) == sorted((x,) for r in runs for x in r)


def vectors(n=400, dim=16):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        v = rng.standard_normal(dim)
        rows.append((i, v.tolist(), int(i % 3)))
    for i in range(n, n + 150):
        j = int(rng.integers(0, 60))
        rows.append((i, (np.array(rows[j][1]) * 2 + rng.standard_normal(dim) * 0.25).tolist(), rows[j][2]))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(4)]
    return rows


@pytest.mark.parametrize("strip", [40, 1024])
def test_embedding_dedup(spark, monkeypatch, strip):
    monkeypatch.setattr(embedding_dedup, "STRIP", strip)
    rows = vectors()
    odd = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, [None] + [1.0] * 15, 2), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int").repartition(4)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    ids = [r[0] for r in rows]
    comp = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == comp:
            break
        comp = new
    got = {r.vec_id: r for r in embedding_dedup.linked(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, v in enumerate(ids):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (near[i].sum(), ids[comp[i]], comp[i] == i)
    for v, *_ in odd[:6]:
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (0, v, True)
    assert (got[2006].n_links, got[2007].component_id) == (1, 2006)
    assert embedding_dedup.linked(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    clean = [text(rng.randint(30, 400)) for _ in range(40)]
    bench = [text(30) for _ in range(5)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "s", 1), (101, clean[4] + " tail", "en", "s", 1), (102, "12 ?!", "en", "s", 1), (103, None, None, None, None), (104, text(50) + " " + bench[2] + " " + text(9), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    near = {r.doc_id for r in minhash_dedup.deduplicate(spark.createDataFrame(rows[:42], "doc_id bigint, text string, lang string, source string, n_chars bigint")).where("kept").collect()}
    assert kept == near
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.limit(0).count() == 0
