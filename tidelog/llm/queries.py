"""Registered queries of the operators, and SQL twins where SQL can say them."""

from __future__ import annotations

from tidelog.llm import decontamination, embedding_dedup, language_id, minhash_dedup, ngram_lm, packing, sharding, token_counts, url_filter, warc
from tidelog.llm.common import lean, table



def _lean(query):
    def run(spark, folder):
        lean(spark)
        return query(spark, folder)

    return run


QUERIES = {
    "op1_minhash_dedup": lambda s, d: minhash_dedup.deduplicate(table(s, d, "documents")),
    "op2_ngram_lm": lambda s, d: ngram_lm.score_documents(table(s, d, "documents"), min_count=1),
    "op3_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op4_warc": lambda s, d: warc.archive(table(s, d, "pages")),
    "op5_url_filter": lambda s, d: url_filter.judge(table(s, d, "pages")),
    "op6_sharding": lambda s, d: sharding.digest(table(s, d, "documents")),
    "op7_language_id": lambda s, d: language_id.identify(table(s, d, "documents")),
    "op8_decontamination": lambda s, d: decontamination.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
    "op9_token_counts": lambda s, d: token_counts.token_counts(table(s, d, "documents")),
    "op10_embedding_dedup": lambda s, d: embedding_dedup.linked(table(s, d, "embeddings")),
}

QUERIES = {name: _lean(query) for name, query in QUERIES.items()}

_RULES = ", ".join(f"('{h}', '{p}', '{h + p}', '{v}')" for h, p, v in url_filter.RULES)

ORACLES = {
    "op1_minhash_dedup": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM t),
        s AS (SELECT DISTINCT doc_id, sh FROM g), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        m AS (SELECT x, min(y) AS root FROM r GROUP BY x)
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, m.root = t.doc_id AS kept FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN m ON m.x = t.doc_id""",
    "op4_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        r AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM r),
        t AS (SELECT *, n >= {warc.MIN_REVISIT} AND page_id <> first AS again FROM f)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN again THEN first END AS refers_to FROM t""",
    "op10_embedding_dedup": """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        u AS (SELECT * FROM e WHERE list_dot_product(v, v) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
        c AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x), m AS (SELECT x, min(y) AS root FROM c GROUP BY x)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.root AS component_id, m.root = e.vec_id AS kept FROM embeddings e LEFT JOIN n ON n.x = e.vec_id JOIN m ON m.x = e.vec_id""",
    "op5_url_filter": f"""WITH r(rh, rp, rule, v) AS (VALUES {_RULES}),
        u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h)
        SELECT page_id, host, path, rule, coalesce(v, '{url_filter.DEFAULT}') AS verdict FROM p
        LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY strlen(rule) DESC NULLS LAST) = 1""",
}
