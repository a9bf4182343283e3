"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from basketlens.llm.bit_slices import op13_top_products
from basketlens.llm.decontaminate import op5_decontaminate
from basketlens.llm.embeddings import op6_embeddings
from basketlens.llm.jaccard_join import op8_jaccard_join
from basketlens.llm.licences import op7_licences
from basketlens.llm.packing import op3_packing
from basketlens.llm.pitman_yor import op10_pitman_yor
from basketlens.llm.quality import op9_quality
from basketlens.llm.secret_scan import op1_secrets
from basketlens.llm.url_filter import op4_url_filter
from basketlens.llm.vector_codes import op11_vector_codes
from basketlens.llm.warc import op2_warc
from basketlens.llm.whitening import op12_whitening

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_embeddings": op6_embeddings,
    "op7_licences": op7_licences,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality": op9_quality,
    "op10_pitman_yor": op10_pitman_yor,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_top_products": op13_top_products,
}


def _code_round(number: int) -> str:
    """SQL of one pass of op11: every part with its nearest entry (``near``), and the codebook that follows (``book``)."""
    return f"""
        near{number} AS (
            SELECT vec, part, p, arg_min({{'entry': entry, 'd': d}}, d * 64 + entry) AS best
            FROM (SELECT v.vec, v.part, v.p, b.entry,
                         list_sum(list_transform(list_zip(v.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                  FROM parts v JOIN book{number} b USING (part))
            GROUP BY vec, part, p),
        sums{number} AS (
            SELECT part, best.entry AS entry, place, sum(p[place])::BIGINT AS s, count(*) AS n
            FROM near{number}, (SELECT unnest(range(1, 5)) AS place) GROUP BY part, best.entry, place),
        moved{number} AS (
            SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS p FROM sums{number} GROUP BY part, entry),
        book{number + 1} AS (
            SELECT part, entry, coalesce(m.p, b.p) AS p FROM book{number} b LEFT JOIN moved{number} m USING (part, entry)),
    """


ORACLES = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        o AS (
            SELECT payload_digest, max(page_id) AS original
            FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN o.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
        FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 1000
    """,
    "op6_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y
            FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        reach AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings
            UNION
            SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
        SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.component_id, t.vec_id = r.component_id AS kept
        FROM embeddings t
        LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = t.vec_id
        JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = t.vec_id
    """,
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n
            HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
        FROM documents d
        LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
    """,
    "op11_vector_codes": f"""
        WITH whole AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS vec, vec_id, label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (
            SELECT vec, part, list_slice(x, 4 * part + 1, 4 * part + 4) AS p
            FROM whole, (SELECT unnest(range(0, 16)) AS part)),
        book0 AS (SELECT part, vec - 1 AS entry, p FROM parts WHERE vec <= 64),
        {_code_round(0)} {_code_round(1)} {_code_round(2)}
        digest AS (
            SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2),
        coded AS (
            SELECT vec, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
            FROM near2 GROUP BY vec)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM whole JOIN coded USING (vec) CROSS JOIN digest
    """,
    "op13_top_products": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.x) = len(c.x)),
        ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
