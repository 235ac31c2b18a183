r"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

BASE32, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
#: White space as word splitting for near-duplicates takes it.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: What separates benchmark words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _digit(at: str) -> str:
    return f"(instr('{HEX}', substr(x, {at}, 1)) - 1)"


ARCHIVES = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', (1 + ((({_digit('1 + 5 * i // 4')} * 16 + {_digit('2 + 5 * i // 4')}) >> (3 - 5 * i % 4)::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > f THEN f END AS refers_to FROM d"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{BLANKS}'), lambda v: v <> '') AS l FROM documents),
s AS (SELECT doc_id, l, least(5, len(l)) AS n FROM w WHERE len(l) > 0),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(len(l) - n + 1), lambda i: array_to_string(l[i + 1 : i + n], ' ')))) AS gram FROM s),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT node AS doc_id, min(root) AS class_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links FROM r LEFT JOIN n ON n.a = r.node GROUP BY node"""


def _words(table: str, key: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{SEPARATORS}'), lambda v: v <> '') AS l FROM {table}"


CONTAMINATION = f"""WITH d AS ({_words('documents', 'doc_id')}), i AS ({_words('benchmark', 'item_id')}),
iw AS (SELECT item_id, least(13, len(l)) AS n, l FROM i WHERE len(l) > 0),
win AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(len(l) - n + 1), lambda k: array_to_string(l[k + 1 : k + n], ' '))) AS w FROM iw),
sized AS (SELECT doc_id, s.n, len(l) - s.n + 1 AS places, l FROM d, (SELECT DISTINCT n FROM win) s WHERE len(l) >= s.n),
dw AS (SELECT doc_id, n, unnest(range(places)) AS p, unnest(list_transform(range(places), lambda k: array_to_string(l[k + 1 : k + n], ' '))) AS w FROM sized),
hit AS (SELECT doc_id, item_id, n, p FROM dw JOIN win USING (n, w)),
spots AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)"""



def _clusters(rounds: int = 3) -> str:
    """Lloyd rounds one after another: d holds a vector's squared distance to every centroid, a its nearest one, c the centroids."""
    steps = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, unnest(v) AS x FROM kept)",
        "f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM kept)",
        "c0 AS MATERIALIZED (SELECT k, d, x FROM e JOIN f USING (vec_id) WHERE k < 16)",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, k, sum((e.x - c.x) * (e.x - c.x)) AS far FROM e JOIN c{r} AS c USING (d) GROUP BY vec_id, k)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, k, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, k) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT k, d, sum(x) AS s, count(*) AS n FROM a{r} JOIN e USING (vec_id) GROUP BY k, d)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, d, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM c{r} LEFT JOIN m{r} USING (k, d))")
    steps.append(f"h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY k)")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, k::INT AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, digest AS centroid_sha256 "
        f"FROM a{rounds} JOIN h USING (k)"
    )


ORACLE_SQL = {"op3_zstd_warc_archives": ARCHIVES, "op9_minhash_ngram_jaccard": NEAR_DUPLICATES, "op10_benchmark_decontamination": CONTAMINATION, "op13_partial_distance_clusters": _clusters()}
