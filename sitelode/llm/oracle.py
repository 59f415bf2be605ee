"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import shards
from .secrets import BASE, RULE_VERSION, RULES


def secret_scan_sql() -> str:
    """Spans from the matches and the pieces between them: a match begins where all that is before it ends."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {quoted(r.kind)} AS kind, {i} AS rk, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, string_split_regex(t, {quoted(r.pattern)}) AS s FROM d" for i, r in enumerate(RULES)
    )
    size = "coalesce(list_sum(list_transform({0}, lambda z: length(z))), 0)"
    counts = ", ".join(f"coalesce(count_if(kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in BASE)
    span = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rk)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({found}),
    u AS (SELECT doc_id, kind, rk, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
    x AS (SELECT doc_id, kind, rk, least, CAST({size.format('s[1:i]')} + {size.format('m[1:i - 1]')} AS BIGINT) AS a, length(m[i]) AS n, length(g[i]) AS measured FROM u),
    f AS (SELECT doc_id, kind, rk, a, a + n AS e FROM x WHERE measured >= least)
    SELECT d.doc_id, {counts}, sha256(coalesce({span} FILTER (rk < {len(BASE)}), '')) AS base_sha256, coalesce({span}, '') AS spans, sha256(t) AS blob, '{RULE_VERSION}' AS rule_version
    FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id, t"""


def ledger_versions_sql() -> str:
    """New blobs are distinct texts that no earlier scan under the same rules had; spans are counted for each path."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    spans = lambda rules: " + ".join(f"len(list_filter(regexp_extract_all(t, {quoted(r.pattern)}, {r.group}), lambda x: length(x) >= {r.least}))" for r in rules)
    each = lambda step, version, source, new, rules: f"SELECT {step}::INT AS step, '{version}' AS rule_version, COUNT(*) AS n_paths, ({new})::BIGINT AS n_new_blobs, coalesce(SUM({spans(rules)}), 0)::BIGINT AS n_spans FROM {source}"
    return f"""WITH d AS (SELECT coalesce(text, '') AS t FROM documents), b AS (SELECT coalesce(text, '') AS t FROM benchmark), u AS (SELECT t FROM d UNION ALL SELECT t FROM b)
    {each(1, 1, 'd', 'SELECT COUNT(DISTINCT t) FROM d', RULES)}
    UNION ALL {each(2, 1, 'u', 'SELECT COUNT(DISTINCT t) FROM b WHERE t NOT IN (SELECT t FROM d)', RULES)}
    UNION ALL {each(3, 2, 'u', 'SELECT COUNT(DISTINCT t) FROM u', BASE)}"""


def crc32_table() -> list[int]:
    """By rule: eight steps of the reversed polynomial for each byte."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def stratified_shards_sql(shards_wanted: int = 8) -> str:
    """Ranks over whole partitions; the checksum folds over the bytes of the text."""
    table = f"[{', '.join(map(str, crc32_table()))}]::BIGINT[]"
    byte = "CAST(('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT)"
    crc = f"xor(list_reduce(list_transform(range(1, n + 1), lambda i: {byte}), lambda acc, b: xor(acc >> 8, tab[1 + (xor(acc, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""WITH d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    m AS (SELECT d.doc_id, d.source, d.n + 1 AS size, {crc} AS text_crc32 FROM d, (SELECT {table} AS tab)),
    c AS (SELECT *, md5('{shards.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size) AS k, CAST(('0x' || substr(md5('{shards.SEED}:' || coalesce(source, '')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM m),
    r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id, text_crc32, size) - u) / CAST(COUNT(*) OVER (PARTITION BY source) AS DOUBLE) AS f FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, k, doc_id, text_crc32, size) - 1 AS place, COUNT(*) OVER () AS total FROM r),
    q AS (SELECT *, total // {shards_wanted} AS least, total % {shards_wanted} AS more FROM p),
    s AS (SELECT *, CASE WHEN place < (least + 1) * more THEN place // (least + 1) ELSE more + (place - (least + 1) * more) // greatest(least, 1) END AS shard FROM q)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(place - CASE WHEN shard <= more THEN shard * (least + 1) ELSE (least + 1) * more + (shard - more) * least END AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM s"""


def _vectors_sql(scale: int) -> str:
    """(r, vec_id, label, v) of the rows that are kept; components as integers, rows numbered."""
    return f"SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


_APART = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def vector_codes_sql(rounds: int = 2) -> str:
    """Every part against every entry, with an average of each component after a round."""
    steps, apart = [], _APART.format("p.x", "e.x")
    nearest = "SELECT r, k, arg_min(i, d * 64 + i) AS i, min(d) AS d FROM (SELECT p.r, p.k, e.i, {0} AS d FROM p JOIN b{1} AS e ON p.k = e.k) GROUP BY r, k"
    for n in range(rounds + 1):
        steps.append(f"a{n} AS ({nearest.format(apart, n)})")
        if n < rounds:
            means = f"SELECT a{n}.k, a{n}.i, [{', '.join(_mean(f'p.x[{c}]') for c in range(1, 5))}] AS x FROM a{n} JOIN p USING (r, k) GROUP BY a{n}.k, a{n}.i"
            steps.append(f"b{n + 1} AS (SELECT e.k, e.i, coalesce(m.x, e.x) AS x FROM b{n} AS e LEFT JOIN ({means}) AS m ON e.k = m.k AND e.i = m.i)")
    return f"""WITH v AS ({_vectors_sql(256)}), p AS (SELECT r, k, v[4 * k + 1:4 * k + 4] AS x FROM v, range(16) AS t(k)),
    f AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS i FROM v QUALIFY i < 64), b0 AS (SELECT p.k, f.i, p.x FROM f JOIN p USING (r)), {', '.join(steps)},
    c AS (SELECT r, string_agg(printf('%02x', i), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM b{rounds})
    SELECT v.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, h.codebooks_sha256 FROM v JOIN c USING (r), h"""


def _mean(total: str) -> str:
    """floor(sum / count) of integers; ``//`` rounds towards zero."""
    return f"CAST((sum({total}) - (((sum({total}) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT)"


def centroid_clusters_sql(rounds: int = 3) -> str:
    steps, apart = [], _APART.format("v.v", "e.x")
    for n in range(rounds + 1):
        steps.append(f"a{n} AS (SELECT r, arg_min(i, d * 16 + i) AS i, min(d) AS d FROM (SELECT v.r, e.i, {apart} AS d FROM v, b{n} AS e) GROUP BY r)")
        if n < rounds:
            each = f"SELECT a{n}.i, g.c, {_mean('v.v[g.c]')} AS m FROM a{n} JOIN v USING (r), range(1, 65) AS g(c) GROUP BY a{n}.i, g.c"
            steps.append(f"b{n + 1} AS (SELECT e.i, coalesce(m.x, e.x) AS x FROM b{n} AS e LEFT JOIN (SELECT i, list(m ORDER BY c) AS x FROM ({each}) GROUP BY i) AS m ON e.i = m.i)")
    return f"""WITH v AS ({_vectors_sql(64)}), b0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS i, v AS x FROM v QUALIFY i < 16), {', '.join(steps)}
    SELECT v.vec_id, a.i::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.i)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(e.x, ',')) AS centroid_sha256
    FROM v JOIN a{rounds} AS a USING (r) JOIN b{rounds} AS e ON a.i = e.i"""


ORACLE: dict[str, str] = {"op4_stratified_shards": stratified_shards_sql(), "op2_secret_scan": secret_scan_sql(), "secret_ledger_versions": ledger_versions_sql(), "op12_vector_codes": vector_codes_sql(), "op13_centroid_clusters": centroid_clusters_sql()}
