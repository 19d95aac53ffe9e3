"""The same results as SQL, where SQL can express them."""

from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"


def _count_of(characters: str) -> str:
    return f"length(regexp_replace(t, '[^{characters}]', '', 'g'))"


def _quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    broken = []
    for part, whole, least, most in RULES.values():
        ratio = f"{part} / nullif({whole}, 0)::double"
        broken += [f"coalesce({ratio} < {least}, false)"] if least is not None else []
        broken += [f"coalesce({ratio} > {most}, false)"] if most is not None else []
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
    tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS whole FROM d),
    m AS (SELECT *, list_transform(whole, lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')) AS ls FROM l),
    c AS (SELECT doc_id, len(w)::bigint AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::bigint AS word_chars,
            {_count_of('#*$%&|<>')}::bigint AS n_symbols, {_count_of('!')} AS n_exclaims, {_count_of('A-Z')} AS n_upper,
            len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({stops}))) AS n_stop_words,
            len(ls) AS n_lines, (len(whole) - len(list_distinct(whole)))::bigint AS n_dup_lines,
            len(list_filter(ls, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines,
            len(list_filter(ls, lambda x: x[1] IN ('-', '*', '•'))) AS n_bullet_lines,
            coalesce(n, 0)::bigint AS n_repeat_words
          FROM m LEFT JOIN covered USING (r)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR {' OR '.join(broken)}) AS kept FROM b"""


def _line_dedup(min_sites: int = 10) -> str:
    trim = lambda x: f"regexp_replace({x}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
    return f"""
    WITH l AS (SELECT r, doc_id, source, i, ls[i] AS line, {trim('ls[i]')} AS k
               FROM (SELECT r, doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i
                     FROM (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS ls FROM documents))),
    wide AS (SELECT k, min(doc_id) AS first FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {min_sites}),
    kept AS (SELECT l.*, wide.k IS NULL OR (l.doc_id IS NOT DISTINCT FROM first AND row_number() OVER (PARTITION BY r, l.k ORDER BY i) = 1) AS keep
             FROM l LEFT JOIN wide USING (k))
    SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (NOT keep)::bigint AS n_removed,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
    FROM kept GROUP BY r, doc_id
    UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL"""


def _repeated_words(size: int = 35) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT r, i, array_to_string(w[i:i + {size - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d)),
    s AS (SELECT r, i AS p, i AS start FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
    u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    c AS (SELECT r, p, word, coalesce(p - max(start) OVER (PARTITION BY r ORDER BY p) < {size}, false) AS gone FROM u LEFT JOIN s USING (r, p)),
    n AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY r)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN n USING (r)"""


def _repeated_bytes(size: int = 200) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    u AS (SELECT r, b, unnest(range(1, octet_length(b) + 1)) AS p FROM d),
    h AS MATERIALIZED (SELECT r, p, hash(b[p:p + {size - 1}]) AS h FROM u WHERE p + {size - 1} <= octet_length(b)),
    g AS (SELECT r, p, b[p:p + {size - 1}] AS g FROM h JOIN d USING (r) WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
    s AS (SELECT r, p, p AS start FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
    c AS (SELECT r, p, hex(b[p:p]) AS byte, coalesce(p - max(start) OVER (PARTITION BY r ORDER BY p) < {size}, false) AS gone FROM u LEFT JOIN s USING (r, p)),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM c),
    n AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY r)
    SELECT doc_id, octet_length(b)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
      sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM d LEFT JOIN n USING (r)"""


DECONTAMINATE = r"""
    WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
    dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
    bw AS (SELECT coalesce(item_id::varchar, '') AS item, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
    iw AS (SELECT DISTINCT item, z, array_to_string(w[i:i + z - 1], ' ') AS g
           FROM (SELECT item, w, least(len(w), 10) AS z, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT z FROM iw),
    dg AS (SELECT r, i, z, array_to_string(w[i:i + z - 1], ' ') AS g
           FROM (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM dw, sizes)),
    hit AS (SELECT r, i, z, item FROM dg JOIN iw USING (z, g)),
    n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + z)) AS p FROM (SELECT DISTINCT r, i, z FROM hit)) GROUP BY r),
    it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""


TOP_K = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) AS x
               FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint AS score
          FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::int AS rank FROM s) WHERE rank <= 5"""


ORACLE = {
    "op2_line_dedup": _line_dedup(),
    "op3_fm_index": _repeated_words(),
    "op6_quality_rules": _quality(),
    "op8_suffix_levels": _repeated_bytes(),
    "op9_decontaminate": DECONTAMINATE,
    "op12_top_k": TOP_K,
}
