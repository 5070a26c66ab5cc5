"""The derived tables in DuckDB SQL, written independently of the DataFrame code they check."""

from __future__ import annotations


def _back(at: str) -> str:
    inside = lambda k: f"hex(d[{at} + 1 - {k}:{at} + 1 - {k}]) BETWEEN '80' AND 'BF'"
    return f"({at} - CASE WHEN {at} <= 0 OR {at} >= n OR NOT {inside(0)} THEN 0 WHEN NOT {inside(1)} THEN 1 WHEN NOT {inside(2)} THEN 2 ELSE 3 END)"


def _cut(size: int, overlap: int) -> str:
    step = size - overlap

    def end(s: str) -> str:
        return f"CASE WHEN {s} + {size} >= n THEN n WHEN {_back(f'({s} + {size})')} > {s} THEN {_back(f'({s} + {size})')} ELSE {s} + {size} END"

    nxt = f"CASE WHEN {_back(f'(s + {step})')} > s THEN {_back(f'(s + {step})')} ELSE s + {step} END"
    return f"""
cut(doc_id, user_id, kb_id, d, n, ordinal, s, e) AS (
  SELECT doc_id, source, lang, d, n, 0, 0, {end('0')} FROM (SELECT doc_id, source, lang, encode(text) AS d, octet_length(encode(text)) AS n FROM documents WHERE text <> '') AS q
  UNION ALL
  SELECT doc_id, user_id, kb_id, d, n, ordinal + 1, t, {end('t')} FROM (SELECT *, {nxt} AS t FROM cut WHERE e < n) AS q
)"""


PARTS = {
    "passages": _cut(3000, 300).replace("cut", "pcut") + """,
passages AS (SELECT doc_id * 100000 + ordinal AS chunk_id, doc_id AS document_id, user_id, kb_id, ordinal, decode(d[s + 1:e]) AS text, CAST(floor((e - s) / 4) AS INTEGER) AS token_count, s AS char_start, e AS char_end FROM pcut)""",
    "chunks": _cut(600, 60) + """,
chunks AS MATERIALIZED (SELECT doc_id * 100000 + ordinal AS chunk_id, doc_id AS document_id, user_id, kb_id, ordinal, decode(d[s + 1:e]) AS text, CAST(floor((e - s) / 4) AS INTEGER) AS token_count, s AS char_start, e AS char_end FROM cut)""",
    "mentions": """
found AS (SELECT chunk_id, document_id, user_id, kb_id, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS m, string_split_regex(text, '[A-Z][a-z]{3,}') AS p FROM chunks),
each AS (SELECT chunk_id, document_id, user_id, kb_id, m, p, unnest(range(len(m))) AS k FROM found),
raw_mentions AS (SELECT chunk_id * 10000 + k AS mention_id, chunk_id, document_id, user_id, kb_id, m[k + 1] AS text,
  coalesce(list_sum(list_transform(p[1:k + 1], lambda x: octet_length(encode(x)))), 0) + coalesce(list_sum(list_transform(m[1:k], lambda x: octet_length(encode(x)))), 0) AS char_start FROM each),
mentions AS MATERIALIZED (SELECT mention_id, chunk_id, document_id, user_id, kb_id, ['person', 'organization', 'location', 'concept', 'event', 'work_of_art', 'date_time'][(ascii(right(text, 1)) - 97) % 7 + 1] AS entity_type,
  text, char_start, char_start + length(text) AS char_end, (length(text) * 7 % 10) / 10.0::DOUBLE AS score FROM raw_mentions
  WHERE length(text) * 7 % 10 >= 5 AND lower(text) NOT IN ('i','me','my','mine','myself','we','us','our','ours','ourselves','you','your','yours','yourself','yourselves','he','him','his','himself','she','her','hers','herself','it','its','itself','they','them','their','theirs','themselves','someone','anyone','everyone','nobody','something','anything','everything','nothing','here','there','no one'))""",
    "resolved": """
resolved AS MATERIALIZED (SELECT *, lower(text) AS normalized_text, min(mention_id) OVER (PARTITION BY user_id, kb_id, lower(text), entity_type) AS canonical_id FROM mentions)""",
    "canonical": """
canonical AS MATERIALIZED (SELECT user_id, kb_id, canonical_id, arg_min(text, mention_id) AS canonical_text, min(normalized_text) AS normalized_text, min(entity_type) AS entity_type, count(*) AS mention_count, count(DISTINCT document_id) AS document_count FROM resolved GROUP BY user_id, kb_id, canonical_id)""",
    "edges": """
few AS (SELECT * FROM mentions QUALIFY count(*) OVER (PARTITION BY chunk_id) <= 25),
edges AS MATERIALIZED (SELECT x.chunk_id, x.document_id, x.user_id, x.kb_id, x.mention_id AS a, y.mention_id AS b, 1 AS co_occurrence_count,
  CASE (x.mention_id + y.mention_id) % 3 WHEN 0 THEN 'linked' WHEN 1 THEN 'none' END AS relation_type FROM few x JOIN few y ON x.chunk_id = y.chunk_id AND x.mention_id < y.mention_id)""",
    "cross": """
crossed AS (SELECT user_id, kb_id, canonical_id AS a, lead(canonical_id, 7) OVER (PARTITION BY user_id, kb_id ORDER BY canonical_id) AS b FROM canonical),
cross_edges AS MATERIALIZED (SELECT *, CASE WHEN a % 2 = 0 THEN 'linked' ELSE 'none' END AS relation_type FROM crossed WHERE b IS NOT NULL)""",
    "lifted": """
lifted AS MATERIALIZED (SELECT e.*, least(p.canonical_id, q.canonical_id) AS x, greatest(p.canonical_id, q.canonical_id) AS y FROM edges e JOIN resolved p ON p.mention_id = e.a JOIN resolved q ON q.mention_id = e.b WHERE p.canonical_id <> q.canonical_id)""",
    "graph": """
total AS (SELECT user_id, kb_id, sum(mention_count)::DOUBLE AS n FROM canonical GROUP BY ALL),
pairs AS MATERIALIZED (SELECT user_id, kb_id, x AS a, y AS b, sum(co_occurrence_count) AS co, coalesce(bool_or(relation_type IS NOT NULL AND relation_type <> 'none'), false) AS confirmed, coalesce(bool_or(relation_type = 'none'), false) AS none_found,
  count(DISTINCT document_id) AS document_count, max(relation_type) FILTER (WHERE relation_type <> 'none') AS relation_type FROM lifted GROUP BY user_id, kb_id, x, y),
scored AS (SELECT p.*, CASE WHEN co < 2 THEN 0 ELSE log2(co / (ca.mention_count::DOUBLE * cb.mention_count::DOUBLE / t.n)) END AS pmi
  FROM pairs p JOIN canonical ca ON ca.canonical_id = p.a JOIN canonical cb ON cb.canonical_id = p.b JOIN total t ON t.user_id = p.user_id AND t.kb_id = p.kb_id),
graph_edges AS MATERIALIZED (SELECT *, CASE WHEN pmi > 0 THEN pmi * CASE WHEN confirmed THEN 2.0::DOUBLE WHEN none_found THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 1.0::DOUBLE END AS weight FROM scored WHERE pmi > 0 OR confirmed)""",
}
NEEDS = {"passages": [], "chunks": [], "mentions": ["chunks"], "resolved": ["mentions"], "canonical": ["resolved"], "edges": ["mentions"], "cross": ["canonical"], "lifted": ["edges", "resolved"], "graph": ["lifted", "canonical"]}


def sql(select: str, *parts: str, extra: str = "") -> str:
    """``select`` over the named derived tables; ``extra`` holds more CTEs of the query's own."""
    order: list[str] = []

    def add(p: str) -> None:
        for q in NEEDS[p]:
            add(q)
        if p not in order:
            order.append(p)

    for p in parts:
        add(p)
    ctes = [PARTS[p].strip() for p in order] + ([extra.strip()] if extra else [])
    return (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + select
