"""The registered queries' results in SQL that another engine runs."""

from __future__ import annotations

from ..operators.text import STOP_WORDS


def _id(letter: str, key: str) -> str:
    return f"'{letter}' || lpad(CAST({key} AS VARCHAR), 7, '0')"


_SEPARATORS = r"""[ \-.,!?:;()\[\]{}"''`/\\\t\n\r*+=<>#@$^&|~]+"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

TOKENS = rf"""
tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_SEPARATORS}'), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)
    AND regexp_full_match(w, '[\p{{L}}\p{{Nd}}_]+') AND NOT regexp_full_match(w, '[0-9]+(e[0-9]+)?|nan|infinity')) AS words
  FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM tokens
), counts AS (
  SELECT doc_id, word, count(*) AS tf FROM placed GROUP BY ALL
), weights AS (
  SELECT word, count(*) AS df, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM counts GROUP BY word
)"""


def _text(select: str) -> str:
    return f"WITH {TOKENS}\n{select}"


HIERARCHY_LOG = f"""
log AS (
  SELECT {_id('r', 'n_regionkey')} AS a, {_id('n', 'n_nationkey')} AS b, 1.0::DOUBLE AS delta, 0::BIGINT AS ts, 1 AS type FROM nation
  UNION ALL SELECT {_id('n', 'c_nationkey')}, {_id('c', 'c_custkey')}, 1.0, 0, 1 FROM customer
  UNION ALL SELECT {_id('n', 's_nationkey')}, {_id('s', 's_suppkey')}, 1.0, 0, 1 FROM supplier
)"""
SUPPLY_LOG = f"""
log AS (
  SELECT {_id('s', 'l_suppkey')} AS a, {_id('p', 'l_partkey')} AS b, l_quantity AS delta, floor(epoch(l_shipdate))::BIGINT AS ts, 0 AS type FROM lineitem
)"""
EVENT_LOG = f"""
log AS (
  SELECT {_id('u', 'user_id')} AS a, 't' || lower(event_type) AS b, value AS delta, floor(epoch(ts))::BIGINT AS ts, 0 AS type FROM events
)"""
FOLD = """
directed AS (
  SELECT a AS src, b AS dst, delta, ts, type FROM log UNION ALL SELECT b, a, delta, ts, type FROM log WHERE type = 0 AND a <> b
), {name} AS (
  SELECT src, dst, sum(delta) AS weight, max(ts) AS last_modified, max(type)::INTEGER AS type FROM directed GROUP BY src, dst
)"""
HIERARCHY = HIERARCHY_LOG + "," + FOLD.format(name="edges")
SUPPLY = SUPPLY_LOG + "," + FOLD.format(name="edges")
EVENTS = EVENT_LOG + "," + FOLD.format(name="edges")
MIXED = (
    HIERARCHY_LOG.replace("log AS", "hlog AS")
    + ","
    + SUPPLY_LOG
    + ","
    + FOLD.format(name="supplied")
    + """, edges AS (
  SELECT a AS src, b AS dst, sum(delta) AS weight, max(ts) AS last_modified, 1 AS type FROM hlog GROUP BY ALL
  UNION ALL SELECT * FROM supplied
)"""
)
COMPILED = """,
node_index AS (
  SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS idx FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
), csr AS (
  SELECT s.idx AS src_idx, d.idx AS dst_idx, weight, last_modified, type FROM edges JOIN node_index s ON src = s.id JOIN node_index d ON dst = d.id
)"""


def _graph(edges: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{edges}{COMPILED}{select}"


_LEAST = """, cc(idx, label) USING KEY (idx) AS (
  SELECT idx, idx FROM node_index
  UNION (SELECT dst_idx, min(c.label) FROM cc c JOIN csr ON src_idx = c.idx JOIN recurring.cc k ON k.idx = dst_idx WHERE c.label < k.label{where} GROUP BY dst_idx)
)"""
_LABELS = _LEAST.format(where="") + ", islands AS (SELECT idx, label AS island FROM cc)"


def _centrality(rounds: int) -> str:
    steps = [
        """, x0 AS MATERIALIZED (
  SELECT idx, island, count(*) OVER (PARTITION BY island) AS n, 1 / sqrt(count(*) OVER (PARTITION BY island)) AS x FROM islands
)"""
    ]
    for k in range(1, rounds + 1):
        steps.append(
            f""", p{k} AS MATERIALIZED (SELECT dst_idx AS idx, sum(weight * x) AS pull FROM csr JOIN x{k - 1} ON src_idx = idx GROUP BY dst_idx),
y{k} AS MATERIALIZED (SELECT idx, island, n, 0.85::DOUBLE * coalesce(pull, 0) + 0.15::DOUBLE / n AS y FROM x{k - 1} LEFT JOIN p{k} USING (idx)),
x{k} AS MATERIALIZED (SELECT idx, island, n, y / sqrt(sum(y * y) OVER (PARTITION BY island)) AS x FROM y{k})"""
        )
    return "".join(steps) + f"\nSELECT idx, round(x, 6) AS centrality FROM x{rounds}"


def _depth(penalty: int, edges: str = MIXED) -> str:
    cost = f"CASE WHEN type = 1 THEN 1 ELSE {penalty} END"
    where = "" if penalty >= 0 else " AND type = 1"
    # No least cost exceeds the bound; a state is left as soon as it does.
    return _graph(
        edges,
        f""", walk AS (
  SELECT idx, 0::BIGINT AS depth FROM node_index WHERE id LIKE 'r%'
  UNION SELECT dst_idx, depth + {cost} FROM walk JOIN csr ON src_idx = idx{where} WHERE depth + {cost} <= 40
), least AS (SELECT idx, min(depth) AS depth FROM walk GROUP BY idx)
SELECT idx, coalesce(depth, -1)::BIGINT AS depth FROM node_index LEFT JOIN least USING (idx)""",
        True,
    )


_CELLS = """
x AS (
  SELECT vec_id AS i, unnest(range(len(embedding)))::BIGINT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings
), w AS (
  SELECT i, j, sin(i * 31.0::DOUBLE + j) AS v FROM range(64) a(i), range(64) b(j)
), bias AS (
  SELECT j, cos(j::DOUBLE) AS v FROM range(64) b(j)
)"""


def _cells(select: str) -> str:
    return f"WITH {_CELLS}\n{select}"


def _pairs(term: str) -> str:
    return f"""SELECT a.vec_id AS vec_id, round({term}, 6) AS {{name}}
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


_DOT = "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * p[2]))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding::DOUBLE[], lambda u: u * u)))"
_EDGES = "SELECT src, dst, round(weight, 6) AS weight, last_modified, type FROM edges"

ORACLES = {
    "vec_dot": _pairs(_DOT).format(name="dot"),
    "vec_l2": _pairs("sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))").format(name="distance"),
    "vec_cosine": _pairs(f"CASE WHEN {_NORM.format('a')} * {_NORM.format('b')} < 1e-10 THEN 0.0 ELSE {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) END").format(name="cosine"),
    "vec_normalize": f"""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, {_NORM.format('embeddings')} AS norm FROM embeddings)
SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN norm < 1e-7 THEN x ELSE x / norm END, 6)) AS unit FROM n""",
    "sha256_digest": "SELECT doc_id, upper(sha256(text)) AS one, upper(sha256(text || lang || source)) AS three FROM documents",
    "knn_topk": """WITH far AS (
  SELECT a.vec_id AS query_id, b.vec_id AS point_id,
    sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id)::INTEGER AS rank, point_id, round(distance, 6) AS distance
FROM far QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) <= 10""",
    "tokenize_counts": _text("SELECT doc_id, word, tf FROM counts"),
    "vocab_first_seen": _text("""SELECT word, (row_number() OVER (ORDER BY doc_id, pos) - 1)::BIGINT AS word_idx FROM (
  SELECT word, doc_id, pos FROM placed QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) = 1
)"""),
    "idf_weights": _text("SELECT word, df, round(idf, 6) AS idf FROM weights"),
    "tfidf": _text("SELECT doc_id, word, tf, round(tf * idf, 6) AS weight FROM counts JOIN weights USING (word)"),
    "tfidf_top_words": _text("""SELECT doc_id, rank, word, weight FROM (
  SELECT doc_id, word, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word)::INTEGER AS rank
  FROM (SELECT doc_id, word, round(tf * idf, 6) AS weight FROM counts JOIN weights USING (word)) WHERE weight > 1e-4
) WHERE rank <= 5"""),
    "encode_counts": _text(""", vocab AS (
  SELECT word, (row_number() OVER (ORDER BY doc_id, pos) - 1)::BIGINT AS word_idx FROM (
    SELECT word, doc_id, pos FROM placed QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) = 1)
)
SELECT doc_id, word_idx, tf FROM counts JOIN vocab USING (word)"""),
    "doc_cosine": _text(""", unit AS (
  SELECT doc_id, word, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM counts
)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum(a.w * b.w), 6) AS cosine
FROM unit a JOIN unit b USING (word) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= 0.8"""),
    "graph_upsert_nodes": f"""WITH log AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'c' END || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS id, o_orderpriority AS data, o_orderkey AS seq FROM orders
)
SELECT arg_min(id, seq) AS id, arg_min(data, seq) AS data FROM log GROUP BY lower(id)""",
    "graph_lookup": """WITH nodes AS (SELECT DISTINCT 'c' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS id FROM orders),
asked AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'c' END || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS asked FROM customer)
SELECT asked, id, id IS NOT NULL AS found FROM asked LEFT JOIN nodes ON lower(asked) = id""",
    "graph_accumulate": f"WITH {SUPPLY}\n{_EDGES}",
    "graph_accumulate_events": f"WITH {EVENTS}\n{_EDGES}",
    "stream_accumulate": f"WITH {EVENTS}\n{_EDGES}",
    "graph_add_edges": f"WITH {HIERARCHY}\n{_EDGES}",
    "graph_merge": f"WITH {EVENTS}\nSELECT src, dst, round(2 * weight, 6) AS weight, last_modified, type FROM edges",
    "graph_remove_nodes": f"""WITH {HIERARCHY}, gone AS (SELECT {_id('n', 'n_nationkey')} AS id FROM nation WHERE n_regionkey = 1)
{_EDGES} WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)""",
    "graph_neighbours": f"WITH {HIERARCHY}\n{_EDGES} WHERE src = 'n0000007'",
    "graph_node_project": f"WITH {MIXED}{COMPILED}\nSELECT id, upper(substr(id, 1, 1)) AS kind, length(id)::INTEGER AS width FROM node_index",
    "graph_decay_edges": f"""WITH {EVENTS}, aged AS (
  SELECT *, exp(-0.05::DOUBLE * greatest(((SELECT max(last_modified) FROM edges) - last_modified)::DOUBLE / 86400.0, 0)) AS m FROM edges
)
SELECT src, dst, round(weight * CASE WHEN m < 1e-7 THEN 0 ELSE m END, 6) AS weight, last_modified, type FROM aged""",
    "graph_compile_nodes": _graph(MIXED, "\nSELECT idx, id FROM node_index"),
    "graph_compile_edges": _graph(MIXED, "\nSELECT src_idx, dst_idx, weight, last_modified, type FROM csr"),
    "graph_row_ptr": _graph(
        MIXED,
        """, degree AS (SELECT idx, count(src_idx) AS d FROM node_index LEFT JOIN csr ON src_idx = idx GROUP BY idx)
SELECT idx, (sum(d) OVER (ORDER BY idx) - d)::BIGINT AS row_start, (sum(d) OVER (ORDER BY idx))::BIGINT AS row_end FROM degree""",
    ),
    "graph_slice": _graph(
        MIXED,
        """, kept AS (SELECT idx, (row_number() OVER (ORDER BY idx) - 1)::BIGINT AS fresh FROM node_index WHERE id NOT LIKE 'c%')
SELECT a.fresh AS src_idx, b.fresh AS dst_idx, weight, last_modified, type FROM csr JOIN kept a ON src_idx = a.idx JOIN kept b ON dst_idx = b.idx""",
    ),
    "graph_boundary": _graph(
        MIXED,
        """, inside AS (SELECT idx FROM node_index WHERE id LIKE 's%')
SELECT src_idx AS source_index, dst_idx AS target_index, weight FROM csr WHERE src_idx IN (FROM inside) AND dst_idx NOT IN (FROM inside)""",
    ),
    "graph_weights": _graph(MIXED, "\nSELECT 0::BIGINT AS i, (row_number() OVER (ORDER BY src_idx, dst_idx) - 1)::BIGINT AS j, weight AS v FROM csr"),
    "graph_jaccard": _graph(
        SUPPLY,
        """, supplied AS (SELECT csr.* FROM csr JOIN node_index ON idx = src_idx WHERE id LIKE 's%'),
degree AS (SELECT src_idx, count(*) AS d FROM supplied GROUP BY src_idx), met AS (
  SELECT a.src_idx AS u, b.src_idx AS v, count(*) AS n FROM supplied a JOIN supplied b USING (dst_idx) WHERE a.src_idx < b.src_idx GROUP BY ALL
)
SELECT u, v, round(n / (p.d + q.d - n)::DOUBLE, 6) AS similarity FROM met JOIN degree p ON p.src_idx = u JOIN degree q ON q.src_idx = v""",
    ),
    "components_weak": _graph(SUPPLY, _LABELS + "\nSELECT idx, island AS component FROM islands", True),
    "components_weak_threshold": _graph(SUPPLY, _LEAST.format(where=" AND weight > 120") + "\nSELECT idx, label AS component FROM cc", True),
    "components_directed": _graph(HIERARCHY, _LABELS + "\nSELECT idx, island AS component FROM islands", True),
    "dependency_depth": _depth(3),
    "dependency_depth_structural": _depth(-1),
    "flow_rank": _graph(
        HIERARCHY,
        """, walk AS (
  SELECT idx, 0 AS rank FROM node_index UNION SELECT dst_idx, rank + 1 FROM walk JOIN csr ON src_idx = idx
)
SELECT idx, max(rank)::INTEGER AS rank FROM walk GROUP BY idx""",
        True,
    ),
    "cycle_check": f"""WITH RECURSIVE {HIERARCHY_LOG}, edges AS (
  SELECT a, b FROM log UNION SELECT {_id('n', 'n_nationkey')}, {_id('r', 'n_regionkey')} FROM nation WHERE n_regionkey = 1
), reach AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), looped AS (SELECT a AS id FROM reach WHERE a = b)
SELECT a AS src, b AS dst FROM edges WHERE a IN (FROM looped) AND b IN (FROM looped)""",
    "centrality_k5": _graph(SUPPLY, _LABELS + _centrality(5), True),
    "snapshot_roundtrip": _graph(MIXED, "\nSELECT src_idx, dst_idx, weight, last_modified, type FROM csr"),
    "transpose": _cells("SELECT j AS i, i AS j, v FROM x"),
    "matmul": _cells("SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM x a JOIN x b USING (i) GROUP BY a.j, b.j"),
    "matmul_grad": _cells("""SELECT 'a' AS operand, x.i AS i, w.i AS j, round(sum(x.v * w.v), 6) AS v FROM x JOIN w USING (j) GROUP BY x.i, w.i
UNION ALL SELECT 'b', a.j, b.j, round(sum(a.v * b.v), 6) FROM x a JOIN x b USING (i) GROUP BY a.j, b.j"""),
    "add_broadcast": _cells("SELECT x.i, x.j, round(x.v + bias.v, 6) AS v FROM x JOIN bias USING (j)"),
    "add_broadcast_grad": _cells("SELECT 0::BIGINT AS i, j, round(sum(v), 6) AS v FROM x GROUP BY j"),
    "relu": _cells("SELECT i, j, CASE WHEN v > 0 THEN v ELSE 0 END AS v FROM x"),
    "relu_grad": _cells("SELECT i, j, CASE WHEN v > 0 THEN v ELSE 0 END AS v FROM x"),
    "tanh": _cells("SELECT i, j, round(tanh(v), 6) AS v FROM x"),
    "tanh_grad": _cells("SELECT i, j, round(v * (1 - tanh(v) * tanh(v)), 6) AS v FROM x"),
    "tensor_decay": _cells("SELECT i, j, round(v * exp(-0.005::DOUBLE * 138.629), 6) AS v FROM x"),
    "linear_forward": _cells("SELECT m.i, m.j, round(m.v + bias.v, 6) AS v FROM (SELECT x.i, w.j, sum(x.v * w.v) AS v FROM x JOIN w ON x.j = w.i GROUP BY x.i, w.j) m JOIN bias USING (j)"),
    "sgd_step": _cells("""SELECT w.i, w.j, round(w.v - 0.01::DOUBLE * g.v, 6) AS v FROM w
JOIN (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (i) GROUP BY a.j, b.j) g USING (i, j)"""),
    "random_normal": """SELECT i, j, round(sqrt(-2.0::DOUBLE * ln(((('0x' || substr(md5('42:' || i || ':' || j || ':0'), 1, 13))::BIGINT + 1.0::DOUBLE) / 4503599627370497.0::DOUBLE))) * cos(2.0::DOUBLE * pi() * ((('0x' || substr(md5('42:' || i || ':' || j || ':1'), 1, 13))::BIGINT + 1.0::DOUBLE) / 4503599627370497.0::DOUBLE)), 6) AS v
FROM range(100) a(i), range(64) b(j)""",
    "zeros": "SELECT i, j, 0.0::DOUBLE AS v FROM range(100) a(i), range(64) b(j)",
}
