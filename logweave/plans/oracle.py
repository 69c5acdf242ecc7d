"""DuckDB SQL for every registered query (the correctness oracle).

Each query starts from the same table mappings as ``logweave.sources.tables``
written as SQL CTEs, then states the operator's semantics independently of
the Spark code.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong word in the library shows.
# Characters that Python's str.strip() removes:
WS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
      "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
      "\u2028\u2029\u202f\u205f\u3000")
# Stop words (general English, then commit-message noise words):
STOP = """
    a an the is are was were be been being have has had do does did
    will would could should may might shall can need must
    this that these those i we you he she it they
    to of in on at by for with from as into and or but not no
    s t re ve ll d m
    feat fix chore docs style refactor test perf ci build revert merge
    update add remove change bump version release minor major patch
    pr pull request branch commit initial first
"""


def _strip(expr: str) -> str:
    return f"trim({expr}, '{WS}')"


STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP.split()) + "]"


def tokens_sql(text: str) -> str:
    camel = f"regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return (f"list_filter(regexp_extract_all(lower({camel}), '[a-z][a-z0-9]*'), "
            f"lambda t: length(t) > 1 AND NOT list_contains({STOP_LIST}, t))")


SUBJECT = _strip("split_part(text, chr(10), 1)")
BODY = _strip("coalesce(array_to_string(string_split(text, chr(10))[2:], chr(10)), '')")

COMMITS = {
    "documents": f"""
      SELECT source AS repo, 'HEAD' AS ref, CAST(doc_id AS BIGINT) AS seq,
             lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sha, lang AS author,
             lang || '@example.com' AS email,
             TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS BIGINT)) AS ts,
             {SUBJECT} AS subject, {BODY} AS body
      FROM documents""",
    "orders": """
      SELECT o_orderstatus AS repo, 'HEAD' AS ref, CAST(o_orderkey AS BIGINT) AS seq,
             lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS sha,
             CAST(o_custkey AS VARCHAR) AS author,
             'c' || CAST(o_custkey AS VARCHAR) || '@example.com' AS email,
             CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS subject, '' AS body
      FROM orders""",
    "events": """
      SELECT event_type AS repo, 'HEAD' AS ref, CAST(event_id AS BIGINT) AS seq,
             lpad(CAST(event_id AS VARCHAR), 12, '0') AS sha,
             CAST(user_id AS VARCHAR) AS author,
             'u' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
             CAST(ts AS TIMESTAMP) AS ts, coalesce(props, '') AS subject, '' AS body
      FROM events""",
    "conversations": f"""
      SELECT CAST(conv_id AS VARCHAR) AS repo, 'HEAD' AS ref, CAST(turn AS BIGINT) AS seq,
             lpad(CAST(conv_id AS VARCHAR), 12, '0') || lpad(CAST(turn AS VARCHAR), 4, '0') AS sha,
             role AS author, role || '@example.com' AS email,
             TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS BIGINT)) AS ts,
             {SUBJECT} AS subject, {BODY} AS body
      FROM conversations""",
}

# the log of each (repo, ref) under one key, odd positions on `dev`
COMMITS["documents_on_refs"] = f"""
      SELECT * REPLACE ('{{' || CASE WHEN repo IS NULL THEN '' ELSE '"repo":"' || repo || '",' END
                        || '"ref":"' || CASE WHEN seq % 2 = 1 THEN 'dev' ELSE 'main' END || '"}}' AS repo)
      FROM ({COMMITS["documents"]})"""
REF_COLUMNS = """nullif(regexp_extract(repo, '"repo":"([^"]*)"', 1), '') AS repo, regexp_extract(repo, '"ref":"([^"]*)"', 1) AS ref"""

NUMSTAT = """
  SELECT o.o_orderstatus AS repo, 'HEAD' AS ref, CAST(l.l_orderkey AS BIGINT) AS commit_seq,
         CAST(l.l_linenumber AS BIGINT) AS line_no,
         CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE CAST(l.l_quantity AS BIGINT) END AS added,
         CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE CAST(l.l_linenumber AS BIGINT) END AS deleted,
         concat_ws('/', 'src', p.p_brand, p.p_type, p.p_name, CAST(l.l_partkey AS VARCHAR)) AS path
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  JOIN orders o ON l.l_orderkey = o.o_orderkey"""


def with_commits(source: str, body: str, extra_ctes: str = "") -> str:
    ctes = f"commits AS ({COMMITS[source]})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def with_numstat(body: str, commits_source: str | None = None, extra_ctes: str = "") -> str:
    ctes = f"numstat AS ({NUMSTAT})"
    if commits_source:
        ctes = f"commits AS ({COMMITS[commits_source]}),\n" + ctes
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def text_ctes(source: str = "documents", threshold: float = 0.2) -> str:
    """CTEs docs, toks, postings, edges (X1, X3) for a commit source."""
    msg = _strip("subject || chr(10) || chr(10) || coalesce(body, '')")
    return f"""commits AS ({COMMITS[source]}),
docs AS (SELECT repo, seq, {msg} AS message FROM commits),
tokl AS (SELECT repo, seq, {tokens_sql('message')} AS l FROM docs),
toks AS (SELECT repo, seq, unnest(l) AS term, unnest(range(len(l))) AS pos FROM tokl),
cnt AS (SELECT repo, seq, term, count(*) AS cnt FROM toks GROUP BY ALL),
nd AS (SELECT repo, count(*) AS n_docs FROM docs GROUP BY repo),
dfc AS (SELECT repo, term, count(*) AS df FROM cnt GROUP BY ALL),
rawp AS (SELECT c.repo, c.seq, c.term, c.cnt, d.df,
                c.cnt * (ln((1.0 + n.n_docs) / (1.0 + d.df)) + 1.0) AS raw
         FROM cnt c JOIN dfc d ON c.repo = d.repo AND c.term = d.term JOIN nd n ON c.repo = n.repo),
postings AS (SELECT repo, seq, term, cnt, df,
                    raw / sqrt(sum(raw * raw) OVER (PARTITION BY repo, seq)) AS weight FROM rawp),
sims AS (SELECT a.repo, a.seq AS seq_a, b.seq AS seq_b, sum(a.weight * b.weight) AS sim
         FROM postings a JOIN postings b ON a.repo = b.repo AND a.term = b.term AND a.seq < b.seq
         GROUP BY ALL),
edges AS (SELECT * FROM sims WHERE sim > {threshold})"""


def leader_ctes(min_size: int = 2) -> str:
    """CTEs seeds, assign, clusters, ranked (C2, C3) as a sequential walk over
    each repo's rows in the order of their digests carrying the list of seeds so far."""
    return f"""ranked_rows AS (SELECT repo, seq, row_number() OVER (PARTITION BY repo ORDER BY md5(repo || ':' || seq)[1:15], seq) AS rn FROM docs),
linked AS (SELECT repo, seq_a AS seed, seq_b AS seq, sim FROM edges UNION ALL SELECT repo, seq_b, seq_a, sim FROM edges),
nb AS (SELECT repo, seq, list(seed) AS near FROM linked GROUP BY ALL),
walk AS (
  SELECT repo, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS seeds FROM (SELECT DISTINCT repo FROM docs)
  UNION ALL
  SELECT w.repo, w.rn + 1,
         CASE WHEN len(list_intersect(coalesce(n.near, CAST([] AS BIGINT[])), w.seeds)) > 0 THEN w.seeds
              ELSE list_append(w.seeds, r.seq) END
  FROM walk w JOIN ranked_rows r ON r.repo = w.repo AND r.rn = w.rn + 1
  LEFT JOIN nb n ON n.repo = r.repo AND n.seq = r.seq),
last_walk AS (SELECT repo, max(rn) AS rn FROM ranked_rows GROUP BY repo),
seeds AS (SELECT w.repo, unnest(w.seeds) AS seed FROM walk w JOIN last_walk l ON w.repo = l.repo AND w.rn = l.rn),
best AS (SELECT repo, seq, seed_seq FROM (
           SELECT e.repo, e.seq, e.seed AS seed_seq,
                  row_number() OVER (PARTITION BY e.repo, e.seq ORDER BY round(e.sim, 9) DESC, e.seed) AS k
           FROM linked e JOIN seeds s ON s.repo = e.repo AND s.seed = e.seed) WHERE k = 1),
assign AS (SELECT d.repo, d.seq, coalesce(s.seed, b.seed_seq) AS seed_seq
           FROM docs d LEFT JOIN seeds s ON s.repo = d.repo AND s.seed = d.seq
                       LEFT JOIN best b ON b.repo = d.repo AND b.seq = d.seq),
clusters AS (SELECT repo, seed_seq, size,
                    row_number() OVER (PARTITION BY repo ORDER BY size DESC, seed_seq) AS cluster_id
             FROM (SELECT repo, seed_seq, count(*) AS size FROM assign GROUP BY ALL) WHERE size >= {min_size}),
ranked AS (SELECT a.repo, a.seq, a.seed_seq, c.cluster_id, c.size
           FROM assign a LEFT JOIN clusters c ON a.repo = c.repo AND a.seed_seq = c.seed_seq)"""


def keyword_ctes(k: int = 8) -> str:
    return f"""kw AS (SELECT repo, cluster_id, rank, term, weight FROM (
         SELECT *, row_number() OVER (PARTITION BY repo, cluster_id ORDER BY round(weight, 9) DESC, term) AS rank
         FROM (SELECT p.repo, r.cluster_id, p.term, sum(p.weight) / any_value(r.size) AS weight
               FROM postings p JOIN ranked r ON p.repo = r.repo AND p.seq = r.seq
               WHERE r.cluster_id IS NOT NULL GROUP BY ALL) WHERE weight > 0)
       WHERE rank <= {k}),
kwl AS (SELECT repo, cluster_id, list(term ORDER BY rank) AS keywords FROM kw GROUP BY ALL)"""
