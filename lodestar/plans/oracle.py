"""DuckDB SQL building blocks for the oracle twins of registered queries.

Every block mirrors one Spark operator on the same decorated input.  The regular
expressions are the same strings as in ``functions.patterns``: the explicit
whitespace class is valid in both Java and RE2.
"""

from __future__ import annotations

from ..functions import patterns as P

WS = P.WS_RE2
STRIP = P.STRIP_RE2
TOKEN_WS = P.TOKEN_WS_RE2
DOT_RUN = P.DOT_RUN

UNIQUE_TITLE = "source || '_' || CAST(doc_id AS VARCHAR)"
SHARED_TITLE = "'t' || CAST(doc_id // 3 AS VARCHAR)"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda x: x <> '')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"


def clean(expr: str) -> str:
    return f"regexp_replace({expr}, '{DOT_RUN}', '', 'g')"


NOISE_SUFFIX = "CASE doc_id % 3 WHEN 0 THEN ' Table 1' WHEN 1 THEN ' suitable' ELSE '' END"


def corpus_ctes(title: str = UNIQUE_TITLE, noise: bool = False) -> str:
    """``docs`` (cleaned, non-blank corpus); ``noise`` appends the noise-tag decoration."""
    text = f"text || {NOISE_SUFFIX}" if noise else "text"
    return f"""
docs_raw AS (
  SELECT doc_id, {title} AS title, CAST(2022 + doc_id % 3 AS INTEGER) AS year, source,
         {clean(text)} AS text
  FROM documents),
docs AS (SELECT * FROM docs_raw WHERE {strip('text')} <> '')"""


def chunk_ctes(size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP, src: str = "docs") -> str:
    """``chunks(doc_id, title, year, source, chunk_index, chunk_content, chunk_tokens, n_chunks)``."""
    stride = size - overlap
    return f"""
tok AS (SELECT doc_id, title, year, source, regexp_extract_all(text, '{TOKEN_WS}') AS t FROM {src}),
tok_n AS (SELECT *, CAST(ceil(len(t) / {stride}.0) AS BIGINT) AS n_chunks FROM tok WHERE len(t) > 0),
idx AS (SELECT doc_id, title, year, source, t, n_chunks, unnest(range(0, n_chunks)) AS chunk_index FROM tok_n),
chunks AS (
  SELECT doc_id, title, year, source, chunk_index, n_chunks,
         array_to_string(t[chunk_index * {stride} + 1 : chunk_index * {stride} + {size}], '') AS chunk_content,
         least({size}, len(t) - chunk_index * {stride}) AS chunk_tokens
  FROM idx)"""


def embed_ctes(name: str, src: str, id_col: str, text_col: str, dim: int = 384) -> str:
    """Sparse hashed embedding ``{name}_vec(id, bucket, v FLOAT)`` and squared norms ``{name}_n2(id, n2)``."""
    return f"""
{name}_w AS (SELECT {id_col} AS id, unnest({words(text_col)}) AS w FROM {src}),
{name}_c AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % {dim} AS BIGINT) AS bucket, count(*) AS c
             FROM {name}_w GROUP BY ALL),
{name}_nn AS (SELECT id, sqrt(sum(c * c)) AS nn FROM {name}_c GROUP BY id),
{name}_vec AS (SELECT id, bucket, CAST(c / nn AS FLOAT) AS v FROM {name}_c JOIN {name}_nn USING (id)),
{name}_n2 AS (SELECT s.{id_col} AS id, coalesce(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), 0) AS n2
              FROM {src} s LEFT JOIN {name}_vec ON {name}_vec.id = s.{id_col} GROUP BY s.{id_col})"""


def sparse_knn_ctes(q: str, c: str, k: int) -> str:
    """``knn(qid, cid, d, rank)`` over two sparse embeddings by squared L2, top ``k``."""
    return f"""
dots AS (SELECT qv.id AS qid, cv.id AS cid, sum(CAST(qv.v AS DOUBLE) * CAST(cv.v AS DOUBLE)) AS dot
         FROM {q}_vec qv JOIN {c}_vec cv USING (bucket) GROUP BY ALL),
knn_pairs AS (SELECT qn.id AS qid, cn.id AS cid, greatest(qn.n2 + cn.n2 - 2 * coalesce(dots.dot, 0), 0) AS d
          FROM {q}_n2 qn CROSS JOIN {c}_n2 cn LEFT JOIN dots ON dots.qid = qn.id AND dots.cid = cn.id),
knn AS (SELECT * FROM (
          SELECT qid, cid, d, row_number() OVER (PARTITION BY qid ORDER BY round(d, 10), cid) AS rank FROM knn_pairs)
        WHERE rank <= {k})"""


def dense_sq_l2(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))))")


def legal_redact(expr: str, keywords: str = "IPR|copyright|patents|trademarks|terms of use") -> str:
    return strip(f"regexp_replace({expr}, '(?i)({keywords}).*', '', 'g')")


def title_name(expr: str) -> str:
    """The Spark side's extract_document_name in RE2."""
    ws = WS[1:-1]
    return (f"CASE WHEN {strip(expr)} = '' THEN NULL "
            f"ELSE nullif(regexp_extract({expr}, '(?i)(?:document|file)[{ws}]+([\\w.-]+)', 1), '') END")


COMPOSED = """CASE item_id % 6 WHEN 0 THEN 'see document t3 please ' || text WHEN 1 THEN 'open FILE t3. ' || text
     WHEN 2 THEN 'profile t3 x ' || text WHEN 3 THEN 'documents t3 ' || text ELSE 'no name ' || text END"""

#: composed questions and, for every sixth, one more row of blanks
QUESTIONS = f"""(SELECT item_id, {COMPOSED} AS q FROM benchmark
       UNION ALL SELECT -1 - item_id AS item_id, '  ' AS q FROM benchmark WHERE item_id % 6 = 5)"""


def shared_collection_ctes() -> str:
    """``coll``: chunks of 64/16 tokens under shared titles, first per chunk id by (year, source, index, doc)."""
    return f"""{corpus_ctes(SHARED_TITLE)},
{chunk_ctes(64, 16)},
cks AS (SELECT *, title || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id FROM chunks),
coll AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY year, source, chunk_index, doc_id) AS rn FROM cks)
  WHERE rn = 1)"""


def questions_ctes() -> str:
    """``qs(item_id, query)``: composed benchmark questions, stripped, blank ones rejected."""
    return f"""qs AS (SELECT item_id, {strip('q')} AS query FROM {QUESTIONS}
       WHERE {strip('q')} <> ''),
names AS (SELECT item_id, {title_name('query')} AS name FROM qs)"""


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS reference, a.text AS generated
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def bleu_ctes() -> str:
    return f"""
btk AS (SELECT conv_id, turn, {words('reference')} AS r, {words('generated')} AS g FROM pairs),
bn AS (SELECT conv_id, turn, r, g, unnest(range(1, 5)) AS n FROM btk),
gr AS (SELECT conv_id, turn, n, array_to_string(r[i + 1 : i + n], ' ') AS gram
       FROM (SELECT conv_id, turn, n, r, unnest(range(0, len(r) - n + 1)) AS i FROM bn)),
gg AS (SELECT conv_id, turn, n, array_to_string(g[i + 1 : i + n], ' ') AS gram
       FROM (SELECT conv_id, turn, n, g, unnest(range(0, len(g) - n + 1)) AS i FROM bn)),
cr AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM gr GROUP BY ALL),
cg AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM gg GROUP BY ALL),
clip AS (SELECT cg.conv_id, cg.turn, cg.n, sum(least(cg.c, coalesce(cr.c, 0))) AS m
         FROM cg LEFT JOIN cr USING (conv_id, turn, n, gram) GROUP BY ALL),
bw AS (SELECT b.conv_id, b.turn, len(b.r) AS ref_len, len(b.g) AS hyp_len,
              coalesce(c1.m, 0) AS m1, coalesce(c2.m, 0) AS m2, coalesce(c3.m, 0) AS m3, coalesce(c4.m, 0) AS m4
       FROM btk b
       LEFT JOIN clip c1 ON c1.conv_id = b.conv_id AND c1.turn = b.turn AND c1.n = 1
       LEFT JOIN clip c2 ON c2.conv_id = b.conv_id AND c2.turn = b.turn AND c2.n = 2
       LEFT JOIN clip c3 ON c3.conv_id = b.conv_id AND c3.turn = b.turn AND c3.n = 3
       LEFT JOIN clip c4 ON c4.conv_id = b.conv_id AND c4.turn = b.turn AND c4.n = 4),
bleu AS (SELECT conv_id, turn, CASE WHEN m1 = 0 THEN 0.0 ELSE
           (CASE WHEN hyp_len > ref_len THEN 1.0 ELSE exp(1.0 - ref_len / hyp_len) END) *
           exp(({_lp(1)} + {_lp(2)} + {_lp(3)} + {_lp(4)}) / 4) END AS bleu FROM bw)"""


def _lp(n: int) -> str:
    den = f"greatest(hyp_len - {n} + 1, 1)"
    return f"ln(CASE WHEN m{n} = 0 THEN 0.1 / {den} ELSE m{n} / {den} END)"


def rouge_ctes() -> str:
    tok = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""
rtk AS (SELECT conv_id, turn, {tok.format(x='reference')} AS r, {tok.format(x='generated')} AS g FROM pairs),
rr AS (SELECT conv_id, turn, unnest(r) AS tok FROM rtk),
rg AS (SELECT conv_id, turn, unnest(g) AS tok FROM rtk),
rcr AS (SELECT conv_id, turn, tok, count(*) AS c FROM rr GROUP BY ALL),
rcg AS (SELECT conv_id, turn, tok, count(*) AS c FROM rg GROUP BY ALL),
rin AS (SELECT rcg.conv_id, rcg.turn, sum(least(rcg.c, coalesce(rcr.c, 0))) AS inter
        FROM rcg LEFT JOIN rcr USING (conv_id, turn, tok) GROUP BY ALL),
rpr AS (SELECT t.conv_id, t.turn, CAST(coalesce(i.inter, 0) AS DOUBLE) / greatest(len(t.g), 1) AS p,
               CAST(coalesce(i.inter, 0) AS DOUBLE) / greatest(len(t.r), 1) AS rc
        FROM rtk t LEFT JOIN rin i USING (conv_id, turn)),
rouge AS (SELECT conv_id, turn, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS rouge1 FROM rpr)"""


def sparse_cosine(a: str, b: str, out: str) -> str:
    """``{out}(id, cos)`` between two sparse embeddings keyed by the same id; null for a zero vector."""
    return f"""
{out}_dot AS (SELECT x.id, sum(CAST(x.v AS DOUBLE) * CAST(y.v AS DOUBLE)) AS dot
              FROM {a}_vec x JOIN {b}_vec y ON x.id = y.id AND x.bucket = y.bucket GROUP BY x.id),
{out} AS (SELECT na.id, CASE WHEN na.n2 > 0 AND nb.n2 > 0 THEN coalesce(d.dot, 0) / (sqrt(na.n2) * sqrt(nb.n2)) END AS cos
          FROM {a}_n2 na JOIN {b}_n2 nb ON na.id = nb.id LEFT JOIN {out}_dot d ON d.id = na.id)"""


def noise_filter_ctes(src: str, group: str, out: str) -> str:
    """``{out}``: rows of ``src`` without a noise tag, or all rows of a group that has only noise."""
    tags = " OR ".join(f"contains(lower(content), '{t}')" for t in ("table", "figure", "list", "appendix"))
    return f"""
{out}_f AS (SELECT *, NOT ({tags}) AS keep FROM {src}),
{out}_g AS (SELECT *, bool_or(keep) OVER (PARTITION BY {group}) AS any_keep FROM {out}_f),
{out} AS (SELECT * EXCLUDE (keep, any_keep) FROM {out}_g WHERE keep OR NOT any_keep)"""
