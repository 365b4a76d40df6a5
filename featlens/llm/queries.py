"""The registered queries of the text operators: one per operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.llm import conversations, jaccard, mix, neighbours, passages, pii, piecewise, quality, spelling, tokenids, topk, toxicity, wordbpe
from featlens.llm.common import table

#: Vocabulary files: a parameter of the queries.
TOKENIZER, PIECES, WORD_ENDS = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenids.write(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), tokenids.scratch(spark))
    return tokenids.read(spark, path, digest=True)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.digest(table(spark, sf_dir, "documents"), piecewise.load(vocabulary(PIECES)))


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix.plan(table(spark, sf_dir, "documents"))
    # what isn't taken has no position: dealt out behind the rest by its id, not left as one key
    behind = 2 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    return d.orderBy(F.coalesce("position", behind)).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digest(table(spark, sf_dir, "documents"), wordbpe.load(vocabulary(WORD_ENDS)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=spelling.DAMAGE)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_passages, op2_personal_data, op3_quality, op4_token_files, op5_jaccard_join, op6_neighbours,
                                   op7_pieces, op8_top_products, op9_toxicity, op10_mix, op11_turn_repair, op12_word_tokens, op13_spelling_variants, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of a text in SQL: the table of the reflected polynomial, then a step for every byte.
CRC_TABLE = ("(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
             "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)")


def crc_sql(text: str, t: str = "t") -> str:
    """SQL for the CRC-32 of ``text``; ``t`` is the column of CRC_TABLE."""
    h = f"hex(encode({text}))"
    byte = f"list_transform(range(length({h}) // 2), lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, {t}[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)")


def repair_sql() -> str:
    """SQL for op11: least (cost, audit) of the rest from each of the four states, row by row from the end."""
    lead = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    keep = {0: "CASE ini WHEN 's' THEN b[2] WHEN 'u' THEN b[3] END", 1: "CASE ini WHEN 'u' THEN b[3] END",
            2: "CASE ini WHEN 'a' THEN b[4] END", 3: "CASE ini WHEN 'u' THEN b[3] END"}

    def way(rest, cost, letters, rows):
        return f"CASE WHEN {rest} IS NOT NULL THEN {{'c': {rest}.c + {cost}, 'a': '{letters}' || {rest}.a, 'r': {rows} || {rest}.r}} END"

    def least(ways):
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"
    row, ahead = [], []
    for s in range(4):
        to, role = lead[s]
        kept, changed = way(f"({keep[s]})", "pay", "K", "line"), way(f"b[{to + 1}]", "3 + pay", "R", f"chr(10) || '{role}:' || text")
        row.append(least([way(f"b[{s + 1}]", 4, "D", "''"), f"CASE WHEN NOT gone THEN {kept} END", f"CASE WHEN NOT gone THEN {changed} END"]))
        then, other = lead[to]
        ahead.append(least([f"e[{s + 1}]", way(f"e[{to + 1}]", 3, "I", f"chr(10) || '{role}:'"),
                            way(f"e[{then + 1}]", 6, "II", f"chr(10) || '{role}:' || chr(10) || '{other}:'")]))
    done = "{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}"
    return rf"""
WITH RECURSIVE t AS {CRC_TABLE},
g AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, t),
d AS (SELECT g.g, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h JOIN g ON g.conv_id IS NOT DISTINCT FROM h.conv_id WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text), copy) AS i, count(*) OVER (PARTITION BY g) AS n,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS ini FROM d),
x AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS seen, lag(ini) OVER (PARTITION BY g ORDER BY i) || ini AS pair FROM o),
r AS (SELECT *, blank OR seen AS gone, CASE WHEN NOT blank AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS pay,
             chr(10) || role || ':' || text AS line FROM x),
v AS (SELECT g, n AS i, [{done}, {{'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 3, 'a': 'I', 'r': chr(10) || 'assistant:'}}, {done}] AS b FROM r WHERE i = n
      UNION ALL
      SELECT g, i - 1, [{", ".join(ahead)}] FROM (SELECT v.g, v.i, [{", ".join(row)}] AS e FROM v JOIN r ON r.g = v.g AND r.i = v.i)),
s AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
             count(*) FILTER (pay > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g)
SELECT g.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank, CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(s.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v.b[1].c, 0) AS BIGINT) AS cost,
       coalesce(v.b[1].a, '') AS audit, sha256(coalesce(substr(v.b[1].r, 2), '')) AS repaired_sha256
FROM g LEFT JOIN s ON s.g = g.g LEFT JOIN v ON v.g = g.g AND v.i = 0"""


ORACLE = {
    "op11_turn_repair": repair_sql(),
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS {CRC_TABLE},
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
r AS (SELECT id, run, count(*) AS k FROM o WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (SELECT run, k, {crc_sql("id || ':' || run")} AS h FROM r, t),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
p AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS p, substr(word, 1, i) || substr(word, i + 2) AS s FROM i),
e AS (SELECT a.word, b.word AS near, b.n FROM p a JOIN p b ON a.p = b.p AND a.word <> b.word
      UNION SELECT p.word, w.word, w.n FROM p JOIN w ON p.s = w.word UNION SELECT w.word, p.word, p.n FROM p JOIN w ON p.s = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS most FROM e GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.best END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n
      FROM w LEFT JOIN b ON b.word = w.word),
c AS (SELECT word, word AS at, 0 AS step FROM f UNION ALL SELECT c.word, f.form, c.step + 1 FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(c.at, c.step) FROM c WHERE c.word = f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f""",
    "op5_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(c) AS c FROM r GROUP BY 1) m ON m.node = d.doc_id""",
    "op8_top_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS weight, CAST([0.5, -0.5, 0.0][(k - 1) % 3 + 1] AS DOUBLE) AS slope,
             CAST(3 * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, slope, least(cap, (SELECT level FROM f WHERE level <= cap / weight ORDER BY cap / weight, k LIMIT 1) * weight) AS target FROM f),
u AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS words FROM t),
o AS (SELECT d.*, u.source_size, u.slope, u.target, u.words,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
x AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM o),
y AS (SELECT *, CAST(passes * size + greatest(0, least(size, words - passes * source_size - start)) AS BIGINT) AS taken FROM x),
z AS (SELECT *, CAST(start AS DOUBLE) / words AS q FROM y)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN
         round(CASE WHEN slope = 0 THEN q ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * q)) / (2 * slope) END, 9) + 0.0 END AS position FROM z""",
}
