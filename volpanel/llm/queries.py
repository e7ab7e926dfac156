"""Registered queries of the pipeline operators, with DuckDB statements where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm import (chat_format, decontaminate, html_text, impact_grid, language_id, language_model, license_scan, overlap_join, phrase_trie,
                          quality_rules, source_mix, suffix_dedup, url_rules)

QUERIES, ORACLES = {}, {}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources", rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WS})) AS size, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS position,
             [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
levels AS (
  SELECT 0 AS k, (SELECT 1.5::DOUBLE * sum(source_size)::BIGINT / sum(w)::BIGINT FROM s) AS level
  UNION ALL
  SELECT k + 1, (SELECT (1.5::DOUBLE * sum(source_size)::BIGINT - 2 * coalesce(sum(source_size) FILTER (level * w > 2 * source_size), 0)::BIGINT)
                        / sum(w) FILTER (level * w <= 2 * source_size)::BIGINT FROM s)
  FROM levels WHERE k < (SELECT count(*) FROM s)),
t AS (SELECT s.*, least(w * (SELECT level FROM levels ORDER BY k DESC LIMIT 1), (2 * source_size)::DOUBLE) AS target FROM s),
r AS (SELECT d.doc_id, size, source_size, target, position, sum(size) OVER (PARTITION BY position ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r.*, copy, (done + copy * source_size)::DOUBLE / target AS finish FROM r, (VALUES (0), (1)) v(copy) WHERE size > 0),
m AS (SELECT doc_id, done, position, sum(size) OVER (ORDER BY finish, position, copy, done ROWS UNBOUNDED PRECEDING) AS used FROM c),
n AS (SELECT position, done, doc_id, count(*) AS copies FROM m WHERE used <= 1.5 * (SELECT sum(source_size) FROM s) GROUP BY ALL)
SELECT r.doc_id, size::BIGINT AS size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken
FROM r LEFT JOIN n ON size > 0 AND n.position = r.position AND n.done = r.done""")
def op1_mix_sources(spark, sf_dir):
    mixed = source_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_jaccard_join", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WS}) AS l FROM documents),
g AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, unnest([array_to_string(l[i:i + 4], ' ') FOR i IN range(1, greatest(len(l) - 3, 2))]) AS shingle FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * common >= 80 * (a.n + b.n - common)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x, y FROM e2 UNION SELECT r.x, e2.y FROM r JOIN e2 ON r.y = e2.x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = w.doc_id""")
def op2_jaccard_join(spark, sf_dir):
    return overlap_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_RULES = "(VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.SITES) + ") r(h, p, v)"


@query("op3_url_rules", rf"""
WITH u AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '')")} AS host,
                  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM u JOIN {_RULES}
      ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches({_LOWER.format("host || path")}, '(^|[^0-9a-z])({"|".join(url_rules.WORDS)})($|[^0-9a-z])') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id)""")
def op3_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages")).drop("word_rule")


_ESC = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"


@query("op4_chat_format", rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, encode(role), encode(text)) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + {len(chat_format.START + chat_format.SEP + chat_format.END)})::BIGINT AS formatted_chars
FROM o GROUP BY conv_id""")
def op4_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat_format.read_back(chat_format.format_trees(chat_format.as_tree(rows)))


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


_ITEM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query("op7_decontaminate", rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ITEM}) AS l FROM benchmark),
win AS (SELECT DISTINCT item, least(len(l), 10) AS k, unnest([array_to_string(l[p:p + 9], ' ') FOR p IN range(1, greatest(len(l) - 8, 2))]) AS g
        FROM i WHERE len(l) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ITEM}) AS l FROM documents),
spots AS (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(l) >= k),
hit AS (SELECT DISTINCT doc_id, p, spots.k, item FROM spots JOIN win ON win.k = spots.k AND g = array_to_string(l[p:p + spots.k - 1], ' ')),
spot AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY encode(item)) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_words, coalesce(spot.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(spot.n, 0) > 0 AS contaminated
FROM d LEFT JOIN spot ON spot.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id""")
def op7_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op8_lm_score")
def op8_lm_score(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"))


@query("op9_html_text")
def op9_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


_GRID = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


@query("op12_impact_grid", rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWER.format("text")}, {_GRID}) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(l))::BIGINT AS n_terms FROM d WHERE len(l) > 0),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(l) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
i AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all({_LOWER.format("text")}, {_GRID}) AS l
      FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT DISTINCT item_id, item, unnest(l) AS term FROM i),
w AS (SELECT q.*, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df USING (term), s),
p AS (SELECT item_id, item, doc_id, d.row, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(l) * n_docs) // n_terms))) AS part
      FROM w JOIN tf USING (term) JOIN d ON d.row = tf.row, s),
r AS (SELECT item_id, item, doc_id, sum(part)::BIGINT AS score FROM p GROUP BY item_id, item, doc_id, row HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM r QUALIFY rank <= 10""")
def op12_impact_grid(spark, sf_dir):
    return impact_grid.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_phrase_trie", rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM p),
g AS (SELECT lang, 1 AS size, unnest(l) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest([l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))]) FROM w
      UNION ALL SELECT lang, 3, unnest([l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] FOR i IN range(1, len(l) - 1)]) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(l))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE size > 1),
parts AS (SELECT *, 1 AS k, s[1] AS x, array_to_string(s[2:], ' ') AS y FROM c
          UNION ALL SELECT *, 2, s[1] || ' ' || s[2], s[3] FROM c WHERE size = 3),
met AS (SELECT p.lang, p.size, p.phrase, a, k, fx.f AS l, fy.f AS r, (1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f) AS score
        FROM parts p JOIN f fx ON fx.lang = p.lang AND fx.phrase = x JOIN f fy ON fy.lang = p.lang AND fy.phrase = y),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, s[1] || ' ' || s[2] AS phrase FROM c WHERE size = 3
           UNION ALL SELECT lang, a, s[2] || ' ' || s[3] FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""")
def op13_phrase_trie(spark, sf_dir):
    return phrase_trie.mine(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
