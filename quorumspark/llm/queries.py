"""The registered queries of this subpackage and their SQL where it can express them."""

import public_tokenizers
from pyspark.sql import functions as F

from quorumspark.llm import bpe, chat, curriculum, decontaminate, html, lines, minhash, negatives, quality, suffix, trie, urls, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.judged(_table(spark, sf_dir, "documents")).drop("boilerplate", "u1", "u2")


def op3_suffix(spark, sf_dir):
    return suffix.digest(suffix.repeated_substrings(_table(spark, sf_dir, "documents")))


def op4_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path))


def op5_urls(spark, sf_dir):
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op6_warc(spark, sf_dir):
    return warc.digest(warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"))))


def op7_html(spark, sf_dir):
    text = html.main_text(_table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op8_lines(spark, sf_dir):
    return lines.repeated_chunks(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{probe}'), (-7L, 1L, 'assistant', '{probe}') AS more(conv_id, turn, role, text)")
    return chat.digest(chat.format_chats(turns.union(more)))


def op11_trie(spark, sf_dir):
    turns = trie.ordered(_table(spark, sf_dir, "conversations"))
    # every conversation takes over the head of the first of its five
    rows, members = trie.graft(turns, F.expr("conv - conv % 5"), F.crc32(F.col("conv").cast("string")) % 9, 8)
    nodes = trie.prefix_trie(rows, members)
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op12_negatives(spark, sf_dir):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", noisy))


def op13_curriculum(spark, sf_dir):
    return curriculum.digest(curriculum.order(curriculum.assign(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_quality, op3_suffix, op4_bpe, op5_urls, op6_warc, op7_html, op8_lines, op9_decontaminate, op10_chat, op11_trie, op12_negatives, op13_curriculum)}

_LOWERED = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP5 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         CASE WHEN contains(url, '://') THEN {host} || regexp_extract(url, '://[^/?#]*([^#]*)', 1) END AS node, html
  FROM pages),
links AS (
  SELECT url, node, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM p
  UNION ALL SELECT url, node, regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1) FROM p
  UNION ALL SELECT url, node, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1) FROM p),
aim AS (
  SELECT node AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || link END AS url FROM links WHERE link <> '' AND node IS NOT NULL),
e AS (SELECT DISTINCT a, {host} || regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS b, url FROM aim WHERE url IS NOT NULL),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
rules AS (SELECT * FROM (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')) r(action, rule, suffix, start)),
named AS (SELECT node, host, path FROM p WHERE node IS NOT NULL UNION SELECT b, {host}, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) FROM e),
best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM named UNION SELECT host, path FROM p) JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start) GROUP BY host, path),
spread AS (
  SELECT r.a AS node, bool_or(b.action = 'allow') AS allowed
  FROM (SELECT a, b FROM reach UNION SELECT a, a FROM sym) r JOIN named n ON n.node = r.b JOIN best b ON b.host = n.host AND b.path = n.path GROUP BY r.a)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.action, CASE WHEN s.allowed THEN 'allow' WHEN NOT s.allowed THEN 'block' END, 'allow') AS verdict,
       (b.action IS NULL AND s.node IS NOT NULL) AS propagated
FROM p LEFT JOIN best b ON b.host = p.host AND b.path = p.path LEFT JOIN spread s ON s.node = p.node
""".replace("{host}", _LOWERED % "regexp_extract(url, '://([^/?#]*)', 1)")

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM m
"""

_OP8 = r"""
WITH l AS (
  SELECT doc_id, line, i, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
marked AS (SELECT *, i > 2 AND (lag(h, 2) OVER w * 31 + lag(h) OVER w) % 2 = 0 AS mark, count(*) OVER (PARTITION BY doc_id) AS size FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cut AS (SELECT *, (mark AND NOT lag(mark) OVER w AND i < size)::INT AS new FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM cut),
chunk AS (SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM numbered GROUP BY doc_id, place),
ranked AS (SELECT *, n > 1 AND regexp_matches(chunk, '[^ \t\n\x0B\f\r]') AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, place) > 1 AS gone FROM chunk)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""

_OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length(text) + length(role) + {escapes_text} + {escapes_role} + 10 AS n,
         row_number() OVER w AS k, lag(role) OVER w AS prev
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
judged AS (SELECT *, coalesce(prev, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS fine FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars, (bool_and(fine) AND arg_max(role, k) = 'assistant') AS valid
FROM judged GROUP BY conv_id
"""
for _c in ("text", "role"):
    _OP10 = _OP10.replace(f"{{escapes_{_c}}}", "(" + " + ".join(f"(length({_c}) - length(replace({_c}, '{x}', ''))) // {len(x)}" for x in ("\\", "<|", "|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\", "|\\", "[\\")) + ")")

# crc32 bit by bit: the message's bits, lowest first, shift through the register
_OP11 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id AS c, max(pos) AS n, conv_id::VARCHAR AS s FROM t GROUP BY conv_id),
h AS (SELECT c, c - c % 5 AS src, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * length(s)), lambda x: ((ascii(s[x // 8 + 1]) >> (x % 8)::INT) & 1)::BIGINT)),
  lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 9 AS h FROM i),
w AS (SELECT h.*, least(h.h, coalesce(j.n, 0)) AS take FROM h LEFT JOIN i j ON j.c = h.src),
r AS (SELECT c, pos, role, text FROM w JOIN t ON t.conv_id = src AND pos <= take UNION ALL SELECT c, pos - h + take, role, text FROM w JOIN t ON t.conv_id = c AND pos > h),
p AS (SELECT c, pos, octet_length(encode(text)) AS bytes, string_agg(md5(role || chr(1) || text), '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM i),
last AS (SELECT c, max(pos) AS pos FROM p GROUP BY c),
n AS (SELECT path, min(c) AS conv_id, pos AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path, pos),
e AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM p JOIN last USING (c, pos) GROUP BY path),
k AS (SELECT a.path, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND starts_with(b.path, a.path) GROUP BY a.path),
u AS (SELECT a.path, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens FROM n a JOIN n b ON starts_with(b.path, a.path) JOIN k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN k USING (path) JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n m ON n.depth > 0 AND m.path = left(n.path, 32 * (n.depth - 1))
"""

_OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(concat_ws('|', 'mix', doc_id)) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][k % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
f AS (
  SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT first(level ORDER BY most / weight, k) AS level FROM f WHERE level * weight <= most),
t AS (SELECT source, source_size, k, least(most, coalesce((SELECT level FROM l) * weight, most)) AS target FROM w),
b AS (SELECT d.*, source_size, k, target, floor(target + 1e-6)::BIGINT AS demand, (sum(size) OVER (PARTITION BY k ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, greatest(0, least(demand - pass * source_size - start, size))::BIGINT AS words, (pass * source_size + start) / nullif(target, 0) AS x FROM b CROSS JOIN (VALUES (0), (1)) p(pass)),
p AS (SELECT *, CASE k % 3 WHEN 0 THEN 2 * x / (1.5 + sqrt(2.25 - 2 * x)) WHEN 1 THEN x
  ELSE CASE WHEN x < 0.3 THEN 0.5 * (4 * x / (0.4 + sqrt(0.16 + 1.6 * x))) ELSE 0.5 + 0.5 * (2 * (x - 0.3) / 0.5 / (0.8 + sqrt(0.64 + 2.4 * (x - 0.3) / 0.5))) END END AS position FROM c WHERE words > 0),
a AS (SELECT *, sum(words) OVER (ORDER BY position, k, pass, start, doc_id ROWS UNBOUNDED PRECEDING) - words AS place FROM p)
SELECT b.doc_id, any_value(b.size)::BIGINT AS size, any_value(b.source_size)::BIGINT AS source_size, any_value(b.target) AS target, coalesce(sum(a.words), 0)::BIGINT AS taken,
       round(min(a.position), 6) AS first_position, min(a.place)::BIGINT AS first_at
FROM b LEFT JOIN a ON a.doc_id = b.doc_id GROUP BY b.doc_id
"""

SQL = {"op5_urls": _OP5, "op6_warc": _OP6, "op8_lines": _OP8, "op10_chat": _OP10, "op11_trie": _OP11, "op12_negatives": _OP12, "op13_curriculum": _OP13}
