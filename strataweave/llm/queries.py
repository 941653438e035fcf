"""The corpus operators as named queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decision_list, exponion_kmeans, hilbert_packing, hyper_minhash, license_join, positional_index, simhash_pivots, token_counts, url_rules, warc_revisit, weak_pii, zstd_toxicity
from .common import stored, table


#: The rules of the standard URL query: host, path prefix, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve(warc_revisit.captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.withColumn("headers", lines)


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return zstd_toxicity.score(docs, zstd_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_join.scan(docs, list(license_join.PHRASES), list(license_join.TEMPLATES))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(weak_pii.candidate_rows(table(spark, sf_dir, "documents").select("doc_id", "text")), "spans")
    return weak_pii.scan(found, weak_pii.fit(found))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op12_exponion_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion_kmeans.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=40, rounds=5, seed=2)


def op13_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of ``op9_decision_list``, which SQL can express."""
    return decision_list.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), []).drop("n_lines", "kept")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of ``op10_weak_pii``, which SQL can express."""
    found = weak_pii.candidate_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return weak_pii.scan(found, weak_pii.train({})).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {f.__name__: f for f in (op1_warc_revisit, op2_simhash_pivots, op3_whole_tokens, op4_url_rules, op5_hilbert_packing, op6_zstd_toxicity, op7_license_join, op8_positional_index, op9_decision_list, op10_weak_pii, op11_conversation_repair, op12_exponion_kmeans, op13_hyper_minhash, quality_statistics, personal_data_base)}
    return found | {"pipeline": corpus_pipeline.run}


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_replace(url, '#.*$', '') AS bare FROM pages),
u AS (
  SELECT page_id, h, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    regexp_extract(bare, '://([^/?]*@)', 1) || lower(regexp_extract(bare, '://([^/?]*@)?([^/?@]*)', 2)) AS host, regexp_extract(bare, '://[^/?]*([^?]*)', 1) AS path, regexp_extract(bare, '([?].*)$', 1) AS query
  FROM p),
c AS (
  SELECT page_id, '"' || md5(h)[1:16] || '"' AS tag, sha256(h) AS digest, CAST(page_id * 60 AS VARCHAR) AS modified,
    scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
      || CASE path WHEN '' THEN '/' ELSE path END || query AS url
  FROM u),
again AS (
  SELECT *, page_id * 60 + CASE WHEN page_id % 11 = 0 THEN -86400 ELSE 86400 END AS at,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"changed"' ELSE tag END AS sent
  FROM c),
best AS (
  SELECT a.page_id, a.url, a.sent, a.modified, r.page_id AS of, r.tag AS r_tag, r.modified AS r_modified, r.digest AS r_digest,
    row_number() OVER (PARTITION BY a.page_id ORDER BY r.page_id DESC) AS n
  FROM again a LEFT JOIN c r ON r.url = a.url AND r.page_id * 60 < a.at),
judged AS (SELECT *, CASE WHEN of IS NULL THEN 'missing' WHEN coalesce(sent = r_tag, modified = r_modified) THEN 'resolved' ELSE 'changed' END AS outcome FROM best WHERE n = 1)
SELECT page_id || '-revisit' AS record_id, url, outcome, CASE outcome WHEN 'resolved' THEN of || '-response' END AS response_id,
  CASE outcome WHEN 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(sent, r_tag) || chr(10) || 'last-modified: ' || r_modified END AS headers,
  CASE outcome WHEN 'resolved' THEN r_digest END AS payload_digest
FROM judged
"""

URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1
"""


LEAK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
s AS (SELECT item, words, least(10, len(words)) AS n, unnest(range(0, len(words) - least(10, len(words)) + 1)) AS pos FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item, n, array_to_string(words[pos + 1 : pos + n], ' ') AS key FROM s),
k AS (SELECT DISTINCT n FROM w),
p AS (SELECT rid, n, unnest(list_transform(range(0, len(words) - n + 1), lambda i: struct_pack(pos := i, key := array_to_string(words[i + 1 : i + n], ' ')))) AS x FROM d, k WHERE len(words) >= n),
o AS (SELECT rid, p.n AS n, x.pos AS pos, item FROM p JOIN w ON w.n = p.n AND w.key = x.key),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS q FROM o) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM o GROUP BY rid),
tw AS (SELECT rid, unnest(list_transform(range(0, len(words)), lambda i: struct_pack(pos := i, word := words[i + 1]))) AS x FROM d),
tb AS (SELECT item, words, pos AS win, n, unnest(range(pos, pos + n)) AS ipos FROM s),
tn AS (SELECT x.word AS word, count(*) AS freq FROM tw WHERE x.word IN (SELECT unnest(words) FROM b) GROUP BY 1),
tr AS (SELECT item, words, win, n, ipos, words[ipos + 1] AS word, row_number() OVER (PARTITION BY item, words, win ORDER BY freq, ipos) AS r FROM tb JOIN tn ON tn.word = words[ipos + 1]),
ta AS (SELECT item, words, win, ipos, word, least(3, n) AS need FROM tr WHERE r <= 3),
ts AS (SELECT item, need, list(ipos ORDER BY ipos) AS ipos, list(word ORDER BY ipos) AS word FROM ta GROUP BY item, words, win, need HAVING count(*) = need),
tu AS (SELECT row_number() OVER () AS st, item, need, ipos, word FROM (SELECT DISTINCT * FROM ts)),
te AS (SELECT st, item, need, unnest(ipos) AS ipos, unnest(word) AS word FROM tu),
tm AS (SELECT DISTINCT rid, st, item, need, ipos, x.pos - ipos AS shift FROM te JOIN tw ON x.word = te.word),
tf AS (SELECT rid, st FROM tm GROUP BY rid, st, need HAVING count(DISTINCT ipos) = need),
tg AS (SELECT tm.* FROM tm JOIN tf USING (rid, st)),
tx AS (SELECT a.rid AS rid, a.item AS item FROM tg a JOIN tg c ON a.rid = c.rid AND a.st = c.st AND c.shift BETWEEN a.shift AND a.shift + 5 GROUP BY a.rid, a.item, a.st, a.shift, a.ipos, a.need HAVING count(DISTINCT c.ipos) = a.need),
ty AS (SELECT rid, count(DISTINCT item) AS n_near FROM tx GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid) LEFT JOIN ty USING (rid)
"""


def license_sql(threshold: float = 0.8) -> str:
    """The license query: every phrase at every place, every template against every block."""
    items = license_join.templates(list(license_join.TEMPLATES), threshold)
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license_join.PHRASES)
    texts = ", ".join(f"({i}, '{t.label}', {sorted(set(t.words))}, {t.needed}, {t.span})" for i, t in enumerate(items))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
ph(phrase, label, n) AS (VALUES {phrases}),
t(tid, label, tw, need, span) AS (VALUES {texts}),
q AS (SELECT rid, phrase, label, unnest(list_transform(range(0, len(words) - n + 1), lambda i: struct_pack(pos := i, key := array_to_string(words[i + 1 : i + n], ' ')))) AS x FROM d, ph WHERE len(words) >= n),
pl AS (SELECT rid, label, x.pos AS pos FROM q WHERE x.key = phrase),
ws AS (SELECT rid, unnest(list_transform(range(0, len(words)), lambda i: struct_pack(pos := i, word := words[i + 1]))) AS x FROM d),
te AS (SELECT tid, unnest(tw) AS word FROM t),
hp AS (SELECT rid, tid, x.pos AS pos, x.word AS word FROM ws JOIN te ON x.word = te.word),
ok AS (SELECT rid, hp.tid AS tid FROM hp JOIN t ON t.tid = hp.tid GROUP BY rid, hp.tid, need HAVING count(DISTINCT word) >= need),
hk AS (SELECT hp.*, span FROM hp JOIN ok ON hp.rid = ok.rid AND hp.tid = ok.tid JOIN t ON t.tid = hp.tid),
m AS (SELECT a.rid AS rid, a.tid AS tid, a.pos AS pos, count(DISTINCT b.word) AS c FROM hk a JOIN hk b ON a.rid = b.rid AND a.tid = b.tid AND b.pos >= a.pos AND b.pos < a.pos + a.span GROUP BY a.rid, a.tid, a.pos),
f AS (SELECT rid, label, max(c) / len(tw) AS share FROM m JOIN t ON t.tid = m.tid GROUP BY rid, m.tid, label, tw, need HAVING max(c) >= need),
a AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM pl UNION ALL SELECT rid, label FROM f) GROUP BY rid),
s AS (SELECT rid, max(share) AS score FROM f GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN a USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT rid, unnest(list_transform(range(0, len(words) - 7), lambda i: struct_pack(pos := i, key := array_to_string(words[i + 1 : i + 8], ' ')))) AS x FROM d WHERE len(words) >= 8),
k AS (SELECT rid, x.key AS key FROM w GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT w.rid AS rid, unnest(range(x.pos, x.pos + 8)) AS q FROM w JOIN k ON k.rid = w.rid AND k.key = x.key) GROUP BY rid),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(words) < 20 OR 100 * coalesce(n, 0) > 30 * len(words) AS base_failed
FROM l LEFT JOIN r USING (rid)
"""

PRIVATE_SQL = r"""
WITH f AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS ips,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9](?:[ -]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS runs,
    list_transform(regexp_extract_all(coalesce(text, ''), '[+][0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS calls
  FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0)) AS n_ip,
  len(list_filter(runs, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE (length(x) - i) % 2 WHEN 0 THEN CAST(x[i] AS INTEGER) ELSE (2 * CAST(x[i] AS INTEGER)) // 10 + (2 * CAST(x[i] AS INTEGER)) % 10 END)) % 10 = 0)) AS n_card,
  len(list_filter(calls, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone
FROM f
"""


def repair_sql() -> str:
    """Damage and repair: per turn and grammar state the least cost and audit in one text, then the trace is read off."""
    more = lambda k, cost, edit: f"printf('%06d', CAST(substr({k}, 1, 6) AS INTEGER) + {cost}) || substr({k}, 7) || '{edit}'"
    inserted = lambda c: f"least({c}2, {', '.join(more(f'{c}{q}', 5, 'I') for q in (0, 1, 3))})"
    also = lambda c: f"least({c}3, {more(f'{c}2', 5, 'I')})"
    kept = lambda q, initial: f"CASE WHEN ok AND initial = '{initial}' THEN {more(f's{q}', 'extra', 'K')} END"
    again = lambda q: f"CASE WHEN ok THEN {more(f's{q}', 'extra + 1', 'R')} END"
    gone = lambda q: more(f"s{q}", 2, "D")
    step = {
        0: gone(0), 1: f"least({gone(1)}, {kept(0, 's')})",
        2: f"least({gone(2)}, {', '.join(f(q) for q in (0, 1, 3) for f in (lambda q: kept(q, 'u'), again))})",
        3: f"least({gone(3)}, {kept(2, 'a')}, {again(2)})",
    }
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(told, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: list_reduce(list_prepend(xor(h, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v // 2, (v % 2) * 3988292384)))"
    return rf"""
WITH RECURSIVE told AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS told FROM conversations),
c AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM told),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS time
  FROM c WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM o),
g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
a AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000005I' AS s2, '000010II' AS s3 FROM g
  UNION ALL
  SELECT conv_id, n, s0, s1, s2, {also('s')} AS s3 FROM (SELECT conv_id, n, e0 AS s0, e1 AS s1, {inserted('e')} AS s2, e3 AS s3 FROM (
    SELECT g.conv_id, g.n, {step[0]} AS e0, {step[1]} AS e1, {step[2]} AS e2, {step[3]} AS e3 FROM a JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id AND g.n = a.n + 1) y) z),
l AS (SELECT conv_id, least(s0, s3) AS best FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
e AS (SELECT conv_id, best, unnest(range(1, length(best) - 5)) AS i FROM l),
t AS (SELECT conv_id, i, best[i + 6] AS edit, length(replace(best[7 : i + 6], 'I', '')) AS n FROM e),
k AS (SELECT t.conv_id, edit, i, CASE edit WHEN 'I' THEN '' ELSE text END AS text, role, initial, row_number() OVER (PARTITION BY t.conv_id ORDER BY i) AS place
  FROM t LEFT JOIN g ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.n = g.n AND edit <> 'I' WHERE edit <> 'D'),
h AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM k),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS whole FROM h GROUP BY conv_id),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best[1:6] AS BIGINT), 0) AS cost, coalesce(best[7:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN s ON v.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN l ON v.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def cluster_sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    nearest = lambda i: f"""a{i} AS MATERIALIZED (SELECT rid, vec_id, v, n, d FROM (
  SELECT rid, vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM vs, c{i}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, n) = 1)"""  # noqa: E731
    moved = lambda i: f"""m{i} AS (SELECT n, i, sum(x) AS s, count(*) AS many FROM (SELECT n, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i - 1}) GROUP BY n, i),
l{i} AS (SELECT n, list(CAST((s - ((s % many) + many) % many) // many AS BIGINT) ORDER BY i) AS c FROM m{i} GROUP BY n),
c{i} AS MATERIALIZED (SELECT b.n, coalesce(l.c, b.c) AS c FROM c{i - 1} b LEFT JOIN l{i} l ON l.n = b.n)"""  # noqa: E731
    steps = ",\n".join(x for i in range(1, rounds + 1) for x in (moved(i), nearest(i)))
    return f"""
WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {dims}),
vs AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM f WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), rid) - 1 AS n, v AS c FROM vs QUALIFY n < {k}),
{nearest(0)},
{steps}
SELECT vec_id, CAST(a.n AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.n = a.n
"""


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, list_distinct(list_transform(range(0, CASE len(w) WHEN 0 THEN 0 ELSE greatest(1, len(w) - 2) END), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS g FROM d),
e AS MATERIALIZED (SELECT rid, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.rid AS a, b.rid AS b, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.rid <> b.rid AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
k AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 85 * (n + m - c)),
r AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
q AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN s ON s.rid = r.b GROUP BY r.a)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN q USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisit": WARC_SQL, "op4_url_rules": URL_SQL, "op7_license_join": license_sql(), "op8_positional_index": LEAK_SQL, "op11_conversation_repair": repair_sql(), "op12_exponion_kmeans": cluster_sql(), "op13_hyper_minhash": NEAR_SQL, "quality_statistics": QUALITY_SQL, "personal_data_base": PRIVATE_SQL}
