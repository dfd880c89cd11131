"""The operators' queries over the driver's tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.llm import ann, bpe, chat, leaderboard, linededup, minhash, packing, quality, simhash, substring, topk, warc, whitening
from grafwerk.llm.shared import prepare, table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha(col: str) -> F.Column:
    return F.sha2(F.encode(F.col(col), "UTF-8"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(rows.unionByName(probe)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(lost).cast("long").alias("loss_chars"),
        F.sha2(F.encode(lost, "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha("text").alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = substring.dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", _sha("text").alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    lines = leaderboard.staged(*(table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items")))
    return leaderboard.change_feed(lines)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bpe, op2_ann, op3_chat, op4_quality, op5_lines, op6_simhash, op7_substring, op8_warc, op9_topk, op10_packing, op11_minhash, op12_leaderboard, op13_whitening]
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '#', '&num;'), ': ', ':&sp;') AS er,
             replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '#', '&num;'), ': ', ':&sp;') AS et FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn>### ') + length(er) + 2 + length(et) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, (d.first IS NOT NULL AND k.doc_id > d.first) AS gone FROM k LEFT JOIN d ON d.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 12)) AS pos, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS win FROM s),
f AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win HAVING count(DISTINCT doc_id) >= 2),
g AS (SELECT DISTINCT h.doc_id, h.pos + o.i AS pos FROM h JOIN f ON f.win = h.win AND h.doc_id > f.first, (SELECT unnest(generate_series(0, 12)) AS i) o),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
k AS (SELECT t.doc_id, t.pos, t.word, g.pos IS NOT NULL AS gone FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.pos = t.pos),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, coalesce(a.n, 0)::BIGINT AS n_words, coalesce(a.r, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON a.doc_id = w.doc_id
"""


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM p),
g AS (SELECT *, list_transform(generate_series(0, 7), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::BIGINT) AS five FROM d)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((five[(i // 4 + 1)::INT] >> ((3 - i % 4) * 5)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

#: CRC-32 by a table that the first step derives from its polynomial.
OP12_SQL = """
WITH t AS (SELECT list_transform(generate_series(0, 255), lambda b: list_reduce(generate_series(1, 8), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)), b::BIGINT)) AS t),
x AS (SELECT *, concat_ws(',', coalesce(sale_id::VARCHAR, ''), coalesce(item_id::VARCHAR, ''), coalesce(vendor_id::VARCHAR, ''), coalesce(line_no::VARCHAR, '')) AS k FROM sale_lines),
h AS (SELECT x.*, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM x, t),
d AS (SELECT *, coalesce(datediff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150)::BIGINT AS s FROM h),
a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM d),
b AS (SELECT *, least(12, greatest(1, 1 + floor((a - 19723) * 12 / 180)))::INTEGER AS batch FROM a),
m AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b GROUP BY batch),
l AS (SELECT v.nation_id, b.item_id, b.a, b.batch, CASE WHEN flag = 'returned' THEN -1 ELSE 1 END *
             coalesce(floor(100 * amount + 0.5), quantity * floor(100 * i.price + 0.5), 0) AS cents
      FROM b JOIN m ON m.batch = b.batch JOIN vendors v ON v.vendor_id = b.vendor_id JOIN items i ON i.item_id = b.item_id
      WHERE v.nation_id IS NOT NULL AND (m.before IS NULL OR b.s + 8 >= m.before)),
g AS (SELECT nation_id, item_id, a, min(batch) AS batch, sum(cents) AS cents FROM l GROUP BY ALL),
r AS (SELECT nation_id, item_id, a AS since, lead(a) OVER w AS until, sum(cents) OVER w AS revenue FROM g WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)),
y AS (SELECT nation_id, a, min(batch) AS batch, lag(a) OVER (PARTITION BY nation_id ORDER BY a) AS prior FROM g GROUP BY nation_id, a),
f AS (SELECT y.nation_id, y.a, r.item_id, r.revenue FROM y JOIN r ON r.nation_id = y.nation_id AND r.since <= y.a AND (r.until IS NULL OR r.until > y.a)),
k AS (SELECT *, row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue DESC, item_id)::INTEGER AS rank FROM f WHERE revenue > 0 QUALIFY rank <= 10),
o AS (SELECT y.nation_id, y.a, k.item_id, k.rank FROM y JOIN k ON k.nation_id = y.nation_id AND k.a = y.prior),
c AS (SELECT coalesce(k.nation_id, o.nation_id) AS nation_id, coalesce(k.a, o.a) AS a, coalesce(k.item_id, o.item_id) AS item_id, o.rank AS old_rank, k.rank AS new_rank
      FROM k FULL JOIN o ON o.nation_id = k.nation_id AND o.a = k.a AND o.item_id = k.item_id WHERE o.rank IS DISTINCT FROM k.rank)
SELECT c.nation_id, c.a::BIGINT AS arrival_day, c.item_id, y.batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
       old_rank, new_rank, f.revenue::BIGINT AS revenue
FROM c JOIN y ON y.nation_id = c.nation_id AND y.a = c.a JOIN f ON f.nation_id = c.nation_id AND f.a = c.a AND f.item_id = c.item_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op5_lines": OP5_SQL, "op7_substring": OP7_SQL, "op8_warc": OP8_SQL, "op9_topk": OP9_SQL, "op11_minhash": OP11_SQL, "op12_leaderboard": OP12_SQL}
