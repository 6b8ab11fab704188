"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import conversations, decontamination, langid, linededup, mixing, neardup, ngramjoin, secrets, sharding, spelling, tokens, topk, warc
from reelspark.llm.common import table, written


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(topk.as_integers(table(spark, sf_dir, "embeddings"), 64), "integers")
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, k=20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.maintained(spark, sf_dir)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.deduplicated_lines(table(spark, sf_dir, "documents"), min_lines=3, min_words=50)
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"], r["end"])), ",")
    return got.select("doc_id", "n_lines", "n_removed", F.coalesce(runs, F.lit("")).alias("runs"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.learn(docs), ["doc_id"])
    return got.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_top_k, op2_token_counts, op3_line_dedup, op4_decontamination, op5_secret_scan,
        op6_near_dedup, op7_sharding, op8_mixing, op9_warc, op10_language_id,
        op11_conversation_repair, op12_spelling_variants, op13_ngram_join,
    )
}

ORACLES: dict[str, str] = {
    "op1_top_k": """
        WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        v AS (SELECT vec_id, list(floor(64 * x) ORDER BY i) AS e FROM u GROUP BY vec_id HAVING count(x) = count(*) AND bool_and(isfinite(x))),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_line_dedup": """
        WITH d AS (SELECT DISTINCT doc_id, md5(text) AS tk, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, tk, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM d),
        l AS (SELECT doc_id, tk, pos, md5(line) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM e),
        w AS (SELECT doc_id, tk, pos, 1 AS w, h AS k, n FROM l
              UNION ALL SELECT doc_id, tk, pos, 2, h || lead(h, 1) OVER o, n + lead(n, 1) OVER o FROM l WINDOW o AS (PARTITION BY doc_id, tk ORDER BY pos)
              UNION ALL SELECT doc_id, tk, pos, 3, h || lead(h, 1) OVER o || lead(h, 2) OVER o, 50 FROM l WINDOW o AS (PARTITION BY doc_id, tk ORDER BY pos)),
        f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(tk) OVER o AS ft, first_value(pos) OVER o AS fp
              FROM w WHERE k IS NOT NULL AND n >= 50 WINDOW o AS (PARTITION BY k ORDER BY doc_id NULLS LAST, tk, pos)),
        g AS (SELECT doc_id, tk, unnest(range(CASE WHEN doc_id = fd AND tk = ft THEN greatest(pos, fp + w) ELSE pos END, pos + w)) AS pos
              FROM f WHERE NOT (doc_id = fd AND tk = ft AND pos = fp)),
        gone AS (SELECT DISTINCT doc_id, tk, pos FROM g),
        i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, tk ORDER BY pos) AS island FROM gone),
        runs AS (SELECT doc_id, tk, min(pos) AS a, max(pos) + 1 AS b FROM i GROUP BY doc_id, tk, island),
        r AS (SELECT doc_id, tk, string_agg(a || '-' || b, ',' ORDER BY a) AS runs, sum(b - a)::BIGINT AS n FROM runs GROUP BY doc_id, tk),
        kept AS (SELECT doc_id, tk, string_agg(line, chr(10) ORDER BY pos) AS text FROM
                 (SELECT doc_id, tk, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM d) ANTI JOIN gone USING (doc_id, tk, pos) GROUP BY doc_id, tk)
        SELECT x.doc_id, CASE WHEN x.text IS NULL THEN 0 ELSE len(string_split(x.text, chr(10))) END::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed,
               coalesce(r.runs, '') AS runs, CASE WHEN x.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS text_md5
        FROM documents x LEFT JOIN r ON x.doc_id = r.doc_id AND md5(x.text) = r.tk LEFT JOIN kept ON x.doc_id = kept.doc_id AND md5(x.text) = kept.tk""",
    "op4_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
        w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i:i + 9], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
        g AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM w))),
        h AS (SELECT doc_id, item_id, i, g.m FROM g JOIN w ON g.k = w.k AND g.m = w.m),
        n AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
        f AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op6_near_dedup": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM d JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op13_ngram_join": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 2 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM d JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
        g AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM g""",
}
