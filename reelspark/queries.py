"""One query for each operator, on the given tables, with the SQL that must give equal rows.

Bindings: an order is a study, a line item its item (n_frames = quantity, view = return flag, kind Standard = status O),
the customer's nation its site; embeddings are items with 97 studies and 50 to a shard; events are logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import columns as fn
from reelspark.operators import bootstrap, joins, labels, metrics, ranks, reports, retrieval, splits, vectors
from reelspark.plans import frames
from reelspark.sources import readers, writers
from reelspark.sources.work import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HELD_SITES = (3, 7, 11, 19)
C = F.col


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def items(s: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(C("l_extendedprice") * 100).cast("long"))
    return table(s, d, "lineitem").select(
        key.alias("id"), C("l_orderkey").alias("study"), C("l_quantity").cast("int").alias("n_frames"), C("l_returnflag").alias("view"),
        F.when(C("l_linestatus") == "O", "Standard").otherwise("Other").alias("type"), (C("l_discount") * 600 - 6).alias("raw_fps"),
        (C("l_tax") - 0.01).alias("delta_cm"), (C("l_linenumber") * 100).alias("height"), (C("l_suppkey") % 400 + 100).cast("int").alias("width"),
    )


ITEMS = """items AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_orderkey AS study,
    l_quantity::INT AS n_frames, l_returnflag AS view, CASE WHEN l_linestatus = 'O' THEN 'Standard' ELSE 'Other' END AS type,
    l_discount * 600 - 6 AS raw_fps, l_tax - 0.01 AS delta_cm, l_linenumber * 100 AS height, (l_suppkey % 400 + 100)::INT AS width FROM lineitem)"""


def r6(c, name: str | None = None):
    col = C(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or (c if isinstance(c, str) else "value"))


# projections and plans


@query("p01_resolve_fps", f"WITH {ITEMS} SELECT id, round(CASE WHEN raw_fps > 0 THEN raw_fps ELSE 0 END, 6) AS fps FROM items")
def _(s, d):
    return items(s, d).select("id", r6(fn.resolve_fps(C("raw_fps")), "fps"))


@query("p02_resolve_spacing", f"WITH {ITEMS} SELECT id, round(CASE WHEN delta_cm > 0 THEN delta_cm * 10 ELSE 0 END, 6) AS spacing FROM items")
def _(s, d):
    return items(s, d).select("id", r6(fn.resolve_spacing(C("delta_cm")), "spacing"))


@query("p03_spacing_plan", f"""WITH {ITEMS}, s AS (SELECT *, CASE WHEN delta_cm > 0 THEN delta_cm * 10 ELSE 0.0 END AS spacing FROM items),
    t AS (SELECT *, CASE WHEN spacing > 0 THEN spacing / 0.36::DOUBLE ELSE 1.0 END AS scale FROM s)
    SELECT id, round(scale, 6) AS scale, CASE WHEN spacing <= 0 OR abs(scale - 1) < 0.01 THEN height ELSE round_even(height * scale, 0) END::BIGINT AS new_h,
    CASE WHEN spacing <= 0 OR abs(scale - 1) < 0.01 THEN width ELSE round_even(width * scale, 0) END::BIGINT AS new_w FROM t""")
def _(s, d):
    return frames.spacing_plan(frames.technical(items(s, d), "raw_fps", "delta_cm")).select("id", r6("scale"), "new_h", "new_w")


@query("p04_resample_plan", f"""WITH {ITEMS}, s AS (SELECT id, n_frames::BIGINT AS n, CASE WHEN raw_fps > 0 THEN raw_fps ELSE 0.0 END AS fps FROM items),
    t AS (SELECT *, CASE WHEN fps > 0 THEN greatest(1, round_even(n / fps * 24.0::DOUBLE, 0))::BIGINT ELSE n END AS t_out FROM s)
    SELECT id, t_out, list_sum(l)::BIGINT AS idx_sum, l[-1] AS last_idx FROM (SELECT id, t_out,
    list_transform(range(t_out), lambda i: CASE WHEN fps > 0 THEN greatest(0, least(round_even(i * (fps / 24.0::DOUBLE), 0)::BIGINT, n - 1)) ELSE i END) AS l FROM t)""")
def _(s, d):
    p = frames.resample_plan(frames.technical(items(s, d), "raw_fps", "delta_cm"))
    return p.select("id", "t_out", F.aggregate("frame_idx", F.lit(0).cast("long"), lambda a, x: a + x).alias("idx_sum"), F.element_at("frame_idx", -1).alias("last_idx"))


@query("p05_center_clip", f"WITH {ITEMS} SELECT id, list_transform(range(16), lambda i: least(greatest(0, floor((n_frames - 16) / 2)::BIGINT) + i, n_frames - 1))::VARCHAR AS clip FROM items")
def _(s, d):
    p = frames.clip_plan(items(s, d), 16)
    return p.select("id", F.concat(F.lit("["), F.array_join("clip_idx", ", "), F.lit("]")).alias("clip"))


@query("p06_strided_clip", f"""WITH {ITEMS}, c AS (SELECT id, n_frames::BIGINT AS n, clip FROM items, range(2) t(clip)),
    u AS (SELECT *, n - 16 AS room, ('0x' || substr(md5(concat_ws(':', 5, id, clip)), 1, 8))::BIGINT % (greatest(n - 16, 0) + 1) AS start FROM c)
    SELECT id, clip::INT AS clip, CASE WHEN room >= 0 THEN list_transform(range(8), lambda i: start + 2 * i) ELSE list_transform(range(8), lambda i: floor(i * (n - 1) / 7.0::DOUBLE)::BIGINT) END::VARCHAR AS idx FROM u""")
def _(s, d):
    p = frames.clip_plan(items(s, d), 8, 2, "random", seed=5, clips=2)
    return p.select("id", "clip", F.concat(F.lit("["), F.array_join("clip_idx", ", "), F.lit("]")).alias("idx"))


@query("p07_sliding_windows", f"""WITH {ITEMS}, w AS (SELECT id, n_frames::BIGINT AS n, unnest(CASE WHEN n_frames >= 16 THEN list_distinct(list_concat(range(0, n_frames - 15, 8), [n_frames - 16])) ELSE [0] END)::BIGINT AS start FROM items)
    SELECT id, start, CASE WHEN n >= 16 THEN list_transform(range(16), lambda i: start + i) ELSE list_transform(range(16), lambda i: floor(i * (n - 1) / 15.0::DOUBLE)::BIGINT) END::VARCHAR AS idx FROM w""")
def _(s, d):
    p = frames.sliding_windows(items(s, d), 16, 8)
    return p.select("id", "start", F.concat(F.lit("["), F.array_join("window_idx", ", "), F.lit("]")).alias("idx"))


@query("p08_eligible_items", f"WITH {ITEMS} SELECT id, n_frames FROM items WHERE type = 'Standard' AND n_frames >= 8")
def _(s, d):
    return labels.eligible_items(items(s, d).withColumn("n_frames", C("n_frames").cast("string"))).select("id", C("n_frames").cast("int").alias("n_frames"))


@query("p09_has_path", "SELECT page_id, url FROM pages WHERE url IS NOT NULL AND trim(url) <> ''")
def _(s, d):
    return labels.has_path(table(s, d, "pages"), "url").select("page_id", "url")


@query("p10_informative", "SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('error', 'Other', 'nan')")
def _(s, d):
    return labels.informative(table(s, d, "events"), "event_type", ("error", "Other", "nan")).select("event_id", "event_type")


@query("p11_numeric_label", "SELECT o_orderkey, round(o_totalprice, 6) AS label FROM orders WHERE o_totalprice BETWEEN 20000 AND 80000")
def _(s, d):
    o = table(s, d, "orders").withColumn("text", F.concat(F.lit(" "), C("o_totalprice").cast("string")))
    return labels.numeric_label(o, "text", 20000, 80000).select("o_orderkey", r6("label"))


@query("p12_grade_text", r"""SELECT * FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'thing|stre') THEN 2 WHEN regexp_matches(lower(text), '\bthe\b') THEN 1
    WHEN regexp_matches(lower(text), 'und|de la') THEN 0 END::INT AS label FROM documents) WHERE label IS NOT NULL""")
def _(s, d):
    return labels.grade_text(table(s, d, "documents"), "text", ((r"thing|stre", 2), (r"\bthe\b", 1), (r"und|de la", 0))).select("doc_id", "label")


@query("p13_presence_text", """SELECT * FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'no thing|the thing') THEN 0 WHEN regexp_matches(lower(text), 'und|normal') AND NOT contains(lower(text), 'thing') THEN 0
    WHEN contains(lower(text), 'thing') THEN 1 END::INT AS label FROM documents) WHERE label IS NOT NULL""")
def _(s, d):
    return labels.presence_text(table(s, d, "documents"), "text", "no thing|the thing", "und|normal", "thing").select("doc_id", "label")


@query("p14_sum_first_two", r"""SELECT page_id, label FROM (SELECT page_id, list_sum(list_transform(regexp_extract_all(replace(html, chr(10), ' '), '(\d+)\s*(?:\)|&|<)', 1)[1:2], lambda x: x::BIGINT))::BIGINT AS label FROM pages) WHERE label IS NOT NULL""")
def _(s, d):
    return labels.sum_first_two(table(s, d, "pages"), "html", r"(?:\)|&|<)").select("page_id", "label")


def _orders(s, d):
    return table(s, d, "orders").withColumn("split", F.when(C("o_orderkey") % 10 < 7, "TRAIN").when(C("o_orderkey") % 10 < 9, "VAL").otherwise("TEST"))


STATS = "s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders WHERE o_orderkey % 10 < 7)"


@query("p15_standardize_label", f"WITH {STATS} SELECT o_orderkey, round((o_totalprice - m) / sd, 6) AS z, round(o_totalprice, 4) AS back FROM orders, s")
def _(s, d):
    o = _orders(s, d)
    stats = metrics.label_stats(o.where("split = 'TRAIN'"), "o_totalprice")
    z = labels.standardize_label(o, stats, "o_totalprice").select("o_orderkey", "z")
    return labels.destandardize(z, stats).select("o_orderkey", r6("z"), F.round("label", 4).alias("back"))


@query("p16_binary_target", "SELECT o_orderkey, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS target FROM orders")
def _(s, d):
    return labels.binary_target(table(s, d, "orders"), ("1-URGENT", "2-HIGH"), "o_orderpriority").select("o_orderkey", "target")


@query("p17_encode_labels", "WITH c AS (SELECT lab, (row_number() OVER (ORDER BY lab) - 1)::INT AS code FROM (SELECT DISTINCT o_orderpriority AS lab FROM orders WHERE o_orderkey % 10 < 7)) SELECT o_orderkey, code FROM orders JOIN c ON lab = o_orderpriority")
def _(s, d):
    o = _orders(s, d)
    return labels.encode_labels(o, labels.label_codes(o.where("split = 'TRAIN'"), "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


MEMBERS = "CASE event_id % 5 WHEN 0 THEN 'a/b/' || event_id || '.frames.npz' WHEN 1 THEN event_id || '.x.frames.npy' WHEN 2 THEN event_id || '.metadata.json' WHEN 3 THEN event_id || '.txt' ELSE '.frames.npy' END"


@query("p18_parse_member", f"""SELECT event_id, regexp_replace(n, '\\.(frames\\.(npy|npz)|metadata\\.json)$', '') AS key, right(n, length(n) - length(regexp_replace(n, '[^.]*$', ''))) AS fmt
    FROM (SELECT event_id, string_split({MEMBERS}, '/')[-1] AS n FROM events) WHERE event_id % 5 < 3""")
def _(s, d):
    return labels.parse_member(table(s, d, "events").withColumn("member", F.expr(MEMBERS))).select("event_id", "key", "fmt")


@query("p19_build_text", """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN event_type WHEN 'click' THEN event_type ELSE 'nan' END AS v, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'lv ' || event_id END AS a,
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS b, CASE WHEN event_id % 7 = 0 THEN '' ELSE ' tag ' END AS t, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS age FROM events),
    p AS (SELECT *, CASE WHEN v = 'view' THEN [nullif(trim(a), '')] WHEN v = 'click' THEN [nullif(trim(b), '')] ELSE [nullif(trim(a), ''), nullif(trim(b), '')] END AS own, [nullif(trim(a), ''), nullif(trim(b), '')] AS every FROM e),
    q AS (SELECT *, list_filter(own, lambda x: x IS NOT NULL) AS o2, list_filter(every, lambda x: x IS NOT NULL) AS e2 FROM p),
    r AS (SELECT event_id, list_concat(list_concat(list_filter(['Age: ' || age::INT || ' years.'], lambda x: x IS NOT NULL), CASE WHEN len(o2) > 0 THEN o2 ELSE e2 END), list_filter([nullif(trim(t), '')], lambda x: x IS NOT NULL)) AS parts FROM q)
    SELECT event_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE 'No clinical information available.' END AS text FROM r""")
def _(s, d):
    e = table(s, d, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN event_type WHEN 'click' THEN event_type ELSE 'nan' END AS v", "CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'lv ' || event_id END AS a",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS b", "CASE WHEN event_id % 7 = 0 THEN '' ELSE ' tag ' END AS t", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS age", "cast(null as string) AS ef",
    )
    return labels.build_text(e, "v", "age", "ef", ("a", "b"), ("t",), {"view": ("a",), "click": ("b",)}).select("event_id", "text")


LOGITS = "[10 * (l_discount + 0.0), 10 * l_tax, l_quantity / 25]"


def logits(s, d):
    li = table(s, d, "lineitem").withColumn("logits", F.array((C("l_discount") + 0.0) * 10, C("l_tax") * 10, C("l_quantity") / 25))
    y = F.when(C("l_returnflag") == "A", 0).when(C("l_returnflag") == "N", 1).otherwise(2)
    return li.withColumn("y", y).withColumn("probs", fn.softmax(C("logits"))).withColumn("pred", fn.argmax(C("logits")))


MULTI = f"""m AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, {LOGITS} AS lg FROM lineitem),
    k AS (SELECT *, list_position(lg, list_max(lg)) - 1 AS pred, list_sum(list_transform(lg, lambda x: exp(x - list_max(lg)))) AS z FROM m),
    p AS (SELECT *, list_transform(lg, lambda x: exp(x - list_max(lg)) / z) AS probs FROM k)"""


@query("p20_softmax", f"WITH {MULTI} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(probs[1], 6) AS p0, round(probs[2], 6) AS p1, round(probs[3], 6) AS p2 FROM p")
def _(s, d):
    return logits(s, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *(r6(C("probs")[i], f"p{i}") for i in range(3)))


@query("p21_argmax_topk", f"WITH {MULTI} SELECT pred::INT AS pred, y::INT AS y, (len(list_filter(lg, lambda x: x > lg[y + 1])) < 2) AS hit, count(*) AS n FROM p GROUP BY ALL")
def _(s, d):
    return logits(s, d).withColumn("hit", fn.topk_hit(C("logits"), C("y"), 2)).groupBy("pred", "y", "hit").agg(F.count("*").alias("n"))


BINARY = "b AS (SELECT *, (l_returnflag = 'R')::INT AS y, round((l_discount + 0.0) * 5 + l_tax * 2 + l_quantity / 200, 4) AS score FROM lineitem)"


def binary(s, d):
    score = F.round((C("l_discount") + 0.0) * 5 + C("l_tax") * 2 + C("l_quantity") / 200, 4)
    return table(s, d, "lineitem").withColumn("y", (C("l_returnflag") == "R").cast("int")).withColumn("score", score)


@query("p22_predict_at", f"WITH {BINARY} SELECT (score >= 0.5)::INT AS pred, y, count(*) AS n FROM b GROUP BY ALL")
def _(s, d):
    return labels.predict_at(binary(s, d)).groupBy("pred", "y").agg(F.count("*").alias("n"))


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS e FROM v)"


def units(s, d):
    return table(s, d, "embeddings").withColumn("embedding", fn.l2_normalize(C("embedding")))


@query("p23_l2_normalize", f"WITH {VEC} SELECT vec_id, round(e[1], 6) AS first, round(e[64], 6) AS last, round(list_sum(e), 6) AS total FROM u")
def _(s, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return units(s, d).select("vec_id", r6(C("embedding")[0], "first"), r6(C("embedding")[63], "last"), r6(total, "total"))


@query("p24_group_key", "SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN role END, CASE WHEN turn % 2 = 0 THEN 'even' END, 'unknown') AS group_key FROM conversations")
def _(s, d):
    c = table(s, d, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 3 = 0 THEN role END AS a", "CASE WHEN turn % 2 = 0 THEN 'even' END AS b")
    return labels.group_key(c, ["a", "b"]).select("conv_id", "turn", "group_key")


@query("p25_sample_metadata", """SELECT page_id, '{"page_id":' || page_id || ',"size":' || CASE WHEN page_id % 3 > 0 THEN (page_id % 3)::VARCHAR ELSE 'null' END || ',"host":"' || split_part(url, '/', 3) || '"}' AS metadata FROM pages""")
def _(s, d):
    p = table(s, d, "pages").withColumn("size", C("page_id") % 3).withColumn("host", F.element_at(F.split("url", "/"), 3))
    return labels.sample_metadata(p, ["page_id", "size"], ["host"], ["size"]).select("page_id", "metadata")


LONG = "long AS (SELECT event_type AS task, metric, avg(value * f) AS value, min(value * f) AS lower, max(value * f) AS upper FROM events, (VALUES ('auc', 1.0), ('mae', 2.0)) t(metric, f) GROUP BY ALL)"


def long_report(s, d):
    t = s.createDataFrame([("auc", 1.0), ("mae", 2.0)], "metric string, f double")
    return table(s, d, "events").crossJoin(F.broadcast(t)).groupBy(C("event_type").alias("task"), "metric").agg(F.avg(C("value") * C("f")).alias("value"), F.min(C("value") * C("f")).alias("lower"), F.max(C("value") * C("f")).alias("upper"))


@query("p26_flatten_report", f"""WITH {LONG} SELECT task, round(max(value) FILTER (metric = 'auc'), 4) AS auc, round(max(lower) FILTER (metric = 'auc'), 4) AS auc_lo, round(max(upper) FILTER (metric = 'auc'), 4) AS auc_hi,
    round(max(value) FILTER (metric = 'mae'), 4) AS mae, round(max(lower) FILTER (metric = 'mae'), 4) AS mae_lo, round(max(upper) FILTER (metric = 'mae'), 4) AS mae_hi FROM long GROUP BY task""")
def _(s, d):
    return labels.flatten_report(long_report(s, d), ["task"], ["auc", "mae"])


# joins and sets


@query("j01_enrich_manifest", "WITH m AS (SELECT l_orderkey, l_suppkey, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) SELECT o_orderkey, coalesce(l_suppkey, -1) AS l_suppkey, coalesce(l_tax, -1.0) AS l_tax FROM orders LEFT JOIN m ON l_orderkey = o_orderkey AND rn = 1")
def _(s, d):
    meta = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.enrich_manifest(table(s, d, "orders"), meta, "o_orderkey", ["l_suppkey", "l_tax", "absent"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("o_orderkey", F.coalesce("l_suppkey", F.lit(-1)).alias("l_suppkey"), F.coalesce("l_tax", F.lit(-1.0)).alias("l_tax"))


@query("j02_attach_annotations", "SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS kind, p.url FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id")
def _(s, d):
    ann = table(s, d, "labels").select("doc_id", C("quality").cast("string").alias("kind"))
    return joins.attach_annotations(table(s, d, "documents").select("doc_id"), ann, table(s, d, "pages").select(C("page_id").alias("doc_id"), "url"), "doc_id", "doc_id", "kind")


@query("j03_keep_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    ids = table(s, d, "lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("o_orderkey"))
    return joins.keep_ids(table(s, d, "orders"), ids, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("j04_drop_ids", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(s, d):
    return joins.drop_ids(table(s, d, "documents"), table(s, d, "labels"), "doc_id").select("doc_id", "source")


@query("j05_propagate_labels", f"WITH {ITEMS} SELECT id, study, o_orderpriority AS label FROM items JOIN orders ON study = o_orderkey WHERE type = 'Standard' AND n_frames >= 8")
def _(s, d):
    lab = table(s, d, "orders").select(C("o_orderkey").alias("study"), C("o_orderpriority").alias("label"))
    return joins.propagate_labels(lab, labels.eligible_items(items(s, d)), "study").select("id", "study", "label")


@query("j06_labelled_embeddings", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, quality FROM embeddings JOIN labels ON vec_id = doc_id")
def _(s, d):
    lab = table(s, d, "labels").select(C("doc_id").alias("vec_id"), "quality")
    return joins.labelled_embeddings(table(s, d, "embeddings"), lab, "vec_id").select("vec_id", r6(C("embedding")[0].cast("double"), "x"), "quality")


@query("j07_attach_site", "SELECT o_orderkey, CASE WHEN c_nationkey < 20 THEN c_nationkey::VARCHAR ELSE '' END AS site FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    sites = table(s, d, "customer").where("c_nationkey < 20").select(C("c_custkey").alias("o_custkey"), C("c_nationkey").cast("string").alias("site"))
    known = table(s, d, "orders").join(table(s, d, "customer"), C("o_custkey") == C("c_custkey"), "left_semi")
    return joins.attach_site(known, sites, "o_custkey", "site").select("o_orderkey", "site")


@query("j08_pairwise_similarity", f"WITH {VEC}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.e, b.e) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id) SELECT a, count(*) AS n, round(sum(sim), 4) AS total, round(max(sim), 6) AS best FROM s GROUP BY a")
def _(s, d):
    return retrieval.similarity_rows(units(s, d), "vec_id").select("a", "n", F.round("total", 4).alias("total"), r6("best"))


@query("j09_missing_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(s, d):
    return joins.missing_ids(table(s, d, "documents"), table(s, d, "labels"), "doc_id")


@query("j10_locate", "SELECT vec_id, vec_id // 50 AS shard FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(s, d):
    index = table(s, d, "embeddings").select("vec_id", F.floor(C("vec_id") / 50).alias("shard"))
    return joins.locate(index, table(s, d, "labels").select(C("doc_id").alias("vec_id")), "vec_id")


def _ids(s, d, where):
    return table(s, d, "orders").where(where).select("o_orderkey")


@query("u01_union_ids", "SELECT o_orderkey FROM orders WHERE o_totalprice < 50000 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def _(s, d):
    return joins.union_ids(_ids(s, d, "o_totalprice < 50000"), _ids(s, d, "o_orderstatus = 'F'"), _ids(s, d, "o_orderpriority = '5-LOW'"))


@query("u02_union_label_ids", "SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings UNION SELECT page_id FROM pages")
def _(s, d):
    return joins.union_label_ids(table(s, d, "labels").select("doc_id"), table(s, d, "embeddings").select("vec_id"), table(s, d, "pages").select("page_id"))


@query("u03_common_ids", "SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def _(s, d):
    return joins.common_ids(table(s, d, "labels").select("doc_id"), table(s, d, "embeddings").select("vec_id"))


@query("u04_subtract_ids", "SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels")
def _(s, d):
    return joins.subtract_ids(table(s, d, "embeddings").select("vec_id"), table(s, d, "labels").select("doc_id"))


@query("u05_skip_set", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL UNION SELECT page_id FROM pages WHERE page_id IS NOT NULL)")
def _(s, d):
    skip = joins.skip_set(table(s, d, "labels").select("doc_id"), table(s, d, "pages").select("page_id"))
    return joins.drop_ids(table(s, d, "documents").select("doc_id"), skip, "doc_id")


@query("u06_stack_splits", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM orders WHERE o_orderkey % 10 >= 7")
def _(s, d):
    o = _orders(s, d)
    return joins.stack_splits(val=o.where("split = 'VAL'").select("o_orderkey"), test=o.where("split = 'TEST'").select("o_orderkey"))


def sited(s, d):
    c = table(s, d, "customer").select(C("c_custkey").alias("o_custkey"), C("c_nationkey").alias("site"))
    return table(s, d, "orders").join(c, "o_custkey", "left").select(C("o_orderkey").alias("id"), "site")


SPLIT = f"""o AS (SELECT o_orderkey AS id, c_nationkey AS site FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    f AS (SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT, id) AS rn FROM o WHERE site IS NULL OR site NOT IN {HELD_SITES}),
    sp AS (SELECT o.id, site, CASE WHEN site IN {HELD_SITES} THEN 'holdout' WHEN rn <= (SELECT greatest(1, floor(count(*) * 0.1::DOUBLE)) FROM f) THEN 'val' ELSE 'train' END AS split FROM o LEFT JOIN f USING (id))"""


@query("u07_audit_splits", f"""WITH {SPLIT} SELECT 'ids_in_several_splits' AS "check", count(*) AS n FROM (SELECT id FROM sp GROUP BY id HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'held_site_outside_holdout', count(*) FROM sp WHERE site IN {HELD_SITES} AND split <> 'holdout'
    UNION ALL SELECT 'other_site_in_holdout', count(*) FROM sp WHERE site NOT IN {HELD_SITES} AND split = 'holdout'
    UNION ALL SELECT 'labels_in_no_split', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM sp)""")
def _(s, d):
    done = splits.split_studies(sited(s, d), 0.1, 42, list(HELD_SITES))
    return joins.audit_splits(done, table(s, d, "orders").select(C("o_orderkey").alias("id")), list(HELD_SITES))


# aggregates


@query("a01_class_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return metrics.class_counts(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("a02_class_weights", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT count(*) AS k, sum(n) AS total, sum(1 / (n + 1e-6)) AS inv FROM c)
    SELECT lang, n, round(total / (k * n), 6) AS balanced, round(1 / (n + 1e-6) / inv * k, 6) AS inverse FROM c, t""")
def _(s, d):
    docs = table(s, d, "documents")
    a, b = metrics.class_weights(docs, "balanced", "lang"), metrics.class_weights(docs, "inverse", "lang")
    return a.select("lang", "n", r6("weight", "balanced")).join(b.select("lang", r6("weight", "inverse")), "lang")


@query("a03_label_stats", "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, count(o_totalprice) AS n FROM orders WHERE o_orderkey % 10 < 7")
def _(s, d):
    t = metrics.label_stats(_orders(s, d).where("split = 'TRAIN'"), "o_totalprice")
    return t.select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", "n")


def studies(s, d):
    return table(s, d, "embeddings").withColumn("study", C("vec_id") % 97)


@query("a04_mean_pool", "WITH x AS (SELECT vec_id % 97 AS study, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT study, i, avg(x) AS x FROM x GROUP BY ALL) SELECT study, round(sum(x), 5) AS total, round(max(x) FILTER (i = 1), 6) AS first, round(max(x) FILTER (i = 64), 6) AS last FROM m GROUP BY study")
def _(s, d):
    p = vectors.mean_pool(studies(s, d), "study")
    return p.select("study", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), r6(C("embedding")[0], "first"), r6(C("embedding")[63], "last"))


@query("a05_confusion", f"WITH {MULTI}, g AS (SELECT a.range::INT AS y, b.range::INT AS pred FROM range(3) a, range(3) b), c AS (SELECT g.y, g.pred, count(p.y) AS n FROM g LEFT JOIN p ON g.y = p.y AND g.pred = p.pred GROUP BY ALL) SELECT y, pred, n, round(n / (sum(n) OVER (PARTITION BY y) + 1e-10), 6) AS share FROM c")
def _(s, d):
    return metrics.confusion(logits(s, d), 3).select("y", "pred", "n", r6("share"))


REPORT = f"""{MULTI}, cl AS (SELECT range::INT AS class FROM range(3)),
    cr AS (SELECT class, count(*) FILTER (y = class AND pred = class) AS tp, count(*) FILTER (y <> class AND pred = class) AS fp, count(*) FILTER (y = class AND pred <> class) AS fn, count(*) AS total FROM p, cl GROUP BY class),
    rep AS (SELECT class, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
        coalesce((total - tp - fp - fn) / nullif(total - tp - fn, 0), 0) AS specificity FROM cr)"""


@query("a06_classification_metrics", f"WITH {REPORT} SELECT (SELECT round(avg((y = pred)::INT), 6) FROM p) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM rep")
def _(s, d):
    return metrics.classification_metrics(logits(s, d)).select(*(r6(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("a06_class_report", f"WITH {REPORT} SELECT class, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep")
def _(s, d):
    return metrics.class_report(logits(s, d)).select("class", "support", *(r6(c) for c in ("precision", "recall", "f1")))


@query("a06_binary_metrics", f"""WITH {BINARY}, c AS (SELECT count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) AS n FROM b)
    SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(s, d):
    return metrics.classification_metrics(labels.predict_at(binary(s, d)), "binary").select(*(r6(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("a07_balanced_accuracy", f"WITH {REPORT} SELECT round(avg(recall), 6) AS balanced_accuracy FROM rep WHERE support > 0")
def _(s, d):
    return metrics.balanced_accuracy(logits(s, d)).select(r6("balanced_accuracy"))


@query("a08_specificity", f"WITH {REPORT} SELECT round(avg(specificity), 6) AS specificity FROM rep")
def _(s, d):
    return metrics.specificity(logits(s, d), 3).select(r6("specificity"))


CURVE = f"{BINARY}, g AS (SELECT score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY score), cv AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM g WINDOW o AS (ORDER BY score DESC))"


@query("a09_roc_auc", f"WITH {CURVE} SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM cv")
def _(s, d):
    return metrics.roc_auc(binary(s, d)).select(r6("auc"))


@query("a09_roc_auc_macro", f"""WITH {MULTI}, o AS (SELECT unnest(probs) AS score, generate_subscripts(probs, 1) - 1 AS class, y FROM p), g AS (SELECT class, round(score, 9) AS score, sum((y = class)::INT)::DOUBLE AS pos, sum((y <> class)::INT)::DOUBLE AS neg FROM o GROUP BY ALL),
    cv AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY score DESC) AS tp FROM g), a AS (SELECT class, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM cv GROUP BY class) SELECT round(avg(auc), 6) AS auc FROM a""")
def _(s, d):
    rounded = logits(s, d).withColumn("probs", F.transform("probs", lambda p: F.round(p, 9)))
    return metrics.macro(metrics.roc_auc, rounded, "auc").select(r6("auc"))


@query("a10_average_precision", f"WITH {CURVE} SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM cv")
def _(s, d):
    return metrics.average_precision(binary(s, d)).select(r6("ap"))


@query("a11_auprc_trapezoid", f"""WITH {CURVE}, pr AS (SELECT score, tp, tp / (tp + fp) AS p, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0, lag(tp / (tp + fp), 1, 1) OVER (ORDER BY score DESC) AS p0 FROM cv)
    SELECT round(sum((tp - tp0) * (p + p0) / 2) / (SELECT sum(y) FROM b), 6) AS auprc FROM pr""")
def _(s, d):
    return metrics.auprc_trapezoid(binary(s, d)).select(r6("auprc"))


@query("a12_ece", f"WITH {MULTI}, c AS (SELECT list_max(probs) AS conf, (list_position(probs, list_max(probs)) - 1 = y)::INT AS ok FROM p), g AS (SELECT greatest(1, ceil(conf * 15)) AS bin, abs(sum(ok) - sum(conf)) AS e, count(*) AS n FROM c GROUP BY 1) SELECT round(sum(e) / sum(n), 5) AS ece FROM g")
def _(s, d):
    return metrics.ece(metrics.confidence(logits(s, d), probs="logits")).select(F.round("ece", 5).alias("ece"))


@query("a12_ece_binary", f"WITH {BINARY}, q AS (SELECT least(1, greatest(0, score)) AS p, y FROM b), c AS (SELECT CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS conf, ((p >= 0.5)::INT = y)::INT AS ok FROM q), g AS (SELECT greatest(1, ceil(conf * 15)) AS bin, abs(sum(ok) - sum(conf)) AS e, count(*) AS n FROM c GROUP BY 1) SELECT round(sum(e) / sum(n), 5) AS ece FROM g")
def _(s, d):
    return metrics.ece(metrics.confidence(binary(s, d), score="score")).select(F.round("ece", 5).alias("ece"))


@query("a13_brier", f"WITH {MULTI}, {BINARY} SELECT (SELECT round(avg((probs[1] - (y = 0)::INT)**2 + (probs[2] - (y = 1)::INT)**2 + (probs[3] - (y = 2)::INT)**2), 6) FROM p) AS multi, (SELECT round(avg((score - y)**2), 6) FROM b) AS two")
def _(s, d):
    a, b = metrics.brier(logits(s, d), probs="probs").select(r6("brier", "multi")), metrics.brier(binary(s, d), score="score").select(r6("brier", "two"))
    return a.crossJoin(F.broadcast(b))


@query("a14_accuracy_pvalue")
def _(s, d):
    return metrics.accuracy_pvalue(logits(s, d), 3, ["l_suppkey"])


REG = "rg AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS pred FROM lineitem JOIN part ON l_partkey = p_partkey)"


def regression(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), C("l_partkey") == C("p_partkey")).select(C("l_extendedprice").alias("y"), (C("l_quantity") * C("p_retailprice")).alias("pred"))


@query("a15_regression_metrics", f"WITH {REG} SELECT round(avg(abs(y - pred)), 3) AS mae, round(sqrt(avg((y - pred)**2)), 3) AS rmse, round(1 - sum((y - pred)**2) / (var_pop(y) * count(*)), 5) AS r2, round(corr(y, pred), 5) AS pearson FROM rg")
def _(s, d):
    return metrics.regression_metrics(regression(s, d)).select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 5).alias("r2"), F.round("pearson", 5).alias("pearson"))


@query("a16_spearman", f"WITH {REG}, k AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2 AS rp FROM rg) SELECT round(corr(ry, rp), 6) AS spearman FROM k")
def _(s, d):
    return metrics.spearman(regression(s, d)).select(r6("spearman"))


BOOT = """n AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, (label < 5)::INT AS y, (embedding[1] + embedding[2] > 0)::INT AS pred, embedding[3]::DOUBLE AS x FROM embeddings), c AS (SELECT count(*) AS n FROM n),
    w AS (SELECT replicate, ('0x' || substr(md5('42:' || replicate || ':' || draw), 1, 8))::BIGINT % (SELECT n FROM c) + 1 AS row FROM (SELECT range AS replicate FROM range(200)), (SELECT unnest(range(1, n + 1)) AS draw FROM c))"""


def numbered(s, d):
    e = table(s, d, "embeddings").select("vec_id", (C("label") < 5).cast("int").alias("y"), (C("embedding")[0] + C("embedding")[1] > 0).cast("int").alias("pred"), C("embedding")[2].cast("double").alias("x"))
    return ranks.row_numbers(e, "vec_id", name="row")


@query("a17_bootstrap_ci", f"""WITH {BOOT}, a AS (SELECT replicate, avg((y = pred)::INT) AS acc, avg(abs(y - x)) AS mae FROM w JOIN n USING (row) GROUP BY replicate)
    SELECT 'accuracy' AS metric, (SELECT round(avg((y = pred)::INT), 6) FROM n) AS value, round(quantile_cont(acc, 0.025), 6) AS lower, round(quantile_cont(acc, 0.975), 6) AS upper FROM a
    UNION ALL SELECT 'mae', (SELECT round(avg(abs(y - x)), 6) FROM n), round(quantile_cont(mae, 0.025), 6), round(quantile_cont(mae, 0.975), 6) FROM a""")
def _(s, d):
    data = numbered(s, d)
    w = written(metrics.draws(data, 200, 42), "draws")
    acc = metrics.bootstrap_ci(data, lambda df, by, wt: metrics.classification_metrics(df, "macro", by, wt).select(*by, "accuracy"), ["accuracy"], weights=w)
    mae = metrics.bootstrap_ci(data, lambda df, by, wt: metrics.regression_metrics(df, by, wt, pred="x"), ["mae"], weights=w)
    return acc.unionByName(mae).select("metric", r6("value"), r6("lower"), r6("upper"))


@query("a17_bootstrap_auc", f"""WITH {BOOT}, g AS (SELECT replicate, x, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM w JOIN n USING (row) GROUP BY ALL), cv AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY x DESC) AS tp FROM g),
    a AS (SELECT replicate, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM cv GROUP BY replicate), pt AS (SELECT x, y, (SELECT count(*) FROM n m WHERE m.y = 0 AND m.x < n.x) + (SELECT count(*) FROM n m WHERE m.y = 0 AND m.x = n.x) / 2 AS won FROM n)
    SELECT 'auc' AS metric, (SELECT round(sum(won) FILTER (y = 1) / ((count(*) FILTER (y = 1)) * (count(*) FILTER (y = 0))), 6) FROM pt) AS value, round(quantile_cont(auc, 0.025), 6) AS lower, round(quantile_cont(auc, 0.975), 6) AS upper FROM a""")
def _(s, d):
    data = numbered(s, d)
    w = written(metrics.draws(data, 200, 42), "draws")
    return metrics.bootstrap_ci(data, lambda df, by, wt: metrics.roc_auc(df, by, wt, score="x"), ["auc"], weights=w).select("metric", r6("value"), r6("lower"), r6("upper"))


@query("a17_multinomial_totals", "SELECT replicate, n AS drawn, n AS rows FROM (SELECT unnest(range(1000)) AS replicate), (SELECT count(*) AS n FROM embeddings)")
def _(s, d):
    got = bootstrap.replicate_sums(table(s, d, "embeddings"), {"rows": F.lit(1)}, ["vec_id"], 1000)
    return got.select("replicate", "drawn", C("rows").cast("long").alias("rows"))


@query("a17_bootstrap_thousand")
def _(s, d):
    data = numbered(s, d)
    sums = {"right": (C("y") == C("pred")).cast("int"), "off": F.abs(C("y") - C("x")), "square": (C("y") - C("x")) ** 2}
    values = {"accuracy": C("right") / C("drawn"), "mae": C("off") / C("drawn"), "rmse": F.sqrt(C("square") / C("drawn"))}
    return bootstrap.sums_ci(data, sums, values, ["row"], 1000).select("metric", r6("value"), r6("lower"), r6("upper"))


@query("a18_calibrate_threshold", f"""WITH {BINARY}, t AS (SELECT range / 100 AS t FROM range(1, 100)), m AS (SELECT t, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp, count(*) FILTER (y = 1) AS p FROM b, t GROUP BY t)
    SELECT t AS threshold, round(2 * tp / (tp + fp + p), 6) AS value FROM m ORDER BY 2 * tp / (tp + fp + p) DESC, t LIMIT 1""")
def _(s, d):
    return metrics.calibrate_threshold(binary(s, d)).select("threshold", r6("value"))


PAIRS = f"{VEC}, pr AS (SELECT list_inner_product(a.e, b.e) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id)"


@query("a19_similarity_stats", f"WITH {PAIRS} SELECT round(avg(sim), 6) AS mean, round(stddev_samp(sim), 6) AS std, round(min(sim), 6) AS min, round(max(sim), 6) AS max, round(quantile_disc(sim, 0.5), 6) AS median FROM pr")
def _(s, d):
    return retrieval.similarity_stats(units(s, d), "vec_id").select(*(r6(c) for c in ("mean", "std", "min", "max", "median")))


KNN = f"{VEC}, s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_inner_product(a.e, b.e), 9) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id), kn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM s QUALIFY rank <= 10)"


def neighbours(s, d, k=10):
    return retrieval.knn(units(s, d), k, "vec_id", digits=9)


@query("w01_knn", f"WITH {KNN} SELECT id, neighbour, round(sim, 6) AS sim, rank::INT AS rank FROM kn")
def _(s, d):
    return neighbours(s, d).select("id", "neighbour", r6("sim"), "rank")


@query("a20_retrieval_at_k", f"""WITH {KNN}, q AS (SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 1)), h AS (SELECT q.id, rank, (q.label = e.label)::INT AS hit FROM kn JOIN q USING (id) JOIN embeddings e ON e.vec_id = neighbour),
    f AS (SELECT id, k, max(CASE WHEN rank <= k THEN hit ELSE 0 END) AS r, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / k AS p FROM h, (VALUES (1), (5), (10)) t(k) GROUP BY id, k) SELECT k, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision FROM f GROUP BY k""")
def _(s, d):
    got = retrieval.retrieval_at_k(neighbours(s, d), table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), (1, 5, 10))
    return got.select("k", r6("recall"), r6("precision"))


@query("a21_knn_similarity", f"WITH {KNN} SELECT round(avg(sim) FILTER (rank = 1), 6) AS nn1, round(avg(sim), 6) AS nn10 FROM kn")
def _(s, d):
    return retrieval.knn_similarity(neighbours(s, d)).select(r6("nn1"), r6("nn10"))


@query("a22_uniformity", f"WITH {PAIRS}, n AS (SELECT count(*) AS n FROM u) SELECT round(ln((2 * sum(exp(-2 * (2 - 2 * sim))) + max(n) * exp(-8)) / (max(n) * max(n))), 6) AS uniformity FROM pr, n")
def _(s, d):
    return retrieval.uniformity(units(s, d), "vec_id").select(r6("uniformity"))


@query("a23_effective_rank")
def _(s, d):
    return vectors.effective_rank(units(s, d)).select(r6("effective_rank"))


@query("a24_summary", f"WITH {LONG}, z AS (SELECT task, metric, value, lower, upper FROM long) SELECT task, round(max(value) FILTER (metric = 'auc'), 4) AS val_auc, round(max(lower) FILTER (metric = 'auc'), 4) AS val_auc_lo, round(max(upper) FILTER (metric = 'auc'), 4) AS val_auc_hi, NULL::DOUBLE AS test_auc, NULL::DOUBLE AS test_auc_lo, NULL::DOUBLE AS test_auc_hi FROM z GROUP BY task")
def _(s, d):
    return reports.summary(long_report(s, d).withColumn("split", F.lit("val")), ["val", "test"], ["auc"])


@query("a25_scaling_table", """WITH v AS (SELECT event_type AS task, (event_id % CASE WHEN event_type = 'view' THEN 3 ELSE 4 END)::INT AS f, avg(value) AS value FROM events GROUP BY ALL),
    w AS (SELECT task, max(value) FILTER (f = 0) AS f0, max(value) FILTER (f = 1) AS f1, max(value) FILTER (f = 2) AS f2, max(value) FILTER (f = 3) AS f3 FROM v GROUP BY task), a AS (SELECT * FROM w UNION ALL SELECT 'mean', avg(f0), avg(f1), avg(f2), avg(f3) FROM w)
    SELECT task, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, round(f3 - f0, 6) AS delta FROM a""")
def _(s, d):
    fraction = C("event_id") % F.when(C("event_type") == "view", 3).otherwise(4)  # the task view has no fraction 3
    v = table(s, d, "events").groupBy(C("event_type").alias("task"), fraction.cast("int").alias("fraction")).agg(F.avg("value").alias("value"))
    return reports.scaling_table(v, (0, 1, 2, 3)).select("task", *(r6(c) for c in ("f0", "f1", "f2", "f3", "delta")))


def log(s, d):
    return table(s, d, "events").select(F.dayofyear("ts").alias("epoch"), C("value").alias("loss"), "event_id", "ts", "event_type")


@query("a26_log_rollup", """WITH e AS (SELECT dayofyear(ts)::INT AS epoch, avg(value) AS m FROM events GROUP BY 1), s AS (SELECT epoch, m, avg(m) OVER (ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM e)
    SELECT epoch, round(m, 6) AS mean_loss, round(sm, 6) AS mean_loss_smooth, round((SELECT min(m) FROM e), 6) AS min_loss, (SELECT max(epoch) FROM e) AS last_epoch, round((SELECT avg(m) FROM e WHERE epoch > (SELECT max(epoch) FROM e) - 10), 6) AS last_k_mean FROM s""")
def _(s, d):
    return reports.log_rollup(log(s, d)).select("epoch", r6("mean_loss"), r6("mean_loss_smooth"), r6("min_loss"), "last_epoch", r6("last_k_mean"))


@query("a27_histogram", """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(50, floor((value - lo) / ((hi - lo) / 50)) + 1)::INT AS bin, lo, hi FROM events, r)
    SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 50), 6) AS lo, round(lo + bin * ((hi - lo) / 50), 6) AS hi, count(*) AS n FROM b GROUP BY bin, b.lo, b.hi""")
def _(s, d):
    return metrics.histogram(table(s, d, "events"), "value").select("bin", r6("lo"), r6("hi"), "n")


@query("a28_corpus_estimate", "SELECT count(*) AS shards, count(*) * 1000 AS samples, floor(count(*) * 1000 / (8 * 4))::BIGINT AS batches_per_worker FROM (SELECT DISTINCT vec_id // 50 FROM embeddings)")
def _(s, d):
    return reports.corpus_estimate(table(s, d, "embeddings").select(F.floor(C("vec_id") / 50)).distinct(), 1000, 8, 4)


@query("a29_throughput", "SELECT event_type AS status, count(*) AS n, round(count(*) * 1e6 / (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events), 9) AS per_second FROM events GROUP BY 1")
def _(s, d):
    return reports.throughput(log(s, d).withColumnRenamed("event_type", "status")).select("status", "n", F.round("per_second", 9).alias("per_second"))


# windows, order, samples


@query("w02_top_items", f"WITH {ITEMS} SELECT study, id, n_frames, row_number() OVER (PARTITION BY study ORDER BY n_frames DESC NULLS LAST, id)::INT AS rn FROM items QUALIFY rn <= 3")
def _(s, d):
    return ranks.top_items(items(s, d), "study", "n_frames", "id").select("study", "id", "n_frames", "rn")


@query("w03_assign_shards", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 1000 + 7)::BIGINT AS shard_id FROM orders")
def _(s, d):
    return ranks.assign_shards(table(s, d, "orders"), 1000, "o_custkey", "o_orderkey", start=7).select("o_orderkey", "shard_id")


@query("w03_round_robin", "SELECT vec_id, ((row_number() OVER (ORDER BY vec_id // 50, vec_id) - 1) % 6)::INT AS worker FROM embeddings")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.floor(C("vec_id") / 50).alias("shard"))
    return ranks.assign_round_robin(e, 6, "shard", "vec_id").select("vec_id", "worker")


@query("w04_curve", f"WITH {CURVE} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM cv")
def _(s, d):
    return ranks.curve(binary(s, d)).select("score", "tp", "fp")


@query("w05_avg_rank", "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS rank FROM orders")
def _(s, d):
    return ranks.avg_rank(table(s, d, "orders"), "o_custkey").select("o_orderkey", "rank")


@query("w06_rolling_mean", "WITH e AS (SELECT dayofyear(ts)::INT AS epoch, avg(value) AS m FROM events GROUP BY 1) SELECT epoch, round(avg(m) OVER (ORDER BY epoch ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS m_smooth FROM e")
def _(s, d):
    e = log(s, d).groupBy("epoch").agg(F.avg("loss").alias("m"))
    return ranks.rolling_mean(e, "m", 10, "epoch").select("epoch", r6("m_smooth"))


@query("w07_resolve_duplicates", f"WITH {ITEMS} SELECT study, id, n_frames FROM items QUALIFY row_number() OVER (PARTITION BY study ORDER BY n_frames DESC, id DESC) = 1 UNION ALL SELECT -study - 1, id, n_frames FROM items QUALIFY row_number() OVER (PARTITION BY study ORDER BY n_frames, id) = 1")
def _(s, d):
    i = items(s, d).select("study", "id", "n_frames")
    first = ranks.resolve_duplicates(i, "study", ["n_frames", "id"], "first").withColumn("study", -C("study") - 1)
    return ranks.resolve_duplicates(i, "study", ["n_frames", "id"]).unionByName(first)


@query("w08_best_run", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1")
def _(s, d):
    return ranks.best_run(table(s, d, "events"), "value", "event_id", by=["event_type"]).select("event_type", "event_id", "value")


@query("l01_first_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(s, d):
    return ranks.first_rows(table(s, d, "orders"), 100, "o_orderkey").select("o_orderkey", "o_custkey")


@query("l02_physical_order", "SELECT vec_id, vec_id // 50 AS shard FROM embeddings")
def _(s, d):
    return ranks.physical_order(table(s, d, "embeddings").select("vec_id", F.floor(C("vec_id") / 50).alias("shard")), "shard", "vec_id")


@query("l03_split_studies", f"WITH {SPLIT} SELECT id, split FROM sp")
def _(s, d):
    return splits.split_studies(sited(s, d), 0.1, 42, list(HELD_SITES)).select("id", "split")


HASHED = "h AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY ('0x' || substr(md5('9:' || o_orderkey), 1, 8))::BIGINT, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"


@query("l04_take_fraction", f"WITH {HASHED} SELECT id FROM h WHERE rn <= greatest(1, floor(n * 0.05::DOUBLE))")
def _(s, d):
    return splits.take_fraction(table(s, d, "orders").select(C("o_orderkey").alias("id")), 0.05, 9)


@query("l05_sample_items", f"WITH {HASHED} SELECT id FROM h WHERE rn <= 500")
def _(s, d):
    return splits.sample_items(table(s, d, "orders").select(C("o_orderkey").alias("id")), 500, 9)


@query("l05_hash_split", "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT < (0.2::DOUBLE * 4294967296)::BIGINT THEN 'val' ELSE 'train' END AS split FROM orders")
def _(s, d):
    return splits.hash_split(table(s, d, "orders"), 0.2, 3, "o_orderkey").select("o_orderkey", "split")


@query("l06_cap_per_worker", "SELECT vec_id, ((rn - 1) % 4)::INT AS worker FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 200")
def _(s, d):
    return splits.cap_per_worker(table(s, d, "embeddings"), 50, 4, "vec_id").select("vec_id", "worker")


# sources and sinks that have a form on tables


@query("s06_task_labels", "SELECT o_orderkey, upper(o_orderstatus) AS split, o_orderpriority AS label FROM orders WHERE o_orderpriority <> '5-LOW'")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("study designation"), F.when(C("o_orderpriority") != "5-LOW", C("o_orderpriority")).alias("label"))
    return readers.task_labels(o)


@query("s07_item_manifest", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(s, d):
    return readers.read_item_manifest(s, f"{d}/lineitem.parquet", ("l_orderkey", "l_linenumber", "l_quantity"))


@query("s12_predictions", "SELECT event_id, value AS score, (value >= 30)::INT::DOUBLE AS pred FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.lit(1).alias("y_true"), C("value").alias("probability"))
    return readers.predictions(e, 30).select("event_id", "score", "pred")


@query("s13_train_log", "SELECT (event_id % 7)::INT AS epoch, event_id::INT AS itr, value AS loss FROM events WHERE event_id % 11 <> 0")
def _(s, d):
    e = table(s, d, "events").select(F.when(C("event_id") % 11 == 0, "epoch").otherwise((C("event_id") % 7).cast("string")).alias("epoch"), C("event_id").cast("string").alias("itr"), C("value").cast("string").alias("loss"))
    return readers.train_log(e)


@query("s14_read_embeddings", "SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def _(s, d):
    e = readers.read_embeddings(s, f"{d}/embeddings.parquet", "vec_id")
    return e.select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("k01_label_lines", "SELECT o_orderkey || ' ' || printf('%.6f', o_totalprice) AS value FROM orders")
def _(s, d):
    return writers.label_lines(table(s, d, "orders"), "o_orderkey", "o_totalprice").select("value")


@query("k06_upsert_embeddings", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END::INT AS version FROM embeddings")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id")
    return writers.upsert_embeddings(e.withColumn("version", F.lit(0)), e.where("vec_id % 3 = 0").withColumn("version", F.lit(1)), "vec_id")


# streams: their batch twins


# probes


@query("m01_standardize", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY i)
    SELECT vec_id, round(sum((x - m) / sd), 4) AS total, round(max((x - m) / sd) FILTER (i = 1), 5) AS first FROM x JOIN t USING (i) GROUP BY vec_id""")
def _(s, d):
    e = table(s, d, "embeddings")
    z = vectors.standardize(e, vectors.vector_stats(e))
    return z.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(C("embedding")[0], 5).alias("first"))


@query("m02_fit_classifier")
def _(s, d):
    from reelspark.operators import probes

    e = table(s, d, "embeddings").withColumn("target", (C("label") < 5).cast("int"))
    return probes.classify(probes.fit_classifier(e), e).select("vec_id", "pred", r6("score"))


@query("m03_fit_ridge")
def _(s, d):
    from reelspark.operators import probes

    e = table(s, d, "embeddings").withColumn("target", C("label").cast("double"))
    return probes.regress(probes.fit_ridge(e), e).select("vec_id", r6("pred"))


@query("m04_grid_probe")
def _(s, d):
    from reelspark.operators import probes

    e = table(s, d, "embeddings").withColumn("target", C("label").cast("double"))
    split = splits.hash_split(e, 0.3, 1, "vec_id")
    return probes.grid_probe(split.where("split = 'train'"), split.where("split = 'val'"), (0.1, 1.0, 10.0), "regression")[1]


@query("m04_grid_heads")
def _(s, d):
    from reelspark.operators import probes

    e = table(s, d, "embeddings").withColumn("target", (C("label") % 3).cast("int"))
    split = splits.hash_split(e, 0.3, 1, "vec_id")
    return probes.grid_heads(split.where("split = 'train'"), split.where("split = 'val'"), (0.01, 0.1), (0.0, 0.01), 8)[1]


@query("m05_run_task")
def _(s, d):
    from reelspark.operators import probes

    e = studies(s, d).select("study", "embedding")
    lab = studies(s, d).groupBy("study").agg(F.avg("label").alias("label")).withColumn("split", F.when(C("study") % 5 < 3, "TRAIN").when(C("study") % 5 == 3, "VAL").otherwise("TEST"))
    return probes.run_task(probes.Task("label_mean", "regression"), lab, e, replicates=100)


@query("m06_embed")
def _(s, d):
    from reelspark.operators import probes

    c = table(s, d, "conversations").select(C("conv_id").alias("id"), C("text").alias("clip"))
    return probes.embed(c, probes.hashing_encoder(8))


@query("m07_pca")
def _(s, d):
    out, shares = vectors.pca(table(s, d, "embeddings"), 2)
    return out.select("vec_id", r6(F.abs(C("pc")[0]), "pc1"), r6(F.abs(C("pc")[1]), "pc2"), F.lit(round(sum(shares), 6)).alias("explained"))


@query("m08_vote_clips", "SELECT l_orderkey AS id, round(avg(l_discount) * 2.5 + 4, 6) AS pred FROM lineitem GROUP BY 1")
def _(s, d):
    from reelspark.operators import probes

    return probes.vote_clips(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "id"), "id", "l_discount", 4.0, 2.5).select("id", r6("l_discount", "pred"))


@query("e2_retrieval", """WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id // 10 ORDER BY label DESC NULLS LAST, vec_id) <= 4),
    u AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS e FROM t), s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_inner_product(a.e, b.e), 9) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
    kn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM s QUALIFY rank <= 10), q AS (SELECT vec_id AS id, label FROM t WHERE label IN (SELECT label FROM t GROUP BY label HAVING count(*) > 1)),
    h AS (SELECT q.id, rank, (q.label = t.label)::INT AS hit FROM kn JOIN q USING (id) JOIN t ON t.vec_id = neighbour), f AS (SELECT id, k, max(CASE WHEN rank <= k THEN hit ELSE 0 END) AS r, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / k AS p FROM h, (VALUES (1), (5), (10)) v(k) GROUP BY id, k)
    SELECT k, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision FROM f GROUP BY k""")
def flagship(s: SparkSession, d: str) -> DataFrame:
    """Embeddings -> top items of a study, ten vectors each -> unit vectors -> neighbours -> recall and precision at k."""
    e = table(s, d, "embeddings").withColumn("study", F.floor(C("vec_id") / 10))
    top = written(ranks.top_items(e, "study", "label", "vec_id", 4).select("vec_id", "label", "embedding"), "top")
    nn = retrieval.knn(retrieval.unit(top), 10, "vec_id", digits=9)
    return retrieval.retrieval_at_k(nn, top.withColumnRenamed("vec_id", "id"), (1, 5, 10)).select("k", r6("recall"), r6("precision"))


from reelspark import file_queries  # noqa: E402, F401  (registers the queries of files and streams)
