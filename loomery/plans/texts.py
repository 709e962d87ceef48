"""Queries on texts, retrieval, recommendation vectors and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.operators import graph as J
from loomery.operators import recsys as H
from loomery.operators import text as I
from loomery.session import stage_table, table


def _r(df, places: int, *cols: str):
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def _bm25(s, d, k=10):
    return I.bm25(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text", k)


def bm25_search(s, d):
    return _r(_bm25(s, d), 4, "score")


def rrf_fusion(s, d):
    a = _bm25(s, d, 10).select("query", "doc", "rank")
    # the second list: documents dealt over the items' ids by their length, the longest first
    items = F.broadcast(table(s, d, "benchmark").agg((F.max("item_id") + 1).alias("n_items")))  # one row
    b = H.top_k(table(s, d, "documents").crossJoin(items).select("doc_id", (F.col("n_chars") % F.col("n_items")).alias("query"), "n_chars"), ["query"], [F.desc("n_chars"), F.col("doc_id")], 10)
    return I.rrf(a.unionByName(b.select(F.col("query").cast("long"), F.col("doc_id").alias("doc"), "rank")), "query", "doc", "rank")


def lexical_rerank(s, d):
    q = table(s, d, "benchmark").select("item_id", F.col("text").alias("q"))
    c = _bm25(s, d, 5).join(q, F.col("query") == F.col("item_id")).join(table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return _r(I.rerank_scores(c, "query", "q", "doc", "text"), 5, "coverage", "tf_score", "position", "rerank_score")


def ir_metrics(s, d):
    ranked = _bm25(s, d, 10)
    # relevant: documents that hold the item's whole text
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("whole"))
    rel = table(s, d, "documents").join(b, F.col("text").contains(F.col("whole"))).select("query", F.col("doc_id").alias("doc"))
    return _r(I.ir_metrics(ranked, rel, "query", "doc", "rank", 10), 6, "precision", "recall", "rr", "ap", "ndcg")


def _mentions(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z])([A-Z]{4,})(?:$|[^A-Za-z])"), F.lit(1))).alias("e"))


def cooccurrence_graph(s, d):
    return I.cooccurrence(_mentions(s, d), "doc_id", "e").filter("n >= 2")


def sentence_chunks(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(I.sentences(F.col("text"))).alias("i", "sentence"))


def paragraph_chunks(s, d):
    return I.paragraph_chunks(table(s, d, "documents"), "doc_id", "text")


def _judged(s, d):
    c = table(s, d, "conversations")
    q = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("q"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("a"))
    before = F.lag("a").over(Window.partitionBy("conv_id").orderBy("t"))
    return I.judged(q.join(a, ["conv_id", "t"]).withColumn("c", F.array_compact(F.array("q", before))), "q", "a", "c")


def ragas_lexical(s, d):
    return _r(_judged(s, d).select("conv_id", "t", *I.MEASURES), 6, *I.MEASURES)


def conversation_rewrite(s, d):
    c = table(s, d, "conversations")
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = c.filter("role = 'user'").join(answers, ["conv_id", "turn"], "left")
    return I.rewrite_queries(turns, "conv_id", "turn", "text", "answer").select("conv_id", "turn", F.md5("rewritten").alias("rewritten"))


def session_ttl(s, d):
    e = table(s, d, "events")
    return I.live_sessions(e, "user_id", "ts", F.lit(e.agg(F.max("ts")).first()[0]), 6 * 3600)


def entity_linking(s, d):
    names = table(s, d, "part").select(F.lower("p_name").alias("mention"))
    kb = table(s, d, "part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("entity"))
    return I.link_entities(names, "mention", kb, "alias", "entity", 0.6)


def _edges(s, d):
    j = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"), F.col("l_extendedprice").alias("amount"), F.datediff("o_orderdate", F.lit("1992-01-01")).alias("ts"))


def _graph(s, d):
    """Customers and suppliers, an edge for each pair with an order line."""
    e = J.clean_edges(_edges(s, d))
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


def _written_graph(s, d):
    """The same with its edges written once."""
    e = stage_table(J.clean_edges(_edges(s, d)), "graph")
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


def calibration_ece(s, d):
    return _r(J.calibration(table(s, d, "labels").select((F.pmod("doc_id", F.lit(128)) / 128.0).alias("p"), "quality"), "p", "quality"), 6, "ece", "mce")


def content_cosine(s, d):
    return H.nearest(table(s, d, "embeddings"), "vec_id", "embedding", 10)


def session_vector(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 20).alias("user"))
    return _r(H.session_vectors(e, "user", [F.desc("vec_id")], "embedding"), 5, "x")


def mmr_rerank(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("q"), ((F.col("vec_id") * 37 % 101) / 101.0).alias("rel"))
    return _r(H.mmr(H.top_k(e, ["q"], [F.desc("rel"), F.col("vec_id")], 100), "q", "vec_id", "rel", "embedding"), 6, "mmr")


def content_recommend(s, d):
    b = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = b.select("o_custkey", "l_partkey", "l_quantity", "p_brand")
    return _r(H.content_scores(x, "o_custkey", "l_partkey", "l_quantity", "p_brand", 3), 6, "score")


def linucb_stats(s, d):
    e = table(s, d, "events").select("event_type", F.round(F.col("value") / 500, 4).alias("x0"), F.lit(1.0).alias("x1"), (F.col("user_id") % 2).cast("double").alias("r"))
    return _r(H.linucb_statistics(e, "event_type", ["x0", "x1"], "r"), 4, "a", "b")


QUERIES = {
    "bm25_search": bm25_search, "rrf_fusion": rrf_fusion, "lexical_rerank": lexical_rerank, "ir_metrics": ir_metrics, "cooccurrence_graph": cooccurrence_graph,
    "sentence_chunks": sentence_chunks, "paragraph_chunks": paragraph_chunks, "ragas_lexical": ragas_lexical, "ragas_means": lambda s, d: I.judged_means(_judged(s, d)), "conversation_rewrite": conversation_rewrite, "session_ttl": session_ttl,
    "memory_turns": lambda s, d: I.kept_turns(table(s, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role"),
    "entity_linking": entity_linking,
    "fixed_chunks": lambda s, d: I.fixed_chunks(table(s, d, "documents"), "doc_id", "text"),
    "topic_chunks": lambda s, d: I.topic_chunks(table(s, d, "documents"), "doc_id", "text"),
    "degree_centrality": lambda s, d: _r(J.degrees(*_graph(s, d)), 6, "in_centrality", "out_centrality"),
    "clustering_coefficient": lambda s, d: _r(J.clustering(*_written_graph(s, d)), 6, "clustering"),
    "pagerank_20": lambda s, d: _r(J.pagerank(*_graph(s, d)), 6, "rank"),
    "connected_components": lambda s, d: J.connected_components(_graph(s, d)[1]),
    "temporal_graph_features": lambda s, d: _r(J.temporal_features(_edges(s, d)), 6, "burst", "concentration", "recent_ratio"),
    "label_propagation": lambda s, d: J.label_propagation(_graph(s, d)[1], 5),
    "kcore": lambda s, d: J.k_core(_graph(s, d)[1]),
    "calibration_ece": calibration_ece, "content_cosine": content_cosine, "session_vector": session_vector, "mmr_rerank": mmr_rerank, "content_recommend": content_recommend, "linucb_stats": linucb_stats,
    "svd_factors": lambda s, d: H.truncated_svd(table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_suppkey", "l_quantity", 4),
}

_BM = r"""t AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}\p{Pc}]+') AS t FROM documents), q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')) AS term FROM benchmark),
  st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM t), x AS (SELECT doc, len(t) AS l, unnest(t) AS term FROM t), p AS (SELECT term, doc, l, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  sc AS (SELECT query, doc, round(sum(greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), st GROUP BY 1, 2), bm AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0)"""
_E = "ed AS (SELECT o_custkey AS src, l_suppkey + 10000000 AS dst, l_extendedprice AS amount, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS ts FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_G = _E + ", e AS (SELECT DISTINCT src, dst FROM ed), nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_N = _G + ", b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
# own copies of the fixed lists, so that a wrong list shows
_STOP = "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought to of in on at by for with from into through during before after above below and or but if because as until while that this it its not no nor so yet both either neither just than then when where who which how what и в на с по из за к о от до у под над при без для или но а не это что как то все он она они мы вы я его её их нас вас ему ей им же ли уже ещё даже тоже также себя"
_BACK = "it this that they them their these those such same above mentioned described said previous aforementioned"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
_TOK = lambda c: rf"list_filter(list_distinct(regexp_split_to_array(translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~«»—–„“”', ''), '\s+')), lambda w: w <> '' AND NOT list_contains({_LIST(_STOP)}, w))"
_SENT = lambda c: rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(trim({c}, ' ' || chr(10) || chr(9) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 5)"
_TURN = "p AS (SELECT q.conv_id, q.turn AS t, q.text AS q, a.text AS a FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"
_JUDGED = f"""{_TURN}, x AS (SELECT conv_id, t, {_TOK('q')} AS tq, {_TOK('a')} AS ta, {_SENT('a')} AS ss, [q, lag(a) OVER (PARTITION BY conv_id ORDER BY t)] AS cs FROM p),
  y AS (SELECT conv_id, t, tq, ta, ss, list_filter(cs, lambda c: c IS NOT NULL) AS cs FROM x),
  z AS (SELECT conv_id, t, CASE WHEN len(tq) = 0 THEN 0 ELSE len(list_filter(cs, lambda c: list_has_any({_TOK('c')}, tq))) / len(cs) END AS cp,
    CASE WHEN len(ss) = 0 THEN 0 ELSE len(list_filter(ss, lambda s: list_has_any({_TOK('s')}, flatten(list_transform(cs, lambda c: {_TOK('c')}))))) / len(ss) END AS cr,
    CASE WHEN len(tq) = 0 OR len(ta) = 0 THEN 0 ELSE len(list_intersect(tq, ta)) / len(list_distinct(list_concat(tq, ta))) END AS ar FROM y)"""

_LONG = lambda c: rf"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+'), lambda w: length(w) > 2)"
_GRAMS = lambda c: f"CASE WHEN length({c}) < 3 THEN [lower({c})] ELSE list_distinct(list_transform(range(1, length({c}) - 1), lambda i: lower({c})[i : i + 2])) END"


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS (SELECT n.id, 0.15 / c.c + 0.85 * (coalesce(s.s, 0) + coalesce(d.d, 0) / c.c) AS rank FROM nodes n LEFT JOIN (SELECT dst AS id, sum(rank / k) AS s FROM r{i} JOIN lk ON id = src GROUP BY 1) s USING (id), "
            f"(SELECT sum(rank) AS d FROM r{i} WHERE id NOT IN (SELECT src FROM e)) d, (SELECT count(*) AS c FROM nodes) c)"
        )
    return f"WITH {_N}, lk AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS k FROM e), {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{rounds}"


SQL = {
    "bm25_search": f"WITH {_BM} SELECT query, doc, round(score, 4)::DOUBLE AS score, rank FROM bm WHERE rank <= 10",
    "rrf_fusion": f"WITH {_BM}, u AS (SELECT query, doc, rank FROM bm WHERE rank <= 10 UNION ALL SELECT * FROM (SELECT n_chars % (SELECT max(item_id) + 1 FROM benchmark), doc_id, row_number() OVER (PARTITION BY n_chars % (SELECT max(item_id) + 1 FROM benchmark) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 10), r AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, doc) AS rank FROM r) SELECT * FROM k WHERE rank <= 5",
    "ir_metrics": f"""WITH {_BM}, rel AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT query, count(*) AS n FROM rel GROUP BY 1),
        h AS (SELECT bm.query, rank, row_number() OVER (PARTITION BY bm.query ORDER BY rank) AS h FROM bm JOIN rel USING (query, doc) WHERE rank <= 10), s AS (SELECT query, count(*) AS c, min(rank) AS f, sum(h / rank) AS ap, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY 1)
        SELECT query, coalesce(round(c / 10, 6), 0) AS precision, coalesce(round(c / n, 6), 0) AS recall, coalesce(round(1 / f, 6), 0) AS rr, coalesce(round(ap / n, 6), 0) AS ap, coalesce(round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) g(i)), 6), 0) AS ndcg FROM n LEFT JOIN s USING (query)""",
    "ragas_lexical": f"WITH {_JUDGED} SELECT conv_id, t, round(cp, 6)::DOUBLE AS context_precision, round(cr, 6)::DOUBLE AS context_recall, round(ar, 6)::DOUBLE AS answer_relevance, round(cr, 6)::DOUBLE AS faithfulness, round((cp + 2 * cr + ar) / 4, 6)::DOUBLE AS overall FROM z",
    "ragas_means": f"WITH {_JUDGED} SELECT round(avg(cp), 4)::DOUBLE AS context_precision, round(avg(cr), 4)::DOUBLE AS context_recall, round(avg(ar), 4)::DOUBLE AS answer_relevance, round(avg(cr), 4)::DOUBLE AS faithfulness, round(avg((cp + 2 * cr + ar) / 4), 4)::DOUBLE AS overall, count(*) AS num_samples FROM z",
    "conversation_rewrite": rf"""WITH s AS (SELECT q.conv_id, q.turn, q.text, 'Q: ' || q.text || CASE WHEN coalesce(a.text, '') <> '' THEN ' | A: ' || trim(split_part(a.text, '.', 1))[1:120] ELSE '' END AS said FROM conversations q LEFT JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'),
        u AS (SELECT conv_id, turn, text, list(said) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM s)
        SELECT conv_id, turn, md5(CASE WHEN (len(w) <= 5 OR list_has_any(w, {_LIST(_BACK)})) AND len(past) > 0 THEN text || ' [Context: ' || array_to_string(past, ' | ') || ']' ELSE text END) AS rewritten FROM u""",
    "memory_turns": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2",
    "session_ttl": "WITH l AS (SELECT user_id, count(*) AS n_turns, max(ts) AS last_active FROM events GROUP BY 1) SELECT user_id, n_turns, last_active, (SELECT max(ts) FROM events) - last_active > INTERVAL 6 HOUR AS is_expired FROM l",
    "degree_centrality": f"WITH {_G}, i AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1), o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1), n AS (SELECT count(*) - 1 AS n FROM nodes) SELECT id, coalesce(i.k, 0) AS in_deg, coalesce(o.k, 0) AS out_deg, round(coalesce(i.k, 0) / n, 6) AS in_centrality, round(coalesce(o.k, 0) / n, 6) AS out_centrality FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id), n",
    "clustering_coefficient": f"WITH {_N}, d AS (SELECT src AS id, count(*) AS k FROM b GROUP BY 1), t AS (SELECT x.src AS id, count(*) AS t FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN b z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1) SELECT id, k, coalesce(t, 0) AS triangles, CASE WHEN k < 2 THEN 0 ELSE round(2 * coalesce(t, 0) / (k * (k - 1)), 6) END AS clustering FROM d LEFT JOIN t USING (id)",
    "connected_components": f"WITH RECURSIVE {_G}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, c) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT b.dst, min(r.c) FROM r JOIN b ON b.src = r.id JOIN recurring.r p ON p.id = b.dst WHERE r.c < p.c GROUP BY b.dst) SELECT id, c AS component FROM r",
    "temporal_graph_features": f"""WITH {_E}, n AS (SELECT src AS id, amount, ts FROM ed UNION ALL SELECT dst, amount, ts FROM ed), w AS (SELECT id, amount, ts, max(ts) OVER (PARTITION BY id) AS l, ts - lag(ts) OVER (PARTITION BY id ORDER BY ts, amount) AS g, sum(amount) OVER (PARTITION BY id) AS s FROM n)
        SELECT id, count(*) FILTER (ts >= l - 30) AS velocity, round(CASE WHEN avg(g) > 0 THEN stddev_pop(g) / avg(g) ELSE 0 END, 6) AS burst, round(sum(pow(amount / s, 2)), 6) AS concentration, round(avg(amount) FILTER (ts >= l - 30) / avg(amount), 6) AS recent_ratio FROM w GROUP BY id""",
    "calibration_ece": "WITH x AS (SELECT doc_id % 128 / 128.0::DOUBLE AS p, quality AS y FROM labels), c AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS g FROM x GROUP BY least(floor(p * 10), 9)) SELECT round(sum(n * g) / sum(n), 6)::DOUBLE AS ece, round(max(g), 6) AS mce FROM c",
    "content_cosine": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT c.vec_id AS q, e.vec_id, round(list_cosine_similarity(e.v, c.v), 6) AS cos FROM e JOIN e c ON e.vec_id <> c.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, vec_id) AS rank FROM p) SELECT q, vec_id, rank, cos FROM k WHERE rank <= 10",
    "session_vector": """WITH k AS (SELECT vec_id % 20 AS "user", embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id DESC) AS k FROM embeddings), p AS (SELECT "user", i, sum(pow(0.8, k - 1) * v[i + 1]) AS x FROM k, range(64) g(i) WHERE k <= 20 GROUP BY 1, 2)
        SELECT "user", i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY "user")), 5) AS x FROM p""",
    "linucb_stats": "WITH e AS (SELECT event_type AS arm, [round(value / 500, 4), 1.0] AS x, (user_id % 2)::DOUBLE AS r FROM events), c AS (SELECT arm, i::INT AS i, j::INT AS j, x[i + 1] * x[j + 1] AS xx, CASE WHEN j = 0 THEN x[i + 1] * r ELSE 0 END AS xr FROM e, range(2) g(i), range(2) h(j)) SELECT arm, i, j, round(sum(xx) + CASE WHEN i = j THEN 1 ELSE 0 END, 4) AS a, round(sum(xr), 4) AS b FROM c GROUP BY arm, i, j",
    "pagerank_20": _pagerank_sql(20),
    "cooccurrence_graph": r"WITH m AS (SELECT DISTINCT doc_id, e FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z]{4,})(?:$|[^A-Za-z])', 1)) AS e FROM documents)) SELECT x.e AS a, y.e AS b, count(*) AS n FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2",
    "sentence_chunks": r"""WITH s AS (SELECT doc_id, list_filter(flatten(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: string_split(regexp_replace(trim(p), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x) <> '') AS s FROM documents)
        SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS i, unnest(s) AS sentence FROM s""",
    "lexical_rerank": f"""WITH {_BM}, c AS (SELECT query, doc, {_LONG('b.text')} AS q0, {_LONG('d.text')} AS p FROM bm JOIN benchmark b ON b.item_id = query JOIN documents d ON d.doc_id = doc WHERE rank <= 5), lx AS (SELECT query, doc, list_distinct(q0) AS q, p, count(*) OVER (PARTITION BY query) AS n FROM c),
        lt AS (SELECT query, doc, p, n, unnest(q) AS t FROM lx), h AS (SELECT *, list_contains(p, t) AS has, list_contains(p[1 : greatest(1, len(p) // 4)], t) AS early, len(list_filter(p, lambda w: w = t)) / len(p) AS tf FROM lt), i AS (SELECT *, ln(1 + n / (1 + sum(has::INT) OVER (PARTITION BY query, t))) AS idf FROM h),
        a AS (SELECT query, doc, avg(has::INT) AS cov, sum(CASE WHEN has THEN tf * idf ELSE 0 END) AS tfs, avg(idf) AS idf, avg(early::INT) AS pos FROM i GROUP BY 1, 2)
        SELECT query, doc, round(cov, 5) AS coverage, round(least(1, tfs / (idf + 1e-9)), 5) AS tf_score, round(pos, 5) AS position, round(0.5 * cov + 0.35 * least(1, tfs / (idf + 1e-9)) + 0.15 * pos, 5) AS rerank_score FROM a""",
    "entity_linking": f"""WITH m AS (SELECT DISTINCT lower(p_name) AS s FROM part), k AS (SELECT p_name AS s, p_partkey AS e FROM part), a AS (SELECT DISTINCT s FROM k), mg AS (SELECT s, {_GRAMS('s')} AS g FROM m), ag AS (SELECT s, {_GRAMS('s')} AS g FROM a),
        me AS (SELECT s, len(g) AS n, unnest(g) AS g FROM mg), ae AS (SELECT s, len(g) AS n, unnest(g) AS g FROM ag), j AS (SELECT me.s AS mention, ae.s AS alias, count(*) / (me.n + ae.n - count(*)) AS sc FROM me JOIN ae USING (g) GROUP BY me.s, ae.s, me.n, ae.n),
        b AS (SELECT mention, e AS entity, round(max(sc), 6) AS score FROM j JOIN k ON k.s = alias WHERE sc >= 0.6 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity) AS rank FROM b) SELECT * FROM r WHERE rank <= 5""",
    "content_recommend": """WITH x AS (SELECT o_custkey, l_partkey, l_quantity AS w, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT o_custkey, p_brand, sum(w) AS w FROM x GROUP BY 1, 2), n AS (SELECT o_custkey, sqrt(sum(w * w)) AS n FROM p GROUP BY 1),
        i AS (SELECT DISTINCT l_partkey, p_brand FROM x), s AS (SELECT o_custkey, l_partkey, w / n AS score FROM p JOIN n USING (o_custkey) JOIN i USING (p_brand) ANTI JOIN x USING (o_custkey, l_partkey)), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, l_partkey) AS rank FROM s) SELECT o_custkey, l_partkey, round(score, 6) AS score, rank FROM r WHERE rank <= 3""",
}
