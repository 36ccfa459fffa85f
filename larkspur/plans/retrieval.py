"""Vector retrieval: similarity to every owner's references, best per owner, top owners, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import balls, evaluate, search
from larkspur.plans.shared import Catalogue
from larkspur.storage import materialize, table

C = Catalogue()
QUERIES, ORACLES, COVERS = C.QUERIES, C.ORACLES, C.COVERS

ASKED = "id % 50 = 0"


def vectors(spark, sf_dir, first=1, last=64):
    """(id, owner, v) of embeddings, or of a slice of their dimensions."""
    v = F.col("embedding") if (first, last) == (1, 64) else F.slice("embedding", first, last - first + 1)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), v.alias("v"))


def best(spark, sf_dir, first=1, last=64):
    """(q, owner, score) of the asked ids."""
    refs = vectors(spark, sf_dir, first, last)
    return search.owner_scores(refs.where(ASKED), refs)


def truth(spark, sf_dir):
    return vectors(spark, sf_dir).where(ASKED).select(F.col("id").alias("q"), F.col("owner").alias("truth"))


_E = "e AS (SELECT vec_id AS id, label AS owner, embedding::DOUBLE[] AS v FROM embeddings)"
_SIM = f"{_E}, sims AS (SELECT a.id AS q, a.owner AS truth, b.id, b.owner, round(list_dot_product(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)"
_BEST = f"{_SIM}, best AS (SELECT q, truth, owner, max(sim) AS score FROM sims GROUP BY q, truth, owner), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, owner) AS rk FROM best)"


@C.query("owner_max_topk", "A8 C13 D11 F2", f"WITH {_BEST} SELECT q AS qid, owner, score, rk::INTEGER AS rank FROM ranked WHERE rk <= 3")
def owner_max_topk(spark, sf_dir, k=3):
    """Maximum similarity over each owner's references, then the k best owners a query."""
    return evaluate.ranked(best(spark, sf_dir)).where(F.col("rank") <= k).withColumnRenamed("q", "qid")


@C.query("recall_curve", "D14 D13", f"""
WITH {_BEST}, t AS (SELECT q, min(rk) FILTER (WHERE owner = truth) AS rk FROM ranked GROUP BY q)
SELECT k::INTEGER AS k, round(avg((coalesce(rk, 99) <= k)::INT), 6) AS recall FROM t, generate_series(1, 10) g(k) GROUP BY k""")
def recall_curve(spark, sf_dir):
    """Share of queries whose true owner is among the first k."""
    rows = evaluate.ranked(best(spark, sf_dir))
    return evaluate.recall_curve(evaluate.target_ranks(rows, truth(spark, sf_dir)), list(range(1, 11)))


@C.query("rank_of_target", "E1", f"WITH {_BEST} SELECT q, coalesce(min(rk) FILTER (WHERE owner = truth), -1) AS rank FROM ranked GROUP BY q")
def rank_of_target(spark, sf_dir):
    return evaluate.target_ranks(evaluate.ranked(best(spark, sf_dir)), truth(spark, sf_dir))


@C.query("weight_grid", "D28", f"""
WITH {_BEST}, s AS (SELECT q, truth, owner, w, row_number() OVER (PARTITION BY q, w ORDER BY round(score + w * (-owner / 100.0), 6) DESC, owner) AS rn FROM best, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) g(w))
SELECT w, round(avg((owner = truth)::INT), 6) AS accuracy FROM s WHERE rn = 1 GROUP BY w""")
def weight_grid(spark, sf_dir):
    """Accuracy for each weight of a second signal over stored similarities."""
    return evaluate.weight_grid(best(spark, sf_dir), truth(spark, sf_dir), [0.0, 0.25, 0.5, 0.75, 1.0], -F.col("owner") / 100.0)


@C.query("hard_negatives", "J26", f"WITH {_SIM} SELECT q, id AS r, sim FROM sims WHERE owner <> truth QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) <= 5")
def hard_negatives(spark, sf_dir):
    """The 5 nearest references of other owners."""
    refs = vectors(spark, sf_dir)
    return search.blocked_topk(refs.where(ASKED), refs, k=5, foreign=True).select("q", F.col("id").alias("r"), "sim")


@C.query("topk_per_query", "F2 F3", f"WITH {_SIM} SELECT q, id AS r, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rk FROM sims QUALIFY rk <= 5")
def topk_per_query(spark, sf_dir):
    refs = vectors(spark, sf_dir)
    return search.blocked_topk(refs.where(ASKED), refs, k=5).select("q", F.col("id").alias("r"), "sim", F.col("rank").cast("long").alias("rk"))


@C.query("blocked_search", "C13", f"WITH {_SIM} SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id)::INTEGER AS rank FROM sims QUALIFY rank <= 50")
def blocked_search(spark, sf_dir):
    """Exact top 50 by blocks of matrix products."""
    refs = vectors(spark, sf_dir)
    return search.blocked_topk(refs.where(ASKED), refs, k=50)


@C.query("cross_modal_match", "C19", f"WITH {_SIM}, t AS (SELECT q, id, sim FROM sims WHERE id % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) = 1) SELECT q, CASE WHEN sim >= 0.45 THEN id END AS id, sim FROM t")
def cross_modal_match(spark, sf_dir):
    """Best row of the other kind for each asked one, or none below 0.45; ids divisible by 50 stand for texts, the others for images."""
    refs = vectors(spark, sf_dir)
    top = search.blocked_topk(refs.where(ASKED), refs.where(f"not ({ASKED})"), k=1)
    return top.select("q", F.when(F.col("sim") >= 0.45, F.col("id")).alias("id"), "sim")


@C.query("knn_vote", "J25 F3", f"""
WITH {_SIM}, s AS (SELECT q, owner, sim::DECIMAL(18,6) AS sim FROM sims QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) <= 15),
v AS (SELECT q, owner, sum(sim) AS votes FROM s GROUP BY q, owner)
SELECT q, owner, votes::DOUBLE AS votes FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY v.votes DESC, owner) = 1""")
def knn_vote(spark, sf_dir):
    """The owner with most weight among the 15 nearest; similarities are summed as decimals, so ties are exact."""
    refs = vectors(spark, sf_dir)
    near = search.blocked_topk(refs.where(ASKED), refs, k=15).join(refs.select("id", "owner"), "id")
    votes = near.groupBy("q", "owner").agg(F.sum(F.col("sim").cast("decimal(18,6)")).alias("votes"))
    first = votes.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("votes"), "owner"))).where("rn = 1")
    return first.select("q", "owner", F.col("votes").cast("double").alias("votes"))


@C.query("ranking_metrics", "D20", f"""
WITH {_BEST}, h AS (SELECT q, rk, (owner % 3 = truth % 3)::INT AS rel FROM ranked),
c AS (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rk) AS hits, sum(rel) OVER (PARTITION BY q) AS total, count(*) OVER (PARTITION BY q) AS n FROM h)
SELECT q, round(sum(rel * hits * 1.0 / rk) / nullif(max(total), 0), 6) AS ap, round(sum(rel) FILTER (WHERE rk <= 3) / 3.0, 6) AS p_at_3, round(sum(rel) FILTER (WHERE rk <= 3) * 1.0 / nullif(max(total), 0), 6) AS r_at_3,
  round((sum(rel * (n - rk + 1)) - max(total) * (max(total) + 1) / 2.0) / nullif(max(total) * (max(n) - max(total)), 0), 6) AS auc FROM c GROUP BY q""")
def ranking_metrics(spark, sf_dir):
    """Average precision, precision and recall at 3, and area under the curve of each query's owners."""
    rows = evaluate.ranked(best(spark, sf_dir)).join(truth(spark, sf_dir), "q")
    return evaluate.metrics(rows.withColumn("rel", (F.col("owner") % 3 == F.col("truth") % 3).cast("int")))


@C.query("open_set_rejection", "B12", f"WITH {_BEST} SELECT q, CASE WHEN score >= 0.60 THEN owner END AS answer, score FROM ranked WHERE rk = 1")
def open_set_rejection(spark, sf_dir):
    """The best owner, or no answer below 0.60."""
    first = evaluate.ranked(best(spark, sf_dir)).where("rank = 1")
    return first.select("q", F.when(F.col("score") >= 0.60, F.col("owner")).alias("answer"), "score")


@C.query("best_and_second", "E11", f"""
WITH {_E}, s AS (SELECT a.id AS item, b.id AS source, round(list_dot_product(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.id) <= 2)
SELECT item, arg_max(source, struct_pack(s := sim, i := -source)) AS source, max(sim) AS best, round(max(sim) + 0.25 * min(sim), 8) AS score FROM s GROUP BY item""")
def best_and_second(spark, sf_dir):
    """Each item's best source and its score with a quarter of the second's, over all sources."""
    refs = vectors(spark, sf_dir)
    near = search.blocked_topk(refs, refs, k=2)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return near.groupBy(F.col("q").alias("item")).agg(at(1, "id").alias("source"), at(1, "sim").alias("best"), F.round(at(1, "sim") + 0.25 * at(2, "sim"), 8).alias("score"))


_ITEMS = "items AS (SELECT vec_id AS item, 'w' || label AS winery, vec_id % 2 = 0 AS has_year, vec_id % 3 = 0 AS has_sweetness, vec_id % 5 = 0 AS has_abv, vec_id % 7 = 0 AS from_catalogue FROM embeddings)"
_TOP = f"{_SIM}, top AS (SELECT q, id AS item, owner, sim AS score, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM sims QUALIFY rank <= 10)"
_NEAR = "near AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON b.owner = a.owner AND b.id > a.id AND b.id - a.id <= 20)"
_FEATURES = f"""{_TOP}, {_ITEMS}, {_NEAR},
f AS (SELECT t.q, t.item, t.score, t.rank, round(t.score - first(t.score ORDER BY t.rank) OVER w, 6) AS margin_to_top1, round(t.score - coalesce(lead(t.score) OVER (PARTITION BY t.q ORDER BY t.rank), t.score), 6) AS margin_to_next,
    round(CASE WHEN stddev_pop(t.score) OVER w > 1e-9 THEN (t.score - avg(t.score) OVER w) / stddev_pop(t.score) OVER w ELSE 0 END, 4) AS score_z,
    round(max(CASE WHEN t.rank = 1 THEN t.score END) OVER w - coalesce(max(CASE WHEN t.rank = 2 THEN t.score END) OVER w, max(CASE WHEN t.rank = 1 THEN t.score END) OVER w), 6) AS top1_gap,
    (winery = max(CASE WHEN t.rank = 1 THEN winery END) OVER w AND t.rank > 1)::INT AS same_winery, count(*) OVER (PARTITION BY t.q, winery) AS winery_count,
    (SELECT count(*) FROM near n JOIN top o ON o.q = t.q AND o.rank = 1 WHERE (n.a = t.item AND n.b = o.item) OR (n.b = t.item AND n.a = o.item))::INT AS near_top1,
    (SELECT count(*) FROM near n JOIN top o ON o.q = t.q WHERE (n.a = t.item AND n.b = o.item) OR (n.b = t.item AND n.a = o.item)) AS near_siblings,
    has_year::INT AS has_year, has_sweetness::INT AS has_sweetness, has_abv::INT AS has_abv, from_catalogue::INT AS from_catalogue
  FROM top t JOIN items USING (item) WINDOW w AS (PARTITION BY t.q))"""


def _features(spark, sf_dir):
    refs = vectors(spark, sf_dir)
    top = search.blocked_topk(refs.where(ASKED), refs, k=10).select("q", F.col("id").alias("item"), F.col("sim").alias("score"), "rank")
    mod = lambda n: F.col("id") % n == 0
    items = refs.select(F.col("id").alias("item"), F.concat(F.lit("w"), F.col("owner").cast("string")).alias("winery"), mod(2).alias("has_year"), mod(3).alias("has_sweetness"), mod(5).alias("has_abv"), mod(7).alias("from_catalogue"))
    listed = top.select("item").distinct().join(items.select("item", "winery"), "item")
    near = listed.alias("x").join(listed.alias("y"), F.col("x.winery") == F.col("y.winery")).where("y.item > x.item and y.item - x.item <= 20").select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))
    return evaluate.candidate_features(top, items, near)


@C.query("candidate_features", "E2 E18", f"WITH {_FEATURES} SELECT * FROM f")
def candidate_features(spark, sf_dir):
    """14 features of the 10 best candidates of each query; rows of one owner with near ids count as near-duplicates."""
    return _features(spark, sf_dir)


RERANK = {"score": 1.0, "margin_to_top1": 0.5, "score_z": 0.02, "same_winery": -0.03, "near_siblings": -0.01, "has_year": 0.02, "from_catalogue": 0.05}


@C.query("linear_rerank", "H26", f"""WITH {_FEATURES}, v AS (SELECT q, item, round(score + 0.5 * margin_to_top1 + 0.02 * score_z - 0.03 * same_winery - 0.01 * near_siblings + 0.02 * has_year + 0.05 * from_catalogue, 8) AS value FROM f)
SELECT q, item, value, row_number() OVER (PARTITION BY q ORDER BY value DESC, item)::INTEGER AS place FROM v""")
def linear_rerank(spark, sf_dir):
    """Candidates by a weighted sum of their features."""
    return evaluate.linear_rerank(_features(spark, sf_dir), RERANK)


SLICES = ((1, 32), (17, 48), (33, 64))
_VIEWS = f"{_E}, views AS (" + " UNION ALL ".join(f"SELECT {k} AS view, a.id AS q, b.id AS item, b.owner, round(list_dot_product(a.v[{i}:{j}], b.v[{i}:{j}]), 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0" for k, (i, j) in enumerate(SLICES, 1)) + ")"


@C.query("multiview_features", "E3", f"""
WITH {_VIEWS}, listed AS (SELECT *, row_number() OVER (PARTITION BY view, q ORDER BY score DESC, item) AS rank FROM views QUALIFY rank <= 20),
c AS (SELECT q, item FROM listed WHERE view = 1 AND rank <= 10), tops AS (SELECT view, q, max(score) AS top FROM listed GROUP BY 1, 2),
g AS (SELECT c.q, c.item, v, coalesce(rank, 1000000) AS rank, coalesce(score, 0) AS score, top FROM c CROSS JOIN generate_series(1, 3) s(v) JOIN tops t ON t.q = c.q AND t.view = v LEFT JOIN listed l ON l.q = c.q AND l.item = c.item AND l.view = v)
SELECT q, item, round(avg(rank), 4) AS mean_rank, max(rank) AS worst_rank, round(stddev_pop(rank), 2) AS rank_spread, count(*) FILTER (WHERE rank = 1) AS firsts, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 5) AS score_spread, round(avg(score - top), 6) AS mean_gap, bool_and(rank <= 10) AS always_listed FROM g GROUP BY q, item""")
def multiview_features(spark, sf_dir):
    """8 features of how stable the first view's candidates are over three views, slices of the vectors."""
    rows = None
    for k, (i, j) in enumerate(SLICES, 1):
        refs = vectors(spark, sf_dir, i, j)
        one = search.blocked_topk(refs.where(ASKED), refs, k=20).select(F.lit(k).alias("view"), "q", F.col("id").alias("item"), "rank", F.col("sim").alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    rows = materialize(rows, "views")
    return evaluate.multiview_features(rows.where("view = 1 and rank <= 10").select("q", "item"), rows, n_views=3, k=10)


def _views(spark, sf_dir):
    rows = None
    for k, (i, j) in enumerate(SLICES, 1):
        one = best(spark, sf_dir, i, j).withColumn("view", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@C.query("late_fusion", "H33", f"""
WITH {_VIEWS}, o AS (SELECT view, q, owner, max(score) AS s FROM views GROUP BY 1, 2, 3), f AS (SELECT q, owner, sum(s::DECIMAL(18,6)) AS total, max(s) AS most FROM o GROUP BY q, owner)
SELECT 'sum' AS how, q, owner, total::DOUBLE AS score FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY total DESC, owner) = 1 UNION ALL SELECT 'max', q, owner, most FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY most DESC, owner) = 1""")
def late_fusion(spark, sf_dir):
    """The best owner by the sum and by the maximum of three views' scores."""
    rows = materialize(_views(spark, sf_dir), "views")
    out = [evaluate.ranked(evaluate.fused(rows, how)).where("rank = 1").select(F.lit(how).alias("how"), "q", "owner", "score") for how in ("sum", "max")]
    return out[0].unionByName(out[1])


@C.query("visual_channels", "H27 G1", f"""
WITH {_E}, s AS (SELECT a.id AS q, b.owner, round(list_dot_product(a.v[1:32], b.v[1:32]), 6) AS g, round(list_dot_product(a.v[33:64], b.v[33:64]), 6) AS f, greatest(round(list_dot_product(a.v[33:64], b.v[1:32]), 6), round(list_dot_product(a.v[1:32], b.v[33:64]), 6)) AS c FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)
SELECT q, owner, max(g) AS global, max(f) AS focus, max(c) AS cross_view, round(0.5 * max(g) + 0.5 * max(f), 7) AS blend FROM s GROUP BY q, owner""")
def visual_channels(spark, sf_dir):
    """Best score an owner of the whole view, of the detail, and of one against the other."""
    whole, detail = vectors(spark, sf_dir, 1, 32), vectors(spark, sf_dir, 33, 64)
    asked = lambda df: df.where(ASKED)
    scores = {"global": search.owner_scores(asked(whole), whole), "focus": search.owner_scores(asked(detail), detail), "c1": search.owner_scores(asked(detail), whole), "c2": search.owner_scores(asked(whole), detail)}
    rows = None
    for name, one in scores.items():
        one = one.withColumnRenamed("score", name)
        rows = one if rows is None else rows.join(one, ["q", "owner"])
    return rows.select("q", "owner", "global", "focus", F.greatest("c1", "c2").alias("cross_view"), F.round(0.5 * F.col("global") + 0.5 * F.col("focus"), 7).alias("blend"))


@C.query("z_blend", "H26 D28", f"""
WITH {_VIEWS}, o AS (SELECT q, owner, max(score) FILTER (WHERE view = 1) AS a, max(score) FILTER (WHERE view = 3) AS b FROM views GROUP BY q, owner)
SELECT q, owner, round((a - avg(a) OVER w) / stddev_pop(a) OVER w + 0.5 * (b - avg(b) OVER w) / stddev_pop(b) OVER w, 4) AS score FROM o WINDOW w AS (PARTITION BY q)""")
def z_blend(spark, sf_dir):
    """Two channels blended as z-scores within each query."""
    a, b = (best(spark, sf_dir, i, j).withColumnRenamed("score", n) for n, (i, j) in (("a", SLICES[0]), ("b", SLICES[2])))
    return evaluate.z_blend(a.join(b, ["q", "owner"]), 0.5)


@C.query("confident_override", "D40 D38", f"""
WITH {_VIEWS}, o AS (SELECT view, q, owner, max(score) AS s FROM views GROUP BY 1, 2, 3), t AS (SELECT view, q, owner, s FROM o QUALIFY row_number() OVER (PARTITION BY view, q ORDER BY s DESC, owner) = 1)
SELECT a.q, CASE WHEN b.s >= 0.35 THEN b.owner ELSE a.owner END AS owner, b.s >= 0.35 AND b.owner <> a.owner AS changed, a.owner = b.owner AS agrees FROM t a JOIN t b ON a.q = b.q AND a.view = 1 AND b.view = 3""")
def confident_override(spark, sf_dir):
    """The first view's answer, replaced by the third's where that is sure; and whether both agree."""
    first, third = (evaluate.ranked(best(spark, sf_dir, i, j)).where("rank = 1") for i, j in (SLICES[0], SLICES[2]))
    return evaluate.overridden(first.select("q", "owner"), third.select("q", "owner", F.col("score").alias("p")), least=0.35)


@C.query("channel_union", "G1", f"""
WITH {_SIM}, {_VIEWS.replace(_E + ", ", "")}, a AS (SELECT q, id FROM sims QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) <= 20),
b AS (SELECT q, item FROM views WHERE view = 1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, item) <= 20), c AS (SELECT q, item FROM views WHERE view = 3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, item) <= 5)
SELECT q, id FROM a UNION SELECT * FROM b UNION SELECT * FROM c""")
def channel_union(spark, sf_dir):
    """Distinct proposals of the whole vector and its first half, 20 each, and 5 of its second half."""
    rows = None
    for (i, j), k in (((1, 64), 20), (SLICES[0], 20), (SLICES[2], 5)):
        refs = vectors(spark, sf_dir, i, j)
        one = search.blocked_topk(refs.where(ASKED), refs, k=k).select("q", "id")
        rows = one if rows is None else rows.unionByName(one)
    return rows.distinct()


@C.query("descriptor_voting", "C24", f"""
WITH {_E}, h AS (SELECT id, owner, list_transform(v[1:32], lambda x: x / sqrt(list_dot_product(v[1:32], v[1:32]))) AS x, list_transform(v[33:64], lambda x: x / sqrt(list_dot_product(v[33:64], v[33:64]))) AS y, v FROM e),
p AS (SELECT a.id AS q, a.owner AS o, b.id, b.owner, round(list_dot_product(a.x, b.x), 6) AS s, round(list_dot_product(a.y, b.y), 6) AS t, round(list_dot_product(a.v, b.v), 6) AS sim FROM h a JOIN h b ON a.id <> b.id WHERE a.id % 50 = 0),
ballots AS (SELECT q, id FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 10 UNION ALL SELECT q, id FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY t DESC, id) <= 10),
votes AS (SELECT q, id, count(*) AS votes FROM ballots GROUP BY q, id), first5 AS (SELECT q, id FROM votes QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, id) <= 5),
known AS (SELECT id, owner FROM e QUALIFY row_number() OVER (PARTITION BY owner ORDER BY id) <= 5), same AS (SELECT a.id AS q, k.id FROM e a JOIN known k USING (owner) WHERE a.id % 50 = 0 AND a.id <> k.id),
c AS (SELECT q, id FROM first5 UNION SELECT q, id FROM same)
SELECT c.q, c.id, coalesce(votes, 0) AS votes, sim FROM c JOIN p ON p.q = c.q AND p.id = c.id LEFT JOIN votes v ON v.q = c.q AND v.id = c.id WHERE sim >= 0.3""")
def descriptor_voting(spark, sf_dir):
    """Candidates by votes of the vector's halves and by owner, verified by the whole vector."""
    refs = vectors(spark, sf_dir)
    return search.voted(refs.where(ASKED), refs, parts=2, k=10, best=5, least=0.3)


@C.query("centroid_index", "D12", """
WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM {embeddings}),
m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY label)
SELECT m.label AS owner, CAST(i AS INTEGER) AS i, round(x / len, 5) AS x FROM m JOIN n USING (label)""")
def centroid_index(spark, sf_dir):
    """Mean of each owner's unit vectors, made a unit again, in long form."""
    means = search.centroids(table(spark, sf_dir, "embeddings").select(F.col("label").alias("owner"), F.col("embedding").alias("v")))
    return means.select("owner", F.posexplode("v").alias("i", "x")).select("owner", (F.col("i") + 1).alias("i"), F.round("x", 5).alias("x"))


@C.query("vector_fusion", "H24 H23", """
SELECT a.vec_id, round(sqrt((1 + DOT(a.embedding, b.embedding)) / 2), 4) AS agreement FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""")
def vector_fusion(spark, sf_dir):
    """Cosine of each vector's successor with the even fusion of both."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(V.dot(V.fused("v", "w", 0.5), "w"), 4).alias("agreement"))


@C.query("query_expansion", "H25", """
WITH s AS (SELECT a.vec_id AS q, b.vec_id AS r, round(DOT(a.embedding, b.embedding), 6) AS sim FROM {embeddings} a JOIN {embeddings} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
t AS (SELECT q, r, greatest(sim, 0) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS rk FROM s) x WHERE rk <= 5 UNION ALL SELECT vec_id, vec_id, 1 FROM {embeddings} WHERE vec_id % 50 = 0),
p AS (SELECT q, generate_subscripts(embedding, 1) AS i, sim ** 3 * unnest(embedding)::DOUBLE AS x FROM t JOIN {embeddings} ON vec_id = r),
m AS (SELECT q, i, sum(x) AS x FROM p GROUP BY q, i), n AS (SELECT q, sqrt(sum(x * x)) AS len FROM m GROUP BY q)
SELECT q, CAST(i AS INTEGER) AS i, round(x / len, 5) AS x FROM m JOIN n USING (q)""")
def query_expansion(spark, sf_dir):
    """Each query plus its 5 nearest, weighted by similarity cubed."""
    refs = vectors(spark, sf_dir)
    expanded = search.expand_queries(refs.where(ASKED), refs, k=5, power=3)
    return expanded.select("q", F.posexplode("v").alias("i", "x")).select("q", (F.col("i") + 1).alias("i"), F.round("x", 5).alias("x"))


@C.query("database_augmentation", "H25", """
WITH s AS (SELECT a.vec_id AS q, b.vec_id AS r, round(DOT(a.embedding, b.embedding), 6) AS sim FROM {embeddings} a JOIN {embeddings} b ON a.vec_id <> b.vec_id),
t AS (SELECT q, r, greatest(sim, 0) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS rk FROM s) x WHERE rk <= 2 UNION ALL SELECT vec_id, vec_id, 1 FROM {embeddings}),
p AS (SELECT q, generate_subscripts(embedding, 1) AS i, sim ** 3 * unnest(embedding)::DOUBLE AS x FROM t JOIN {embeddings} ON vec_id = r),
m AS (SELECT q, i, sum(x) AS x FROM p GROUP BY q, i), n AS (SELECT q, sqrt(sum(x * x)) AS len FROM m GROUP BY q)
SELECT q AS vec_id, CAST(i AS INTEGER) AS i, round(x / len, 5) AS x FROM m JOIN n USING (q)""")
def database_augmentation(spark, sf_dir):
    """Each vector plus its 2 nearest others, weighted by similarity cubed; neighbours of all rows through an index of balls."""
    mixed = balls.augmented(vectors(spark, sf_dir).select("id", "v"), k=2, power=3)
    return mixed.select(F.col("id").alias("vec_id"), F.posexplode("v").alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("x", 5).alias("x"))


@C.query("whitening", "D32 H25")
def whitening(spark, sf_dir):
    """Vectors on their principal axes, each axis of unit variance."""
    return search.whitened(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), k=16)


@C.query("bootstrap_interval", "D19", f"""
WITH draws AS (SELECT r, l_discount AS x, (('0x' || left(md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || ':' || r), 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM lineitem, generate_series(1, 200) g(r)),
n AS (SELECT r, x, {" + ".join(f"(u > {limit})::INT" for limit in search.POISSON)} AS n FROM draws),
m AS (SELECT r, sum(x * n) / sum(n) AS m FROM n GROUP BY r)
SELECT round(avg(m), 8) AS mean, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m""")
def bootstrap_interval(spark, sf_dir):
    """95 % interval of the mean of l_discount by 200 Poisson resamples, each row drawn in each by a hash of its own."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("h"), F.col("l_discount").alias("x"))
    found = search.bootstrap_mean(rows, rounds=200)
    return found.select(*[F.round(c, 8).alias(c) for c in found.columns])
