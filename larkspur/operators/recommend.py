"""From vectors, evidence and popularity to feeds, neighbours, decks, lists and explanations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import copies, taste
from larkspur.operators.pruning import EXPLORE
from larkspur.operators.selection import pool_for, top_per_group
from larkspur.storage import materialize

REDUNDANCY, STYLE_REPEAT, GRAPE_REPEAT, PER_PRODUCER = 0.35, 0.1, 0.12, 2
NEAR = 0.45  # likeness from which an item counts towards the taste of its source


def interest_of(cards: DataFrame) -> DataFrame:
    """(item, interest, style, grape, producer, duplicate_of): coarse taste and what repeats are counted by."""
    sweet = F.coalesce("sweet", F.lit("")) == "sweet"
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return cards.select(
        "item",
        F.concat_ws("/", part("color"), F.when(F.col("sparkling"), "sparkling").otherwise("still"), F.when(sweet, "sweet").otherwise("dry")).alias("interest"),
        F.concat_ws("/", part("color"), part("sweet"), part("sparkling")).alias("style"),
        F.coalesce(F.get("grapes", F.lit(0)), F.lit("")).alias("grape"),
        part("winery").alias("producer"),
        part("duplicate_of").alias("duplicate_of"),
    )


def picked(pool: DataFrame, *, n: int, interests: bool) -> DataFrame:
    """(profile, slot, item, interest): greedy pick of n from each profile's pool.

    pool: profile, item, score, interest, share, style, grape, producer, duplicate_of, features. With
    interests the next slot goes to the one with most share for its slots so far; inside it the item of
    highest score is taken, less what it resembles the picked ones and repeats their grape; without, a
    repeated style costs instead. One item of a duplicate group, two of a producer; slots left are
    filled from those. Pools are cut first, by interest or as a whole, so a group is bounded.
    """
    cut = top_per_group(pool, ["profile", "interest"], [F.desc("score"), "item"], pool_by_interest(n)) if interests else top_per_group(pool, ["profile"], [F.desc("score"), "item"], pool_for(n))
    cut = cut.withColumns({"f": F.col("features.f"), "x": F.col("features.x")}).drop("features")
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
        vectors = _dense(rows.f, rows.x)
        score, producer, group, style, grape = (rows[c].to_numpy() for c in ("score", "producer", "duplicate_of", "style", "grape"))
        interest = rows.interest.to_numpy() if interests else np.full(len(rows), "", object)
        shares = dict(zip(interest, rows.share.fillna(0.0), strict=True))
        overlap, repeat, alive = np.zeros(len(rows)), np.zeros(len(rows)), np.ones(len(rows), bool)
        chosen, capped, groups, producers, taken = [], [], set(), {}, {}
        while alive.any() and len(chosen) < n:
            open_here = alive
            if interests:
                best = max(set(interest[alive]), key=lambda k: (shares.get(k, 0.0) / (taken.get(k, 0) + 1), k))
                open_here = alive & (interest == best)
            t = int(np.argmax(np.where(open_here, score * (1 - REDUNDANCY * overlap - repeat), -np.inf)))
            alive[t] = False
            if group[t] in groups:
                continue
            if producer[t] and producers.get(producer[t], 0) >= PER_PRODUCER:
                capped.append(t)
                continue
            chosen.append(t)
            groups.add(group[t])
            producers[producer[t]] = producers.get(producer[t], 0) + 1
            taken[interest[t]] = taken.get(interest[t], 0) + 1
            overlap = np.maximum(overlap, vectors @ vectors[t])
            repeat += GRAPE_REPEAT * ((grape == grape[t]) & (grape != "")) + (0 if interests else STYLE_REPEAT * (style == style[t]))
        for t in capped:
            if len(chosen) < n and group[t] not in groups:
                chosen.append(t)
                groups.add(group[t])
        return pd.DataFrame({"profile": rows.profile.iloc[0], "slot": range(1, len(chosen) + 1), "item": rows.item.to_numpy()[chosen], "interest": rows.interest.to_numpy()[chosen]})

    return cut.groupBy("profile").applyInPandas(pick, f"profile {kinds['profile']}, slot int, item {kinds['item']}, interest string")


def _dense(names: pd.Series, values: pd.Series) -> np.ndarray:
    """Vectors given as arrays of features and of their values, in the columns of all features that occur."""
    held = [np.empty(0, np.int64) if f is None else f for f in names]
    owner = np.repeat(np.arange(len(held)), [len(f) for f in held])
    found, at = np.unique(np.concatenate(held), return_inverse=True)
    out = np.zeros((len(held), max(1, len(found))))
    out[owner, at] = np.concatenate([np.empty(0) if x is None else x for x in values])
    return out


def pool_by_interest(n: int) -> int:
    """How many of the best of an interest compete for n slots."""
    return max(n * 15, 60)


def feed(pool: DataFrame, weights: DataFrame, answers: DataFrame, cards: DataFrame, vectors: DataFrame, *, n: int) -> DataFrame:
    """Feeds from the best items of each interest (profile, item, score, interest): slots by the evidence of interests, the rest explores.

    weights: (profile, item, w); answers: (profile, label, w), each answer an interest of its own.
    """
    about = interest_of(cards)
    liked = weights.where("w > 0").join(about.select("item", "interest"), "item").select("profile", "interest", "w")
    sums = liked.unionByName(answers.select("profile", F.col("label").alias("interest"), F.col("w").cast("double").alias("w"))).groupBy("profile", "interest").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("profile"))
    sure = taste.confidence(weights, answers).select("profile", "confidence")
    shares = sums.withColumn("total", total).join(sure, "profile").select("profile", "interest", (F.col("w") / F.col("total") * F.col("confidence")).alias("share"))
    placed = pool.join(shares, ["profile", "interest"], "left").join(sure, "profile")
    share = F.when(F.col("interest") == EXPLORE, (1 - F.col("confidence")) / 2).otherwise(F.col("share"))
    placed = placed.select("profile", "item", "score", "interest", share.alias("share"))
    return picked(placed.join(about.drop("interest"), "item").join(vectors, "item", "left"), n=n, interests=True)


def cold_start(scores: DataFrame, cards: DataFrame, vectors: DataFrame, *, n: int) -> DataFrame:
    """(slot, item, interest): one feed for newcomers from (item, prior), slots by the root of the items of an interest."""
    about = interest_of(cards)
    sizes = about.groupBy("interest").agg(F.sqrt(F.count("*")).alias("root"))
    share = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("root").alias("all")))).select("interest", (F.col("root") / F.col("all")).alias("share"))
    pool = scores.join(about, "item").join(share, "interest").join(vectors, "item", "left").withColumns({"profile": F.lit(0).cast("long"), "score": F.round("prior", 6)})
    return picked(pool, n=n, interests=True).select("slot", "item", "interest")


def nearest(packed: DataFrame, *, asked: str | DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(q, item, sim): the k items most like each asked one (a condition or a table of items), from (item, features); with a group column, of other groups only."""
    column: Column = F.lit("") if group is None else F.col(group).cast("string")
    items = packed.select("item", column.alias("level"), F.lit(0.0).alias("prior"), "features")
    chosen = items.where(asked) if isinstance(asked, str) else items.join(asked, "item", "left_semi")
    profiles = chosen.select(F.col("item").alias("profile"), F.lit(1.0).alias("confidence"), F.lit(group is not None).alias("guard"), F.array("level").alias("levels"), F.array("item").alias("seen"))
    seeds = chosen.select(F.col("item").alias("profile"), "item", F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("w"), "features")

    def foreign(best, off_level, **_):
        return np.where(off_level > 0, best, 0.0)

    found = taste.ranked_items(profiles, seeds, items, k=k, **({} if group is None else {"score": foreign}))
    return found.where("score > 0").select(F.col("profile").alias("q"), "item", F.col("score").alias("sim"))


def neighbours(cards: DataFrame, *, asked: str, k: int) -> DataFrame:
    """(q, item, score): the k items of the same style that are nearest on shared axes, at a mean distance of 1 at most.

    Items with equal style, axes, aromas and grape are a class, and classes meet. An item only leaves out those of its own
    duplicate_of, so the first 2 * k of a class, k at most of one duplicate_of, hold the k best of each of its items.
    """
    style = F.concat_ws("/", F.coalesce("color", F.lit("")), F.coalesce("sweet", F.lit("")), F.col("sparkling").cast("string"))
    fields = ["style", "axes", "aromas", "grape"]
    rows = cards.select("item", style.alias("style"), "axes", "aromas", F.get("grapes", F.lit(0)).alias("grape"), "duplicate_of")
    rows = rows.where("duplicate_of is not null").withColumn("class", copies.named(fields))
    told = F.struct(*fields)
    kinds = rows.groupBy("class").agg(F.first(told).alias("c"), F.max(F.expr(asked)).alias("asked"))
    left = kinds.where("asked").select(F.col("class").alias("q_class"), *[F.col(f"c.{c}").alias(f"q_{c}") for c in fields])
    met = left.join(kinds.select("class", "c.*"), F.col("q_style") == F.col("style"))
    shared = F.array_intersect(F.map_keys("q_axes"), F.map_keys("axes"))
    gap = F.aggregate("shared", F.lit(0.0), lambda s, a: s + F.abs(F.element_at("q_axes", a) - F.element_at("axes", a)))
    far = met.withColumn("shared", shared).where(F.size("shared") >= 2).withColumn("distance", gap / F.size("shared")).where("distance <= 1")
    bonus = 0.1 * F.least(F.size(F.array_intersect("q_aromas", "aromas")), F.lit(3)) + F.when(F.col("q_grape") == F.col("grape"), 0.15).otherwise(0.0)
    scored = far.select("q_class", "class", F.round(1 - F.col("distance") / 4 + bonus, 6).alias("score"))

    def first(df, by, order):
        return top_per_group(top_per_group(df, [by, "duplicate_of"], order, k), [by], order, 2 * k)

    offered = first(rows.select("class", "item", "duplicate_of"), "class", ["item"])
    best = first(scored.join(offered, "class").select("q_class", "item", "duplicate_of", "score"), "q_class", [F.desc("score"), "item"])
    asking = rows.where(asked).select(F.col("item").alias("q"), F.col("class").alias("q_class"), F.col("duplicate_of").alias("own"))
    return top_per_group(asking.join(best, "q_class").where("own <> duplicate_of").select("q", "item", "score"), ["q"], [F.desc("score"), "item"], k)


def unexplored(weights: DataFrame, scores: DataFrame, grapes: DataFrame, *, k: int) -> DataFrame:
    """(profile, grape, item, prior): the k best items of each grape that a profile hasn't liked."""
    known = weights.where("w > 0").join(grapes, "item").select("profile", "grape").distinct()
    best = top_per_group(scores.join(grapes, "item").where("grape is not null"), ["grape"], [F.desc("prior"), "item"], k)
    every = weights.select("profile").distinct().join(best.select("grape").distinct())
    return every.join(known, ["profile", "grape"], "left_anti").join(best, "grape").select("profile", "grape", "item", "prior")


def unusual(items: DataFrame, share: float = 0.25) -> DataFrame:
    """(item, style, grape): items whose style or grape is among the `share` that have fewest items."""
    counted = [items.groupBy(c).agg(F.count("*").alias(f"{c}_n")) for c in ("grape", "style")]
    limits = [n.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {c}_n)").alias(f"{c}_limit")) for n, c in zip(counted, ("grape", "style"), strict=True)]
    joined = items.join(counted[0], "grape").join(counted[1], "style").crossJoin(F.broadcast(limits[0])).crossJoin(F.broadcast(limits[1]))  # one row each
    return joined.where("grape_n <= grape_limit or style_n <= style_limit").select("item", "style", "grape")


def _served(cards: DataFrame, rules: DataFrame) -> DataFrame:
    return cards.select("item", "sweet", F.explode(F.array_distinct("dishes")).alias("pairing")).join(rules, "pairing")


def pairings(cards: DataFrame, rules: DataFrame) -> DataFrame:
    """(item, dish, pairing): the first pairing of the dictionary (dish, pairing, pos) that an item has, a dish."""
    first = _served(cards, rules).groupBy("item", "dish").agg(F.min(F.struct("pos", "pairing")).alias("first"))
    return first.select("item", "dish", "first.pairing")


def cellar(signals: DataFrame, cards: DataFrame, rules: DataFrame) -> DataFrame:
    """(profile, dish, item, score): kept bottles for each dish that they serve."""
    hits = _served(cards, rules).groupBy("item", "dish").agg(F.count("*").alias("hits"), F.max("sweet").alias("sweet"))
    kept = signals.where("quantity > 0").select("profile", "item", "quantity").join(hits, "item")
    heavy = F.when((F.col("sweet") == "sweet") & (F.col("dish") != "dessert"), 6).otherwise(0)
    return kept.select("profile", "dish", "item", F.round(15.0 * F.col("hits") + 2 * F.least("quantity", F.lit(3)) - heavy, 6).alias("score"))


def refill(lines: DataFrame, packed: DataFrame, members: DataFrame, *, last: int, near: int) -> DataFrame:
    """(profile, finished, item): the items last finished and no longer kept, with their nearest ones.

    packed: (item, features) of classes of equal items, named by the smallest of their members (class, id).
    """
    rows = lines.select(F.col("o_custkey").alias("profile"), F.col("l_partkey").alias("item"), "o_orderdate", "l_returnflag", "l_linestatus")
    done = rows.where("l_returnflag = 'A' and l_linestatus = 'F'").groupBy("profile", "item").agg(F.max("o_orderdate").alias("latest"))
    kept = rows.where("l_returnflag = 'N' and l_linestatus = 'O'").select("profile", "item").distinct()
    finished = top_per_group(done.join(kept, ["profile", "item"], "left_anti"), ["profile"], [F.desc("latest"), "item"], last)
    finished = materialize(finished.select("profile", F.col("item").alias("finished")), "finished")
    asking = materialize(finished.select(F.col("finished").alias("id")).distinct().join(members, "id").select("class", "id"), "asking")
    asked = asking.select(F.col("class").alias("item")).distinct()
    near_by = nearest(packed, asked=asked, k=near).select("q", F.col("item").alias("id"), "sim")
    own = packed.join(asked, "item", "left_semi").select(F.col("item").alias("q"), F.col("item").alias("id"), F.lit(1.0).alias("sim"))
    near_by = copies.nearest_members(near_by.unionByName(own), members, asking, near).select(F.col("q").alias("finished"), F.col("id").alias("item"))
    return finished.join(near_by, "finished").select("profile", "finished", "item")


def match_percent(pairs: DataFrame, weights: DataFrame, cards: DataFrame) -> DataFrame:
    """(profile, item, percent): 0.6 axes + 0.25 aromas + 0.15 colour against a profile's likes, stretched, 10 to 99."""
    about = cards.select("item", "axes", F.array_distinct("aromas").alias("aromas"), "color")
    liked = weights.where("w > 0").join(about, "item")
    axes = liked.select("profile", "w", F.explode("axes").alias("axis", "v")).groupBy("profile", "axis").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    axes = axes.groupBy("profile").agg(F.map_from_entries(F.collect_list(F.struct("axis", "v"))).alias("mean"))
    aromas = liked.select("profile", "w", F.explode("aromas").alias("aroma")).groupBy("profile", "aroma").agg(F.round(F.sum("w"), 6).alias("w"))
    aromas = top_per_group(aromas, ["profile"], [F.desc("w"), "aroma"], 5).groupBy("profile").agg(F.collect_list("aroma").alias("known"))
    colors = liked.groupBy("profile").agg(F.collect_set("color").alias("colors"))
    met = pairs.join(about, "item").join(axes, "profile").join(aromas, "profile").join(colors, "profile")
    shared = F.array_intersect(F.map_keys("axes"), F.map_keys("mean"))
    gap = F.aggregate(shared, F.lit(0.0), lambda s, a: s + F.abs(F.element_at("mean", a) - F.element_at("axes", a))) / F.size(shared)
    hit = F.size(F.array_intersect("known", "aromas")) / F.size("aromas")
    raw = 0.6 * (1 - gap / 4) + 0.25 * hit + 0.15 * F.array_contains("colors", F.col("color")).cast("double")
    stretched = F.floor(F.round(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - 0.2) / 0.7)), 6))
    return met.select("profile", "item", F.least(F.lit(99), F.greatest(F.lit(10), stretched)).cast("long").alias("percent"))


def deck(swiped: DataFrame, scores: DataFrame, *, pool: int, n: int) -> DataFrame:
    """(profile, item, prior, pos): the next n cards of each profile that swipes, from the `pool` best less those swiped."""
    best = scores.orderBy(F.desc("prior"), "item").limit(pool)
    every = swiped.select("profile").distinct().crossJoin(F.broadcast(best))  # pool rows
    left = every.join(swiped, ["profile", "item"], "left_anti")
    pos = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("prior"), "item"))
    return left.withColumn("pos", pos).where(F.col("pos") <= n)


def list_fit(lists: DataFrame, occasion: DataFrame, packed: DataFrame, members: DataFrame, *, k: int) -> DataFrame:
    """(list, item, fit): 6 * likeness to the nearest member + 4 * occasion, the k best items outside each of lists (list, item).

    occasion, packed: (item, ...) of classes of equal items, named by the smallest of their members (class, id). Items of a list
    stand in a bounded number of classes; so many more than k classes hold the k best outside it.
    """
    named = lists.join(members.withColumnRenamed("id", "item"), "item").select("list", "item", "class")
    named = materialize(named, "lists")
    mine = named.groupBy("list", "class").agg(F.min("item").alias("item"))
    touched = mine.groupBy("list").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    profiles = lists.select(F.col("list").alias("profile"), F.lit(1.0).alias("confidence"), F.lit(False).alias("guard"), F.array().cast("array<string>").alias("levels"), F.array().cast("array<long>").alias("seen")).distinct()
    seeds = mine.join(packed.withColumnRenamed("item", "class"), "class").select(F.col("list").alias("profile"), F.col("class").alias("item"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("w"), "features")
    items = occasion.join(packed, "item").select("item", F.lit("").alias("level"), F.col("occasion").alias("prior"), "features")

    def fit(best, prior, **_):
        return 6 * best + 4 * prior

    # a class that the list holds none of offers its k first items, another one k beyond those that the list holds
    found = taste.ranked_items(profiles, seeds, items, k=k + touched, score=fit).select(F.col("profile").alias("list"), F.col("item").alias("class"), F.col("score").alias("fit"))
    held = named.groupBy("list", "class").agg(F.count("*").alias("n"))
    most = held.agg(F.max("n")).first()[0] or 0
    offered = found.join(held, ["list", "class"], "left").join(copies.first_members(members, k + most), "class")
    offered = offered.select("list", "class", "fit", F.explode(F.slice("ids", F.lit(1), k + F.coalesce("n", F.lit(0)))).alias("item"))
    outside = offered.join(named, ["list", "class", "item"], "left_anti")
    return top_per_group(outside.select("list", "item", "fit"), ["list"], [F.desc("fit"), "item"], k)


def shelves(members: DataFrame, scores: DataFrame, names: DataFrame, *, good: float, wanted: str) -> DataFrame:
    """(list, n, score): mean of members + 5 * the share at `good` or more + 8 for a name that holds `wanted`; equal contents once."""
    grouped = members.join(scores, "item").groupBy("list").agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.count_if(F.col("score") > good).alias("liked"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item")).cast("array<string>")), 256).alias("print"))
    bonus = F.when(F.contains("name", F.lit(wanted)), 8).otherwise(0)
    ranked = grouped.join(names, "list").withColumn("score", F.round(F.col("mean") + 5.0 * F.col("liked") / F.col("n") + bonus, 6))
    return top_per_group(ranked, ["print"], [F.desc("score"), "name", "list"], 1).select("list", "n", "score")


def why(vectors: DataFrame, *, asked: str, k: int, kinds: tuple[str, ...], n: int) -> DataFrame:
    """(q, item, feature, product): the n strongest shared features of the given kinds, of each asked item and its k nearest."""
    pairs = nearest(taste.packed_vectors(vectors, ["item"]), asked=asked, k=k).select("q", "item")
    told = vectors.where(F.col("kind").isin(*kinds))
    mine = told.select(F.col("item").alias("q"), "feature", F.col("x").alias("a"))
    theirs = told.select("item", "feature", F.col("x").alias("b"))
    products = pairs.join(mine, "q").join(theirs, ["item", "feature"]).select("q", "item", "feature", F.round(F.col("a") * F.col("b"), 6).alias("product"))
    return top_per_group(products, ["q", "item"], [F.desc("product"), "feature"], n)


def progress(goals: DataFrame, tried: DataFrame) -> DataFrame:
    """(profile, challenge, done, total, complete) from (challenge, item) and (profile, item)."""
    total = goals.groupBy("challenge").agg(F.count("*").alias("total"))
    done = tried.join(goals, "item").groupBy("profile", "challenge").agg(F.count("*").alias("done"))
    return done.join(total, "challenge").select("profile", "challenge", "done", "total", (F.col("done") == F.col("total")).alias("complete"))


def leave_one_out(vectors: DataFrame, labels: DataFrame, *, asked: str, k: int) -> DataFrame:
    """(item, predicted, truth): weighted vote of the k nearest items of other producers, from labels (item, producer, yes)."""
    packed = taste.packed_vectors(vectors, ["item"]).join(labels.select("item", "producer"), "item")
    near = nearest(packed, asked=asked, k=k, group="producer")
    exact = F.col("sim").cast("decimal(18,6)")
    votes = near.join(labels.select("item", "yes"), "item").groupBy("q").agg((F.sum(F.when(F.col("yes"), exact).otherwise(0)).cast("double") / F.sum(exact).cast("double")).alias("p"))
    return votes.join(labels, F.col("q") == F.col("item")).select("item", F.round("p", 4).alias("predicted"), F.col("yes").alias("truth"))
