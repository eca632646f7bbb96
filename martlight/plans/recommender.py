"""Co-purchase recommender with a time split, popularity fallback and offline evaluation.

Two exact compressions keep hot keys small:

* products that occur in exactly the same orders form a *class*; they have equal
  similarity to every other product and similarity 1 to each other, so pairs and
  scores are computed per class and expanded to products only for the listed rows;
* persons with the same purchase set share a *history*; recommendations are
  computed once per history and joined back to its persons.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlight.functions.columns import ranked_array
from martlight.operators.ordering import grouped_position, rank_first, top_n_per, ts_quantile
from martlight.operators.pairs import (
    basket_classes,
    baskets,
    co_purchase_pairs,
    jaccard,
    nth_unseen,
    pair_parts,
    product_frequency,
    with_orders,
)
from martlight.operators.products import packed_lists, top_of_product
from martlight.plans.facts import person_orders
from martlight.plans.product import categories
from martlight.session import stable
from martlight.sources.tables import Marketplace

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"
# fixed values: order states that do not count as purchases, and method names
EXCLUDED_STATES = ["canceled", "unavailable"]
BY_SIMILARITY = "item_item_similarity"
BY_POPULARITY = "popularity_fallback"
METHODS = {"popularity": "Popularity Baseline", "similarity": "Item-Item Collaborative Filtering"}
# Similarities are summed as integers of this unit, so that equal scores tie whatever the
# order of summation.  A sum is at most the size of the largest basket of the candidate.
SCORE_UNIT = 1_000_000_000_000


def interactions(t: Marketplace) -> DataFrame:
    """fq04: purchased items with person and time; canceled and unavailable orders are left out."""
    items = t.order_items.select("order_id", "product_id", "price", "freight_value")
    return (
        person_orders(t, TS, "order_status")
        .where(~F.col("order_status").isin(EXCLUDED_STATES))
        .drop("order_status")
        .join(items, "order_id")
        .fillna(0, ["price", "freight_value"])
        .dropna(subset=[PERSON, "product_id", TS])
    )


def time_split(df: DataFrame, p: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows up to the p-quantile of the interaction times, and the rows after it."""
    cutoff = ts_quantile(df, TS, p).head()[0]
    limit = F.lit(cutoff).cast("timestamp_ntz")
    return df.where(F.col(TS) <= limit), df.where(F.col(TS) > limit)


def popularity(train: DataFrame) -> DataFrame:
    """Products by orders, then persons, then id, with score relative to the most bought one."""
    per_order = train.groupBy("product_id", "order_id").agg(F.max(PERSON).alias(PERSON), F.sum("price").alias("revenue"))
    sold = per_order.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("purchase_count"),
        F.countDistinct(PERSON).alias("customer_count"),
        F.sum("revenue").cast("double").alias("revenue"),
    )
    order = [F.desc("purchase_count"), F.desc("customer_count"), F.col("product_id")]
    ranked = rank_first(sold, order, "popularity_rank")
    top = ranked.where(F.col("popularity_rank") == 1).select(F.col("purchase_count")).scalar()
    return ranked.withColumn("popularity_score", F.col("purchase_count") / top)


def history_rows(train: DataFrame) -> DataFrame:
    """Distinct (person, product)."""
    return train.select(PERSON, "product_id").distinct()


def history_sets(train: DataFrame, key: str = PERSON, item: str = "product_id") -> DataFrame:
    """Items per key as a sorted array, for export of bounded histories."""
    return train.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"))


def item_similarity(train: DataFrame) -> DataFrame:
    """Jaccard similarity of every pair bought together, in both directions."""
    basket = stable(baskets(train))
    parts = pair_parts(basket)
    pairs = with_orders(co_purchase_pairs(basket, parts=parts), product_frequency(basket), ("orders_a", "orders_b"), parts)
    similarity = jaccard(F.col("co_purchase_orders"), F.col("orders_a"), F.col("orders_b"))
    both = F.inline(
        F.array(
            F.struct(F.col("product_a").alias("src"), F.col("product_b").alias("dst")),
            F.struct(F.col("product_b").alias("src"), F.col("product_a").alias("dst")),
        )
    )
    return pairs.select(both, F.col("co_purchase_orders").alias("co_orders"), similarity.alias("jaccard"))


@dataclass(frozen=True)
class History:
    """Who bought what, once per different purchase set, and what is popular."""

    popularity: DataFrame  # product_id, popularity_rank, purchase_count, popularity_score, ...
    history: DataFrame  # history_id, product_id
    persons: DataFrame  # customer_unique_id, history_id


@dataclass(frozen=True)
class Recommender(History):
    """History with the similarity of product classes."""

    members: DataFrame  # product_id, class_id, place within the class
    classes: DataFrame  # class_id, orders, size, number
    lists: DataFrame  # neighbours of a class by its number, packed best first; similarity in SCORE_UNITs


def fit_history(train: DataFrame) -> History:
    bought = history_rows(train)
    sets = bought.groupBy(PERSON).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("product_id")).alias("set_1"),
        F.bit_xor(F.xxhash64(F.lit(7), "product_id")).alias("set_2"),
    )
    first = sets.groupBy("n", "set_1", "set_2").agg(F.min(PERSON).alias("history_id"))
    persons = stable(sets.join(first, ["n", "set_1", "set_2"]).select(PERSON, "history_id"))
    owners = persons.where(F.col(PERSON) == F.col("history_id")).select("history_id")
    history = bought.withColumnRenamed(PERSON, "history_id").join(owners, "history_id", "left_semi")
    return History(popularity(train), stable(history), persons)


def fit_recommender(train: DataFrame) -> Recommender:
    basket = stable(baskets(train))
    signature = ["orders", "digest_1", "digest_2"]
    products = basket_classes(basket)
    named = products.groupBy(*signature).agg(F.min("product_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    member_of = products.join(named, signature).select("product_id", "class_id")
    members = grouped_position(member_of, ["class_id"], [F.col("product_id")], "place")
    classes = stable(rank_first(named.select("class_id", "orders", "size"), [F.col("class_id")], "number"))

    # The rows of a class's first member stand for the class.
    numbered = basket.join(classes.select(F.col("class_id").alias("product_id"), "number", "orders"), "product_id")
    numbered = numbered.select("order_id", F.col("number").alias("product_id"), "orders")
    pairs = co_purchase_pairs(numbered, parts=pair_parts(numbered), carried="orders")
    similarity = jaccard(F.col("co_purchase_orders"), F.col("orders_a"), F.col("orders_b"))
    units = F.round(similarity * SCORE_UNIT).cast("long").alias("value")

    def towards(src: str, dst: str) -> Column:
        return F.struct(F.col(f"product_{src}").alias("src"), F.col(f"product_{dst}").alias("dst"), units)

    loops = classes.where(F.col("size") > 1).select(
        F.col("number").alias("src"), F.col("number").alias("dst"), F.lit(SCORE_UNIT).cast("long").alias("value")
    )
    directed = pairs.select(F.inline(F.array(towards("a", "b"), towards("b", "a"))))
    lists = stable(packed_lists(directed.unionByName(loops)))
    known = fit_history(train)
    return Recommender(known.popularity, known.history, known.persons, stable(members), classes, lists)


def similar_products(model: Recommender, k: int, histories: DataFrame | None = None) -> DataFrame:
    """Up to ``k`` unseen products per history by summed similarity, popularity, id."""
    history = model.history
    if histories is not None:
        history = history.join(histories, "history_id", "left_semi")
    owned = (
        history.join(model.members, "product_id")
        .groupBy("history_id", "class_id")
        .agg(F.count(F.lit(1)).alias("held"))
    )
    owned = stable(owned.join(model.classes, "class_id").select("history_id", "number", "held", (F.col("held") >= F.col("size")).alias("closed")))
    sources = owned.select("history_id", F.col("number").alias("src"), F.col("held").alias("weight"), "closed")
    scored = top_of_product(sources, model.lists, "history_id", k).withColumnRenamed("dst", "number")
    held = owned.select("history_id", "number", "held")
    open_classes = (
        scored.join(model.classes, "number")
        .join(held, ["history_id", "number"], "left")
        .withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
        .withColumn("free", F.col("size") - F.col("held"))
    )
    # Every class offers at least one product, so classes behind k better ones cannot be listed.
    best = Window.partitionBy("history_id").orderBy(F.desc("score"), F.desc("orders"))
    leading = open_classes.withColumn("class_rank", F.rank().over(best)).where(F.col("class_rank") <= k)
    leading = stable(leading.select("history_id", "class_id", "score", "orders", "free", "held"))

    slots = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("free"), F.lit(k).cast("long"))))
    wanted = leading.select("history_id", "class_id", "held", slots.alias("slot"))
    places = model.members.withColumnRenamed("place", "slot")
    plain = wanted.where(F.col("held") == 0).join(places, ["class_id", "slot"])
    partly = wanted.where(F.col("held") > 0).drop("held")
    listed = plain.select("history_id", "class_id", "product_id")
    if not partly.isEmpty():
        rest = nth_unseen(partly, history, model.members, ["history_id", "class_id"], "product_id", ["class_id"])
        listed = listed.unionByName(rest.select("history_id", "class_id", "product_id"))
    candidates = listed.join(leading.select("history_id", "class_id", "score", "orders"), ["history_id", "class_id"])
    order = [F.desc("score"), F.desc("orders"), F.col("product_id")]
    return top_n_per(candidates, ["history_id"], order, k).select(
        "history_id", "product_id", "rank", (F.col("score") / F.lit(float(SCORE_UNIT))).alias("score")
    )


def popular_unseen(model: History, histories: DataFrame, k: int) -> DataFrame:
    """The ``k`` most popular products each history does not hold."""
    ranking = model.popularity.select("product_id", F.col("popularity_rank").alias("place"))
    slots = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")))
    wanted = histories.select("history_id", slots.alias("slot"))
    history = model.history.join(histories, "history_id", "left_semi")
    return nth_unseen(wanted, history, ranking, ["history_id"], "product_id").select(
        "history_id", "product_id", F.col("slot").cast("int").alias("rank"), F.lit(0.0).alias("score")
    )


def popular_top(model: History, histories: DataFrame, k: int) -> DataFrame:
    """The ``k`` most popular products, seen or not; a list of k rows goes to every history."""
    top = model.popularity.where(F.col("popularity_rank") <= k)
    listed = F.collect_list(F.struct(F.col("popularity_rank").cast("int").alias("rank"), "product_id"))
    return histories.select("history_id", F.inline(top.agg(listed).scalar())).withColumn("score", F.lit(0.0))


def recommend(model: Recommender, k: int = 10, customers: DataFrame | None = None, unseen_only: bool = True) -> DataFrame:
    """``k`` products per person: by similarity where the history has neighbours, else by popularity.

    ``customers`` limits the persons and may name ones without history.  The fallback
    leaves out purchased products unless ``unseen_only`` is false.
    """
    if not 1 <= k <= 50:
        raise ValueError("k counts products per person: 1 to 50")
    persons = model.persons
    if customers is not None:
        persons = customers.select(PERSON).distinct().join(persons, PERSON, "left")
    known = persons.where(F.col("history_id").isNotNull())
    histories = known.select("history_id").distinct()
    similar = stable(similar_products(model, k, histories).withColumn("method", F.lit(BY_SIMILARITY)))
    lonely = stable(histories.join(similar.select("history_id"), "history_id", "left_anti"))
    per_history = similar
    if not lonely.isEmpty():
        fallback = (popular_unseen if unseen_only else popular_top)(model, lonely, k)
        per_history = similar.unionByName(fallback.withColumn("method", F.lit(BY_POPULARITY)))
    columns = [PERSON, "product_id", "rank", "score", "method"]
    found = known.join(per_history, "history_id").select(*columns)
    if customers is None:
        return found
    cold = persons.where(F.col("history_id").isNull()).select(F.col(PERSON).alias("history_id"))
    cold = popular_top(model, cold, k).withColumn("method", F.lit(BY_POPULARITY))
    return found.unionByName(cold.withColumnRenamed("history_id", PERSON).select(*columns))


def popularity_recs(model: History, customers: DataFrame, k: int = 10) -> DataFrame:
    """Popularity baseline: the ``k`` most popular unseen products of each person."""
    known = customers.select(PERSON).distinct().join(model.persons, PERSON)
    listed = popular_unseen(model, known.select("history_id").distinct(), k)
    return known.join(listed, "history_id").select(PERSON, "product_id", "rank", "score")


def eligible_customers(train: DataFrame, test: DataFrame) -> DataFrame:
    """Persons with purchases in both periods."""
    return test.select(PERSON).distinct().join(train.select(PERSON), PERSON, "left_semi")


def evaluate_recs(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Precision, recall and hit rate at ``k`` of recommendations against distinct (person, product) rows.

    Persons are those of ``truth``; recall pools all relevant items.
    """
    listed = recs.select(PERSON, "product_id", F.lit(1).alias("hit"))
    per_person = (
        truth.join(listed, [PERSON, "product_id"], "left")
        .groupBy(PERSON)
        .agg(F.count(F.lit(1)).alias("relevant"), F.count("hit").alias("overlap"))
    )
    totals = per_person.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("relevant").alias("relevant"),
        F.sum("overlap").alias("overlap"),
        F.count_if(F.col("overlap") > 0).alias("hits"),
    )

    def ratio(top: str, bottom):
        return F.coalesce(F.col(top) / F.nullif(bottom, F.lit(0).cast("long")), F.lit(0.0))

    return totals.select(
        ratio("overlap", F.col("n") * k).alias("precision_at_k"),
        ratio("overlap", F.col("relevant")).alias("recall_at_k"),
        ratio("hits", F.col("n")).alias("hit_rate_at_k"),
        F.col("n").alias("customers_evaluated"),
    )


def compare_methods(metrics: dict[str, DataFrame]) -> DataFrame:
    rows = [df.select(F.lit(name).alias("method"), "*") for name, df in metrics.items()]
    return reduce(DataFrame.unionByName, rows)


def long_comparison(comparison: DataFrame) -> DataFrame:
    return comparison.unpivot(["method"], ["precision_at_k", "recall_at_k", "hit_rate_at_k"], "metric", "score")


def recommendation_table(model: Recommender, customers: DataFrame, product_names: DataFrame, k: int = 10) -> DataFrame:
    """Ranked products with category, plain popularity as fallback."""
    recs = recommend(model, k, customers, unseen_only=False)
    return recs.join(product_names, "product_id", "left").select(PERSON, "product_id", "rank", "category")


def saved_recs(recs: DataFrame, customer_id, k: int = 10) -> DataFrame:
    """Saved rows of one person in rank order."""
    if not 1 <= k <= 50:
        raise ValueError("k counts products per person: 1 to 50")
    mine = recs.where(F.col(PERSON).cast("string") == str(customer_id))
    return mine.orderBy("rank").limit(k)


def customer_history(model: History, customer_id) -> DataFrame:
    """Purchased products of one person."""
    mine = model.persons.where(F.col(PERSON).cast("string") == str(customer_id))
    return mine.join(model.history, "history_id").select(PERSON, "product_id").orderBy("product_id")


def rec_metadata(model: Recommender) -> DataFrame:
    """Counts describing a fitted recommender."""
    persons = model.persons.agg(F.count(F.lit(1)).alias("customers"))
    return persons.select(
        "customers",
        model.popularity.agg(F.count(F.lit(1))).scalar().alias("products"),
        model.classes.agg(F.count(F.lit(1))).scalar().alias("product_classes"),
        model.persons.agg(F.countDistinct("history_id")).scalar().alias("histories"),
    )


def neighbour_lists(similarity: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest products of each product as an array, for export."""
    order = [F.desc("jaccard"), F.col("dst")]
    top = top_n_per(similarity, ["src"], order, k)
    entry = F.struct(F.col("dst").alias("product_id"), "jaccard")
    return top.groupBy("src").agg(ranked_array(entry, F.col("rank")).alias("neighbours"))


# ---- registered queries -----------------------------------------------------


def interaction_table(t: Marketplace) -> DataFrame:
    """fq04"""
    return interactions(t).withColumns({c: F.col(c).cast("double") for c in ("price", "freight_value")})


def product_category_table(t: Marketplace) -> DataFrame:
    """fq05"""
    return categories(t)


def purchase_rows(t: Marketplace) -> DataFrame:
    """Interactions joined once; every later step reads these narrow rows."""
    return stable(interactions(t).select(PERSON, "order_id", TS, "product_id", "price"))


def _train(t: Marketplace) -> DataFrame:
    return time_split(purchase_rows(t))[0]


def popularity_table(t: Marketplace) -> DataFrame:
    return popularity(_train(t)).select("product_id", "purchase_count", "customer_count", "revenue", "popularity_rank", "popularity_score")


def similarity_table(t: Marketplace) -> DataFrame:
    return item_similarity(_train(t)).withColumn("jaccard", F.round("jaccard", 12))


def _eligible(t: Marketplace) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = time_split(purchase_rows(t))
    customers = eligible_customers(train, test)
    truth = test.select(PERSON, "product_id").distinct().join(customers, PERSON, "left_semi")
    return train, customers, truth


def recommendations(t: Marketplace) -> DataFrame:
    """k5_7, k5_12: for every person with purchases in both periods."""
    train, customers, _ = _eligible(t)
    return recommendation_table(fit_recommender(train), customers, categories(t))


def scored_recommendations(t: Marketplace) -> DataFrame:
    """k5_8: for every known person, fallback without purchased products."""
    return recommend(fit_recommender(_train(t)), 10, t.customers)


def baseline_recommendations(t: Marketplace) -> DataFrame:
    """k5_9"""
    train, customers, _ = _eligible(t)
    return popularity_recs(fit_history(train), customers).select(PERSON, "product_id", "rank")


def method_comparison(t: Marketplace, k: int = 10) -> DataFrame:
    """k5_10, k5_11"""
    train, customers, truth = _eligible(t)
    model, truth = fit_recommender(train), stable(truth)
    return compare_methods(
        {
            METHODS["popularity"]: evaluate_recs(popularity_recs(model, customers, k), truth, k),
            METHODS["similarity"]: evaluate_recs(recommend(model, k, customers, unseen_only=False), truth, k),
        }
    )


def method_comparison_long(t: Marketplace) -> DataFrame:
    return long_comparison(method_comparison(t))


QUERIES = {
    "fq04_interactions": interaction_table,
    "fq05_product_categories": product_category_table,
    "k5_3_popularity": popularity_table,
    "k5_6_item_similarity": similarity_table,
    "k5_8_recommendations_all": scored_recommendations,
    "k5_9_popularity_baseline": baseline_recommendations,
    "k5_10_method_comparison": method_comparison,
    "k5_11_method_comparison_long": method_comparison_long,
    "k5_12_recommendation_table": recommendations,
}
