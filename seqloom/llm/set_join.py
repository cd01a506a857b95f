"""All similar pairs between set-valued records, of one table or of two: a prefix-filtered join.

Equal sets are one class, joined once through a representative: copies never meet in
the index.  Tokens of the classes are ordered by rarity.  Two sets with Jaccard
similarity t or more share a token among the first n - ceil(t n) + 1 of each, so only
these prefixes are indexed.  Pairs of one index key must pass the length filter and
the positional filter; the rest is verified by exact overlap.

Common keys are split twice, both exactly.  A prefix token of more than ``hot`` sets is
indexed together with a second token: sets that must share two tokens share two in the
prefix one longer.  A key that still holds more than ``BLOCK`` sets is cut into blocks
of about that size, and each pair of blocks is a key of its own.

Defined results of edge cases
* null id, null token: left out; repeated tokens and rows of an id: united
* sets smaller than ``min_size``, empty and null sets: no part of any pair
* tokens of any type that can be ordered; strings may hold any character
* a threshold of 0 or less or above 1: ValueError
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.skew import Spread
from seqloom.session import cut, salted_lookup

BLOCK = 2_000  # sets of one index key that one task pairs with as many others


def _need(n: Column, t: float) -> Column:
    return F.ceil(n * F.lit(t) - F.lit(1e-9)).cast("int")


def value_sets(elements: DataFrame, min_size: int) -> DataFrame:
    """(id, [side,] tokens, class_key) of (id, token[, side]) rows; tokens in the order of their values."""
    key = [c for c in ("side", "id") if c in elements.columns]
    rows = elements.select(*key, "token").where(F.col("id").isNotNull() & F.col("token").isNotNull())
    sets = rows.groupBy(*key).agg(F.array_sort(F.collect_set("token")).alias("tokens")).where(F.size("tokens") >= max(min_size, 1))
    # as JSON no two different sets look alike, whatever their tokens hold
    return sets.withColumn("class_key", F.md5(F.to_json("tokens")))


def classes(sets: DataFrame) -> DataFrame:
    """One row per distinct set: (class_key, rep, tokens, n, size[, lefts, rights]); tokens rarest first,
    ``rep`` the least id (of two tables: the class key)."""
    sided = "side" in sets.columns
    counts = [F.count_if(F.col("side") == s).alias(c) for s, c in ((0, "lefts"), (1, "rights"))] if sided else []
    one = sets.groupBy("class_key", "tokens").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), *counts)
    if sided:  # ids of two tables may be the same
        one = one.withColumn("rep", F.col("class_key"))
    each = one.select("class_key", F.explode("tokens").alias("token"))
    freq = each.groupBy("token").agg(F.count(F.lit(1)).alias("_f"))
    order = (
        salted_lookup(each, freq, "token", F.col("class_key")).groupBy("class_key")
        .agg(F.sort_array(F.collect_list(F.struct("_f", "token"))).alias("_s"))
        .select("class_key", F.transform("_s", lambda x: x["token"]).alias("tokens"))
    )
    return one.drop("tokens").join(order, "class_key").withColumn("n", F.size("tokens"))


def membership(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, [side,] rep, size) of every set; a class may hold a large share of all sets, so the lookup is salted."""
    key = [c for c in ("side", "id") if c in sets.columns]
    return salted_lookup(sets.select(*key, "class_key"), reps.select("class_key", "rep", "size"), "class_key", F.col("id")).drop("class_key")


def _split(keyed: DataFrame, block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the join and what to join them on beside the key: in keys of more than ``block`` sets a
    set's block, beside each block it is held against."""
    spread = Spread.measure(keyed, ["token", "second"], block)
    if spread.hot is None:
        return keyed, keyed, []
    n = F.coalesce("_salts", F.lit(1))
    wide = spread.mark(keyed).withColumn("_own", F.pmod(F.xxhash64("rep"), n).cast("int"))
    wide = wide.withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return wide.withColumnsRenamed({"_own": "_i", "_other": "_j"}), wide.withColumnsRenamed({"_other": "_i", "_own": "_j"}), ["_i", "_j"]


def class_pairs(reps: DataFrame, threshold: float, hot: int = 200, block: int = BLOCK) -> DataFrame:
    """(a, b, overlap, similarity) of representatives, a < b; of two tables only classes that pair a set of
    the one with a set of the other."""
    t = threshold
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sides = [c for c in ("lefts", "rights") if c in reps.columns]
    need = _need(F.col("n"), t)
    base = reps.select("rep", "n", *sides, (F.col("n") - need + 1).alias("p"), need.alias("_need"), "tokens").withColumn(
        "_pre", F.slice("tokens", F.lit(1), F.col("p") + 1)
    )
    index = base.select("rep", "n", "_need", *sides, "_pre", F.posexplode(F.slice("_pre", F.lit(1), F.col("p"))).alias("pos", "token"))
    marked = Spread.measure(index, ["token"], hot).mark(index)
    later = F.slice("_pre", F.col("pos") + 2, F.size("_pre"))
    none = F.array(F.lit(None).cast(reps.schema["tokens"].dataType.elementType))
    # a set that needs two common tokens with any partner goes by two; one that may do with a single one goes by
    # that as well, as its larger partners go by two alone
    second = F.when(F.col("_salts").isNull(), none).when(F.col("_need") > 1, later).otherwise(F.concat(none, later))
    keyed = marked.select("rep", "n", *sides, "pos", "token", F.explode(second).alias("second"))
    left, right, blocks = _split(keyed, block)
    x, y = left.alias("x"), right.alias("y")
    c = lambda s: F.col(s)
    alpha = F.ceil((c("x.n") + c("y.n")) * F.lit(t / (1 + t)) - F.lit(1e-9))
    room = F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos"))
    ok = (
        (c("x.token") == c("y.token")) & c("x.second").eqNullSafe(c("y.second"))
        & (c("x.rep") < c("y.rep")) & (c("x.n") >= _need(c("y.n"), t)) & (c("y.n") >= _need(c("x.n"), t)) & (room >= alpha)
    )
    for b in blocks:
        ok &= c(f"x.{b}") == c(f"y.{b}")
    if sides:
        ok &= ((c("x.lefts") > 0) & (c("y.rights") > 0)) | ((c("x.rights") > 0) & (c("y.lefts") > 0))
    cand = x.join(y, ok).select(c("x.rep").alias("a"), c("y.rep").alias("b")).distinct()
    ta = reps.select(F.col("rep").alias("a"), F.col("tokens").alias("_ta"))
    tb = reps.select(F.col("rep").alias("b"), F.col("tokens").alias("_tb"))
    overlap = F.size(F.array_intersect("_ta", "_tb"))
    return (
        cand.join(ta, "a")
        .join(tb, "b")
        .withColumn("overlap", overlap)
        .withColumn("similarity", F.col("overlap") / (F.size("_ta") + F.size("_tb") - F.col("overlap")))
        .where(F.col("similarity") >= F.lit(t - 1e-12))
        .select("a", "b", "overlap", "similarity")
    )


def _parts(elements: DataFrame, threshold: float, min_size: int, hot: int):
    # read several times below: a reliable checkpoint keeps the plan small and the work single
    sets = cut(value_sets(elements, min_size))
    reps = cut(classes(sets))
    return sets, reps, membership(sets, reps), class_pairs(reps, threshold, hot)


def _expand(links: DataFrame, reps: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, x, y): members x of class a in ``left`` beside members y of class b in ``right`` by links (a, b).

    A class may hold a large share of all ids.  Its ids go into blocks of about ``BLOCK``, and each pair of
    blocks of a link is a key of its own, so what a task pairs is bounded."""
    if not reps.where(F.col("size") > BLOCK).limit(1).count():
        x = left.select(F.col("rep").alias("a"), F.col("id").alias("x"))
        y = right.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        return links.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    blocks = reps.select("rep", count.alias("_n"))
    for rep, no in (("a", "_i"), ("b", "_j")):
        links = links.join(blocks.withColumnRenamed("rep", rep), rep).withColumn(no, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    own = F.pmod(F.xxhash64("id"), count).cast("int")
    x = left.select(F.col("rep").alias("a"), own.alias("_i"), F.col("id").alias("x"))
    y = right.select(F.col("rep").alias("b"), own.alias("_j"), F.col("id").alias("y"))
    return links.join(x, ["a", "_i"]).join(y, ["b", "_j"]).select("a", "b", "x", "y")


def similar_pairs(elements: DataFrame, threshold: float = 0.8, min_size: int = 5, hot: int = 200) -> DataFrame:
    """Every pair (id_a, id_b), id_a < id_b, classes expanded."""
    _, reps, member, pairs = _parts(elements, threshold, min_size, hot)
    own = reps.where(F.col("size") > 1).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    both = _expand(pairs.select("a", "b").unionByName(own), reps, member, member).where("a <> b OR x < y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_pairs_between(left: DataFrame, right: DataFrame, threshold: float = 0.8, min_size: int = 5, hot: int = 200) -> DataFrame:
    """Every pair (id_left, id_right) of two tables of (id, token) rows; ids of the two need not differ."""
    cols = [F.col("id"), F.col("token")]
    both = left.select(F.lit(0).alias("side"), *cols).unionByName(right.select(F.lit(1).alias("side"), *cols))
    _, reps, member, pairs = _parts(both, threshold, min_size, hot)
    ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = ways.unionByName(reps.where("lefts > 0 AND rights > 0").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    out = _expand(ways, reps, member.where("side = 0"), member.where("side = 1"))
    return out.select(F.col("x").alias("id_left"), F.col("y").alias("id_right"))


def linked_classes(elements: DataFrame, threshold: float = 0.8, min_size: int = 5, hot: int = 200) -> DataFrame:
    """One row per record in any pair's reach: (id, class_id, n_links), copies not expanded into pairs."""
    _, reps, member, pairs = _parts(elements, threshold, min_size, hot)
    sizes = reps.select("rep", "size")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("rep"), F.col("a").alias("other"))
    )
    far = both.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("size").alias("_far"))
    links = sizes.join(far, "rep", "left").select(
        "rep", (F.col("size") - 1 + F.coalesce("_far", F.lit(0))).cast("long").alias("n_links")
    )
    return salted_lookup(member, links, "rep", F.col("id")).select("id", F.col("rep").alias("class_id"), "n_links")


def path_elements(paths: DataFrame) -> DataFrame:
    return paths.select(F.col("genome_id").alias("id"), F.explode("steps.unitig_id").alias("token"))


def node_elements(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("unitig_id").alias("id"), F.explode("genome_ids").alias("token"))
