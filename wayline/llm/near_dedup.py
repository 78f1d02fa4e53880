"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each document gives its set of word shingles and a MinHash signature of ``coordinates`` values.
   Documents with equal sets become one node.
2. A signature is a set of (coordinate, value) tokens. Nodes are posted under their tokens, rarest
   first; two nodes that agree on ``matches`` coordinates must meet within the first
   ``coordinates - matches + 1`` tokens of both (prefix), so the most frequent tokens are never
   posted (skip). Tokens that one node alone has are not posted either.
3. Pairs that meet are merged: coordinates that agree are counted on the whole signatures, and pairs
   above the threshold are confirmed on the full shingle sets.
4. A list of n nodes does not give n*n pairs. First all nodes of a list meet its smallest node, and
   confirmed links give components. For the lists that still hold several components each node's
   shingles that no other node of such a list has are counted: a pair can't have them in common,
   which bounds its similarity from above, and so do the bits in which two parity sketches of their
   sets differ; both rule out most pairs without a look at the sets. Then
   all nodes meet the list's most central one, that with the largest shared part. What is left are
   pairs of different components within the bound: each node outside a list's largest component
   meets all others of that list. So every pair that could join two components is tested or ruled
   out by a bound, and no link between components is lost.

What is summed by token, node or shingle is summed before its shuffle and written before it is joined
again. Each such join then has plain shuffles on both sides, which Spark splits where one key is hot.
A node is named by the first 64 bits of its set's key, never by a doc_id, which may be null or stand for several texts.

``matches`` is the largest number for which a pair exactly at the threshold is missed with a
probability of at most 1e-6; pairs above it are missed far less often.

Defined results: a null or wordless text has an empty set and links with nothing; component_id is the
smallest doc_id of a component that is not null. In ``near_duplicates`` a set none of whose rows has an id
links with nothing (component null, kept); rows of one doc_id and one set are each returned with equal
results, so both are kept or neither; different sets with one smallest id are nodes of their own. A very
long text is one block: its set is held whole by one task. An empty table gives no rows; other columns are ignored.
``keep_distinct`` works on rows instead: of each component exactly one row stays, whether ids are null,
repeated or both; a row without words always stays.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import keep
from .shingles import PARITY_WORDS, set_rows, signature_rows


def least_matches(coordinates: int, similarity: float, missed: float = 1e-6) -> int:
    """The largest t such that a binomial (coordinates, similarity) variable is below t with a probability of at most ``missed``."""
    below, t = 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > missed:
            break
        t += 1
    return max(t, 1)


def _postings(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, rep, n, tokens): each node under the rare tokens of its prefix that another node has too."""
    listed = nodes.select("rep", F.explode("tokens").alias("token"))
    frequent = keep(listed.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1"), "frequent")
    shared = listed.join(frequent, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("own"))
    # Tokens that no other node has stand first in the order of rarity and take up places of the prefix.
    posted = F.slice("own", 1, F.greatest(F.lit(0), F.size("own") - F.lit(matches - 1)))
    return shared.where(F.size("own") >= matches).select("rep", F.explode(posted).alias("x")).select(F.col("x.token").alias("token"), "rep")


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, per_hundred: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree on enough coordinates and whose full sets are similar enough."""
    of = lambda x: nodes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("n_a", "n_b") >= per_hundred * F.greatest("n_a", "n_b"))
    same = F.aggregate(F.zip_with("tokens_a", "tokens_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = near.where(same >= matches).select("a", "b", "n_a", "n_b")
    full = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = near.join(full("a"), "a").join(full("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("common") >= per_hundred * (F.col("n_a") + F.col("n_b") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()


def _open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings, with labels, of the lists that still hold more than one component."""
    labelled = posts.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
    labelled = keep(labelled, "labelled")
    open_ = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    return labelled.join(keep(open_, "open-lists"), "token")


def _able(labelled: DataFrame, nodes: DataFrame, sets: DataFrame, per_hundred: int) -> DataFrame:
    """rep, n and shared, its shingles that another node of an open list has too, where that leaves room for a link at all.

    A pair has at most the smaller ``shared`` of its two nodes in common.
    """
    each = sets.join(labelled.select("rep").distinct(), "rep", "left_semi").select("rep", F.explode("shingles").alias("shingle"))
    several = keep(each.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle"), "several")
    shared = each.join(several, "shingle", "left_semi").groupBy("rep").agg(F.count("*").alias("shared"))
    words = [F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)]
    able = shared.join(nodes.select("rep", "n"), "rep").where(100 * F.col("shared") >= per_hundred * F.col("n"))
    return able.join(sets.select("rep", *words), "rep")


def _possible(per_hundred: int) -> Column:
    """Whether two nodes of the able (the other's columns end in _x) can be similar enough: two upper bounds of what they have in common."""
    both, common = F.col("n") + F.col("n_x"), F.least("shared", "shared_x")
    differ = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"p{k}_x"))) for k in range(PARITY_WORDS)), F.lit(0))
    return (100 * common >= per_hundred * (both - common)) & (100 * (both - differ) >= per_hundred * (both + differ))


def _classes(docs: DataFrame, words: int, per_hundred: int, coordinates: int, matches: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, member): rows (doc_id, member, n_shingles, key1, key2), nodes (rep, key1, key2 and their smallest member) and labels (node, component), which unlinked nodes don't have."""
    matches = matches or least_matches(coordinates, per_hundred / 100)
    rows = keep(docs.mapInArrow(signature_rows(words, coordinates), "doc_id long, member long, n_shingles long, key1 long, key2 long, tokens array<long>"), "signatures")
    nodes = rows.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min("member").alias("member"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    nodes = keep(nodes.where("member IS NOT NULL").withColumn("rep", F.col("key1")), "nodes")
    posts = keep(_postings(nodes, coordinates, matches), "postings")
    active = keep(posts.select("rep").distinct().join(nodes.select("rep", "n", "member", "key1", "key2", "tokens"), "rep"), "active")
    texts = docs.select("text", "member").join(active.select("member", "key1", "key2"), "member").select("text", "key1", "key2")
    # Rows of one member may hold several texts: each node takes that with its own keys, of equal ones any.
    sets = keep(texts.mapInArrow(set_rows(words), "rep long, shingles array<long>, parity array<long>").dropDuplicates(["rep"]), "sets")
    labelled, lists = posts.withColumn("label", F.col("rep")), keep(posts.groupBy("token").agg(F.min("rep").alias("x")), "pivots")
    edges = keep(_confirmed(_pairs(labelled.join(lists, "token").where(F.col("rep") != F.col("x"))), active, sets, matches, per_hundred), "links")
    labels = keep(components(edges), "labels")
    labelled = keep(_open(posts, labels), "open")
    if not labelled.isEmpty():
        able = keep(_able(labelled, active, sets, per_hundred), "able")
        posts = keep(labelled.drop("label").join(able, "rep"), "able-postings")
        for turn in ("central", "rest"):
            labelled = keep(_open(posts, labels), "open")
            if labelled.isEmpty():
                break
            x = [F.col(c).alias(f"{c}_x") for c in ("label", "n", "shared", *(f"p{k}" for k in range(PARITY_WORDS)))]
            if turn == "central":
                central = F.max_by(F.struct(F.col("rep").alias("x"), *x), F.struct(F.col("shared") / F.col("n"), -F.col("rep")))
                outside = keep(labelled.groupBy("token").agg(central.alias("c")).select("token", "c.*"), "outside")
            else:
                sizes = labelled.groupBy("token", "label").agg(F.count("*").alias("size"))
                main = keep(sizes.groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("main")), "main")
                outside = keep(labelled.join(main, "token").where(F.col("label") != F.col("main")).select("token", F.col("rep").alias("x"), *x), "outside")
            met = outside.join(labelled, "token").where((F.col("label") != F.col("label_x")) & _possible(per_hundred))
            edges = edges.union(keep(_confirmed(_pairs(met), active, sets, matches, per_hundred), "links"))
            labels = keep(components(edges), "labels")
    return rows.drop("tokens"), nodes.select("rep", "key1", "key2", "member"), labels


def near_duplicates(docs: DataFrame, words: int = 5, per_hundred: int = 80, coordinates: int = 32, matches: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Two documents link if 100 * common shingles >= per_hundred * all their shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, nodes, labels = _classes(docs.withColumn("member", F.col("doc_id")), words, per_hundred, coordinates, matches)
    least = keep(labels.join(nodes, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("member").alias("least")), "least-ids")
    labels = keep(labels.join(least, "component").select("node", "least"), "named")
    named = nodes.join(labels, F.col("rep") == F.col("node"), "left").select("key1", "key2", F.coalesce("least", "member").alias("component_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.join(named, ["key1", "key2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_distinct(docs: DataFrame, words: int = 5, per_hundred: int = 80, coordinates: int = 32, matches: int | None = None) -> DataFrame:
    """One row, that with the smallest doc_id (nulls last), of each group of near-duplicates among the rows of ``docs`` (doc_id, text and any others).

    Rows get numbers and are written first: ids may repeat, and rows that are read anew after a lost
    executor keep their numbers.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows, nodes, labels = _classes(numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row).alias("member")), words, per_hundred, coordinates, matches)
    # A component of one row needs no choice; only rows that are not chosen leave.
    named = nodes.join(labels, F.col("rep") == F.col("node"), "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"))
    linked = keep(rows.where("n_shingles > 0").join(named, ["key1", "key2"]).select("component", "doc_id", "member"), "members")
    chosen = keep(linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("member"))).alias("c"), F.count("*").alias("k")).where("k > 1").select("component", F.col("c.member").alias("chosen")), "chosen")
    gone = keep(linked.join(chosen, "component").where("member != chosen").select(F.col("member").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
