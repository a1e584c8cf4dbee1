"""Finding names in texts by their words, and names by a part of them; candidates meet by their rarest pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators.lineage import cut
from foliant.sources.store import small

#: A name links if so much of its words is there; a partial link's score is this part of the coverage.
COVERAGE, PARTIAL = 0.6, 0.8


def _spaced(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def linked_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name, words, score): names that a query (query, text) has as a phrase (1), or by 0.6 of their words (0.8 of that part).

    Names (name) have three characters at least and aren't numbers. For the partial match words of one character don't
    count, and a name needs two others. A name whose phrase is there has its rarest word there; one with a share t of
    its n words has one of its n - t n + 1 rarest there. So names are filed under these words only, by how many queries
    have them, and each candidate is tested once. Frequent words are filed only where a name has nothing rarer, and
    adaptive execution splits what such a word still brings together.
    """
    asked = queries.select("query", T.tokenize(F.col("text")).alias("asked"))
    heard = asked.select("query", F.explode_outer(F.array_distinct("asked")).alias("token")).where("token is not null")
    often = cut(heard.groupBy("token").agg(F.count("*").alias("n")))
    named = names.select("name", T.tokenize(F.col("name")).alias("words")).distinct().where((F.length("name") >= 3) & ~F.col("name").rlike("^[0-9]+$"))
    counted = named.withColumn("long", F.filter(F.array_distinct("words"), lambda w: F.length(w) >= 2))
    each = counted.select("name", "words", "long", F.explode_outer(F.array_distinct("words")).alias("token")).where("token is not null")
    rare = each.join(small(often), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("name").orderBy("n", "token")
    is_long = F.array_contains("long", F.col("token"))
    place, long_place = F.row_number().over(order), F.sum(is_long.cast("int")).over(order)
    enough = F.size("long") - F.ceil(COVERAGE * F.size("long") - 1e-9) + 1
    filed = rare.withColumns({"place": place, "long_place": long_place}).where((F.col("place") == 1) | (is_long & (F.size("long") >= 2) & (F.col("long_place") <= enough))).where("n > 0")
    pairs = heard.join(filed.select("token", "name", "words", "long"), "token").select("query", "name", "words", "long").distinct()
    met = pairs.join(asked, "query")
    covered = F.size(F.array_intersect("long", "asked")) / F.size("long")
    phrase = F.contains(_spaced(F.col("asked")), _spaced(F.col("words")))
    score = F.when(phrase, 1.0).when((F.size("long") >= 2) & (covered >= COVERAGE - 1e-9), PARTIAL * covered)
    return met.select("query", "name", "words", score.alias("score")).where("score is not null")


def most_specific(linked: DataFrame, most: int = 5) -> DataFrame:
    """(query, name, score, place): up to ``most`` names of each query, the surest and longest first, none inside one before it.

    Round by round the best name left is taken, and the names inside it go; no query's names are gathered.
    """
    left, taken = cut(linked), None
    for place in range(1, most + 1):
        best = left.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.length("name")).alias("l"), "name", "words")).alias("b"))
        best = cut(best.select("query", F.col("b.name").alias("name"), (-F.col("b.s")).alias("score"), F.lit(place).alias("place"), F.col("b.words").alias("outer")))
        taken = best if taken is None else taken.unionByName(best)
        if place < most:
            left = cut(left.join(small(best.select("query", "outer")), "query").where(~F.contains(_spaced(F.col("outer")), _spaced(F.col("words")))).drop("outer"))
    return taken.select("query", "name", "score", "place")


def linked_entities(queries: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(query, name, score, place): the most specific names that each query (query, text) has; scores have nine digits.

    Queries with the same texts have the same names, so each kind of query is linked once and its names are joined back.
    """
    asked = queries.where("text is not null").groupBy("query").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    kinds = cut(asked.select("texts").distinct().withColumn("kind", F.monotonically_increasing_id()))
    linked = linked_names(kinds.select(F.col("kind").alias("query"), F.explode("texts").alias("text")), names)
    found = most_specific(linked.withColumn("score", F.round("score", 9)), most).withColumnRenamed("query", "kind")
    return asked.join(small(cut(kinds.join(small(found), "kind"))), "texts").select("query", "name", "score", "place")


def _grams(x: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    at = F.sequence(F.lit(1), F.length(x) - n + 1)
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(x, i, n)))).otherwise(F.array().cast("array<string>"))


def substring_index(names: DataFrame, n: int = 3) -> DataFrame:
    """(gram, name, of): names (name) under all their substrings of 1 to n characters, and how many names each gram has."""
    low = F.lower("name")
    each = cut(names.select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(*(_grams(low, k) for k in range(1, n + 1))))).alias("gram")))
    return cut(each.join(each.groupBy("gram").agg(F.count("*").alias("of")), "gram"))


def names_holding(parts: DataFrame, index: DataFrame, n: int = 3) -> DataFrame:
    """(part, name): the names of an index that hold a part (part) as a substring, whatever the case.

    A part is looked up by its rarest gram, and a part with a gram that no name has is dropped; a part of up to n
    characters is a gram itself. The empty part is in every name and isn't looked up.
    """
    low = F.lower("part")
    own = F.when(F.length("part") <= n, F.array(low)).otherwise(_grams(low, n))
    each = parts.select("part").distinct().where("part != ''").select("part", F.explode(own).alias("gram"))
    sizes = index.select("gram", "of").distinct()
    known = each.join(sizes, "gram", "left").groupBy("part").agg(F.min(F.struct("of", "gram")).alias("r"), F.count_if(F.col("of").isNull()).alias("missing"))
    rare = cut(known.where("missing = 0").select("part", F.col("r.gram").alias("gram")))
    return small(rare).join(index.select("gram", "name"), "gram").where(F.contains(F.lower("name"), low)).select("part", "name")


def expand_by_substring(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(query, rel_id, src, dst, depth): the edges met around each start (query, part), each at the depth that it is met first.

    An expansion of a string takes the first ``most`` edges (by rel_id, then by their ends) with an end whose name holds it; the names at
    their ends, not yet expanded for the query, are the next strings. edges: src, dst (names), rel_id. Strings that
    several queries expand are expanded once.
    """
    index = substring_index(edges.select(F.explode(F.array("src", "dst")).alias("name")).where("name is not null"))
    edge = ["rel_id", "src", "dst"]
    ends = edges.select(*edge, F.explode(F.array_distinct(F.array("src", "dst"))).alias("name")).where("name is not null")
    front = cut(starts.select("query", F.lower("part").alias("part")).distinct())
    visited, found = front, None
    for step in range(1, depth + 1):
        wanted = front.select("part").distinct()
        touched = names_holding(wanted, index).join(ends, "name").select("part", *edge).distinct()
        first = touched.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*edge))).where(F.col("k") <= most)
        met = cut(front.join(first, "part").select("query", *edge).distinct().withColumn("depth", F.lit(step)))
        found = met if found is None else found.unionByName(met)
        if step < depth:
            ahead = met.select("query", F.explode(F.array(F.lower("src"), F.lower("dst"))).alias("part")).where("part is not null").distinct()
            front = cut(ahead.join(visited, ["query", "part"], "left_anti"))
            visited = cut(visited.unionByName(front))
    return found.groupBy("query", "rel_id", "src", "dst").agg(F.min("depth").alias("depth"))


def same_names(wanted: DataFrame, found: DataFrame, scope: str) -> DataFrame:
    """(scope, name, other): pairs of a scope's wanted and found names (scope, name) that ``same_entity`` calls one.

    One name holds the other as whole words, so they share the rarest word of the shorter: names meet by their words,
    with or without a qualifier, and each pair is tested once.
    """
    words = lambda c: F.array_distinct(F.split(T.squeeze(F.lower(c)), " "))
    left = wanted.select(scope, "name").distinct().select(scope, "name", F.explode(words(F.col("name"))).alias("word"))
    right = found.select(scope, F.col("name").alias("other")).distinct().select(scope, "other", F.explode(words(F.col("other"))).alias("word"))
    return left.join(right, [scope, "word"]).select(scope, "name", "other").distinct().where(T.same_entity(F.col("name"), F.col("other")))
