"""Search for a table of terms or questions at once, by an inverted index of the characters of names and ids.

A node stands under every distinct run of two and three characters of its name and id, and under the first four characters of its
name and short name. A term that is part of a name stands under all its runs, so it is looked up under its rarest one alone; a
shared prefix has four characters at least, so it is looked up under these. What is found is verified with the same score as
one question's search, so nothing is lost and nothing is added. A term whose rarest run is common costs as much as the nodes that have it.

Terms have two characters or more, as ``text.terms`` gives them; null and shorter terms match nothing. Nodes without a name go by their id. Repeated
terms count once, repeated nodes each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork import fixed_values as V
from knotwork.functions.text import favoured, short_name, term_score
from knotwork.operators.traverse import BROADCAST_ROWS
from knotwork.runtime import cut

PREFIX = 4


def runs(text: Column, n: int) -> Column:
    """Every run of ``n`` characters; the range starts at 0, so short texts have none."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.substr(text, i + 1, F.lit(n))), lambda r: F.length(r) == n)


def head(text: Column) -> Column:
    """The key of the first characters: longer than any run, so they never meet."""
    return F.when(F.length(text) >= PREFIX, F.concat(F.lit("^"), F.left(text, F.lit(PREFIX))))


def postings(nodes: DataFrame) -> DataFrame:
    """The index: (key, id, type, low, short, low_id), each key of a node once."""
    low = F.lower(F.coalesce("name", "id"))
    x = nodes.select("id", "type", low.alias("low"), short_name(low).alias("short"), F.lower("id").alias("low_id"))
    name, node_id = F.col("low"), F.col("low_id")
    keys = F.concat(runs(name, 2), runs(name, 3), runs(node_id, 2), runs(node_id, 3), F.array_compact(F.array(head(name), head(F.col("short")))))
    return x.select(F.explode(F.array_distinct(keys)).alias("key"), "id", "type", "low", "short", "low_id")


def lookups(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term, inside): the rarest run of each term (``inside``) and its first characters; none where no node has them all."""
    t = terms.select("term").where(F.length("term") >= 2).distinct()
    term = F.col("term")
    part = lambda key, inside: F.struct(key.alias("key"), F.lit(inside).alias("inside"))
    inner = F.transform(F.array_distinct(F.when(F.length(term) >= 3, runs(term, 3)).otherwise(runs(term, 2))), lambda r: part(r, True))
    mine = cut(t.select("term", F.explode(F.concat(inner, F.array(part(head(term), False)))).alias("p")).select("term", "p.key", "p.inside").where("key IS NOT NULL"))
    # the keys of all nodes are counted before they meet those of the terms, so one row for each key and task is shuffled
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).join(mine.select("key").distinct(), "key", "left_semi")
    return mine.join(sizes, "key", "left").groupBy("term", "inside").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("b")).where("b.n > 0").select("b.key", "term", "inside")


def term_scores(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, type, points) of every node that a term of ``terms`` (term) matches, each pair once."""
    return _scores(postings(nodes), *_looked_up(postings(nodes), terms))


def _looked_up(index: DataFrame, terms: DataFrame) -> tuple[DataFrame, bool]:
    """The lookups, evaluated, and whether they are few enough to be broadcast."""
    look = cut(lookups(index, terms))
    return look, look.count() <= BROADCAST_ROWS


def _scores(index: DataFrame, look: DataFrame, few: bool) -> DataFrame:
    if few:
        look = F.broadcast(look)
    else:
        # keys are runs of three characters and heads of four: what no term looks up is not shuffled
        index = index.join(look.select("key").distinct(), "key", "left_semi")
    term = F.col("term")
    inside = F.contains("low", term) | F.contains("low_id", term)
    # what holds the term is kept under its run alone and the rest under the prefix alone, so no pair comes twice
    x = index.join(look, "key").where(F.col("inside") == inside)
    return x.select("term", "id", "type", term_score(term, F.col("low"), F.col("short"), F.col("low_id")).alias("points")).where("points > 0")


def question_seeds(nodes: DataFrame, questions: DataFrame, keys: list[str], k: int = V.SEEDS) -> DataFrame:
    """(keys, rank, id, score): the k best nodes of each question of ``questions`` (keys, term), ties by id.

    Nodes with the same points for every term tie in every question: a profile. Only the k smallest ids of a profile can be
    seeds, and only the k best profiles of a question, by score, then smallest id, since each one before them has a node before all of theirs. A
    profile goes by sums of three 40-bit hashes, so a node is one row of a few numbers however many terms it matches.
    """
    asked = questions.select(*keys, "term").distinct()
    index = postings(nodes)
    look, few = _looked_up(index, asked)
    favour = favoured(F.col("type"))
    # sums count pairs of repeated nodes each time, and have room for 2^23 of them
    mark = lambda seed: F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "term", "points"), 24)).alias(f"p{seed}")
    profiles = _scores(index, look, few).groupBy("id").agg(*map(mark, range(3)), F.max(favour).alias("favour"))
    by = Window.partitionBy("p0", "p1", "p2", "favour").orderBy("id")
    members = cut(profiles.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).withColumn("first", F.min("id").over(by)).select("first", "id", "favour"))
    ones = members.where("first = id").select("id", "favour")
    ones = F.broadcast(ones) if ones.count() <= BROADCAST_ROWS else ones
    points = cut(_scores(postings(nodes.join(ones, "id", "left_semi")), look, few).join(ones, "id").select(F.col("id").alias("first"), "term", "points", "favour"))
    points = F.broadcast(points) if points.count() <= BROADCAST_ROWS else points
    score = (F.sum("points") + F.max("favour")).cast("long").alias("score")
    best = lambda *by: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *by)).cast("long")
    x = asked.join(points, "term").groupBy(*keys, "first").agg(score)
    x = x.withColumn("rank", best("first")).where(F.col("rank") <= k).drop("rank")
    x = x.join(members.select("first", "id"), "first").withColumn("rank", best("id")).where(F.col("rank") <= k)
    return x.select(*keys, "rank", "id", "score")
