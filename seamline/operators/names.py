"""Finding people by id, name, or part of a name or alias, for any number of terms at once.

An inverted index holds the people of every gram (one to three characters) of a
lower-cased name or alias. A term is looked up by the gram of it that fewest people
have; candidates are then held against the whole term. So terms and names never
meet as a product: what is joined is the postings of each term's rarest gram.

A term matches by id first, else by whole name (case counts), else by a part of the
name or of an alias (case does not count). Equal terms are answered once. An empty or
null term matches nobody. A person listed twice, or by name and alias, is one hit;
null names and aliases match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, length: int) -> Column:
    """The distinct grams of a length; none of a shorter text."""
    many = F.length(text) - (length - 1)
    return F.when(many > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def labels(people: DataFrame) -> DataFrame:
    """(id, label): each lower-cased name and alias of a person once, from (id, name, aliases)."""
    every = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return people.select("id", every.alias("l")).where("l IS NOT NULL").select("id", F.lower("l").alias("label")).distinct()


def gram_index(people: DataFrame) -> DataFrame:
    """(gram, id, label): the inverted index; write it to look up more than once."""
    grams = F.concat(*[_grams(F.col("label"), n) for n in range(1, GRAM + 1)])
    return labels(people).select("id", "label", F.explode(grams).alias("gram")).select("gram", "id", "label")


def matches(terms: DataFrame, people: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(term, tier, id): who matches each term by id (1), name (2) or part (3), of the least tier that has anyone."""
    terms = terms.select("term").where(F.coalesce("term", F.lit("")) != "").distinct()
    by_id = terms.join(people.select(F.col("id").alias("term"), "id").distinct(), "term").select("term", F.lit(1).alias("tier"), "id")
    by_name = terms.join(people.select(F.col("name").alias("term"), "id").distinct(), "term").select("term", F.lit(2).alias("tier"), "id")
    index = gram_index(people) if index is None else index
    # a term's grams are all as long as it, or of three characters
    part = terms.withColumn("needle", F.lower("term"))
    length = F.least(F.length("needle"), F.lit(GRAM))
    grams = F.when(length == 1, _grams(F.col("needle"), 1)).when(length == 2, _grams(F.col("needle"), 2)).otherwise(_grams(F.col("needle"), GRAM))
    asked = part.select("term", "needle", F.explode(grams).alias("gram"))
    known = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that nobody has leaves its term without candidates
    rarest = asked.join(known, "gram", "left").groupBy("term", "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    partial = rarest.join(index, "gram").where(F.contains("label", "needle")).select("term", F.lit(3).alias("tier"), "id").distinct()
    found = by_id.unionByName(by_name).unionByName(partial)
    best = found.groupBy("term").agg(F.min("tier").alias("tier"))
    return found.join(best, ["term", "tier"])


def resolve(terms: DataFrame, people: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(term, tier, hits, first_id, status) of every distinct term: ``one`` person, ``none``, or ``ambiguous``, which ``matches`` lists."""
    got = matches(terms, people, index).groupBy("term").agg(F.min("tier").alias("tier"), F.count("*").alias("hits"), F.min("id").alias("first_id"))
    out = terms.select(F.coalesce("term", F.lit("")).alias("term")).distinct().join(got, "term", "left")
    hits = F.coalesce("hits", F.lit(0))
    return out.select("term", F.coalesce("tier", F.lit(0)).alias("tier"), hits.alias("hits"), "first_id", F.when(hits == 0, "none").when(hits == 1, "one").otherwise("ambiguous").alias("status"))
