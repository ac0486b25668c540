"""Finding objects by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _rank(name, key, wanted, alias=None):
    r = F.when((name == wanted) | (key == wanted), 0)
    if alias is not None:
        r = r.when(alias, 1)
    return r.when(name.startswith(wanted) | key.startswith(wanted), 2).otherwise(3)


def search(objects: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Ranked: equal, prefix, substring; then shorter names, then id."""
    wanted = F.lit(text.strip().lower())
    name, key = F.lower("name"), F.substring(F.col("id"), F.instr("id", ":") + 1, F.length("id"))
    hit = objects.where(F.contains(name, wanted) | F.contains(F.col("id"), wanted))
    return hit.withColumn("rank", _rank(name, key, wanted)).orderBy("rank", F.length("name"), "id").limit(limit)


def containing(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (name, wanted) where ``names(name)`` contains ``texts(wanted)``.

    A name must have a piece of the text: its rarest three letters, or the whole of a shorter one. So names are joined by their pieces of one to three
    letters instead of comparing every pair. Empty texts are in no pair.
    """
    wanted = texts.select("wanted").where("wanted <> ''").distinct()
    pieces = names.select("name").where("name IS NOT NULL").distinct().select("name", F.explode(_pieces("name", range(1, GRAM + 1))).alias("g"))
    freq = pieces.groupBy("g").agg(F.count("*").alias("f"))
    own = F.when(F.length("wanted") < GRAM, F.array("wanted")).otherwise(_pieces("wanted", [GRAM]))
    key = wanted.select("wanted", F.explode(own).alias("g")).join(freq, "g", "left").groupBy("wanted").agg(F.min_by("g", F.struct(F.coalesce("f", F.lit(0)), F.col("g"))).alias("g"))
    return key.join(pieces, "g").where(F.contains(F.col("name"), F.col("wanted"))).select("name", "wanted")


def _pieces(text: str, sizes):
    def cut_to(size: int):
        return F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substr(F.col(text), i, F.lit(size)))

    return F.array_distinct(F.flatten(F.array(*(F.when(F.length(text) >= k, cut_to(k)).otherwise(F.array().cast("array<string>")) for k in sizes))))


def resolve(refs: DataFrame, objects: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(ref, id, candidates) for every reference: the best object and how many objects share its tier; no id and 0 candidates where nothing fits.

    Tiers: the id or its key or the name, an alias from ``aliases(id, alias)``, a prefix, a substring.
    """
    r = refs.select("ref").distinct().withColumn("w", F.lower(F.trim("ref")))
    pairs = containing(objects.select(F.lower("name").alias("name")), r.select(F.col("w").alias("wanted")))
    hit = r.join(pairs.select(F.col("wanted").alias("w"), F.col("name").alias("n")), "w").select("ref", "w", "n")
    full = hit.join(objects.select("id", "name", F.lower("name").alias("n")), "n")
    ident = F.substring(F.col("id"), F.instr("id", ":") + 1, F.length("id"))
    full = full.withColumn("tier", _rank(F.col("n"), ident, F.col("w"))).select("ref", "tier", "id", "name")
    by_id = objects.select("id", "name", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower(ident)))).alias("w"))
    full = full.unionByName(r.join(by_id, "w").select("ref", F.lit(0).alias("tier"), "id", "name"))
    if aliases is not None:
        named = aliases.select("id", F.lower(F.trim("alias")).alias("w")).join(objects.select("id", "name"), "id")
        full = full.unionByName(r.join(named, "w").select("ref", F.lit(1).alias("tier"), "id", "name"))
    # an object counts once, in its best tier
    full = full.groupBy("ref", "id").agg(F.min("tier").alias("tier"), F.min("name").alias("name"))
    per_tier = full.groupBy("ref", "tier").agg(
        F.count("*").alias("candidates"), F.min_by("id", F.struct(F.length("name"), F.col("id"))).alias("id"))
    best = per_tier.groupBy("ref").agg(F.min_by(F.struct("id", "candidates"), "tier").alias("b")).select("ref", "b.*")
    return r.select("ref").join(best, "ref", "left").select("ref", "id", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def resolve_names(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Objects for names by exact name or alias, ignoring case."""
    return rows.withColumn("alias_lc", F.lower(F.trim(F.col(column)))).join(aliases, "alias_lc", "left")
