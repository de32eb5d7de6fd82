"""Text search over hotspots by posting lists of letter groups.

The index holds, for every group of one to three characters of a name or
jurisdiction in lower case, the ids of the hotspots that have it, in blocks of
bounded length. A query reads the lists of its own groups only, intersects them
block by block and compares the few hotspots that are left with the whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.explore import matches_query

LONGEST = 3         # characters of a group
BLOCK = 10_000      # ids that one list may hold; equal blocks of different groups cover the same ids
FIELDS = ("name", "jurisdiction")


def _groups(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters; none in a shorter text."""
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def build_index(hotspots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(field, letters, block, ids) of ``hotspots`` (id, name, jurisdiction). Null texts are in no list."""
    texts = hotspots.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in FIELDS])).alias("t"))
    texts = texts.select("id", "t.*").where(F.col("text").isNotNull())
    letters = F.array_distinct(F.concat(*[_groups(F.col("text"), n) for n in range(1, LONGEST + 1)]))
    rows = texts.select("field", "id", F.explode(letters).alias("letters"))
    return rows.groupBy("field", "letters", F.expr(f"id div {block}").alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def query_groups(query: str) -> list[str]:
    """The groups every match of a query holds."""
    text = query.lower()
    n = min(LONGEST, len(text))
    return sorted({text[i:i + n] for i in range(len(text) - n + 1)}) if n else []


def candidates(index: DataFrame, query: str) -> DataFrame:
    """(id): hotspots one of whose texts holds all groups of a query that is not blank."""
    wanted = query_groups(query)
    lists = index.where(F.col("letters").isin(wanted)).groupBy("field", "block").agg(F.collect_list("ids").alias("lists"))
    met = lists.where(F.size("lists") == len(wanted))
    common = F.aggregate(F.slice("lists", 2, max(1, len(wanted))), F.get("lists", F.lit(0)), lambda found, ids: F.array_intersect(found, ids))
    return met.select(F.explode(common).alias("id")).distinct()


def search(index: DataFrame, hotspots: DataFrame, query: str) -> DataFrame:
    """The rows ``filter_hotspots`` gives for a text: name or jurisdiction contains the query; a blank one keeps all.

    The untrimmed query is what is matched, as in the scan.
    """
    if not query.strip():
        return hotspots
    return hotspots.join(candidates(index, query), "id", "left_semi").where(matches_query(query))
