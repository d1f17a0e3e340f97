"""Groups of rows that arrive in order and share names, with the order in which a group's rows came together.

Rows arrive one after another. Each joins the first group that has one of its names; further groups that have one are taken in by that group, with all that they hold, and then the
row itself. So the groups are connected components, but what a group says first depends on the order in which its parts came together. That order is
a tree: a row hangs below the row that founded its group, and the founder of a group that was taken in hangs below the founder of the group that took it, from
that time on. The rows of a group, read down the tree with children in order of time, stand as they came together, and a row's place is the list of ``(time, row)`` on its way from
the root; lists compare as the rows stand. With it names, votes and evidence are grouped aggregates, and no group is ever held in one task.

Everything is joins and grouped minima: names that come again are linked with their first row, links within a tree of first rows vanish, and only what links two trees can take a group in. Rows of which no name
comes again are left out of all that and told as ``alone``. Of the merges
there are few in a story; up to ``SMALL_MERGES`` different ones, counted first, are put in order on the driver, more are contracted by rounds until no more are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.session import written

#: Merges up to this number are put in order on the driver.
SMALL_MERGES = 20_000


def roots(up: DataFrame) -> DataFrame:
    """``(story, row, up)`` with ``up`` the end of each row's way; a founder is its own ``up``. Ways double in length each round."""
    up = written(up)
    while True:
        further = up.where("up <> row").select(F.col("story").alias("s"), F.col("row").alias("r"), F.col("up").alias("next"))
        moved = written(up.join(further, (F.col("story") == F.col("s")) & (F.col("up") == F.col("r")), "left"))
        if moved.where("next is not null").isEmpty():
            return up
        up = moved.select("story", "row", F.coalesce("next", "up").alias("up"))


def _taken_on_driver(merges: DataFrame) -> DataFrame:
    """Each founder that is taken in, by whom and when: merges in order of time, the earlier founder stays."""
    home: dict = {}

    def root(x):
        while home.setdefault(x, x) != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    out = []
    for r in sorted(merges.collect(), key=lambda r: (r["story"], r["time"], r["lo"], r["hi"])):
        a, b = sorted((root((r["story"], r["lo"])), root((r["story"], r["hi"]))))
        if a != b:
            home[b] = a
            out.append((r["story"], b[1], a[1], r["time"]))
    return merges.sparkSession.createDataFrame(out, "story string, row long, up long, time long")


def _taken_by_rounds(merges: DataFrame, small: int) -> DataFrame:
    """The same: in a round every founder whose first merge is with an earlier one is taken in, and its further merges are that one's.

    ``up`` is a founder of the group at that time, not yet the first one.
    """
    out: list[DataFrame] = []
    while merges.count() > small:
        both = merges.select("story", F.col("hi").alias("row"), F.col("lo").alias("other"), "time").union(merges.select("story", F.col("lo").alias("row"), F.col("hi").alias("other"), "time"))
        first = both.groupBy("story", "row").agg(F.min(F.struct("time", "other")).alias("m")).where("m.other < row")
        gone = written(first.select("story", "row", F.col("m.other").alias("up"), F.col("m.time").alias("time")))
        out.append(gone)
        homes = gone.select("story", "row", "up").union(gone.join(gone.select("story", F.col("row").alias("up")), ["story", "up"], "left_anti").select("story", F.col("up").alias("row"), "up").distinct())
        homes = roots(homes)
        merges = written(_between(merges, homes))
    rest = _taken_on_driver(merges)
    for gone in out:
        rest = rest.union(gone)
    return written(rest)


def _between(links: DataFrame, homes: DataFrame) -> DataFrame:
    """The first time at which two homes are linked, by ``links(story, lo, hi, time)``; rows that have no home are their own."""
    for end in ("lo", "hi"):
        known = homes.select(F.col("story").alias("s"), F.col("row").alias("r"), F.col("up").alias("home"))
        links = links.join(known, (F.col("story") == F.col("s")) & (F.col(end) == F.col("r")), "left").withColumn(end, F.coalesce("home", end)).drop("s", "r", "home")
    return links.where("lo <> hi").groupBy("story", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.min("time").alias("time"))


def _climbed(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows(story, row, up, time)`` with ``up`` the founder of the group at that time: up the tree while what was taken in was so by then."""
    jumps = [taken]
    while True:  # 2, 4, 8 ... steps at a time, the latest time of them
        j = jumps[-1]
        ahead = j.select(F.col("story").alias("s"), F.col("row").alias("r"), F.col("up").alias("next"), F.col("time").alias("then"))
        longer = written(j.join(ahead, (F.col("story") == F.col("s")) & (F.col("up") == F.col("r"))).select("story", "row", F.col("next").alias("up"), F.greatest("time", "then").alias("time")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    for j in reversed(jumps):
        ahead = j.select(F.col("story").alias("s"), F.col("row").alias("r"), F.col("up").alias("next"), F.col("time").alias("then"))
        met = rows.join(ahead, (F.col("story") == F.col("s")) & (F.col("up") == F.col("r")) & (F.col("then") <= F.col("time")), "left")
        rows = met.withColumn("up", F.coalesce("next", "up")).drop("s", "r", "next", "then")
    return rows


def _ways(taken: DataFrame) -> DataFrame:
    """``(story, row, root, way)`` of each founder that was taken in: its group's first row in the end, and the list of ``(time, row)`` down to it."""
    ways = taken.select("story", "row", F.col("up").alias("root"), F.array(F.struct("time", "row")).alias("way"))
    while True:
        ahead = ways.select(F.col("story").alias("s"), F.col("row").alias("r"), F.col("root").alias("next"), F.col("way").alias("above"))
        met = written(ways.join(ahead, (F.col("story") == F.col("s")) & (F.col("root") == F.col("r")), "left"))
        if met.where("next is not null").isEmpty():
            return ways
        ways = met.select("story", "row", F.coalesce("next", "root").alias("root"), F.when(F.col("next").isNotNull(), F.concat("above", "way")).otherwise(F.col("way")).alias("way"))


def merge_order(rows: DataFrame, story: Column, row: Column, names: Column, small: int = SMALL_MERGES) -> DataFrame:
    """Adds ``first_row``, ``place`` and ``alone`` to ``rows``: the row that founded the group in the end, where the row stands in the order in which the group came together, and whether it shares no name and is a group of its own.

    ``row`` is a whole number that tells the order of arrival and is a row's own within its ``story``; rows without story or number are left out. ``names`` is an array of strings, nulls and repeats count for nothing. A row without names is
    alone. ``rows`` is read twice: pass a table that is written or cheap to make. Up to ``small`` merges are put in order on the driver. A place is as long as the number of times that the groups of the row were taken in.
    """
    keyed = rows.withColumns({"_story": story.cast("string"), "_row": row.cast("long")}).where("_story is not null and _row is not null")
    named = keyed.select(F.col("_story").alias("story"), F.col("_row").alias("row"), F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull()))).alias("name"))
    first = named.groupBy("story", "name").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.xxhash64("story", "name").alias("h"), F.col("story").alias("s"), F.col("name").alias("of"), "first")
    # on a hash beside the names: both sides are dealt out anew, and AQE can split a frequent name
    met = written(named.join(first, (F.xxhash64("story", "name") == F.col("h")) & (F.col("story") == F.col("s")) & (F.col("name") == F.col("of"))).select("story", "row", "first").distinct())
    links = met.where("first < row")
    homes = roots(met.groupBy("story", "row").agg(F.min("first").alias("up")))
    merges = written(_between(links.select("story", F.col("first").alias("lo"), F.col("row").alias("hi"), F.col("row").alias("time")), homes))
    n = merges.count()
    none = F.expr("cast(array() as array<struct<time:bigint,row:bigint>>)")
    own_step = lambda time: F.array(F.struct(time.alias("time"), F.col("row").alias("row")))
    if not n:
        placed = homes.select("story", "row", F.col("up").alias("first_row"), F.when(F.col("up") == F.col("row"), none).otherwise(own_step(F.col("row"))).alias("place"))
    else:
        taken = _taken_on_driver(merges) if n <= small else _taken_by_rounds(merges, small)
        taken = written(taken)
        if n > small:  # what took them in may have been taken in before
            taken = written(_climbed(taken.select("story", "row", "up", "time"), taken))
        ways = _ways(taken)
        joined = homes.where("up <> row").select("story", "row", "up", F.col("row").alias("time"))
        children = _climbed(joined, taken).join(ways.select(F.col("story").alias("s"), F.col("row").alias("r"), "root", "way"), (F.col("story") == F.col("s")) & (F.col("up") == F.col("r")), "left")
        children = children.select("story", "row", F.coalesce("root", "up").alias("first_row"), F.concat(F.coalesce("way", none), own_step(F.col("time"))).alias("place"))
        founders = homes.where("up = row").select("story", "row").join(ways, ["story", "row"], "left").select("story", "row", F.coalesce("root", "row").alias("first_row"), F.coalesce("way", none).alias("place"))
        placed = children.unionByName(founders)
    placed = placed.select(F.col("story").alias("_s"), F.col("row").alias("_r"), "first_row", "place")
    told = keyed.join(placed, (F.col("_story") == F.col("_s")) & (F.col("_row") == F.col("_r")), "left").withColumn("alone", F.col("_r").isNull())
    return told.withColumns({"first_row": F.coalesce("first_row", "_row"), "place": F.coalesce("place", none)}).drop("_story", "_row", "_s", "_r")


def ordered_distinct(rows: DataFrame, keys: list[str], order: list[Column], values: Column, out: str, most: int | None = None) -> DataFrame:
    """``(keys, out)``: the different elements of a group's arrays in order of their first occurrence, the first ``most`` of them.

    Repeats are dropped before the shuffle, and what is gathered for a group is its different values, or ``most`` of them; groups without any are left out.
    """
    each = rows.select(*keys, *(o.alias(f"_o{i}") for i, o in enumerate(order)), F.posexplode(values).alias("_at", "_value"))
    at = F.struct(*(F.col(f"_o{i}") for i in range(len(order))), "_at")
    firsts = each.groupBy(*keys, "_value").agg(F.min(at).alias("_first"))
    if most is not None:
        firsts = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).where(F.col("_n") <= most)
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_value"))), lambda s: s["_value"]).alias(out))


def most_voted(rows: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    """``(keys, value)``: the value that most rows of a group have; of equals the one whose first row stands first."""
    votes = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    return votes.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_first")).alias(value))
