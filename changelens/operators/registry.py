"""The registry of indexes: similarity of file sets, orphans, keepers, twins, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import written

#: Similarity of file sets from which two indexes are one project.
SAME = 0.6
#: Characters of a SHA-256 in base 64.
DIGEST = 44


def similar_pairs(records: DataFrame, threshold: float = SAME, key: str = "name") -> DataFrame:
    """(a, b, similarity): pairs whose file sets have Jaccard similarity of the threshold or more, a before b.

    Exact prefix filtering: of each set only its rarest n - ceil(threshold n) + 1 members are joined, as two similar
    sets must share one of them, and pairs whose sizes or whose places of the shared member rule the threshold out are
    dropped at once.  Then candidates alone are compared in full.  Long members move as their SHA-256, which is longer than
    any member that moves as it is.
    """
    brief = lambda x: F.when(F.octet_length(x) >= DIGEST, F.base64(F.unhex(F.sha2(x, 256)))).otherwise(x)
    sets = records.select(key, F.array_distinct("fileset").alias("s")).where(F.size("s") > 0)
    sets = sets.select(key, F.transform("s", brief).alias("s"), F.size("s").alias("n"))
    members = sets.select(key, "n", F.explode("s").alias("m"))
    freq = members.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(key).orderBy("df", "m")
    need = F.ceil(F.col("n") * threshold - F.lit(1e-9))
    prefix = members.join(freq, "m").withColumn("at", F.row_number().over(order)).where((F.col("at") <= F.col("n") - need + 1) & (F.col("df") > 1))
    a = prefix.select("m", F.col(key).alias("a"), F.col("n").alias("na"), F.col("at").alias("i"))
    b = prefix.select("m", F.col(key).alias("b"), F.col("n").alias("nb"), F.col("at").alias("j"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    most = F.least("i", "j") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"))  # shared up to the member, and after it
    near = (small >= large * threshold - F.lit(1e-9)) & (most >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - F.lit(1e-9))
    cand = a.join(b, "m").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    left, right = sets.select(F.col(key).alias("a"), F.col("s").alias("sa")), sets.select(F.col(key).alias("b"), F.col("s").alias("sb"))
    both = cand.join(left, "a").join(right, "b")
    k = F.size(F.array_intersect("sa", "sb"))
    out = both.select("a", "b", (k / (F.size("sa") + F.size("sb") - k)).alias("similarity"))
    return out.where(F.col("similarity") >= threshold)


def same_project(records: DataFrame, threshold: float = SAME, key: str = "name") -> DataFrame:
    """(a, b), a before b: one remote, or similar file sets.

    Records of one remote are linked to its first record only: that is enough to group them.
    """
    remote = records.where("remote <> ''")
    first = remote.groupBy("remote").agg(F.min(key).alias("a"))
    by_remote = remote.join(first, "remote").where(F.col("a") < F.col(key)).select("a", F.col(key).alias("b"))
    return by_remote.union(similar_pairs(records, threshold, key).select("a", "b")).distinct()


def orphans(records: DataFrame) -> DataFrame:
    """``records`` with ``orphan``: the checkout is gone and nothing reaches the index."""
    gone = (F.coalesce("root", F.lit("")) != "") & ~F.col("root_exists") & ~F.col("reachable")
    return records.withColumn("orphan", gone)


def keepers(grouped: DataFrame, group: str = "group_id") -> DataFrame:
    """``grouped`` records with ``keep``: the best of each group.

    Reachable before not, existing root before gone, the latest, the largest; the first in order of name on a tie.
    """
    rooted = (F.coalesce("root", F.lit("")) != "") & F.col("root_exists")
    best = [F.desc("reachable"), F.desc(rooted), F.desc(F.coalesce("indexed_at", F.lit(""))), F.desc(F.coalesce("chunks", F.lit(0))), F.asc("name")]
    return grouped.withColumn("keep", F.row_number().over(Window.partitionBy(group).orderBy(*best)) == 1)


def leaders(records: DataFrame, threshold: float = SAME) -> DataFrame:
    """``records`` with ``group_id``, the name of the first record of their group.

    In order of name, a record joins the first group whose first record is the same project, else it starts one.  So the
    first records are the lexicographically first independent set of the links, which is decided in rounds: a record with
    a first record among its smaller neighbours is none; one whose smaller neighbours are all decided, and none of them a
    first record, is one.

    Records of one remote, or of equal file sets, are not linked pair by pair: at most one of them is a first record, and
    a round asks of the others only for the least name that is not ruled out.  So file sets are compared once for each
    different one.  Each round reads and writes tables and decides the least undecided record of each connected part; as
    names are digests, rounds grow with the logarithm of the number of records.  An empty remote is none.  Names are taken
    to be unique.
    """
    files = F.array_sort(F.array_distinct("fileset"))
    content = F.when(F.size("fileset") > 0, F.sha2(F.array_join(files, "\x00"), 256))
    own = records.select("name", F.when(F.col("remote") != "", F.col("remote")).alias("remote"), content.alias("set"), "fileset")
    sets = own.where("set is not null").groupBy("set").agg(F.first("fileset").alias("fileset"))
    pairs = similar_pairs(sets, threshold, "set").select("a", "b")
    links = written(pairs.union(pairs.select("b", "a")))
    state = written(own.select("name", "remote", "set", F.lit("?").alias("state")))

    def around(state: DataFrame) -> DataFrame:
        """``state`` with the least first record, and the least not ruled out, among a record's neighbours and itself."""
        left = state.where("state <> 'member'")
        mins = [F.min("name").alias("least"), F.min(F.when(F.col("state") == "first", F.col("name"))).alias("lead")]
        of_set = left.where("set is not null").groupBy("set").agg(*mins)
        near = links.join(of_set, links["a"] == of_set["set"]).groupBy(F.col("b").alias("set")).agg(F.min("least").alias("least"), F.min("lead").alias("lead"))
        of_set = of_set.unionByName(near).groupBy("set").agg(F.min("least").alias("set_least"), F.min("lead").alias("set_lead"))
        of_remote = left.where("remote is not null").groupBy("remote").agg(*mins)
        both = state.join(of_set, "set", "left").join(of_remote, "remote", "left")
        return both.select("name", "remote", "set", "state", F.least("set_least", "least").alias("least"), F.least("set_lead", "lead").alias("lead"))

    smaller = lambda c: F.coalesce(F.col(c) < F.col("name"), F.lit(False))
    while not state.where("state = '?'").isEmpty():
        new = F.when(F.col("state") != "?", F.col("state")).when(smaller("lead"), "member").when(~smaller("least"), "first").otherwise("?")
        state = written(around(state).select("name", "remote", "set", new.alias("state")))
    group = around(state).select("name", F.when(F.col("state") == "first", F.col("name")).otherwise(F.col("lead")).alias("group_id"))
    return records.join(group, "name")


def prune(records: DataFrame, threshold: float = SAME) -> DataFrame:
    """``records`` with ``reason``: why each is prunable, or null where it stays."""
    rows = orphans(records)
    grouped = keepers(leaders(rows.where("not orphan"), threshold))
    winner = grouped.where("keep").select("group_id", F.col("name").alias("winner"))
    kept = grouped.join(winner, "group_id").withColumn("reason", F.when(~F.col("keep"), F.concat(F.lit("duplicate of "), F.substring("winner", 1, 8))))
    gone = rows.where("orphan").withColumn("reason", F.lit("orphan: checkout gone"))
    return kept.select(*records.columns, "reason").unionByName(gone.select(*records.columns, "reason"))


def reclaimed(pruned: DataFrame) -> DataFrame:
    return pruned.agg(F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("size_bytes"))), F.lit(0)).alias("reclaimed_bytes"), F.count("reason").alias("prunable"))


def dead_twins(records: DataFrame, name: str, remote: str | None, fileset: DataFrame | list[str], threshold: float = SAME, sets: DataFrame | None = None) -> DataFrame:
    """Records other than ``name`` that are its project and no longer reachable.

    ``fileset`` (path) are its files; ``sets`` (name, path) those of the others, else ``records`` have them.  Files meet by
    an equi-join on the path, and only for records whose number of files leaves the threshold open.
    """
    spark = records.sparkSession
    mine = fileset if isinstance(fileset, DataFrame) else spark.createDataFrame([(p,) for p in fileset], "path string")
    mine = mine.select("path").distinct()
    dead = records.where((F.col("name") != name) & ~(F.col("root_exists") & F.col("reachable")))
    sets = dead.select("name", F.explode("fileset").alias("path")) if sets is None else sets.join(dead.select("name"), "name", "left_semi")
    sets = sets.select("name", "path").distinct()
    sizes = sets.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    size = mine.agg(F.count(F.lit(1)).alias("m"))
    near = sizes.join(F.broadcast(size)).where((F.least("n", "m") >= F.greatest("n", "m") * threshold) & (F.col("m") > 0))  # one row of size
    shared = sets.join(mine, "path").join(near.select("name"), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    like = near.join(shared, "name").where(F.col("k") / (F.col("n") + F.col("m") - F.col("k")) >= threshold).select("name", F.lit(True).alias("like"))
    same = F.coalesce("like", F.lit(False)) | (F.coalesce(F.col("remote"), F.lit("")) == (remote or "\x00"))
    return dead.join(like, "name", "left").where(same).drop("like")


def with_keys(roots: DataFrame) -> DataFrame:
    """``roots`` (root, remote_url) with the index's name and the normal form of the remote."""
    return roots.withColumns({"name": T.index_key(F.col("root")), "remote": T.normal_remote(F.col("remote_url"))})
