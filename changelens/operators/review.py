"""Reviews: manifest, threads, status, verification of comments against changes, comment drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import written
from .prefix import running

WINDOW_LINES, PREVIEW, KEY_CHARS, MAX_COMMENTS = 40, 150, 200, 25
#: Changed lines from which ranges of them make a block of the manifest; files of a block below.
LARGE, RUN = 4096, 1 << 16
#: Characters at the end of a path that are joined on.
SUFFIX = 6


def manifest_stats(files: DataFrame) -> DataFrame:
    """Per review: counts of measured files and lines."""
    ok = F.col("reviewable")
    total = lambda c, when=None: F.sum(F.col(c) if when is None else F.when(when, F.col(c)).otherwise(0))
    return files.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("reviewable_files"),
        F.count_if(~ok).alias("skipped_files"),
        total("additions").alias("total_additions"),
        total("deletions").alias("total_deletions"),
        total("additions", ok).alias("reviewable_additions"),
        total("deletions", ok).alias("reviewable_deletions"),
    )


def manifest_order(files: DataFrame) -> DataFrame:
    """Measured files with their place in the manifest: reviewable first, most changed lines first, then as given.

    Blocks are numbers of changed lines, ranges of them from LARGE on; below, where very many files may agree, also runs
    of RUN files.
    """
    noise, changed = (~F.col("reviewable")).cast("int"), F.col("additions") + F.col("deletions")
    size = F.when(changed < LARGE, changed).otherwise(LARGE + F.floor(F.log2(changed / LARGE) * 16)).cast("int")
    block = F.struct(noise.alias("noise"), (-size).alias("size"), F.when(changed < LARGE, F.floor(F.col("file_ord") / RUN)).otherwise(F.lit(0).cast("long")).alias("run"))
    out = running(files, "review_id", block, [noise, F.desc(changed), "file_ord"], {"place": F.lit(1)})
    return out.withColumn("place", F.col("place").cast("int"))


def reply_threads(comments: DataFrame) -> DataFrame:
    """Review comments with the root of their thread, from (review_id, ord, id, in_reply_to_id).

    In order of arrival, a comment joins the thread it replies to if that is the root of one already, else it is a root
    itself.  So along a chain of replies to earlier comments the rule alternates: a comment at an even number of steps from
    the chain's end is a root, one at an odd number joins its parent.  Steps are counted by pointer jumping: in each round
    a comment looks as far again as it has looked, so rounds grow with the logarithm of the longest chain, and a review of
    any size is spread by its comments.

    Comments are in order of ord, then id.  Of rows with one id the first counts for those that reply to it; the others are
    judged by their own parent.  A null id is its own root and has no replies.
    """
    own = comments.select("review_id", "ord", "id", "in_reply_to_id")
    first = own.where("id is not null").groupBy("review_id", "id").agg(F.min_by(F.struct("ord", "in_reply_to_id"), "ord").alias("f"))
    known = first.select("review_id", "id", F.col("f.ord").alias("ord"), F.col("f.in_reply_to_id").alias("reply"))
    parent = known.select("review_id", F.col("id").alias("reply"), F.col("ord").alias("parent_ord"))
    earlier = F.col("parent_ord").isNotNull() & (F.struct("parent_ord", "reply") < F.struct("ord", "id"))
    up = F.when(earlier, F.col("reply"))
    steps = written(known.join(parent, ["review_id", "reply"], "left").select("review_id", "id", up.alias("up"), up.isNotNull().alias("odd")))
    while not steps.where("up is not null").isEmpty():
        far = steps.select("review_id", F.col("id").alias("up"), F.col("up").alias("far"), F.col("odd").alias("more")).where("more or far is not null")
        both = steps.join(far, ["review_id", "up"], "left")
        steps = written(both.select("review_id", "id", F.col("far").alias("up"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd")))
    roots = steps.where("not odd").select("review_id", F.col("id").alias("in_reply_to_id"), F.lit(True).alias("is_root"))
    at = parent.withColumnRenamed("reply", "in_reply_to_id").join(roots, ["review_id", "in_reply_to_id"])
    joined = own.join(at, ["review_id", "in_reply_to_id"], "left")
    joins = F.coalesce(F.struct("parent_ord", "in_reply_to_id") < F.struct("ord", "id"), F.lit(False)) & F.col("is_root").isNotNull()
    return joined.select("review_id", "id", F.when(joins, F.col("in_reply_to_id")).otherwise(F.col("id")).alias("root"))


def split_threads(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, general comments) of raw discussion notes.

    ``notes``: review_id, disc_ord, id, note_ord, author, body, created_at, system, resolvable, resolved, new_path,
    old_path, new_line, old_line.  Discussions of system notes only go; those whose first other note is not
    resolvable are general; a thread keeps system notes only where a line it is about has changed.
    """
    row = F.struct("note_ord", *[c for c in ("author", "body", "created_at", "system", "resolvable", "resolved", "new_path", "old_path", "new_line", "old_line")])
    per = notes.groupBy("review_id", "disc_ord", "id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    people = F.filter("all", lambda n: ~n["system"])
    per = per.withColumn("people", people).where(F.size("people") > 0).withColumn("first", F.element_at("people", 1))
    bare = lambda n: F.struct(n["author"].alias("author"), n["body"].alias("body"), n["created_at"].alias("created_at"), n["system"].alias("system"))
    general = per.where(~F.col("first.resolvable")).select("review_id", "disc_ord", F.posexplode("people").alias("note_ord", "n"))
    general = general.select("review_id", "disc_ord", "note_ord", "n.author", "n.body", "n.created_at")
    kept = F.filter("all", lambda n: ~n["system"] | n["body"].contains("changed this line"))
    filled = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b))
    line = F.coalesce(F.when(F.col("first.new_line") != 0, F.col("first.new_line")), "first.old_line")
    threads = per.where("first.resolvable").select(
        "review_id", "disc_ord", "id", F.col("first.resolved").alias("resolved"), filled("first.new_path", "first.old_path").alias("file_path"), line.alias("line"), F.transform(kept, bare).alias("notes")
    )
    return threads, general


def status(threads: DataFrame) -> DataFrame:
    """Per review: counts of discussions and previews of the unresolved, from threads with their notes in order."""
    preview = F.coalesce(F.substring(F.try_element_at("notes", F.lit(1))["body"], 1, PREVIEW), F.lit(""))
    row = F.struct("disc_ord", "id", "file_path", preview.alias("first_comment_preview"))
    open_ = F.array_sort(F.collect_list(F.when(~F.col("resolved"), row)))
    return threads.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("total_discussions"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), open_.alias("unresolved_details")
    )


def distinct_threads(threads: DataFrame) -> DataFrame:
    """Threads that say something, once per file, line and start of the first comment; with first comment and replies.

    The first of equals in order stays; threads without a place take part too.
    """
    people = F.filter("notes", lambda n: ~n["system"])
    rows = threads.withColumn("people", people).where(F.size("people") > 0)
    rows = rows.withColumns({"first_comment": F.element_at("people", 1), "replies": F.slice("people", 2, 1_000_000_000)})
    key = Window.partitionBy("review_id", "file_path", "line", F.substring("first_comment.body", 1, KEY_CHARS)).orderBy("disc_ord")
    rows = rows.withColumn("n", F.row_number().over(key)).where("n = 1")
    located = F.col("line").isNotNull() & (F.coalesce("file_path", F.lit("")) != "")
    return rows.withColumn("located", located).drop("n", "people", "notes")


def match_paths(threads: DataFrame, files: DataFrame) -> DataFrame:
    """The file of the diff that each located thread is about: the same path, else the first that ends as it or that it ends as.

    Files with an empty patch do not count, nor those whose path contains no thread's path.  Where one path ends as
    another, their last SUFFIX characters agree, or the shorter one is that suffix; both are keys of equi-joins, so a
    review of very many files and threads is spread by its paths.  Where one path holds another, one run of SUFFIX
    characters of the latter, the one of least hash, is in both, or the whole of it.
    """
    paths = threads.where("located").select("review_id", F.col("file_path").alias("thread_path")).distinct()
    own = files.where("patch <> ''").select("review_id", "file_ord", "file_path")
    both = written(_ending_alike(paths, own))  # few, and read three times
    sure = both.where(F.endswith("file_path", "thread_path"))  # such a file contains a thread's path
    rest = both.where(~F.endswith("file_path", "thread_path"))
    both = sure.unionByName(rest.join(_containing(rest.select(own.columns).distinct(), paths), ["review_id", "file_ord"], "left_semi").select(sure.columns))
    exact = F.col("file_path") == F.col("thread_path")
    return both.groupBy("review_id", "thread_path").agg(F.min_by(F.struct("file_ord", "file_path"), F.struct(~exact, "file_ord")).alias("f")).select("review_id", "thread_path", "f.file_ord", "f.file_path")


def _ending_alike(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs (review_id, thread_path, file_ord, file_path) of which one path ends as the other.

    Two long paths meet under their last SUFFIX characters, a short one as a whole under an end of the other.
    """

    def keys(c: str, whole: str, ends: str):
        own = F.col(c)
        long_ = F.when(F.length(c) >= SUFFIX, F.array(F.concat(F.lit("long"), F.expr(f"right({c}, {SUFFIX})"))))
        short = F.array(F.concat(F.lit(whole), own))
        some = F.transform(F.sequence(F.lit(0), F.least(F.length(c), F.lit(SUFFIX - 1))), lambda n: F.concat(F.lit(ends), F.substring(own, F.length(c) - n + 1, n)))
        return F.explode(F.concat(F.coalesce(long_, short), some)).alias("key")

    p = paths.select("*", keys("thread_path", "thread", "file"))
    f = files.select("*", keys("file_path", "file", "thread"))
    both = p.join(f, ["review_id", "key"]).drop("key").distinct()
    return both.where(F.endswith("file_path", "thread_path") | F.endswith("thread_path", "file_path"))


def _containing(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(review_id, file_ord) of the files whose path contains one of the threads' ``paths``."""
    hashed = lambda x: F.xxhash64(x)
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n)))
    long_ = lambda c: F.transform(F.when(F.length(c) >= SUFFIX, runs(c, SUFFIX)).otherwise(F.array().cast("array<string>")), hashed)
    short = [F.transform(F.when(F.length("file_path") >= n, runs("file_path", n)).otherwise(F.array().cast("array<string>")), hashed) for n in range(1, SUFFIX)]
    f = files.select("review_id", "file_ord", "file_path", F.explode(F.array_distinct(F.concat(long_("file_path"), *short))).alias("key"))
    p = paths.select("review_id", "thread_path", F.when(F.length("thread_path") >= SUFFIX, F.array_min(long_("thread_path"))).otherwise(F.xxhash64("thread_path")).alias("key"))
    return f.join(p, ["review_id", "key"]).where(F.contains("file_path", "thread_path")).select("review_id", "file_ord").distinct()


def nearby_changes(threads: DataFrame, matched: DataFrame, lines: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """Changed lines within ``window`` of each located thread: an equi-join on the file, cells of lines against skew.

    Each thread looks into its own cell of ``window`` + 1 lines and both neighbours, so a huge file is spread over cells and no
    pair outside the window's reach is made.
    """
    width = window + 1
    change = lines.where("type <> 'context'").select("review_id", "file_path", F.coalesce("new_line", "old_line").alias("ref"), "hunk_no", "pos", "type", "old_line", "new_line", "content")
    change = change.withColumn("cell", F.floor(F.col("ref") / width))
    own = threads.where("located").select("review_id", "disc_ord", "id", F.col("line").alias("original_line"), F.col("file_path").alias("thread_path"))
    own = own.join(matched.select("review_id", "thread_path", "file_path"), ["review_id", "thread_path"])
    at = F.floor(F.col("original_line") / width)
    own = own.withColumn("cell", F.explode(F.array(at - 1, at, at + 1)))
    both = own.join(change, ["review_id", "file_path", "cell"]).withColumn("distance", F.abs(F.col("ref") - F.col("original_line"))).where(F.col("distance") <= window)
    order = Window.partitionBy("review_id", "disc_ord").orderBy("distance", "hunk_no", "pos")
    return both.withColumn("place", F.row_number().over(order)).select("review_id", "disc_ord", "id", "thread_path", "original_line", "place", "type", "old_line", "new_line", "content", "distance")


def verify_summary(threads: DataFrame, nearby: DataFrame) -> DataFrame:
    """Per review: located threads, resolved and not, with and without changes nearby."""
    near = nearby.select("review_id", "disc_ord").distinct().withColumn("changed", F.lit(True))
    rows = threads.where("located").join(near, ["review_id", "disc_ord"], "left")
    changed = F.coalesce("changed", F.lit(False))
    return rows.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("total_threads"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if(changed).alias("threads_with_changes"), F.count_if(~changed).alias("threads_without_changes")
    )


def comment_errors(drafts: DataFrame) -> DataFrame:
    """Drafts with ``error``: what is missing, or null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    n = F.col("ord").cast("string")
    error = (
        F.when(blank("file_path"), F.concat(F.lit("comment "), n, F.lit(": file_path is missing")))
        .when(blank("body"), F.concat(F.lit("comment "), n, F.lit(": body is missing")))
        .when(zero("new_line") & zero("old_line"), F.concat(F.lit("comment "), n, F.lit(": new_line or old_line is needed")))
    )
    return drafts.withColumn("error", error)


def batch_error(drafts: DataFrame, most: int = MAX_COMMENTS) -> DataFrame:
    """Per review: why its batch of drafts is refused, or null: too many, or the first bad draft."""
    rows = comment_errors(drafts)
    many = F.concat(F.lit("too many comments: "), F.count(F.lit(1)).cast("string"))
    return rows.groupBy("review_id").agg(F.when(F.count(F.lit(1)) > most, many).otherwise(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord")))).alias("error"))


def positions(drafts: DataFrame) -> DataFrame:
    """Drafts with the place of each as GitLab (``gitlab``) and GitHub (``side``, ``line``) take it.

    ``drafts`` carry base_sha, head_sha and start_sha; without a base a GitLab position is null.
    """
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col(c))
    lab = F.struct(
        F.lit("text").alias("position_type"), "base_sha", "head_sha", "start_sha", F.col("file_path").alias("new_path"),
        F.coalesce(F.when(F.col("old_path") != "", F.col("old_path")), "file_path").alias("old_path"), some("new_line").alias("new_line"), some("old_line").alias("old_line"),
    )
    right = F.col("new_line").isNotNull()
    return drafts.withColumns({
        "gitlab": F.when(F.coalesce("base_sha", F.lit("")) != "", F.to_json(lab)),
        "side": F.when(right, "RIGHT").otherwise("LEFT"),
        "line": F.when(right, F.col("new_line")).otherwise(F.col("old_line")),
    })


def platform_facts(urls: DataFrame, base: str = "") -> DataFrame:
    """``urls`` (url) with platform, repository and number; unknown platforms are null."""
    u = F.col("url")
    return urls.withColumns({"platform": T.platform(u), "repository": T.repository(u, base), "number": T.review_number(u)})
