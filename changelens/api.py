"""The tools as functions: batches of reviews, checkouts or symbols in, DataFrames out.

Inputs that are not as they should be raise ``ValueError`` here, at the edge; what is wrong with single rows comes as
an ``error`` column.
"""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import code, diff, index, registry, review, search, sections, syntax
from .runtime import written
from .sources import embeddings, posting, repository, sinks
from .streaming.index import latest, part_paths, refresh, vacuum, versions


def changed_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files in the manifest's order, counts per review); no file content is carried."""
    rows = diff.measured(files).drop("patch")
    return review.manifest_order(rows), review.manifest_stats(rows)


def _page(files: DataFrame, cost: DataFrame, targeted: bool, max_chars: int, skip_noise: bool) -> DataFrame:
    rows = diff.measured(files).drop("patch").join(cost, diff.FILE, "left").fillna({"cost": 0})
    if targeted:
        return rows.withColumns({"used_chars": F.lit(None).cast("long"), "status": F.lit("returned")})
    return diff.budget(rows, max_chars, skip_noise)


def diff_lines(files: DataFrame, files_filter: list[str] | None = None, lines_filter: dict[str, list[int]] | None = None, max_chars: int = diff.MAX_CHARS, skip_noise: bool = True) -> tuple[DataFrame, DataFrame]:
    """(lines of the returned files, files with their status); with ``lines_filter``, mappings instead of lines."""
    if max_chars < 0:
        raise ValueError("max_chars must not be negative")
    own = diff.path_filter(files, [*(files_filter or []), *(lines_filter or {})])
    lines = diff.hunk_lines(own)
    if lines_filter:
        wanted = F.flatten(F.array(*[F.when(F.col("file_path").contains(k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<int>")) for k, v in lines_filter.items()]))
        page = _page(own, own.select(*diff.FILE, F.lit(0).alias("cost")), True, max_chars, skip_noise)
        return diff.line_mappings(lines, own.select(*diff.FILE, wanted.alias("requested"))), page
    page = _page(own, diff.entry_costs(diff.measured(own), lines), bool(files_filter), max_chars, skip_noise)
    return lines.join(page.where("status = 'returned'").select(*diff.FILE), diff.FILE, "left_semi"), page


def diff_sections(files: DataFrame, include_context: bool = False, files_filter: list[str] | None = None, max_chars: int = diff.MAX_CHARS, skip_noise: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sections of the returned files with their lines as ``changes``, files with their status).

    New files go by syntax, others by hunk context.  A file costs what its entry has of characters as JSON.
    """
    own = diff.path_filter(files, files_filter)
    lines = diff.hunk_lines(own)
    by_syntax = syntax.new_file_sections(lines, own, include_context, with_changes=True)
    by_hunk = sections.hunk_sections(lines, include_context, with_changes=True).drop("section_no").join(by_syntax.select(*diff.FILE).distinct(), diff.FILE, "left_anti")
    found = by_hunk.unionByName(by_syntax)
    page = _page(own, diff.section_costs(diff.measured(own), found), bool(files_filter), max_chars, skip_noise)
    return found.join(page.where("status = 'returned'").select(*diff.FILE), diff.FILE, "left_semi"), page


def review_status(threads: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(discussion summary per review, changed lines per file)."""
    return review.status(threads), diff.measured(files).select(*diff.FILE, "additions", "deletions")


def dependency_impact(files: DataFrame, symbols: DataFrame, whole_word: bool = True, max_results: int = code.MAX_RESULTS, file_glob: str | None = None) -> dict[str, DataFrame]:
    """references to symbols in source files, with usage and enclosing declaration; by_file, by_usage_type and total_references.

    Usages in Python files go by syntax, in others by patterns.
    """
    if file_glob:
        files = files.where(F.col("path").rlike(T.glob_pattern(file_glob)))
    hits = written(code.references(code.source_lines(files), symbols, whole_word, most=max_results))
    own = files.join(hits.select("path").distinct(), "path", "left_semi")
    by_syntax = syntax.usages(own, hits)
    hits = hits.join(by_syntax, ["path", "line", "symbol"], "left").withColumn("usage_type", F.coalesce("usage", "usage_type")).drop("usage")
    found = written(code.enclosing(hits, syntax.declarations(syntax.syntax(own, most=None))))
    found = found.select("symbol", "rank", "path", "line", "context", "usage_type", "enclosing_symbol")
    total = found.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_references"))
    return {"references": found, "by_file": code.counts(found, "path"), "by_usage_type": code.counts(found, "usage_type"), "total_references": total}


def trace_call_chain(files: DataFrame, symbols: DataFrame, depth: int = 1, call_name: str = "last", max_files: int | None = None) -> dict[str, DataFrame]:
    """definition, callees, callers, stats and, beyond the first step, what is reached.

    All files take part; ``max_files`` (``code.MAX_FILES`` is the interactive tool's) keeps the first by path.
    """
    if max_files is not None:
        files = files.orderBy("path").limit(max_files)
    parsed = written(syntax.syntax(files, call_name))
    calls = syntax.edges(parsed)
    return {
        "definition": code.definitions(syntax.declarations(parsed), symbols), "callees": code.callees(calls, symbols), "callers": code.callers(calls, symbols),
        "reach": code.reach(calls, symbols, depth), "stats": syntax.scan_stats(parsed),
    }


def file_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, hash) of the indexes in a folder: from their tables, else from their records."""
    found = repository.sidecars(spark, folder)
    listed = found.select("name", F.explode("fileset").alias("path"), "files").select("name", "path", F.try_element_at("files", "path").alias("hash"))
    names = [r[0] for r in found.select("name").collect()]  # one name an index
    paths = [x for name in names for x in part_paths(spark, f"{folder}/{name}", "files")]
    if not paths:
        return listed
    own = spark.read.schema("path string, hash string").parquet(*paths)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)/files/version=\d+/bucket=\d+/[^/]+$", 1)
    own = own.select(name.alias("name"), "path", "hash")
    return listed.join(own.select("name").distinct(), "name", "left_anti").unionByName(own)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all indexes in a folder, with what the registry asks of them; file sets are in ``file_sets``."""
    found = repository.sidecars(spark, folder)
    roots = [r[0] for r in found.select("root").where("root <> ''").distinct().collect()]  # one path an index
    there = spark.createDataFrame([(r, Path(r).exists()) for r in roots], "root string, root_exists boolean")
    live = repository.live_keys(spark, roots).withColumn("reachable", F.lit(True))
    out = found.join(there, "root", "left").join(live, "name", "left").join(repository.folder_sizes(spark, folder), "name", "left")
    return out.fillna(False, ["root_exists", "reachable"]).fillna(0, ["size_bytes"])


def index_repo(spark: SparkSession, root: str, folder: str, connect=None, model: str = "", force: bool = False) -> dict:
    """Index a checkout into ``folder``, or bring its index to what is there now.

    Only changed files are chunked and, with ``connect`` (see ``sources.embeddings``), embedded again, unless there is
    no index, no record, another model, or ``force``.  The record is written last; indexes of the same project that
    nothing reaches any more are dropped.  The files and their hashes are a table of the index (``file_sets``): none of
    their paths passes through the driver.  Returns what was done, in numbers, observed by the passes that did it.
    """
    facts, met = repository.git_facts(spark, root).first(), Observation()
    table, files = f"{folder}/{facts.key}", written(repository.scan(spark, root, seen=met).select("path", "content", "hash"))
    record = _record(spark, folder, facts.key)
    known = versions(spark, table)
    state = spark.createDataFrame([(force, bool(known), record.model if record else None, model, record and "")], "force boolean, has_table boolean, meta_model string, model string, files string")
    gate = index.is_incremental(*map(F.col, ("force", "has_table", "meta_model", "model", "files")))
    incremental, done = bool(state.select(gate).first()[0]), {}
    embed = (lambda rows: embeddings.embed(rows, connect)) if connect is not None else None
    refresh(spark, table, files, known[-1] + 1 if known else 1, embed, incremental, counts=done)
    vacuum(spark, table, keep=2)  # a reader may still be at the one before
    stamp = {"git_sha": facts.main_sha or facts.head_sha, "model": model, "chunks": done["chunks"], "indexed_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "root": facts.root, "remote": facts.remote, "n_files": done["files"]}
    sinks.write_record(spark, folder, facts.key, stamp)
    twins = [r.name for r in registry.dead_twins(_records(spark, folder), facts.key, facts.remote, files.select("path"), sets=file_sets(spark, folder)).select("name").collect()]  # one name an index
    for name in twins:
        sinks.drop_index(spark, f"{folder}/{name}")
        sinks.drop_record(spark, folder, name)
    return {"mode": "incremental" if incremental else "full", "indexed_chunks": done["chunks"], "files": done["files"], "skipped": met.get["met"] - done["files"], "changed_files": done["changed"], "deleted_files": done["deleted"], "git_sha": (stamp["git_sha"] or "")[:8], "model": model, "evicted": len(twins)}


def _record(spark: SparkSession, folder: str, name: str):
    """An index's record, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return repository.sidecars(spark, folder).where(F.col("name") == name).first()


def index_status(spark: SparkSession, root: str, folder: str, model: str = "") -> DataFrame:
    """One row: the state of a checkout's index (absent, fresh, stale, model_mismatch, unknown) and what it follows from."""
    facts = repository.git_facts(spark, root)
    row = facts.first()
    record, table = _record(spark, folder, row.key), versions(spark, f"{folder}/{row.key}") or None
    own = {"has_table": table is not None, "has_meta": record is not None, "meta_model": record and record.model, "indexed_sha": record and record.git_sha, "indexed_at": record and record.indexed_at, "chunks": record.chunks if record is not None and table is not None else None}
    types = {"has_table": "boolean", "has_meta": "boolean", "chunks": "long"}
    out = index.freshness(facts.withColumns({"model": F.lit(model)} | {k: F.lit(v).cast(types.get(k, "string")) for k, v in own.items()}))
    behind = repository.commits_between(root, record.git_sha, row.main_sha or "HEAD") if record and out.first().needs_commits_behind else None
    return index.next_step(index.auto_index(out.withColumn("commits_behind", F.lit(behind).cast("long"))))


def prune_folder(spark: SparkSession, folder: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """``prune_indexes`` of a folder's records; without ``dry_run`` what is prunable is deleted."""
    sets = file_sets(spark, folder).groupBy("name").agg(F.collect_set("path").alias("paths"))
    own = _records(spark, folder).join(sets, "name", "left").withColumn("fileset", F.coalesce("paths", "fileset")).drop("paths")
    rows, freed = prune_indexes(own)
    rows, freed = written(rows), written(freed)
    if not dry_run:
        for r in rows.where("reason is not null").select("name").collect():  # one name an index
            sinks.drop_index(spark, f"{folder}/{r.name}")
            sinks.drop_record(spark, folder, r.name)
    return rows, freed


def code_search(chunks: DataFrame, queries: DataFrame, k: int = 8, postings: DataFrame | None = None) -> DataFrame:
    """The k best chunks (chunk_id, text, vector) of each query (query_id, query, terms), by meaning and by words.

    ``postings``: those that ``index_repo`` has written beside the chunks; else they are made of the chunks.
    """
    near = search.nearest(chunks, queries.select("query_id", "query"), max(k, search.DEPTH))
    postings = search.postings(chunks) if postings is None else postings
    text = search.bm25(postings, queries.select("query_id", F.explode("terms").alias("term")), search.totals(chunks), max(k, search.DEPTH))
    return search.fuse(near, text, k).join(chunks.drop("vector"), "chunk_id")


def review_context(files: DataFrame, source: DataFrame, max_symbols: int = sections.MAX_SYMBOLS, root: str | None = None, review_head: str | None = None, folder: str | None = None, model: str = "", connect=None, auto: bool = True) -> dict[str, DataFrame]:
    """What the code base says about the symbols that reviews change.

    symbols (with a snippet each) and references to them; with ``root`` the state of the checkout (root_status, and a
    warning where it is not at the review's head); with ``folder`` the state of its index, which is brought up to date
    first where that is called for; with ``connect`` also related code, by meaning and by words.
    """
    spark = files.sparkSession
    lines = diff.hunk_lines(files)
    top = sections.review_symbols(sections.hunk_sections(lines), lines, max_symbols)
    symbols = written(top.join(sections.first_context(lines, top), ["review_id", "symbol"], "left"))
    out = {"symbols": symbols} | {k: v for k, v in dependency_impact(source, symbols.select("symbol")).items()}
    if root is not None:
        warning = F.when(F.col("root_state") == "mr_head_absent", "the checkout does not hold the review's head: fetch it, else references miss its changes").when(F.col("root_state") == "not_checked_out", "the checkout is not at the review's head: check it out for exact references")
        out["root_status"] = index.root_state(repository.git_facts(spark, root, review_head)).withColumn("warning", warning)
    if root is not None and folder is not None:
        status = index_status(spark, root, folder, model)
        if auto and status.first().auto_index:
            index_repo(spark, root, folder, connect, model)
            status = index_status(spark, root, folder, model)
        out["index_status"] = status
        table = f"{folder}/{repository.git_facts(spark, root).first().key}"
        chunks = latest(spark, table)
        if connect is not None and chunks is not None and "vector" in chunks.columns:
            text = F.trim(F.concat_ws(" ", "symbol", "snippet"))
            asked = symbols.select("symbol", text.alias("text")).groupBy("symbol").agg(F.min("text").alias("text")).withColumn("query_id", F.col("symbol"))
            terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(search.WORD), F.lit(1)))
            queries = written(embeddings.embed(asked, connect).select("query_id", F.col("vector").alias("query"), terms.alias("terms")))
            out["related"] = code_search(chunks, queries, 5, latest(spark, f"{table}/postings")).withColumnRenamed("query_id", "symbol_asked")
    return out


def verify_review(threads: DataFrame, files: DataFrame, window: int = review.WINDOW_LINES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(threads, changes near each, summary per review); only files with threads are parsed."""
    own = review.distinct_threads(threads)
    matched = review.match_paths(own, files)
    wanted = files.join(matched.select("review_id", "file_ord").distinct(), ["review_id", "file_ord"], "left_semi")
    near = review.nearby_changes(own, matched, diff.hunk_lines(wanted), window)
    return own, near, review.verify_summary(own, near)


def post_comments(drafts: DataFrame, connect, max_comments: int = review.MAX_COMMENTS, scrub=str, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, summary); reviews whose batch is refused post nothing and come with the error in the summary.

    With a ``ledger`` (see ``sources.posting``) a draft is posted once, whatever runs again; without one that is up to what
    ``connect`` gives.
    """
    errors = review.batch_error(drafts, max_comments)
    ok = drafts.join(errors.where("error is null").select("review_id"), "review_id", "left_semi")
    outcomes = posting.post_once(ok, connect, ledger, scrub) if ledger else written(sinks.post_comments(ok, connect, scrub))  # posted once, read twice
    return outcomes, errors.join(sinks.post_summary(outcomes), "review_id", "left")


def prune_indexes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the reason to prune each, what pruning frees)."""
    rows = registry.prune(records)
    return rows, registry.reclaimed(rows)
