"""End-to-end plans: ``analyse`` (themes) and ``hotfiles`` (churn).

Spark form of the reference's pipeline:
``commits -> F1-F4 -> message/tokens -> TF-IDF -> similarity edges ->
clusters -> ranked clusters -> keywords``; ``report`` goes on to labels, summary and export.
Shuffles: term counts, document frequency, per-document norm, the
similarity join on (repo, term), cluster ranking and keyword ranking.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import message
from logweave.operators import churn as churn_ops
from logweave.operators import cluster as cl
from logweave.operators import filters as flt
from logweave.operators import labels as lab
from logweave.operators import vectors as vec
from logweave.operators.packs import pack_texts
from logweave.session import checkpoint_dir, stored
from logweave.sinks import reports as sinks


@dataclass
class Themes:
    docs: DataFrame        # (repo, seq, message)
    postings: DataFrame    # (repo, seq, term, cnt, df, weight)
    assignment: DataFrame  # (repo, seq, seed_seq)
    ranked: DataFrame      # (repo, seq, seed_seq, cluster_id, size)
    keywords: DataFrame    # (repo, cluster_id, rank, term, weight)
    clusters: DataFrame    # (repo, seed_seq, size, cluster_id)


def documents_of(commits: DataFrame) -> DataFrame:
    cols = commits.columns
    msg = F.col("message") if "message" in cols else message()
    return commits.select("repo", "seq", msg.alias("message"))


def theme_tables(commits: DataFrame, threshold: float = 0.20, min_size: int = 2,
                 k: int = 8, algorithm: str = "leader", method: str = "blocks",
                 persist: bool = False) -> Themes:
    """Vectors, clusters and keywords for every repo of ``commits``.

    ``algorithm="leader"`` (C2, any size) or ``"greedy"`` (C1, exact
    reference rule, bounded groups).  ``persist`` keeps the reused
    intermediates (postings, ranked) in memory-and-disk for multi-output
    runs.
    """
    cl._check_args(threshold, min_size)
    checkpoint_dir(commits.sparkSession)
    docs = documents_of(commits)
    if algorithm == "leader" and method == "blocks" and 0 < threshold < 1 - 1e-9:
        # vectors stay packed: no posting is shuffled or written as a row
        vectors = pack_texts(docs)
        postings = vectors.postings()
        return _themes(docs, vectors, postings.persist(StorageLevel.MEMORY_AND_DISK) if persist else postings,
                       cl.leader_themes_packed(docs, vectors, threshold), min_size, k, persist)
    postings = vec.tfidf(docs, term_ids=algorithm == "leader")
    if persist:
        postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        # postings feed both the similarity join and the keywords: write them
        # once to the shared checkpoint folder (also cuts the lineage)
        postings = stored(postings, "postings")
    if algorithm == "leader":
        # exact copies are collapsed first, so a big group of copies never
        # turns into all-pairs edges
        assignment = cl.leader_themes_collapsed(docs, postings, threshold, method)
    elif algorithm == "greedy":
        assignment = cl.greedy_themes(docs, postings, threshold)
    else:
        raise ValueError("algorithm must be 'leader' or 'greedy'")
    return _themes(docs, postings, postings.drop("term_id"), assignment, min_size, k, persist)


def _themes(docs: DataFrame, vectors, postings: DataFrame, assignment: DataFrame, min_size: int, k: int, persist: bool) -> Themes:
    # ranks, sizes, labels and reports all start from the assignment: write it once
    assignment = stored(assignment, "assignment")
    clusters = cl.cluster_sizes(assignment, min_size)
    ranked = cl.rank_clusters(assignment, min_size, clusters)
    if persist:
        ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    keywords = cl.top_keywords(ranked, vectors, k)
    return Themes(docs, postings, assignment, ranked, keywords, clusters)


def analyse(commits: DataFrame, since=None, until=None, author=None, branch: str = "HEAD",
            max_commits: int | None = None, **theme_args) -> Themes:
    """The reference's ``analyse`` selection (F1-F4; all commits unless ``max_commits`` is given)
    followed by ``theme_tables``.  One ref is analysed: ``seq`` is a position in
    the log of one ref, so logs of several refs are never mixed (``analyse_refs``
    takes many in one run)."""
    sel = flt.select_log(commits, since, until, author, branch, max_commits)
    return theme_tables(sel, **theme_args)


def log_key():
    """One string for the log of a (repo, ref), from which both can be read again."""
    return F.to_json(F.struct("repo", "ref"))


def _with_ref(table: DataFrame) -> DataFrame:
    log = F.from_json("repo", "repo string, ref string")
    return table.select(log["repo"].alias("repo"), log["ref"].alias("ref"), *[c for c in table.columns if c != "repo"])


def analyse_refs(commits: DataFrame, refs: list[str] | None = None, since=None, until=None, author=None,
                 max_commits: int | None = None, **theme_args) -> Themes:
    """``analyse`` of the logs of several refs (default: all) in one run.

    Each (repo, ref) is a log of its own: ``max_commits``, document frequencies, clusters
    and their ids are per log, and every table of the result has ``(repo, ref, ...)``.  The
    theme operators see one key per log, so all logs share the same shuffles and a commit
    that lies on two refs is a member of two logs.  The order in which C2 visits a log's
    rows comes from the log's key, so its themes may differ from those of ``analyse``.
    """
    sel = flt.select_log(commits, since, until, author, None, max_commits)
    if refs is not None:
        sel = sel.filter(F.col("ref").isin(list(refs)))
    found = theme_tables(sel.withColumn("repo", log_key()), **theme_args)
    return Themes(**{f.name: _with_ref(getattr(found, f.name)) for f in fields(Themes)})


@dataclass
class Report:
    themes: Themes
    labels: DataFrame           # (repo, cluster_id, title, summary, action_items)
    overall: DataFrame | None   # (repo, overall_summary); None without a summariser
    frame: DataFrame            # what was written, or would be


def report(commits: DataFrame, path: str | None = None, labeller: Callable | None = None,
           summariser: Callable | None = None, export: str | None = None, generated_at: str | None = None,
           max_concurrent: int = 3, journal: str | None = None, files: int | None = None, **selection) -> Report:
    """From the log to the report in one call: ``analyse``, labels (L5 with ``labeller``, else
    keyword titles), executive summary (L3 with ``summariser``, repos of at least two themes),
    and the export that ``path`` or ``export`` asks for, written if there is a ``path``: in a
    folder per repo or, with ``files``, in at most that many files and a manifest.
    ``selection``: the arguments of ``analyse``.
    """
    from datetime import datetime, timezone

    since, until, author, branch, most = (selection.pop(k, d) for k, d in (
        ("since", None), ("until", None), ("author", None), ("branch", "HEAD"), ("max_commits", None)))
    selected = flt.select_log(commits, since, until, author, branch, most)
    t = theme_tables(selected, **selection)
    words = cl.keyword_lists(t.keywords)
    labels = lab.keyword_labels(t.clusters, words)
    if labeller is not None:
        labels = lab.label_themes(lab.cluster_prompts(t.ranked, selected, words), labeller, labels, max_concurrent, journal)
    overall = None
    if summariser is not None:
        overall = lab.summarise_repos(lab.overview_prompt_lines(labels, selected), summariser, max_concurrent, journal)
    stamp = generated_at or datetime.now(timezone.utc).isoformat()
    kind = sinks.export_format(path or "", export)
    if kind == "csv":
        frame, write = sinks.report_csv_frame(selected, t.ranked, labels), sinks.write_report_csv
    elif kind == "markdown":
        frame, write = sinks.report_markdown_lines(selected, t.ranked, labels, stamp, overall), sinks.write_report_markdown
    else:
        frame, write = sinks.report_json_lines(selected, t.ranked, labels, stamp, overall), sinks.write_report_documents
    if path is not None:
        write(frame, path, files=files)
    return Report(t, labels, overall, frame)


def hotfiles(numstat: DataFrame, commits: DataFrame | None = None, since=None, until=None,
             author=None, branch: str = "HEAD", max_commits: int | None = None,
             min_commits: int = 2, top: int = 20) -> DataFrame:
    """The reference's ``hotfiles`` command: churn of the selected commits of one
    ref, top-n per repo with heat values."""
    numstat = numstat.filter(F.col("ref") == F.lit(branch))
    if commits is not None:
        sel = flt.select_log(commits, since, until, author, branch, max_commits)
        numstat = flt.churn_for_commits(numstat, sel)
    return churn_ops.hot_files(churn_ops.file_churn(numstat, min_commits), top)
