"""Theme labels (L1-L5): keyword titles, prompt rows, label parsing, and the
user-function labelling step.

No language-model client is part of the library.  ``label_themes`` calls a
user function on batches of prompts inside ``mapInPandas``, ``summarise_repos`` on the
lines of each repo; tests pass deterministic local functions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import keyword_title, py_strip
from logweave.operators.journal import Journal, new_journal
from logweave.operators.keyed import join_per_repo
from logweave.session import stored

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference:
PROMPT_COMMIT_LINES = 30       # commits listed in a cluster prompt
OVERVIEW_RECENT = 20           # newest commits listed in the overview prompt
DEFAULT_TITLE = "Miscellaneous"
DEFAULT_SUMMARY = ""
DEFAULT_ACTION = "None"
NO_KEYWORDS = "(none detected)"
# Python str.splitlines() boundaries:
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# ---------------------------------------------------------------------------

PROMPT_INSTRUCTIONS = (
    "Reply in exactly three lines, no headings and no blank lines:\n"
    "1) a theme title of three to six words in title case\n"
    "2) one or two sentences on what the commits change and why\n"
    "3) one concrete follow-up for an engineer, or 'None'"
)
OVERVIEW_INSTRUCTIONS = (
    "Summarise the recent direction of this repository in three to five "
    "sentences for a technical lead: main direction, worrying patterns such "
    "as repeated hotfixes, and the area with the most activity."
)


def keyword_labels(clusters: DataFrame, keyword_lists: DataFrame) -> DataFrame:
    """L1: ``(repo, cluster_id, title, summary, action_items)`` without a
    model: title from the first three keywords, ``Uncategorised`` if none."""
    kws = F.coalesce(F.col("keywords"), F.array().cast("array<string>"))
    return (clusters.select("repo", "cluster_id")
            .join(keyword_lists, ["repo", "cluster_id"], "left")
            .select("repo", "cluster_id", keyword_title(kws).alias("title"),
                    F.lit("").alias("summary"), F.lit("None").alias("action_items")))


def commit_line(date_col="date", subject_col="subject"):
    return F.concat(F.lit("["), F.date_format(date_col, "yyyy-MM-dd"), F.lit("] "), F.col(subject_col))


def theme_preview(ranked: DataFrame, commits: DataFrame, n: int) -> DataFrame:
    """First ``n`` commits (log order) of each theme with their position
    ``line`` (1-based) and the theme size; the rest is ``size - n`` more."""
    members = ranked.filter(F.col("cluster_id").isNotNull()).select("repo", "seq", "cluster_id", "size")
    w = Window.partitionBy("repo", "cluster_id").orderBy("seq")
    c = commits.select("repo", "seq", "sha", "author", "subject", F.to_date("ts").alias("date"))
    return (members.withColumn("line", F.row_number().over(w))
            .filter(F.col("line") <= int(n))
            .join(c, ["repo", "seq"]))


def cluster_prompts(ranked: DataFrame, commits: DataFrame, keyword_lists: DataFrame,
                    max_lines: int = PROMPT_COMMIT_LINES) -> DataFrame:
    """L2: one prompt per theme ``(repo, cluster_id, prompt)`` listing the
    keywords and the first ``max_lines`` commits as ``N. [date] subject``."""
    prev = theme_preview(ranked, commits, max_lines)
    lines = (prev.groupBy("repo", "cluster_id")
             .agg(F.first("size").alias("size"),
                  F.sort_array(F.collect_list(F.struct(
                      "line", F.concat(F.col("line").cast("string"), F.lit(". "),
                                       commit_line()).alias("text")))).alias("l")))
    kw = F.when(F.size(F.coalesce("keywords", F.array())) > 0,
                F.array_join("keywords", ", ")).otherwise(F.lit(NO_KEYWORDS))
    omitted = F.col("size") - F.lit(max_lines)
    prompt = F.concat(
        F.lit("Commit theme analysis.\n\nKeywords: "), kw,
        F.lit("\n\nCommits ("), F.col("size").cast("string"), F.lit(" total"),
        F.when(omitted > 0, F.lit(f", showing {max_lines}")).otherwise(F.lit("")),
        F.lit("):\n"), F.array_join(F.col("l.text"), "\n"), F.lit("\n"),
        F.when(omitted > 0, F.concat(F.lit("(+ "), omitted.cast("string"), F.lit(" more)\n")))
         .otherwise(F.lit("")),
        F.lit("\n" + PROMPT_INSTRUCTIONS))
    return (lines.join(keyword_lists, ["repo", "cluster_id"], "left")
            .select("repo", "cluster_id", prompt.alias("prompt")))


def overview_prompt_lines(labels: DataFrame, commits: DataFrame,
                          recent: int = OVERVIEW_RECENT) -> DataFrame:
    """L3: the overview prompt of each repo with at least two themes, as
    ordered lines ``(repo, line_no, text)``: a header, one ``- title`` line
    per theme (cluster order), the newest ``recent`` commits and the
    instructions.  Lines, not one string, so a repo with very many themes
    never becomes a single huge row; ``summarise_repos`` streams them."""
    n_labels = labels.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    repos = n_labels.filter(F.col("n") >= 2).select("repo")
    head = repos.select("repo", F.lit(0).cast("long").alias("line_no"),
                        F.lit("Recent activity summary.\n\nThemes:").alias("text"))
    titles = (join_per_repo(labels, repos, "left_semi", salt_cols=("cluster_id",))
              .select("repo", F.col("cluster_id").cast("long").alias("line_no"),
                      F.concat(F.lit("- "), F.col("title")).alias("text")))
    w = Window.partitionBy("repo").orderBy("seq")
    newest = (join_per_repo(commits, repos, "left_semi")
              .withColumn("k", F.row_number().over(w)).filter(F.col("k") <= int(recent)))
    big = F.lit(1 << 40)
    mid = repos.select("repo", (big - 1).alias("line_no"), F.lit("\nNewest commits:").alias("text"))
    recent_lines = newest.select("repo", (big + F.col("k")).alias("line_no"),
                                 commit_line(F.to_date("ts")).alias("text"))
    tail = repos.select("repo", (big * 2).alias("line_no"),
                        F.lit("\n" + OVERVIEW_INSTRUCTIONS).alias("text"))
    return head.unionByName(titles).unionByName(mid).unionByName(recent_lines).unionByName(tail)


def parse_label(text) -> F.Column:
    """L4: response text -> ``struct(title, summary, action_items)`` from its
    non-blank stripped lines, defaults ``Miscellaneous`` / ``""`` / ``None``."""
    col = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), LINE_BREAKS), py_strip),
                     lambda s: s != F.lit(""))
    return F.struct(
        F.coalesce(F.get(lines, 0), F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce(F.get(lines, 1), F.lit(DEFAULT_SUMMARY)).alias("summary"),
        F.coalesce(F.get(lines, 2), F.lit(DEFAULT_ACTION)).alias("action_items"))


def _call_batches(fn: Callable[[Sequence[str]], Sequence[str]], folder: str):
    def run(it):
        journal = Journal(folder)
        for pdf in it:
            known = {k: journal.get(k) for k in pdf["key"].unique()}
            asked = pdf[pdf["key"].map(known.get).isna()].drop_duplicates("key")
            err = None
            if len(asked):
                try:
                    texts = list(fn(list(asked["prompt"])))
                    if len(texts) != len(asked):
                        raise ValueError("label function returned a different number of texts")
                    for key, text in zip(asked["key"], texts):
                        journal.put(key, text or "")
                        known[key] = text or ""
                except Exception as exc:  # noqa: BLE001 - recorded, the run falls back
                    err = f"{type(exc).__name__}: {exc}"
            yield pd.DataFrame({
                "repo": pdf["repo"], "cluster_id": pdf["cluster_id"],
                "response": [known.get(k) for k in pdf["key"]],
                "error": [err] * len(pdf)})
    return run


def responses(prompts: DataFrame, fn: Callable[[Sequence[str]], Sequence[str]], journal: str,
              max_concurrent: int = 3) -> DataFrame:
    """``(repo, cluster_id, response, error)``: a prompt that the journal answers is not asked again."""
    return (prompts.withColumn("key", F.sha2("prompt", 256)).repartition(int(max_concurrent), "key")
            .mapInPandas(_call_batches(fn, journal),
                         schema="repo string, cluster_id int, response string, error string"))


def label_themes(prompts: DataFrame, fn: Callable[[Sequence[str]], Sequence[str]],
                 fallback: DataFrame, max_concurrent: int = 3, journal: str | None = None) -> DataFrame:
    """Label every theme with a user function ``fn(prompts) -> texts``.

    At most ``max_concurrent`` tasks call ``fn`` at once (the prompts are
    spread over that many partitions); equal prompts are asked once.  Errors
    are caught per batch; if any batch failed, the whole run uses ``fallback``
    (keyword labels), as the reference does.  Responses go to a journal at
    once, so a retried or lost task does not call ``fn`` again for what it has
    got; with a ``journal`` folder of the caller, a later run does not either.
    """
    journal = journal or new_journal(prompts.sparkSession)
    out = stored(responses(prompts, fn, journal, max_concurrent), "responses")
    if out.filter(F.col("error").isNotNull()).limit(1).count() > 0:
        return fallback.select("repo", "cluster_id", "title", "summary", "action_items")
    p = parse_label("response")
    return out.select("repo", "cluster_id", p["title"].alias("title"),
                      p["summary"].alias("summary"), p["action_items"].alias("action_items"))


def _summaries(fn, folder: str):
    def run(it):
        journal = Journal(folder)
        rows = (row for pdf in it for row in zip(pdf["repo"], pdf["text"]))
        for repo, lines in itertools.groupby(rows, key=lambda r: r[0]):
            key = next(lines)[1]
            text = journal.get(key)
            if text is None:
                parts, whole = [], True
                try:
                    got = fn(line for _, line in lines)
                    parts.extend([got] if isinstance(got, str) else ())
                    if not isinstance(got, str):
                        for chunk in got:
                            parts.append(chunk)
                except Exception:  # noqa: BLE001 - what has come so far is the summary
                    whole = False
                text = "".join(parts)
                if whole:
                    journal.put(key, text)
            yield pd.DataFrame({"repo": [repo], "overall_summary": [text]})
    return run


def summarise_repos(lines: DataFrame, fn: Callable[[Iterable[str]], str | Iterable[str]],
                    max_concurrent: int = 3, journal: str | None = None) -> DataFrame:
    """L3: ``(repo, overall_summary)`` from a user function over the overview prompt.

    ``lines``: ``overview_prompt_lines``.  ``fn`` gets the lines of one repo in order as
    an iterator that reads them as it goes, and returns a text or its chunks.  If it
    fails, the chunks before that are the summary, as in the reference, and are not kept
    in the journal.  Repos with fewer than two themes have no lines and no row.
    """
    journal = journal or new_journal(lines.sparkSession)
    line = F.struct("repo", "line_no", "text")
    keys = (lines.groupBy("repo").agg(F.bit_xor(F.xxhash64(line)).alias("h"), F.count(F.lit(1)).alias("n"))
            .select("repo", F.lit(-1).cast("long").alias("line_no"),
                    F.sha2(F.concat_ws(":", "repo", F.col("h").cast("string"), F.col("n").cast("string")), 256).alias("text")))
    rows = lines.select("repo", "line_no", "text").unionByName(keys)
    rows = rows.repartition(int(max_concurrent), "repo").sortWithinPartitions("repo", "line_no")
    return stored(rows.mapInPandas(_summaries(fn, journal), schema="repo string, overall_summary string"), "summaries")
