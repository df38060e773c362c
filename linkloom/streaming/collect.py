"""Collection of a corpus in resumable steps.

A crawl's files are processed a few at a time, each to a shard of its own, and the state is written after each; what failed
or was interrupted is taken up by the next call. When there are ``oversample`` times as many candidates as URLs are wanted the
corpus is built, and if the quotas leave too few, collection goes on with a higher aim.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import corpus
from linkloom.sources import corpus_files, files


class StateMismatch(ValueError):
    """The folder holds the state of another crawl or manifest."""


@dataclass
class State:
    """Which crawl, its files, and what has been finished: {file's number: shard, rows, seconds, source}."""

    crawl: str
    sources: list[str]
    completed: dict[str, dict] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(c["rows"] for c in self.completed.values())


@dataclass
class Plan:
    folder: str
    crawl: str
    sources: list[str]
    target: int = corpus.TARGET_URLS
    per_source: int = corpus.PER_SOURCE
    quota: int = corpus.DOMAIN_QUOTA
    oversample: float = 3.0
    workers: int = 8
    progress: Callable[[str], None] = lambda line: None

    def __post_init__(self) -> None:
        if min(self.target, self.per_source, self.quota, self.workers) < 1 or self.oversample < 1:
            raise ValueError("target, candidates, quota, workers and oversample are 1 at least")

    @property
    def state_path(self) -> str:
        return f"{self.folder}/state.json"

    @property
    def urls_path(self) -> str:
        return f"{self.folder}/urls"

    @property
    def candidates(self) -> int:
        """How many candidates are collected before the corpus is built, and how many more each further time."""
        return math.ceil(self.target * self.oversample)

    def shard(self, k: int) -> str:
        return f"{self.folder}/shard-{k:04d}.parquet"


def load_state(spark: SparkSession, plan: Plan) -> State:
    """The folder's state, or a new one. Shards that are gone count as not done; unfinished files are removed, and a corpus whose replacement was cut off comes back."""
    files.recover(spark, plan.urls_path)
    if not files.exists(spark, plan.state_path):
        return State(plan.crawl, plan.sources)
    state = State(**files.read_json(spark, plan.state_path))
    if state.crawl != plan.crawl or state.sources != plan.sources:
        raise StateMismatch(f"{plan.folder} belongs to {state.crawl} with {len(state.sources)} files")
    state.completed = {k: c for k, c in state.completed.items() if files.exists(spark, c["file"])}
    for path in files.names(spark, plan.folder):
        if ".tmp" in path.rpartition("/")[2]:
            files.delete(spark, path)
    return state


def reset(spark: SparkSession, plan: Plan) -> None:
    """Forgets a collection: its state, shards, corpus and report. What else the folder holds stays."""
    if not files.exists(spark, plan.folder):
        return
    own = re.compile(r"(state\.json|report\.json|urls|ranked|shard-[0-9]{4,})(\..*)?")
    for path in files.names(spark, plan.folder):
        if own.fullmatch(path.rpartition("/")[2]):
            files.delete(spark, path)


def save_state(spark: SparkSession, plan: Plan, state: State) -> None:
    files.write_json(spark, plan.state_path, {"crawl": state.crawl, "sources": state.sources, "completed": state.completed})


def collect_source(spark: SparkSession, plan: Plan, k: int, ranked: DataFrame) -> dict:
    """One file of the crawl to its shard: filter, ranked domains, the first per_source rows in random order.

    The crawl's file is read once: what it keeps is written, and counted and cut from there.
    """
    began = time.time()
    rows = corpus.of_ranked_domains(corpus.wanted_urls(corpus_files.crawl_rows(spark, plan.sources[k])), ranked)
    place = plan.shard(k)
    if files.exists(spark, place):
        files.delete(spark, place)  # written, but never entered in the state
    kept = f"{place}.kept.tmp"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(kept)
    n = corpus_files.write_shard(corpus.first_by_hash(spark.read.schema(rows.schema).parquet(kept), plan.per_source), place)
    files.delete(spark, kept)
    return {"file": place, "rows": n, "seconds": round(time.time() - began, 3), "source": plan.sources[k]}


def collect(spark: SparkSession, plan: Plan, state: State, ranked: DataFrame, aim: int) -> dict[int, Exception]:
    """Works through files that aren't done until ``aim`` candidates are there or none is left; returns what failed.

    No more files are under way than the rows that are missing could need.
    """
    todo = [k for k in range(len(plan.sources)) if str(k) not in state.completed]
    failed: dict[int, Exception] = {}
    with ThreadPoolExecutor(plan.workers) as pool:
        running: dict = {}
        while True:
            missing = aim - state.rows
            room = min(plan.workers, math.ceil(missing / plan.per_source)) if missing > 0 else 0
            while todo and len(running) < room:
                k = todo.pop(0)
                running[pool.submit(collect_source, spark, plan, k, ranked)] = k
            if not running:
                return failed
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                k = running.pop(done)
                if done.exception() is None:
                    state.completed[str(k)] = done.result()
                    save_state(spark, plan, state)
                    plan.progress(f"{plan.sources[k]}: {state.completed[str(k)]['rows']} rows, {state.rows} of {aim}")
                else:
                    failed[k] = done.exception()
                    plan.progress(f"{plan.sources[k]} failed: {failed[k]}")


def final_rows(spark: SparkSession, plan: Plan, state: State) -> DataFrame:
    """Unique candidates of all shards with their rank in the domain, up to the quota."""
    shards = [state.completed[k]["file"] for k in sorted(state.completed, key=int)]
    return corpus.domain_ranks(corpus.unique_urls(spark.read.option("mergeSchema", "true").parquet(*shards)), plan.quota)


def build(spark: SparkSession, plan: Plan, ranked: DataFrame) -> dict:
    """Collects and publishes <folder>/urls and <folder>/report.json; returns the report.

    The ranked rows are written once per attempt, and counts, cut and domains are read from there. With too few eligible
    URLs an older corpus stays as it is and the aim, at first oversample times the target, grows by as much; with no file left
    it is an error.
    """
    state = load_state(spark, plan)
    save_state(spark, plan, state)
    aim = plan.candidates
    while True:
        failed = collect(spark, plan, state, ranked, aim)
        eligible, kept = 0, f"{plan.folder}/ranked.tmp"
        if state.completed:
            final_rows(spark, plan, state).write.mode("overwrite").option("compression", "zstd").parquet(kept)
            rows = spark.read.parquet(kept)
            eligible = rows.count()
        if eligible >= plan.target:
            chosen = corpus.first_by_hash(rows, plan.target)
            domains = chosen.agg(F.countDistinct("domain")).first()[0]
            written = corpus_files.write_urls(chosen, plan.urls_path, plan.target)
            report = {"crawl": plan.crawl, "candidates": state.rows, "eligible": eligible, "urls": written, "domains": domains, "files": len(state.completed), "failed": len(failed)}
            files.write_json(spark, f"{plan.folder}/report.json", report)
            files.delete(spark, kept)
            return report
        if len(state.completed) + len(failed) >= len(plan.sources):
            raise RuntimeError(f"{eligible} of {plan.target} URLs: no file is left, {len(failed)} failed") from next(iter(failed.values()), None)
        aim = max(aim, state.rows) + plan.candidates
