"""Commit history and diffs of a git repository, read by its command-line client.

`register(spark)` adds the data source `commits`; spark.read.format("commits").option("path", repo).load() gives
commit_id, author, ts, path, one row for each file that a commit changes against its first parent, newest first."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from weftline.functions.text import fnv1a

_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout


def told(repo: str, *args: str) -> Iterator[str]:
    """What the client writes between marks U+0001, read as it comes: one commit at a time is held."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE) as run:
        held = b""
        while chunk := run.stdout.read(1 << 16):
            *whole, held = (held + chunk).split(b"\1")
            yield from (part.decode("utf-8", "replace") for part in whole if part)
        if held:
            yield held.decode("utf-8", "replace")
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, run.args)


def is_ancestor(repo: str, commit: str, head: str = "HEAD") -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", commit, head], capture_output=True).returncode == 0


def author_key(email: str, name: str) -> int:
    """Signed 64-bit FNV-1a of the mail address, of the name where there is none."""
    h = fnv1a((email or name).encode())
    return h - (1 << 64) if h >= 1 << 63 else h


class CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.since, self.depth = options["path"], options.get("since"), options.get("depth")

    def read(self, partition) -> Iterator[tuple]:
        """All commits that lead to HEAD, those of merged branches too, each against its first parent; newest first."""
        args = ["log", "--diff-merges=first-parent", "--no-renames", "--name-only", "-z", "--format=%x01%H%x02%ae%x02%an%x02%ct%x02"]
        if self.depth:
            args.append(f"--max-count={self.depth}")
        # a mark that is no ancestor (rewritten history) means the whole walk
        args.append(f"{self.since}..HEAD" if self.since and is_ancestor(self.repo, self.since) else "HEAD")
        for part in told(self.repo, *args):
            commit, email, name, when, rest = part.split("\x02", 4)
            ts = datetime.fromtimestamp(int(when), timezone.utc).replace(tzinfo=None)
            for path in sorted({p.strip("\n") for p in rest.split("\0")} - {""}):
                yield commit, author_key(email, name), ts, path


class Commits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commits"

    def schema(self) -> str:
        return "commit_id string, author bigint, ts timestamp_ntz, path string"

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Commits)


def hunks_of(text: str) -> list[tuple[str, int, int]]:
    """(path, first, last) of a unified diff without context: new-side lines from 1; pure deletions give none."""
    out, path = [], None
    for line in text.splitlines():
        if line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else None
        elif path and (m := _HUNK.match(line)):
            n = int(m[2]) if m[2] is not None else 1
            if n:
                out.append((path, int(m[1]), int(m[1]) + n - 1))
    return out


def diff(repo: str, commit: str | None = None, base: str | None = None, head: str | None = None) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(hunks, changed paths), sorted, of the working tree against HEAD, of one commit, or between two. Untracked files don't count."""
    if commit:
        args = ["show", "--first-parent", "-m", "--format=", commit]
    elif base and head:
        args = ["diff", base, head]
    else:
        args = ["diff", "HEAD"]
    text = git(repo, *args, "-U0", "--no-renames", "--diff-algorithm=histogram", "--no-color", "--src-prefix=a/", "--dst-prefix=b/").decode("utf-8", "replace")
    names = git(repo, *args, "--no-renames", "--name-only", "-z").decode("utf-8", "replace")
    return sorted(set(hunks_of(text))), sorted({p.strip("\n") for p in names.split("\0")} - {""})


def commit_hunks(spark: SparkSession, repo: str, commits: DataFrame) -> DataFrame:
    """(commit_id, path, start_line, end_line) of each commit (commit_id); executors run the client on a shared checkout."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(c, p, a, b) for c in pdf["commit_id"] for p, a, b in diff(repo, commit=c)[0]]
            yield pd.DataFrame(rows, columns=["commit_id", "path", "start_line", "end_line"])

    return commits.select("commit_id").distinct().mapInPandas(run, "commit_id string, path string, start_line int, end_line int")


def blobs(repo: str, rev: str, paths: list[str]) -> list[tuple[str, bytes]]:
    """(path, bytes) at a revision; paths it lacks are left out."""
    out = []
    for p in paths:
        found = subprocess.run(["git", "-C", repo, "show", f"{rev}:{p}"], capture_output=True)
        if found.returncode == 0:
            out.append((p, found.stdout))
    return out
