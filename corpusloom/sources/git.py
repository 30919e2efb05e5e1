"""Files of a git commit as a Spark data source.

``spark.read.format("git_tree").option("repo", path).load()`` gives path, mode, sha,
size and content of every file of a commit. A partition takes the files whose
paths hash to it, and reads them through one git process; neither the list nor a
blob passes the driver. The objects themselves are read, so files that
attributes leave out of archives (export-ignore) are there. The repository must lie
where executors can read it.

Options: repo, commit (HEAD), suffix (of paths; all without), partitions (8).
Content is as git keeps it, without the line ends that attributes may give to a
checkout. Symbolic links have their target as content; submodules are left out.
"""

from __future__ import annotations

import subprocess
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of content of one Arrow batch (or a single larger file).
BATCH_BYTES = 8 << 20


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, mode string, sha string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return GitTreeReader(dict(self.options))


class GitTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("repo"):
            raise ValueError("option repo is missing")
        self.repo, self.suffix = options["repo"], options.get("suffix", "")
        self.count = max(1, int(options.get("partitions", 8)))
        # a name like HEAD may move while partitions are read
        self.commit = resolved(self.repo, options.get("commit", "HEAD"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.count)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        listing = subprocess.Popen(["git", "-C", self.repo, "ls-tree", "-r", "-z", self.commit], stdout=subprocess.PIPE)
        blobs = subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        rows: list[tuple] = []
        held = 0
        try:
            for mode, sha, path in _entries(listing.stdout):
                if not path.endswith(self.suffix.encode()) or zlib.crc32(path) % self.count != partition.value:
                    continue
                content = _blob(blobs, sha)
                rows.append((path.decode("utf-8", "replace"), mode, sha.decode(), len(content), content))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
            if listing.wait():
                raise OSError(f"git ls-tree failed in {self.repo}")
        finally:
            blobs.stdin.close()
            for process in (listing, blobs):
                process.stdout.close()
                process.wait()


def resolved(repo: str, commit: str) -> str:
    """The full name of a commit."""
    done = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "--end-of-options", f"{commit}^{{commit}}"], capture_output=True)
    if done.returncode:
        raise ValueError(f"{repo} has no commit {commit}")
    return done.stdout.decode().strip()


def _entries(stream) -> Iterator[tuple[str, bytes, bytes]]:
    """mode, sha and path of the files in a listing that ends entries with NUL."""
    rest = b""
    while chunk := stream.read(1 << 16):
        *whole, rest = (rest + chunk).split(b"\0")
        for entry in whole:
            about, path = entry.split(b"\t", 1)
            mode, kind, sha = about.split()
            if kind == b"blob":
                yield mode.decode(), sha, path


def _blob(process: subprocess.Popen, sha: bytes) -> bytes:
    process.stdin.write(sha + b"\n")
    process.stdin.flush()
    head = process.stdout.readline().split()
    if len(head) != 3 or head[1] != b"blob":
        raise OSError(f"git has no object {sha.decode()}")
    content = process.stdout.read(int(head[2]))
    process.stdout.read(1)
    return content


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "mode": pa.string(), "sha": pa.string(), "size": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitTree)
