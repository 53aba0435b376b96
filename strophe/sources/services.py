"""Remote services as Spark data sources, with an offline stand-in.

A service is a class with submit, status and lyrics; `SongService` is what tests and offline runs use.
Reading the source submits one task for each row of a song range and gives its final state; ranges
are partitions, so a lost executor repeats its range only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FINAL = ("succeeded", "failed")


class SongService:
    """Deterministic stand-in of a song service: a task ends after a few polls, every seventh fails."""

    def submit(self, song: int) -> str:
        return f"task-{song:06d}"

    def status(self, task: str, polls: int) -> str:
        n = int(task.rpartition("-")[2])
        return "running" if polls <= n % 3 else FINAL[n % 7 == 6]

    def lyrics(self, task: str) -> str:
        return f"[00:10.00]line of {task}"


def finish(service: SongService, task: str, most_polls: int = 60, retries: int = 3) -> tuple[str, int]:
    """Polls until the task ends; what raises is tried again, at most `retries` times in a row."""
    errors = 0
    for polls in range(1, most_polls + 1):
        try:
            state, errors = service.status(task, polls), 0
        except OSError:
            errors += 1
            if errors > retries:
                return "failed", polls
            continue
        if state in FINAL:
            return state, polls
    return "timeout", most_polls


class Songs(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.n, self.parts = int(options.get("songs", "0")), int(options.get("partitions", "4"))

    def partitions(self) -> list[Songs]:
        each = -(-self.n // self.parts) if self.n else 0
        return [Songs(i, min(self.n, i + each)) for i in range(0, self.n, each)] if each else [Songs(0, 0)]

    def read(self, partition: Songs) -> Iterator[tuple]:
        service = SongService()
        for song in range(partition.first, partition.last):
            task = service.submit(song)
            state, polls = finish(service, task)
            yield song, task, state, polls, service.lyrics(task) if state == "succeeded" else None


class SongSource(DataSource):
    """`spark.dataSource.register(SongSource)`, then `spark.read.format("song_service").option("songs", n)`."""

    @classmethod
    def name(cls) -> str:
        return "song_service"

    def schema(self) -> str:
        return "song long, task_id string, state string, poll_count int, lyrics string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
