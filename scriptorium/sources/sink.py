"""Documents and link lists as a Spark data source to write to: all files of a job appear, or none."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import filesystem

FORMAT = "committed_documents"
DRAFTS = ".drafts-"


@dataclass
class Drafted(WriterCommitMessage):
    """A task's folder of drafts: names stay there, so a message is as short for a million files as for one."""

    folder: str
    files: int


class _Writer(DataSourceArrowWriter):
    """Tasks write into folders of their own under ``<folder>/.drafts-<job>``; a commit moves what the tasks that count have written.

    If a move fails, those done are taken back: a new file goes, a file that was replaced is put back.
    """

    def __init__(self, folder: str, kind: str, replace: bool):
        self.folder, self.kind, self.replace, self.job = folder, kind, replace, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafted:
        store, at = filesystem(self.folder)
        own, n = f"{at}/{DRAFTS}{self.job}/{uuid.uuid4().hex}", 0
        for batch in iterator:
            for stem, text in zip(batch.column("stem").to_pylist(), batch.column("text").to_pylist()):
                name = f"{stem}_{self.kind}.md"
                if not self.replace and store.get_file_info(f"{at}/{name}").type.name != "NotFound":
                    continue
                if not n:
                    store.create_dir(own, recursive=True)
                with store.open_output_stream(f"{own}/{name}") as out:
                    out.write(text.encode())
                n += 1
        return Drafted(own, n)

    def commit(self, messages: list[Drafted | None]) -> None:
        from pyarrow import fs

        store, at = filesystem(self.folder)
        old = f"{at}/{DRAFTS}{self.job}/replaced"
        undone: list[tuple[str, str]] = []
        try:
            for message in messages:
                if message is None or not message.files:
                    continue
                for info in store.get_file_info(fs.FileSelector(message.folder)):
                    final = f"{at}/{posixpath.basename(info.path)}"
                    if store.get_file_info(final).type.name != "NotFound":
                        store.create_dir(old, recursive=True)
                        store.move(final, f"{old}/{posixpath.basename(final)}")
                        undone.append((f"{old}/{posixpath.basename(final)}", final))
                    store.move(info.path, final)
                    undone.append((final, info.path))
        except Exception:
            for now, before in reversed(undone):
                store.move(now, before)
            self._clear(store, at)
            raise
        self._clear(store, at)

    def abort(self, messages: list[Drafted | None]) -> None:
        store, at = filesystem(self.folder)
        self._clear(store, at)

    def _clear(self, store, at: str) -> None:
        if store.get_file_info(f"{at}/{DRAFTS}{self.job}").type.name != "NotFound":
            store.delete_dir(f"{at}/{DRAFTS}{self.job}")


class Documents(DataSource):
    """Options: path, a folder that all executors share; kind, raw or refine; replace, whether files that are there are written anew (default false)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "stem string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), self.options.get("kind", "raw"), self.options.get("replace", "false") == "true")


def write_committed(docs: DataFrame, folder: str, *, kind: str = "raw", stem: str = "stem", text: str = "text", overwrite: bool = False) -> None:
    """Each document as its own file ``<stem>_<kind>.md`` in ``folder``: if the job fails, no file is new or other than before.

    Cases are those of ``files.write_documents``: files that are there stay unless ``overwrite``, of a repeated stem the text that sorts first counts, null
    stems are left out, null texts are empty files.
    """
    docs.sparkSession.dataSource.register(Documents)
    own = docs.where(F.col(stem).isNotNull()).groupBy(F.col(stem).alias("stem")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    own.write.format(FORMAT).mode("append").option("path", folder).option("kind", kind).option("replace", str(overwrite).lower()).save()
