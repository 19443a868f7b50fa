"""Reports on documents as JSON and text, and files written from binary columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.formats import inspection
from quire.formats.errors import FormatError, Limits
from quire.operators.documents import detect_format, each_document


def inspections(files: DataFrame, *, bookmarks: bool = False, pages: bool = False, limits: Limits = Limits()) -> DataFrame:
    """``path, json, text, error``: both reports on each file; a file of unknown format is an error."""

    def kernel(data, name):
        if name is None:
            raise FormatError("UnsupportedFormat")
        found = inspection.read(data, name, limits, pages=pages)
        yield {"json": inspection.as_json(found, bookmarks=bookmarks, pages=pages), "text": inspection.as_text(found, bookmarks=bookmarks, pages=pages)}

    named = files.select("path", "content", detect_format(F.col("content")).alias("format"))
    return each_document(named, kernel, "json string, text string", more=["format"])


def write_files(rows: DataFrame, content: str, uri: str, suffix: str, *, keep_errors: bool = False, overwrite: bool = False) -> DataFrame:
    """A file for each row (path, content) in the shared folder ``uri``; ``path, written, bytes``.

    Rows without content are left out, or kept with their ``error`` as text if ``keep_errors``.

    Names come from a hash of the source's path, so no output can replace an input; a file
    appears by renaming a whole one. A file that is there already stays: if it holds the same bytes
    the row counts as written, so a task may run twice, and else it is an error unless ``overwrite``.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for path, body, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = body.as_py()
                if body is None:
                    if keep_errors:
                        done.append((path, None, None, error or "no content"))
                    continue
                name = f"{root}/{hashlib.sha256(path.encode()).hexdigest()[:32]}{suffix}"
                if not overwrite and fs.get_file_info(name).type != pafs.FileType.NotFound:
                    with fs.open_input_stream(name) as there:
                        if there.read() != body:
                            if keep_errors:
                                done.append((path, None, None, "output exists"))
                                continue
                            raise FileExistsError(name)
                    done.append((path, name, len(body), None))
                    continue
                with fs.open_output_stream(part := f"{name}.{TaskContext.get().taskAttemptId()}.tmp") as out:
                    out.write(body)
                fs.move(part, name)
                done.append((path, name, len(body), None))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], ["path", "written", "bytes", "error"])

    kind = dict(rows.dtypes).get("error")
    error = F.lit(None).cast("string") if kind is None else F.col("error") if kind == "string" else F.col("error.message")
    wrote = rows.select("path", content, error.alias("error")).mapInArrow(run, "path string, written string, bytes long, error string")
    return wrote if keep_errors else wrote.drop("error")
