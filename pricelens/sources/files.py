"""Documents from files: a loader for each suffix, and a reason for each file that gives no text.

Files are rows of binaryFile; those over a size are told apart by their length, so that their bytes
are never read. One file is one row of a task.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file, and of what a compressed one holds, at most.
MAX_BYTES = 50_000_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def plain(data: bytes, most: int) -> str:
    return data.decode("utf-8-sig")


def docx(data: bytes, most: int) -> str:
    """The paragraphs of a word processor's file, a blank line between them; tabs and breaks as such."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > most:
            raise ValueError("its text is too large")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    return "\n\n".join("".join(marks.get(x.tag, x.text or "" if x.tag == f"{WORD}t" else "") for x in p.iter()) for p in root.iter(f"{WORD}p"))


#: A loader for each suffix; a suffix that is not here is read as plain text, but for those in UNREAD.
LOADERS: dict[str, Callable[[bytes, int], str]] = {".txt": plain, ".md": plain, ".docx": docx}
UNREAD = (".pdf", ".doc")


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, suffix, length, content, reason of every file under path: its text, or why there is none.

    PDF files and the old word processor's have no loader here. A file that is too large, is not UTF-8 or
    is broken gives a reason and stops nothing; an empty one has no row, as the reader passes it over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    told = lambda why: (F.lit(None).cast("string").alias("content"), F.lit(why).alias("reason"))
    large = files.where(F.col("length") > max_bytes).select("path", suffix.alias("suffix"), "length", *told("larger than the bound"))
    small = files.where(F.col("length") <= max_bytes)
    unread = small.where(suffix.isin(*UNREAD)).select("path", suffix.alias("suffix"), "length", *told("no loader for this suffix"))

    def load(batches):
        for batch in batches:
            out = []
            for kind, data in zip(batch["suffix"], batch["content"], strict=True):
                try:
                    out.append((LOADERS.get(kind, plain)(bytes(data), max_bytes), None))
                except Exception as e:  # noqa: BLE001  whatever a broken file brings
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            text, reason = zip(*out, strict=True) if out else ((), ())
            yield pd.DataFrame({"path": batch["path"], "suffix": batch["suffix"], "length": batch["length"], "content": pd.Series(text, dtype=object), "reason": pd.Series(reason, dtype=object)})

    read = small.where(~suffix.isin(*UNREAD)).select("path", suffix.alias("suffix"), "length", "content")
    return read.mapInPandas(load, "path string, suffix string, length long, content string, reason string").unionByName(large).unionByName(unread)


def quarantined(documents: DataFrame) -> DataFrame:
    return documents.where("reason is not null").select("path", "suffix", "length", "reason")
