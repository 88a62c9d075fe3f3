"""Attachment texts: find distinct files, extract each once, hand texts back to notices."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch import fixed_values as fv
from pagewatch.functions.hashing import content_hash
from pagewatch.functions.urls import detect_suffix, is_public_http_url

EXTRACTED_DDL = "url STRING, content_hash STRING, text STRING, error STRING"


def wanted_attachments(notices: DataFrame) -> DataFrame:
    """Every attachment url once, however many notices name it."""
    return (
        notices.select(F.explode("attachment_urls").alias("url"))
        .where(is_public_http_url(F.col("url")))
        .distinct()
    )


def typed_files(files: DataFrame, headers: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files (url, length, content) with their type and, for files over ``max_bytes``, why they are refused.

    A refused file keeps its row and loses its content.
    """
    if headers is None:
        none = F.lit("")
        rows = files.withColumn("suffix", detect_suffix(F.col("url"), none, none))
    else:
        suffix = detect_suffix(F.col("url"), F.col("content_disposition"), F.col("content_type"))
        rows = files.join(headers, "url", "left").withColumn("suffix", suffix).drop("content_disposition", "content_type")
    already = F.col("refused") if "refused" in files.columns else F.lit(None).cast("string")
    if max_bytes is None:
        return rows.withColumn("refused", already)
    large = F.col("length") > max_bytes
    return rows.withColumns(
        {
            "refused": F.coalesce(already, F.when(large, F.format_string(f"%d bytes, over {max_bytes}", "length"))),
            "content": F.when(~large, F.col("content")),
        }
    )


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _open_archive(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def docx_text(content: bytes) -> str:
    with _open_archive(content) as archive:
        document = ElementTree.fromstring(archive.read("word/document.xml"))
    body = next((e for e in document if _local(e.tag) == "body"), ())
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "\n".join(
        "".join((n.text or "") if _local(n.tag) == "t" else marks.get(_local(n.tag), "") for n in p.iter())
        for p in body
        if _local(p.tag) == "p"
    )


def xlsx_text(content: bytes) -> str:
    with _open_archive(content) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(n.text or "" for n in item.iter() if _local(n.tag) == "t"))
        targets = {
            r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/")
            for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        values: list[str] = []
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
            if _local(sheet.tag) != "sheet":
                continue
            relation = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
            for cell in ElementTree.fromstring(archive.read(f"xl/{targets[relation]}")).iter():
                if _local(cell.tag) != "c":
                    continue
                text = "".join(n.text or "" for n in cell.iter() if _local(n.tag) in ("v", "t"))
                if text:
                    values.append(shared[int(text)] if cell.get("t") == "s" else text)
    return "\n".join(values)


class _Lines:
    """Collects the runs of text of each paragraph while a section is read; paragraphs may stand inside paragraphs."""

    def __init__(self) -> None:
        self.lines: list[tuple[int, list[str]]] = []
        self._open: list[list[str]] = []
        self._run: list[str] | None = None

    def start(self, tag: str, _attributes: dict) -> None:
        kind = _local(tag)
        if kind == "p":
            self._open.append([])
            self.lines.append((len(self._open), self._open[-1]))
        self._run = [] if kind == "t" else None

    def data(self, text: str) -> None:
        if self._run is not None:
            self._run.append(text)

    def end(self, tag: str) -> None:
        if self._run is not None and (run := "".join(self._run).strip()):
            # an inner paragraph's text is part of the outer ones too
            for runs in self._open:
                runs.append(run)
        self._run = None
        if _local(tag) == "p":
            self._open.pop()

    def close(self) -> list[str]:
        return [line for _, runs in self.lines if (line := " ".join(runs))]


def hwpx_text(content: bytes) -> str:
    """Text of all sections, read piece by piece; a section that is not sound XML has none."""
    found: list[str] = []
    with _open_archive(content) as archive:
        for name in sorted(archive.namelist()):
            if not (name.startswith("Contents/section") and name.endswith(".xml")):
                continue
            parser = ElementTree.XMLParser(target=_Lines())
            try:
                with archive.open(name) as section:
                    while piece := section.read(1 << 16):
                        parser.feed(piece)
                found += parser.close()
            except ElementTree.ParseError:
                continue
    return "\n".join(found)


CODECS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".xlsx": xlsx_text, ".hwpx": hwpx_text}


def extract_texts(
    files: DataFrame, codecs: dict[str, Callable[[bytes], str]] = CODECS, max_expanded: int | None = None
) -> DataFrame:
    """Text of every file (url, suffix, content); a file without text has the reason in ``error``.

    ``max_expanded`` refuses archives whose entries would take more bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("url", "content_hash", "text", "error")])
        for batch in batches:
            for row in batch.to_pylist():
                text, error = "", row["refused"]
                try:
                    codec = codecs.get(row["suffix"])
                    if error is None and codec is None:
                        error = f"no reader for {row['suffix'] or 'files without a type'}"
                    elif error is None:
                        content = row["content"] or b""
                        if max_expanded is not None:
                            with _open_archive(content) as archive:
                                if (size := sum(e.file_size for e in archive.infolist())) > max_expanded:
                                    raise ValueError(f"{size} bytes when expanded, over {max_expanded}")
                        text = codec(content)
                except Exception as exc:  # one broken file must not fail the job
                    error = f"{type(exc).__name__}: {exc}"
                out = {"url": row["url"], "content_hash": row["content_hash"], "text": text, "error": error}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    refused = F.col("refused") if "refused" in files.columns else F.lit(None).cast("string").alias("refused")
    hashed = files.select("url", "suffix", content_hash(F.col("content")).alias("content_hash"), "content", refused)
    return hashed.mapInArrow(run, EXTRACTED_DDL)


def extract_changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Like ``extract_texts``, but files whose bytes are remembered reuse the remembered text.

    ``known`` holds (url, content_hash, extracted_text), one row per url.
    """
    hashed = files.withColumn("content_hash", content_hash(F.col("content")))
    memory = known.select("url", "content_hash", F.col("extracted_text").alias("text"))
    reused = hashed.select("url", "content_hash").join(memory, ["url", "content_hash"])
    fresh = hashed.join(memory, ["url", "content_hash"], "left_anti")
    return extract_texts(fresh.drop("content_hash")).unionByName(
        reused.withColumn("error", F.lit(None).cast("string"))
    )


def with_attachment_texts(notices: DataFrame, texts: DataFrame, key: str = "seq", keep_blank: bool = False) -> DataFrame:
    """Add ``attachment_texts``: ordered ``array<struct<url,text>>`` of a notice's own attachments.

    The list regrouped per notice is the notice's own array, never more.
    """
    order = notices.select(key, F.posexplode(F.array_distinct("attachment_urls")).alias("pos", "url"))
    # of several texts of one url the longest counts, of equally long ones the last in order
    one = texts.groupBy("url").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    found = order.join(one, "url")
    if not keep_blank:
        found = found.where(F.coalesce("text", F.lit("")) != "")
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "url", "text"))).alias("_found"))
    joined = notices.join(lists, key, "left")
    listed = F.transform("_found", lambda f: F.struct(f["url"].alias("url"), f["text"].alias("text")))
    empty = F.array().cast("array<struct<url:string,text:string>>")
    return joined.withColumn("attachment_texts", F.coalesce(listed, empty)).drop("_found")


def text_sources(body: Column, attachment_texts: Column) -> Column:
    """Body and attachments as named sources, in order."""
    named = lambda name, text: F.struct(name.alias("name"), text.alias("text"))
    return F.concat(
        F.array(named(F.lit(fv.SOURCE_BODY), body)),
        F.transform(
            attachment_texts, lambda a: named(F.concat(F.lit(fv.SOURCE_ATTACHMENT_PREFIX), a["url"]), a["text"])
        ),
    )


def combined_text(sources: Column) -> Column:
    return F.array_join(F.transform(sources, lambda s: s["text"]), "\n")
