"""Calls for one file, and for folders of files with Spark."""

from __future__ import annotations

import os
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .operators.documents import OPTIONS, chunk_bytes, chunk_files, chunk_loaded, markdown_files, markdown_of, stream_bytes, validate
from .operators.fit import fit_tokens
from .sources.formats import of_pdf_markdown

__all__ = [
    "chunk_pdf_markdown", "fit_tokens", "get_chunks", "get_chunks_from_bytes", "get_chunks_from_fileobj", "get_chunks_from_path", "get_chunks_from_s3_presigned_url", "get_chunks_from_upload", "get_markdown", "markdown_folder", "read_chunks",
    "stream_chunks", "stream_chunks_from_bytes", "stream_chunks_from_fileobj", "stream_chunks_from_path", "stream_chunks_from_s3_presigned_url", "stream_chunks_from_upload",
]


def get_chunks_from_bytes(data: bytes, filename: str, mode: str = "default", **options) -> list[dict]:
    if not data:
        raise ValueError("data is empty")
    return chunk_bytes(data, filename, mode, **options)


def get_chunks_from_path(path: str | os.PathLike, mode: str = "default", **options) -> list[dict]:
    with open(path, "rb") as f:
        return chunk_bytes(f.read(), os.fspath(path), mode, **options)


def _read(file) -> bytes:
    data = file.read()
    return data.encode() if isinstance(data, str) else data


def get_chunks_from_fileobj(file, filename: str, mode: str = "default", **options) -> list[dict]:
    return get_chunks_from_bytes(_read(file), filename, mode, **options)


def get_chunks_from_upload(upload, mode: str = "default", **options) -> list[dict]:
    """upload: an object with filename, and read() or file.read()."""
    return get_chunks_from_fileobj(getattr(upload, "file", upload), upload.filename, mode, **options)


def get_chunks_from_s3_presigned_url(url: str, mode: str = "default", timeout: float = 60, **options) -> list[dict]:
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError("url must begin with http:// or https://")
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        return get_chunks_from_bytes(answer.read(), urllib.parse.unquote(parts.path), mode, **options)


def get_chunks(source, *, filename: str | None = None, mode: str = "default", **options) -> list[dict]:
    """Chunks ({content_type, content, metadata}) of a path, URL, bytes, file object or upload."""
    if isinstance(source, (bytes, bytearray)):
        if not filename:
            raise ValueError("filename is required for bytes")
        return get_chunks_from_bytes(bytes(source), filename, mode, **options)
    if isinstance(source, (str, os.PathLike)):
        text = os.fspath(source)
        return get_chunks_from_s3_presigned_url(text, mode, **options) if text.startswith(("http://", "https://")) else get_chunks_from_path(text, mode, **options)
    if hasattr(source, "filename"):
        return get_chunks_from_upload(source, mode, **options)
    if not filename:
        raise ValueError("filename is required for file objects")
    return get_chunks_from_fileobj(source, filename, mode, **options)


def chunk_pdf_markdown(markdown: str, total_pages: int, mode: str = "default", **options) -> list[dict]:
    """Chunks of a PDF that another parser has turned into Markdown."""
    validate(mode, **{k: v for k, v in options.items() if k in OPTIONS})
    return chunk_loaded(of_pdf_markdown(markdown, total_pages), "x.pdf", mode, **options)


def stream_chunks(source, *, filename: str | None = None, mode: str = "default", **options) -> Iterator[dict]:
    """The chunks of get_chunks as they come: a PDF's default mode reads a page at a time."""
    if isinstance(source, (str, os.PathLike)) and not os.fspath(source).startswith(("http://", "https://")):
        yield from stream_chunks_from_path(source, mode, **options)
    elif isinstance(source, (bytes, bytearray)) and filename:
        yield from stream_chunks_from_bytes(bytes(source), filename, mode, **options)
    else:
        yield from get_chunks(source, filename=filename, mode=mode, **options)


def stream_chunks_from_path(path, mode: str = "default", **options) -> Iterator[dict]:
    with open(path, "rb") as f:
        data = f.read()
    yield from stream_bytes(data, os.fspath(path), mode, **options)


def stream_chunks_from_bytes(data: bytes, filename: str, mode: str = "default", **options) -> Iterator[dict]:
    if not data:
        raise ValueError("data is empty")
    yield from stream_bytes(data, filename, mode, **options)


def stream_chunks_from_fileobj(file, filename: str, mode: str = "default", **options) -> Iterator[dict]:
    yield from stream_chunks_from_bytes(_read(file), filename, mode, **options)


def stream_chunks_from_upload(upload, mode: str = "default", **options) -> Iterator[dict]:
    yield from get_chunks_from_upload(upload, mode, **options)


def stream_chunks_from_s3_presigned_url(url: str, mode: str = "default", **options) -> Iterator[dict]:
    yield from get_chunks_from_s3_presigned_url(url, mode, **options)


def get_markdown(source, *, filename: str | None = None) -> str:
    """A file as Markdown; no URLs."""
    if isinstance(source, (bytes, bytearray)):
        return markdown_of(bytes(source), filename or "")
    if isinstance(source, (str, os.PathLike)):
        with open(source, "rb") as f:
            return markdown_of(f.read(), os.fspath(source))
    file = getattr(source, "file", source)
    return markdown_of(_read(file), filename or getattr(source, "filename", ""))


def read_chunks(spark: SparkSession, folder: str, mode: str = "default", glob: str = "*", **options) -> DataFrame:
    """Chunks of every file in a folder of any store that Spark reads."""
    return chunk_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder), mode, **options)


def markdown_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return markdown_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder))
