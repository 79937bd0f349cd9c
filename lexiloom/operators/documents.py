"""Chunking of whole files: one at a time for the API, in Arrow batches next to the scan for DataFrames."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.formats import FAMILY, Loaded, UnsupportedFormat, extension, load, pdf_blocks
from . import grid, prose
from .word import word_structural

MODES = ("default", "structural", "section", "semantic", "sentence", "sliding_window", "page_aware")
SHEET_MODES = ("default", "row", "table", "sheet", *MODES[1:])
OPTIONS = {"window_size": 3, "overlap": 1, "sentences_per_chunk": 3, "paragraphs_per_page": 15}


def validate(mode: str, window_size: int = 3, overlap: int = 1, sentences_per_chunk: int = 3, paragraphs_per_page: int = 15) -> None:
    if mode not in SHEET_MODES:
        raise ValueError(f"mode must be one of {', '.join(map(repr, SHEET_MODES))}, got {mode!r}")
    for name, value in (("window_size", window_size), ("sentences_per_chunk", sentences_per_chunk), ("paragraphs_per_page", paragraphs_per_page)):
        if value <= 0:
            raise ValueError(f"{name} must be greater than 0")
    if overlap < 0 or overlap >= window_size:
        raise ValueError("overlap must be less than window_size")


def chunk_loaded(doc: Loaded, name: str, mode: str = "default", *, window_size: int = 3, overlap: int = 1, sentences_per_chunk: int = 3, paragraphs_per_page: int = 15, delimiter: str | None = None, encoding: str = "auto") -> list[dict]:
    ext = extension(name)
    family = FAMILY[ext]
    if family == "csv":
        per = paragraphs_per_page if mode == "page_aware" else max(1, sentences_per_chunk)
        return grid.csv_chunks(doc.text, "sliding_window" if mode == "sliding_window" else "row", per, window_size, overlap, delimiter="\t" if ext == "tsv" else delimiter, encoding=encoding)
    if doc.sheets is not None:
        per = 1 if sentences_per_chunk == OPTIONS["sentences_per_chunk"] else sentences_per_chunk
        return grid.sheet_chunks(doc.sheets, "row" if mode == "sentence" else mode, per, window_size, overlap, marks=doc.marks)
    more = {"sentence": {"sentences_per_chunk": sentences_per_chunk}, "sliding_window": {"window_size": window_size, "overlap": overlap}, "page_aware": {"paragraphs_per_page": paragraphs_per_page}}
    if mode not in prose.MODES:
        raise ValueError(f"mode {mode!r} is only for spreadsheets")
    if doc.word is not None and prose.MODES[mode] is prose.structural:
        return word_structural(doc.word)
    run = lambda blocks: prose.MODES[mode](blocks, doc.style, **more.get(mode, {}))
    if not doc.starts:
        return run(doc.blocks)
    # every record, message, slide or chapter is chunked by itself and keeps its facts
    first = [s for s, _ in doc.starts]
    out = run(doc.blocks[: first[0]])
    for (a, facts), b in zip(doc.starts, [*first[1:], len(doc.blocks)], strict=True):
        for c in run(doc.blocks[a:b]):
            out.append(c | {"metadata": c["metadata"] | facts})
    for i, c in enumerate(out):
        if "chunk_index" in c["metadata"]:
            c["metadata"]["chunk_index"] = i
    return out


def owner(starts: list[int], block: int) -> int:
    """The record that a block belongs to: the last that starts at or before it; -1 before the first."""
    return bisect.bisect_right(starts, block) - 1


def chunk_bytes(data: bytes, name: str, mode: str = "default", **options) -> list[dict]:
    validate(mode, **{k: v for k, v in options.items() if k in OPTIONS})
    if mode == "default" and extension(name) == "pdf":
        return list(stream_bytes(data, name, mode, **options))
    return chunk_loaded(load(name, data, options.get("encoding") or "auto"), name, mode, **options)


def stream_bytes(data: bytes, name: str, mode: str = "default", **options) -> Iterator[dict]:
    """chunk_bytes, one by one. In the default mode of PDFs a page is read when its chunks are asked for, and headings are ranked within it."""
    if mode != "default" or extension(name) != "pdf":
        yield from chunk_bytes(data, name, mode, **options)
        return
    validate(mode, **{k: v for k, v in options.items() if k in OPTIONS})
    yield from prose.structural_chunks(*pdf_blocks(data))


#: Bytes of input a core below which a table is dealt out anew before it is parsed: its scan has fewer tasks than there are cores.
SPREAD_BYTES = 32 << 20
#: Characters of output that are sent on at once.
BATCH_CHARS = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, a small one over all cores: one shuffle of at most SPREAD_BYTES a core; larger ones, and streams, stay as they are scanned."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def _per_file(files: DataFrame, key: str, data: str, name: str, fn, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """fn(bytes, name) gives rows of fields; a file that can't be read gives one row with parse_error."""
    source = spread(files.select(F.col(key).alias("k"), F.col(data).cast("binary").alias("d"), F.col(name).alias("n")))

    def parsed(batch):
        rows: list[tuple] = []
        at: list[int] = []
        errors: list[str | None] = []
        held = 0

        def out():
            columns = [pa.array(v, t) for v, (_, t, _) in zip(zip(*rows, strict=True), fields, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns, pa.array(errors, pa.string())], names=[key, *(f for f, _, _ in fields), "parse_error"])

        for i in range(batch.num_rows):  # one file parsed at a time
            raw, file = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            try:
                found, error = fn(raw or b"", file or ""), None
            except Exception as e:  # noqa: BLE001  a broken file must not end the job
                found, error = [(None,) * len(fields)], f"{type(e).__name__}: {e}"
            rows += found
            at += [i] * len(found)
            errors += [error] * len(found)
            held += sum(len(v) for row in found for v in row if isinstance(v, str))
            if held > BATCH_CHARS:
                yield out()
                rows, at, errors, held = [], [], [], 0
        if rows:
            yield out()

    def run(batches):
        for parts in map(parsed, batches):  # a batch is let go before the next is read
            yield from parts
            pa.default_memory_pool().release_unused()

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{f} {t}" for f, _, t in fields), "parse_error string"]))


CHUNKS = [("chunk_index", pa.int32(), "int"), ("content_type", pa.string(), "string"), ("content", pa.string(), "string"), ("metadata", pa.string(), "string")]


def chunk_files(files: DataFrame, mode: str = "default", key: str = "path", data: str = "content", name: str = "path", **options) -> DataFrame:
    """Chunks of a DataFrame of files (as the binaryFile source gives them): key, chunk_index, content_type, content,
    metadata (JSON) and parse_error. Only small inputs are dealt out anew; a null or empty file has no chunks."""
    validate(mode, **{k: v for k, v in options.items() if k in OPTIONS})

    def fn(raw: bytes, file: str) -> list[tuple]:
        return [(i, c["content_type"], c["content"], json.dumps(c["metadata"], ensure_ascii=False)) for i, c in enumerate(chunk_bytes(raw, file, mode, **options) if raw else [])]

    return _per_file(files, key, data, name, fn, CHUNKS)


def chunk_texts(docs: DataFrame, mode: str = "default", text: str = "text", key: str = "doc_id", format: str = "txt", **options) -> DataFrame:  # noqa: A002
    """chunk_files over a column of texts of one format."""
    if format not in FAMILY:
        raise UnsupportedFormat(f"unsupported file extension: .{format}")
    named = docs.select(F.col(key), F.encode(F.col(text), "UTF-8").alias("__data"), F.lit(f"x.{format}").alias("__name"))
    return chunk_files(named, mode, key, "__data", "__name", **options)


def blocks_of(docs: DataFrame, text: str = "text", key: str = "doc_id", format: str = "txt") -> DataFrame:  # noqa: A002
    """key, block_index, block_type, content and level of each block."""
    named = docs.select(F.col(key), F.encode(F.col(text), "UTF-8").alias("__data"), F.lit(f"x.{format}").alias("__name"))
    fields = [("block_index", pa.int32(), "int"), ("block_type", pa.string(), "string"), ("content", pa.string(), "string"), ("level", pa.int32(), "int")]
    return _per_file(named, key, "__data", "__name", lambda raw, file: [(i, b.type, b.content, b.level) for i, b in enumerate(load(file, raw).blocks)], fields).drop("parse_error")


def markdown_files(files: DataFrame, key: str = "path", data: str = "content", name: str = "path") -> DataFrame:
    """key, markdown, parse_error of each file."""

    def fn(raw: bytes, file: str) -> list[tuple]:
        return [(markdown_of(raw, file),)]

    return _per_file(files, key, data, name, fn, [("markdown", pa.string(), "string")])


def markdown_of(data: bytes, name: str) -> str:
    if FAMILY.get(extension(name)) == "csv":
        header, rows, _, _ = grid.csv_rows(load(name, data).text, "\t" if extension(name) == "tsv" else None)
        return grid.table_markdown(header, rows)
    return load(name, data).text
