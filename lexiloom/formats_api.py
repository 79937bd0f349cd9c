"""One call for each family of files, with the options of that family: chunks and what they took, or a stream of them."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from .operators import grid
from .operators.documents import MODES, chunk_loaded, stream_bytes, validate
from .sources.formats import FAMILIES, FAMILY, Loaded, UnsupportedFormat, extension, load


def _options_of_sheets(mode: str, rows_per_chunk: int, window_size: int, overlap: int) -> None:
    if rows_per_chunk < 1:
        raise ValueError("rows_per_chunk must be greater than 0")
    if mode == "sliding_window":
        validate(mode, window_size, overlap)


def _csv(doc: Loaded, name: str, mode: str = "row", rows_per_chunk: int = 10, window_size: int = 5, overlap: int = 1, include_headers: bool = True, delimiter: str | None = None, encoding: str = "auto", skip_empty_rows: bool = True) -> list[dict]:
    _options_of_sheets(mode, rows_per_chunk, window_size, overlap)
    if mode not in ("row", "sliding_window"):
        raise ValueError(f"mode must be 'row' or 'sliding_window', got {mode!r}")
    return grid.csv_chunks(doc.text, mode, rows_per_chunk, window_size, overlap, include_headers, "\t" if extension(name) == "tsv" else delimiter, encoding, skip_empty_rows)


def _sheet(doc: Loaded, name: str, mode: str = "row", rows_per_chunk: int = 1, window_size: int = 3, overlap: int = 1, sheet_names: list[str] | None = None, serialize_as: str = "key_value", max_chunk_chars: int = grid.SHEET_MAX) -> list[dict]:
    _options_of_sheets(mode, rows_per_chunk, window_size, overlap)
    if serialize_as not in ("key_value", "values"):
        raise ValueError(f"serialize_as must be 'key_value' or 'values', got {serialize_as!r}")
    return grid.sheet_chunks(doc.sheets or [], mode, rows_per_chunk, window_size, overlap, sheet_names, serialize_as, max_chunk_chars, doc.marks)


def _prose(doc: Loaded, name: str, mode: str = "default", **options) -> list[dict]:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(map(repr, MODES))}, got {mode!r}")
    validate(mode, **options)
    return chunk_loaded(doc, name, mode, **options)


def _call(family: str) -> tuple[Callable, Callable]:
    chunk = {"csv": _csv, "sheet": _sheet}.get(family, _prose)

    def chunks(path: str | os.PathLike, mode: str | None = None, **options) -> tuple[list[dict], dict[str, float]]:
        name = os.fspath(path)
        if FAMILY.get(extension(name)) != family:
            raise UnsupportedFormat(f"unsupported file extension: .{extension(name)}")
        began = time.perf_counter()
        with open(name, "rb") as f:
            data = f.read()
        lazy = family == "pdf" and mode in (None, "default")  # read while it is chunked
        doc = None if lazy else load(name, data, options.get("encoding", "auto"))
        read = time.perf_counter()
        out = list(stream_bytes(data, name, "default", **options)) if lazy else chunk(doc, name, **({"mode": mode} if mode else {}), **options)
        return out, {"read_ms": 1000 * (read - began), "chunk_ms": 1000 * (time.perf_counter() - read)}

    def stream(path: str | os.PathLike, mode: str | None = None, **options) -> Iterator[dict]:
        name = os.fspath(path)
        if family == "pdf" and extension(name) == "pdf" and mode in (None, "default"):
            with open(name, "rb") as f:
                yield from stream_bytes(f.read(), name, "default", **options)
        else:
            yield from chunks(path, mode, **options)[0]

    chunks.__name__, stream.__name__ = f"chunk_{family}", f"stream_chunk_{family}"
    chunks.__doc__ = f"Chunks of a {family} file ({', '.join(FAMILIES[family])}) and the milliseconds that reading and chunking took."
    stream.__doc__ = f"The chunks of a {family} file, one by one."
    return chunks, stream


#: chunk_<family> and stream_chunk_<family> by name.
CALLS = {f.__name__: f for family in FAMILIES for f in _call(family)}
globals().update(CALLS)
__all__ = sorted(CALLS)


def stream_csv(lines: Iterator[str], rows_per_chunk: int = 10, delimiter: str | None = None, include_headers: bool = True) -> Iterator[dict]:
    """Row groups of delimited lines as they come: only the rows the header vote looks at, and one group, are held.

    Equal to the batch result on the same lines.
    """
    import csv
    import itertools

    lines = iter(lines)
    ahead: list[str] = []
    for line in lines:  # up to the line by which the delimiter is told
        ahead.append(line)
        if line.strip() and not line.lstrip().startswith("#"):
            break
    found = delimiter or grid.sniff_delimiter("".join(ahead))
    rows = (r for r in csv.reader(itertools.chain(ahead, lines), delimiter=found) if any(c.strip() for c in r))
    head = list(itertools.islice(rows, 21))
    own = bool(head) and grid.has_header(head[0], head[1:])
    header = head[0] if own else [f"Column {i + 1}" for i in range(len(head[0]) if head else 0)]
    data = itertools.chain(head[own:], rows)
    widest, at, i = len(header), 0, 0
    while part := list(itertools.islice(data, rows_per_chunk)):
        widest = max(widest, *map(len, part))
        names = grid.names(header, widest)
        content = "\n".join(grid.render(r, names, include_headers) for r in part)
        facts = {"row_start": at + 1, "row_end": at + len(part), "row_count": len(part), "header_row": names, "has_header": own, "col_count": widest, "delimiter_detected": found, "encoding": "auto", "chunk_index": i}
        yield {"content_type": "row_group", "content": content, "metadata": facts}
        at, i = at + len(part), i + 1
