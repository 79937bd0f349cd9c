"""Images in packages, mails, notebooks and HTML, by the name that chunks give them."""

from __future__ import annotations

import base64
import email
import email.policy
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.splits import image_name
from .formats import FAMILY, ParseError, decode, extension

#: Where packages keep their images.
FOLDERS = {"docx": "word/media/", "pptx": "ppt/media/", "sheet": ("xl/media/", "Pictures/"), "odf": "Pictures/", "epub": ""}
_DATA_URI = re.compile(r"data:image/(png|jpeg|jpg|gif|webp);base64,([A-Za-z0-9+/=\s]+)", re.IGNORECASE)


def _all_images(data: bytes, name: str) -> Iterator[tuple[str, bytes]]:
    family = FAMILY.get(extension(name))
    if family in FOLDERS:
        try:
            package = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ParseError(f"not a package: {e}") from None
        for part in package.namelist():
            if part.startswith(FOLDERS[family]) and (found := image_name(raw := package.read(part), part)):
                yield (posixpath.basename(part) if family == "epub" else found), raw
    elif family in ("html", "md"):
        for kind, body in _DATA_URI.findall(decode(data)):
            raw = base64.b64decode(body)
            yield image_name(raw, "x." + kind), raw
    elif family == "eml":
        message = email.message_from_bytes(data, policy=email.policy.default)
        for i, part in enumerate(p for p in message.walk() if p.get_content_maintype() == "image"):
            yield part.get_filename() or f"image_{i + 1}.{part.get_content_subtype()}", part.get_payload(decode=True) or b""
    elif family == "ipynb":
        outputs = [o.get("data", {}) for c in json.loads(decode(data)).get("cells", []) for o in c.get("outputs", [])]
        found = [(k.partition("/")[2], v) for o in outputs for k, v in o.items() if k in ("image/png", "image/jpeg", "image/gif")]
        for i, (kind, body) in enumerate(found):
            yield f"output_{i + 1}.{kind}", base64.b64decode("".join(body) if isinstance(body, list) else body)


def list_images(data: bytes, name: str) -> list[tuple[str, bytes]]:
    """(name, bytes) of a file's images, in order; of equal names the first."""
    found: dict[str, bytes] = {}
    for n, raw in _all_images(data, name):
        found.setdefault(n, raw)
    return list(found.items())


def image_files(files: DataFrame, key: str = "path", data: str = "content", name: str = "path") -> DataFrame:
    """key, position, image_name, data and parse_error of the images of a DataFrame of files, next to the scan."""
    from ..operators.documents import _per_file

    fields = [("position", pa.int32(), "int"), ("image_name", pa.string(), "string"), ("data", pa.binary(), "binary")]
    return _per_file(files, key, data, name, lambda raw, file: [(i, n, b) for i, (n, b) in enumerate(list_images(raw, file))] if raw else [], fields)
