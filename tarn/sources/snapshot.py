"""The binary snapshot of documents, for interchange: a codec over bytes."""

from __future__ import annotations

import struct
from typing import NamedTuple

MAGIC = b"TARNSN"
VERSION = 1
MAX_DOCUMENTS = 10_000_000


class Document(NamedTuple):
    url: str
    title: str = ""
    snippet: str = ""
    content: str = ""
    source: str = "clearweb"
    depth: int = 0


class SnapshotError(ValueError):
    """The bytes are no snapshot, or not a whole one."""


def serialize(documents: list[Document]) -> bytes:
    """magic, u32 version, u32 count; per document four u32-prefixed strings, u8 source, u32 depth."""
    out = [MAGIC, struct.pack("<II", VERSION, len(documents))]
    for d in documents:
        for text in (d.url, d.title, d.snippet, d.content):
            data = (text or "").encode("utf-8", "surrogatepass")
            out += [struct.pack("<I", len(data)), data]
        out.append(struct.pack("<BI", 1 if d.source == "onion" else 0, d.depth or 0))
    return b"".join(out)


def deserialize(data: bytes) -> list[Document]:
    """The documents; trailing bytes are ignored, an unknown source is clearweb."""
    if data[: len(MAGIC)] != MAGIC:
        raise SnapshotError("bad magic")
    at = len(MAGIC)

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise SnapshotError("truncated")
        values = struct.unpack_from(form, data, at)
        at += size
        return values

    version, count = take("<II")
    if version != VERSION:
        raise SnapshotError("unsupported version")
    if count > MAX_DOCUMENTS:
        raise SnapshotError("implausible document count")
    out = []
    for _ in range(count):
        texts = []
        for _ in range(4):
            (size,) = take("<I")
            if at + size > len(data):
                raise SnapshotError("truncated")
            texts.append(data[at : at + size].decode("utf-8", "replace"))
            at += size
        source, depth = take("<BI")
        out.append(Document(*texts, "onion" if source == 1 else "clearweb", depth))
    return out
