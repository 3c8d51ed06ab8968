"""Mail files as rows: RFC 5322 messages from any file system Spark reads, parsed in Arrow batches with the standard library."""

from __future__ import annotations

import email
import email.policy
import hashlib
from collections.abc import Iterator
from datetime import timezone
from email.message import EmailMessage
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

SCHEMA = "path string, message_id string, in_reply_to string, ref_ids array<string>, from_addr string, to_addrs array<string>, cc_addrs array<string>, subject string, sent timestamp, content_type string, body string, body_type string, attachments array<struct<name: string, type: string, size: bigint, sha256: string>>"


def parts(message: EmailMessage) -> tuple[EmailMessage | None, list[EmailMessage]]:
    """The body part that reads best, and the attachments.

    Of an alternative's versions the first plain one is the body, else the
    first HTML one; the others are neither. In a related container the first
    part is the body, what it shows besides is attached. Elsewhere text without
    a file name that is not disposed as an attachment goes to the body, and
    only its first part is it; the rest is attached. A digest's messages are
    attachments.
    """
    texts: list[EmailMessage] = []
    attached: list[EmailMessage] = []

    def is_text(p: EmailMessage) -> bool:
        return p.get_content_type() in ("text/plain", "text/html") and p.get_content_disposition() != "attachment"

    def sort(p: EmailMessage, container: str, first: bool) -> None:
        if p.get_content_type() == "message/rfc822" or not p.is_multipart():
            named = bool(p.get_filename())
            inline = is_text(p) and (first or container != "related") and (first or not named) and not (container == "digest")
            (texts if inline and not (named and container == "mixed") else attached).append(p)
            return
        kind = p.get_content_subtype()
        children = list(p.iter_parts())
        if kind == "alternative":
            versions = [leaf for c in children for leaf in _leaves(c) if is_text(leaf)]
            best = next((v for v in versions if v.get_content_type() == "text/plain"), versions[0] if versions else None)
            if best is not None:
                texts.append(best)
            attached.extend(leaf for c in children for leaf in _leaves(c) if not is_text(leaf))
            return
        for k, c in enumerate(children):
            sort(c, kind if kind in ("related", "digest") else "mixed", k == 0 and kind == "related")

    sort(message, "message", not message.is_multipart())
    return (texts[0] if texts else None), attached + texts[1:]


def _leaves(p: EmailMessage) -> Iterator[EmailMessage]:
    if p.is_multipart() and p.get_content_type() != "message/rfc822":
        for c in p.iter_parts():
            yield from _leaves(c)
    else:
        yield p


def row(path: str, raw: bytes) -> tuple:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body, attached = parts(m)
    people = lambda k: [a for _, a in getaddresses([str(v) for v in m.get_all(k, [])]) if a]
    try:
        sent = parsedate_to_datetime(str(m["date"])).astimezone(timezone.utc)
    except (TypeError, ValueError):
        sent = None
    files = []
    for p in attached:
        data = p.get_payload(decode=True) or b""
        files.append((p.get_filename(), p.get_content_type(), len(data), hashlib.sha256(data).hexdigest()))
    text = lambda k: str(m[k]) if m[k] is not None else None
    return (
        path, text("message-id"), text("in-reply-to"), str(m.get("references", "")).split(), text("from"), people("to"), people("cc"), text("subject"), sent, m.get_content_type(),
        body.get_content() if body is not None else None, body.get_content_type() if body is not None else None, files,
    )


def _parser(fields: list[StructField]):
    """mapInArrow function: a row for each file."""
    schema = to_arrow_schema(StructType(fields))
    kinds = [f.dataType.elementType.names if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType) else None for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(path, content) for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) if content is not None]
            columns = [[[dict(zip(k, x)) for x in r[i]] if k and r[i] is not None else r[i] for r in rows] for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema.names)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """The messages of ``*.eml`` files in and below a folder; many small files share a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parser(StructType.fromDDL(SCHEMA).fields), SCHEMA)
