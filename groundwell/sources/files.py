"""Raw files: scanning, missing keys, type detection, decoding, content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import text as T

# --- fixed values: MIME types ------------------------------------------------
PDF = "application/pdf"
TEXT = "text/plain"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content; the glob prunes the listing, the content is read only if asked."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def missing_files(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested keys without an object. The key is gone for good when its store answered, else it may be retried."""
    absent = requested.join(stored.select("key").distinct(), "key", "left_anti")
    reachable = F.coalesce("store_reachable", F.lit(True)) if "store_reachable" in requested.columns else F.lit(True)
    return absent.select(
        "key", F.when(reachable, "FILE_NOT_FOUND").otherwise("OBJECT_STORAGE_FAILED").alias("error_code"),
        (~reachable).alias("retryable"),
    )


def _starts(content: Column, prefix: str) -> Column:
    return F.hex(F.substring(content, 1, len(prefix))) == prefix.encode().hex().upper()


def _holds(content: Column, name: str) -> Column:
    return F.contains(content, F.lit(bytearray(name.encode())))


def _is_docx(content: Column) -> Column:
    return _starts(content, "PK") & _holds(content, "word/document.xml") & _holds(content, "[Content_Types].xml")


def _byte_share(sample: Column, pattern: str) -> Column:
    """Share of the bytes of a sample that match a Latin-1 character class."""
    letters = F.decode(sample, "ISO-8859-1")
    return F.length(F.regexp_replace(letters, f"[^{pattern}]", "")) / F.greatest(F.length(letters), F.lit(1))


def looks_like_text(content: Column) -> Column:
    """Judged by the first 2048 bytes: no NUL, and valid UTF-8 or more than 90 % printable ASCII."""
    sample = F.substring(content, 1, 2048)
    has_nul = F.contains(sample, F.lit(bytearray(b"\x00")))
    valid = F.is_valid_utf8(sample.cast("string"))
    return (F.length(sample) == 0) | (~has_nul & (valid | (_byte_share(sample, r"\t\n\r -~") > 0.9)))


def detect_type(content: Column, mime: Column, key: Column) -> Column:
    """pdf, docx or txt by content; UNSUPPORTED_FILE_TYPE when text was declared to be something else."""
    name = F.lower(key)
    declared_pdf = (mime == PDF) | name.endswith(".pdf")
    declared_docx = (mime == DOCX) | name.endswith(".docx")
    declared_text = (mime == TEXT) | name.endswith(".txt")
    allowed = declared_text | (~declared_pdf & ~declared_docx)
    return (
        F.when(_starts(content, "%PDF-"), "pdf").when(_is_docx(content), "docx")
        .when(allowed & looks_like_text(content), "txt").otherwise("UNSUPPORTED_FILE_TYPE")
    )


def detected_mime(content: Column) -> Column:
    """MIME type from content at upload: few control bytes make a text; null when nothing fits."""
    sample = F.substring(content, 1, 4096)
    nul = F.contains(sample, F.lit(bytearray(b"\x00")))
    suspicious = _byte_share(sample, r"\x01-\x08\x0B\x0C\x0E-\x1F\x7F")
    zip_head = F.hex(F.substring(content, 1, 4)).rlike("^504B0[357]0[468]$")
    return (
        F.when(_starts(content, "%PDF-"), PDF).when(zip_head & _is_docx(content), DOCX)
        .when(~nul & (suspicious < 0.02), TEXT)
    )


def upload_check(content: Column, filename: Column, declared: Column) -> Column:
    """`ok`, or why an upload is refused: extension, content and declared type must agree."""
    extension = F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
    by_extension = F.when(extension == ".pdf", PDF).when(extension == ".txt", TEXT).when(extension == ".docx", DOCX)
    said = F.lower(F.nullif(F.nullif(declared, F.lit("")), F.lit("application/octet-stream")))
    found = detected_mime(content)
    return (
        F.when(by_extension.isNull() | found.isNull(), "unsupported_file_type")
        .when(by_extension != found, "extension_mismatch")
        .when(said.isNotNull() & ~said.isin(PDF, TEXT, DOCX), "unsupported_declared_type")
        .when(said.isNotNull() & (said != found), "declared_type_mismatch").otherwise("ok")
    )


def decode_text(content: Column) -> Column:
    """UTF-8 with or without a byte order mark, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^﻿", "")


def storage_key(kb_id: Column, content: Column, filename: Column) -> Column:
    return F.concat(kb_id, F.lit("/"), F.sha2(content, 256), F.lit("-"), T.safe_filename(filename))
