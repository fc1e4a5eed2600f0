"""What is refused before it is parsed: size, number, signature, archives that explode.

Refusals are rows: an error code, its layer and its status, never a failed job.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT, Config

#: Error codes with layer and HTTP status.
ERRORS = {
    "INFRA_UNSUPPORTED_FORMAT": ("infra", 400), "INFRA_UNAUTHORIZED": ("infra", 401), "INFRA_FORBIDDEN": ("infra", 403), "INFRA_FILE_TOO_LARGE": ("infra", 413),
    "INFRA_TOO_MANY_FILES": ("infra", 413), "INFRA_CORRUPT_FILE": ("infra", 422), "INFRA_PASSWORD_PROTECTED": ("infra", 422), "INFRA_RATE_LIMITED": ("infra", 429),
    "DOMAIN_MARKDOWN_SYNTAX": ("domain", 500), "DOMAIN_STRUCTURE_MAPPING": ("domain", 500),
}
#: First bytes.
PDF, ZIPS = "25504446", ("504B0304", "504B0506", "504B0708")


def extension_of(path: Column) -> Column:
    """The last suffix of the file name, lower-cased; '' for none."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def format_of(extension: Column) -> Column:
    """The reader of an extension; null for none."""
    return F.when(extension.isin(".html", ".htm"), "html").when(extension.isin(".csv", ".tsv"), "csv").when(extension == ".md", "markdown").when(extension == ".txt", "text").when(extension.isin(".pdf", ".docx", ".pptx", ".xlsx"), F.substring(extension, 2, 4))


def too_large(length: Column, config: Config = DEFAULT) -> Column:
    """A plain comparison: on ``binaryFile`` it is pushed down, and content is never read."""
    return length > config.max_file_size_bytes


def request_limits(files: DataFrame, request: str, order: str, length: str, config: Config = DEFAULT) -> DataFrame:
    """``files`` with n_files, running bytes and error_code of each request."""
    w = Window.partitionBy(request)
    out = files.withColumn("n_files", F.count(F.lit(1)).over(w)).withColumn("total_bytes", F.sum(length).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    code = F.when(F.col("n_files") > config.max_files, "INFRA_TOO_MANY_FILES").when(too_large(F.col(length), config) | (F.col("total_bytes") > config.max_total_bytes), "INFRA_FILE_TOO_LARGE")
    return out.withColumn("error_code", code)


def bad_signature(content: Column, extension: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return ((extension == ".pdf") & (head != PDF)) | (extension.isin(".docx", ".pptx", ".xlsx") & ~head.isin(*ZIPS))


def zip_index(content: Column) -> Column:
    """Sums over an archive's index; nothing is unpacked. Nulls for what is no archive."""

    @F.pandas_udf("entries long, uncompressed long, compressed long")
    def index(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                files = zipfile.ZipFile(io.BytesIO(data)).infolist()
                out.append((len(files), sum(f.file_size for f in files), sum(f.compress_size for f in files)))
            except Exception:  # whatever breaks here, the file is no archive
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["entries", "uncompressed", "compressed"], dtype="Int64")

    return index(content)


def zip_verdict(index: Column, config: Config = DEFAULT) -> Column:
    ratio = (index["compressed"] > 4096) & (index["uncompressed"] > config.zip_max_ratio * index["compressed"])
    return F.when(index["entries"].isNull(), "INFRA_CORRUPT_FILE").when((index["entries"] > config.zip_max_entries) | (index["uncompressed"] > config.zip_max_uncompressed_bytes) | ratio, "INFRA_FILE_TOO_LARGE")


def error_columns(code: Column) -> list[Column]:
    """error_code, error_layer and http_status."""
    layers = F.create_map(*[x for k, (layer, _) in ERRORS.items() for x in (F.lit(k), F.lit(layer))])
    status = F.create_map(*[x for k, (_, s) in ERRORS.items() for x in (F.lit(k), F.lit(s))])
    return [code.alias("error_code"), F.try_element_at(layers, code).alias("error_layer"), F.try_element_at(status, code).alias("http_status")]


def client_ip(forwarded: Column, remote: Column) -> Column:
    """The first address that was forwarded, else the peer's."""
    first = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.when(first != "", first).otherwise(remote)


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    """Requests without origin pass; '*' allows all."""
    if "*" in allowed:
        return F.lit(True)
    return F.coalesce(F.regexp_replace(origin, r"/+$", "").isin([a.rstrip("/") for a in allowed]), F.lit(True))


def key_matches(given: Column, key: str) -> Column:
    """Compared by digest, so that its time tells nothing; without a key all pass."""
    return F.lit(True) if not key else F.coalesce(F.sha2(given, 256) == F.sha2(F.lit(key), 256), F.lit(False))


def safe_stem(name: Column) -> Column:
    """A file name's stem without control characters, quotes and slashes; never empty."""
    plain = F.regexp_replace(F.regexp_replace(name, r'[\r\n"\\/\x00-\x1f\x7f]', ""), r"\.[^.]*$", "")
    stem = F.regexp_replace(plain, r"^[\s.]+|[\s.]+$", "")
    return F.when(stem == "", "documento").otherwise(stem)


def content_disposition(stem: Column, suffix: str = ".md") -> Column:
    ascii_ = F.regexp_replace(stem, r"[^\x20-\x7E]", "_")
    quoted = F.replace(F.url_encode(F.concat(stem, F.lit(suffix))), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit('attachment; filename="'), ascii_, F.lit(suffix + "\"; filename*=UTF-8''"), quoted)
