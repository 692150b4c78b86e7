"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives two records linked to it by WARC-Refers-To: a conversion
with the page's visible text, and a metadata record with what is known of the
response, which also names the conversion. Identifiers are derived from the
response's, so that a second run gives the same records. Target, date and the
source's headers and payload digest are preserved.

Markup is taken out by patterns that always match once they have begun: what is
left open ends with the text, as in HTML. So no position is scanned twice, and
time is in proportion to the text's length whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date and status of pages that come without them.
DATE = "2026-01-01T00:00:00Z"
STATUS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Elements without visible text.
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)" + "".join(rf"|{e}\b.*?(?:</{e}\s*>|\z)" for e in ("title", "script", "style", "noscript", "template")) + ")"
#: Tags that end a line.
BREAKS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|article|section|header|footer|main|aside|nav|blockquote|pre|form)\b[^>]*(?:>|\z)"
TAG = r"<[A-Za-z/!?][^>]*(?:>|\z)"
TITLE = r"(?is)<title\b[^>]*(?:>|\z)(.*?)(?:</title\s*>|\z)"
LANG = r"""(?i)<html\b[^<>]*\blang\s*=\s*["']?([A-Za-z-]+)"""
LINK = r"(?i)<a\b[^<>]*\bhref\s*="
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: References to characters by decimal or hexadecimal number.
NUMERIC = r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"


def _numeric(text: Column) -> Column:
    """Numeric references replaced; those that name no character by U+FFFD."""
    parts, refs = F.split(text, NUMERIC, -1), F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(1))

    def character(ref: Column) -> Column:
        point = F.when(F.lower(F.substring(ref, 1, 1)) == "x", F.conv(F.substring(ref, F.lit(2), F.length(ref)), 16, 10)).otherwise(ref).cast("bigint")
        point = F.when((point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF), point).otherwise(0xFFFD)
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    whole = F.array_join(F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(character(r), F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&#")), whole).otherwise(text)


def _decoded(text: Column) -> Column:
    text = _numeric(text)
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def bare(html: Column) -> Column:
    """The text between tags, a line per block; references are left as they are."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    return F.regexp_replace(text, TAG, "")


def laid_out(text: Column) -> Column:
    """``bare`` text with HTML's core entities and numeric references decoded and its white space made even."""
    # what is a single space or line end already isn't replaced by itself
    text = F.regexp_replace(_decoded(text), r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " ")
    text = F.regexp_replace(text, r"\n[ \n]+| \n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Visible text, a line per block; HTML's core entities and numeric references are decoded."""
    return laid_out(bare(html))


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", header_col: str | None = None, date_col: str | None = None) -> DataFrame:
    """Crawled pages as response records: ``page_id, record_id, target_uri,
    warc_date, http_header, payload``. A null page counts as an empty payload, a
    null URL as ''; rows with a null id are left out, and an empty table gives an
    empty one. Header and date are those of the page where columns for them are
    named; where there is none, or it is null, ``STATUS`` and ``DATE`` stand in."""
    given = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("target_uri"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
        given(header_col).alias("header"), given(date_col).alias("date"),
    ).where("page_id IS NOT NULL")
    return rows.select(
        "page_id", urn(F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri")).alias("record_id"), "target_uri",
        F.coalesce("date", F.lit(DATE)).alias("warc_date"), F.coalesce("header", F.concat(F.lit(STATUS), F.octet_length("payload").cast("string"))).alias("http_header"), "payload",
    )


def derive(sources: DataFrame) -> DataFrame:
    """``(page_id, record_type, record_id, refers_to, target_uri, content_type,
    content_length, block_digest, source_digest, header, block)``, two rows a response.

    Empty payloads give an empty conversion. Repeated responses give repeated
    records with equal identifiers, an empty table an empty one. Texts are
    converted whole. A record's own digest is that of its block; the source's is
    kept beside it as an extension field.
    """
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    # columns of their own, since decoding names its text several times and would make it anew each time
    parts = sources.withColumns({"bare": bare(F.col("payload")), "raw_title": F.regexp_extract("payload", TITLE, 1)})
    base = parts.select(
        "page_id", "record_id", "target_uri", "warc_date", "http_header",
        digest(F.col("payload")).alias("source_digest"),
        F.octet_length("payload").alias("source_length"),
        laid_out(F.col("bare")).alias("text"),
        F.regexp_replace(_decoded(F.col("raw_title")), r"[ \t\r\n\f]+", " ").alias("title"),
        F.lower(F.regexp_extract("payload", LANG, 1)).alias("html_lang"),
        F.regexp_count("payload", F.lit(LINK)).cast("bigint").alias("links"),
    )
    linked = base.withColumn("conversion_id", urn(F.lit("conversion"), F.col("record_id"))).withColumn("metadata_id", urn(F.lit("metadata"), F.col("record_id")))
    fields = F.concat(
        F.lit("title: "), "title", F.lit("\r\nhtml-lang: "), "html_lang", F.lit("\r\noutlinks: "), F.col("links").cast("string"),
        F.lit("\r\nsource-content-length: "), F.col("source_length").cast("string"), F.lit("\r\nsource-payload-digest: "), "source_digest",
        F.lit("\r\nconversion: "), "conversion_id", F.lit("\r\nconversion-length: "), F.octet_length("text").cast("string"),
        F.lit("\r\nsource-http-header: "), F.replace(F.col("http_header"), F.lit("\r\n"), F.lit(" | ")), F.lit("\r\n"),
    )
    record = lambda kind, key, mime, block: F.struct(F.lit(kind).alias("record_type"), F.col(key).alias("new_id"), F.lit(mime).alias("content_type"), block.alias("block"))
    each = linked.select(
        "page_id", "record_id", "target_uri", "warc_date", "source_digest",
        F.explode(F.array(record("conversion", "conversion_id", "text/plain; charset=utf-8", F.col("text")), record("metadata", "metadata_id", "application/warc-fields", fields))).alias("r"),
    ).select("*", "r.*").withColumn("content_length", F.octet_length("block").cast("bigint")).withColumn("block_digest", digest(F.col("block")))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), "new_id", F.lit("\r\nWARC-Date: "), "warc_date",
        F.lit("\r\nWARC-Refers-To: "), "record_id", F.lit("\r\nWARC-Target-URI: "), "target_uri", F.lit("\r\nWARC-Block-Digest: "), "block_digest",
        F.lit("\r\nX-Source-Payload-Digest: "), "source_digest", F.lit("\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"),
    )
    return each.select(
        "page_id", "record_type", F.col("new_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "content_type",
        "content_length", "block_digest", "source_digest", header.alias("header"), "block",
    )


def derivatives(pages: DataFrame, **options) -> DataFrame:
    """``derive`` over ``responses`` of a table of pages."""
    return derive(responses(pages, **options))


def write(records: DataFrame, path: str) -> None:
    """Write the records as WARC files, one a partition (text, uncompressed)."""
    records.select(F.concat("header", "block", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)
