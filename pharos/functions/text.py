"""String, colour and number functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters replaced in file names, and lead-ins dropped from alternative texts.
BAD_FILE_CHARACTERS = r"#%&{}\<>*?/$!'" + '":@+`|='
ALT_LEAD_IN = r"(?i)^(image|picture|photo|photograph|illustration|graphic|icon)\s+of\s+"
PAGES_PER_CHUNK = 200
TITLE_WORDS = 50


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The last extension with its dot, or empty."""
    return F.regexp_extract(name, r"[^.](\.[^./]*)$", 1)


def safe_file_name(name: Column) -> Column:
    """Blanks to underscores, runs of them to one, problem characters to underscores, none at the ends; `document` if nothing is left."""
    joined = F.regexp_replace(F.replace(name, F.lit(" "), F.lit("_")), "__+", "_")
    put = F.translate(joined, BAD_FILE_CHARACTERS, "_" * len(BAD_FILE_CHARACTERS))
    return F.coalesce(F.nullif(F.regexp_replace(put, "^_+|_+$", ""), F.lit("")), F.lit("document"))


def stage_key(key: Column, stage: str, ext: str | None = None) -> Column:
    name = base_name(key)
    own = F.coalesce(F.nullif(extension(name), F.lit("")), F.lit(".html"))
    end = F.lit(ext if ext.startswith(".") else f".{ext}") if ext else own
    return F.concat(F.lit(f"{stage}/"), stem(name), end)


def chunk_keys(key: Column, pages: Column, per_chunk: int = PAGES_PER_CHUNK) -> Column:
    """One key for each chunk of a document of so many pages, in order."""
    name = F.regexp_replace(base_name(key), r"\.[^.]*$", "")
    starts = F.when(pages > 0, F.sequence(F.lit(0), (pages - 1).cast("int"), F.lit(per_chunk))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.concat(F.lit("temp/"), name, F.lit("/"), name, F.lit("_chunk_"), (s / per_chunk).cast("int") + 1, F.lit(".pdf")))


def merged_key(chunk: Column) -> Column:
    """The key of the whole document that a chunk belongs to."""
    return F.regexp_replace(chunk, r"_chunk_\d+(?=\.pdf$)", "")


def compliant_name(name: Column) -> Column:
    return F.concat(F.lit("COMPLIANT_"), name)


def clean_alt(text: Column) -> Column:
    """No quotes around, no lead-in such as `image of`, no full stops at the end, first letter capital."""
    t = F.regexp_replace(text, "^[\"']+|[\"']+$", "")
    t = F.regexp_replace(F.regexp_replace(t, ALT_LEAD_IN, ""), r"\.+$", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))


def figure_number(caption: Column) -> Column:
    return F.regexp_extract(caption, r"(?i)figure\s+(\d+(?:\.\d+)?)", 1)


def normal_header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), "[^a-z0-9 ]", ""))


def header_id(text: Column, number: Column) -> Column:
    """`th-` and up to twenty characters of the text as a slug; the number where the text is empty or begins with no letter."""
    slug = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "-")
    slug = F.when(slug.rlike(r"^\p{L}"), slug).otherwise(F.concat(F.lit("header-"), number.cast("string")))
    return F.when(text == "", F.concat(F.lit("th-"), number.cast("string"))).otherwise(F.concat(F.lit("th-"), F.left(slug, F.lit(20))))


def humanised(name: Column) -> Column:
    """Words of a field name, split on underscores and hyphens, each with a capital."""
    return F.array_join(F.transform(F.split(name, "[_-]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), " ")


def title_words(file_name: Column) -> Column:
    return F.initcap(F.array_join(F.regexp_extract_all(stem(base_name(file_name)), F.lit("([A-Za-z0-9]+)"), F.lit(1)), " "))


def common_prefix(labels: Column) -> Column:
    """The longest prefix that all labels share, if longer than three characters."""
    shortest = F.array_min(F.transform(labels, lambda x: F.length(x)))
    fits = F.filter(F.sequence(F.lit(0), F.coalesce(shortest, F.lit(0))), lambda n: F.size(F.array_distinct(F.transform(labels, lambda x: F.left(x, n)))) <= 1)
    prefix = F.left(F.get(labels, F.lit(0)), F.array_max(fits))
    return F.when(F.length(prefix) > 3, F.trim(prefix)).otherwise("")


def first_words(text: Column, n: int = 5) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))).otherwise(F.array_join(words, " "))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^www\.", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def title_context(pages: Column) -> Column:
    """The first page if it has fifty words or is alone, else the first three joined by blank lines."""
    first = F.coalesce(F.get(pages, F.lit(0)), F.lit(""))
    three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(pages, i), F.lit("")))
    return F.when((word_count(first) >= TITLE_WORDS) | (F.size(pages) <= 1), first).otherwise(F.trim(F.array_join(three, "\n\n")))


def token_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.expr("1") * F.floor(n / 4))).cast("bigint")


def is_image_path(path: Column) -> Column:
    return path.rlike(r"(?i)\.(png|jpe?g|gif|bmp)$")


def content_type(path: Column) -> Column:
    # Content types by extension.
    types = {"html": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf"}
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in types.items() for x in p]), ext), F.lit("application/octet-stream"))


def natural_key(name: Column) -> Column:
    """Sorts digit runs as numbers: an array of (number, text) parts."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.struct(x.try_cast("bigint").alias("n"), x.alias("s")))


def glob_match(name: Column, pattern: str) -> Column:
    """Case-insensitive match of a whole name with `*` and `?`."""
    import re

    rule = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return name.rlike(f"(?is)^{rule}$")


def selector(tag: Column, attrs: Column, nth: Column) -> Column:
    """A short selector of an element: id, else classes, else the end of an image's source, else its place among its kind."""
    a = lambda k: F.nullif(F.try_element_at(attrs, F.lit(k)), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("#"), a("id")), F.concat(tag, F.lit("."), F.regexp_replace(F.trim(a("class")), r"\s+", ".")),
        F.concat(tag, F.lit('[src$="'), base_name(a("src")), F.lit('"]')), F.concat(tag, F.lit(":nth-of-type("), nth.cast("string"), F.lit(")")),
    )


def labelled_payload(text: Column) -> Column:
    """The lines of a payload with labels; any other line that isn't blank is the status, the last one winning."""
    one = lambda label: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{label}:[ \t]*(.*)$", 1)), F.lit(""))
    rest = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike("^(Bucket|Merged File Key|Merged File Name):"))
    return F.struct(F.trim(F.try_element_at(rest, F.lit(-1))).alias("status"), one("Bucket").alias("bucket"), one("Merged File Key").alias("key"), one("Merged File Name").alias("name"))


def json_inside(text: Column) -> Column:
    """What stands from the first brace to the last in free text, as a variant; NULL if that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def log_fields(message: Column) -> Column:
    """(file, status) of `File: X, Status: Y` and `Filename : X | Status`."""
    return F.struct(F.regexp_extract(message, r"File: (.*?), Status: (.*)$", 1).alias("file"), F.regexp_extract(message, r"File: (.*?), Status: (.*)$", 2).alias("status"))


def brightness(hex_colour: Column) -> Column:
    """Perceived brightness of `#rrggbb`, 0 to 1; NULL if it is no such colour."""
    part = lambda i: F.conv(F.substring(hex_colour, i, 2), 16, 10).cast("double")
    return F.when(hex_colour.rlike("^#[0-9a-fA-F]{6}$"), (0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6)) / 255)


def is_dark(hex_colour: Column) -> Column:
    return F.coalesce(brightness(hex_colour) < 0.5, F.lit(False))
