"""Document identity and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_TEXT = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def derived_uuid(namespace: str, name: Column) -> Column:
    """A version-8 UUID of a name in a namespace (itself a UUID): 16 bytes of SHA-256 over both, with version and variant set."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha2(F.concat(space, F.encode(name, "utf-8")), 256)
    variant = F.substring(F.lit("89ab"), 1, 4)
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-"), F.substr(variant, digit + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def document_id(namespace: str, given: Column) -> Column:
    """The id of a document by its own `id`: a UUID is itself in lower case, another text a derived UUID, none a random one; an empty text is an error."""
    bad = F.raise_error(F.lit("an id must be a string that is not empty"))
    return F.when(given.isNull(), F.uuid()).when(given == "", bad.cast("string")).when(given.rlike(UUID_TEXT), F.lower(given)).otherwise(derived_uuid(namespace, given))


def content_hash(doc: Column) -> Column:
    return F.sha2(doc.cast("binary"), 256)
