"""WARC records in a content-addressed archive, in DataFrame functions only.

Two tables make an archive: payloads(key, payload) holds every payload once under its SHA-256, and records(key, head)
holds the exact header bytes of every record, WARC and HTTP headers both, with the key of its payload. Reading joins
them and gives the original records back; a payload that no longer has the digest it is named by stops the read.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest id is the response and the others
revisit it (a revisit's block holds headers only); smaller payloads always make responses. Null payloads are empty.
Null urls are written as the empty target. Rows that repeat an id with the same payload have the same record type. A
null id can be no one's response unless all ids of that payload are null, which makes all of them responses. Ids are read
back as numbers: those that are none are read as null (their heads keep them). An empty table gives an archive without
records; extra columns aren't archived, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.session import materialize, release

MIN_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
URN = "urn:recordmill:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _head(rows: DataFrame) -> Column:
    """The WARC header and the HTTP header of a record; a blank line ends each."""
    urn = lambda c: _lines("<", URN, F.coalesce(F.col(c).cast("string"), F.lit("")), ">")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")
    http = _lines("HTTP/1.1 200 OK", END, "Content-Type: text/html; charset=utf-8", END, "Content-Length: ", F.col("n").cast("string"), END, END)
    revisit = F.col("response").isNotNull()
    length = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("n"))
    warc = _lines(
        "WARC/1.1", END,
        "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"), END,
        "WARC-Record-ID: ", urn("id"), END,
        "WARC-Target-URI: ", url, END,
        "WARC-Date: ", DATE, END,
        "WARC-Payload-Digest: sha1:", F.lower(F.hex("sha1")), END,
        F.when(revisit, _lines("WARC-Profile: ", PROFILE, END, "WARC-Refers-To: ", urn("response"), END)).otherwise(""),
        "Content-Type: application/http; msgtype=response", END,
        "Content-Length: ", length.cast("string"), END, END,
    )
    return F.encode(F.concat(warc, http), "UTF-8")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the archive of pages to a new path."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    full = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    full = full.withColumn("key", F.unhex(F.sha2("payload", 256)))
    brief = materialize(full.select("id", "url", "key", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "digests")
    keepers = brief.groupBy("key", "n", "id").agg(F.count(F.lit(1)).alias("copies")).groupBy("key", "n").agg(F.max("id").alias("keeper"), F.max_by("copies", "id").alias("copies"), F.max("copies").alias("most"))
    keepers = materialize(keepers.withColumn("copies", F.coalesce("copies", "most")).drop("most"), "keepers")
    joined = brief.join(keepers, ["key", "n"])
    response = F.when((F.col("n") >= MIN_REVISIT) & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    records = joined.select("id", "url", "key", "sha1", "n", response.alias("response"))
    records.select("key", _head(records).alias("head")).write.option("compression", "zstd").parquet(f"{path}/records")
    release(brief)
    # one row of each payload, streamed past a hash table of the keepers; the id in the key deals out many copies
    named = lambda df, c: df.withColumn("k", F.coalesce(F.col(c).cast("string"), F.lit("")))
    kept = named(full, "id").select("key", "k", "payload").join(named(keepers, "keeper").select("key", "k", "copies").hint("shuffle_hash"), ["key", "k"])
    single = kept.where("copies = 1").select("key", "payload")
    if not keepers.where("copies > 1").isEmpty():
        single = single.unionByName(kept.where("copies > 1").select("key", "payload").dropDuplicates(["key"]))
    single.write.option("compression", "zstd").parquet(f"{path}/payloads")
    release(keepers)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """key, payload; a payload whose digest isn't its key raises an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("key")
    return stored.select("key", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")).cast("binary")).alias("payload"))


def parse(records: DataFrame) -> DataFrame:
    """records(key, head) with the fields of the headers."""
    head = F.decode("head", "UTF-8")
    field = lambda name, rx: F.regexp_extract(head, rf"\r\n{name}: {rx}\r\n", 1)
    number = lambda text: F.when(text != "", text.cast("long"))
    return records.select(
        "key", "head",
        field("WARC-Type", r"([a-z]+)").alias("record_type"),
        number(field("WARC-Record-ID", rf"<{URN}(-?[0-9]*)>")).alias("id"),
        field("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        number(field("WARC-Refers-To", rf"<{URN}(-?[0-9]*)>")).alias("refers_to"),
        field("WARC-Payload-Digest", r"sha1:([0-9a-f]*)").alias("payload_digest"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The original records: parsed fields, record (its exact bytes) and payload (that of the response for revisits)."""
    fields = parse(spark.read.parquet(f"{path}/records"))
    joined = fields.join(read_payloads(spark, path), "key")
    end = F.encode(F.lit(END + END), "UTF-8")
    block = F.when(F.col("record_type") == "revisit", F.concat("head", end)).otherwise(F.concat("head", "payload", end))
    return joined.withColumn("record", block)


def digest_report(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, from the records as read gives them back: the size and SHA-1 of each record's rebuilt payload, which
    must be what its header says. A payload with very many records is one row on its side of the join, so adaptive
    execution splits the records' side."""
    rebuilt = read(spark, path)
    digest = F.sha1("payload")
    sound = F.when(digest == F.col("payload_digest"), digest).otherwise(F.raise_error(F.lit("a record's digest isn't that of its payload")).cast("string"))
    return rebuilt.select(F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", "refers_to")
