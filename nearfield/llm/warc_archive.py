"""A content-addressed WARC archive.

Payload bytes are stored once each, in a table addressed by their SHA-256; the
exact headers of every record are in another. A digest is verified when a
payload is read. Both tables are bucketed by address, so that reading moves no
payload but those of very many records; headers of payloads that more than a
thousandth of all records have are in a third table, in files of any task, since
a bucket would be one task's. Joins of the tables give back the records as they
would stand in a WARC file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.store import HEAVY, Scratch, repeated

CRLF = "\r\n"
#: Records of one payload from which they are dealt over SALTS tasks.
OFTEN, SALTS = 256, 64


def base32(hex_text: Column) -> Column:
    """Base-32 of 20 bytes given in hexadecimal: five hexadecimal digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_text, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(text: Column) -> Column:
    h = F.md5(text)
    return F.concat(*[F.concat(F.lit("-" if i else ""), F.substring(h, a, n)) for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))])


@dataclass
class Archive:
    """Tables of one archive: ``headers``, ``payloads``, and ``crowded``, the headers of payloads that very many records have."""

    headers: DataFrame
    payloads: DataFrame
    crowded: DataFrame

    def verified(self) -> DataFrame:
        """The payloads, each checked against its address; a wrong one raises an error."""
        return self._checked(self.payloads)

    def payloads_often(self) -> DataFrame:
        return self._checked(self.payloads.where("often"))

    def _checked(self, payloads: DataFrame) -> DataFrame:
        right = F.sha2("payload", 256) == F.col("address")
        return payloads.select("address", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("binary")).alias("payload"))

    def records(self, whole: bool = True) -> DataFrame:
        """Headers with ``payload`` and ``record``, the bytes of the record.

        ``whole``: revisit records get back the payload they refer to, as the
        original had it; else they end after their headers, as in the archive.
        """
        payloads = self.verified()
        few, many = self.headers.where("not often"), self.headers.where("often").unionByName(self.crowded)
        joined = few.join(payloads, "address")
        # a payload of many records would be one task's: its records are dealt over salts
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        spread = many.withColumn("salt", F.pmod(F.xxhash64("id", "url", "copy"), F.lit(SALTS)).cast("int"))
        hot = self.payloads_often().select("*", salts)
        joined = joined.unionByName(spread.join(hot, ["address", "salt"]).select(joined.columns))
        body = F.col("payload") if whole else F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        end = F.lit((2 * CRLF).encode())
        return joined.withColumn("record", F.concat("warc_header", "http_header", body, end))


def write_archive(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Writes one record for each row of ``pages`` and gives the archive's tables, as read from the shared folder.

    Of records with equal payloads of at least ``least_bytes`` bytes, the first
    by id (then URL; nulls last) is a response and the others are revisits that
    refer to it; smaller ones are all responses. A null payload is empty. Rows
    repeated whole are records of their own: the first stays what it is, the
    others are revisits. An empty table gives an empty archive; other columns
    are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    described = rows.select("id", "url", "address", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    known = scratch.write(described.groupBy("id", "url", "address", "sha1", "n_bytes").agg(F.count("*").alias("times")), "known")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("url").isNull().alias("no_url"), F.col("url"))
    firsts = scratch.write(known.groupBy("address").agg(F.min(place).alias("first"), F.sum("times").alias("of_all")).withColumn("often", F.col("of_all") >= OFTEN), "firsts")
    total = firsts.agg(F.sum("of_all")).first()[0] or 0
    # there are fewer than HEAVY of these
    crowds = F.broadcast(firsts.where("often").where(F.col("of_all") * HEAVY > F.lit(total)).drop("of_all"))
    rest = known.join(crowds.select("address"), "address", "left_anti")
    # by a sort-merge join, so that each bucket is one file
    placed = repeated(rest.join(firsts.drop("of_all").hint("merge"), "address"), "times", "copy")
    crowded = repeated(known.join(crowds, "address"), "times", "copy", dealt=True)
    is_first = F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.url").eqNullSafe(F.col("url"))
    response = (F.col("n_bytes") < least_bytes) | (is_first & (F.col("copy") == 0))

    def uri(url: Column, id_: Column) -> Column:
        """A header is one line: line ends in a URL are escaped."""
        return F.coalesce(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.concat(F.lit("urn:page:"), F.coalesce(id_.cast("string"), F.lit("none"))))

    def record_id(id_: Column, url: Column, copy: Column) -> Column:
        return F.concat(F.lit("<urn:uuid:"), _uuid(F.concat_ws("\x1f", F.coalesce(id_.cast("string"), F.lit("\x00")), F.coalesce(url, F.lit("\x00")), F.col("address"), copy.cast("string"))), F.lit(">"))

    record_type = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(2 * CRLF))
    block = F.octet_length("http") + F.when(F.col("record_type") == "response", F.col("n_bytes")).otherwise(F.lit(0))
    refers = F.when(
        F.col("record_type") == "revisit",
        F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "),
            record_id(F.col("first.id"), F.col("first.url"), F.lit(0)),
            F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "),
            uri(F.col("first.url"), F.col("first.id")),
            F.lit(CRLF),
        ),
    ).otherwise(F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), record_id(F.col("id"), F.col("url"), F.col("copy")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri(F.col("url"), F.col("id")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF), refers,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.col("block").cast("string"), F.lit(2 * CRLF),
    )

    def described_by(copies: DataFrame) -> DataFrame:
        typed = copies.withColumn("record_type", record_type).withColumn("payload_digest", base32(F.col("sha1"))).withColumn("http", http).withColumn("block", block)
        refers_to = F.when(F.col("record_type") == "revisit", F.col("first.id")).alias("refers_to")
        return typed.select("id", "url", "copy", "address", "often", "record_type", "n_bytes", refers_to, F.encode(header, "UTF-8").alias("warc_header"), F.encode("http", "UTF-8").alias("http_header"))

    headers = scratch.write_bucketed(described_by(placed), "headers", "address")
    crowded = scratch.write(described_by(crowded), "crowded")
    # any record's bytes serve for an address; equal ones are dropped before and after they move
    stored = rows.select("address", "payload").dropDuplicates(["address"]).join(firsts.select("address", "often"), "address")
    payloads = scratch.write_bucketed(stored.select("address", "often", "payload"), "payloads", "address")
    scratch.drop(known, firsts)
    return Archive(headers, payloads, crowded)


def read_back(archive: Archive) -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to`` from the records as reconstructed and parsed."""
    records = archive.records()
    head = F.decode("warc_header", "UTF-8")
    size = F.octet_length("record") - F.octet_length("warc_header") - F.octet_length("http_header") - 4
    body = F.substring(F.col("record"), F.octet_length("warc_header") + F.octet_length("http_header") + 1, size)
    return records.select(
        "id",
        "copy",
        size.cast("long").alias("payload_bytes"),
        base32(F.sha1(body)).alias("payload_digest"),
        F.regexp_extract(head, r"WARC-Type: (\w+)", 1).alias("record_type"),
        F.regexp_extract(head, r"WARC-Payload-Digest: sha1:(\w+)", 1).alias("stated_digest"),
        "refers_to",
    )
