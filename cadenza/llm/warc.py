r"""WARC archives of pages, and one capture index merged from the archives' sorted runs.

Pages are written as WARC records, each a gzip member of its own, so that an index entry's offset and length
are enough to fetch it: the payload of equal pages once, as a response, and otherwise as revisits that refer
to it. The archives are read back record by record. Each archive's captures, sorted by URL key and time where
they are read, are a run; the key space is cut into ranges, and within a range the runs are merged by a loser
tree into the global order of capture histories.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

#: Fixed values of the format and of base 32.
VERSION = "WARC/1.1"
DIGITS_32, ALPHABET_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_ID = "urn:x-page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: 160 bits as four numbers of eight digits each."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS_32, ALPHABET_32)


def capture_plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: which page stores an equal payload.

    Among equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is stored and
    the others have its id in ``refers_to``; smaller payloads are all stored. A null html counts as empty.
    Rows that repeat the largest id are all stored; where every id is null, so are all.
    """
    html = F.coalesce("html", F.lit(""))
    html = F.coalesce("html", F.lit(""))
    known = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
        base32_sha1(html).alias("payload_digest"),
    )
    # Decided on numbers and digests alone; only the pages that refer to others are joined to the payloads.
    told = known.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    same = ["payload_digest", "payload_bytes"]
    stores = told.groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("pages")).where("pages > 1 and refers_to is not null")
    revisits = stored(
        told.join(stores, same).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()
    )
    return known.alias("k").join(
        revisits.alias("r"), F.col("k.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("k.payload_digest") == F.col("r.payload_digest")), "left"
    ).select("k.*", "r.refers_to")


def record_text(captured: Column) -> Column:
    """The WARC record of a planned capture."""
    line = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(line + line),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return F.concat(
        F.lit(f"{VERSION}{line}WARC-Type: "), kind,
        F.coalesce(F.concat(F.lit(f"{line}WARC-Record-ID: <{RECORD_ID}"), F.col("page_id").cast("string"), F.lit(">")), F.lit("")),
        F.lit(f"{line}WARC-Date: "), F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Refers-To: <{RECORD_ID}"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(line + line), block, F.lit(line + line),
    )


def member(record: bytes) -> bytes:
    """A record as a gzip member whose last byte is 0.

    That byte is the highest of the record's length; after a record of 16 MB and more a member without content
    follows, whose length is 0.
    """
    packed = gzip.compress(record, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0)


def write_archives(plan: DataFrame, path: str, archive_bytes: int = 8 << 20, captured: Column | None = None) -> None:
    """Writes the records of a plan to archives below ``path``, each record a gzip member of its own.

    An archive takes records up to ``archive_bytes`` and one more. ``captured`` is the time of a capture; by
    default page_id (modulo 10**9) seconds after the start of 2024. Spark's text sink writes the bytes, the last
    one of a member being its line end; a failed task leaves no archive behind, as whole files only are committed.
    """
    if captured is None:
        captured = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                members = [member(x.as_py().encode("utf-8", "surrogatepass")) for x in batch.column("value").slice(start, 64)]
                names = []
                for m in members:
                    names.append(f"{task:06}-{written // archive_bytes:06}")
                    written += len(m)
                yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in members], pa.binary()), pa.array(names, pa.string())], ["value", "archive"])

    packed = plan.select(record_text(captured).alias("value")).mapInArrow(each, "value binary, archive string")
    packed.select(F.col("value").cast("string"), "archive").write.option("lineSep", "\0").partitionBy("archive").text(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive that have content."""
    at, step = 0, 1 << 16
    view = memoryview(data)
    while at < len(data):
        unpack, parts, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= len(data):
                raise ValueError(f"member at {at} is cut off")
            parts.append(unpack.decompress(view[fed : fed + step]))
            fed += step
        end = min(fed, len(data)) - len(unpack.unused_data)
        content = b"".join(parts)
        if content:
            yield at, end - at, content
        at = end


def fetch(archive: bytes, offset: int, length: int) -> dict:
    """The record that an index entry points to, from those bytes of the archive alone."""
    return parse_record(gzip.decompress(archive[offset : offset + length]))


def parse_record(data: bytes) -> dict:
    """A record by its declared lengths, its payload checked against its digest."""
    head_end = data.find(b"\r\n\r\n")
    first, *lines = data[: max(0, head_end)].decode("utf-8", "surrogatepass").split("\r\n")
    if first != VERSION:
        raise ValueError("no record")
    head = dict(line.split(": ", 1) for line in lines)
    start = head_end + 4
    block = data[start : start + int(head["Content-Length"])]
    if data[start + len(block) :] != b"\r\n\r\n" or len(block) != int(head["Content-Length"]):
        raise ValueError("record is cut off")
    http, payload = block.split(b"\r\n\r\n", 1)
    declared = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != declared:
            raise ValueError("record does not match its digest")
    number = lambda name: int(head[name].strip("<>").removeprefix(RECORD_ID)) if name in head else None
    return {
        "page_id": number("WARC-Record-ID"), "url": head.get("WARC-Target-URI"), "captured": head["WARC-Date"],
        "record_type": head["WARC-Type"], "payload_bytes": declared, "payload_digest": digest,
        "refers_to": number("WARC-Refers-To"), "payload": payload,
    }


def url_key(url: str | None) -> str:
    """A URL as a sort key: host labels reversed, then port, path and query; no URL sorts first."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").split(".")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url or ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host))}{port}){parts.path or '/'}{query}" if parts.hostname else (url or "")


#: What the index holds of a capture; ``INDEX_ORDER`` are the fields that order it.
INDEX_SCHEMA = (
    "archive string, url_key string, captured string, page_id bigint, url string, record_type string,"
    " payload_bytes bigint, payload_digest string, refers_to bigint, offset bigint, length bigint"
)
INDEX_ORDER = ["url_key", "captured", "page_id", "archive", "offset"]


def order_of(entry: dict) -> tuple:
    """An index entry's place; no page sorts before any number."""
    page = entry["page_id"]
    return entry["url_key"], entry["captured"], page is not None, page or 0, entry["archive"], entry["offset"]


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The captures in ``archives`` (path, content), each archive's in order: a run. Payloads come if asked for.

    Every stored payload is checked against its digest; a damaged archive fails the read.
    """
    schema = INDEX_SCHEMA + (", payload binary" if payloads else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        out = pa.schema([(n, types[x.strip().split(" ")[1]]) for n, x in zip(names, schema.split(","))])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                archive, run = "/".join(path.as_py().rsplit("/", 2)[-2:]), []
                for offset, length, data in members(content.as_py()):
                    record = parse_record(data)
                    entry = record | {"archive": archive, "url_key": url_key(record["url"]), "offset": offset, "length": length}
                    run.append({n: entry[n] for n in names})
                run.sort(key=order_of)
                yield from pa.Table.from_pylist(run, out).to_batches(65536)

    return archives.select("path", "content").mapInArrow(each, schema)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up.

    After the overall winner is taken, only the matches on its path are played again.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(x) for x in runs]
        self.heads = [next(x, None) for x in self.runs]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._start(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _start(self, node: int) -> int:
        """The winner below ``node``; leaves are the runs, numbered from the count of runs on."""
        n = len(self.runs)
        if node >= n:
            return node - n
        a, b = self._start(2 * node), self._start(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator[tuple]:
        n = len(self.runs)
        while self.winner >= 0 and self.heads[self.winner] is not None:
            best = self.winner
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            node = (best + n) // 2
            while node >= 1:
                if self._beats(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def merge_index(runs: DataFrame, rows_per_range: int = 20_000) -> DataFrame:
    """The captures of all runs in the global order of URL key, time and page; its partitions follow one another.

    ``runs`` are stored, each archive's captures in order. Ranges are cut on the whole order, not on the URL
    alone, at quantiles of a sample, so a URL with very many captures is spread over ranges too. A run is cut
    at them into blocks, which keep their order; a task merges the blocks of a range, without payloads.
    """
    total = runs.count()
    ranges = -(-total // rows_per_range)
    bounds: list[tuple] = []
    if ranges > 1:
        drawn = runs.select(*INDEX_ORDER).sample(min(1.0, 40 * ranges / total), seed=1).toArrow().to_pylist()
        drawn = sorted(map(order_of, drawn))
        bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)} if drawn else ())
    names = runs.columns
    entry = runs.schema.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(INDEX_ORDER).to_pylist()
            places = [bisect.bisect_right(bounds, order_of(r)) for r in rows]
            cuts = [i for i in range(len(rows)) if i == 0 or (rows[i]["archive"], places[i]) != (rows[i - 1]["archive"], places[i - 1])]
            whole = pa.StructArray.from_arrays(batch.columns, names)
            for a, b in zip(cuts, [*cuts[1:], len(rows)]):
                held = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), whole.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([places[a]], pa.int32()), held], ["place", "entries"])

    def keyed(held: pa.StructArray, start: int) -> Iterator[tuple]:
        return ((order_of(x.as_py()), start + i) for i, x in enumerate(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((place, held) for b in batches for place, held in zip(b.column("place").to_pylist(), b.column("entries")))
        for _, group in itertools.groupby(pieces, lambda x: x[0]):
            arrays = [held.values for _, held in group]
            starts = itertools.accumulate(map(len, arrays), initial=0)
            runs = [keyed(held, at) for held, at in zip(arrays, starts)]
            table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in arrays])
            found = table.take(pa.array([i for _, i in LoserTree(runs)], pa.int64()))
            yield from found.combine_chunks().to_batches(65536)

    cut = runs.mapInArrow(blocks, f"place int, entries array<{entry}>")
    dealt = cut.repartitionByRange(max(1, ranges), "place").sortWithinPartitions("place")
    return dealt.mapInArrow(merged, runs.schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 8 << 20) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC archives and returns their merged index.

    ``offset`` and ``length`` are those of a record's gzip member in its archive. Null htmls are empty
    payloads, null ids and urls stay null, line ends in urls are percent-encoded, repeated rows are captures
    of their own, an empty table has an empty index, other columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc"
    write_archives(capture_plan(pages, min_bytes), path, archive_bytes)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return merge_index(stored(read_archives(archives)))


ORACLE = """
WITH known AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), stores AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS stores FROM known)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + (i // 8) * 10)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = stores THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> stores THEN stores END AS refers_to
FROM stores
"""
