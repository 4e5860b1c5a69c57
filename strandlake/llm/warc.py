"""WARC archives: writing, and reading back by boundary-chain verification.

Writing. A record is one text row that ends in CR LF CR, and Spark's text sink adds the last LF, so the part files are WARC
files and a lost task is simply written again. Of equal payloads the smallest identifier is the response; the others are
revisit records that carry the payload's digest and refer to it. A record's name holds identifier and digest, so rows with one
identifier and different payloads stay apart. Rows repeated with identifier and payload give a record each: of those that
share the response's identifier the one with the smallest URL is the response. A null identifier counts as the largest.

Reading. Files are cut at every occurrence of the record magic, also inside payloads. Each cut is a candidate record: its
header gives its length and so the offset of its successor. Offsets are sums inside a split of a file and over its splits. Runs
of candidates whose successor is the very next candidate are contracted; pointer jumping from offset 0 over the rest doubles
the reach in every round and keeps what is on the chain. What lies between such a record and its successor belongs
to its payload, which is put together again; all others are digested where they are read.

Empty and null payloads are payloads of 0 bytes. A file's chain ends at the file's end or at the first offset that holds no
record; rows behind such a break are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.session import materialize

# The format's version line and field names.
MAGIC = "WARC/1.1\r\n"
NAME = "urn:page:"
_HEX5 = 8  # 160 bits are eight groups of 20
_SIZE = len(MAGIC)
_BIN = 16  # spans are looked up in bins of 64 kB: at most some thousand candidates each


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 20-bit groups of the hex digest are four base-32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(_HEX5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(again: Column, name: Column, first: Column) -> Column:
    """The record's text, of columns url, digest, bytes and payload."""
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Record-ID: <{NAME}"),
        name,
        F.lit(">\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Refers-To: <{NAME}"), first, F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string")),
        F.lit("\r\n\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("payload")),
        F.lit("\r\n\r"),
    )


def _name(id_: Column, digest: Column) -> Column:
    return F.concat(F.coalesce(F.url_encode(id_.cast("string")), F.lit("")), F.lit(":"), digest)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write one record per row below ``path``; payloads under ``min_bytes`` are always responses."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", "").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    # identifiers and digests alone are compared; a payload moves only where the marks of repeated ones outgrow a broadcast
    keys = rows.groupBy("id", "digest").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n"), F.min("url").alias("first_url"))
    keys = materialize(keys, "keys")
    shared = keys.where(F.col("bytes") >= min_bytes)
    firsts = (
        shared.groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count("*").alias("ids"))
        .select("digest", F.col("first.id").alias("first"), "ids")
    )
    marks = (
        shared.join(firsts, "digest")
        .where("n > 1 OR NOT (id <=> first)")
        .unionByName(keys.where(F.col("bytes") < min_bytes).where("n > 1"), allowMissingColumns=True)
        .select("id", "digest", "n", "first_url", F.expr("bytes >= %d AND id <=> first" % min_bytes).alias("is_first"), F.expr("bytes >= %d" % min_bytes).alias("may"), "first")
    )
    marks = materialize(marks, "marks")
    r, m = rows.alias("r"), marks.withColumnsRenamed({"id": "m_id", "digest": "m_digest"}).alias("m")
    marked = r.join(m, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")), "left")
    again = F.col("n").isNotNull() & ~F.col("is_first")
    out = marked.where("n IS NULL OR n = 1").select(_record(again, _name(F.col("id"), F.col("digest")), _name(F.col("first"), F.col("digest"))).alias("value"))
    if not marks.where("n > 1").isEmpty():
        # repeated rows: one payload and a count per identifier, payload and URL
        group = marked.where("n > 1").groupBy("id", "digest", "bytes", "url", "first_url", "is_first", "may", "first")
        copies = group.agg(F.count("*").alias("copies"), F.max("payload").alias("payload")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        lead = F.col("is_first") & (F.col("url") == F.col("first_url")) & (F.col("k") == 1)
        suffix = F.when(lead, F.lit("")).otherwise(F.concat(F.lit(":"), F.hex(F.xxhash64("url")), F.lit(":"), F.col("k").cast("string")))
        more = copies.select(_record(F.col("may") & ~lead, F.concat(_name(F.col("id"), F.col("digest")), suffix), _name(F.col("first"), F.col("digest"))).alias("value"))
        out = out.union(more)
    out.write.option("lineSep", "\n").text(path)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of bytes between two magics: file (a hash of its path), split, bytes, and what its header says."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    head = F.substring_index("value", "\r\n\r\n", 1)
    field = lambda name, what: F.regexp_extract(F.col("head"), f"(?:^|\\r\\n){name}: {what}(?:\\r\\n|$)", 1)
    return (
        raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
        .withColumns({"bytes": F.octet_length("value").cast("long"), "head": head})
        .withColumns(
            {
                "type": field("WARC-Type", "([a-z]+)"),
                "name": field("WARC-Record-ID", f"<{NAME}([^>]*)>"),
                "refers": field("WARC-Refers-To", f"<{NAME}([^>]*)>"),
                "length": F.expr("try_cast(regexp_extract(head, '(?:^|\\\\r\\\\n)Content-Length: ([0-9]+)(?:\\\\r\\\\n|$)', 1) as long)"),
                "skip": (F.octet_length("head") + 4).cast("long"),
            }
        )
        .withColumns(
            {
                "ok": F.col("length").isNotNull() & (F.col("type") != "") & (F.col("skip") <= F.col("bytes")),
                "whole": F.col("bytes") >= F.col("skip") + F.col("length"),
            }
        )
    )


def _placed(seen: DataFrame) -> DataFrame:
    """Add at (the magic's offset in the file), next (that of the following magic, or the file's end) and to (the successor).

    Splits are summed first, so no task sorts more than a split."""
    splits = seen.groupBy("file", "split").agg(F.sum(F.col("bytes") + _SIZE).alias("of_split"))
    before = F.sum("of_split").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum(F.col("bytes") + _SIZE).over(W.partitionBy("file", "split").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    # a file opens with the magic, so its first run is empty and the next one begins behind the first magic
    return (
        seen.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(starts, ["file", "split"])
        .withColumn("at", F.col("start") + F.col("inside") - _SIZE)
        .withColumns({"next": F.col("at") + _SIZE + F.col("bytes"), "to": F.when(F.col("ok"), F.col("at") + _SIZE + F.col("skip") + F.col("length") + 4)})
        .where("at >= 0")
        .drop("start", "inside", "place", "split")
    )


def _reachable(jump: DataFrame) -> DataFrame:
    """(file, at) of the nodes reached from offset 0 over (file, at, to), by pointer jumping."""
    jump = materialize(jump, "jump")
    nodes = jump.select("file", "at")
    reached, n = nodes.where("at = 0"), 0
    while True:
        step = jump.join(reached, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.union(step.join(nodes, ["file", "at"], "left_semi")).distinct(), "reached")
        total = reached.count()
        if total == n:
            return reached
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump, n = materialize(jump.join(far, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jump"), total


def _spans(placed: DataFrame, odd: DataFrame) -> DataFrame:
    """(file, owner, end, ok): the candidates on the chain whose successor is not the next candidate, and where their span ends.

    ``odd``: the candidates with that property. Between two of them the chain runs from candidate to candidate."""
    landing = odd.where("ok").select("file", F.col("to").alias("at")).distinct()
    heads = placed.where("at = 0").select("file", "at").union(landing.join(placed.select("file", "at"), ["file", "at"], "left_semi")).distinct()
    heads = materialize(heads, "heads")
    events = heads.select("file", "at", F.lit(True).alias("head"), F.lit(None).cast("long").alias("odd_at")).union(
        odd.select("file", "at", F.lit(False), F.col("at"))
    )
    ahead = W.partitionBy("file").orderBy("at", F.col("head").desc()).rowsBetween(0, W.unboundedFollowing)
    runs = events.withColumn("odd_at", F.first("odd_at", ignorenulls=True).over(ahead)).where("head").select("file", "at", "odd_at")
    ends = odd.select("file", F.col("at").alias("odd_at"), "ok", "to")
    linked = materialize(runs.join(ends, ["file", "odd_at"]), "linked")
    reached = _reachable(heads.join(linked.where("ok").select("file", "at", "to"), ["file", "at"], "left"))
    last = heads.select("file", F.col("at").alias("to"), F.lit(True).alias("lands"))
    on_chain = linked.join(reached, ["file", "at"], "left_semi").join(last, ["file", "to"], "left")
    end = F.when(F.col("ok") & F.col("lands"), F.col("to")).otherwise(F.lit((1 << 63) - 1))
    return on_chain.select("file", F.col("odd_at").alias("owner"), end.alias("end"), "ok").distinct()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, refers_name, payload_bytes, payload_digest) of every record on the chains of the files below ``path``.

    The chain is followed by contraction: candidates whose successor is the next candidate form runs that are on the chain if their first one is. Only where a
    successor is another one (a magic inside a payload, a damaged header) are pointers jumped over from run to run; an archive without such a place is one run from offset 0 on.

    Names are identifiers as ``write_warc`` had them. A revisit's payload fields are those of the record it refers to, null if that
    is missing."""
    cuts = _cuts(spark, path)
    whole_digest = base32_sha1(F.expr("substring(cast(value as binary), cast(skip + 1 as int), cast(length as int))"))
    prints = {"p1": F.xxhash64("value"), "p2": F.xxhash64(F.lit(1), "value")}
    light = ["file", "split", "bytes", "type", "name", "refers", "length", "skip", "ok", "whole"]
    seen = cuts.select(*light, F.monotonically_increasing_id().alias("place"), F.when(F.col("ok") & F.col("whole"), whole_digest).alias("digest"), *(c.alias(k) for k, c in prints.items()))
    placed = materialize(_placed(materialize(seen, "cuts")), "placed")
    odd = materialize(placed.where("NOT ok OR to <> next").select("file", "at", "ok", "to"), "odd")
    fields = ["name", "type", "refers", "bytes", "digest"]
    if odd.isEmpty():
        found = placed.withColumn("bytes", F.col("length")).select(fields)
    else:
        spans = materialize(_spans(placed, odd), "spans")
        files = placed.groupBy("file").agg(F.max("next").alias("size"))
        bins = spans.join(files, "file").withColumn("bin", F.explode(F.expr(f"sequence(shiftright(owner, {_BIN}), shiftright(least(end, size), {_BIN}))")))
        s, p = bins.select(F.col("file").alias("s_file"), "bin", "owner", "end", F.col("ok").alias("owner_ok")), placed.withColumn("p_bin", F.shiftright("at", _BIN))
        inside = (F.col("file") == F.col("s_file")) & (F.col("bin") == F.col("p_bin")) & (F.col("at") >= F.col("owner")) & (F.col("at") < F.col("end"))
        owned = materialize(p.join(s, inside, "left").drop("s_file", "bin", "p_bin"), "owned")
        records = owned.where("owner IS NULL OR owner_ok AND at = owner")
        found = records.where("whole").withColumn("bytes", F.col("length")).select(fields)
        # payloads cut by a magic: their pieces are found again by fingerprint, whatever splits the second scan has
        torn = materialize(records.where("NOT whole").select("file", "at", "to", "name", "type", "refers", "length", "skip"), "torn")
        pieces = owned.where("owner_ok AND at < end").select("file", F.col("owner"), F.col("at").alias("piece"), "p1", "p2")
        pieces = materialize(pieces.join(torn.select("file", F.col("at").alias("owner"), "to"), ["file", "owner"]).where("piece < to").drop("to"), "pieces")
        if not pieces.isEmpty():
            values = cuts.select("value", *(c.alias(k) for k, c in prints.items())).join(pieces.select("p1", "p2").distinct(), ["p1", "p2"], "left_semi")
            values = values.groupBy("p1", "p2").agg(F.first("value").alias("value"))
            body = (
                pieces.join(values, ["p1", "p2"])
                .groupBy("file", "owner")
                .agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("parts"))
                .select("file", F.col("owner").alias("at"), F.array_join("parts.value", MAGIC).cast("binary").alias("all"))
            )
            whole = base32_sha1(F.expr("substring(all, cast(skip + 1 as int), cast(length as int))"))
            mended = torn.join(body, ["file", "at"]).where(F.octet_length("all") >= F.col("skip") + F.col("length"))
            found = found.union(mended.select("name", "type", "refers", F.col("length").alias("bytes"), whole.alias("digest")))
        found = materialize(found, "records")
    target = found.where("type <> 'revisit'").groupBy(F.col("name").alias("refers")).agg(F.min(F.struct("bytes", "digest")).alias("t"))
    plain = lambda c: F.url_decode(F.substring_index(c, ":", 1))
    own = found.where("type <> 'revisit'").select(plain("name").alias("name"), "type", F.when(F.col("refers") != "", plain("refers")).alias("refers_name"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    # one response may be referred to by a third of all records: only the response's few columns are looked up
    again = found.where("type = 'revisit'").join(target, "refers", "left")
    return own.union(again.select(plain("name"), "type", F.when(F.col("refers") != "", plain("refers")), "t.bytes", "t.digest"))
