"""Fixity audit of WARC replicas by Merkle trees.

A web page becomes a WARC record: header lines, then the payload. Records are laid into files of FILE_RECORDS ids each,
in the order of their ids, and each has its offset in its file. A record's leaf is the SHA-256 of its bytes; a tree node
covers FANOUT ordered ranges below it and its hash is the SHA-256 of its children's ranges and hashes. Two replicas are
compared from the roots: where nodes agree nothing below is read, where they differ the next level of that branch is
compared, down to the records. Records there are matched by their ids and hashes, not by their places.

The tree's levels are grouped sums over ever fewer nodes; a node has at most FANOUT children, so no group grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.shared import cut

FILE_RECORDS, FANOUT = 4096, 16


def record_bytes(url: Column, html: Column) -> Column:
    """One WARC response record: version, header fields, blank line, payload, two line ends."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"),
                    F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n")).cast("binary")


def _placed(runs: DataFrame, group: list[str], then: list[str]) -> DataFrame:
    """Runs of `n` equal records with before (records) and offset (bytes) of the runs ahead in their group.

    Runs are ordered by `then` and sha256. Sums go through parts of the hash, so a hot id is not one window partition.
    """
    runs = runs.withColumn("part", F.substring("sha256", 1, 2))
    key = [*group, *then, "part"]
    bytes_ = F.col("n") * F.col("length")
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner, outer = Window.partitionBy(*key).orderBy("sha256"), Window.partitionBy(*group).orderBy(*then, "part")
    sums = runs.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(bytes_).alias("bytes"))
    sums = sums.select(*(F.col(c).alias(f"k_{c}") for c in key), ahead("n", outer).alias("k_before"), ahead("bytes", outer).alias("k_offset"))
    runs = runs.withColumns({"before": ahead("n", inner), "offset": ahead(bytes_, inner)})
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]
    runs = runs.join(sums, same).withColumns({"before": F.col("before") + F.col("k_before"), "offset": F.col("offset") + F.col("k_offset")})
    return runs.drop("part", *(f"k_{c}" for c in [*key, "before", "offset"]))


def archive(pages: DataFrame) -> DataFrame:
    """page_id, file, slot, offset, length, sha256, copy of each page's record; offsets run without gaps through a file.

    Null ids and repeated ids are records like any other: null ids lie in files with negative numbers, dealt by the
    hash of their record, and records of one id are ordered by their hashes. Equal records of one id are counted by
    `copy`, from 1. A file has as many records as its ids have.
    """
    page_id = F.col("page_id").cast("long")
    rows = pages.select(page_id.alias("page_id"), record_bytes(F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))
    rows = rows.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    lost = -1 - F.pmod(F.xxhash64("sha256"), F.lit(1 << 16))
    rows = rows.withColumn("file", F.coalesce(F.shiftright(F.col("page_id").cast("long"), FILE_RECORDS.bit_length() - 1), lost))
    runs = cut(rows.groupBy("file", "page_id", "length", "sha256").agg(F.count("*").alias("n")))
    runs = _placed(runs, ["file"], ["page_id"])
    # In two steps, so that no array grows with the copies.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / FILE_RECORDS))).alias("chunk")
    runs = runs.select("*", chunk)
    first = F.col("chunk") * FILE_RECORDS
    rows = runs.select("*", F.explode(F.sequence(first + 1, F.least(first + FILE_RECORDS, F.col("n")))).alias("copy"))
    return rows.select("page_id", "file", (F.col("before") + F.col("copy")).alias("slot"), (F.col("offset") + (F.col("copy") - 1) * F.col("length")).alias("offset"), "length", "sha256", "copy")


def shape(*archives: DataFrame) -> list[str]:
    """Steps from a leaf to the root of a tree over all these archives: by slots in a file, by files, and to one root."""
    spans = [a.agg(F.min("file"), F.max("file"), F.max("slot")).first() for a in archives]
    spans = [x for x in spans if x[0] is not None] or [(0, 0, 0)]
    low, high, slots = min(x[0] for x in spans), max(x[1] for x in spans), max(x[2] for x in spans)
    steps = []
    while slots > 0:
        slots //= FANOUT
        steps.append("slot")
    while low != high and (low, high) != (-1, 0):
        low, high = low // FANOUT, high // FANOUT
        steps.append("file")
    return steps + ["root"] * (low != high)  # one branch of negative numbers and one of the others never meet


def _above(level: DataFrame, step: str | None) -> DataFrame:
    """The level with the place of each node's parent."""
    zero = F.lit(0).cast("long")
    file = {"file": F.floor(F.col("file") / FANOUT), "root": zero}.get(step, F.col("file"))
    return level.select("*", file.alias("up_file"), (F.floor(F.col("node") / FANOUT) if step == "slot" else zero).alias("up_node"))


def tree(records: DataFrame, steps: list[str]) -> list[DataFrame]:
    """Levels of the tree from the leaves to one root: file, node, start, end (covered leaves), hash, up_file, up_node.

    A leaf's place is its file and its slot, however many records the file has; files below zero come first. A parent
    has the slot, and above the slots the file, divided by FANOUT; `steps` give replicas the same shape.
    """
    place = F.struct("file", "slot")
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "copy", "offset", "length", "sha256"), 256)
    level = records.select("file", F.col("slot").alias("node"), place.alias("start"), place.alias("end"), leaf.alias("hash"))
    levels = [cut(_above(level, steps[0] if steps else None))]
    for step in [*steps[1:], None] if steps else []:
        levels.append(_above(_parents(levels[-1]), step))
    return levels


def _parents(level: DataFrame) -> DataFrame:
    child = F.struct("file", "node", "start", "end", "hash")
    made = F.array_sort(F.collect_list(child))
    text = F.array_join(F.transform(made, lambda c: F.concat_ws("|", c["start"]["file"], c["start"]["slot"], c["end"]["file"], c["end"]["slot"], c["hash"])), "\n")
    return (level.groupBy("up_file", "up_node").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(text, 256).alias("hash"))
            .select(F.col("up_file").alias("file"), F.col("up_node").alias("node"), "start", "end", "hash"))


def descend(mine: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """file and slot of every leaf that differs between trees of one shape, found from the root down the mismatching
    branches only."""
    bad = None
    for a, b in zip(reversed(mine), reversed(other), strict=True):
        if bad is not None:
            up = bad.select(F.col("file").alias("up_file"), F.col("slot").alias("up_node"))
            a, b = (x.join(up, ["up_file", "up_node"], "left_semi") for x in (a, b))
        both = a.select("file", "node", F.col("hash").alias("x")).join(b.select("file", "node", F.col("hash").alias("y")), ["file", "node"], "full")
        bad = cut(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", F.col("node").alias("slot")))
        if bad.isEmpty():
            break
    return bad


def _rank(left: DataFrame) -> DataFrame:
    """Records that are left over, with `rank` among those of their id, in the order of their hashes."""
    # The copies that are left of a run are its last ones, without gaps.
    runs = left.groupBy("file", "page_id", "length", "sha256").agg(F.count("*").alias("n"), F.min("copy").alias("first"))
    runs = _placed(runs, ["file", "page_id"], [])
    runs = runs.select(F.col("file").alias("k_file"), F.col("page_id").alias("k_id"), F.col("sha256").alias("k_sha256"), "before", "first")
    same = [F.col("file") == F.col("k_file"), F.col("page_id").eqNullSafe(F.col("k_id")), F.col("sha256") == F.col("k_sha256")]
    return left.join(runs, same).withColumn("rank", F.col("before") + F.col("copy") - F.col("first")).drop("k_file", "k_id", "k_sha256", "before", "first")


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of either archive: page_id, file, slot, offset, length, sha256, found_sha256, status.

    status: intact, moved (the same record at another offset), damaged (other bytes under this id), missing (only in
    the original) or added (only in the replica). Below a mismatching branch records are matched by id and hash, then
    what is left by id, in the order of the hashes; a null id names no record, so its changes are missing and added.
    Places are those of the original, for added records of the replica. Empty archives give an empty result.
    """
    original, replica = cut(original), cut(replica)
    steps = shape(original, replica)
    bad = descend(tree(original, steps), tree(replica, steps))
    out = ["page_id", "file", "slot", "offset", "length", "sha256"]
    intact = original.join(bad, ["file", "slot"], "left_anti").select(*out, F.col("sha256").alias("found_sha256"), F.lit("intact").alias("status"))
    # Only places below a mismatching branch look at the replica's records.
    mine = original.join(bad, ["file", "slot"], "left_semi").select(*original.columns)
    found = replica.join(bad, ["file", "slot"], "left_semi").select(*(F.col(c).alias(f"r_{c}") for c in replica.columns))
    same = [F.col("page_id").eqNullSafe(F.col("r_page_id")), F.col("sha256") == F.col("r_sha256"), F.col("copy") == F.col("r_copy")]
    both = cut(mine.join(found, same, "full"))
    status = F.when(F.col("offset") == F.col("r_offset"), "intact").otherwise("moved")
    kept = both.where("slot IS NOT NULL AND r_slot IS NOT NULL").select(*out, F.col("r_sha256").alias("found_sha256"), status.alias("status"))
    lost = _rank(both.where("r_slot IS NULL").select(*original.columns))
    new = _rank(both.where("slot IS NULL").select(*(F.col(f"r_{c}").alias(c) for c in replica.columns)))
    new = new.select(*(F.col(c).alias(f"r_{c}") for c in new.columns))
    left = lost.join(new, (F.col("page_id") == F.col("r_page_id")) & (F.col("rank") == F.col("r_rank")), "full")
    status = F.when(F.col("r_slot").isNull(), "missing").when(F.col("slot").isNull(), "added").otherwise("damaged")
    pick = lambda c: F.when(F.col("slot").isNull(), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c)
    left = left.select(*(pick(c) for c in out[:-1]), "sha256", F.col("r_sha256").alias("found_sha256"), status.alias("status"))
    return intact.unionByName(kept).unionByName(left)


def drill(pages: DataFrame, prefix: str = "00", lose: str | None = None, add: str | None = None, shorten: str | None = None) -> DataFrame:
    """A replica for an exercise: the pages, with the last character of the html changed where the MD5 of the page_id
    as text starts with `prefix`.

    Likewise pages are left out at `lose`, get a second record under their id at `add`, and lose the last character of
    their html at `shorten`; the first of lose, shorten and change that fits is done.
    """
    digest = F.md5(F.col("page_id").cast("string").cast("binary"))
    at = lambda p: F.coalesce(digest.startswith(p), F.lit(False)) if p is not None else F.lit(False)
    full, short = F.length("html") > 0, F.expr("left(html, length(html) - 1)")
    html = (F.when(at(shorten) & full, short)
            .when(at(prefix) & full, F.concat(short, F.when(F.col("html").endswith("~"), "!").otherwise("~"))).otherwise(F.col("html")))
    out = pages.where(~at(lose)).withColumn("html", html) if lose is not None else pages.withColumn("html", html)
    if add is not None:
        out = out.unionByName(pages.where(at(add)).withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit("+"))))
    return out
