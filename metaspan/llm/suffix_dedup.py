"""Suffix-array dedup: removal of every byte covered by a string of LENGTH bytes that starts twice or more.

Suffixes of the whole corpus are never brought together. Each window of LENGTH bytes has one anchor, its least k-gram;
equal windows have equal anchors at equal offsets, so windows can only meet within one anchor's group:
1.  A pass emits an anchor row for each run of windows with one anchor: digest h of the k-gram, digest c of all the
    run's bytes, text key and place. Rows whose h is lone are done. The rest are counted by (h, c).
2.  Of every (h, c) the bytes of one holder are fetched, or of two where it has several. Two holders' bytes are compared:
    equal ones repeat as a whole. Where an h has several c, suffix arrays are built over one holder of each: two-stage
    sorting, then adjacent common prefixes; windows whose neighbours share LENGTH bytes repeat. Groups beyond GROUP
    holders are split over tasks; what then is lone in its part meets the others by window digest (128 bits).
3.  So bytes decide every run. Where a run has more holders than the two that were compared, the others take over its spans
    by (h, c), together with the 128-bit digest of the compared bytes; before a span is cut, the bytes there are held
    against that digest. Runs with very many holders are few (at most SHARES), so they go to the texts: each text looks its own
    runs up, and gives one row however many of them it holds. No row is made per holder and run.
4.  Spans are joined to the texts, merged and cut out.
Texts are known by their MD5 digest; texts with equal digests count as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from metaspan.llm import bytesops as bo
from metaspan.llm import suffix_array as sx
from metaspan.llm.scratch import prepare, release, table, written

LENGTH = 200
#: Bytes of an anchor. Windows of LENGTH hold LENGTH - GRAM + 1 of them.
GRAM = 64
#: Holders of one anchor that a task sorts together.
GROUP = 2048
#: A run with more than this share of all anchor rows (and HOT rows) is looked up by its holders: there are at most SHARES of
#: them.
SHARES, HOT = 20_000, 500


def _anchors(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(h, c, row of the column, run) of the runs of windows, in chunks; rows ascend."""
    width = length - GRAM + 1
    for i, _, data, at in bo.chunks(column):
        if len(data) < length:
            continue
        c = bo.prefix_hash(data)
        start = np.arange(len(data) - GRAM + 1)
        grams = bo.substring(c, start, start + GRAM)
        doc, place, w0, w1 = bo.anchors(grams, at[:-1], np.maximum(at[:-1], at[1:] - GRAM + 1), width)
        if not len(doc):
            continue
        whole = bo.substring(c, w0, w1 + length)
        run_of = ((w0 - at[doc]) << 16) | ((place - w0) << 8) | (w1 - w0)
        yield grams[place].view(np.int64), whole.view(np.int64), i + doc, run_of


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, row, run_of in _anchors(batch.column(1), length):
                yield pa.record_batch([pa.array(h), pa.array(c), batch.column(0).take(pa.array(row)), pa.array(run_of)], ["h", "c", "key", "run"])

    return run


def _frequent_spans(length: int, frequent: list[tuple[int, int, bytes]]):
    """Per text that holds runs of `frequent` (h, c, digest): its key and their (span, digest), in one row."""
    known = {(h, c): k for k, (h, c, _) in enumerate(frequent)}
    anchors = np.sort(np.array([h for h, _, _ in frequent], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, row, run_of in _anchors(batch.column(1), length):
                near = np.flatnonzero(anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h)
                found = [known.get(x, -1) for x in zip(h[near].tolist(), c[near].tolist())]
                at = near[np.array(found, np.int64) >= 0]
                if not len(at):
                    continue
                edge = np.flatnonzero(np.concatenate(([True], row[at][1:] != row[at][:-1])))
                span = (run_of[at] >> 16 << 16) | ((run_of[at] & 255) + length)
                pairs = pa.StructArray.from_arrays([pa.array(span), pa.array([frequent[k][2] for k in found if k >= 0], pa.binary())], ["span", "digest"])
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate((edge, [len(at)])), pa.int32()), pairs)
                yield pa.record_batch([batch.column(0).take(pa.array(row[at][edge])), spans], ["key", "spans"])

    return run


def _cut_holders(length: int):
    """Per text with a list of wanted runs: the bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("h", "shard", "shards", "c", "n", "second", "run")
            rows: dict[str, list] = {k: [] for k in (*names, "key", "piece")}
            for key, text, wants in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("wants").to_pylist()):
                raw = memoryview(text.as_buffer() if text.is_valid else b"")
                for x in wants:
                    s = x["run"] >> 16
                    for k in names:
                        rows[k].append(x[k])
                    rows["key"].append(key)
                    rows["piece"].append(bytes(raw[s : s + (x["run"] & 255) + length]))
            if rows["h"]:
                kinds = {"piece": pa.binary(), "key": pa.binary()}
                yield pa.record_batch([pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], list(rows))

    return run


def repeated_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, class, size of the class) of every window of `length` bytes inside a piece, through a suffix array."""
    t = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(pieces)), size)
    inside = np.arange(len(t)) + length <= first[of + 1]
    sa = sx.suffix_array(t, length, inside)
    sa = sa[inside[sa]]
    label = np.cumsum(sx.common_prefixes(t, sa, length) < length)
    piece = of[sa]
    start = sa - first[piece]
    if not len(label):
        return piece, start, label, label
    return piece, start, label, np.bincount(label)[label]


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _sort_groups(length: int):
    """Rows come ordered by (h, shard, c, second); whole groups are sorted together, about a megabyte at a time.

    Out come (key, span) for runs with one holder, (h, c, digest) for those with several, and for split groups (key, span,
    digest) of windows that are lone in their part and (digest) of the others.
    """

    def settle(rows: pa.Table) -> pa.RecordBatch:
        h, shard, c, second = (rows[k].to_numpy() for k in ("h", "shard", "c", "second"))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (shard[1:] != shard[:-1]) | (c[1:] != c[:-1]) | (second[1:] != second[:-1])
        rows = rows.filter(pa.array(fresh))
        second, whole = rows["second"].to_numpy(), rows["piece"].to_pylist()
        for k in np.flatnonzero(second):  # the second holder stands behind the first
            if whole[k] != whole[k - 1]:
                raise RuntimeError("unlike runs share two 64-bit digests")
        rows = rows.filter(pa.array(second == 0))
        run, n, shards, h, c, shard = (rows[k].to_numpy() for k in ("run", "n", "shards", "h", "c", "shard"))
        key = rows["key"].combine_chunks()
        pieces = rows["piece"].to_pylist()
        many = np.flatnonzero(n > 1)
        # a run that is alone under its h (and in its part, if there is one part) has nothing else to meet
        edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (shard[1:] != shard[:-1]))))
        size = np.diff(np.concatenate((edge, [len(h)])))
        some = np.flatnonzero((np.repeat(size, size) > 1) | (shards > 1))
        piece, start, label, count = repeated_windows([pieces[k] for k in some], length)
        piece = some[piece]
        count = np.where(n[piece] > 1, 2, count)
        again = (count > 1) & (n[piece] == 1)
        order = np.lexsort((start[again], piece[again]))
        p, s = piece[again][order], start[again][order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        i = np.flatnonzero(new)
        j = np.concatenate((i[1:], [len(p)])) - 1 if len(i) else i
        span = (((run[p[i]] >> 16) + s[i]) << 16) | (s[j] - s[i] + length)
        # parts of one split group: a digest of each class, and the place of what is lone here
        split = shards[piece] > 1
        lone = split & (count == 1) & (n[piece] == 1)
        _, pick = np.unique(np.where(split & ~lone, label, -1), return_index=True)
        pick = pick[(split & ~lone)[pick]]
        at = np.concatenate((np.flatnonzero(lone), pick))
        parts = [_digest(pieces[p][s : s + length]) for p, s in zip(piece[at], start[at])]
        where = np.where(np.arange(len(at)) < int(lone.sum()), ((run[piece[at]] >> 16) + start[at]) << 16 | length, -1)
        none = lambda k, kind: pa.nulls(k, kind)
        keys = pa.concat_arrays([key.take(pa.array(p[i])), none(len(many), pa.binary()), key.take(pa.array(piece[at]))])
        spans = np.concatenate((span, np.full(len(many), -1), where))
        digests = pa.concat_arrays([none(len(span), pa.binary()), pa.array([_digest(pieces[k]) for k in many], pa.binary()), pa.array(parts, pa.binary())])
        of = [pa.concat_arrays([none(len(span), pa.int64()), pa.array(v[many]), none(len(at), pa.int64())]) for v in (h, c, n)]
        return pa.record_batch([keys, pa.array(spans), digests, *of], ["key", "span", "digest", "h", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("piece").nbytes
            if size < bo.CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            h, shard = rows["h"].to_numpy(), rows["shard"].to_numpy()
            edge = np.flatnonzero((h[1:] != h[:-1]) | (shard[1:] != shard[:-1]))
            if len(edge):
                cut = int(edge[-1]) + 1
                yield settle(rows.slice(0, cut))
                rows = rows.slice(cut)
            held, size = rows.to_batches(), rows["piece"].nbytes
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans) for each distinct text with repeats. docs: key binary, did long (never null), text.

    A span is (span, digest): span packs start << 16 | bytes, spans may overlap; the bytes of a span with a digest are to be
    held against it. Texts shorter than `length` bytes have none.
    """
    rows = docs.select("key", "text").mapInArrow(_anchor_rows(length), "h long, c long, key binary, run long")
    # the first shuffle carries 48 bits of h only; a chance collision merely lets a lone row through
    again = written(rows.groupBy(F.shiftrightunsigned("h", 16).alias("short")).agg(F.count("*").alias("k")).filter("k > 1").select("short"), "shared")
    members = rows.withColumn("short", F.shiftrightunsigned("h", 16)).join(again, "short", "left_semi").drop("short")
    members = written(members, "anchors")
    release(again)
    holder = F.struct("key", "run")
    same = written(members.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(holder).alias("one"), F.max(holder).alias("two")), "same")
    # all that share h, but for those h that only a chance collision let through
    met = same.groupBy("h").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).filter("kinds > 1 or most > 1").select("h", F.ceil(F.col("kinds") / GROUP).alias("shards"))
    both = F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))
    wants = same.join(met, "h").select("h", "c", "n", "shards", F.posexplode(both).alias("second", "at"))
    wants = wants.select(
        F.col("at.key").alias("key"),
        F.struct("h", F.pmod(F.xxhash64("c"), F.col("shards")).alias("shard"), "shards", "c", "n", "second", F.col("at.run").alias("run")).alias("x"),
    )
    first = docs.groupBy("key").agg(F.min("did").alias("did"))
    wants = written(wants.groupBy("key").agg(F.collect_list("x").alias("wants")).join(first, "key"), "wants")
    held = docs.join(wants, ["key", "did"]).select("key", "text", "wants")
    held = held.mapInArrow(_cut_holders(length), "h long, shard long, shards long, c long, n long, second long, run long, key binary, piece binary")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = held.repartition(parts, "h", "shard").sortWithinPartitions("h", "shard", "c", "second")
    found = written(sorted_.mapInArrow(_sort_groups(length), "key binary, span long, digest binary, h long, c long, n long"), "windows")
    apart = found.filter("digest is not null and h is null")
    again = apart.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest")
    lone = apart.filter("span >= 0").join(again, "digest", "left_semi")
    # runs with several holders: those with very many are few, so these go to the texts
    classes = found.filter("h is not null").select("h", "c", "n", "digest")
    bound = max(HOT, (same.agg(F.sum("n")).first()[0] or 0) // SHARES)
    frequent = [(r.h, r.c, bytes(r.digest)) for r in classes.filter(F.col("n") > bound).collect()]
    whole = members.join(classes.filter(F.col("n") <= bound).select("h", "c", "digest"), ["h", "c"])
    whole = whole.select("key", F.expr(f"shiftleft(shiftright(run, 16), 16) | ((run & 255) + {length})").alias("span"), "digest")
    nothing = F.lit(None).cast("binary").alias("digest")
    spans = whole.unionByName(found.filter("digest is null").select("key", "span", nothing)).unionByName(lone.select("key", "span", nothing))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("span", "digest")).alias("spans"))
    if frequent:  # copies of a text give equal lists
        held = docs.select("key", "text").mapInArrow(_frequent_spans(length, frequent), "key binary, spans array<struct<span:long,digest:binary>>")
        held = held.groupBy("key").agg(F.first("spans").alias("spans"))
        spans = spans.unionByName(held).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = written(spans, "spans")
    release(members, same, wants, found)
    return spans


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Packed spans as disjoint (start, end) in order; touching ones fuse."""
    out: list[tuple[int, int]] = []
    for v in np.sort(spans):
        s, e = int(v) >> 16, (int(v) >> 16) + (int(v) & 0xFFFF)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(as_text: bool):
    """Columns row, text and spans become row, kept (binary or text), n_bytes, n_removed and n_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, gone, n = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw = bytes(text.as_buffer()) if text.is_valid else b""
                cut = []
                if spans.is_valid:
                    places = spans.values.field("span").to_numpy(zero_copy_only=False)
                    for v, digest in zip(places.tolist(), spans.values.field("digest").to_pylist()):
                        if digest is not None and _digest(raw[v >> 16 : (v >> 16) + (v & 0xFFFF)]) != digest:
                            raise RuntimeError("unlike runs share two 64-bit digests")
                    cut = merged(places)
                n_bytes.append(len(raw))
                gone.append(sum(e - s for s, e in cut))
                n.append(len(cut))
                at = [0, *[x for span in cut for x in span], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])))
            out = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.record_batch([batch.column("row"), out, *[pa.array(v, pa.int64()) for v in (n_bytes, gone, n)]], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """docs' rows with kept (the remaining bytes), n_bytes, n_removed and n_spans in place of text.

    Matches never cross documents; null is empty; every byte in a `length`-byte string that starts anywhere else goes,
    so copies lose all occurrences. Repeated rows are documents of their own and thus copies. Row order is not kept.
    With as_text kept is a string; what is left of a character that a cut went through is dropped then.
    Columns named kept, n_bytes, n_removed or n_spans in docs are replaced; all others pass. An empty table gives none.
    """
    prepare(docs.sparkSession)
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    rest = [f for f in docs.schema.fields if f.name not in (*new, "text")]
    row = F.struct(*[F.col(f"`{f.name}`") for f in rest])
    keyed = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), "text", row.alias("row"))
    spans = repeat_spans(keyed.select("key", "did", "text"), length)
    both = keyed.join(spans, "key", "left").select("row", "text", "spans")
    kind = StructType([both.schema["row"], StructField("kept", StringType() if as_text else BinaryType()), *[StructField(c, LongType()) for c in new[1:]]])
    out = both.mapInArrow(_cut(as_text), kind)
    return out.select("row.*", *new)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: 200-byte repeats over all of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, LENGTH)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
