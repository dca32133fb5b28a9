"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

The reference-count table holds, for every line key, the number of documents
that hold it: exact, and a sum, so documents are added and taken away by adding
and subtracting their own counts.  Keys that reach ``least`` documents are
blocked.  Each shard of the key space keeps a cuckoo filter of its blocked keys:
buckets of four 32-bit fingerprints, two buckets a key, so single keys can be
put in and taken out again.  A filter is checked against all keys that its
shard's exact table counts: the few counted keys that it takes for blocked by
mistake are listed beside it, so for counted lines the answer is exact.

While all filters together stay under ``FILTER_BYTES`` each task probes a
broadcast copy and texts never move.  Beyond that, the lines' keys meet the
exact table in a salted join.  Both ways give the same rows.

Defined cases: a null or empty text is one empty line; a line's key strips
space and \\x09-\\x0D at both ends and folds A-Z; keys shorter than ``shortest``
code points are never dropped; a text that loses all lines is empty; repeated
rows of one document are separate documents; an empty table gives no row; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keep, set_aside
from loomgraph.llm.textcodes import mix

LEAST, SHORTEST = 10, 1
#: Size up to which all filters are sent to every task; the exact join serves beyond.
FILTER_BYTES = 32 << 20
#: Keys of one shard's filter, on average.
SHARD_KEYS = 1 << 17
#: Distinct lines a task counts before it hands its counts on.
FLUSH = 1 << 18
SALTS = 32
SLOTS = 4

_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower folds A-Z only


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, shortest: int) -> bool:
    if len(key) >= 4 * shortest:
        return True
    return len(key.decode("utf-8", "replace")) >= shortest


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_counts(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(key, n): number of documents for every line key, counted in the task before anything moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                for key in {line_key(x) for x in _lines(text.as_py())}:
                    if _long_enough(key, shortest):
                        h = _hash(key)
                        seen[h] = seen.get(h, 0) + 1
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Cuckoo:
    """A cuckoo filter of 16-byte keys: ``table`` is buckets x 4 fingerprints, 0 where free.

    Keys are spread in vectorised rounds: all pending keys try their bucket, the
    losers move on to, or push a fingerprint out of, the other one.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(keys, 1) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given as rows of two 64-bit numbers."""
        finger = (keys[:, 1] >> np.uint64(32)).astype(np.uint32)
        finger[finger == 0] = 1
        first = mix(keys[:, 0]) & self.mask
        return finger, first, self.other(first, finger)

    def other(self, bucket: np.ndarray, finger: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(finger.astype(np.uint64)) & self.mask)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        finger, a, b = self.places(keys)
        return (self.table[a] == finger[:, None]).any(1) | (self.table[b] == finger[:, None]).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Add keys; False when the table is too full, and then it must be rebuilt larger."""
        if not len(keys):
            return True
        finger, bucket, _ = self.places(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(rounds):
            order = np.argsort(bucket, kind="stable")
            finger, bucket = finger[order], bucket[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            nth = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
            free = self.table[bucket] == 0
            room = free.sum(1)
            goes = nth < room
            rank = np.cumsum(free, axis=1)
            slot = np.argmax((rank == (nth + 1)[:, None]) & free, axis=1)
            self.table[bucket[goes], slot[goes]] = finger[goes]
            finger, bucket, nth = finger[~goes], bucket[~goes], nth[~goes]
            if not len(finger):
                return True
            if turn % 2 == 0:
                bucket = self.other(bucket, finger)
                continue
            one = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # one push a bucket and round
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = finger[one]
            finger[one] = out
            bucket[one] = self.other(bucket[one], out)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were put in before, one copy each."""
        finger, a, b = self.places(keys)
        for f, i, j in zip(finger.tolist(), a.tolist(), b.tolist(), strict=True):
            for bucket in (i, j):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def as_numbers(keys: pa.Array) -> np.ndarray:
    """Rows of two 64-bit numbers from an Arrow array of 16-byte keys."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)


def _filled(blocked: np.ndarray) -> Cuckoo:
    size = len(blocked)
    while True:
        made = Cuckoo.sized(size)
        if made.insert(blocked):
            return made
        size = 2 * max(size, 1)


def shard_of(key: str, shards: int) -> Column:
    """Shard of a key: its first four bytes as a number, modulo ``shards``."""
    return (F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint") % shards).cast("int")


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    lead = keys.view(np.uint8).reshape(-1, 16)[:, :4].astype(np.int64)
    return (lead @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.int64)) % shards


def build_filters(counts: DataFrame, shards: int, least: int = LEAST) -> DataFrame:
    """(shard, buckets, filter, wrong): each shard's filter, and the counted keys it would take for blocked by mistake."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        every = as_numbers(t["key"].combine_chunks())
        made = _filled(every[n >= least])
        wrong = every[n < least]
        wrong = wrong[made.holds(wrong)]
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "filter": pa.array([made.table.tobytes()], pa.binary()),
                "wrong": pa.array([wrong.tobytes()], pa.binary()),
            }
        )

    return counts.where("n > 0").withColumn("shard", shard_of("key", shards)).groupBy("shard").applyInArrow(build, "shard int, filter binary, wrong binary")


def shift(counts: DataFrame, docs: DataFrame, sign: int, shortest: int = SHORTEST) -> DataFrame:
    """Reference counts after ``docs`` are added (sign 1) or taken away (sign -1); keys without documents go."""
    change = line_counts(docs, shortest).withColumn("n", F.col("n") * sign)
    return counts.unionByName(change).groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, least: int = LEAST) -> DataFrame:
    """Filters after a change of the counts: keys that crossed ``least`` are put in or taken out, nothing else is touched."""
    old = before.select("key", F.col("n").alias("old"))
    both = after.join(old, "key", "full").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("old", F.lit(0)).alias("old"))
    keyed = both.withColumn("shard", shard_of("key", shards))

    def change(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = (left if left.num_rows else right)["shard"][0].as_py()
        keys = as_numbers(right["key"].combine_chunks()) if right.num_rows else np.zeros((0, 2), np.uint64)
        n, old = right["n"].to_numpy(), right["old"].to_numpy()
        if left.num_rows:
            made = Cuckoo(np.frombuffer(left["filter"][0].as_py(), np.uint32).reshape(-1, SLOTS).copy())
            made.delete(keys[(old >= least) & (n < least)])
            if not made.insert(keys[(n >= least) & (old < least)]):
                made = _filled(keys[n >= least])
        else:
            made = _filled(keys[n >= least])
        wrong = keys[(n < least) & (n > 0)]
        wrong = wrong[made.holds(wrong)]
        return pa.table(
            {"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.table.tobytes()], pa.binary()), "wrong": pa.array([wrong.tobytes()], pa.binary())}
        )

    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(change, "shard int, filter binary, wrong binary")


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def drop_by_filters(docs: DataFrame, filters: DataFrame, shards: int, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``text`` rewritten and n_lines, n_dropped added; each task probes a copy of all filters."""
    spark = docs.sparkSession
    rows = filters.collect()  # under FILTER_BYTES, checked by the caller
    shared = spark.sparkContext.broadcast([(r["shard"], bytes(r["filter"]), bytes(r["wrong"])) for r in rows])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {n: Cuckoo(np.frombuffer(f, np.uint32).reshape(-1, SLOTS)) for n, f, _ in shared.value}
        wrong = {w[i : i + 16] for _, _, w in shared.value for i in range(0, len(w), 16)}
        for batch in batches:
            texts = [_lines(t) for t in batch.column(names.index("text")).to_pylist()]
            fresh = {line_key(x) for lines in texts for x in lines}
            fresh = [k for k in fresh if _long_enough(k, shortest)]
            hashes = [_hash(k) for k in fresh]
            numbers = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
            hit = np.zeros(len(fresh), bool)
            shard = shards_of(numbers, shards)
            for n, c in made.items():
                mine = np.flatnonzero(shard == n)
                hit[mine] = c.holds(numbers[mine])
            blocked = {fresh[i] for i in np.flatnonzero(hit) if hashes[i] not in wrong}
            yield _rewritten(batch, names, texts, blocked)

    return docs.mapInArrow(run, _schema(docs))


def _schema(docs: DataFrame) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return ", ".join([*fields, "n_lines bigint", "n_dropped bigint"])


def _rewritten(batch: pa.RecordBatch, names: list[str], texts: list[list[bytes]], blocked: set[bytes]) -> pa.RecordBatch:
    n_lines, n_dropped, kept = [], [], []
    for original, lines in zip(batch.column(names.index("text")).to_pylist(), texts, strict=True):
        left = [x for x in lines if line_key(x) not in blocked]
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
        kept.append(original if len(left) == len(lines) else b"\n".join(left).decode("utf-8", "surrogatepass"))
    columns = [pa.array(kept, pa.string()) if name == "text" else batch.column(i) for i, name in enumerate(names)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])


def drop_by_join(docs: DataFrame, counts: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """The same by a join of every line key with the exact table, for filters too large to send out.

    Rows get a number of their own; blocked keys are laid out once per salt, so
    the documents of a very common line spread over tasks.
    """
    numbered = keep(docs.withColumn("_row", F.monotonically_increasing_id()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = [_hash(k) for k in {line_key(x) for x in _lines(text)} if _long_enough(k, shortest)]
                ids += [row] * len(mine)
                out += mine
            yield pa.RecordBatch.from_pydict({"_row": pa.array(ids, pa.int64()), "key": pa.array(out, pa.binary())})

    salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
    lines = numbered.select("_row", "text").mapInArrow(keys, "_row bigint, key binary").withColumn("salt", salt)
    blocked = counts.where(F.col("n") >= least).select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    drops = lines.join(blocked, ["key", "salt"]).groupBy("_row").agg(F.collect_set("key").alias("_drop"))  # at most a document's lines
    both = numbered.join(drops, "_row", "left").drop("_row")
    names = both.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [x for x in names if x != "_drop"]
        for batch in batches:
            texts = [_lines(t) for t in batch.column(names.index("text")).to_pylist()]
            done = []
            for i, drop in enumerate(batch.column(names.index("_drop")).to_pylist()):
                gone = set(drop or ())
                blocked = {k for k in map(line_key, texts[i]) if _hash(k) in gone} if gone else set()
                done.append(_rewritten(batch.slice(i, 1).select(own), own, texts[i : i + 1], blocked))
            yield from done

    return both.mapInArrow(run, _schema(docs))


def dedup_lines(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Documents without the lines that ``least`` documents hold, with n_lines and n_dropped."""
    counts = keep(line_counts(docs, shortest))
    shards = shards_for(counts.count())
    filters = keep(build_filters(counts, shards, least))
    size = filters.agg(F.coalesce(F.sum(F.length("filter") + F.length("wrong")), F.lit(0))).first()[0]
    if size <= filter_bytes:
        return drop_by_filters(docs, filters, shards, shortest)
    return drop_by_join(docs, counts, least, shortest)


def without_shared_lines(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``text`` rewritten and no column added; other columns may have any name.

    A null or empty text is one empty line and stays as it is; an empty table
    stays empty.
    """
    plain = set_aside(docs)
    return dedup_lines(plain, least, shortest).select(*plain.columns).toDF(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))
