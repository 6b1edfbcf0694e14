"""Exact substring dedup: every byte covered by a 50-byte string that also starts in an earlier document goes.

1. Runs.  Texts are cut into runs of starts that share a name (``runs``): equal strings have equal names.  Names of
   a block of texts go to a bucket by hash, as packed arrays and not as rows; names of a single text are done with.
2. Suffix arrays.  Texts of the runs left (a run and the 49 bytes behind it) go to a bucket by name, so all strings
   that can be equal meet.  Equal run texts count once.  Where a name has several texts, the bucket sorts their
   suffixes by difference cover (``suffixes``: sampled triples, recursion on names, merge of the rest) and compares
   neighbouring prefixes: starts that agree in 50 bytes form a class, whose smallest document keeps the string.
3. Cuts.  The removed starts come back per document and become byte ranges.

Copies of a whole text are one text with the smallest id from step 2 on; all others of the group are removed whole.
Buckets follow the bytes of the corpus (about 5 MB each).  A bucket takes its names in shares of about ``_SHARE`` bytes
of run texts, and sorts at most ``_SORTED`` bytes at a time, or one name's texts.  A name holds only distinct texts around one 24-byte string.

Null texts are empty; texts under 50 bytes lose nothing.  Rows with a null id are neither removed nor a reason to
remove.  Rows that repeat id and text share one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.llm.base import mixed, slabs, text_bytes, text_size
from dataprobe.llm.runs import LENGTH, runs
from dataprobe.llm.suffixes import ranks

_BLOCK = 8 << 20
_BUCKET = 5 << 20
_SORTED = 1 << 20
# a bucket's run texts are compared share by share, about this many bytes at a time
_SHARE = 1 << 20
_PART = 1 << 20
_TAIL = LENGTH - 1


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _packed(values: np.ndarray | bytes, level: int = 1) -> bytes:
    """Compressed for the shuffle, harder than the shuffle itself does."""
    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), level)


def _unpacked(blob: bytes, kind=None):
    raw = zstandard.decompress(blob)
    return raw if kind is None else np.frombuffer(raw, kind)


def _join(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = [_unpacked(v, kind) for v in column.to_pylist() if v]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of a rising uint32 sequence; its running sum gives it back."""
    return np.diff(values, prepend=values[:0].dtype.type(0))


# ---- 1. which runs repeat ------------------------------------------------------------------------------------------


def _names_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(name, row) of every run of a block, hashed a part at a time: the arrays take many times the text's size."""
    names, owners, row = [], [], 0
    for part in slabs(iter([batch]), "text", _PART):
        name, _, _, owner = runs(*text_bytes(part.column(3)))
        names.append(name)
        owners.append(owner + row)
        row += part.num_rows
    return np.concatenate(names), np.concatenate(owners)


def _named(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, names, at, many, ids, keys, counts): packed names of a block by bucket, and one head per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in slabs(batches, "text", _BLOCK):
            block += 1
            name, owner = _names_of(batch)
            ids, k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            place = ((name >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort([name & np.uint64(0xFFFFFFFF), place]) if buckets > 1 else np.argsort(name & np.uint64(0xFFFFFFFF), kind="stable")
            place, low, key = place[order], (name[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), k1[owner[order]]
            many = np.zeros(len(order), np.uint8)
            cut = _groups(place << 32 | low.astype(np.int64))
            if len(order):
                differs = np.minimum.reduceat(key, cut[:-1]) != np.maximum.reduceat(key, cut[:-1])
                many = np.repeat(differs, np.diff(cut)).astype(np.uint8)
            edges = _groups(place)
            parts = list(zip(edges[:-1], edges[1:], strict=True)) if len(order) else []
            n = len(parts)
            yield _batch({
                "bucket": ([int(place[a]) for a, _ in parts] + [block % buckets], pa.int32()),
                "block": ([block] * (n + 1), pa.int64()),
                "names": ([_packed(_steps(low[a:b])) for a, b in parts] + [None], pa.binary()),
                "at": ([_packed(order[a:b].astype(np.uint32)) for a, b in parts] + [None], pa.binary()),
                "many": ([_packed(many[a:b]) for a, b in parts] + [None], pa.binary()),
                "head": ([None] * n + [_packed(np.stack([ids, k1, k2, np.bincount(owner, minlength=len(ids))]))], pa.binary()),
            })

    return docs.mapInArrow(run, "bucket int, block bigint, names binary, at binary, many binary, head binary")


def _repeating(key: tuple, rows: pa.Table) -> pa.Table:
    """The runs of each block whose name occurs in more than one text; heads pass through."""
    parts = rows.filter(pc.is_null(rows["head"]))
    heads = rows.filter(pc.is_valid(rows["head"]))
    block = parts["block"].to_numpy()
    each = [np.cumsum(_unpacked(v, np.uint32), dtype=np.uint32) for v in parts["names"].to_pylist()]
    sizes = np.array([len(e) for e in each], np.int64)
    names = np.concatenate(each) if each else np.zeros(0, np.uint32)
    at, many = _join(parts["at"], np.uint32), _join(parts["many"], np.uint8)
    owner = np.repeat(np.arange(len(block)), sizes)
    order = np.argsort(names, kind="stable")
    cut = _groups(names[order])
    out_block, out_at = [], []
    if len(order):
        sorted_owner = owner[order]
        twice = (np.minimum.reduceat(sorted_owner, cut[:-1]) != np.maximum.reduceat(sorted_owner, cut[:-1])) | (np.maximum.reduceat(many[order], cut[:-1]) > 0)
        flagged = np.zeros(len(order), bool)
        flagged[order] = np.repeat(twice, np.diff(cut))
        picked, who = at[flagged], owner[flagged]
        edges = _groups(who)
        if len(who):
            out_block = [int(block[who[a]]) for a in edges[:-1]]
            out_at = [_packed(picked[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    n = len(out_block)
    return pa.table({
        "block": pa.array(out_block + heads["block"].to_pylist(), pa.int64()),
        "at": pa.array(out_at + [None] * len(heads), pa.binary()),
        "head": pa.array([None] * n + heads["head"].to_pylist(), pa.binary()),
    })


def _by_text(key: tuple, rows: pa.Table) -> pa.Table:
    """(id, k1, k2, runs): the repeating runs of every text of a block, numbered within the text."""
    head = _join(rows["head"], np.int64).reshape(4, -1)
    ids, k1, k2, counts = head
    at = np.sort(_join(rows["at"], np.uint32)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.searchsorted(first, at, side="right") - 1
    edges = _groups(owner)
    some = owner[edges[:-1]] if len(owner) else owner
    return pa.table({
        "id": pa.array(ids[some], pa.int64()), "k1": pa.array(k1[some], pa.int64()), "k2": pa.array(k2[some], pa.int64()),
        "runs": pa.array([(at[a:b] - first[owner[a]]).astype(np.uint32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(owner) else [], pa.binary()),
    })


# ---- 2. classes of equal strings -----------------------------------------------------------------------------------


def _compressed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` as compressed bytes: texts cross the network in this form."""
    names = docs.columns
    at = names.index(text)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in batches:
            packed = pa.array([None if v is None else packer.compress(v.encode("utf-8", "surrogatepass")) for v in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, schema)


def _texts(column: pa.Array) -> list[bytes | None]:
    reader = zstandard.ZstdDecompressor()
    return [None if v is None else reader.decompress(v) for v in column.to_pylist()]


def _run_texts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, names, sizes, texts, which, docs, who, firsts): run texts by the bucket of their name, packed per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text", _PART):
            body, starts, ends = text_bytes(pa.array(_texts(batch.column(1)), pa.binary()))
            name, first, size, owner = runs(body, starts, ends)
            base = np.searchsorted(owner, np.arange(batch.num_rows))
            chosen = np.concatenate([np.frombuffer(v, np.uint32).astype(np.int64) + b for v, b in zip(batch.column(2).to_pylist(), base, strict=True)])
            name, first, size, owner = name[chosen], first[chosen], size[chosen], owner[chosen]
            place = ((name >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            edges = _groups(place[order])
            docs = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3)])
            raw = body.tobytes()
            out: dict[str, list] = {k: [] for k in ("bucket", "names", "sizes", "texts", "which", "docs", "who", "firsts")}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = order[a:b]
                seen: dict[bytes, int] = {}
                which = np.fromiter((seen.setdefault(raw[f : f + s + _TAIL], len(seen)) for f, s in zip(first[part].tolist(), size[part].tolist(), strict=True)), np.uint32, len(part))
                lead = np.zeros(len(seen), np.int64)
                lead[which[::-1]] = part[::-1]
                out["bucket"].append(int(place[part[0]]))
                out["names"].append(_packed(name[lead]))
                out["sizes"].append(_packed(size[lead].astype(np.uint32)))
                out["texts"].append(_packed(b"".join(seen), 3))
                out["which"].append(_packed(which))
                met, who = np.unique(owner[part], return_inverse=True)
                out["docs"].append(_packed(docs[:, met]))
                out["who"].append(_packed(who.astype(np.uint32)))
                out["firsts"].append(_packed((first[part] - starts[owner[part]]).astype(np.uint32)))
            yield _batch({k: (v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()})

    return rows.mapInArrow(run, "bucket int, names binary, sizes binary, texts binary, which binary, docs binary, who binary, firsts binary")


def _same_as_next(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where the 50 bytes at ``at[i]`` and ``at[i + 1]`` are equal."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        padded = (padded[:-step] << np.uint64(8 * step)) | padded[step:]
    same = np.ones(max(len(at) - 1, 0), bool)
    for shift in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        word = padded[at + shift]
        same &= word[1:] == word[:-1]
    return same


def string_classes(texts: list[bytes], sizes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For the first ``sizes[i]`` starts of every text, one after the other: the smallest of ``owners`` over all
    starts with the same 50 bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 2
    joined[begin + lengths] = 1
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.repeat(begin, sizes) + inner
    rank = ranks(joined, LENGTH)[starts]
    order = np.argsort(rank, kind="stable")
    same = _same_as_next((joined & 0xFF).astype(np.uint8), starts[order])
    cut = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(order)]])
    least = np.minimum.reduceat(np.repeat(owners, sizes)[order], cut[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(cut))
    return out


def _shares(rows: pa.Table) -> Iterator[tuple]:
    """(names, sizes, texts, text of each run, its (id, key), its first start) by shares of the names of a bucket.

    Equal texts of a name are one, and all texts of a name are in one share.
    """
    columns = {k: _join(rows[k], t) for k, t in (("names", np.uint64), ("sizes", np.uint32), ("which", np.uint32), ("firsts", np.uint32))}
    name, size, which, first = columns["names"], columns["sizes"].astype(np.int64), columns["which"].astype(np.int64), columns["firsts"]
    raw = b"".join(_unpacked(v) for v in rows["texts"].to_pylist())
    at = np.cumsum(size + _TAIL) - size - _TAIL
    docs, before = [], 0
    ran = 0
    for names, who, met in zip(rows["names"].to_pylist(), rows["who"].to_pylist(), rows["docs"].to_pylist(), strict=True):
        owner = _unpacked(who, np.uint32)
        docs.append(_unpacked(met, np.int64).reshape(2, -1)[:, owner])
        which[ran : ran + len(owner)] += before
        ran, before = ran + len(owner), before + len(_unpacked(names, np.uint64))
    docs = np.concatenate(docs, axis=1)
    shares = 1 + len(raw) // _SHARE
    share = (name % np.uint64(shares)).astype(np.int64)
    of_text, of_run = np.argsort(share, kind="stable"), np.argsort(share[which], kind="stable")
    edge, run_edge = np.searchsorted(share[of_text], np.arange(shares + 1)), np.searchsorted(share[which][of_run], np.arange(shares + 1))
    place = np.empty(len(name), np.int64)
    for k in range(shares):
        here, runs_here = of_text[edge[k] : edge[k + 1]], of_run[run_edge[k] : run_edge[k + 1]]
        seen: dict[tuple[int, bytes], int] = {}
        met = ((n, raw[a : a + s + _TAIL]) for n, a, s in zip(name[here].tolist(), at[here].tolist(), size[here].tolist(), strict=True))
        place[here] = np.fromiter((seen.setdefault(m, len(seen)) for m in met), np.int64, len(here))
        lead = np.zeros(len(seen), np.int64)
        lead[place[here]] = here
        yield name[lead], size[lead], [m[1] for m in seen], place[which[runs_here]], docs[:, runs_here], first[runs_here].astype(np.int64)


def _lost_starts(name_of: np.ndarray, size_of: np.ndarray, texts: list[bytes], text: np.ndarray, docs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, key, first start, starts) of the stretches that a share of names removes."""
    ids, keys = docs
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, text, ids)
    whole = least[text] < ids
    out_run, out_first, out_size = [np.flatnonzero(whole)], [first[whole]], [size_of[text[whole]]]
    # names with several texts: their first documents may lose single strings
    order = np.argsort(name_of, kind="stable")
    cut = _groups(name_of[order])
    multi = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1]
    keeper = np.flatnonzero(~whole)
    keeper = keeper[np.argsort(text[keeper], kind="stable")]
    kept = np.searchsorted(text[keeper], np.arange(len(texts) + 1))
    group: list[np.ndarray] = []
    held = 0
    for k, members in enumerate(multi):
        group.append(members)
        held += int((size_of[members] + LENGTH).sum())
        if held < _SORTED and k + 1 < len(multi):
            continue
        chosen = np.concatenate(group)
        group, held = [], 0
        found = string_classes([texts[m] for m in chosen], size_of[chosen], least[chosen])
        lost = found < np.repeat(least[chosen], size_of[chosen])
        ends = np.cumsum(size_of[chosen])
        change = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
        # stretches of lost starts, cut where one text ends and the next begins
        inner = ends[:-1][(lost[ends[:-1] - 1] & lost[ends[:-1]])] if len(ends) > 1 else ends[:0]
        begins = np.sort(np.concatenate([change[::2], inner]))
        stops = np.sort(np.concatenate([change[1::2], inner]))
        where = np.searchsorted(ends, begins, side="right")
        # every run that keeps the text loses the stretch
        member = chosen[where]
        many = kept[member + 1] - kept[member]
        run = keeper[np.repeat(kept[member] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        out_run.append(run)
        out_first.append(first[run] + np.repeat(begins - ends[where] + size_of[member], many))
        out_size.append(np.repeat(stops - begins, many))
    run, start, count = np.concatenate(out_run), np.concatenate(out_first), np.concatenate(out_size)
    return ids[run], keys[run], start, count


def _removed_starts(buckets: int):
    def removed(_: tuple, rows: pa.Table) -> pa.Table:
        doc, key, start, count = (np.concatenate(c) for c in zip(*(_lost_starts(*share) for share in _shares(rows)), strict=True))
        place = (mixed(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        edges = _groups(place[order])
        pieces = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(order) else []
        return pa.table({
            "place": pa.array([int(place[p[0]]) for p in pieces], pa.int32()),
            "ids": pa.array([_packed(doc[p]) for p in pieces], pa.binary()),
            "keys": pa.array([_packed(key[p]) for p in pieces], pa.binary()),
            "firsts": pa.array([_packed(start[p].astype(np.uint32)) for p in pieces], pa.binary()),
            "sizes": pa.array([_packed(count[p].astype(np.uint32)) for p in pieces], pa.binary()),
        })

    return removed


# ---- 3. cuts -------------------------------------------------------------------------------------------------------

_RANGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _ranges(_: tuple, rows: pa.Table) -> pa.Table:
    """(id, k1, ranges): the removed byte ranges [first, last) of each document, apart from each other."""
    ids, keys = _join(rows["ids"], np.int64), _join(rows["keys"], np.int64)
    first, size = (_join(rows[c], np.uint32).astype(np.int64) for c in ("firsts", "sizes"))
    order = np.lexsort([first, keys, ids])
    ids, keys, first, last = ids[order], keys[order], first[order], (first + size + _TAIL)[order]
    new_doc = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1
    out = []
    cut = [0, *new_doc.tolist(), len(ids)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        reach = np.maximum.accumulate(last[a:b])
        begin = np.flatnonzero(np.concatenate([[True], first[a + 1 : b] > reach[:-1]]))
        stop = reach[np.append(begin[1:], b - a) - 1]
        out.append([{"first": f, "last": s} for f, s in zip(first[a:b][begin].tolist(), stop.tolist(), strict=True)])
    return pa.table({"id": pa.array(ids[cut[:-1]], pa.int64()), "k1": pa.array(keys[cut[:-1]], pa.int64()), "ranges": pa.array(out, _RANGES)})


def removed_ranges(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k1, ranges): the byte ranges to remove, for documents that lose any; ``k1`` names the text."""
    own = F.col(f"`{text}`")
    keyed = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(own).alias("k1"), F.xxhash64(F.lit(1), own).alias("k2"), F.coalesce(own, F.lit("")).alias("text")
    )
    long = keyed.filter(F.octet_length("text") >= LENGTH)
    buckets = max(1, text_size(docs, text) // _BUCKET)
    blocks = _named(long, buckets).groupBy("bucket").applyInArrow(_repeating, "block bigint, at binary, head binary")
    flagged = blocks.groupBy("block").applyInArrow(_by_text, "id bigint, k1 bigint, k2 bigint, runs binary")
    # one row per distinct text that has a repeating run, under its smallest id
    single = flagged.groupBy("k1", "k2").agg(F.min(F.struct("id", "runs")).alias("m")).select("k1", "k2", "m.id", "m.runs")
    joined = _compressed(long.select("id", "k1", "k2", "text")).join(single.hint("shuffle_hash"), ["id", "k1", "k2"]).select("id", "text", "runs", "k1")
    packed = _run_texts(joined, buckets).groupBy("bucket").applyInArrow(_removed_starts(buckets), "place int, ids binary, keys binary, firsts binary, sizes binary")
    cuts = packed.groupBy("place").applyInArrow(_ranges, "id bigint, k1 bigint, ranges array<struct<first:int,last:int>>")
    slim = long.select("id", "k1", "k2", F.octet_length("text").alias("size"))
    copies = slim.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    gone = slim.join(copies, ["k1", "k2"]).filter("id > least").select("id", "k1", F.array(F.struct(F.lit(0).alias("first"), F.col("size").alias("last"))).alias("ranges"))
    return gone.unionByName(cuts).dropDuplicates(["id", "k1"])


def _whole(text: bytes, ranges: list[dict]) -> list[dict]:
    """``ranges`` widened to whole characters of UTF-8."""
    out = []
    for r in ranges:
        first, last = r["first"], r["last"]
        while first > 0 and first < len(text) and text[first] & 0xC0 == 0x80:
            first -= 1
        while last < len(text) and text[last] & 0xC0 == 0x80:
            last += 1
        out.append({"first": first, "last": last})
    return out


def _left(text: bytes, ranges: list[dict] | None, characters: bool = False) -> bytes:
    """The bytes outside ``ranges``, one after the other; with ``characters`` only those of whole characters."""
    if not ranges:
        return text
    if characters:
        ranges = _whole(text, ranges)
    at, out = 0, []
    for r in ranges:
        out.append(text[at : r["first"]])
        at = r["last"]
    return b"".join([*out, text[at:]])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, characters: bool = False) -> DataFrame:
    """``keep`` columns (default: the id), ``removed`` ranges (null where none) and ``kept``, the bytes left.

    With ``characters``, what a cut leaves of a character is not kept either.
    """
    keep = [id_col] if keep is None else keep
    own = F.col(f"`{text}`")
    found = removed_ranges(docs, id_col, text).select(F.col("id").alias("_id"), F.col("k1").alias("_a"), F.col("ranges").alias("removed"))
    # the text travels once, compressed, also where it is one of the columns to keep
    others = [c for c in keep if c != text]
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)], F.col(f"`{id_col}`").cast("long").alias("_i"), own.alias("_text"), F.xxhash64(own).alias("_k1"))
    on = (F.col("_i") == F.col("_id")) & (F.col("_k1") == F.col("_a"))
    met = _compressed(named, "_text").join(found.hint("shuffle_hash"), on, "left").select(*[f"_c{i}" for i in range(len(others))], "_text", "removed")
    kinds = {f.name: f for f in docs.schema.fields}
    removed = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    schema = T.StructType([T.StructField(c, kinds[c].dataType) for c in keep] + [T.StructField("removed", removed), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(iter([batch]), "_text", _PART):
                texts, ranges = _texts(part.column(len(others))), part.column(len(others) + 1)
                kept = pa.array([_left(t or b"", r, characters) for t, r in zip(texts, ranges.to_pylist(), strict=True)], pa.binary())
                columns = dict(zip(others, part.columns[: len(others)], strict=True))
                if text in keep:
                    columns[text] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[columns[c] for c in keep], ranges, kept], names=[*keep, "removed", "kept"])

    return met.mapInArrow(run, schema)
