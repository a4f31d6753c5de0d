"""Removal of byte strings that an earlier document holds, over a sorted sample of suffixes.

A string of `size` bytes counts as repeated if it also starts in a document with a smaller id. Suffixes are not
sorted everywhere, but at anchors: of the GRAM-byte grams inside a string the one with the smallest hash is its
anchor, so equal strings have equal anchors at equal places, wherever they occur. The strings of one anchor are
neighbours; together they are its context, at most 2*size-GRAM bytes.

1. Documents go to chunk files in the shared folder; each chunk's anchor hashes go to hash buckets.
2. A bucket finds hashes of several documents and tells the chunks that hold them.
3. The chunks send the distinct contexts of those anchors, each once and with its smallest document, so frequent
   passages are combined before they are dealt out.
4. A bucket sorts the suffixes that start at equal anchors, and the reversed texts before them, by deep-shallow sorting:
   multikey quicksort on eight-byte characters down to a shallow depth, all parts of a level at once, then blind
   tries for groups that still agree. Strings at distance o before the anchor are equal exactly if they share size-o
   bytes after its start and o bytes before it, which the sorted orders and their common prefixes tell; the smallest
   document of each group is the owner of its strings.
5. The owners' verdicts return to the chunks, which remove what an earlier document owns.

Hashes only choose and group; strings are compared byte by byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespark.llm.warc import open_folder
from salespark.session import shared_folder, ship_package, stage

GRAM = 16
KEY_BYTES = 6  # of an anchor's hash, between chunks and buckets
NO_ID = np.iinfo(np.int64).max  # a null id is later than all others
_STEP = 1 << 20
_U = np.uint64


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP + 256, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        _tables.update(up=_powers(_BASE), down=_powers(pow(_BASE, -1, 1 << 64)))
    return _tables[name]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


@dataclass
class Runs:
    """Anchors with the strings they stand for: anchor place, first and last string start, hash of the gram."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray


def anchor_runs(data: np.ndarray, ends: np.ndarray, size: int) -> Runs:
    """Anchors of all strings that lie inside a document; documents follow each other up to `ends`."""
    width, none = size - GRAM + 1, np.zeros(0, dtype=np.int64)
    parts: list[tuple[np.ndarray, ...]] = [(none, none, none, none.astype(np.uint64))]
    crossing = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(crossing, np.maximum(ends - size + 1, np.concatenate([[0], ends[:-1]])), 1)
    np.add.at(crossing, ends, -1)
    crossing = np.cumsum(crossing)
    for low in range(0, max(0, len(data) - size + 1), _STEP):
        piece = data[low : low + _STEP + size - 1]
        n = len(piece)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * _table("up")[:n], out=sums[1:])
        hashes = _mix((sums[GRAM:] - sums[:-GRAM]) * _table("down")[: n - GRAM + 1])
        least = (hashes & _U(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the first one
        covered = 1
        while covered < width:
            step = min(covered, width - covered)
            least = np.minimum(least[:-step], least[step:])
            covered += step
        inside = np.flatnonzero(crossing[low : low + len(least)] == 0)
        if not len(inside):
            continue
        least = least[inside]
        fresh = np.ones(len(inside), dtype=bool)
        fresh[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1] + 1)
        begin = np.flatnonzero(fresh)
        at = (least[begin] & _U(0xFFFFFF)).astype(np.int64)
        parts.append((at + low, inside[begin] + low, inside[np.append(begin[1:], len(inside)) - 1] + low, hashes[at]))
    return Runs(*(np.concatenate(p) for p in zip(*parts, strict=True)))


# --- chunks


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _keys(hashes: np.ndarray) -> np.ndarray:
    return hashes >> _U(64 - 8 * KEY_BYTES)


def _short(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])


def _long(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short) // KEY_BYTES, 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = short.reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


@dataclass
class Chunk:
    ids: np.ndarray
    data: np.ndarray
    ends: np.ndarray

    def save(self, folder: str) -> str:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(pack(self.ids, self.ends, self.data))
        return f"{folder}/{name}"

    @staticmethod
    def load(uri: str) -> Chunk:
        system, path = open_folder(uri)
        with system.open_input_file(path) as file:
            ids, ends, data = unpack(file.read(), "i8", "i8", "u1")
        return Chunk(ids, data, ends)

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Ids of the documents that hold these bytes."""
        return self.ids[np.searchsorted(self.ends, places, side="right")]


@dataclass
class Entries:
    """Distinct contexts of a chunk in a fixed order, and which run belongs to which."""

    runs: Runs
    of_run: np.ndarray
    sample: np.ndarray  # a run of each entry
    least: np.ndarray  # smallest id
    many: np.ndarray  # several ids


def entries(chunk: Chunk, shared: np.ndarray, size: int) -> Entries:
    """Contexts at anchors whose key is in `shared` (sorted)."""
    runs = anchor_runs(chunk.data, chunk.ends, size)
    keys = _keys(runs.hash)
    place = np.searchsorted(shared, keys)
    kept = np.zeros(len(keys), dtype=bool) if not len(shared) else shared[np.minimum(place, len(shared) - 1)] == keys
    runs = Runs(*(x[kept] for x in (runs.at, runs.first, runs.last, runs.hash)))
    rows = contexts(chunk.data, runs, size)
    labels = np.column_stack([runs.hash.view(np.uint8).reshape(-1, 8), (runs.at - runs.first).astype(np.uint8), (runs.last - runs.first).astype(np.uint8), rows])
    whole = np.ascontiguousarray(labels).view(np.dtype((np.void, labels.shape[1]))).ravel()
    sample, of_run = _distinct(labels, whole)
    ids = chunk.owner(runs.first)
    least, most = np.full(len(sample), NO_ID), np.full(len(sample), np.iinfo(np.int64).min)
    np.minimum.at(least, of_run, ids)
    np.maximum.at(most, of_run, ids)
    return Entries(runs, of_run, sample, least, most > least)


def _distinct(labels: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each class, class of each row): by a hash of the rows, checked, else by the rows themselves."""
    if not len(labels):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    wide = np.zeros((len(labels), -(-labels.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : labels.shape[1]] = labels
    words, hashed = wide.view(np.uint64), np.zeros(len(labels), dtype=np.uint64)
    for i in range(words.shape[1]):
        hashed = _mix(hashed * _U(_BASE) + words[:, i])
    _, sample, of_row = np.unique(hashed, return_index=True, return_inverse=True)
    if not (labels == labels[sample[of_row]]).all():
        _, sample, of_row = np.unique(whole, return_index=True, return_inverse=True)
    return sample, of_row


def contexts(data: np.ndarray, runs: Runs, size: int) -> np.ndarray:
    """A row of 2*size-GRAM bytes for each run, the anchor's start always in column size-GRAM, zero outside."""
    before = size - GRAM
    out = np.zeros((len(runs.at), 2 * size - GRAM), dtype=np.uint8)
    for low in range(0, len(out), 1 << 16):
        part = slice(low, low + (1 << 16))
        at = runs.at[part, None] - before + np.arange(out.shape[1])
        inside = (at >= runs.first[part, None]) & (at < runs.last[part, None] + size)
        out[part] = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
    return out


# --- deep-shallow sorting


def blind_trie_order(values: list[int], width: int) -> list[int]:
    """Positions of equally long strings (as big-endian numbers of `width` bytes) in sorted order.

    A blind trie keeps only branching depths and bytes. An insertion goes down by these alone, compares once with
    the string it reaches, and branches where the first difference is.
    """
    bits = 8 * width

    def byte(value: int, depth: int) -> int:
        return value >> (bits - 8 * depth - 8) & 255

    root: list = [-1, [0]]  # a leaf is [-1, positions], an inner node [depth, {byte: node}]
    for position in range(1, len(values)):
        value, node = values[position], root
        while node[0] >= 0:
            child = node[1].get(byte(value, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = values[node[1][0]]
        if other == value:
            node[1].append(position)
            continue
        common = (bits - (other ^ value).bit_length()) // 8
        parent, node = None, root
        while 0 <= node[0] < common:
            parent, node = node, node[1][byte(value, node[0])]
        if node[0] == common:
            node[1][byte(value, common)] = [-1, [position]]
            continue
        branch = [common, {byte(other, common): node, byte(value, common): [-1, [position]]}]
        if parent is None:
            root = branch
        else:
            parent[1][byte(value, parent[0])] = branch
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if node[0] < 0:
            out += node[1]
        else:
            waiting += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(rows: np.ndarray, group: np.ndarray, shallow: int = 16) -> np.ndarray:
    """Order of byte rows inside their groups (numbered; groups come in their order)."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    padded = np.zeros((n, max(-(-width // 8) * 8, shallow)), dtype=np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8")
    order = np.argsort(group, kind="stable")
    part = group[order]
    for level in range(shallow // 8):
        # one level of multikey quicksort: every part that is not settled is split by its next character
        sizes = np.bincount(np.unique(part, return_inverse=True)[1])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        open_rows = np.repeat(sizes > 1, sizes)
        which = np.flatnonzero(open_rows)
        keys = words[order[which], level].astype(np.uint64)
        labels = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.lexsort((keys, labels[which]))
        order[which], keys = order[which][inner], keys[inner]
        fresh = np.zeros(n, dtype=bool)
        fresh[starts] = True
        changed = np.zeros(len(which), dtype=bool)
        changed[1:] = keys[1:] != keys[:-1]
        fresh[which] |= changed
        part = np.cumsum(fresh)
    if width > shallow:
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        stops = np.append(starts[1:], n)
        for start, stop in zip(starts[stops - starts > 1], stops[stops - starts > 1], strict=True):
            own = order[start:stop]
            raw = rows[own, shallow:].tobytes()
            rest = width - shallow
            values = [int.from_bytes(raw[i : i + rest], "big") for i in range(0, len(raw), rest)]
            order[start:stop] = own[blind_trie_order(values, rest)]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before it."""
    out = np.zeros(len(order), dtype=np.int64)
    for low in range(1, len(order), 1 << 16):
        part = order[low : low + (1 << 16)]
        differ = rows[part] != rows[order[low - 1 : low - 1 + len(part)]]
        out[low : low + len(part)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def string_owners(rows: np.ndarray, group: np.ndarray, before: np.ndarray, count: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """owners[i, o]: smallest id that holds the string of row i which starts o bytes before the anchor.

    rows are distinct contexts, `before` the bytes of each before the anchor, `count` its strings. Places without a
    string of the row hold NO_ID.
    """
    split = size - GRAM
    owners = np.full((len(rows), split + 1), NO_ID)
    after, ahead = rows[:, split:], rows[:, split - 1 :: -1] if split else rows[:, :0]
    sorted_after, sorted_ahead = deep_shallow_order(after[:, GRAM:], group), deep_shallow_order(ahead, group)
    shared_after, shared_ahead = common_prefixes(after, sorted_after), common_prefixes(ahead, sorted_ahead)
    for order, shared in ((sorted_after, shared_after), (sorted_ahead, shared_ahead)):
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = group[order][1:] != group[order][:-1]
        shared[fresh] = -1
    for o in range(split + 1):
        held = np.flatnonzero((before >= o) & (before - count < o))
        if not len(held):
            continue
        label = []
        for order, shared, depth in ((sorted_after, shared_after, size - o), (sorted_ahead, shared_ahead, o)):
            of = np.empty(len(order), dtype=np.int64)
            of[order] = np.cumsum(shared < depth)
            label.append(of[held])
        inner = np.lexsort((label[1], label[0]))
        fresh = np.ones(len(inner), dtype=bool)
        fresh[1:] = (label[0][inner][1:] != label[0][inner][:-1]) | (label[1][inner][1:] != label[1][inner][:-1])
        smallest = np.minimum.reduceat(least[held][inner], np.flatnonzero(fresh))
        owners[held[inner], o] = smallest[np.cumsum(fresh) - 1]
    return owners


# --- the five steps as tasks

_ROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.string()), ("blob", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _as_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)]) if rows else _ROW.empty_table()


def _chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[Chunk]:
    ids, texts, held = [], [], 0

    def close() -> Chunk:
        data = b"".join(texts)
        made = Chunk(np.array(ids, dtype=np.int64), np.frombuffer(data, np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64))
        ids.clear()
        texts.clear()
        return made

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("bytes"), strict=True):
            ids.append(NO_ID if doc_id is None else doc_id)
            texts.append(text.as_py() or b"")
            held += len(texts[-1]) + 16
            if held >= chunk_bytes:
                yield close()
                held = 0
    if ids:
        yield close()


def remove_repeats(docs: DataFrame, size: int = 50, chunk_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, removed (array of start and end in bytes), kept (bytes).

    docs needs doc_id and text; null texts are empty; other columns are ignored. Documents shorter than `size` keep
    everything. A null doc_id counts as larger than all others. Rows that repeat a doc_id don't remove each other.
    A kept text may be cut inside a character, so it is binary.
    """
    if not GRAM < size <= 128:
        raise ValueError(f"size must be over {GRAM} and at most 128 bytes")
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // bucket_bytes))
    folder = f"{shared_folder(spark).rstrip('/')}/salespark/substrings-{uuid.uuid4().hex}"

    def bucketed(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = keys % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        yield from zip((int(b) for b in names), np.split(order, starts[1:]), strict=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunked(batches, chunk_bytes):
            path = chunk.save(folder)
            runs = anchor_runs(chunk.data, chunk.ends, size)
            keys, ids = _keys(runs.hash), chunk.owner(runs.first)
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin) if len(keys) else np.zeros(0, dtype=bool)
            keys = keys[begin]
            yield _batch([(-1, path, None), *((b, path, pack(_short(keys[i]), several[i])) for b, i in bucketed(keys))] if len(keys) else [(-1, path, None)])

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        found = [unpack(blob, "u1", "?") for blob in table.column("blob").to_pylist()]
        keys = [_long(f[0]) for f in found]
        every, several = np.concatenate(keys), np.concatenate([f[1] for f in found])
        names, of, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times > 1
        np.logical_or.at(shared, of, several)
        told = np.split(shared[of], np.cumsum([len(k) for k in keys])[:-1])
        return _as_table([(-2, c, pack(_short(k[t]))) for c, k, t in zip(table.column("chunk").to_pylist(), keys, told, strict=True) if t.any()])

    def shared_keys(blobs: list[bytes]) -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *(_long(unpack(b, "u1")[0]) for b in blobs)]))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        path = key[0].as_py()
        chunk = Chunk.load(path)
        own = entries(chunk, shared_keys(table.column("blob").to_pylist()), size)
        runs = Runs(*(x[own.sample] for x in (own.runs.at, own.runs.first, own.runs.last, own.runs.hash)))
        out = []
        for bucket, i in bucketed(_keys(runs.hash)):
            part = Runs(runs.at[i], runs.first[i], runs.last[i], runs.hash[i])
            lengths = part.last - part.first + size
            flat = np.repeat(part.first, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out.append((bucket, path, pack(part.hash, (part.at - part.first).astype(np.uint8), (part.last - part.first + 1).astype(np.uint8), own.least[i], own.many[i], i.astype(np.int32), chunk.data[flat])))
        return _as_table(out)

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        found = [unpack(blob, "u8", "u1", "u1", "i8", "?", "i4", "u1") for blob in table.column("blob").to_pylist()]
        hashes, before, count, least, many, entry = (np.concatenate([f[i] for f in found]) for i in range(6))
        before, count = before.astype(np.int64), count.astype(np.int64)
        data = np.concatenate([f[6] for f in found])
        starts = np.cumsum(count + size - 1) - (count + size - 1)
        rows = contexts(data, Runs(starts + before, starts, starts + count - 1, hashes), size)
        labels = np.column_stack([hashes.view(np.uint8).reshape(-1, 8), before.astype(np.uint8), count.astype(np.uint8), rows])
        sample, of = _distinct(labels, np.ascontiguousarray(labels).view(np.dtype((np.void, labels.shape[1]))).ravel())
        smallest = np.full(len(sample), NO_ID)
        np.minimum.at(smallest, of, least)
        grams = np.ascontiguousarray(rows[sample, size - GRAM : size])
        _, group = _distinct(grams, grams.view(np.dtype((np.void, GRAM))).ravel())
        sizes = np.bincount(group)
        mixed = np.flatnonzero(sizes[group] > 1)
        # entry, first string, strings, owner: one stretch if all contexts of the anchor are equal
        alone = np.flatnonzero((sizes[group] == 1)[of])
        verdicts = [(alone, np.zeros(len(alone), dtype=np.int64), count[alone], smallest[of[alone]])]
        if len(mixed):
            owners = string_owners(rows[sample[mixed]], group[mixed], before[sample[mixed]], count[sample[mixed]], smallest[mixed], size)
            place = np.full(len(sample), -1)
            place[mixed] = np.arange(len(mixed))
            # stretches of strings with one owner, in each distinct context
            steps = np.arange(owners.shape[1])
            offset = before[sample[mixed], None] - steps  # string number i starts before-i bytes ahead of the anchor
            by_string = np.take_along_axis(owners, np.clip(offset, 0, None), 1)
            valid = steps < count[sample[mixed], None]
            fresh = valid.copy()
            fresh[:, 1:] &= by_string[:, 1:] != by_string[:, :-1]
            fresh[:, 0] = valid[:, 0]
            row, first = np.nonzero(fresh)
            same = np.append(row[1:] == row[:-1], False)
            stop = np.where(same, np.append(first[1:], 0), count[sample[mixed]][row])
            reach = np.searchsorted(row, np.arange(len(mixed) + 1))
            which = np.flatnonzero(place[of] >= 0)
            p = place[of[which]]
            n = reach[p + 1] - reach[p]
            k = np.repeat(reach[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            verdicts.append((np.repeat(which, n), first[k], stop[k] - first[k], by_string[row[k], first[k]]))
        which, first, length, owner = (np.concatenate(v) for v in zip(*verdicts, strict=True))
        useful = (owner < least[which]) | many[which]
        which, first, length, owner = which[useful], first[useful], length[useful], owner[useful]
        of_blob = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])[which]
        order = np.argsort(of_blob, kind="stable")
        out = []
        for i, blob in zip(np.split(order, np.searchsorted(of_blob[order], np.arange(1, len(found)))), range(len(found)), strict=True):
            if len(i):
                w = which[i]
                out.append((-3, table.column("chunk")[blob].as_py(), pack(entry[w], first[i].astype(np.uint8), length[i].astype(np.uint8), owner[i])))
        return _as_table(out)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def remove(key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk.load(key[0].as_py())
        blobs: dict[int, list[bytes]] = {-2: [], -3: []}
        for kind, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind in blobs:
                blobs[kind].append(blob)
        gone = np.zeros(len(chunk.data) + 1, dtype=np.int32)
        if blobs[-3]:
            own = entries(chunk, shared_keys(blobs[-2]), size)
            found = [unpack(b, "i4", "u1", "u1", "i8") for b in blobs[-3]]
            entry, first, length, owner = (np.concatenate([f[i] for f in found]) for i in range(4))
            order = np.argsort(entry, kind="stable")
            entry, first, length, owner = entry[order], first[order].astype(np.int64), length[order].astype(np.int64), owner[order]
            low, high = np.searchsorted(entry, own.of_run), np.searchsorted(entry, own.of_run, side="right")
            n = high - low
            run = np.repeat(np.arange(len(n)), n)
            k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = own.runs.first[run] + first[k]
            later = owner[k] < chunk.owner(own.runs.first)[run]
            np.add.at(gone, start[later], 1)
            np.add.at(gone, (start + length[k] - 1 + size)[later], -1)
        gone = np.cumsum(gone)[:-1] > 0
        ids, sizes, removed, kept = [], [], [], []
        for doc_id, end, n in zip(chunk.ids.tolist(), chunk.ends.tolist(), np.diff(chunk.ends, prepend=0).tolist(), strict=True):
            mask = gone[end - n : end]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            ids.append(None if doc_id == NO_ID else doc_id)
            sizes.append(n)
            removed.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            kept.append(chunk.data[end - n : end][~mask].tobytes())
        return pa.table([ids, sizes, removed, kept], schema=result)

    kinds = "bucket long, chunk string, blob binary"
    cuts = stage(rows.mapInArrow(cut, kinds), "substrings-anchors")
    told = stage(cuts.where("bucket >= 0").groupBy("bucket").applyInArrow(tell, kinds), "substrings-shared")
    verdicts = stage(told.groupBy("chunk").applyInArrow(send, kinds).groupBy("bucket").applyInArrow(judge, kinds), "substrings-verdicts")
    joined = cuts.where("bucket = -1").unionByName(told).unionByName(verdicts)
    return joined.groupBy("chunk").applyInArrow(remove, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")

