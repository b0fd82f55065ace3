"""Token ids of whole texts by the tokenizers library, with a table of chunks that repeat.

A byte-level BPE of this kind splits a text into words before it merges bytes. No word goes over a space that
has a non-space after it or before it: such a space is the first character of the next word, or of the white
space there. So the ids of a text are those of its chunks, each beginning with a space or at the text's start;
only a space with white space (or the text's end) on both sides can be grouped otherwise, and such texts go to
the tokenizer whole. The library encodes each chunk when a worker first meets it; numpy finds the repeats in the
bytes of an Arrow column, comparing whole chunks and not only their hashes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

#: Chunks kept by a worker and slots of their table; memory (about 70 MB), not results, depends on them.
MAX_CHUNKS, SLOTS = 1_000_000, 1 << 22
#: Bytes of a chunk that can be kept, and of new chunks that are encoded together.
WIDTH, CHAIN = 24, 1 << 14
_ENCODERS: dict[str, Encoder] = {}
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Bytes that can end and begin a white space character in UTF-8 (some others end and begin with them too).
_ENDS, _BEGINS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ENDS[[*range(9, 14), *range(28, 33), 0x80, 0x85, 0x9F, 0xA0, *range(0x81, 0x8B), 0xA8, 0xA9, 0xAF]] = True
_LAST = _ENDS.tolist()
_BEGINS[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def column_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, followed by a few zeros, and each value's start (and the last end)."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.zeros(offsets[-1] - offsets[0] + WIDTH + 8, dtype=np.uint8)
    if values.buffers()[2] is not None:
        data[: offsets[-1] - offsets[0]] = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of slices, one slice after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would take those of others
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=np.int64)  # bytes of each id: a sign of its name is a byte
        self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.slots = np.full(SLOTS, -1, dtype=np.int32)
        self.keys = np.zeros((1024, 3), dtype=np.uint64)
        self.first = np.zeros(1025, dtype=np.int64)  # of each chunk's ids
        self.ids = np.zeros(4096, dtype=np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)
        self.size = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def separate(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks, and each chunk's first place and number of ids in them.

        Chunks from a space to a non-space are set one after the other and encoded in long texts; the ids' sizes in
        bytes show where each chunk ends. Others, and texts whose ids do not end where a chunk ends, go one by one.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        chained = np.fromiter((c[0] == 32 and not _LAST[c[-1]] for c in chunks), bool, len(chunks)) & (size > 1)
        chain = np.flatnonzero(chained)
        ends = np.cumsum(size[chain])
        cuts = np.flatnonzero(np.diff(ends // CHAIN)) + 1
        groups = [g for g in np.split(chain, cuts) if len(g)]
        first, counts, out, used = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [np.zeros(0, np.uint32)], 0
        for group, ids in zip(groups, self.whole([b"".join([chunks[i] for i in g]).decode("utf-8") for g in groups]), strict=True):
            of = np.cumsum(self.sizes[ids]) if len(ids) and ids.max() < len(self.sizes) else np.zeros(0, np.int64)
            want = np.cumsum(size[group])
            at = np.searchsorted(of, want)
            if len(of) and at[-1] == len(of) - 1 and (of[at] == want).all():
                counts[group] = np.diff(at, prepend=-1)
                first[group] = used + at + 1 - counts[group]
                out.append(ids)
                used += len(ids)
            else:
                chained[group] = False
        for i, ids in zip(left := np.flatnonzero(~chained).tolist(), self.whole([chunks[i].decode("utf-8") for i in left]), strict=True):
            first[i], counts[i] = used, len(ids)
            out.append(ids)
            used += len(ids)
        return np.concatenate(out), first, counts

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys * _MIX).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(29)
        return ((h * _MIX[1]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _keep(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.size + len(keys) > MAX_CHUNKS:
            return
        end, used = self.size + len(keys), int(self.first[self.size])
        for name, need in (("keys", end), ("first", end + 1), ("ids", used + len(ids))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros((max(need, 2 * len(old)), *old.shape[1:]), dtype=old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.keys[self.size : end] = keys
        self.ids[used : used + len(ids)] = ids
        self.first[self.size + 1 : end + 1] = used + np.cumsum(counts)
        self.slots[self._slot(keys)] = np.arange(self.size, end)  # of two chunks with one slot, the last is found
        self.size = end

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column without nulls, and the number of ids of each value."""
        data, offsets = column_bytes(values)
        size, lengths = int(offsets[-1]), np.diff(offsets)
        if not size:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(lengths), dtype=np.int64)
        space = np.flatnonzero(data[:size] == 32)
        last = np.zeros(size + 1, dtype=bool)
        last[offsets[1:]] = True  # just after a value's end
        head = np.zeros(size + 1, dtype=bool)
        head[offsets[:-1][lengths > 0]] = True
        before, after = data[space - 1], data[space + 1]
        loose = space[_ENDS[before] & ~head[space] & (_BEGINS[after] | last[space + 1])]
        head[space] = True
        starts = np.flatnonzero(head[:size])
        ends = np.append(starts[1:], size)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        odd = np.zeros(len(lengths), dtype=bool)
        odd[np.searchsorted(offsets, loose, side="right") - 1] = True
        if odd.any():
            use = ~odd[owner]
            starts, ends, owner = starts[use], ends[use], owner[use]
        n = ends - starts
        words = np.ndarray((size + WIDTH,), dtype="<u8", buffer=data, strides=(1,))
        keys = np.stack([words[starts + 8 * k] & _MASK[np.clip(n - 8 * k, 0, 8)] for k in range(3)], axis=1) if len(starts) else np.zeros((0, 3), dtype=np.uint64)
        at = self.slots[self._slot(keys)]
        hit = (at >= 0) & (n <= WIDTH) & (self.keys[at] == keys).all(axis=1)
        counts = np.zeros(len(starts), dtype=np.int64)
        counts[hit] = self.first[at[hit] + 1] - self.first[at[hit]]
        miss = np.flatnonzero(~hit)
        raw = data.tobytes()
        chunks = [raw[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
        index = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
        fresh_ids, fresh_first, fresh_counts = self.separate(list(index))
        which = np.array([index[c] for c in chunks], dtype=np.int64)
        counts[miss] = fresh_counts[which]
        totals = np.bincount(owner, weights=counts, minlength=len(lengths)).astype(np.int64)
        whole = self.whole([raw[offsets[i] : offsets[i + 1]].decode("utf-8") for i in np.flatnonzero(odd)])
        for i, x in zip(np.flatnonzero(odd), whole, strict=True):
            totals[i] = len(x)
        first = np.cumsum(totals) - totals
        within = np.cumsum(counts) - counts
        each = np.bincount(owner, weights=counts, minlength=len(lengths)).astype(np.int64)
        place = within - (np.cumsum(each) - each)[owner] + first[owner]  # of each chunk's ids
        out = np.empty(int(totals.sum()), dtype=np.uint32)
        out[ragged(place[hit], counts[hit])] = self.ids[ragged(self.first[at[hit]], counts[hit])]
        out[ragged(place[miss], counts[miss])] = fresh_ids[ragged(fresh_first[which], counts[miss])]
        for i, x in zip(np.flatnonzero(odd), whole, strict=True):
            out[first[i] : first[i] + totals[i]] = x
        if len(miss):
            keep = np.unique(which[n[miss] <= WIDTH], return_index=True)
            rows = miss[n[miss] <= WIDTH][keep[1]]
            order = keep[0]
            self._keep(keys[rows], fresh_ids[ragged(fresh_first[order], fresh_counts[order])], fresh_counts[order])
        return out, totals


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
