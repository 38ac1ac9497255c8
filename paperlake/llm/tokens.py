"""Words of many texts at once, as 64-bit hashes, with numpy over Arrow string columns (helpers that run inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at once; a longer text is taken alone.
SLICE_BYTES = 2 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its lower-cased value plus one if it belongs to a word, else 0; and a random odd weight for each place."""
    value = np.zeros(256, np.uint64)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if 48 <= low <= 57 or 97 <= low <= 122 or low >= 128:
            value[b] = low + 1
    weight = np.random.default_rng(20250101).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return value, weight


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of texts of about limit bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and for each text the place of its first word among them (one more entry at the end).

    A word is a run of digits, ASCII letters (A-Z count as a-z) and bytes outside ASCII; texts end words.
    """
    VALUE, WEIGHT = _tables()
    value = VALUE[data]
    word = value != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = word[edges]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(at, append=len(data))
    place = np.arange(at[0], len(data), dtype=np.int64) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(value[at[0] :] * WEIGHT[place & 63], at - at[0])
        h = mix(h)
    return h, np.searchsorted(at, offsets)


def words_of(text: str | None) -> list[str]:
    """The same words as strings, for small inputs."""
    out, run = [], []
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            run.append(b)
        elif run:
            out.append(bytes(run).decode())
            run = []
    return out + ([bytes(run).decode()] if run else [])


def hash_texts(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each of a few texts."""
    out = []
    for _, _, data, offsets in slices(pa.array(texts, pa.string())):
        h, first = hash_words(data, offsets)
        out += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of key, from batches that are sorted by it. Holds one batch and one run at a time."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        if rest and rest[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        change = np.flatnonzero(k[1:] != k[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = [b.slice(cut)]
        else:
            rest.append(b)
    if rest:
        yield pa.Table.from_batches(rest)
