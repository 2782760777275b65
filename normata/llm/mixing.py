"""A context-mixing range coder for token ids, many blocks at a time.

Blocks of ids are coded on their own: each lists its alphabet and starts with an empty model, so a damaged block costs
no other. Within a block an id is coded as its place in the alphabet, with a probability mixed from three
predictions: by the ids before it of order two (a hashed table of the id that followed last), of order one
(likewise), and of order zero (how often the block has each id, which is listed beside the alphabet). What the first two
weigh depends on how often in a row they were right; a block lists for each such number the share of right ones.
The mixed interval drives a range coder with 24-bit words; carries are settled after the last id.

Arrays run over blocks: step t codes the t-th id of up to ``LANES`` blocks at once. Encoder and decoder
share the model, whose arithmetic is exact in double precision. Tables hold 16 or 32 bits an entry, and those of a lane
no more entries than its alphabet, so that they stay near the core.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a block, blocks coded together.
BLOCK, LANES = 4096, 2048
#: Entries of a lane's table of order two.
SLOTS = 1024
#: Bits of a mixed probability, and of a coder's word; two words are its state.
TOTAL, WORD = 18, 24
WHOLE, LEAST = float(1 << TOTAL), float(1 << WORD)
#: Right predictions in a row that are told apart; a share of them is of 256, and at most this, so each id keeps an interval.
ROW, MOST = 16, 224
#: Steps whose predictions are counted at a time.
STEPS = 256
#: A block's ids and distinct ids, the bytes of its lists, its words, and the CRC-32 of its ids (32 bits each).
BLOCK_TABLE = np.dtype([("ids", "<u4"), ("distinct", "<u4"), ("listed", "<u4"), ("words", "<u4"), ("crc", "<u4")])


class Model:
    """The predictions of all lanes; lane i has ``sizes[i]`` ids in its alphabet, ``counts`` has theirs, lane by lane."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
        lanes = len(sizes)
        self.offset, self.base, self.state = np.cumsum(sizes) - sizes, np.arange(lanes) * SLOTS, np.arange(lanes) * ROW
        counts = counts * np.repeat(BLOCK // lengths, sizes)  # a short block's ids share the slots of a whole one
        before = np.cumsum(counts) - counts
        before -= np.repeat(before[self.offset], sizes)
        self.spread = ((before << 16) | counts).astype(np.uint32)
        self.first, self.second = np.zeros(len(counts), np.uint16), np.zeros(lanes * SLOTS, np.uint16)
        self.at, self.hashed, self.last = self.offset, self.base, np.zeros(lanes, np.uint16)

    def weigh(self, shares: np.ndarray) -> None:
        """Take the listed shares: lanes by order (one, two) by row."""
        self.one = (256.0 - shares[:, 0].ravel()) / (256 * BLOCK)
        self.two = shares[:, 1].ravel() * (WHOLE / 256)

    def keep(self, n: int) -> None:
        """Go on with the first ``n`` lanes."""
        for name in ("offset", "base", "state", "at", "hashed", "last"):
            setattr(self, name, getattr(self, name)[:n])

    def foresee(self) -> tuple[np.ndarray, np.ndarray]:
        """The entries of order one and two: an id, and in the last four bits its row."""
        return self.first.take(self.at), self.second.take(self.hashed)

    def learn(self, x: np.ndarray, at: np.ndarray, rows: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> None:
        """Learn what the ids, with places ``at`` in the lists, were."""
        mark = (x << 4) | 1
        self.first[self.at] = mark + np.minimum(rows[0], 14) * right[0]
        self.second[self.hashed] = mark + np.minimum(rows[1], 14) * right[1]
        self.at, self.hashed, self.last = at, self.base + ((x * 2531 + self.last * 1033) & (SLOTS - 1)), x

    def weights(self, rows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the predictions of order one and two weigh, and what each slot of order zero does."""
        two = self.two.take(self.state + rows[1])
        rest = WHOLE - two
        slot = np.floor(rest * self.one.take(self.state + rows[0]))
        return rest - slot * BLOCK, two, slot

    def interval(self, x: np.ndarray, at: np.ndarray, foreseen: tuple, right: tuple, weights: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' intervals; what predictions add comes before an id's slots."""
        one, two, slot = weights
        spread = self.spread.take(at)
        start = (spread >> 16) * slot + one * (foreseen[0] < x) + two * (foreseen[1] < x)
        return start, (spread & 0xFFFF) * slot + one * right[0] + two * right[1]


def stretches(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin, end, lanes): steps during which the same lanes, the longest, have ids."""
    edges = [0, *sorted(set(lengths.tolist()))]
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, b, int((lengths >= b).sum())


def shares_of(entries: list[np.ndarray], places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often, of 256, each row's next prediction was right: lanes by order by row; where order two was right, order one is not judged."""
    lanes = len(lengths)
    state = np.arange(lanes) * ROW
    one, two = np.zeros(4 * ROW * lanes, np.int64), np.zeros(2 * ROW * lanes, np.int64)
    for begin, end, n in stretches(lengths):
        for t in range(begin, end, STEPS):
            own = slice(t, min(t + STEPS, end)), slice(0, n)
            hit = [entry[own] >> 4 == places[own] for entry in entries]
            keys = [((state[:n] + (entry[own] & 15)) << 1) + h for entry, h in zip(entries, hit, strict=True)]
            two += np.bincount(keys[1].ravel(), minlength=len(two))
            one += np.bincount(((keys[0] << 1) + hit[1]).ravel(), minlength=len(one))
    counted = np.stack([one.reshape(lanes, ROW, 2, 2)[..., 0], two.reshape(lanes, ROW, 2)], axis=1)
    return np.minimum(256 * (counted[..., 1] + 0.2) / (counted.sum(axis=-1) + 0.5), MOST).astype(np.uint8)


def encode_lanes(ids: list[np.ndarray], sizes: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words of each lane as bytes, and its shares; lanes hold places in their alphabets, the longest first."""
    lengths = np.array([len(x) for x in ids])
    lanes, longest = len(ids), int(lengths[0])
    places = np.zeros((lanes, longest), np.uint16)
    for lane, own in enumerate(ids):
        places[lane, : len(own)] = own
    places = np.ascontiguousarray(places.T)
    model, entries = Model(sizes, counts, lengths), [np.zeros((longest, lanes), np.uint16) for _ in range(2)]
    offset, state = model.offset, model.state
    for begin, end, n in stretches(lengths):
        model.keep(n)
        for t in range(begin, end):
            x = places[t, :n]
            one, two = entries[0][t, :n], entries[1][t, :n] = model.foresee()
            model.learn(x, model.offset + x, (one & 15, two & 15), (one >> 4 == x, two >> 4 == x))
    shares = shares_of(entries, places, lengths)
    model.weigh(shares)
    model.offset, model.state = offset, state
    low, width, to = np.zeros(lanes), np.full(lanes, LEAST * LEAST), np.arange(lanes) * (longest + 2)
    words = np.zeros((lanes, longest + 2), np.uint32)
    out = words.ravel()
    for begin, end, n in stretches(lengths):
        model.keep(n)
        lo, wide, own = low[:n], width[:n], to[:n]  # views
        for t in range(begin, end, 4):
            some = slice(t, min(t + 4, end)), slice(0, n)
            x, foreseen, rows = places[some], [e[some] >> 4 for e in entries], [e[some] & 15 for e in entries]
            right = foreseen[0] == x, foreseen[1] == x
            for start, size in zip(*model.interval(x, model.offset + x, foreseen, right, model.weights(rows)), strict=True):
                unit = np.floor(wide * (1 / WHOLE))
                lo += unit * start
                unit *= size
                word = np.floor(lo * (1 / LEAST))
                out[own] = word
                small = unit < LEAST
                times = small * (LEAST - 1)
                times += 1
                lo -= word * (small * LEAST)
                lo *= times
                np.multiply(unit, times, out=wide)
                own += small
    for _ in range(2):
        word = np.floor(low * (1 / LEAST))
        out[to] = word
        low = (low - word * LEAST) * LEAST
        to += 1
    filled = to - np.arange(lanes) * (longest + 2)
    words = np.ascontiguousarray(words[:, : filled.max()].T)
    for k in range(len(words) - 1, 0, -1):  # carries
        words[k - 1] += (words[k] >> WORD) * (k < filled)
    raw = words.T.astype(">u4", order="C").view(np.uint8).reshape(lanes, -1, 4)[:, :, 1:]
    return [lane[:n].tobytes() for lane, n in zip(raw, filled.tolist(), strict=True)], shares


def decode_lanes(words: list[bytes], lengths: np.ndarray, sizes: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Places in the alphabets, lanes by steps, from the words of each lane; the longest lane first."""
    lanes, longest = len(words), int(lengths[0])
    most = max(map(len, words)) // 3 + 2
    raw = np.zeros((lanes, most, 4), np.uint8)
    for lane, own in enumerate(words):
        raw[lane, : len(own) // 3, 1:] = np.frombuffer(own, np.uint8).reshape(-1, 3)
    read = raw.view(">u4").astype(np.uint32).ravel()
    model = Model(sizes, counts, lengths)
    model.weigh(shares)
    slots = np.zeros((lanes, BLOCK), np.uint16)
    for lane, (a, n) in enumerate(zip(model.offset.tolist(), sizes.tolist(), strict=True)):
        own = np.repeat(np.arange(n, dtype=np.uint16), model.spread[a : a + n] & 0xFFFF)
        slots[lane, : len(own)] = own
        slots[lane, len(own) :] = n - 1
    slots, table = slots.ravel(), np.zeros((longest, lanes), np.uint16)
    place, row = np.arange(lanes) * most, np.arange(lanes) * BLOCK
    code, width = read[place] * LEAST + read[place + 1], np.full(lanes, LEAST * LEAST)
    place += 2
    for begin, end, n in stretches(lengths):
        model.keep(n)
        code, width, place, row = code[:n], width[:n], place[:n], row[:n]
        for t in range(begin, end):
            one, two = model.foresee()
            p, q = foreseen = one >> 4, two >> 4
            rows = one & 15, two & 15
            one, two, slot = weights = model.weights(rows)
            width *= 1 / WHOLE
            unit = np.floor(width, out=width)
            v = code / unit
            np.minimum(np.floor(v, out=v), WHOLE - 1, out=v)
            before = v - (model.spread.take(model.offset + p) >> 16) * slot
            before -= two * (q < p)
            v -= np.minimum(np.maximum(before, 0, out=before), one, out=before)
            before = v - (model.spread.take(model.offset + q) >> 16) * slot
            v -= np.minimum(np.maximum(before, 0, out=before), two, out=before)
            v /= slot
            x = slots.take(row + v.astype(np.int64))
            at = model.offset + x
            right = p == x, q == x
            start, size = model.interval(x, at, foreseen, right, weights)
            code -= unit * start
            width *= size
            np.minimum(code, width - 1, out=code)  # as it is, but for damage
            small = width < LEAST
            times = small * (LEAST - 1)
            times += 1
            code *= times
            code += read.take(place, mode="clip") * small
            width *= times
            place += small
            table[t, :n] = x
            model.learn(x, at, rows, right)
    return np.ascontiguousarray(table.T)


def coded(ids: np.ndarray) -> bytes:
    """A stream of ids in independent blocks: their number, a table of blocks, lists, words."""
    ids = ids.astype("<u4", copy=False)
    blocks = [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]
    seen, place = np.zeros(int(ids.max(initial=0)) + 1, bool), np.zeros(int(ids.max(initial=0)) + 1, np.uint16)
    table, found, words = np.zeros(len(blocks), BLOCK_TABLE), [], []
    for begin in range(0, len(blocks), LANES):
        lanes, alphabets, counts = [], [], []
        for own in blocks[begin : begin + LANES]:
            seen[own] = True
            alphabet = np.flatnonzero(seen)
            seen[alphabet] = False
            place[alphabet] = np.arange(len(alphabet), dtype=np.uint16)
            lanes.append(place[own])
            alphabets.append(alphabet)
            counts.append(np.bincount(lanes[-1]))
        own, shares = encode_lanes(lanes, np.array([len(x) for x in alphabets]), np.concatenate(counts))
        words += own
        found += [lists(*x) for x in zip(alphabets, counts, shares, strict=True)]
        table["distinct"][begin : begin + LANES] = [len(x) for x in alphabets]
    table["ids"], table["crc"] = [len(x) for x in blocks], [zlib.crc32(x) for x in blocks]
    table["listed"], table["words"] = [len(x) for x in found], [len(w) // 3 for w in words]
    return b"".join([np.array([len(blocks)], "<u4").tobytes(), table.tobytes(), *found, *words])


def decoded(data: bytes, where: str = "") -> np.ndarray:
    """The ids of :func:`coded`; a block that does not match its checksum is an error."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    table = np.frombuffer(data, BLOCK_TABLE, n, 4)
    at = np.append(0, np.cumsum(table["listed"], dtype=np.int64)) + 4 + table.nbytes
    to = np.append(0, np.cumsum(3 * table["words"].astype(np.int64))) + at[-1]
    out = []
    for begin in range(0, n, LANES):
        own = table[begin : begin + LANES]
        found = [listed(data[at[k] : at[k + 1]], int(block["distinct"])) for k, block in enumerate(own, begin)]
        alphabets, counts, shares = zip(*found, strict=True)
        lengths, sizes = own["ids"].astype(np.int64), own["distinct"].astype(np.int64)
        for k, (length, counted) in enumerate(zip(lengths.tolist(), counts, strict=True), begin):
            if not 0 < counted.sum() == length <= BLOCK:
                raise ValueError(f"block {k}{where} does not match its checksum")
        words = [data[to[k] : to[k + 1]] for k in range(begin, begin + len(own))]
        places = decode_lanes(words, lengths, sizes, np.concatenate(counts), np.stack(shares))
        for k, (block, alphabet, of) in enumerate(zip(own, alphabets, places, strict=True), begin):
            ids = alphabet[of[: block["ids"]]].astype("<u4")
            if zlib.crc32(ids) != block["crc"]:
                raise ValueError(f"block {k}{where} does not match its checksum")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers as bytes: 255 for those of more, which follow in four bytes each."""
    return np.minimum(numbers, 255).astype(np.uint8).tobytes() + numbers[numbers >= 255].astype("<u4").tobytes()


def widened(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """The numbers of :func:`narrow`, and the bytes after them."""
    numbers = np.frombuffer(data, np.uint8, n).astype(np.int64)
    far = numbers == 255
    end = n + 4 * int(far.sum())
    numbers[far] = np.frombuffer(data[n:end], "<u4")
    return numbers, data[end:]


def lists(alphabet: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> bytes:
    """A block's ascending alphabet by its steps, the counts, and the shares, with Huffman codes for their bytes."""
    step = alphabet.copy()
    step[1:] -= alphabet[:-1] + 1
    huffman = zlib.compressobj(1, zlib.DEFLATED, -9, 8, zlib.Z_HUFFMAN_ONLY)
    return huffman.compress(narrow(step) + narrow(counts - 1) + shares.tobytes()) + huffman.flush()


def listed(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The alphabet, the counts and the shares of :func:`lists`."""
    try:
        step, rest = widened(zlib.decompress(data, -9), n)
    except zlib.error as damage:
        raise ValueError("lists are damaged") from damage
    counts, rest = widened(rest, n)
    return np.cumsum(step + 1) - 1, counts + 1, np.minimum(np.frombuffer(rest, np.uint8).reshape(2, ROW), MOST)
