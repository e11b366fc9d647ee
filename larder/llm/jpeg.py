"""Progressive JPEG files with bytes as coefficients: encoding, decoding, tensors.

A payload of 64-byte blocks becomes a colour image of 4:2:0 sampling whose 8x8
blocks hold byte + 2 as quantised coefficients (all quantisers 1), so decoding the
coefficients gives the bytes back. The luminance blocks come first, then both
chroma planes; blocks beyond the payload hold zero bytes. Each component has six
scans: DC and two spectral bands, all without their lowest bit, then that bit by
successive approximation. Scans restart every RESTART blocks, and a batch's
restart segments are decoded side by side in numpy.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

RESTART = 4
BANDS = [(0, 0), (1, 5), (6, 63)]
#: Code lengths of the two Huffman tables, by symbol.
DC_LENGTHS = {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 4, 8: 5, 9: 6, 10: 7, 11: 8}
AC_LENGTHS = {6: 1, 5: 2, 7: 3, 1: 5, 2: 6, 3: 6, 4: 6, 8: 6, 0xF0: 10} | {r << 4: 10 for r in range(15)}
_PEEK = 16


def _zigzag() -> np.ndarray:
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    return np.array(order)


ZIGZAG = _zigzag()


def _canonical(lengths: dict[int, int]) -> tuple[bytes, list[int], dict[int, tuple[int, int]]]:
    """(counts by length, symbols in order, code and length by symbol)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    counts = bytes(sum(n == i for n in lengths.values()) for i in range(1, 17))
    return counts, symbols, codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DC, _AC = _canonical(DC_LENGTHS), _canonical(AC_LENGTHS)
_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    + _segment(0xC4, bytes([0x00]) + _DC[0] + bytes(_DC[1]))
    + _segment(0xC4, bytes([0x10]) + _AC[0] + bytes(_AC[1]))
    + _segment(0xDD, struct.pack(">H", RESTART))
)


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1]


# ---------------------------------------------------------------- encoding


def shape_of(blocks: int) -> tuple[int, int]:
    """(MCUs a row, rows) for so many blocks."""
    mcus = -(-blocks // 6)
    wide = min(mcus, max(64, -(-mcus // 4095)))
    return wide, -(-mcus // wide)


def _entropy(codes: np.ndarray, lengths: np.ndarray, owner: np.ndarray, segments: int, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packs codes into byte-aligned restart segments: (bytes, where each segment stops).

    owner: the segment of each code; last: whether a segment ends its scan; number: its restart number.
    """
    bits = np.bincount(owner, weights=lengths, minlength=segments).astype(np.int64)
    size = -(-bits // 8)
    first = np.cumsum(size) - size
    run = np.cumsum(lengths) - lengths
    begin = np.cumsum(bits) - bits
    at = first[owner] * 8 + (run - begin[owner])
    # a code of at most 25 bits lies in four bytes, which it shares with others bit by bit
    total = int(size.sum())
    width = int(-(-((at & 7) + lengths).max(initial=0) // 8))
    word = codes.astype(np.uint32) << (32 - (at & 7) - lengths).astype(np.uint32)
    at >>= 3
    data = np.zeros(total + 4, np.uint8)
    for i in range(width):
        part = (word >> np.uint32(24 - 8 * i)) & np.uint32(0xFF)
        data[i:] += np.bincount(at, weights=part, minlength=total + 4)[: total + 4 - i].astype(np.uint8)
    data = data[:total]
    data[(first + size - 1)[size > 0]] |= ((1 << (size * 8 - bits)) - 1)[size > 0].astype(np.uint8)  # padding bits are ones
    full = data == 0xFF
    stuffed = np.add.reduceat(np.append(full, False).astype(np.int64), first) if segments else size
    stuffed[size == 0] = 0
    length = size + stuffed + 2 * ~last
    stop = np.cumsum(length)
    final = np.zeros(int(stop[-1]) if segments else 0, np.uint8)
    step = np.ones(len(data), np.int64)
    step[1:] += full[:-1]
    place = np.cumsum(step) - 1 if len(data) else step
    which = np.repeat(np.arange(segments), size)
    place += 2 * (np.cumsum(~last) - ~last)[which]
    final[place] = data
    marks = np.flatnonzero(~last)
    final[stop[marks] - 2] = 0xFF
    final[stop[marks] - 1] = 0xD0 + number[marks] % 8
    return final, stop


def encode_payloads(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """A progressive JPEG file for each payload of 64-byte blocks; sizes: bytes before padding, kept in a comment."""
    shapes = [shape_of(len(p) // 64) for p in payloads]
    parts: list[list[bytes]] = []
    for p, n, (wide, high) in zip(payloads, sizes, shapes):
        frame = struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts.append([b"\xff\xd8" + _segment(0xFE, struct.pack(">QQ", n, len(p))) + _TABLES + _segment(0xC2, frame)])
    dc_code = np.array([_DC[2][c][0] for c in range(12)])
    dc_size = np.array([_DC[2][c][1] for c in range(12)])
    value = np.arange(2, 258) >> 1
    category = _bit_length(value)
    ac_code = np.array([_AC[2][c][0] << c for c in category.tolist()]) | value
    ac_size = np.array([_AC[2][c][1] + c for c in category.tolist()])
    for component in range(3):
        counts = np.array([w * h * (4 if component == 0 else 1) for w, h in shapes])
        rows = np.zeros((int(counts.sum()), 64), np.uint8)
        at = 0
        for p, (w, h), n in zip(payloads, shapes, counts.tolist()):
            skip = 0 if component == 0 else w * h * (3 + component)
            own = np.frombuffer(p, dtype=np.uint8)[skip * 64 : (skip + n) * 64].reshape(-1, 64)
            rows[at : at + len(own)] = own
            at += n
        per_doc = -(-counts // RESTART)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(np.cumsum(per_doc) - per_doc, counts) + inner // RESTART
        segments = int(per_doc.sum())
        number = np.arange(segments) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        last = number == np.repeat(per_doc, per_doc) - 1
        held = np.bincount(owner, minlength=segments)
        ends = np.cumsum(per_doc) - 1

        def scan(low: int, high: int, fine: bool, codes: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> None:
            data, stop = _entropy(codes, lengths, own, segments, last, number)
            header = _segment(0xDA, bytes([1, component + 1, 0x00, low, high, 0x10 if fine else 0x01]))
            raw, begin = data.tobytes(), 0
            for i, end in enumerate(stop[ends].tolist()):
                parts[i] += [header, raw[begin:end]]
                begin = end

        dc = (rows[:, 0].astype(np.int64) + 2) >> 1
        diff = dc - np.where(inner % RESTART == 0, 0, np.append(0, dc[:-1]))
        cat = _bit_length(np.abs(diff))
        scan(0, 0, False, (dc_code[cat] << cat) | np.where(diff < 0, diff + (1 << cat) - 1, diff), dc_size[cat] + cat, owner)
        for low, high in BANDS[1:]:
            flat = rows[:, low : high + 1].ravel()
            scan(low, high, False, ac_code[flat], ac_size[flat], np.repeat(owner, high - low + 1))
        scan(0, 0, True, rows[:, 0].astype(np.int64) & 1, np.ones(len(rows), np.int64), owner)
        for low, high in BANDS[1:]:
            width = high - low + 1
            power = _bit_length(held) - 1  # one end-of-band run over the segment, then its bits
            eob = np.array([_AC[2][r << 4] for r in range(15)])
            lead = (eob[power, 0] << power) | (held - (1 << power))
            bits = (rows[:, low : high + 1].astype(np.int64) & 1).ravel()
            own = np.concatenate([np.arange(segments), np.repeat(owner, width)])
            order = np.argsort(own, kind="stable")
            codes = np.concatenate([lead, bits])[order]
            lengths = np.concatenate([eob[power, 1] + power, np.ones(len(bits), np.int64)])[order]
            scan(low, high, True, codes, lengths, own[order])
    return [b"".join(p) + b"\xff\xd9" for p in parts]


# ---------------------------------------------------------------- decoding


@dataclass
class _File:
    """What the markers of one file say; scans: (component, low, high, ah, al, dc table, ac table, data).

    In an interleaved DC scan component and dc table are tuples over its components.
    """

    width: int = 0
    height: int = 0
    n_bytes: int = 0
    payload_bytes: int = 0
    restart: int = 0
    quant: dict = field(default_factory=dict)
    components: list = field(default_factory=list)
    scans: list = field(default_factory=list)


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(raw: bytes) -> _File:
    """Reads the markers; raises an error on what is no progressive file."""
    out, at, tables = _File(), 2, {}
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        if raw[at] != 0xFF:
            raise ValueError("no marker")
        while raw[at + 1] == 0xFF:
            at += 1
        marker = raw[at + 1]
        if marker == 0xD9:
            return out
        (length,) = struct.unpack_from(">H", raw, at + 2)
        body = raw[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE and len(body) == 16:
            out.n_bytes, out.payload_bytes = struct.unpack(">QQ", body)
        elif marker == 0xDB:
            while body:
                kind, size = (">u2", 128) if body[0] >> 4 else ("u1", 64)
                out.quant[body[0] & 15] = np.frombuffer(body, kind, 64, 1).astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]] = body[1:size]
                body = body[size:]
        elif marker == 0xDD:
            (out.restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive file")
        elif marker == 0xDA:
            stop = _NEXT.search(raw, at).start()
            names = [c[0] for c in out.components]
            if (n := body[0]) != 1:
                which = tuple(names.index(body[1 + 2 * i]) for i in range(n))
                low, high, bits = body[1 + 2 * n : 4 + 2 * n]
                if low or high:
                    raise ValueError("interleaved scan of AC coefficients")
                dc = tuple(tables.get(body[2 + 2 * i] >> 4) for i in range(n))
                out.scans.append((which, 0, 0, bits >> 4, bits & 15, dc, None, raw[at:stop]))
                at = stop
                continue
            which = names.index(body[1])
            out.scans.append((which, body[3], body[4], body[5] >> 4, body[5] & 15, tables.get(body[2] >> 4), tables.get(0x10 | body[2] & 15), raw[at:stop]))
            at = stop


def _lookup(table: bytes) -> tuple[np.ndarray, ...]:
    """Symbol and code length for every _PEEK bits; value and bits of code and value together, 0 bits if they are more or there is no value."""
    symbol, length = np.zeros(1 << _PEEK, np.int64), np.zeros(1 << _PEEK, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            low = code << (_PEEK - n)
            symbol[low : low + (1 << (_PEEK - n))] = table[at]
            length[low : low + (1 << (_PEEK - n))] = n
            code, at = code + 1, at + 1
        code <<= 1
    size = symbol & 15
    whole = (size > 0) & (length > 0) & (length + size <= _PEEK)
    bits = (np.arange(1 << _PEEK) >> np.maximum(_PEEK - length - size, 0)) & ((1 << size) - 1)
    value = np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)
    return symbol, length, np.where(whole, value, 0), np.where(whole, length + size, 0)


class _Lanes:
    """The restart segments of one scan of many files, decoded side by side."""

    def __init__(self, datas: list[bytes], blocks: list[int], firsts: list[int], restart: int):
        flat = np.frombuffer(b"".join(datas), np.uint8)
        ends = np.cumsum([len(d) for d in datas])
        high = np.flatnonzero(flat == 0xFF)
        follow = flat[np.minimum(high + 1, len(flat) - 1)]
        mark = high[(follow >= 0xD0) & (follow <= 0xD7)]
        keep = np.ones(len(flat), bool)
        keep[high[follow == 0] + 1] = False
        keep[mark] = False
        keep[mark + 1] = False
        kept = np.append(0, np.cumsum(keep))
        begin = np.sort(np.concatenate([ends - np.array([len(d) for d in datas]), mark + 2]))
        data = np.append(flat[keep], np.full(8, 0xFF, np.uint8)).astype(np.int32)
        self.words = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]  # 24 bits from each byte on
        self.bits = np.unpackbits(flat[keep])
        self.pos = kept[begin] * 8
        counts = np.array(blocks)
        lanes = -(-counts // restart) if restart else np.minimum(counts, 1)
        if len(begin) != lanes.sum():
            raise ValueError("restart markers are missing")
        inner = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        step = restart or 1 << 40
        self.first = np.repeat(np.array(firsts), lanes) + inner * step
        self.held = np.minimum(step, np.repeat(counts, lanes) - inner * step)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The 16 bits at each position."""
        return (self.words[pos >> 3] >> (8 - (pos & 7))) & 0xFFFF

    def take(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits, at most 16, at each position."""
        return self.peek(pos) >> (16 - n)

    def dc_first(self, out: np.ndarray, al: int, table: tuple) -> None:
        symbol, length = table[:2]
        pos, lane, predicted = self.pos.copy(), np.arange(len(self.pos)), np.zeros(len(self.pos), np.int64)
        for b in range(int(self.held.max(initial=0))):
            lane = lane[self.held[lane] > b]
            p = pos[lane]
            x = self.peek(p)
            n = symbol[x]
            p = p + length[x]
            v = self.take(p, n)
            predicted[lane] += np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)
            out[self.first[lane] + b, 0] = predicted[lane] << al
            pos[lane] = p + n

    def dc_interleaved(self, out: np.ndarray, al: int, tables: list[tuple], pattern: list[int]) -> None:
        """dc_first over units whose blocks belong to the components of `pattern`, each with its own table and prediction."""
        pos, lane = self.pos.copy(), np.arange(len(self.pos))
        predicted = np.zeros((len(tables), len(pos)), np.int64)
        for b in range(int(self.held.max(initial=0))):
            c = pattern[b % len(pattern)]
            symbol, length = tables[c][:2]
            lane = lane[self.held[lane] > b]
            p = pos[lane]
            x = self.peek(p)
            n = symbol[x]
            p = p + length[x]
            v = self.take(p, n)
            predicted[c, lane] += np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)
            out[self.first[lane] + b, 0] = predicted[c, lane] << al
            pos[lane] = p + n

    def dc_refine(self, out: np.ndarray, al: int) -> None:
        block = np.repeat(self.first, self.held) + (inner := np.arange(int(self.held.sum())) - np.repeat(np.cumsum(self.held) - self.held, self.held))
        out[block, 0] |= self.bits[np.repeat(self.pos, self.held) + inner].astype(out.dtype) << al

    def ac_first(self, out: np.ndarray, low: int, high: int, al: int, table: tuple) -> None:
        symbol, length, value, advance = table
        value, runs = value << al, symbol >> 4
        pos, block, stop = self.pos.copy(), self.first.copy(), self.first + self.held
        k = np.full(len(pos), low)
        flat = out.reshape(-1)
        while len(pos):
            x = self.peek(pos)
            step = advance[x]
            at = slice(None) if step.all() else np.flatnonzero(step)
            y = x[at]
            k[at] += runs[y]
            flat[(block[at] << 6) + k[at]] = value[y]
            k[at] += 1
            pos += step
            if not isinstance(at, slice):
                self._ac_rare(flat, np.flatnonzero(step == 0), x, pos, block, k, low, al, symbol, length)
            over = k > high
            if over.any():
                block[over] += 1
                k[over] = low
            going = block < stop
            if not going.all():
                pos, block, k, stop = pos[going], block[going], k[going], stop[going]

    def _ac_rare(self, flat, at, x, pos, block, k, low, al, symbol, length) -> None:
        """Zero runs, end-of-band runs, and values whose code and bits exceed 16 together."""
        s = symbol[x[at]]
        pos[at] += length[x[at]]
        run, n = s >> 4, s & 15
        some = at[n > 0]
        k[some] += run[n > 0]
        bits = n[n > 0]
        v = self.take(pos[some], bits)
        flat[(block[some] << 6) + k[some]] = np.where(v < (1 << (bits - 1)), v - (1 << bits) + 1, v) << al
        pos[some] += bits
        k[some] += 1
        k[at[(n == 0) & (run == 15)]] += 16
        ended = (n == 0) & (run < 15)
        end, run = at[ended], run[ended]
        block[end] += (1 << run) + self.take(pos[end], run)
        pos[end] += run
        k[end] = low

    def ac_refine(self, out: np.ndarray, low: int, high: int, al: int, table: tuple) -> None:
        symbol, length = table[:2]
        x = self.peek(self.pos)
        s = symbol[x]
        run = s >> 4
        start = self.pos + length[x]
        whole = ((s & 15) == 0) & (run < 15)
        whole &= (1 << np.where(whole, run, 0)) + self.take(start, np.where(whole, run, 0)) == self.held
        # a segment that is one end-of-band run: only bits of known coefficients follow
        lanes = np.flatnonzero(whole)
        held = self.held[lanes]
        block = np.repeat(self.first[lanes], held) + np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
        old = out[block, low : high + 1]
        known = old != 0
        counts = known.sum(axis=1)
        lane_counts = np.add.reduceat(counts, np.cumsum(held) - held) if len(held) else counts
        index = np.arange(int(counts.sum())) - np.repeat(np.cumsum(lane_counts) - lane_counts, lane_counts)
        bit = self.bits[np.repeat((start + run)[lanes], lane_counts) + index].astype(out.dtype)
        old[known] += np.sign(old[known]) * (bit << al)
        out[block, low : high + 1] = old
        for lane in np.flatnonzero(~whole).tolist():
            self._refine_lane(out, int(lane), low, high, al, table)

    def _refine_lane(self, out: np.ndarray, lane: int, low: int, high: int, al: int, table: tuple) -> None:
        """One segment with newly nonzero coefficients, symbol by symbol."""
        symbol, length = table[:2]
        pos, left = int(self.pos[lane]), 0

        def refine(row: np.ndarray, k: int) -> None:
            nonlocal pos
            if self.bits[pos]:
                row[k] += (1 << al) if row[k] > 0 else -(1 << al)
            pos += 1

        for b in range(int(self.held[lane])):
            row, k = out[int(self.first[lane]) + b], low
            while k <= high and not left:
                x = int(self.peek(np.array([pos]))[0])
                s = int(symbol[x])
                pos += int(length[x])
                run, n = s >> 4, s & 15
                if not n and run < 15:
                    left = (1 << run) + (int(self.take(np.array([pos]), np.array([run]))[0]) if run else 0)
                    pos += run
                    break
                new = 0
                if n:
                    new = (1 << al) if self.bits[pos] else -(1 << al)
                    pos += 1
                while k <= high:
                    if row[k]:
                        refine(row, k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if k <= high and new:
                    row[k] = new
                k += 1
            if left:
                for j in range(k, high + 1):
                    if row[j]:
                        refine(row, j)
                left -= 1


@dataclass
class Image:
    """A decoded file: coefficients by component, (blocks, 64) in zigzag order, and its header."""

    header: _File
    coefficients: list[np.ndarray]

    def payload(self) -> bytes:
        """The bytes stored by encode_payloads."""
        return (np.concatenate(self.coefficients).ravel() - 2).astype(np.uint8).tobytes()[: self.header.payload_bytes]


def _units(header: _File, which: tuple[int, ...]) -> tuple[int, list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Number of units of an interleaved scan, the component (place in `which`) of each block of a unit, and
    for each component (places in the scan, its blocks); blocks that only fill up a unit are left out."""
    across, down = (max(x[i] for x in header.components) for i in (1, 2))
    wide, high = -(-header.width // (8 * across)), -(-header.height // (8 * down))
    pattern = [i for i, c in enumerate(which) for _ in range(header.components[c][1] * header.components[c][2])]
    unit, maps, before = np.arange(wide * high), [], 0
    for c in which:
        _, hs, vs, _ = header.components[c]
        columns, rows = -(-header.width * hs // (8 * across)), -(-header.height * vs // (8 * down))
        inner = np.arange(hs * vs)
        x = (unit[:, None] % wide * hs + inner % hs).ravel()
        y = (unit[:, None] // wide * vs + inner // hs).ravel()
        place = (unit[:, None] * len(pattern) + before + inner).ravel()
        inside = (x < columns) & (y < rows)
        maps.append((place[inside], (y * columns + x)[inside]))
        before += hs * vs
    return wide * high, pattern, maps


def decode_files(files: list[bytes]) -> list[Image]:
    """Accumulates the scans of all files into coefficient arrays."""
    headers = [parse(f) for f in files]
    frames: dict[tuple, np.ndarray] = {}
    offsets: dict[int, list[int]] = {}
    counts: dict[int, list[int]] = {}
    for c in range(max((len(h.components) for h in headers), default=0)):
        counts[c] = []
        for h in headers:
            if c < len(h.components):
                across, down = (max(x[i] for x in h.components) for i in (1, 2))
                _, hs, vs, _ = h.components[c]
                counts[c].append(-(-h.width * hs // (8 * across)) * -(-h.height * vs // (8 * down)))
            else:
                counts[c].append(0)
        offsets[c] = (np.cumsum(counts[c]) - counts[c]).tolist()
        frames[c] = np.zeros((sum(counts[c]), 64), np.int32)
    known: dict[bytes, tuple] = {}
    for turn in range(max((len(h.scans) for h in headers), default=0)):
        alike: dict[tuple, list[int]] = {}
        for i, h in enumerate(headers):
            if turn < len(h.scans):
                shape = tuple(x[1:3] for x in h.components) if isinstance(h.scans[turn][0], tuple) else ()
                alike.setdefault((*h.scans[turn][:7], h.restart, shape), []).append(i)
        for (c, low, high, ah, al, dc, ac, restart, _), which in alike.items():
            if isinstance(c, tuple):
                made = [_units(headers[i], c) for i in which]
                blocks, pattern = [m[0] * len(m[1]) for m in made], made[0][1]
                begins = np.cumsum(blocks) - blocks
                lanes = _Lanes([headers[i].scans[turn][7] for i in which], blocks, begins.tolist(), restart * len(pattern))
                held = np.zeros((sum(blocks), 1), np.int32)
                if ah:
                    lanes.dc_refine(held, al)
                else:
                    lanes.dc_interleaved(held, al, [known.setdefault(t, _lookup(t)) for t in dc], pattern)
                for i, begin, (_, _, maps) in zip(which, begins, made):
                    for own, (place, block) in zip(c, maps):
                        frames[own][offsets[own][i] + block, 0] |= held[begin + place, 0]
                continue
            lanes = _Lanes([headers[i].scans[turn][7] for i in which], [counts[c][i] for i in which], [offsets[c][i] for i in which], restart)
            raw = dc if low == 0 else ac
            table = known.setdefault(raw, _lookup(raw)) if raw not in known and raw is not None else known.get(raw)
            if low == 0:
                lanes.dc_refine(frames[c], al) if ah else lanes.dc_first(frames[c], al, table)
            else:
                lanes.ac_refine(frames[c], low, high, al, table) if ah else lanes.ac_first(frames[c], low, high, al, table)
    return [
        Image(h, [frames[c][offsets[c][i] : offsets[c][i] + counts[c][i]] for c in range(len(h.components))]) for i, h in enumerate(headers)
    ]


def read_files(files: list[bytes]) -> list[tuple[Image, np.ndarray] | None]:
    """Image and tensor of each file, None for one that cannot be decoded; the others of the list do not suffer."""
    try:
        return [(i, rgb(i)) for i in decode_files(files)]
    except (ValueError, LookupError, TypeError, AttributeError, ArithmeticError, MemoryError, struct.error):
        return [None] if len(files) == 1 else [read_files([f])[0] for f in files]


def _basis() -> np.ndarray:
    """The inverse transform of a zigzag block as integers scaled by 2**20: exact in float64 whatever the order of the sums."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    both = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << 20))


_BASIS = _basis()


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples of 0 to 255."""
    made = (coefficients * quant).astype(np.float64) @ _BASIS
    return np.clip(np.floor(made / (1 << 20) + 128.5), 0, 255).astype(np.int32).reshape(-1, 8, 8)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3), chroma repeated to the size of luminance."""
    h = image.header
    across, down = max(c[1] for c in h.components), max(c[2] for c in h.components)
    planes = []
    for (_, hs, vs, q), own in zip(h.components, image.coefficients):
        wide, high = -(-h.width * hs // (8 * across)), -(-h.height * vs // (8 * down))
        plane = samples(own, h.quant[q]).reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)
        planes.append(np.repeat(np.repeat(plane, down // vs, axis=0), across // hs, axis=1)[: h.height, : h.width])
    if len(planes) == 1:
        planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    r = y + ((91881 * cr + 32768) >> 16)
    g = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
    b = y + ((116130 * cb + 32768) >> 16)
    return np.clip(np.stack([r, g, b], axis=-1), 0, 255).astype(np.uint8)
