"""Media columns as progressive JPEG.

A payload's bytes become the quantized coefficients of a 4:2:0 image, the unit of this format: byte b is the number whose
eight JPEG value bits are b, so coefficients 1 to 48 of each block hold 48 bytes and 576 bytes fill 12 blocks, two
units of 16 by 16 points. Scans select bands of the spectrum and approximate them successively: first a coarse one
without the lowest bit, then one that refines it. Reading accumulates all scans into arrays of coefficients,
transforms them back in numpy, upsamples chroma and gives a full-resolution RGB tensor.

Null and empty texts have a payload of 576 bytes of 255. Equal texts get equal rows: the transform is exact in integers. Rows
are stored one by one, so ties, repeated rows, repeated or null doc_ids, columns of any other names and empty tables need no
rule of their own."""

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

UNIT, BAND = 576, 48
#: Bands of coefficients of each component, and whether a scan without the lowest bit comes first.
BANDS = (((1, 16, True), (17, 48, False)), ((1, 48, False),), ((1, 48, False),))
#: Sampling factors of the three components.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Most units of 16 points along a side (sides have at most 65535 points), and most blocks that one end-of-band run spans.
MOST_SIDE, MOST_RUN = 4095, 32767
SCALE = 4096


def zigzag() -> np.ndarray:
    """Places in an 8 by 8 block, in the order of scans."""
    cells = sorted(((x + y, (y if (x + y) % 2 else x), y, x) for y in range(8) for x in range(8)))
    return np.array([y * 8 + x for _, _, y, x in cells])


def inverse_transform() -> np.ndarray:
    """From coefficients in scan order to samples, times SCALE, in whole numbers: sums stay exact in 32-bit floats."""
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(0.5), 1.0) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    both = np.einsum("uy,vx->uvyx", basis, basis).reshape(64, 64)
    return np.rint(both[zigzag()] * SCALE).astype(np.float32)


def padded(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def one_code(table: int, symbol: int) -> bytes:
    """A Huffman table with one code of one bit."""
    return marker(0xC4, bytes([table, 1] + [0] * 15 + [symbol]))


def packed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled up with ones, a zero behind each byte of ones."""
    fill = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(fill, np.uint8))) if fill else bits).tobytes().replace(b"\xff", b"\xff\x00")


def bits_of(values: np.ndarray, width: int) -> np.ndarray:
    """A row of width bits for each value below 2 ** 16, the highest first."""
    wide = np.unpackbits(values.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return wide[:, 16 - width :]


def numbers(rows: np.ndarray) -> np.ndarray:
    """The number that each row of at most 15 bits stands for."""
    wide = np.zeros((len(rows), 8 if rows.shape[1] <= 8 else 16), np.uint8)
    wide[:, wide.shape[1] - rows.shape[1] :] = rows
    return np.packbits(wide).view("u1" if wide.shape[1] == 8 else ">u2").astype(np.int16)


def runs(blocks: int) -> list[int]:
    """Lengths of end-of-band runs that span all blocks, of one bit length."""
    n = -(-blocks // MOST_RUN)
    return [blocks * (i + 1) // n - blocks * i // n for i in range(n)]


def encode(payload: bytes) -> bytes:
    units = len(payload) // UNIT
    wide = 2 * -(-units // MOST_SIDE)
    high = -(-2 * units // wide)
    luma, chroma = 4 * wide * high, wide * high
    rows = np.full(((luma + 2 * chroma), BAND), 255, np.uint8)
    rows[: units * 12] = np.frombuffer(payload, np.uint8).reshape(-1, BAND)
    out = [b"\xff\xd8", marker(0xFE, b"payload %d" % len(payload)), marker(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(marker(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))))
    scan = lambda parts, low, up, before, now, table=0: marker(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, table]) for i in parts) + bytes([low, up, before << 4 | now]))
    everything, blank = range(3), np.zeros(luma + 2 * chroma, np.uint8)
    out += [one_code(0x00, 0), one_code(0x10, 8), one_code(0x11, 7), scan(everything, 0, 0, 0, 1), packed(blank), scan(everything, 0, 0, 1, 0), packed(blank)]
    for i, own in enumerate(np.split(rows, [luma, luma + chroma])):
        for low, up, coarse in BANDS[i]:
            values = own[:, low - 1 : up]
            if not coarse:
                out += [scan([i], low, up, 0, 0), packed(bits_of(values.ravel(), 9).ravel())]
                continue
            # a code of one zero bit, then the seven higher bits
            out += [scan([i], low, up, 0, 1, 1), (values >> 1).tobytes()]
            # refinement bits are of magnitudes: those of negative numbers are inverted
            fine, bits, done = ((values & 1) ^ (values < 128)).astype(np.uint8), [], 0
            for run in runs(len(own)):
                n = run.bit_length() - 1
                bits += [bits_of(np.array([run - (1 << n)]), n + 1).ravel(), fine[done : done + run].ravel()]
                done += run
            out += [one_code(0x12, n << 4), scan([i], low, up, 1, 0, 2), packed(np.concatenate(bits))]
    return b"".join(out) + b"\xff\xd9"


class Bits:
    """Bits of a scan, one after the other."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits.tolist(), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Image:
    """A progressive JPEG file as arrays of coefficients in scan order, one for each component."""

    def __init__(self, data: bytes):
        self.tables: dict[int, dict[tuple[int, int], int]] = {}
        self.quantizers: dict[int, np.ndarray] = {}
        self.comment, at = b"", 2
        while data[at + 1] != 0xD9:
            kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                self.quantizers[body[0]] = np.frombuffer(body, np.uint8, 64, 1).astype(np.int32)
            elif kind == 0xC4:
                self.read_table(body)
            elif kind == 0xC2:
                self.read_frame(body)
            elif kind == 0xDA:
                end = NEXT_MARKER.search(data, at).start()
                self.read_scan(body, np.unpackbits(np.frombuffer(data[at:end].replace(b"\xff\x00", b"\xff"), np.uint8)))
                at = end
            elif kind not in range(0xE0, 0xF0):
                raise ValueError(f"marker {kind:x} isn't read")

    def read_table(self, body: bytes) -> None:
        counts, symbols, code, at = body[1:17], body[17:], 0, 0
        self.tables[body[0]] = table = {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = symbols[at]
                at, code = at + 1, code + 1
            code <<= 1

    def read_frame(self, body: bytes) -> None:
        self.height, self.width = struct.unpack_from(">HH", body, 1)
        self.sampling = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])]
        self.quantizer = [body[8 + 3 * i] for i in range(body[5])]
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        if self.height % (8 * v) or self.width % (8 * h):
            raise ValueError("only whole units are read")
        self.units = self.height // (8 * v), self.width // (8 * h)
        self.grid = [(self.units[0] * s[1], self.units[1] * s[0]) for s in self.sampling]
        self.coefficients = [np.zeros((rows * columns, 64), np.int16) for rows, columns in self.grid]

    def order(self, parts: list[int]) -> list[tuple[int, np.ndarray]]:
        """Component and block places in the order of an interleaved scan: for each unit, each component's blocks."""
        out = []
        for i in parts:
            rows, columns = self.grid[i]
            h, v = self.sampling[i] if len(parts) > 1 else (1, 1)
            out.append((i, np.arange(rows * columns).reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h)))
        return out

    def read_scan(self, body: bytes, bits: np.ndarray) -> None:
        parts = [body[1 + 2 * i] - 1 for i in range(body[0])]
        table = body[2] >> 4, body[2] & 15
        low, up, approx = body[1 + 2 * body[0] :]
        before, now = approx >> 4, approx & 15
        if low == 0:
            self.read_first(parts, bits, before, now, [self.tables.get(body[2 + 2 * i] >> 4, {}) for i in range(body[0])])
            return
        own, codes = self.coefficients[parts[0]][:, low : up + 1], self.tables[0x10 | table[1]]
        sole = next(iter(codes.values())) if len(codes) == 1 and (1, 0) in codes else None
        if not before:
            if sole is not None and not sole >> 4 and 0 < sole & 15 < 15:  # all codes alike: numbers of one width
                size = sole & 15
                v = numbers(bits[: own.size * (size + 1)].reshape(-1, size + 1)[:, 1:])
                v -= ((1 << size) - 1) * (v < 1 << (size - 1))
                own[:] = (v << now).reshape(own.shape)
            else:
                self.spread(Bits(bits), codes, own, now)
        elif sole is not None and not sole & 15 and sole >> 4 < 15 and own.all():  # runs of blocks with refinement bits only
            at = done = 0
            while done < len(own):
                n = sole >> 4
                run = (1 << n) + int("".join(map(str, bits[at + 1 : at + 1 + n])) or "0", 2)
                at += 1 + n
                fine = bits[at : at + run * own.shape[1]].reshape(run, -1).astype(np.int16) << now
                own[done : done + run] += np.where(own[done : done + run] > 0, fine, -fine)
                at, done = at + run * own.shape[1], done + run
        else:
            self.refine(Bits(bits), codes, own, now)

    def read_first(self, parts, bits, before, now, codes) -> None:
        blocks = sum(len(self.coefficients[i]) for i in parts)
        if before and not bits[:blocks].any() or not before and all(c == {(1, 0): 0} for c in codes):
            return  # nothing but zeros
        order = self.order(parts)
        per = [places.shape[1] for _, places in order]
        total = sum(p.size for _, p in order)
        if before:  # one more bit of each first coefficient
            values = bits[:total].reshape(-1, sum(per)).astype(np.int16) << now
        else:
            reader, values = Bits(bits), np.empty((total // sum(per), sum(per)), np.int16)
            for row in values:
                at = 0
                for n, c in zip(per, codes, strict=True):
                    for k in range(n):
                        row[at + k] = reader.value(reader.symbol(c))
                    at += n
        for (i, places), own in zip(order, np.split(values, np.cumsum(per)[:-1], axis=1), strict=True):
            if before:
                self.coefficients[i][places.ravel(), 0] |= own.ravel()
            else:
                self.coefficients[i][places.ravel(), 0] = np.cumsum(own.ravel()) << now

    @staticmethod
    def spread(reader: Bits, codes: dict, own: np.ndarray, now: int) -> None:
        """The first scan of a band, code by code."""
        skip = 0
        for block in own:
            if skip:
                skip -= 1
                continue
            k = 0
            while k < len(block):
                run, size = divmod(reader.symbol(codes), 16)
                if size:
                    k += run
                    block[k] = reader.value(size) * (1 << now)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) - 1 + reader.take(run)
                    break

    @staticmethod
    def refine(reader: Bits, codes: dict, own: np.ndarray, now: int) -> None:
        """A later scan of a band, code by code."""
        skip, one = 0, 1 << now
        correct = lambda c: c + (one if c > 0 else -one) * reader.take(1)
        for block in own:
            k = 0
            while k < len(block) and not skip:
                run, size = divmod(reader.symbol(codes), 16)
                fresh = 0
                if size:
                    fresh = one if reader.take(1) else -one
                elif run < 15:
                    skip = (1 << run) + reader.take(run)
                    break
                while k < len(block):
                    if block[k]:
                        block[k] = correct(block[k])
                    elif run:
                        run -= 1
                    else:
                        block[k] = fresh
                        k += 1
                        break
                    k += 1
            if skip:
                for j in range(k, len(block)):
                    if block[j]:
                        block[j] = correct(block[j])
                skip -= 1

    def rgb(self, inverse: np.ndarray) -> np.ndarray:
        """Full-resolution samples, height by width by 3, of the usual 4:2:0 or 4:4:4 colour space."""
        planes = []
        for c, (rows, columns), q in zip(self.coefficients, self.grid, self.quantizer, strict=True):
            scaled = c if (self.quantizers[q] == 1).all() else c * self.quantizers[q]
            samples = scaled.astype(np.float32) @ inverse
            samples *= np.float32(1 / SCALE)
            np.rint(samples, out=samples)
            samples += 128
            np.clip(samples, 0, 255, out=samples)
            planes.append(samples.astype(np.int16).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8))
        high, wide = (max(p.shape[k] for p in planes[1:]) for k in (0, 1))
        blue, red = (p.repeat(high // p.shape[0], 0).repeat(wide // p.shape[1], 1).astype(np.float32) - 128 for p in planes[1:])
        # each chroma sample goes to all points of its cell
        cells = (high, self.height // high, wide, self.width // wide)
        y, out = planes[0].repeat(self.height // planes[0].shape[0], 0).repeat(self.width // planes[0].shape[1], 1).reshape(cells), np.empty((*cells, 3), np.uint8)
        for i, more in enumerate((1.402 * red, -0.344136 * blue - 0.714136 * red, 1.772 * blue)):
            out[..., i] = np.clip(y + np.rint(more).astype(np.int16)[:, None, :, None], 0, 255)
        return out.reshape(self.height, self.width, 3)

    def payload(self) -> bytes:
        """The bytes that encode() was given."""
        n = int(self.comment.split()[1])
        rows = np.concatenate([c[:, 1 : BAND + 1] for c in self.coefficients])[: n // BAND]
        return np.where(rows > 0, rows, rows + 255).astype(np.uint8).tobytes()


NEXT_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xff]")


def store_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (size, means and CRC-32 of the RGB tensor) and, if asked for, media (the file) and tensor (its samples)."""

    def make():
        inverse = inverse_transform()
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def run(texts):
            rows = []
            for t in texts:
                media = encode(padded(t))
                image = Image(media)
                back, tensor = image.payload(), image.rgb(inverse)
                means = ",".join(f"{x:.3f}" for x in tensor.reshape(-1, 3).mean(0))
                row = (len(t or b""), len(back), sha(back), zlib.crc32(back[-32:]), len(media), sha(media), f"{image.height}x{image.width}:{means}:{zlib.crc32(tensor.data):08x}")
                rows.append(row + (media, tensor.tobytes()) * with_media)
            return list(map(list, zip(*rows, strict=True)))

        return run

    return map_texts(docs, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, tensor binary" * with_media, make)
