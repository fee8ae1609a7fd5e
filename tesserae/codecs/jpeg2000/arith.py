"""The MQ coder, raw bits, and the bit-stuffed packet headers with tag trees."""

from __future__ import annotations

# MQ states, each (Qe, next after MPS, next after LPS, switch).
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
RUN, UNIFORM, N_CONTEXTS = 17, 18, 19


def _joined() -> list[tuple[int, int, int]]:
    """(Qe, next after MPS, next after LPS) of state * 2 + most probable symbol."""
    out = []
    for qe, mps, lps, switch in STATES:
        for bit in (0, 1):
            out.append((qe, mps * 2 + bit, lps * 2 + (bit ^ switch)))
    return out


JOINED = _joined()


def fresh_contexts() -> list[int]:
    out = [0] * N_CONTEXTS
    out[0], out[RUN], out[UNIFORM] = 4 * 2, 3 * 2, 46 * 2
    return out


class MqDecoder:
    def __init__(self, data: bytes):
        self.data = data + b"\xff\xff"
        self.at = 0
        self.c = self.data[0] << 16
        self.ct = 0
        self._fill()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _fill(self) -> None:
        if self.data[self.at] == 0xFF:
            if self.data[self.at + 1] > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += self.data[self.at] << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += self.data[self.at] << 8
            self.ct = 8

    def bit(self, contexts: list[int], i: int) -> int:
        s = contexts[i]
        qe, mps, lps = JOINED[s]
        a = self.a - qe
        d = s & 1
        if (self.c >> 16) < qe:
            if a < qe:
                contexts[i] = mps
            else:
                d ^= 1
                contexts[i] = lps
            a = qe
        else:
            self.c -= qe << 16
            if a & 0x8000:
                self.a = a
                return d
            if a < qe:
                d ^= 1
                contexts[i] = lps
            else:
                contexts[i] = mps
        while True:
            if self.ct == 0:
                self._fill()
            a <<= 1
            self.c <<= 1
            self.ct -= 1
            if a & 0x8000:
                break
        self.a = a
        return d


class RawBits:
    """Bits of a bypassed segment: after 0xFF a byte has seven."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.byte = data, 0, 0, 0

    def bit(self) -> int:
        if self.left == 0:
            stuffed = self.byte == 0xFF
            self.byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
            self.left = 7 if stuffed else 8
        self.left -= 1
        return self.byte >> self.left & 1


class MqEncoder:
    def __init__(self) -> None:
        self.a, self.c, self.ct = 0x8000, 0, 12
        self.out = bytearray(b"\0")  # the byte before the first

    def bit(self, contexts: list[int], i: int, d: int) -> None:
        s = contexts[i]
        qe, mps, lps = JOINED[s]
        self.a -= qe
        if d == s & 1:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            contexts[i] = mps
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            contexts[i] = lps
        while True:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if self.ct == 0:
                self._byte()
            if self.a & 0x8000:
                break

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 1 << 27:
            self.out[-1] += 1
            self.c &= (1 << 27) - 1
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c &= (1 << 20) - 1
            self.ct = 7
        else:
            self.out.append(self.c >> 19)
            self.c &= (1 << 19) - 1
            self.ct = 8

    def upper_length(self) -> int:
        """Bytes that surely hold all that was coded so far."""
        return len(self.out) - 1 + 4

    def flush(self) -> bytes:
        low = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= low:
            self.c -= 0x8000
        self.c <<= self.ct
        self._byte()
        self.c <<= self.ct
        self._byte()
        data = bytes(self.out[1:])
        return data[:-1] if data.endswith(b"\xff") else data


class HeaderReader:
    """Packet header bits; after 0xFF the next byte has seven."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.byte = data, at, 0, 0

    def bit(self) -> int:
        if self.left == 0:
            if self.at >= len(self.data):
                raise EOFError
            stuffed = self.byte == 0xFF
            self.byte = self.data[self.at]
            self.at += 1
            self.left = 7 if stuffed else 8
        self.left -= 1
        return self.byte >> self.left & 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def end(self) -> int:
        """The place after the header."""
        if self.byte == 0xFF:
            self.at += 1
        return self.at

    def passes(self) -> int:
        if not self.bit():
            return 1
        if not self.bit():
            return 2
        n = self.bits(2)
        if n < 3:
            return 3 + n
        n = self.bits(5)
        return 6 + n if n < 31 else 37 + self.bits(7)


class HeaderWriter:
    def __init__(self) -> None:
        self.out, self.byte, self.left = bytearray(), 0, 8

    def bit(self, b: int) -> None:
        self.left -= 1
        self.byte |= b << self.left
        if self.left == 0:
            self._next()

    def _next(self) -> None:
        self.out.append(self.byte)
        self.left = 7 if self.byte == 0xFF else 8
        self.byte = 0

    def bits(self, v: int, n: int) -> None:
        for i in range(n - 1, -1, -1):
            self.bit(v >> i & 1)

    def passes(self, n: int) -> None:
        if n == 1:
            self.bit(0)
        elif n == 2:
            self.bits(0b10, 2)
        elif n <= 5:
            self.bits(0b11, 2)
            self.bits(n - 3, 2)
        elif n <= 36:
            self.bits(0b1111, 4)
            self.bits(n - 6, 5)
        else:
            self.bits(0b111111111, 9)
            self.bits(n - 37, 7)

    def end(self) -> bytes:
        full = 7 if self.out and self.out[-1] == 0xFF else 8
        if self.left != full or full == 7:
            self._next()
            if self.out[-1] == 0xFF:
                self.out.append(0)
        return bytes(self.out)


#: The path in a tree of one leaf.
ROOT = [(0, 0)]


class TagTree:
    """Values of a grid of leaves; each node is the least of up to four below it."""

    def __init__(self, width: int, height: int):
        self.sizes = [(width, height)]
        while self.sizes[-1] != (1, 1) and width and height:
            w, h = self.sizes[-1]
            self.sizes.append((-(-w // 2), -(-h // 2)))
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.known = [[False] * (w * h) for w, h in self.sizes]
        self.value = [[0] * (w * h) for w, h in self.sizes]

    def set(self, values: list[int]) -> None:
        self.value[0] = list(values)
        for k in range(1, len(self.sizes)):
            w, h = self.sizes[k - 1]
            up = self.sizes[k][0]
            self.value[k] = [1 << 30] * (up * self.sizes[k][1])
            for i, v in enumerate(self.value[k - 1]):
                j = i // w // 2 * up + i % w // 2
                self.value[k][j] = min(self.value[k][j], v)

    def _path(self, x: int, y: int) -> list[tuple[int, int]]:
        if len(self.sizes) == 1:
            return ROOT
        return [(k, (y >> k) * self.sizes[k][0] + (x >> k)) for k in range(len(self.sizes) - 1, -1, -1)]

    def read(self, header: HeaderReader, x: int, y: int, limit: int) -> bool:
        """Whether the leaf's value is below limit."""
        low = 0
        for k, i in self._path(x, y):
            low = max(low, self.low[k][i])
            while low < limit and not self.known[k][i]:
                if header.bit():
                    self.known[k][i] = True
                else:
                    low += 1
            self.low[k][i] = low
        return self.known[0][y * self.sizes[0][0] + x] and low < limit

    def write(self, header: HeaderWriter, x: int, y: int, limit: int) -> None:
        low = 0
        for k, i in self._path(x, y):
            low = max(low, self.low[k][i])
            while low < limit and not self.known[k][i]:
                if self.value[k][i] > low:
                    header.bit(0)
                    low += 1
                else:
                    header.bit(1)
                    self.known[k][i] = True
            self.low[k][i] = low
