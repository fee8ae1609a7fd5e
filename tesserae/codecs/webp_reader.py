"""A small VP8L reader, by which the encoder is checked: predictor and subtract-green transforms, one code group."""

import numpy as np

# Order of the code-length code.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


class Reader:
    def __init__(self, data):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").tolist()
        self.at = 0

    def take(self, n):
        v = sum(b << i for i, b in enumerate(self.bits[self.at : self.at + n]))
        self.at += n
        return v

    def code(self, size):
        lengths = [0] * size
        if self.take(1):
            n = self.take(1) + 1
            lengths[self.take(8 if self.take(1) else 1)] = 1
            if n == 2:
                lengths[self.take(8)] = 1
            return self.table(lengths)
        small = [0] * 19
        for s in ORDER[: 4 + self.take(4)]:
            small[s] = self.take(3)
        assert self.take(1) == 0
        table, i, last = self.table(small), 0, 8
        while i < size:
            s = self.symbol(table)
            if s < 16:
                lengths[i] = s
                last = s or last
                i += 1
            else:
                n = (3 + self.take(2)) if s == 16 else (3 + self.take(3)) if s == 17 else (11 + self.take(7))
                lengths[i : i + n] = [last if s == 16 else 0] * n
                i += n
        assert len(lengths) == size
        return self.table(lengths)

    @staticmethod
    def table(lengths):
        used = [i for i, n in enumerate(lengths) if n]
        if len(used) == 1:
            return used[0]
        out, code = {}, 0
        for n in range(1, 16):
            for i, v in enumerate(lengths):
                if v == n:
                    out[n, code] = i
                    code += 1
            code <<= 1
        assert sum(2.0**-n for n in lengths if n) == 1
        return out

    def symbol(self, table):
        if isinstance(table, int):
            return table
        v = 0
        for n in range(1, 16):
            v = v << 1 | self.take(1)
            if (n, v) in table:
                return table[n, v]
        raise ValueError("code")

    def value(self, symbol):
        if symbol < 4:
            return symbol + 1
        extra = (symbol - 2) >> 1
        return ((2 + (symbol & 1)) << extra) + self.take(extra) + 1

    def image(self, w, h, top):
        assert self.take(1) == 0
        if top:
            assert self.take(1) == 0
        green, red, blue, alpha, distance = (self.code(n) for n in (280, 256, 256, 256, 40))
        out = []
        while len(out) < w * h:
            s = self.symbol(green)
            if s < 256:
                r, b, a = self.symbol(red), self.symbol(blue), self.symbol(alpha)
                out.append((a, r, s, b))
            else:
                n, d = self.value(s - 256), self.value(self.symbol(distance))
                d = {1: w, 2: 1}[d] if d <= 2 else d - 120
                for _ in range(n):
                    out.append(out[-d])
        assert len(out) == w * h
        return np.array(out, np.int64).reshape(h, w, 4)


def read(data):
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and int.from_bytes(data[4:8], "little") == len(data) - 8
    r = Reader(data[20:])
    assert r.take(8) == 0x2F
    w, h = r.take(14) + 1, r.take(14) + 1
    r.take(4)
    assert (r.take(1), r.take(2), r.take(1), r.take(2)) == (1, 2, 1, 0)
    bits = r.take(3) + 2
    modes = r.image((w + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits, False)[..., 2]
    assert r.take(1) == 0
    rest = r.image(w, h, True)
    out = np.zeros_like(rest)
    for y in range(h):
        for x in range(w):
            if x == y == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0:
                p = out[0, x - 1]
            elif x == 0:
                p = out[y - 1, 0]
            else:
                left, top, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                m = modes[y >> bits, x >> bits]
                mean = (left + top) // 2
                if m == 11:
                    p = left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
                else:
                    p = {1: left, 2: top, 7: mean, 12: np.clip(left + top - corner, 0, 255), 13: np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255)}[m]
            out[y, x] = (rest[y, x] + p) % 256
    out[..., 1] = (out[..., 1] + out[..., 2]) % 256
    out[..., 3] = (out[..., 3] + out[..., 2]) % 256
    return out[..., [1, 2, 3, 0]].astype(np.uint8)
