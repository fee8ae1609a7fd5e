"""Codestream decoder: markers, packets, code blocks, wavelets and colour."""

from __future__ import annotations

import struct
from copy import copy
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tesserae.codecs.jpeg2000 import wavelet
from tesserae.codecs.jpeg2000.arith import HeaderReader, TagTree
from tesserae.codecs.jpeg2000.blocks import BYPASS, TERMALL, decode_block
from tesserae.errors import SlideFormatError, UnsupportedCompressionError

ceil_div = lambda a, b: -(-a // b)


def shifted(a: int, n: int) -> int:
    """a / 2**n rounded up."""
    return (a + (1 << n) - 1) >> n


@dataclass
class Component:
    precision: int
    signed: bool
    dx: int
    dy: int


@dataclass
class Style:
    levels: int = 0
    xcb: int = 6
    ycb: int = 6
    blocks: int = 0  # code-block style
    reversible: bool = True
    precincts: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Quant:
    kind: int = 0
    guard: int = 0
    steps: list[tuple[int, int]] = field(default_factory=list)  # exponent, mantissa


@dataclass
class Params:
    """Coding parameters; a tile's markers change a copy of the main header's."""

    order: int = 0
    layers: int = 1
    transform: int = 0
    sop: bool = False
    eph: bool = False
    style: Style | None = None
    styles: dict[int, Style] = field(default_factory=dict)
    quant: Quant | None = None
    quants: dict[int, Quant] = field(default_factory=dict)
    shifts: dict[int, int] = field(default_factory=dict)
    changes: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def fork(self) -> Params:
        out = copy(self)
        out.styles, out.quants, out.shifts, out.changes = dict(self.styles), dict(self.quants), dict(self.shifts), list(self.changes)
        return out


@dataclass
class CodeBlock:
    x0: int
    y0: int
    x1: int
    y1: int
    col: int
    row: int
    included: bool = False
    missing: int = 0
    length_bits: int = 3
    passes: int = 0
    segments: list[list] = field(default_factory=list)  # [bytes, passes, most passes]


@dataclass
class Precinct:
    blocks: list[CodeBlock]
    inclusion: TagTree
    planes: TagTree


@dataclass
class Band:
    kind: int
    x0: int
    y0: int
    x1: int
    y1: int
    planes: int = 0
    step: float = 1.0
    precincts: list[Precinct] = field(default_factory=list)


@dataclass
class Resolution:
    x0: int
    y0: int
    x1: int
    y1: int
    across: int
    down: int
    bands: list[Band]
    places: list[tuple[int, int]]  # of each precinct on the reference grid: y, x


def read_style(b: bytes, has_precincts: bool) -> Style:
    levels, xcb, ycb, blocks, transform = b[:5]
    precincts = [(v & 15, v >> 4) for v in b[5 : 6 + levels]] if has_precincts else []
    return Style(levels, (xcb & 15) + 2, (ycb & 15) + 2, blocks, transform == 1, precincts)


def read_quant(b: bytes) -> Quant:
    kind, guard = b[0] & 31, b[0] >> 5
    if kind == 0:
        return Quant(kind, guard, [(v >> 3, 0) for v in b[1:]])
    return Quant(kind, guard, [(v >> 11, v & 0x7FF) for (v,) in struct.iter_unpack(">H", b[1 : 1 + (len(b) - 1) // 2 * 2])])


def block_grid(x0: int, y0: int, x1: int, y1: int, xcb: int, ycb: int) -> tuple[list[tuple[int, ...]], int, int]:
    """The first fields of each code block, and how many stand across and down."""
    if x1 <= x0 or y1 <= y0:
        return [], 0, 0
    c0, c1, r0, r1 = x0 >> xcb, shifted(x1, xcb), y0 >> ycb, shifted(y1, ycb)
    out = []
    for r in range(r0, r1):
        for c in range(c0, c1):
            out.append((max(x0, c << xcb), max(y0, r << ycb), min(x1, c + 1 << xcb), min(y1, r + 1 << ycb), c - c0, r - r0))
    return out, c1 - c0, r1 - r0


def resolutions(box: tuple[int, int, int, int], style: Style, dx: int, dy: int, tile: tuple[int, int]) -> list[Resolution]:
    """The resolutions of a tile-component with bands, precincts and code blocks."""
    out = []
    small = (box[2] - box[0]) * (box[3] - box[1]) <= KEPT_AREA
    for *place, bands, places in (_kept_geometry if small else _geometry)(box, style.levels, style.xcb, style.ycb, tuple(style.precincts), dx, dy, tile):
        made = [Band(*b, precincts=[Precinct([CodeBlock(*f) for f in blocks], TagTree(cols, rows), TagTree(cols, rows)) for blocks, cols, rows in grids]) for b, grids in bands]
        out.append(Resolution(*place, made, places))
    return out


def _geometry(box: tuple[int, int, int, int], levels: int, xcb: int, ycb: int, precincts: tuple[tuple[int, int], ...], dx: int, dy: int, tile: tuple[int, int]) -> list[tuple]:
    """Of each resolution its place, precincts across and down, its bands as (kind and place, grids of code blocks), and its precincts' places."""
    out = []
    for r in range(levels + 1):
        n = levels - r
        x0, y0, x1, y1 = (shifted(v, n) for v in box)
        px, py = precincts[r] if precincts else (15, 15)
        across = shifted(x1, px) - (x0 >> px) if x1 > x0 else 0
        down = shifted(y1, py) - (y0 >> py) if y1 > y0 else 0
        bands = []
        for kind in (0,) if r == 0 else (1, 2, 3):
            nb = n if r == 0 else n + 1
            ox, oy = (kind & 1) << nb >> 1, (kind >> 1) << nb >> 1
            bx0, bx1 = (shifted(v - ox, nb) for v in (box[0], box[2]))
            by0, by1 = (shifted(v - oy, nb) for v in (box[1], box[3]))
            w, h = (px, py) if r == 0 else (px - 1, py - 1)
            grids = []
            for k in range(across * down):
                cx = ((x0 >> px) + k % across) << w
                cy = ((y0 >> py) + k // across) << h
                grids.append(block_grid(max(bx0, cx), max(by0, cy), min(bx1, cx + (1 << w)), min(by1, cy + (1 << h)), min(xcb, w), min(ycb, h)))
            bands.append(((kind, bx0, by0, bx1, by1), grids))
        places = []
        for k in range(across * down):
            gy = (((y0 >> py) + k // across) << py + n) * dy
            gx = (((x0 >> px) + k % across) << px + n) * dx
            places.append((max(gy, tile[1]), max(gx, tile[0])))
        out.append((x0, y0, x1, y1, across, down, bands, places))
    return out


#: Samples of a tile-component whose geometry is kept for the next one of its size.
KEPT_AREA = 1 << 20
_kept_geometry = lru_cache(maxsize=64)(_geometry)


class _Tile:
    def __init__(self, params: Params):
        self.params = params
        self.bodies: list[bytes] = []
        self.headers: list[tuple[int, bytes]] = []  # PPT, by index
        self.packed = b""  # PPM parts of this tile, in order


class Decoder:
    def __init__(self, data: bytes, reduction: int):
        self.data, self.reduction = data, reduction
        self.main = Params()
        self.tiles: dict[int, _Tile] = {}
        self.components: list[Component] = []
        self.decoded: dict[tuple, np.ndarray] = {}  # code blocks of a tile; of grey images, components have the same

    def fail(self, message: str):
        raise SlideFormatError(f"JPEG 2000: {message}")

    def run(self) -> np.ndarray:
        d = self.data
        if d[:4] != b"\xff\x4f\xff\x51":
            self.fail("no codestream")
        at, merged = 2, []
        while True:
            if at + 4 > len(d):
                self.fail("the main header is cut off")
            marker, size = struct.unpack(">HH", d[at : at + 4])
            if marker == 0xFF90:
                break
            body = d[at + 4 : at + 2 + size]
            if marker >> 8 != 0xFF or len(body) != size - 2:
                self.fail("a damaged main header")
            if marker == 0xFF51:
                self.read_size(body)
            elif marker == 0xFF50:
                raise UnsupportedCompressionError(33005, "high-throughput JPEG 2000")
            elif marker == 0xFF60:
                merged.append((body[0], body[1:]))
            else:
                self.read_parameter(self.main, marker, body)
            at += 2 + size
        if self.main.style is None or self.main.quant is None:
            self.fail("coding style or quantisation is missing")
        self.packed = self.split_packed(b"".join(b for _, b in sorted(merged))) if merged else None
        self.read_tile_parts(at)
        planes = self.new_planes()
        for index in sorted(self.tiles):
            self.decode_tile(index, self.tiles[index], planes)
        return self.assemble(planes)

    def read_size(self, b: bytes) -> None:
        _, self.x1, self.y1, self.x0, self.y0, self.tw, self.th, self.tx0, self.ty0, n = struct.unpack(">H8IH", b[:36])
        self.components = [Component((b[i] & 127) + 1, bool(b[i] >> 7), b[i + 1], b[i + 2]) for i in range(36, 36 + 3 * n, 3)]
        if not (self.x1 > self.x0 and self.y1 > self.y0 and self.tw and self.th and len(self.components) == n and all(c.dx and c.dy for c in self.components)):
            self.fail("an empty image")
        self.tiles_x = ceil_div(self.x1 - self.tx0, self.tw)

    def read_parameter(self, p: Params, marker: int, b: bytes) -> None:
        wide = len(self.components) > 256
        index = lambda: (struct.unpack(">H", b[:2])[0], b[2:]) if wide else (b[0], b[1:])
        if marker == 0xFF52:
            p.sop, p.eph = bool(b[0] & 2), bool(b[0] & 4)
            p.order, p.layers, p.transform = struct.unpack(">BHB", b[1:5])
            p.style = read_style(b[5:], bool(b[0] & 1))
            if p is not self.main:
                p.styles = {}
        elif marker == 0xFF53:
            c, rest = index()
            p.styles[c] = read_style(rest[1:], bool(rest[0] & 1))
        elif marker == 0xFF5C:
            p.quant = read_quant(b)
            if p is not self.main:
                p.quants = {}
        elif marker == 0xFF5D:
            c, rest = index()
            p.quants[c] = read_quant(rest)
        elif marker == 0xFF5E:
            c, rest = index()
            p.shifts[c] = rest[1]
        elif marker == 0xFF5F:
            one = ">BHHBHB" if wide else ">BBHBBB"
            p.changes += [x for x in struct.iter_unpack(one, b)]

    def split_packed(self, b: bytes) -> list[bytes]:
        out, at = [], 0
        while at + 4 <= len(b):
            n = struct.unpack(">I", b[at : at + 4])[0]
            out.append(b[at + 4 : at + 4 + n])
            at += 4 + n
        return out

    def read_tile_parts(self, at: int) -> None:
        d, part = self.data, 0
        while at + 12 <= len(d) and d[at : at + 2] == b"\xff\x90":
            index, length = struct.unpack(">HI", d[at + 4 : at + 10])
            end = at + length if length else len(d) - 2 * d.endswith(b"\xff\xd9")
            end = min(end, len(d))
            tile = self.tiles.setdefault(index, _Tile(self.main.fork()))
            fresh_changes = False
            p = at + 12
            while p + 2 <= end and d[p : p + 2] != b"\xff\x93":
                marker, size = struct.unpack(">HH", d[p : p + 4])
                body = d[p + 4 : p + 2 + size]
                if marker == 0xFF61:
                    tile.headers.append((body[0], body[1:]))
                else:
                    if marker == 0xFF5F and not fresh_changes and tile.params.changes == self.main.changes:
                        tile.params.changes, fresh_changes = [], True
                    self.read_parameter(tile.params, marker, body)
                p += 2 + size
            tile.bodies.append(d[p + 2 : end])
            if self.packed is not None and part < len(self.packed):
                tile.packed += self.packed[part]
            part += 1
            at = end

    def new_planes(self) -> list[np.ndarray]:
        out = []
        for c in self.components:
            lo = (shifted(ceil_div(self.x0, c.dx), self.reduction), shifted(ceil_div(self.y0, c.dy), self.reduction))
            hi = (shifted(ceil_div(self.x1, c.dx), self.reduction), shifted(ceil_div(self.y1, c.dy), self.reduction))
            out.append(np.zeros((hi[1] - lo[1], hi[0] - lo[0]), np.int64))
        return out

    def decode_tile(self, index: int, tile: _Tile, planes: list[np.ndarray]) -> None:
        p, q = index % self.tiles_x, index // self.tiles_x
        x0, y0 = max(self.tx0 + p * self.tw, self.x0), max(self.ty0 + q * self.th, self.y0)
        x1, y1 = min(self.tx0 + (p + 1) * self.tw, self.x1), min(self.ty0 + (q + 1) * self.th, self.y1)
        par = tile.params
        styles, all_res = [], []
        for i, c in enumerate(self.components):
            style = par.styles.get(i, par.style)
            if self.reduction > style.levels:
                self.fail("fewer resolutions than asked for")
            box = (ceil_div(x0, c.dx), ceil_div(y0, c.dy), ceil_div(x1, c.dx), ceil_div(y1, c.dy))
            res = resolutions(box, style, c.dx, c.dy, (x0, y0))
            quant, roi = par.quants.get(i, par.quant), par.shifts.get(i, 0)
            for r, rs in enumerate(res):
                for b in rs.bands:
                    self.set_step(b, r, quant, style, c.precision, roi)
            styles.append(style)
            all_res.append(res)
        self.read_packets(tile, styles, all_res)
        samples = [self.component(all_res[i], styles[i], par.shifts.get(i, 0)) for i in range(len(self.components))]
        self.decoded = {}
        self.colour(par, styles, samples)
        for i, c in enumerate(self.components):
            a = samples[i]
            if a.dtype != np.int64:
                a = np.where(a >= 0, np.floor(a + 0.5), np.ceil(a - 0.5)).astype(np.int64)
            if not c.signed:
                a = a + (1 << c.precision - 1)
            low, high = (-(1 << c.precision - 1), (1 << c.precision - 1) - 1) if c.signed else (0, (1 << c.precision) - 1)
            n = styles[i].levels - self.reduction
            rs = all_res[i][n]
            ox = rs.x0 - shifted(ceil_div(self.x0, c.dx), self.reduction)
            oy = rs.y0 - shifted(ceil_div(self.y0, c.dy), self.reduction)
            planes[i][oy : oy + a.shape[0], ox : ox + a.shape[1]] = np.clip(a, low, high)

    def set_step(self, b: Band, r: int, quant: Quant, style: Style, precision: int, roi: int) -> None:
        if quant.kind == 1:
            below = style.levels if r == 0 else style.levels - r + 1
            exponent, mantissa = quant.steps[0][0] - style.levels + below, quant.steps[0][1]
        else:
            i = 0 if r == 0 else 3 * (r - 1) + b.kind
            exponent, mantissa = quant.steps[min(i, len(quant.steps) - 1)]
        b.planes = quant.guard + exponent - 1 + roi
        gain = (0, 1, 1, 2)[b.kind]
        b.step = 2.0 ** (precision + gain - exponent) * (1 + mantissa / 2048)

    def packet_order(self, par: Params, styles: list[Style], res: list[list[Resolution]]):
        """(layer, resolution, component, precinct) of each packet."""
        sent: dict[tuple[int, int, int], int] = {}
        top = max(s.levels for s in styles) + 1
        volumes = par.changes or [(0, 0, par.layers, top, len(styles), par.order)]
        for r0, c0, layers, r1, c1, order in volumes:
            c1 = c1 or 256
            spots = [(r, c, k) for c in range(c0, min(c1, len(styles))) for r in range(r0, min(r1, styles[c].levels + 1)) for k in range(len(res[c][r].places))]
            layers = min(layers, par.layers)
            by_place = {
                2: lambda s: (s[0], *res[s[1]][s[0]].places[s[2]], s[1], s[2]),
                3: lambda s: (*res[s[1]][s[0]].places[s[2]], s[1], s[0], s[2]),
                4: lambda s: (s[1], *res[s[1]][s[0]].places[s[2]], s[0], s[2]),
            }
            if order == 0:
                each = [(n, s) for n in range(layers) for s in sorted(spots)]
            elif order == 1:
                each = [(n, s) for r in range(top) for n in range(layers) for s in sorted(spots) if s[0] == r]
            else:
                each = [(n, s) for s in sorted(spots, key=by_place[order]) for n in range(layers)]
            for n, s in each:
                if n == sent.get(s, 0):
                    sent[s] = n + 1
                    yield n, *s

    def read_packets(self, tile: _Tile, styles: list[Style], res: list[list[Resolution]]) -> None:
        body = b"".join(tile.bodies)
        outside = tile.packed or b"".join(b for _, b in sorted(tile.headers)) or None
        at = head_at = 0
        for layer, r, c, k in self.packet_order(tile.params, styles, res):
            if at >= len(body) and (outside is None or head_at >= len(outside)):
                return
            if body[at : at + 2] == b"\xff\x91":
                at += 6
            h = HeaderReader(body if outside is None else outside, at if outside is None else head_at)
            try:
                parts = self.read_header(h, res[c][r], k, layer, styles[c].blocks)
            except EOFError:
                return
            end = h.end()
            source = body if outside is None else outside
            if source[end : end + 2] == b"\xff\x92":
                end += 2
            if outside is None:
                at = end
            else:
                head_at = end
            for segment, size in parts:
                segment[0] += body[at : at + size]
                at += size

    def read_header(self, h: HeaderReader, rs: Resolution, k: int, layer: int, style: int) -> list[tuple[list, int]]:
        """(segment, bytes) of the packet's code blocks."""
        parts: list[tuple[list, int]] = []
        if not h.bit():
            return parts
        for band in rs.bands:
            p = band.precincts[k]
            for b in p.blocks:
                if b.included:
                    if not h.bit():
                        continue
                elif not p.inclusion.read(h, b.col, b.row, layer + 1):
                    continue
                else:
                    b.included = True
                    n = 1
                    while not p.planes.read(h, b.col, b.row, n):
                        n += 1
                    b.missing = n - 1
                passes = h.passes()
                while h.bit():
                    b.length_bits += 1
                while passes:
                    if not b.segments or b.segments[-1][1] == b.segments[-1][2]:
                        b.segments.append([b"", 0, self.most_passes(b.passes, style)])
                    s = b.segments[-1]
                    n = min(passes, s[2] - s[1])
                    parts.append((s, h.bits(b.length_bits + n.bit_length() - 1)))
                    s[1] += n
                    b.passes += n
                    passes -= n
        return parts

    @staticmethod
    def most_passes(done: int, style: int) -> int:
        """Passes that the segment beginning after `done` passes can hold."""
        if style & TERMALL:
            return 1
        if style & BYPASS:
            if done < 10:
                return 10 - done
            return 2 if done % 3 == 1 else 1
        return 1 << 30

    def component(self, res: list[Resolution], style: Style, roi: int) -> np.ndarray:
        """The samples of a tile-component at the wanted resolution."""
        out = None
        for r in range(style.levels - self.reduction + 1):
            rs = res[r]
            arrays = [self.band(b, style, roi) for b in rs.bands]
            if r == 0:
                out = arrays[0]
            else:
                out = wavelet.inverse((out, *arrays), rs.x0, rs.y0, rs.x1 - rs.x0, rs.y1 - rs.y0, style.reversible)
        return out

    def band(self, b: Band, style: Style, roi: int) -> np.ndarray:
        doubled = np.zeros((max(0, b.y1 - b.y0), max(0, b.x1 - b.x0)), np.int64)
        for p in b.precincts:
            for cb in p.blocks:
                segments = [(s[0], s[1]) for s in cb.segments if s[1]]
                if segments and b.planes - cb.missing > 0:
                    key = (tuple(segments), cb.x1 - cb.x0, cb.y1 - cb.y0, b.kind, b.planes - cb.missing, style.blocks)
                    if key not in self.decoded:
                        self.decoded[key] = decode_block(segments, *key[1:])
                    doubled[cb.y0 - b.y0 : cb.y1 - b.y0, cb.x0 - b.x0 : cb.x1 - b.x0] = self.decoded[key]
        if roi:
            size = np.abs(doubled)
            doubled = np.where(size >= 2 << roi, np.sign(doubled) * (size >> roi), doubled)
        if style.reversible:
            return np.sign(doubled) * (np.abs(doubled) >> 1)
        return doubled * (0.5 * b.step)

    def colour(self, par: Params, styles: list[Style], samples: list[np.ndarray]) -> None:
        if not par.transform or len(samples) < 3 or len({a.shape for a in samples[:3]}) > 1:
            return
        y, u, v = samples[:3]
        if styles[0].reversible:
            g = y - ((u + v) >> 2)
            samples[:3] = [v + g, g, u + g]
        else:
            samples[:3] = [y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u]

    def assemble(self, planes: list[np.ndarray]) -> np.ndarray:
        """Components repeated to the image's grid and scaled to eight bits."""
        w = shifted(self.x1, self.reduction) - shifted(self.x0, self.reduction)
        h = shifted(self.y1, self.reduction) - shifted(self.y0, self.reduction)
        out = np.zeros((h, w, len(planes)), np.uint8)
        for i, (c, a) in enumerate(zip(self.components, planes)):
            if not a.size:
                continue
            a = a + (1 << c.precision - 1) if c.signed else a
            if c.dx > 1 or c.dy > 1:
                a = a[np.minimum(np.arange(h) // c.dy, a.shape[0] - 1)][:, np.minimum(np.arange(w) // c.dx, a.shape[1] - 1)]
            extra = c.precision - 8
            out[..., i] = np.clip(a >> extra if extra > 0 else a << -extra, 0, 255)
        return out


def decode(data: bytes, reduction: int = 0) -> np.ndarray:
    """uint8 samples (height, width, components), with `reduction` resolutions left out."""
    return Decoder(data, reduction).run()
