"""Encoders of T.82 and T.88 for built documents, written apart from the decoders: they keep exact intervals or the standard's registers."""

import struct

from quire.formats import arithmetic


class QM:
    """The code as one whole number; nothing is emitted before the end."""

    def __init__(self):
        self.low, self.interval, self.shifts = 0, 0x10000, 0

    def put(self, bank, context, value):
        qe, likely, other = arithmetic.QM_STEPS[bank[context]]
        mps = bank[context] & 1
        rest = self.interval - qe
        if value == mps and rest >= 0x8000:
            self.interval = rest
            return
        lower = (value == mps) == (rest >= qe)  # the larger part belongs to the likelier symbol
        self.low, self.interval = (self.low, rest) if lower else (self.low + rest, qe)
        bank[context] = likely if value == mps else other
        while self.interval < 0x8000:
            self.low, self.interval, self.shifts = self.low << 1, self.interval << 1, self.shifts + 1

    def finish(self):
        bits = 16 + self.shifts
        pad = -bits % 8
        return (self.low << pad).to_bytes((bits + pad) // 8, "big")


class MQ:
    def __init__(self):
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, [0]

    def put(self, bank, context, value):
        qe, likely, other = arithmetic.MQ_STEPS[bank[context]]
        mps = bank[context] & 1
        self.a -= qe
        if value == mps:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            bank[context] = likely
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            bank[context] = other
        while not self.a & 0x8000:
            self.a, self.c, self.ct = self.a << 1, self.c << 1, self.ct - 1
            if not self.ct:
                self._byte()

    def _byte(self):
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c, self.ct = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19)
            self.c, self.ct = self.c & 0x7FFFF, 8

    def finish(self):
        most = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= most:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        body = bytes(self.out[1:])
        return (body[:-1] if body[-1] == 0xFF else body) + b"\xff\xac"


class Numbers:
    def __init__(self, coder):
        self.coder, self.banks = coder, {}

    def put(self, name, value):
        bank, path = self.banks.setdefault(name, [0] * 512), 1
        size = 0 if value is None else abs(value)
        k = max(i for i, (_, first) in enumerate(arithmetic.RANGES) if size >= first)
        count, first = arithmetic.RANGES[k]
        bits = [int(value is None or value < 0)] + [1] * k + [0] * (k < 5) + [(size - first) >> i & 1 for i in reversed(range(count))]
        for b in bits:
            self.coder.put(bank, path, b)
            path = path << 1 | b if path < 256 else (path << 1 | b) & 511 | 256

    def symbol(self, number, length):
        bank, path = self.banks.setdefault(f"IAID{length}", [0] * (2 << length)), 1
        for k in reversed(range(length)):
            b = number >> k & 1
            self.coder.put(bank, path, b)
            path = path << 1 | b


def pixel(rows, x, y):
    return rows[y][x] if 0 <= y < len(rows) and 0 <= x < len(rows[0]) else 0


def context(rows, x, y, order):
    out = 0
    for dx, dy in order:
        out = out << 1 | pixel(rows, x + dx, y + dy)
    return out


OWN, NEAR, FAR = [(-2, 0), (-1, 0)], [(k, -1) for k in range(-2, 3)], [(k, -2) for k in range(-1, 2)]


def type0_body(rows):
    coder, bank = QM(), [0] * 1024
    for y, row in enumerate(rows):
        same = row == (rows[y - 1] if y else [0] * len(row))
        coder.put(bank, 457, int(same))
        if not same:
            for x, value in enumerate(row):
                coder.put(bank, context(rows, x, y, OWN + NEAR + FAR), value)
    return coder.finish()


def put_pixels(coder, bank, rows):
    for y, row in enumerate(rows):
        for x, value in enumerate(row):
            coder.put(bank, context(rows, x, y, FAR + NEAR + OWN), value)


def put_refined(coder, bank, rows, reference, dx, dy):
    for y, row in enumerate(rows):
        for x, value in enumerate(row):
            own = context(rows, x, y, [(-1, -1), (0, -1), (1, -1), (-1, 0)])
            other = context(reference, x - dx, y - dy, [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1), (1, 1)])
            coder.put(bank, own << 6 | other, value)


def region(width, height, x=0, y=0, operator=0):
    return struct.pack(">IIIIB", width, height, x, y, operator)


def generic_region(rows, operator=0):
    coder = MQ()
    put_pixels(coder, [0] * 1024, rows)
    return region(len(rows[0]), len(rows), operator=operator) + b"\x04\x02\xff" + coder.finish()


def direct_dictionary(shapes):
    """Shapes in order of height; all are exported."""
    coder = MQ()
    numbers, bank, height = Numbers(coder), [0] * 1024, 0
    for h in sorted({len(s) for s in shapes}):
        numbers.put("IADH", h - height)
        height, width = h, 0
        for s in (s for s in shapes if len(s) == h):
            numbers.put("IADW", len(s[0]) - width)
            width = len(s[0])
            put_pixels(coder, bank, s)
        numbers.put("IADW", None)
    numbers.put("IAEX", 0)
    numbers.put("IAEX", len(shapes))
    return struct.pack(">H", 0x0800) + b"\x02\xff" + struct.pack(">II", len(shapes), len(shapes)) + coder.finish()


def refined_dictionary(imported, shape, number, dx, dy):
    """One new shape that refines an imported one; only the new one is exported."""
    coder = MQ()
    numbers, length = Numbers(coder), max(0, len(imported).bit_length())
    numbers.put("IADH", len(shape))
    numbers.put("IADW", len(shape[0]))
    numbers.put("IAAI", 1)
    numbers.symbol(number, length)
    numbers.put("IARDX", dx)
    numbers.put("IARDY", dy)
    put_refined(coder, [0] * 1024, shape, imported[number], dx, dy)
    numbers.put("IADW", None)
    numbers.put("IAEX", len(imported))
    numbers.put("IAEX", 1)
    return struct.pack(">H", 0x1802) + b"\x02\xff" + struct.pack(">II", 1, 1) + coder.finish()


def text_region(width, height, strips, flags=0x0010, symbols=1):
    """``strips``: (rise, first, [(gap before, across, symbol)]); two strips a row (LOGSBSTRIPS 1) if flags say so."""
    coder = MQ()
    numbers, length, count = Numbers(coder), max(0, (symbols - 1).bit_length()), 0
    numbers.put("IADT", 0)
    for rise, first, items in strips:
        numbers.put("IADT", rise)
        for k, (gap, across, number) in enumerate(items):
            numbers.put("IADS" if k else "IAFS", gap if k else first)
            if flags >> 2 & 3:
                numbers.put("IAIT", across)
            numbers.symbol(number, length)
            count += 1
        numbers.put("IADS", None)
    return region(width, height) + struct.pack(">HI", flags, count) + coder.finish()
